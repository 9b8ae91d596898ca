"""Cells (model, benchmark): coverage, gaps between clean and contaminated items, strata, quantile splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import phi, risk_class
from .quantiles import quantiles, same, with_quantiles

CELL = ["model", "benchmark"]


def rate(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def align_by_item(scores: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Scores and outcomes of the same item, by key and never by position."""
    return scores.join(outcomes, [*CELL, "item_id"])


def audit_summary(audit: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or CELL
    means = audit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), F.avg("p").alias("p_mean"), rate(F.col("p") > 0.5).alias("high_risk_rate"), F.avg("loss").alias("mean_loss"), F.avg("delta").alias("mean_delta"))
    q = quantiles(audit, "p", keys, {"p_p90": 0.9}).withColumnsRenamed({k: f"_q_{k}" for k in keys})
    return means.join(q, same(keys, "_q_"), "left").select(*keys, "n_items", "p_mean", "p_p90", "high_risk_rate", "mean_loss", "mean_delta")


def coverage(audit: DataFrame, keys: list[str]) -> DataFrame:
    k = risk_class(F.col("p"))
    return audit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), *[F.count_if(k == c).alias(f"n_{c}") for c in ("clean", "mid", "contam")]).withColumn("frac_contam", F.col("n_contam") / F.col("n_total"))


def salvageability(audit: DataFrame) -> DataFrame:
    r = audit.groupBy("benchmark").agg(rate(F.col("p") > 0.5).alias("rate"))
    return r.withColumn("verdict", F.when(F.col("rate") < 0.05, "clean").when(F.col("rate") < 0.25, "salvageable").otherwise("compromised"))


def gap(audit: DataFrame, keys: list[str], side: Column | None = None, least: int = 10) -> DataFrame:
    """(keys, n_clean, n_contam, clean_acc, contam_acc, gap): accuracy on both sides; cells need ``least`` items on each.

    ``side``: a column of ``clean`` and ``contam`` (others are left out); risk classes of p by default.
    """
    k = risk_class(F.col("p")) if side is None else side
    by = audit.withColumn("_k", k).groupBy(*keys).agg(
        F.count_if(F.col("_k") == "clean").alias("n_clean"), F.count_if(F.col("_k") == "contam").alias("n_contam"),
        F.avg(F.when(F.col("_k") == "clean", F.col("correct"))).alias("clean_acc"), F.avg(F.when(F.col("_k") == "contam", F.col("correct"))).alias("contam_acc"),
    )
    return by.where((F.col("n_clean") >= least) & (F.col("n_contam") >= least)).withColumn("gap", F.col("clean_acc") - F.col("contam_acc"))


def subset_accuracy(audit: DataFrame, keys: list[str]) -> DataFrame:
    k = risk_class(F.col("p"))
    acc = lambda c: F.avg(F.when(k == c, F.col("correct")))
    out = audit.groupBy(*keys).agg(F.count(F.lit(1)).alias("full_n"), F.avg("correct").alias("full_acc"), acc("clean").alias("clean_acc"), acc("contam").alias("contam_acc"))
    return out.withColumns({"drop_clean": F.col("full_acc") - F.col("clean_acc"), "clean_minus_contam": F.col("clean_acc") - F.col("contam_acc")})


def iv_weighted_gap(audit: DataFrame, keys: list[str], stratum: str, side: Column | None = None, least: int = 10, least_side: int = 5) -> DataFrame:
    """(keys, n_strata, iv_gap, iv_se, z, p_two, p_one): gaps within strata, weighted by their inverse variance.

    Strata need ``least`` items, ``least_side`` on both sides, and a positive variance.
    """
    k = risk_class(F.col("p")) if side is None else side
    acc = lambda c, f: f(F.when(F.col("_k") == c, F.col("correct").cast("double")))
    s = audit.withColumn("_k", k).groupBy(*keys, stratum).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_k") == "clean").alias("nc"), F.count_if(F.col("_k") == "contam").alias("nt"),
        acc("clean", F.avg).alias("ac"), acc("contam", F.avg).alias("at"), acc("clean", F.var_samp).alias("vc"), acc("contam", F.var_samp).alias("vt"),
    )
    s = s.where((F.col("n") >= least) & (F.col("nc") >= least_side) & (F.col("nt") >= least_side))
    s = s.withColumns({"g": F.col("ac") - F.col("at"), "v": F.col("vc") / F.col("nc") + F.col("vt") / F.col("nt")}).where("v > 0")
    out = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_strata"), (F.sum(F.col("g") / F.col("v")) / F.sum(1 / F.col("v"))).alias("iv_gap"), F.sqrt(1 / F.sum(1 / F.col("v"))).alias("iv_se"))
    out = out.withColumn("z", F.col("iv_gap") / F.col("iv_se"))
    return out.withColumns({"p_two": 2 * (1 - phi(F.abs("z"))), "p_one": phi(F.col("z"))})


def union_flags(audit: DataFrame) -> DataFrame:
    """Per item over models: greatest and mean p, and how many models flag it or clear it."""
    return audit.groupBy("benchmark", "item_id").agg(F.max("p").alias("p_max"), F.avg("p").alias("p_mean"), F.count_if(F.col("p") > 0.5).alias("n_flag"), F.count_if(F.col("p") < 0.1).alias("n_clear"))


def transfer_slice(flags: DataFrame, outcomes: DataFrame, majority: int = 3) -> DataFrame:
    """Gap of other outcomes under three ways to split items by flags of many models."""
    ways = {
        "any": F.when(F.col("n_flag") > 0, "contam").otherwise("clean"),
        "majority": F.when(F.col("n_flag") >= majority, "contam").otherwise("clean"),
        "max_score": F.when(F.col("p_max") > 0.5, "contam").when(F.col("p_max") < 0.1, "clean"),
    }
    sides = F.array(*[F.struct(F.lit(k).alias("way"), v.alias("side")) for k, v in ways.items()])
    rows = outcomes.join(flags, ["benchmark", "item_id"]).withColumn("w", F.explode(sides)).select("benchmark", "correct", "w.way", "w.side")
    return gap(rows, ["way", "benchmark"], F.col("side"), 1)


def length_quartile(df: DataFrame, value: str, keys: list[str], side: str = "left", out: str = "bin") -> DataFrame:
    """Quartile bins within ``keys``: a value on a cut goes to the lower bin (left) or the upper one (digitize)."""
    cuts = {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}
    over = (lambda q: F.col(value) > F.col(q)) if side == "left" else (lambda q: F.col(value) >= F.col(q))
    return with_quantiles(df, value, keys, cuts).withColumn(out, sum(F.coalesce(over(q).cast("int"), F.lit(0)) for q in cuts)).drop(*cuts)


def quantile_split(df: DataFrame, score: str, keys: list[str], low: float, high: float, low_is_contam: bool = False) -> DataFrame:
    """(keys, ...gap columns): items at or below one quantile of the score against those at or above another."""
    a, b = ("contam", "clean") if low_is_contam else ("clean", "contam")
    side = F.when(F.col(score) <= F.col("_lo"), a).when(F.col(score) >= F.col("_hi"), b)
    return gap(with_quantiles(df, score, keys, {"_lo": low, "_hi": high}), keys, side, 1)


def rate_matched_split(df: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """(keys, threshold, flag_rate): the score's quantile at which it flags as many items of the cell as p > 0.5 does,
    interpolated between neighbouring ranks (each cell has its own rate)."""
    rates = df.groupBy(*keys).agg(rate(F.col("p") > 0.5).alias("flag_rate"))
    wanted = rates.select(*keys, F.lit("cut").alias("name"), (1 - F.col("flag_rate")).alias("q"))
    cut = quantiles(df, score, keys, per_group=wanted).select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col("quantile").alias("threshold"))
    return rates.join(cut, same(keys, "_q_")).select(*keys, "threshold", "flag_rate")
