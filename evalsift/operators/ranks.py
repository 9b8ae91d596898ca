"""Ranks and what rests on them: AUC, Mann-Whitney, Wilcoxon, Spearman, multiple-testing corrections, ROC and PR curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import phi
from .prefix import distinct_ranks, with_rank


def roc_auc(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """(keys, auc, sign): area under the ROC curve, ties counting half; below 0.5 the sign flips and 1 - auc is given.
    Positives and negatives are counted by distinct score; what ranks is those counts."""
    r = distinct_ranks(df, score, keys, {"_p": F.count_if(F.col(label) == 1), "_q": F.count_if(F.col(label) == 0)})
    a = r.groupBy(*keys).agg(F.sum(F.col("_p") * F.col("rank")).alias("_s"), F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    raw = F.try_divide(F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * F.col("_q"))
    return a.withColumn("_a", raw).select(*keys, F.greatest("_a", 1 - F.col("_a")).alias("auc"), F.when(F.col("_a") < 0.5, -1).otherwise(1).alias("sign"))


def curve(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """(keys, score, tp, fp, p, q): cumulative counts at each distinct score from the top, and totals."""
    r = distinct_ranks(df, score, keys, {"_p": F.count_if(F.col(label) == 1), "_q": F.count_if(F.col(label) == 0)})
    totals = r.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("_p").alias("p"), F.sum("_q").alias("q"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = r.join(totals, on) if keys else r.crossJoin(F.broadcast(totals))  # one row
    return both.select(*keys, F.col(score).alias("score"), (F.col("p") - F.col("before__p")).alias("tp"), (F.col("q") - F.col("before__q")).alias("fp"), "p", "q")


def f1(tp: Column, fp: Column, p: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, tp + fp + p), F.lit(0.0))


def best_threshold(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """(keys, threshold, best_f1): the score at or above which F1 is greatest; the least such score on ties."""
    c = curve(df, score, label, keys).withColumn("_f", F.round(f1(F.col("tp"), F.col("fp"), F.col("p")), 12))
    return c.groupBy(*keys).agg(F.max(F.struct("_f", (-F.col("score")).alias("_s"))).alias("m")).select(*keys, (-F.col("m._s")).alias("threshold"), F.col("m._f").alias("best_f1"))


def prf(df: DataFrame, score: str, label: str, threshold: Column, keys: list[str]) -> DataFrame:
    hit = F.col(score) >= threshold
    a = df.groupBy(*keys).agg(F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"), F.count_if(~hit & (F.col(label) == 1)).alias("fn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return a.select(*keys, zero(F.try_divide("tp", F.col("tp") + F.col("fp"))).alias("precision"), zero(F.try_divide("tp", F.col("tp") + F.col("fn"))).alias("recall"), zero(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, n, pearson, spearman) of rows that have both values."""
    r = with_rank(with_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, keys, "_x"), y, keys, "_y")
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("_x", "_y").alias("spearman")).where(F.col("n") >= least)


def mann_whitney(df: DataFrame, value: str, group: str, keys: list[str]) -> DataFrame:
    """(keys, u, z, p): whether group 1 lies above group 0, one-sided, tie-corrected normal form with continuity."""
    r = distinct_ranks(df, value, keys, {"_a": F.count_if(F.col(group) == 1), "_b": F.count_if(F.col(group) == 0)})
    tie = F.col("n").cast("double")
    a = r.groupBy(*keys).agg(F.sum(F.col("_a") * F.col("rank")).alias("_s"), F.sum("_a").alias("a"), F.sum("_b").alias("b"), F.sum(tie * (tie * tie - 1)).alias("_tie"))
    n = F.col("a") + F.col("b")
    u = F.col("_s") - F.col("a") * (F.col("a") + 1) / 2
    sd = F.sqrt(F.col("a") * F.col("b") / 12.0 * (n + 1 - F.col("_tie") / (n * (n - 1))))
    z = F.try_divide(u - F.col("a") * F.col("b") / 2 - 0.5, sd)
    return a.where("a > 0 and b > 0").withColumns({"u": u, "z": z}).select(*keys, "u", "z", (1 - phi(F.col("z"))).alias("p"))


def u_without(df: DataFrame, value: str, group: str, out: str) -> DataFrame:
    """(out, u): the Mann-Whitney U of group 1 over group 0 with the rows of each value of ``out`` left out in turn: all of
    U, less what those rows have in it, plus the pairs among them, which that takes off twice."""
    ones, zeros = F.count_if(F.col(group) == 1), F.count_if(F.col(group) == 0)
    r = distinct_ranks(df, value, [], {"_a": ones, "_b": zeros}).select(F.col(value).alias("_value"), "_a", "_b", "before__a", "before__b")
    wins = F.when(F.col(group) == 1, F.col("before__b") + F.col("_b") / 2).otherwise(F.col("_ones") - F.col("before__a") - F.col("_a") / 2)
    total = df.where(F.col(value).isNotNull()).agg(ones.alias("_ones"))
    rows = df.join(r, F.col(value) == F.col("_value")).crossJoin(F.broadcast(total)).withColumn("_w", wins)  # one row
    every = rows.agg(F.sum(F.when(F.col(group) == 1, F.col("_w"))).alias("_u"))
    x, y = rows.where(F.col(group) == 1).select(out, F.col(value).alias("_x")), rows.where(F.col(group) == 0).select(out, F.col(value).alias("_y"))
    twice = x.join(y, out).groupBy(out).agg(F.sum(F.when(F.col("_x") > F.col("_y"), 1.0).when(F.col("_x") == F.col("_y"), 0.5).otherwise(0.0)).alias("_both"))
    left = rows.groupBy(out).agg(F.sum("_w").alias("_own")).join(twice, out, "left").crossJoin(F.broadcast(every))  # one row
    return left.select(out, (F.col("_u") - F.col("_own") + F.coalesce("_both", F.lit(0.0))).alias("u"))


def wilcoxon(df: DataFrame, diff: str, keys: list[str]) -> DataFrame:
    """(keys, n, w_plus, z, p): whether paired differences lie above 0; zeros are dropped; normal form with tie term."""
    d = distinct_ranks(df.where(F.col(diff) != 0).withColumn("_abs", F.abs(diff)), "_abs", keys, {"_plus": F.count_if(F.col(diff) > 0)})
    tie = F.col("n").cast("double")
    a = d.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("_plus") * F.col("rank")).alias("w_plus"), F.sum(tie * (tie * tie - 1)).alias("_tie"))
    n = F.col("n").cast("double")  # as whole numbers, the product of three overflows from 1.66 M rows a group on
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tie") / 48))
    return a.withColumn("z", z).select(*keys, "n", "w_plus", "z", (1 - phi(F.col("z"))).alias("p"))


def adjusted(df: DataFrame, p: str, keys: list[str], tie: str) -> DataFrame:
    """Adds bonferroni, holm and bh columns within ``keys``."""
    w = W.partitionBy(*keys)
    order = w.orderBy(p, tie)
    r = df.withColumns({"_m": F.count(p).over(w), "_i": F.row_number().over(order)})
    up = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    down = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    one = lambda x: F.least(x, F.lit(1.0))
    return r.withColumns({"bonferroni": one(F.col(p) * F.col("_m")), "holm": one(F.max(F.col(p) * (F.col("_m") - F.col("_i") + 1)).over(down)), "bh": one(F.min(F.col(p) * F.col("_m") / F.col("_i")).over(up))}).drop("_m", "_i")


def kappa(preds: DataFrame, keys: list[str], name: str = "detector", row: str = "row_id") -> DataFrame:
    """(keys, a, b, n, agreement, kappa) of every pair of detectors on their common rows; ``pred`` is 0 or 1."""
    other = preds.select(*keys, row, F.col(name).alias("b"), F.col("pred").alias("pb"))
    both = preds.select(*keys, row, F.col(name).alias("a"), F.col("pred").alias("pa")).join(other, [*keys, row]).where("a < b")
    s = both.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pa") == F.col("pb")).cast("double")).alias("agreement"), F.avg(F.col("pa").cast("double")).alias("ma"), F.avg(F.col("pb").cast("double")).alias("mb"))
    pe = F.col("ma") * F.col("mb") + (1 - F.col("ma")) * (1 - F.col("mb"))
    return s.select(*keys, "a", "b", "n", "agreement", F.try_divide(F.col("agreement") - pe, 1 - pe).alias("kappa"))


def agreement(preds: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(keys, a, b, n, agreement, kappa, tpr, fpr) of pairs of 0/1 columns: ``a`` judges, ``b`` is held against it; rows
    where either is missing count for neither."""
    out = None
    for a, b in pairs:
        known = preds.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        x, y = F.col(a).cast("double"), F.col(b)
        s = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("agreement"), F.avg(x).alias("_a"), F.avg(y.cast("double")).alias("_b"), F.avg(F.when(y == 1, x)).alias("tpr"), F.avg(F.when(y == 0, x)).alias("fpr"))
        pe = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
        one = s.select(*keys, F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "agreement", F.try_divide(F.col("agreement") - pe, 1 - pe).alias("kappa"), "tpr", "fpr")
        out = one if out is None else out.unionByName(one)
    return out
