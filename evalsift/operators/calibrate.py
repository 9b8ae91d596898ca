"""Calibration: negatives, detectors in long form, the logistic ensemble and its variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .fits import fit_many
from .peers import difficulty_quantile, nearest_match
from .ranks import best_threshold, curve, f1, prf, roc_auc
from .resample import md5_order


def same_source_negatives(items: DataFrame, positives: DataFrame, n: int, by: str, seed: str) -> DataFrame:
    """Up to n items a source whose text is no positive's, in md5 order; repeated candidates stay."""
    rest = items.join(positives.select("text").distinct(), "text", "left_anti")
    r = F.row_number().over(W.partitionBy(by).orderBy(md5_order(seed, F.col("item_id")), "item_id"))
    return rest.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def cross_source_negatives(items: DataFrame, positives: DataFrame, n: int, by: str, seed: str, quota: int | None = None) -> DataFrame:
    """n items of all sources pooled, minus positives; with ``quota``, at most so many of each."""
    rest = items.join(positives.select("text").distinct(), "text", "left_anti").withColumn("_h", md5_order(seed, F.col("item_id")))
    if quota:
        rest = rest.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy("_h", "item_id"))).where(F.col("_r") <= quota).drop("_r")
    return rest.orderBy("_h", "item_id").limit(n).drop("_h")


def long_form(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep, detector, score): one row a feature."""
    return df.unpivot(keep, [F.col(f).cast("double").alias(f) for f in features], "detector", "score")


def per_method(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """(detector, sign, threshold, dev and val precision, recall, F1, AUC): sign and threshold come from dev rows."""
    dev = df.where(F.col(split) == "dev")
    sign = roc_auc(dev, "score", label, ["detector"]).select("detector", "sign", F.col("auc").alias("dev_auc"))
    turned = df.join(sign, "detector").withColumn("score", F.col("score") * F.col("sign"))
    cut = best_threshold(turned.where(F.col(split) == "dev"), "score", label, ["detector"])
    judged = turned.join(cut, "detector")
    out = sign.join(cut, "detector")
    for s in ("dev", "val"):
        m = prf(judged.where(F.col(split) == s), "score", label, F.col("threshold"), ["detector"])
        out = out.join(m.select("detector", *[F.col(c).alias(f"{s}_{c}") for c in ("precision", "recall", "f1")]), "detector", "left")
    return out


def max_f1(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    c = curve(df, score, label, keys)
    return c.groupBy(*keys).agg(F.max(f1(F.col("tp"), F.col("fp"), F.col("p"))).alias("max_f1"))


def standardize(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """(x - mean) / population deviation, 1 where that is 0; the statistics are one row."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in features}
    return df.crossJoin(F.broadcast(stats)).withColumns({f"z_{c}": v for c, v in z.items()}).drop(*[f"_{n}_{c}" for c in features for n in "ms"])  # one row


def fit_ensemble(train: DataFrame, features: list[str], label: str, c: float = 1.0) -> dict:
    """Balanced L2 logistic regression on standardised features: {feature: (mean, sd, coef)} and the intercept."""
    return fit_many(train, {"fit": (features, F.lit(True))}, label, c)["fit"]


def score(model: dict, policy: str = "mean") -> Column:
    """The ensemble's probability as a column; missing features by policy: training mean, 0, or null out."""
    z = F.lit(model["intercept"])
    for x, (mean, sd, coef) in model["features"].items():
        v = F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double"))
        v = {"mean": F.coalesce(v, F.lit(mean)), "zero": F.coalesce(v, F.lit(0.0)), "drop": v}[policy]
        z = z + coef * (v - mean) / sd
    return 1 / (1 + F.exp(-z))


def deployment_gap(scored: DataFrame, keys: list[str], least: int = 20, low: float = 0.1, high: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """(by, n_cells, mean_gap, correct_dir): over cells with ``least`` rows below ``low`` and above ``high``, the mean gap in
    ``correct`` between the two, and the share of cells where the upper rows fare better. One row, or one for each value
    of ``by`` that has cells."""
    by = by or []
    clean, contam = F.col("score") < low, F.col("score") > high
    cells = scored.groupBy(*by, *keys).agg(F.count_if(clean).alias("_n0"), F.count_if(contam).alias("_n1"), (F.avg(F.when(clean, F.col("correct"))) - F.avg(F.when(contam, F.col("correct")))).alias("_gap"))
    return cells.where((F.col("_n0") >= least) & (F.col("_n1") >= least)).groupBy(*by).agg(F.count("_gap").alias("n_cells"), F.avg("_gap").alias("mean_gap"), F.avg((F.col("_gap") < 0).cast("double")).alias("correct_dir"))


def matched_rows(rows: DataFrame, features: list[str], value: str, label: str, row: str, variant: str) -> DataFrame:
    """(variant, split, label, features, difficulty): the positives of each variant, and for each of them the negative
    nearest in ``value``, repeated as often as it is the nearest. ``difficulty`` is the row's quantile in its variant."""
    ranked = difficulty_quantile(rows, value, [variant], row).select(variant, row, "split", label, *features, "difficulty")
    pos, neg = ranked.where(F.col(label) == 1), ranked.where(F.col(label) == 0)
    near = nearest_match(rows.where(F.col(label) == 1), rows.where(F.col(label) == 0), value, row, [variant]).where(F.col("match").isNotNull()).select(variant, F.col("match").alias(row))
    return pos.unionByName(neg.join(near, [variant, row]))


def difficulty_matched(rows: DataFrame, features: list[str], value: str, label: str, row: str, variant: str) -> DataFrame:
    """(n_dev, n_val, auc, f1) of an ensemble with the difficulty quantile, fitted on the matched rows of dev variants."""
    matched = matched_rows(rows, features, value, label, row, variant).fillna(0.0, [*features, "difficulty"])
    model = fit_ensemble(matched.where("split = 'dev'"), [*features, "difficulty"], label)
    val = matched.where("split = 'val'").withColumn("score", score(model))
    sizes = matched.agg(F.count_if(F.col("split") == "dev").alias("n_dev"), F.count_if(F.col("split") == "val").alias("n_val"))
    return sizes.crossJoin(F.broadcast(roc_auc(val, "score", label, []))).crossJoin(F.broadcast(max_f1(val, "score", label, []))).select("n_dev", "n_val", "auc", F.col("max_f1").alias("f1"))  # one row each


def kmeans_strata(df: DataFrame, row: str, vector: str, k: int) -> DataFrame:
    """(row, stratum): clusters of vectors; fewer than ``k`` rows are one stratum."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if len(df.select(row).limit(k).take(k)) < k:
        return df.select(row, F.lit(0).alias("stratum"))
    e = df.select(row, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=0).fit(e).transform(e).select(row, F.col("prediction").alias("stratum"))


def score_with_table(df: DataFrame, ensemble: DataFrame, features: list[str], row: str) -> DataFrame:
    """(row, p): the same from a coefficient table (feature, mean, std, coef, intercept)."""
    lf = df.unpivot([row], [F.col(f).cast("double").alias(f) for f in features], "feature", "x")
    z = lf.join(F.broadcast(ensemble), "feature").withColumn("z", F.col("coef") * (F.coalesce("x", "mean") - F.col("mean")) / F.col("std"))
    return z.groupBy(row, "intercept").agg(F.sum("z").alias("s")).select(row, (1 / (1 + F.exp(-(F.col("s") + F.col("intercept"))))).alias("p"))


def ensemble_table(spark, model: dict, version: str) -> DataFrame:
    rows = [(version, x, i, m, s, c, model["intercept"]) for i, (x, (m, s, c)) in enumerate(model["features"].items())]
    return spark.createDataFrame(rows, "version string, feature string, ord int, mean double, std double, coef double, intercept double")
