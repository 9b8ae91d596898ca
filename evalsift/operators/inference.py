"""Tests over cells: meta-analysis, power, t tests, regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import phi, student_t_tail


def meta_analysis(df: DataFrame, effect: str, se: str, keys: list[str]) -> DataFrame:
    """(keys, k, q, i2, tau2, re_mean, re_se, z, p, hk_se, t, df, hk_p): DerSimonian-Laird random effects, and the
    Hartung-Knapp variance with its t test."""
    d = df.select(*keys, F.col(effect).alias("y"), (1 / (F.col(se) * F.col(se))).alias("w"))
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y")).alias("swy"), F.sum(F.col("w") * F.col("w")).alias("sww"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("swyy"))
    q = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    a = a.withColumns({"q": q, "df": F.col("k") - 1})
    a = a.withColumns({"tau2": F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("df"), F.col("sw") - F.col("sww") / F.col("sw"))), "i2": F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("df"), F.col("q")))})
    r = d.join(a.select(*keys, "k", "q", "i2", "tau2", "df"), keys) if keys else d.crossJoin(F.broadcast(a.select("k", "q", "i2", "tau2", "df")))
    r = r.withColumn("u", 1 / (1 / F.col("w") + F.col("tau2")))
    group = [*keys, "k", "q", "i2", "tau2", "df"]
    m = r.groupBy(*group).agg(F.sum("u").alias("su"), F.sum(F.col("u") * F.col("y")).alias("suy"), F.sum(F.col("u") * F.col("y") * F.col("y")).alias("suyy"))
    mean = F.col("suy") / F.col("su")
    m = m.withColumns({"re_mean": mean, "re_se": F.sqrt(1 / F.col("su")), "hk_se": F.sqrt(F.try_divide(F.col("suyy") - F.col("suy") * mean, F.col("df") * F.col("su")))})
    m = m.withColumns({"z": F.col("re_mean") / F.col("re_se"), "t": F.try_divide(F.col("re_mean"), F.col("hk_se"))})
    return m.withColumns({"p": 2 * (1 - phi(F.abs("z"))), "hk_p": student_t_tail(F.col("t"), F.col("df").cast("double"))}).drop("su", "suy", "suyy")


def ttest_1samp(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    a = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    a = a.where("n > 1 and sd > 0").withColumn("t", F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return a.withColumn("p", student_t_tail(F.col("t"), (F.col("n") - 1).cast("double")))


def ttest_welch(df: DataFrame, value: str, group: str, keys: list[str]) -> DataFrame:
    """(keys, t, df, p): group 1 against group 0 with unequal variances."""
    of = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    a = df.groupBy(*keys).agg(*[of(g, f).alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    e0, e1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    a = a.where("n0 > 1 and n1 > 1 and v0 + v1 > 0").withColumns({"t": (F.col("m1") - F.col("m0")) / F.sqrt(e0 + e1), "df": (e0 + e1) * (e0 + e1) / (e0 * e0 / (F.col("n0") - 1) + e1 * e1 / (F.col("n1") - 1))})
    return a.withColumn("p", student_t_tail(F.col("t"), F.col("df"))).select(*keys, "t", "df", "p")


def linear_fit(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """(keys, n, slope, intercept, r, se, band): least squares with the slope's error and its half 95% band (normal)."""
    d = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("x", "y").alias("r"), F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy")).where("n > 2")
    se = F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("r") * F.col("r")) * F.col("_syy") / (F.col("n") - 2)) / F.col("_sxx"))
    return a.withColumn("se", se).withColumn("band", 1.959964 * F.col("se")).drop("_sxx", "_syy")


def ols_cluster(df: DataFrame, y: str, x: str, cluster: str) -> DataFrame:
    """(n, clusters, intercept, slope, se, t): y on a 0/1 regressor with cluster-robust (CR1) errors, one row."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(x).cast("double")).alias("n1"), F.avg(F.when(F.col(x) == 0, F.col(y))).alias("m0"), F.avg(F.when(F.col(x) == 1, F.col(y))).alias("m1"))
    r = df.crossJoin(F.broadcast(a))  # one row
    e = F.col(y) - F.when(F.col(x) == 1, F.col("m1")).otherwise(F.col("m0"))
    # influence of a row on the slope: e/n1 where x = 1, -e/n0 where x = 0
    infl = F.when(F.col(x) == 1, e / F.col("n1")).otherwise(-e / (F.col("n") - F.col("n1")))
    c = r.groupBy(cluster, "n", "n1", "m0", "m1").agg(F.sum(infl).alias("s"))
    o = c.groupBy("n", "n1", "m0", "m1").agg(F.count(F.lit(1)).alias("clusters"), F.sum(F.col("s") * F.col("s")).alias("v"))
    g = F.col("clusters")
    se = F.sqrt(F.col("v") * g / (g - 1) * (F.col("n") - 1) / (F.col("n") - 2))
    return o.select("n", "clusters", F.col("m0").alias("intercept"), (F.col("m1") - F.col("m0")).alias("slope"), se.alias("se"), ((F.col("m1") - F.col("m0")) / se).alias("t"))
