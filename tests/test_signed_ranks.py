"""The signed-rank test of a group whose n (n + 1) (2 n + 1) is beyond 64 bits."""

import math

from pyspark.sql import functions as F


def test_wilcoxon_of_a_large_group(spark):
    from evalsift.operators.ranks import wilcoxon

    n, plus = 1_800_000, 901_000
    df = spark.range(n).select(F.lit("g").alias("k"), F.when(F.col("id") < plus, 1.0).otherwise(-1.0).alias("d"))
    r = wilcoxon(df, "d", ["k"]).first()
    w = plus * (n + 1) / 2  # all differences are tied
    z = (w - n * (n + 1) / 4) / math.sqrt((2 * n * (n + 1) * (2 * n + 1) - (n**3 - n)) / 48)
    assert (r["n"], r["w_plus"]) == (n, w)
    assert math.isclose(r["z"], z, rel_tol=1e-9)
    assert math.isclose(r["p"], math.erfc(z / math.sqrt(2)) / 2, abs_tol=1e-6)
