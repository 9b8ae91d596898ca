"""Findings of round 3: cases that failed before."""

import math
import time

import pytest
from pyspark.sql import functions as F


def test_hypergeometric_of_large_cells(spark):
    """Terms at the far end of the range underflow; the function at and around the mean must not."""
    from evalsift.functions.stats import hypergeom_cdf

    def exact(k, t, g, n):
        lg = math.lgamma
        p = lambda x: math.exp(lg(g + 1) - lg(x + 1) - lg(g - x + 1) + lg(t - g + 1) - lg(n - x + 1) - lg(t - g - n + x + 1) - lg(t + 1) + lg(n + 1) + lg(t - n + 1))
        return sum(p(x) for x in range(max(0, n + g - t), k + 1))

    cases = [(k, 9000, 5100, 1500) for k in (700, 840, 849, 850, 851, 900)] + [(0, 10, 4, 3), (1, 10, 4, 3), (2, 10, 9, 3), (3, 10, 4, 3), (1, 10, 9, 3), (4, 12, 8, 8), (5000, 9000, 8999, 5001), (60_100, 540_000, 361_000, 90_000), (34, 50, 35, 49)]
    df = spark.createDataFrame([tuple(c) for c in cases], "k long, t long, g long, n long")
    got = [r["p"] for r in df.coalesce(1).select(hypergeom_cdf(F.col("k"), F.col("t"), F.col("g"), F.col("n")).alias("p")).collect()]
    assert got == [pytest.approx(exact(*c), abs=1e-8) for c in cases]


def test_t_tail_is_quick(spark):
    """A million rows in seconds, and right where Simpson's rule was not: at broken degrees of freedom below two."""
    from evalsift.functions.stats import student_t_tail

    df = spark.range(1_000_000).select((F.col("id") / 1e5).alias("t"))
    began = time.time()
    worst = df.select(F.abs(student_t_tail(F.col("t"), F.lit(1.0)) - (1 - 2 * F.atan("t") / math.pi)).alias("e")).agg(F.max("e")).first()[0]
    assert worst < 1e-9 and time.time() - began < 30

    def by_density(t, v, steps=20000):
        f = [(1 + (t * i / steps) ** 2 / v) ** (-(v + 1) / 2) for i in range(steps + 1)]
        area = (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2])) * t / steps / 3
        return 1 - 2 * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * area

    cases = [(1.7, 1.3), (0.4, 1.5), (2.5, 1.01), (3.0, 4.7), (1.9, 60.0), (2.2, 5000.0)]
    rows = spark.createDataFrame(cases, "t double, v double").coalesce(1)
    assert [r[0] for r in rows.select(student_t_tail(F.col("t"), F.col("v"))).collect()] == [pytest.approx(by_density(*c), abs=1e-8) for c in cases]


def test_random_peers_once_a_set(spark):
    """Repetitions with the same peers cost no more: of ten models there are few sets of three, however many repetitions."""
    from evalsift.operators.peers import peer_delta
    from evalsift.operators.resample import random_peer_null

    models = spark.createDataFrame([(f"m{i}", f"f{i % 2}") for i in range(5)], "model string, family string")
    rows = [(f"m{i}", j, ((i * 7 + j * j * 3) % 17) / 4, (i + j) % 3 % 2) for i in range(5) for j in range(60) if (i + j) % 11]
    outcomes = spark.createDataFrame(rows, "model string, item_id long, loss double, correct int")
    got = random_peer_null(outcomes, models, 2, 2_000).groupBy("model", "gap").count().collect()
    # m0, m2 and m4 have one set of two, m1 and m3 have three
    assert sum(r["count"] for r in got) == 10_000 and len({r["gap"] for r in got if r["model"] == "m0"}) == 1
    peers = spark.createDataFrame([("m0", "m1"), ("m0", "m3")], "model string, peer string")
    loss = {(m, i): x for m, i, x, _ in rows}
    want = {i: loss["m0", i] - (loss["m1", i] + loss["m3", i]) / 2 for i in range(60) if all((m, i) in loss for m in ("m0", "m1", "m3"))}
    assert {r["item_id"]: r["delta"] for r in peer_delta(outcomes, peers).collect()} == pytest.approx(want)


def test_buckets_grow_with_the_corpus(spark):
    """A bucket's grams stay within a task's memory: sixteen buckets are only the least."""
    from evalsift.sources import io

    docs = spark.createDataFrame([("x" * 1000,), (None,)], "text string")
    assert io.buckets_for(docs) == 16 and io.buckets_for(docs.where("text is null")) == 16
    large = docs.select(F.repeat("text", F.lit(200_000)).alias("text"))
    assert io.buckets_for(large) == -(-200_000_000 // io.BUCKET_BYTES)
