"""The inverted file of vectors against brute force."""

import numpy as np
from pyspark.sql import functions as F

from evalsift.operators import checks, vectors

SCHEMA = "vec_id long, embedding array<float>"


def brute(keys, x, asked):
    dots = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(dots, -np.inf)
    return {int(k): max(0.0, float(dots[i].max())) for i, k in enumerate(keys) if k in asked}


def test_index_equals_brute_force(spark):
    """Clusters (one holds a third of all), copies, zero vectors and unlike lengths; few lists are left to compare."""
    rng = np.random.default_rng(4)
    at = rng.normal(size=(30, 16)) * 3
    x = (at[np.where(rng.random(2000) < 1 / 3, 0, rng.integers(0, 30, 2000))] + rng.normal(size=(2000, 16)) * 0.1).astype(np.float32)
    x[5:9], x[9], x[10:40] = x[4], 0, x[10:40] * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    asked = set(range(0, 2000, 5))
    want = brute(range(2000), x, asked)
    queries = df.where("vec_id % 5 = 0")
    for got in (checks.max_cosine(queries, df, block=64), checks.max_cosine(queries, df), vectors.indexed_max_dot(queries, df, block=50)):
        got = {r["vec_id"]: r["best"] for r in got.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_index_of_odd_tables(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.5, 0.5])], SCHEMA)
    got = {r["vec_id"]: r["best"] for r in vectors.indexed_max_dot(one, one).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.5}
    none = one.limit(0)
    assert [r["best"] for r in vectors.indexed_max_dot(one.where("vec_id = 1"), none).collect()] == [0.0]
    assert vectors.indexed_max_dot(none, one).count() == 0
    assert vectors.indexed_max_dot(one, one).select(F.count("best")).first()[0] == 3
