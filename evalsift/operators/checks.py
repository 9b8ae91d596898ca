"""Data checks: row counts and fields, metrics against expectations, sample rows; embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resample import md5_order
from .vectors import indexed_max_dot


def check_dataset(df: DataFrame, name: str, expected: int, fields: list[str], tolerance: float = 0.05) -> DataFrame:
    """One row: count, whether it is near enough to ``expected``, missing fields."""
    missing = ",".join(f for f in fields if f not in df.columns)
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows"), (F.abs(n - expected) <= tolerance * expected).alias("count_ok")).select(F.lit(name).alias("dataset"), "n_rows", "count_ok", F.lit(missing).alias("missing"))


def check_metrics(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(metric, status): missing, not_finite, off or ok by relative tolerance. Both have metric and value."""
    both = expected.join(actual.select("metric", F.col("value").alias("got")), "metric", "left")
    err = F.abs(F.col("got") - F.col("value")) / F.greatest(F.abs("value"), F.lit(1e-12))
    status = F.when(F.col("got").isNull(), "missing").when(F.isnan("got") | (F.abs("got") == float("inf")), "not_finite").when(err > F.col("tolerance"), "off").otherwise("ok")
    return both.select("metric", status.alias("status"))


def sample_rows(df: DataFrame, row: str, n: int = 3, seed: str = "sample") -> DataFrame:
    return df.orderBy(md5_order(seed, F.col(row)), row).limit(n)


def max_cosine(queries: DataFrame, corpus: DataFrame, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(key, best): the greatest dot product of each query with any corpus vector of another key, at least 0.

    Up to ``block`` queries are one matrix beside a stream of corpus batches: a broadcast of bounded size, of which only
    maxima leave a task. More of them go through the inverted file of ``vectors``, with the same results.
    """
    if queries.limit(block + 1).count() > block:
        return indexed_max_dot(queries, corpus, key, vector)
    rows = queries.select(key, vector).toPandas()
    if not len(rows):
        return queries.select(key, F.lit(0.0).alias("best"))
    shared = queries.sparkSession.sparkContext.broadcast((rows[key].to_numpy(), np.stack(rows[vector].to_numpy()).astype(np.float64)))

    def best(it):
        ids, m = shared.value
        top = np.zeros(len(ids))
        for pdf in it:
            if len(pdf):
                dots = np.stack(pdf[vector].to_numpy()).astype(np.float64) @ m.T
                dots[pdf[key].to_numpy()[:, None] == ids] = -np.inf
                top = np.maximum(top, dots.max(0))
        yield pd.DataFrame({key: ids, "best": top})

    return corpus.select(key, vector).mapInPandas(best, f"{key} long, best double").groupBy(key).agg(F.max("best").alias("best"))
