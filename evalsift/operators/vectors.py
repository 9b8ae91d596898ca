"""Vector search: an inverted file whose lists are left out by exact bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import stored

#: Most lists of the file: their centres and radii are what tasks are sent, so they bound it.
LISTS = 1024


def _listed(df: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """(key, vector, list, far): the list of the nearest centre and the distance to that."""

    def nearest(it):
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
                pdf["list"], pdf["far"] = near, np.linalg.norm(x - centres[near], axis=1)
                yield pdf

    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    return rows.mapInPandas(nearest, f"{key} long, {vector} array<double>, list long, far double")


def _met(queries: DataFrame, corpus: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """(key, best) of the queries' rows (key, vector, list), each against its list of the corpus. Of either side ``block``
    rows of a list on average meet in a task, so that a hot list fills many; only maxima leave it."""
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias(name))
    sizes = F.broadcast(blocks(corpus, "_nc").join(blocks(queries, "_nq"), "list"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64(key), F.col(n))
    cols = [key, vector, "list"]
    left = queries.select(cols).join(sizes, "list").select(*cols, own("_nq").alias("_q"), every("_nc").alias("_c"))
    right = corpus.select(cols).join(sizes, "list").select(*cols, own("_nc").alias("_c"), every("_nq").alias("_q"))

    def best(one: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(many):
            return pd.DataFrame({key: np.zeros(0, np.int64), "best": np.zeros(0)})
        dots = np.stack(one[vector].to_numpy()) @ np.stack(many[vector].to_numpy()).T
        dots[one[key].to_numpy()[:, None] == many[key].to_numpy()] = -np.inf
        return pd.DataFrame({key: one[key].to_numpy(), "best": np.maximum(dots.max(1), 0.0)})

    by = ["list", "_q", "_c"]
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(best, f"{key} long, best double").groupBy(key).agg(F.max("best").alias("best"))


def indexed_max_dot(queries: DataFrame, corpus: DataFrame, key: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """(key, best): the greatest dot product of each query with any corpus vector of another key, at least 0; exact.

    The corpus is dealt to the lists of at most LISTS centres, sampled by hash. A query first meets its nearest list; then
    only those lists whose bound (its product with the centre, and its length times the list's radius) beats what it found.
    The file is read twice, however many queries there are. Keys are whole numbers, one a vector; rows without a vector
    are in no list, and as queries find nothing.
    """
    real = corpus.where(F.col(vector).isNotNull())
    wanted = min(LISTS, max(1, math.isqrt(real.count())))
    sample = real.orderBy(F.xxhash64(key), key).limit(wanted).select(vector).collect()
    none = queries.select(F.col(key).cast("long").alias(key), F.lit(0.0).alias("best"))
    if not sample:
        return none
    centres = np.array([r[vector] for r in sample], np.float64)
    file, asked = stored(_listed(corpus, key, vector, centres)), stored(_listed(queries, key, vector, centres))
    radius = np.full(len(centres), -1.0)
    for r in file.groupBy("list").agg(F.max("far").alias("r")).collect():
        radius[r["list"]] = r["r"]
    first = stored(_met(asked, file, key, vector, block))

    def others(it):
        for pdf in it:
            if not len(pdf):
                continue
            x = np.stack(pdf[vector].to_numpy())
            bound = x @ centres.T + np.linalg.norm(x, axis=1)[:, None] * np.maximum(radius, 0.0)
            open_ = (bound + 1e-9 * (1 + np.abs(bound)) > pdf["best"].to_numpy()[:, None]) & (radius >= 0)
            open_[np.arange(len(pdf)), pdf["list"].to_numpy()] = False
            row, to = np.nonzero(open_)
            for i in range(0, len(row), 4096):
                part = pdf.iloc[row[i : i + 4096]]
                yield pd.DataFrame({key: part[key].to_numpy(), vector: part[vector].to_numpy(), "list": to[i : i + 4096]})

    found = asked.join(first, key, "left").fillna(0.0, ["best"]).select(key, vector, "list", "best")
    rest = stored(found.mapInPandas(others, f"{key} long, {vector} array<double>, list long"))
    return none.unionByName(first).unionByName(_met(rest, file, key, vector, block)).groupBy(key).agg(F.max("best").alias("best"))
