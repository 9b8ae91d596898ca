"""Exact quantiles of many groups by distributed selection: no task ever sorts or holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.io import stored

#: Bins of a range of values in one pass, and rows of ranges that are broadcast to the values at most.
BINS, BROADCAST_ROWS = 1024, 100_000


def same(keys: list[str], prefix: str):
    return [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys]


def quantiles(df: DataFrame, value: str, keys: list[str], qs: dict[str, float] | None = None, per_group: DataFrame | None = None) -> DataFrame:
    """(keys, a column for each of ``qs``): quantiles of ``value`` within ``keys``, between neighbouring ranks linearly.

    ``per_group`` (keys, name, q) gives each group quantiles of its own instead: (keys, name, quantile). Nulls and NaN are
    no values; a group without values has no row.

    Each wanted rank keeps the range of values that holds it. A pass counts the values of all ranges in BINS bins each (a
    row a bin, summed before the shuffle) and goes on with the bin that holds the rank, from its least to its greatest
    value. Both ends of a range fall into different bins, so every pass narrows, and a range of one value is the answer.
    """
    own = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    named = [F.col(k).alias(o) for k, o in zip(keys, own, strict=False)] if keys else [F.lit(0).alias("_k0")]
    rows = stored(df.select(*named, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")))
    stats = rows.groupBy(*own).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    if per_group is None:
        wanted = stats.withColumn("w", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("q")) for k, q in qs.items()]))).select(*own, "lo", "hi", "n", "w.*")
    else:
        theirs = per_group.select(*[F.col(k).alias(f"r{o}") for k, o in zip(keys, own, strict=True)], "name", F.col("q").cast("double").alias("q"))
        wanted = stats.join(theirs, same(own, "r")).select(*own, "lo", "hi", "n", "name", "q")
    place = (F.col("n") - 1) * F.col("q")
    wanted = stored(wanted.withColumns({"below": F.floor(place), "part": place - F.floor(place), "above": F.least(F.floor(place) + 1, F.col("n") - 1)}))
    found = selected(rows, wanted.withColumn("rank", F.explode(F.array_distinct(F.array("below", "above")))).select(*own, "rank", "lo", "hi").distinct(), own)
    at = lambda x: found.select(*[F.col(k).alias(f"{x}{k}") for k in own], F.col("rank").alias(f"{x}_rank"), F.col("lo").alias(x))
    both = wanted.drop("lo", "hi")
    for x in ("below", "above"):
        both = both.join(at(f"_{x}"), [*same(own, f"_{x}"), F.col(x) == F.col(f"_{x}_rank")])
    out = both.select(*own, "name", (F.col("_below") + (F.col("_above") - F.col("_below")) * F.col("part")).alias("quantile"))
    back = [F.col(o).alias(k) for k, o in zip(keys, own, strict=False)]
    if per_group is not None:
        return out.select(*back, "name", "quantile")
    wide = out.groupBy(*own).agg(*[F.max(F.when(F.col("name") == k, F.col("quantile"))).alias(k) for k in qs])
    return wide.select(*back, *qs)


def with_quantiles(df: DataFrame, value: str, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """``df`` with the quantiles of its group as columns; groups without values are left out."""
    q = quantiles(df, value, keys, qs).withColumnsRenamed({k: f"_q_{k}" for k in keys})
    if not keys:
        return df.crossJoin(F.broadcast(q))  # one row
    return df.join(q, same(keys, "_q_")).drop(*[f"_q_{k}" for k in keys])


def selected(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, lo): the value at each rank (from 0) of ``rows`` (keys, v). ``ranks``: keys, rank, lo and hi of all."""
    state, linear = stored(ranks.withColumn("r", F.col("rank"))), True
    while True:
        open_ = state.where("lo < hi")
        ranges = open_.select(*[F.col(k).alias(f"r{k}") for k in keys], "lo", "hi").distinct()
        n = ranges.limit(BROADCAST_ROWS + 1).count()
        if not n:
            return state
        ranges = F.broadcast(ranges) if n <= BROADCAST_ROWS else ranges
        # every other pass is even in the logarithm where a range spans magnitudes, so that any data take few passes;
        # halves keep the widths of ranges across zero finite
        lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
        log = lambda x: F.signum(x) * (F.ln(F.abs(x)) + 750)
        wide = F.lit(False) if linear else (lo <= 0) & (hi >= 0) | (F.greatest(F.abs(lo), F.abs(hi)) > 1000 * F.least(F.abs(lo), F.abs(hi)))
        f = lambda x: F.when(x == 0, 0.0).when(wide, log(x)).otherwise(x / 2)
        share = (f(v) - f(lo)) / (f(hi) - f(lo))
        bin_ = F.when(v >= hi, BINS - 1).otherwise(F.greatest(F.least(F.floor(share * (BINS - 1)), F.lit(BINS - 2)), F.lit(0)))
        linear = not linear
        inside = rows.join(ranges, [*same(keys, "r"), F.col("v").between(F.col("lo"), F.col("hi"))])
        bins = inside.groupBy(*[f"r{k}" for k in keys], "lo", "hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        order = W.partitionBy(*[f"r{k}" for k in keys], "lo", "hi").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumnsRenamed({"lo": "b_lo", "hi": "b_hi"})
        hit = [*same(keys, "r"), F.col("lo") == F.col("b_lo"), F.col("hi") == F.col("b_hi"), F.col("r") >= F.col("before"), F.col("r") < F.col("before") + F.col("n")]
        narrowed = open_.join(bins, hit).select(*keys, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("r") - F.col("before")).alias("r"))
        state = stored(state.where("lo >= hi").select(*keys, "rank", "lo", "hi", "r").unionByName(narrowed))
