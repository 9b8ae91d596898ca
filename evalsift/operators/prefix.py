"""Running sums along an order, level by level, so that no task holds a whole group however few groups there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Cuts of the range of values: a group's rows meet in so many parts, and one more.
CUTS = 255
#: Distinct values, over all groups, up to which they are ranked in one level; the result is the same.
ONE_LEVEL = 200_000


def search(value: Column, cuts: list, lo: int = 0, hi: int | None = None) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``: a balanced tree of comparisons."""
    hi = len(cuts) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value < F.lit(cuts[mid]), search(value, cuts, lo, mid)).otherwise(search(value, cuts, mid + 1, hi))


def part_of(df: DataFrame, value: str) -> Column:
    """Which part of the range holds the value: parts lie between quantiles of all values."""
    cuts = df.agg(F.percentile_approx(value, [i / (CUTS + 1) for i in range(1, CUTS + 1)], 10_000)).first()[0]
    return search(F.col(value), sorted(set(cuts or [])))


def before(groups: DataFrame, keys: list[str], order: list[Column], sums: list[str], part: Column) -> DataFrame:
    """``groups`` with ``before_x`` for each x of ``sums``: its sum over the rows of the same ``keys`` that come earlier.

    ``part`` must rise with the order. Rows meet within (keys, part); between parts their sums do, CUTS + 1 rows a key.
    """
    cut = groups.withColumn("_part", part)
    names = [f"_far_k{i}" for i in range(len(keys))]
    totals = cut.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_part").alias("_far_part")).agg(*[F.sum(x).alias(f"_t_{x}") for x in sums])
    earlier = W.partitionBy(*names).orderBy("_far_part").rowsBetween(W.unboundedPreceding, -1)
    far = totals.select(*names, "_far_part", *[F.coalesce(F.sum(f"_t_{x}").over(earlier), F.lit(0)).alias(f"_f_{x}") for x in sums])
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    near = cut.withColumns({f"_n_{x}": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums})
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [F.col("_part") == F.col("_far_part")]
    both = near.join(far, on)
    return both.select(*groups.columns, *[(F.col(f"_n_{x}") + F.col(f"_f_{x}")).alias(f"before_{x}") for x in sums])


def distinct_ranks(df: DataFrame, value: str, keys: list[str], counts: dict[str, Column] | None = None) -> DataFrame:
    """(keys, value, n, before_n, rank, ...): a row for each distinct value within ``keys`` with its tie-averaged rank;
    ``counts`` are further aggregates, each with its ``before_``. Null values have no rank."""
    from ..sources.io import stored

    counts = counts or {}
    g = stored(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()]))
    if g.count() <= ONE_LEVEL:  # one window a group, whose size this bounds
        earlier = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        out = g.select("*", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"before_{x}") for x in ("n", *counts)])
    else:
        out = before(g, keys, [F.col(value)], ["n", *counts], part_of(g, value))
    return out.withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)


def with_rank(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """``df`` with the tie-averaged rank of ``value`` within ``keys`` (null for null)."""
    r = distinct_ranks(df, value, keys).select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(value).alias("_r_value"), F.col("rank").alias(out))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col(value) == F.col("_r_value")]
    return df.join(r, on, "left").drop("_r_value", *[f"_r_{k}" for k in keys])


def numbered(df: DataFrame, keys: list[str], order: list[Column], part: Column, out: str) -> DataFrame:
    """``df`` with its rows numbered from 0 within ``keys`` along ``order``, with which ``part`` must rise."""
    one = before(df.withColumn("_one", F.lit(1).cast("long")), keys, order, ["_one"], part)
    return one.withColumnRenamed("before__one", out).drop("_one")
