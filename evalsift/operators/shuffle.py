"""Shuffles and resamples of real-valued outcomes, in parts: no task holds a cell, however large."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import stored
from .quantiles import quantiles, same

#: Distinct outcomes of a cell that one task shuffles together, and rows a side that a test asks for.
PART, LEAST_SIDE = 4096, 3


def shuffle_test(items: DataFrame, value: str, keys: list[str], n: int, seed: int = 1) -> DataFrame:
    """(keys, n_clean, n_contam, gap, p_perm): the gap of the sides' mean ``value`` and the share of ``n`` label shuffles
    with a gap at most that; null with fewer than LEAST_SIDE rows on a side. ``items``: side (clean or contam) and value.

    Outcomes are counted by value, and values dealt to parts by hash. A shuffle first decides how many clean labels each
    part gets, then within each part how many each value gets: hypergeometric numbers given what is left, which together
    are one draw of the multivariate hypergeometric distribution. Parts return their sums by shuffle; those add up.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    rows = items.where(F.col("side").isin("clean", "contam") & F.col(value).isNotNull()).select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], "side", F.col(value).cast("double").alias("v"))
    clean = F.col("side") == "clean"
    values = stored(rows.groupBy(*own, "v").agg(F.count(F.lit(1)).alias("c"), F.count_if(clean).alias("a")))
    x = F.col("v")
    cells = values.groupBy(*own).agg(F.sum("c").alias("n"), F.sum("a").alias("n_clean"), F.sum(x * F.col("c")).alias("total"), F.sum(x * F.col("a")).alias("s"), F.count(F.lit(1)).alias("d"))
    cells = cells.withColumn("n_contam", F.col("n") - F.col("n_clean"))
    cells = stored(cells.withColumn("gap", F.col("s") / F.col("n_clean") - (F.col("total") - F.col("s")) / F.col("n_contam")).where("n_clean > 0 and n_contam > 0").withColumn("cell", F.xxhash64(F.lit(seed), *own)))
    tested = cells.where((F.col("n_clean") >= LEAST_SIDE) & (F.col("n_contam") >= LEAST_SIDE))
    named = tested.select(*[F.col(k).alias(f"c{k}") for k in own], "cell", "n_clean", F.ceil(F.col("d") / PART).alias("parts"), F.col("n").alias("of"))
    dealt = values.join(named, same(own, "c")).select("cell", "n_clean", "of", "v", "c", F.pmod(F.xxhash64("v", F.lit(seed)), F.col("parts")).alias("part"))
    sizes = dealt.groupBy("cell", "n_clean", "of", "part").agg(F.sum("c").alias("m"))
    # the labels of each part: a pass along a cell's parts, a row each, that holds what is left for each shuffle
    labels = stored(sizes.repartition("cell").sortWithinPartitions("cell", "part").mapInPandas(lambda it: _labels(it, n), "cell long, part long, m long, labels array<long>"))

    def sums(key, have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        have = have.sort_values("v")
        rng, left, rest, s = _rng(*key), np.array(want["labels"].iloc[0]), int(want["m"].iloc[0]), np.zeros(n)
        for v, c in zip(have["v"].to_numpy(), have["c"].to_numpy(), strict=True):
            rest -= int(c)
            got = _hypergeometric(rng, int(c), rest, left)
            left = left - got
            s += v * got
        return pd.DataFrame({"cell": [key[0]], "sums": [s]})

    parts = dealt.groupBy("cell", "part").cogroup(labels.groupBy("cell", "part")).applyInPandas(sums, "cell long, sums array<double>")
    by_shuffle = parts.select("cell", F.posexplode("sums").alias("rep", "s")).groupBy("cell", "rep").agg(F.sum("s").alias("s"))
    judged = by_shuffle.join(tested.select("cell", "n_clean", "n_contam", "total", "gap"), "cell")
    drawn = F.col("s") / F.col("n_clean") - (F.col("total") - F.col("s")) / F.col("n_contam")
    # sums of the same values in another order differ in their last places
    slack = 1e-9 * F.greatest(F.abs("gap"), F.abs(F.col("total") / (F.col("n_clean") + F.col("n_contam"))), F.lit(1e-300))
    p = judged.groupBy("cell").agg(F.avg((drawn <= F.col("gap") + slack).cast("double")).alias("p_perm"))
    return cells.join(p, "cell", "left").select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], "n_clean", "n_contam", "gap", "p_perm")


def _rng(*key: int) -> np.random.Generator:
    return np.random.default_rng([k & 0xFFFFFFFFFFFFFFFF for k in map(int, key)])


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: np.ndarray) -> np.ndarray:
    """How many of ``draws`` of good + bad fall on good. Of one it is a coin; above 1e9, which NumPy's sampler does not
    take, the normal limit, rounded and held to what is possible."""
    if good == 1:
        return (rng.random(len(draws)) * (1 + bad) < draws).astype(np.int64)
    if good + bad < 1_000_000_000:
        return rng.hypergeometric(good, bad, draws)
    total, share = good + bad, draws / (good + bad)
    sd = np.sqrt(good * share * (1 - share) * (bad / (total - 1)))
    return np.clip(np.rint(good * share + sd * rng.standard_normal(len(draws))), np.maximum(0, draws - bad), np.minimum(good, draws)).astype(np.int64)


def _labels(it: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    cell, rng, left, rest = None, None, None, 0
    for pdf in it:
        for r in pdf.itertuples(index=False):
            if r.cell != cell:
                cell, rng, left, rest = r.cell, _rng(r.cell), np.full(n, r.n_clean, np.int64), int(r.of)
            rest -= int(r.m)
            got = _hypergeometric(rng, int(r.m), rest, left)
            left = left - got
            yield pd.DataFrame({"cell": [cell], "part": [r.part], "m": [r.m], "labels": [got]})


#: P(X <= k) of a Poisson variable of mean 1, for k from 0.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020]
POISSON_HEX = [f"{round(p * 2**32):08x}" for p in POISSON]


def _poisson(h: Column) -> Column:
    """The Poisson number of eight hex digits, from 0 up: most are told by the first two comparisons."""
    out = F.when(h < POISSON_HEX[0], 0)
    for k, t in enumerate(POISSON_HEX[1:], 1):
        out = out.when(h < t, k)
    return out.otherwise(len(POISSON_HEX))


def poisson_bootstrap(items: DataFrame, value: str, keys: list[str], row: str, n: int, seed: int = 6) -> DataFrame:
    """(keys, ci_low, ci_high): percentiles over ``n`` resamples of the gap of the sides' mean ``value``.

    In a resample each row counts as often as a Poisson number of mean 1 says, drawn from the md5 of (seed, resample,
    row): rows need not know how many there are, so resamples are sums that every task makes of its own rows. One
    aggregate over all resamples; what is shuffled is a row for each (cell, side, resample) and task.
    """
    rows = items.where(F.col("side").isin("clean", "contam") & F.col(value).isNotNull())
    # eight hex digits are a uniform number, and order as their text does; a digest has four of them, whose sums stay side by
    # side until they are added up
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "_b", F.col(row).cast("string")))
    drawn = rows.select(*keys, "side", F.col(value).cast("double").alias("_v"), row, F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 4))).alias("_b")).withColumn("_h", digest)
    parts = drawn.select(*keys, "side", "_v", "_b", *[F.substring("_h", 8 * j + 1, 8).alias(f"_h{j}") for j in range(4)])
    weighed = parts.select(*keys, "side", "_v", "_b", *[_poisson(F.col(f"_h{j}")).alias(f"_w{j}") for j in range(4)])
    four = weighed.groupBy(*keys, "_b", "side").agg(*[s for j in range(4) for s in (F.sum(f"_w{j}").alias(f"_n{j}"), F.sum(F.col(f"_w{j}") * F.col("_v")).alias(f"_s{j}"))])
    sums = four.select(*keys, "side", F.inline(F.array(*[F.struct((4 * F.col("_b") + j).alias("rep"), F.col(f"_n{j}").alias("_n"), F.col(f"_s{j}").alias("_s")) for j in range(4)])))
    sums = sums.where(f"_n > 0 and rep < {n}").withColumn("_m", F.col("_s") / F.col("_n"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("_m")))
    gaps = sums.groupBy(*keys, "rep").agg((side("clean") - side("contam")).alias("gap")).where("gap is not null")
    return quantiles(gaps, "gap", keys, {"ci_low": 0.025, "ci_high": 0.975})
