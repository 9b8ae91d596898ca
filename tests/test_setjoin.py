"""The best partner by overlap against every pair: random sets, a gram in all items, nested sets, hot passages."""

import random

import pytest
from pyspark.sql import functions as F


def brute(rows):
    out = {}
    for g, i, e in rows:
        best = max((len(e & f) / min(len(e), len(f)) for h, j, f in rows if h == g and j != i and e and f), default=0.0)
        out[g, i] = (len(e), round(best, 9))
    return out


def cases(seed):
    rng = random.Random(seed)
    rows = [("a", i, set(rng.sample(range(60), rng.randint(0, 12)))) for i in range(60)]
    rows += [("b", i, {0} | set(rng.sample(range(1, 4000), rng.randint(0, 9)))) for i in range(80)]  # one element in all
    passage = set(range(10_000, 10_008))
    rows += [("c", i, passage | {i} | ({20_000 + i // 2} if i % 3 else set())) for i in range(60)]  # and a passage in all
    nest = list(range(40))
    rows += [("d", i, set(nest[: i + 1])) for i in range(40)] + [("d", 100 + i, set(nest[i:])) for i in range(0, 40, 7)]
    rows += [("e", i, {0, 1, 2, *range(100 * i, 100 * i + 5 * i)}) for i in range(30)] + [("e", 90, {0}), ("e", 91, {0}), ("e", 92, set()), ("f", 1, {5})]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_overlap(spark, seed):
    from evalsift.operators import setjoin

    rows = cases(seed)
    df = spark.createDataFrame([(g, i, sorted(e)) for g, i, e in rows], "grp string, id long, elements array<long>")
    got = {(r["grp"], r["id"]): (r["size"], round(r["best"], 9)) for r in setjoin.best_overlap(df).collect()}
    assert got == brute(rows)


def test_an_element_in_all_sets_is_never_joined_with_itself(spark, monkeypatch):
    """The pairs that are looked at grow with the sets, not with their square."""
    from evalsift.operators import setjoin

    looked = []
    real = setjoin.verified
    monkeypatch.setattr(setjoin, "verified", lambda pairs, kinds: looked.append(pairs.count()) or real(pairs, kinds))
    n = 600
    # a passage of eight in all; each set shares one more element with one other set
    df = spark.range(n).select(F.lit("g").alias("grp"), "id", F.concat(F.sequence(F.lit(1), F.lit(8)), F.array(F.lit(1000) + F.floor(F.col("id") / 2)), F.sequence(F.col("id") * 100 + 10_000, F.col("id") * 100 + 10_030)).cast("array<long>").alias("elements"))
    got = setjoin.best_overlap(df).collect()
    assert all(abs(r["best"] - 9 / 40) < 1e-9 for r in got)
    assert sum(looked) <= 12 * n
