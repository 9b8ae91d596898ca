"""What the best partner by overlap puts on disk: shared elements, passages of a pair, and no shuffle file for longer than its step."""

import time

from pyspark.sql import functions as F


def longs(df):
    arrays = [c for c, t in df.dtypes if t.startswith("array")]
    return df.agg(F.sum(sum((F.size(c) for c in arrays), F.lit(0)))).first()[0] or 0


def test_elements_of_one_set_alone_are_not_stored(spark, monkeypatch):
    from evalsift.operators import setjoin

    held = []
    real = setjoin.stored

    def stored(df):
        out = real(df)
        held.append(longs(out) if any(t.startswith("array") for _, t in out.dtypes) else 0)
        return out

    monkeypatch.setattr(setjoin, "stored", stored)
    n = 300
    # one element with one other set, a hundred of its own
    df = spark.range(n).select(F.lit("g").alias("grp"), "id", F.concat(F.array(-1 - F.floor(F.col("id") / 2)), F.sequence(F.col("id") * 100, F.col("id") * 100 + 99)).cast("array<long>").alias("elements"))
    got = setjoin.best_overlap(df).collect()
    assert len(got) == n and all(r["size"] == 101 and abs(r["best"] - 1 / 101) < 1e-9 for r in got)
    assert max(held) <= n


def test_a_pair_moves_its_passages_not_their_elements(spark, monkeypatch):
    from evalsift.operators import setjoin

    moved = []
    real = setjoin.verified
    monkeypatch.setattr(setjoin, "verified", lambda pairs, sets: moved.append(longs(sets) / sets.count()) or real(pairs, sets))
    # each set has three of eight passages of 5000 elements; of a passage beyond 2047 the weight takes two longs
    three = [(i, j, k) for i in range(8) for j in range(i) for k in range(j)]
    rows = [(i, [x for p in ps for x in range(10_000 * p, 10_000 * p + 5000)]) for i, ps in enumerate(three)]
    df = spark.createDataFrame([("g", i, [*e, 100_000 + i]) for i, e in rows], "grp string, id long, elements array<long>")
    got = setjoin.best_overlap(df).collect()
    assert len(got) == 56 and all(abs(r["best"] - 10_000 / 15_001) < 1e-9 for r in got)
    assert max(moved) <= 6


def test_weights_of_passages(spark):
    from evalsift.operators.setjoin import packed, weight

    ws = [1, 2047, 2048, 5000, 4096, (1 << 22) + 5, (1 << 31) - 1]
    df = spark.createDataFrame([(w, -7 * w) for w in ws], "w long, h long")
    assert all(r["w"] == r["x"] for r in df.select("w", weight(packed(F.col("h"), F.col("w"))).alias("x")).collect())


def test_no_shuffle_file_outlives_its_step(spark):
    from evalsift.operators import setjoin

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString(" ").split() if "/shuffle_" in x}
    old = files()
    df = spark.range(200).select(F.lit("g").alias("grp"), "id", F.array(F.col("id") % 20, F.col("id") % 30, F.col("id") + 1000).alias("elements"))
    setjoin.best_overlap(df.withColumn("elements", F.array_distinct("elements")))
    until = time.time() + 30
    while (left := files() - old) and time.time() < until:
        time.sleep(0.5)
    assert not left


def test_an_id_that_comes_twice_has_the_grams_of_both_rows(spark):
    from evalsift.operators.ngram import canary

    texts = [("g", 1, "a b c"), ("g", 1, "c d"), ("g", 2, "c d e"), ("g", 3, ""), ("g", 3, "x y"), ("g", 4, ""), ("g", 5, "c d e"), (None, 6, "a b c d"), (None, 7, "a b")]
    df = spark.createDataFrame([(g, i, t.split()) for g, i, t in texts], "benchmark string, item_id long, t array<string>")
    got = sorted((r["benchmark"] or "", r["item_id"], r["size"], r["best"]) for r in canary(df, 2).collect())
    assert got == [("", 6, 3, 0.0), ("", 7, 1, 0.0), ("g", 1, 3, 0.5), ("g", 1, 3, 0.5), ("g", 2, 2, 1.0), ("g", 3, 1, 0.0), ("g", 3, 1, 0.0), ("g", 4, 0, 0.0), ("g", 5, 2, 1.0)]


def test_copies_are_cut_into_grams_once(spark, monkeypatch):
    from evalsift.operators import ngram, setjoin

    held = []
    real = setjoin.stored

    def stored(df):
        out = real(df)
        held.append(longs(out) if any(t == "array<bigint>" for _, t in out.dtypes) else 0)
        return out

    monkeypatch.setattr(setjoin, "stored", stored)
    # 30 texts, six copies of each: no gram is in two of them, and each of 50 is in six items
    df = spark.range(180).select(F.lit("g").alias("benchmark"), F.col("id").alias("item_id"), F.transform(F.sequence(F.lit(0), F.lit(51)), lambda i: F.concat_ws("-", F.col("id") % 30, i)).alias("t"))
    for few in (1_000_000, 100, 10):  # copies broadcast, firsts broadcast, neither
        monkeypatch.setattr(ngram, "BROADCAST_ROWS", few)
        assert [(r["size"], r["best"]) for r in ngram.canary(df, 3).collect()] == [(50, 1.0)] * 180
    assert max(held) == 0


def test_members_of_a_family_are_sure_of_nearly_their_best_after_the_seeds(spark, monkeypatch):
    """So that few passages are joined afterwards. The smallest set that has an element shares nothing else with the family."""
    import random

    from evalsift.operators import setjoin

    from .test_setjoin import brute

    rng = random.Random(3)
    sets = [set(range(120)) - {rng.randrange(120) for _ in range(30)} | {2000 + i} for i in range(150)]
    rows = [("g", i, e) for i, e in enumerate(sets)] + [("g", 500 + x, {x, *range(10_000 + 100 * x, 10_060 + 100 * x)}) for x in range(120)]
    sure = []
    real = setjoin.best_of

    def best_of(kinds, found):
        out = real(kinds, found)
        if len(found) == 1:
            sure.extend(r["count"] for r in out.where("m > 1").collect())
        return out

    monkeypatch.setattr(setjoin, "best_of", best_of)
    df = spark.createDataFrame([(g, i, sorted(e)) for g, i, e in rows], "grp string, id long, elements array<long>")
    got = {(r["grp"], r["id"]): (r["size"], round(r["best"], 9)) for r in setjoin.best_overlap(df).collect()}
    assert got == brute(rows)
    most = [max(len(e & f) for j, f in enumerate(sets) if j != i) for i, e in enumerate(sets)]
    assert len(sure) == 150 and sum(sure) > 0.9 * sum(most)
