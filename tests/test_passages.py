"""Elements that the same sets have are joined as one passage, not one by one."""

import random


def test_a_passage_is_one_entry_a_kind(spark, monkeypatch):
    from evalsift.operators import setjoin

    rng = random.Random(5)
    # passages of 60 elements, each in about a sixth of the sets; every set has three and one of its own
    rows = [(i, sorted({x for p in rng.sample(range(18), 3) for x in range(100 * p, 100 * p + 60)} | {10_000 + i})) for i in range(60)]
    want = {i: round(max(len(set(e) & set(f)) / 181 for j, f in rows if j != i), 9) for i, e in rows}
    entries = []
    real = setjoin.stored

    def stored(df):
        out = real(df)
        if "h" in df.columns and "kind" in df.columns:
            entries.append(out.count())
        return out

    monkeypatch.setattr(setjoin, "stored", stored)
    df = spark.createDataFrame([("g", i, e) for i, e in rows], "grp string, id long, elements array<long>")
    got = {r["id"]: round(r["best"], 9) for r in setjoin.best_overlap(df).collect()}
    # equal triples have 1, their own element apart: 180 of 181
    assert got == want
    assert entries and max(entries) <= 3 * len(rows)
