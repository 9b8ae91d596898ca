"""Quantiles by selection and many fits at once, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def plain_fit(x, y, c=1.0):
    """Balanced L2 logistic regression by damped Newton steps on standardised columns: (mean, sd, coefficients, intercept)."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd == 0, 1, sd)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1 / c] * x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - 0.5 * np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + ridge, z.T @ (w * (p - y)) + ridge @ b)
    return mean, sd, b[1:], b[0]


def check_model(model, features, frame, y):
    mean, sd, coef, intercept = plain_fit(frame[features].to_numpy(float), y)
    assert list(model["features"]) == features
    for k, f in enumerate(features):
        assert np.allclose(model["features"][f], (mean[k], sd[k], coef[k]), rtol=1e-6, atol=1e-6)
    assert abs(model["intercept"] - intercept) < 1e-6


def test_many_fits(spark):
    from evalsift.operators.calibrate import fit_ensemble
    from evalsift.operators.fits import fit_many

    rng = np.random.default_rng(5)
    n = 900
    a, b = rng.normal(3, 2, n), rng.exponential(5, n)
    c = 0.5 * a + rng.normal(0, 1, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(a - 4 + 0.3 * (b - 5))))).astype(int)
    df = spark.createDataFrame([(int(i), *map(float, v), int(t), int(i % 5)) for i, (*v, t) in enumerate(zip(a, b, c, y, strict=True))], "id long, a double, b double, c double, y int, fold int")
    holes = df.withColumns({"a": F.when(F.col("id") % 50 != 7, F.col("a")), "y": F.when(F.col("id") % 90 != 3, F.col("y"))}).cache()
    fits = {f"cv {i}": (["a", "b", "c"], F.col("fold") != i) for i in range(5)} | {"no a": (["b", "c"], F.lit(True)), "b": (["b"], F.col("id") < 300), "turned": (["c", "a"], F.lit(True)), "none": (["a"], F.lit(False))}
    got = fit_many(holes, fits, "y")
    frame = holes.toPandas()
    for name, (features, _) in fits.items():
        if name == "none":
            assert got[name]["features"]["a"][2] == 0
            continue
        rows = frame.dropna(subset=[*features, "y"])
        rows = rows[rows.fold != int(name[3:])] if name.startswith("cv") else rows[rows.id < 300] if name == "b" else rows
        check_model(got[name], features, rows, rows.y.to_numpy(float))
    one = fit_ensemble(df, ["a", "b", "c"], "y")
    check_model(one, ["a", "b", "c"], df.toPandas(), y.astype(float))


def test_ten_fits_take_the_jobs_of_one(spark):
    from evalsift.operators.fits import fit_many

    df = spark.range(400).selectExpr("id", "cast(id % 17 as double) as a", "cast(id % 23 as double) as b", "cast(id * 7 % 11 < 5 as int) as y").cache()
    df.count()

    def jobs(fits):
        tag = f"fits-{len(fits)}"
        spark.sparkContext.setJobGroup(tag, tag)
        fit_many(df, fits, "y")
        spark.sparkContext.setJobGroup("rest", "rest")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))

    assert jobs({f"{i}": (["a", "b"], F.col("id") % 10 != i) for i in range(10)}) <= jobs({"one": (["a", "b"], F.lit(True))}) + 4


def test_the_logistic_queries_use_those_fits(spark):
    """kfold_eval: the AUC of each fold by NumPy from plain fits."""
    from evalsift.operators import resample
    from evalsift.plans import QUERIES
    from evalsift.plans.base import FEATURES, calib

    sf = "/root/testdata/sf0.001"
    got = {(r["k"], r["fold"]): r["auc"] for r in QUERIES["kfold_eval"](spark, sf).collect()}
    assert set(got) == {(k, i) for k in (2, 3, 5) for i in range(k)}
    for k in (2, 5):
        frame = resample.kfold(calib(spark, sf), k, "cv", "row_id", []).toPandas()
        for i in range(k):
            fit = frame[frame.fold != i].dropna(subset=[*FEATURES, "label"])
            mean, sd, coef, _ = plain_fit(fit[FEATURES].to_numpy(float), fit.label.to_numpy(float))
            out = frame[frame.fold == i]
            x = out[FEATURES].to_numpy(float)
            s, y = ((np.where(np.isnan(x), mean, x) - mean) / sd) @ coef, out.label.to_numpy()
            pos, neg = s[y == 1], s[y == 0]
            auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
            assert abs(max(auc, 1 - auc) - got[k, i]) < 1e-6


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_quantiles(spark, broadcast, monkeypatch):
    from evalsift.operators import quantiles as Q

    monkeypatch.setattr(Q, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(2)
    groups = {"normal": rng.normal(0, 1, 700), "ties": rng.integers(0, 4, 500) * 1.0, "one": np.array([3.5]), "same": np.full(50, -2.0), "wide": np.concatenate([10.0 ** rng.integers(-300, 300, 300), -(10.0 ** rng.integers(-300, 300, 200))]), "huge": np.array([-1.7e308, 1.7e308, 0.0, 1.0]), None: rng.random(40), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("empty", None), ("normal", None), ("normal", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.777, "e": 1.0}
    got = {r["g"]: r for r in Q.quantiles(df, "x", ["g"], qs).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        s = np.sort(x)
        for name, q in qs.items():
            h = (len(s) - 1) * q
            lo, hi = s[int(h)], s[min(int(h) + 1, len(s) - 1)]
            assert got[g][name] == lo + (hi - lo) * (h - int(h)) or g in ("wide", "huge") and np.isclose(got[g][name], lo + (hi - lo) * (h - int(h)))
    own = spark.createDataFrame([(g, f"n{i}", q) for i, g in enumerate(groups) for q in (0.1 * i,)], "g string, name string, q double")
    for r in Q.quantiles(df, "x", ["g"], per_group=own).collect():
        i = int(r["name"][1:])
        assert list(groups)[i] == r["g"] and np.isclose(r["quantile"], np.quantile(groups[r["g"]], 0.1 * i), rtol=1e-9)
    whole = Q.quantiles(df.where("g = 'ties'"), "x", [], {"q": 0.25}).collect()
    assert len(whole) == 1 and whole[0]["q"] == np.quantile(groups["ties"], 0.25)
    assert Q.quantiles(df.limit(0), "x", ["g"], qs).count() == 0
    assert Q.with_quantiles(df, "x", ["g"], {"q": 0.5}).count() == len(rows) - 1


def test_quantile_of_one_group_of_a_million_values(spark):
    """One group of 1e6 distinct values: rows go in bins from the first pass on, none is gathered or sorted."""
    from evalsift.operators.quantiles import quantiles

    df = spark.range(0, 1_000_000, 1, 8).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("x"))
    got = quantiles(df, "x", ["g"], {"m": 0.5, "t": 0.999}).first()
    x = (np.arange(1_000_000) * 7919) % 1_000_003
    assert (got["m"], got["t"]) == (np.quantile(x, 0.5), np.quantile(x, 0.999))


def test_shuffles_of_real_outcomes_against_every_labelling(spark, monkeypatch):
    import itertools

    from evalsift.operators import shuffle

    rng = np.random.default_rng(8)
    cells = {"a": (rng.normal(0, 1, 5), rng.normal(0.7, 1, 6)), "ties": (rng.integers(0, 3, 6) * 0.1, rng.integers(0, 4, 5) * 0.1), "same": (np.full(4, 2.0), np.full(4, 2.0)), "few": (np.array([1.0, 2.0]), rng.normal(0, 1, 9)), "01": (np.array([1.0, 1, 0, 1]), np.array([0.0, 0, 1, 0, 0]))}
    rows = [(k, s, float(v)) for k, (x, y) in cells.items() for s, z in (("clean", x), ("contam", y)) for v in z] + [("a", None, 3.0), ("a", "mid", 3.0), ("a", "clean", None), ("one side", "clean", 1.0)]
    df = spark.createDataFrame(rows, "cell string, side string, v double")
    for part in (4096, 2):  # one part a cell, or several
        monkeypatch.setattr(shuffle, "PART", part)
        got = {r["cell"]: r for r in shuffle.shuffle_test(df, "v", ["cell"], 4000).collect()}
        assert set(got) == set(cells) and got["few"]["p_perm"] is None
        for k, (x, y) in cells.items():
            assert (got[k]["n_clean"], got[k]["n_contam"]) == (len(x), len(y)) and abs(got[k]["gap"] - (x.mean() - y.mean())) < 1e-12
            if k != "few":
                both, n = np.concatenate([x, y]), len(x)
                sums = np.array([both[list(c)].sum() for c in itertools.combinations(range(len(both)), n)])
                gaps = sums / n - (both.sum() - sums) / len(y)
                exact = (gaps <= x.mean() - y.mean() + 1e-9).mean()
                assert abs(got[k]["p_perm"] - exact) < 4 * (0.25 / 4000) ** 0.5, (k, part)
    again = {r["cell"]: r["p_perm"] for r in shuffle.shuffle_test(df.repartition(7), "v", ["cell"], 4000).collect()}
    assert again == {k: r["p_perm"] for k, r in got.items()}


def test_poisson_bootstrap_against_the_closed_form(spark):
    from evalsift.operators.shuffle import POISSON, poisson_bootstrap

    import math

    assert np.allclose(POISSON, np.cumsum([math.exp(-1) / math.factorial(k) for k in range(len(POISSON))]), atol=1e-15)
    rng = np.random.default_rng(3)
    x, y = rng.normal(1, 2, 700), rng.exponential(1.5, 500)
    df = spark.createDataFrame([(i, "c", s, float(v)) for i, (s, v) in enumerate([("clean", v) for v in x] + [("contam", v) for v in y])], "id long, cell string, side string, v double")
    r = poisson_bootstrap(df, "v", ["cell"], "id", 1000).first()
    se = (x.var() / len(x) + y.var() / len(y)) ** 0.5
    gap = x.mean() - y.mean()
    assert abs(r["ci_low"] - (gap - 1.96 * se)) < 0.3 * se and abs(r["ci_high"] - (gap + 1.96 * se)) < 0.3 * se


def test_nearest_match_over_ranges(spark):
    """One group over many ranges, ties, runs of ranges without negatives, null values and groups without negatives."""
    from evalsift.operators.peers import nearest_match

    rng = np.random.default_rng(4)
    pos = [("g", i, float(v)) for i, v in enumerate(rng.integers(0, 5000, 900))] + [("g", 5000, None), ("h", 1, 2.0), (None, 7, 1.0)]
    neg = [("g", 10_000 + i, float(v)) for i, v in enumerate(np.concatenate([rng.integers(0, 400, 60), rng.integers(4700, 5000, 60)]))] + [("g", 9, None), (None, 8, 3.0), ("k", 1, 1.0)]
    a, b = (spark.createDataFrame(x, "grp string, id long, x double") for x in (pos, neg))
    got = {(r["grp"], r["id"]): (r["match"], r["distance"]) for r in nearest_match(a, b, "x", "id", ["grp"]).collect()}
    for g, i, x in pos:
        best = min(((abs(x - y), j) for h, j, y in neg if h == g and y is not None), default=None) if x is not None else None
        assert got[g, i] == ((best[1], best[0]) if best else (None, None)), (g, i, x)
    assert len(got) == len(pos)


def test_a_bucketed_index_is_not_shuffled(spark, tmp_path):
    import io as text
    from contextlib import redirect_stdout

    from evalsift.functions.text import tokenize_words
    from evalsift.operators.ngram import overlap, stored_overlap
    from evalsift.sources.io import write_bucketed_index

    docs = spark.createDataFrame([("x", " ".join(f"w{(i * j) % 41}" for j in range(60))) for i in range(1, 30)] + [("x", None), ("x", "")], "corpus string, text string")
    items = spark.createDataFrame([(i, [f"w{(i * j) % 41}" for j in range(30)]) for i in range(1, 45)] + [(99, []), (98, ["w1"])], "item_id long, t array<string>")
    index = write_bucketed_index(docs, tokenize_words(F.col("text")), [3, 5], "grams_of_a_test", f"file://{tmp_path}/index", 4)
    got = stored_overlap(items, index, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, overlap(items, docs.select(tokenize_words(F.col("text")).alias("t")), 5).collect()))
    with redirect_stdout(text.StringIO()) as out:
        got.explain("simple")
    lines = out.getvalue().splitlines()
    scan = next(i for i, x in enumerate(lines) if "grams_of_a_test" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, at = [], depth(lines[scan])
    for x in reversed(lines[:scan]):  # the nodes between the scan and the join
        if depth(x) < at:
            above.append(x)
            at = depth(x)
            if "Join" in x:
                break
    assert "Join" in above[-1] and not any("Exchange" in x for x in above)
    assert index.count() == index.distinct().count()
    spark.sql("drop table grams_of_a_test")


def test_ranks_in_one_level_and_in_two_agree(spark, monkeypatch):
    from evalsift.operators import prefix

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"g{i % 3}", float(v)) for i, v in enumerate(rng.integers(0, 300, 2000))] + [("g0", None)], "g string, x double").cache()
    one = {(r["g"], r["x"]): r["rank"] for r in prefix.distinct_ranks(df, "x", ["g"]).collect()}
    monkeypatch.setattr(prefix, "ONE_LEVEL", 0)
    assert one == {(r["g"], r["x"]): r["rank"] for r in prefix.distinct_ranks(df, "x", ["g"]).collect()}


def test_commits_of_a_versioned_table(spark, tmp_path, monkeypatch):
    """Merged rows, untouched buckets left alone, a commit killed between data and manifest, a commit given twice, a race."""
    from evalsift.sources.versioned import VersionedTable

    rows = lambda ids, v: spark.createDataFrame([(i, f"{v}{i}") for i in ids], "id long, v string")
    t = VersionedTable(spark, f"file://{tmp_path}/t", ["id"], 8)
    held = lambda: {r["id"]: r["v"] for r in t.read().collect()}
    assert t.read() is None and t.merge(rows(range(100), "a"), "one") == 1
    first = t.manifest()["buckets"]
    assert held() == {i: f"a{i}" for i in range(100)} and len(first) == 8

    assert t.merge(rows([3, 500], "b"), "two") == 2
    want = {i: f"a{i}" for i in range(100)} | {3: "b3", 500: "b500"}
    now = t.manifest()["buckets"]
    assert held() == want and sum(now[k] != first[k] for k in first) in (1, 2)

    def killed(manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(t, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        t.merge(rows(range(50), "c"), "three")
    assert held() == want and t.manifest()["version"] == 2  # its data lie there and are not read
    monkeypatch.undo()
    assert t.merge(rows(range(50), "c"), "three") == 3
    want |= {i: f"c{i}" for i in range(50)}
    assert held() == want
    assert t.merge(rows(range(100), "z"), "three") == 3 and held() == want  # the same commit again: nothing

    stale = t.manifest()
    assert t.merge(rows([7], "d"), "four") == 4
    monkeypatch.setattr(t, "manifest", lambda: stale)  # a writer that has not seen the commit before it
    with pytest.raises(RuntimeError, match="another commit"):
        t.merge(rows([8], "e"), "five")
    monkeypatch.undo()
    assert held() == want | {7: "d7"} and t.merge(rows([8], "e"), "five") == 5 and held() == want | {7: "d7", 8: "e8"}
    assert t.merge(rows([], "f"), "six") == 6 and held() == want | {7: "d7", 8: "e8"}


def test_sketches_of_parts_make_the_sketch_of_the_whole(spark):
    from evalsift.operators.ngram import manifest_counts, merge_manifests, sketch_manifest

    tokens = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), (F.col("id") * 7919 + i * 31) % 9000))
    docs = spark.range(6000).select((F.col("id") % 2).cast("string").alias("corpus"), "id", tokens.alias("t"))
    docs = docs.unionByName(spark.createDataFrame([("tiny", -1, ["a", "b", "c"]), ("none", -2, []), (None, -3, ["x", "y"])], "corpus string, id long, t array<string>")).cache()
    cut = docs.where("id % 3 = 0"), docs.where("id % 3 = 1"), docs.where("id % 3 not in (0, 1)")
    whole = {(r["corpus"], r["n"]): r for r in manifest_counts(sketch_manifest(docs, [2, 3])).collect()}
    parts = merge_manifests(merge_manifests(sketch_manifest(cut[0], [2, 3]), sketch_manifest(cut[1], [2, 3])), sketch_manifest(cut[2].coalesce(1), [2, 3]))
    merged = {(r["corpus"], r["n"]): r for r in manifest_counts(parts).collect()}
    known = {k: v for k, v in whole.items() if k[0] is not None}
    assert {k: v for k, v in merged.items() if k[0] is not None} == known and set(merged) == set(whole)
    exact = {(r["corpus"], n): r["e"] for n in (2, 3) for r in docs.select("corpus", F.explode(F.expr(f"transform(sequence(1, greatest(size(t) - {n - 1}, 1)), i -> slice(t, i, {n}))")).alias("g")).where(f"size(g) = {n}").groupBy("corpus").agg(F.count_distinct("g").alias("e")).collect()}
    for k, r in known.items():
        assert abs(r["ngrams"] - exact.get(k, 0)) <= 0.05 * exact.get(k, 0), (k, r, exact.get(k))
    assert whole["none", 2]["ngrams"] == 0 and whole["tiny", 2]["ngrams"] == 2 and whole["0", 2]["docs"] == 3000
