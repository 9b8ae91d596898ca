"""Ranks, resampling, matching and ensembles against plain Python on small tables."""

import collections
import json
import math
import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    """Two groups of very unlike sizes with ties, nulls and both labels."""
    rng = random.Random(3)
    data = [("big" if i % 7 else "small", i, rng.choice([None, *range(40)]) if i % 3 else rng.random() * 50, rng.random() < 0.4) for i in range(600)]
    return [(g, i, None if v is None else float(v), int(y)) for g, i, v, y in data]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "g string, row_id long, x double, y int").cache()


def rank(values, v):
    return sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2


@pytest.mark.parametrize("cuts", [0, 3, 255])
def test_running_sums_and_ranks(spark, rows, table, cuts, monkeypatch):
    from evalsift.operators import prefix

    monkeypatch.setattr(prefix, "CUTS", cuts)
    got = {r["row_id"]: r["r"] for r in prefix.with_rank(table, "x", ["g"], "r").collect()}
    by = collections.defaultdict(list)
    for g, _, x, _ in rows:
        if x is not None:
            by[g].append(x)
    assert got == {i: None if x is None else rank(by[g], x) for g, i, x, _ in rows}
    known = table.where("x is not null")
    order = [F.col("x"), F.col("row_id")]
    got = {r["row_id"]: r["i"] for r in prefix.numbered(known, [], order, prefix.part_of(known, "x"), "i").collect()}
    line = sorted((x, i) for _, i, x, _ in rows if x is not None)
    assert got == {i: n for n, (_, i) in enumerate(line)}
    assert prefix.with_rank(table.limit(0), "x", ["g"], "r").count() == 0


def test_auc_and_u_without_each_group(spark, rows, table):
    from evalsift.operators import ranks

    def u(pairs):
        pos, neg = [x for x, y in pairs if y == 1], [x for x, y in pairs if y == 0]
        return sum((a > b) + (a == b) / 2 for a in pos for b in neg), len(pos) * len(neg)

    known = [(i % 5, x, y) for _, i, x, y in rows if x is not None]
    won, n = u([(x, y) for _, x, y in known])
    r = ranks.roc_auc(table, "x", "y", []).first()
    assert abs(r["auc"] - max(won / n, 1 - won / n)) < 1e-12 and r["sign"] == (1 if won / n >= 0.5 else -1)
    df = table.where("x is not null").withColumn("e", F.col("row_id") % 5)
    got = {r["e"]: r["u"] for r in ranks.u_without(df, "x", "y", "e").collect()}
    for e in range(5):
        assert abs(got[e] - u([(x, y) for k, x, y in known if k != e])[0]) < 1e-6


def test_binomial_draws_invert_the_distribution(spark):
    from evalsift.functions.stats import binomial_draw

    us = [1e-9, 0.01, 0.2, 0.5, 0.77, 0.999, 1 - 1e-9]
    cells = [(10, 3), (1, 0), (5, 5), (200, 11), (3000, 1800), (40, 39)]
    df = spark.createDataFrame(cells, "n long, k long").select("n", "k", binomial_draw(F.col("n"), F.col("k"), F.array(*[F.lit(u) for u in us])).alias("d"))
    for r in df.collect():
        n, k, cdf, want = r["n"], r["k"], 0.0, []
        p = k / n
        if 0 < k < n:
            table = []
            for x in range(n + 1):
                cdf += math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log(1 - p))
                table.append(cdf)
            want = [next((x for x, c in enumerate(table) if c >= u), n) for u in us]
        assert list(r["d"]) == (want or [k] * len(us)), (n, k)


def test_bootstrap_covers_what_the_normal_form_says(spark):
    from evalsift.operators.resample import bootstrap_ci

    rows = [("c", "clean", int(i < 240)) for i in range(400)] + [("c", "contam", int(i < 300)) for i in range(400)] + [("lone", "clean", 1)]
    got = bootstrap_ci(spark.createDataFrame(rows, "cell string, side string, correct int"), ["cell"], 2000).collect()
    assert len(got) == 1
    se = math.sqrt(0.6 * 0.4 / 400 + 0.75 * 0.25 / 400)
    assert abs(got[0]["ci_low"] - (-0.15 - 1.96 * se)) < 0.01 and abs(got[0]["ci_high"] - (-0.15 + 1.96 * se)) < 0.01


def test_matched_rows_repeat_the_nearest_negative(spark):
    from evalsift.operators.calibrate import difficulty_matched, matched_rows

    rows = [("A", "dev", 1, 1, 10.0), ("A", "dev", 2, 1, 11.0), ("A", "dev", 3, 0, 12.0), ("A", "dev", 4, 0, 90.0), ("B", "val", 5, 1, 50.0), ("B", "val", 6, 0, 40.0), ("B", "val", 7, 0, 59.0), ("C", "val", 8, 1, 1.0)]
    df = spark.createDataFrame(rows, "variant string, split string, row_id long, label int, loss double")
    got = sorted((r["row_id"], r["label"], round(r["difficulty"], 3)) for r in matched_rows(df, ["loss"], "loss", "label", "row_id", "variant").collect())
    assert got == [(1, 1, 0.0), (2, 1, 0.333), (3, 0, 0.667), (3, 0, 0.667), (5, 1, 0.5), (7, 0, 1.0), (8, 1, 0.0)]
    r = difficulty_matched(df, ["loss"], "loss", "label", "row_id", "variant").first()
    assert (r["n_dev"], r["n_val"]) == (4, 3) and 0 <= r["auc"] <= 1 and 0 < r["f1"] <= 1


def test_deployment_gap_and_agreement(spark):
    from evalsift.operators.calibrate import deployment_gap, kmeans_strata
    from evalsift.operators.ranks import agreement

    rows = [("p", 0.05, 0)] * 20 + [("p", 0.9, 1)] * 25 + [("q", 0.05, 1)] * 20 + [("q", 0.9, 0)] * 20 + [("few", 0.05, 1)] * 19 + [("few", 0.9, 1)] * 40
    r = deployment_gap(spark.createDataFrame(rows, "v string, score double, correct int"), ["v"]).first()
    assert (r["n_cells"], r["mean_gap"], r["correct_dir"]) == (2, 0.0, 0.5)
    preds = spark.createDataFrame([("v", 1, 1), ("v", 1, 0), ("v", 0, 0), ("v", 0, 0), ("v", None, 1)], "k string, a int, b int")
    r = agreement(preds, ["k"], [("a", "b")]).first()
    assert (r["n"], r["agreement"], r["tpr"]) == (4, 0.75, 1.0) and abs(r["fpr"] - 1 / 3) < 1e-12 and abs(r["kappa"] - 0.5) < 1e-12
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r["stratum"] for r in kmeans_strata(few, "vec_id", "embedding", 4).collect()} == {0}


def test_canary_by_classes(spark):
    from evalsift.operators.ngram import canary

    texts = ["a b c d e f", "a b c d e f", "a b c d e g", "x y z w v u", "a b", "q r s t u v w x", "r s t u v w", None]
    df = spark.createDataFrame([("g", i, (t or "").split()) for i, t in enumerate(texts)] + [("h", 100, "a b c d e f".split())], "benchmark string, item_id long, t array<string>")
    grams = [{tuple((t or "").split()[i : i + 3]) for i in range(len((t or "").split()) - 2)} for t in texts]
    want = {i: (len(s), max([len(s & o) / min(len(s), len(o)) for j, o in enumerate(grams) if j != i and s and o], default=0.0)) for i, s in enumerate(grams)} | {100: (4, 0.0)}
    assert {r["item_id"]: (r["size"], r["best"]) for r in canary(df, 3).collect()} == want


def test_every_template_and_the_fallback(spark):
    from evalsift.functions import grade as G

    item = {"question": "q", "answer": "a", "subject": "s", "choices": ["x", "y"], "labels": ["1", "2"], "label": 1, "context": "c", "solution": "z"}
    want = {
        "gsm8k_test": "Question: q\nAnswer: a", "mmlu_test": "Subject: s\nQuestion: q\nA. x\nB. y\nAnswer: B", "hellaswag_val": "Context: c\nContinuation: y", "arc_challenge": "Question: q\n1. x\n2. y\nAnswer: a",
        "humaneval": "qz", "mbpp": "q\nz", "math": "Problem: q\nSolution: z", "math500": "Problem: q\nSolution: z", "truthfulqa_mc": "Question: q\nx (1)\ny (2)", "bbh": "q\nAnswer: a", "agieval": "q\nAnswer: a",
        "aime2024": "Problem: q\nAnswer: a", "livecodebench": "q\nz",
    }
    assert set(want) == set(G.RENDERERS)
    df = spark.createDataFrame([(b, *item.values()) for b in [*want, "other"]], "benchmark string, question string, answer string, subject string, choices array<string>, labels array<string>, label int, context string, solution string")
    got = dict(df.select("benchmark", G.render_item(F.col("benchmark"), F.to_json(F.struct(*item)))).collect())
    assert json.loads(got.pop("other")) == item and got == want


def test_json_arrays_are_capped_and_malformed_ones_empty(spark):
    from evalsift.functions import grade as G

    rows = ['[{"k":1},{"k":2},{"k":3},{"k":4},{"k":5},{"k":6}]', "[]", '[{"k":1}', None, "no"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(G.json_cases(F.col("t"), "struct<k: bigint>").alias("c"))
    assert [[x["k"] for x in r["c"]] for r in df.collect()] == [[1, 2, 3, 4, 5], [], [], [], []]
