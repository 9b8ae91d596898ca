"""Components of the n-gram Jaccard join are walked once; later rounds add what they find between components."""


def test_rounds_without_new_links_walk_no_components(spark, monkeypatch):
    from evalsift.llm import jaccard_join as J

    word = lambda i, j: f"w{i}x{j}"
    rows = [(10 * i + c, " ".join([word(i, j) for j in range(60)] + [f"tail{i}y{c}"])) for i in range(6) for c in range(3)]
    walked = []
    real = J.components
    monkeypatch.setattr(J, "components", lambda links: walked.append(1) or real(links))
    got = {r["doc_id"]: r["component_id"] for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d // 10 * 10 for d, _ in rows}
    assert len(walked) == 1


def test_links_merge_into_components(spark):
    from evalsift.llm import jaccard_join as J

    old = [(1, 2), (2, 3), (7, 8), (20, 21), (30, 31)]
    new = [(3, 8), (40, 41), (41, 20), (50, 51), (1, 2)]
    table = lambda x: spark.createDataFrame(x, "a long, b long")
    of = lambda df: {r["fp"]: r["comp"] for r in df.collect()}
    comps = J.written(J.components(table(old)))
    assert J.merged(comps, table([])) is comps
    assert of(J.merged(comps, table(new))) == of(J.components(table(old + new))) == {**dict.fromkeys([1, 2, 3, 7, 8], 1), **dict.fromkeys([20, 21, 40, 41], 20), **dict.fromkeys([30, 31], 30), **dict.fromkeys([50, 51], 50)}
    assert of(J.components(table([]))) == {}
