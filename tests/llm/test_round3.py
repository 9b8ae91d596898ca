"""Operators 11 to 13 against brute-force versions: odd texts, nulls, repeated rows, ties, empty tables, clashing columns."""

import collections
import hashlib
import io
import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "two  spaces ", "\ttab\nline\n\nend", "▁bar ▁ x", "<|endoftext|> <s> </s> <0x41>", "é ﬁ 😀😀 あいう 한국어", "it's they'll I'd", "x\u0085y z \x1c q", "0000000000000000 1,2;3|4", "same row", "same row", "\x00 nul", "ünï " * 400, "a" * 3000]
CLASH = ["row", "pair", "pairs", "counts", "n", "c", "_b", "file", "digest", "first", "to", "term", "at", "zero", "v", "p", "q", "item", "value", "rank", "copies"]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(None if i == 3 else 900000 + i - (t == "same row"), t, None if i % 5 == 0 else "en", None if i % 3 == 0 else "src0", 0) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd).withColumns({c: F.lit(1) for c in CLASH}).cache()


def gold_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    from evalsift.llm.alignment import A_FILE, B_FILE, byte_letters

    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b, letters = sentencepiece.SentencePieceProcessor(model_file=B_FILE), byte_letters()
    out = []
    for t in texts:
        said = " " + (t or "")
        ids = (a.encode(said, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        one = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]]
        two = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]]
        if b"".join(one) != said.encode() or b"".join(two) != said.encode():
            ids, one, two = ([], []), [], []
        ends = [np.cumsum([len(x) for x in side]).tolist() if side else [] for side in (one, two)]
        common = sorted(set(ends[0]) & set(ends[1]))
        place = {e: k for k, e in enumerate(common)}
        groups, k = [[[], []] for _ in common], [0, 0]
        for side in (0, 1):
            for i, e in zip(ids[side], ends[side], strict=True):
                groups[k[side]][side].append(i)
                k[side] += e in place
        at = dict(zip(ends[1], ids[1], strict=True))
        links = [(i, at[e]) for i, e in zip(ids[0], ends[0], strict=True) if e in at]
        starts = [[0, *e[:-1]] for e in ends]
        overlap = sum(1 for s, e in zip(starts[0], ends[0]) for u, f in zip(starts[1], ends[1]) if s < f and u < e) if len(one) < 200 else None
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(one), len(two), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if one else "", overlap, sum(len(x) * len(y) for x, y in groups)))
    return out


@pytest.mark.parametrize("hot", [None, 200])
def test_alignment(docs, hot, monkeypatch):
    from evalsift.llm import alignment

    if hot:
        monkeypatch.setattr(alignment, "HOT_PAIRS", hot)  # then most pairs take the way of the rare ones
    rows = docs.select("doc_id", "text").collect()
    gold = gold_alignment([r["text"] for r in rows])
    counts = collections.Counter(x for g in gold for x in g[3])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    want = collections.Counter((r["doc_id"], *g[:3], len(g[3]), sum(counts[x] == best[x[1]] for x in g[3]), sum(counts[x] for x in g[3]), g[4], g[6]) for r, g in zip(rows, gold, strict=True))
    got = alignment.align_documents(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"], r["n_shared"]) for r in got) == want
    overlap = {g[4]: g[5] for g in gold if g[5] is not None}
    assert all(overlap.get(r["groups_sha256"], r["n_overlap"]) == r["n_overlap"] for r in got)
    assert sum(r["n_a"] == 0 for r in got) >= 3  # null, empty, and U+2581, which piece vocabularies take for a space


def test_products():
    from evalsift.llm.alignment import Csr, products, starts_of, transposed

    rng = np.random.default_rng(1)
    a, b = ((rng.random((40, 30)) < 0.2) * rng.integers(1, 5, (40, 30)) for _ in range(2))
    csr = lambda m, values=True: Csr(starts_of((m > 0).sum(1)), np.nonzero(m)[1], m.shape[1], m[m > 0] if values else None)
    for most in (1, 7, 1 << 20):
        got = np.zeros((40, 40), int)
        for i, j, v in products(csr(a), transposed(csr(b, False)), most):
            assert len(set(zip(i.tolist(), j.tolist()))) == len(i)
            got[i, j] += v
        assert (got == a @ (b > 0).T).all()


def test_words_are_cut_where_both_tokenizers_cut():
    """Texts cut into words give the ids of whole texts, for any white space and letters."""
    from evalsift.llm.alignment import table_of, A_FILE, B_FILE

    e, rng = table_of(A_FILE, B_FILE).e, np.random.default_rng(3)
    bits = ["a", "the", " ", "  ", "\n", "\t", ".", "'s", "é", "1", "12", " ", "　", "日", "😀", "_", "<s>", "ing", "\u0085", "\x1c"]
    for _ in range(400):
        text = "".join(bits[i] for i in rng.integers(0, len(bits), 30))
        whole = e.one.encode_ordinary(" " + text), e.two.encode(text)
        a, b, _, _, bad = e.encode(e.words(text))
        assert (a.tolist(), b.tolist()) == whole and not bad.any()


@pytest.fixture(scope="module")
def pages(spark):
    big, odd = "x" * 1200, "ü" * 600
    rows = [(1, "u", big), (5, "u", big), (3, "u", big), (5, "u", big), (None, "u", big), (6, "u", odd), (7, "u", odd), (8, "u", "y" * 999), (9, "u", "y" * 999), (10, "u", None), (11, "u", ""), (None, "u", "only null " * 200), (12, "u", "WARC/1.1\r\n\r\n" * 300), (13, "u", "z" * 700_000)]
    extra = spark.createDataFrame(rows, "page_id long, url string, html string")
    return spark.read.parquet(f"{SF}/pages.parquet").unionByName(extra).withColumns({c: F.lit(1) for c in CLASH}).cache()


def test_warc(pages):
    from evalsift.llm.warc import archive_pages

    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.select("page_id", "html").collect()]
    last = collections.defaultdict(list)
    for i, data in rows:
        last[data].append(i)
    want = collections.Counter()
    for i, data in rows:
        known = [x for x in last[data] if x is not None]
        to = max(known) if len(data) >= 1000 and known and i != max(known) else None
        want[i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert collections.Counter(tuple(r) for r in archive_pages(pages).collect()) == want


def test_warc_files(spark, tmp_path, monkeypatch):
    """The normalised file: any member inflates alone, the sidecar tells where it lies, all of it inflates to the source."""
    from evalsift.llm import warc

    monkeypatch.setattr(warc, "PIECE", 7)  # so that heads, bodies and members end anywhere within a piece
    records = [warc.record(i, bytes([65 + i]) * (i * 13), None) for i in range(6)] + [warc.record(9, b"abc", 4), warc.record(None, b"", None)]
    whole = b"".join(records)
    for source in (gzip.compress(whole), gzip.compress(whole[:200]) + gzip.compress(whole[200:]) + b"\0\0", b"".join(map(gzip.compress, records))):
        out = io.BytesIO()
        index = list(warc.normalise(io.BytesIO(source), out))
        data = out.getvalue()
        assert len(index) == len(records) and sum(x[1] for x in index) == len(data)
        for (offset, length, kind, target), r in zip(index, records, strict=True):
            assert zlib.decompress(data[offset : offset + length], 31) == r
        assert [x[2] for x in index] == ["response"] * 6 + ["revisit", "response"]
        assert gzip.decompress(data) == whole
        found = [warc.parse(data[o : o + n]) for o, n, _, _ in index]
        assert [f["page_id"] for f in found] == [0, 1, 2, 3, 4, 5, 9, None] and found[6]["refers_to"] == 4 and found[6]["payload_bytes"] == 3
    with pytest.raises(ValueError, match="ends within"):
        list(warc.normalise(io.BytesIO(gzip.compress(whole[:-200])), io.BytesIO()))


def test_warc_rolls_files(spark, pages, tmp_path, monkeypatch):
    from evalsift.llm import warc

    few = pages.where("page_id < 14").select("page_id", "html").coalesce(1)
    files = warc.write_archives(few, f"file://{tmp_path}/one")
    index = warc.normalise_archives(files, f"file://{tmp_path}/one", f"file://{tmp_path}/two")
    rows = index.collect()
    assert len(rows) == few.count() and {r["file"] for r in rows} == {p.name for p in (tmp_path / "two").glob("*.gz")}
    for p in (tmp_path / "two").glob("*.idx"):
        lines = [x.split(" ") for x in p.read_text().splitlines()]
        assert [(int(x[1]), int(x[2]), x[3]) for x in lines] == [(r["offset"], r["length"], r["type"]) for r in sorted(rows, key=lambda r: r["position"]) if r["file"] + ".idx" == p.name]
    assert warc.read_records(index, f"file://{tmp_path}/two").count() == len(rows)


def gold_audit(rows, least, added, most):
    import re

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, df, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [t.translate(fold) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for t in found:
            count[lang, source, t] += 1
        for t in set(found):
            df[lang, t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept, sources = sorted(t for (x, t), n in df.items() if x == lang and n >= least), sorted(s for x, s in groups if x == lang)
        n = {s: [count[lang, s, t] for t in kept] for s in sources}
        share = lambda c: [1 + 10**9 * (x + added) // (sum(c) + added * len(kept)) for x in c]
        p, q = {s: share(n[s]) for s in sources}, share([sum(n[s][k] for s in sources) for k in range(len(kept))])
        for s in sources:
            pairs = sorted((-sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s)
            terms = sorted((y - x, t.encode()) for t, x, y, c in zip(kept, p[s], q, n[s], strict=True) if c and x > y)[:most]
            out |= {(lang, s, part, o.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, o) in enumerate(found)}
    return out


@pytest.mark.parametrize("least", [30, 2])
def test_divergence(docs, least, monkeypatch):
    from evalsift.llm import divergence

    monkeypatch.setattr(divergence, "LEAST_DOCS", least)
    monkeypatch.setattr(divergence, "HELD_TERMS", 500)
    monkeypatch.setattr(divergence, "HOT", 10)
    monkeypatch.setattr(divergence, "HELD_PAIRS", 50)
    alone = docs.limit(1).withColumns({"lang": F.lit("xx"), "text": F.lit("Only ONE source")})
    lone = docs.limit(1).withColumns({"lang": F.lit("yy"), "text": F.lit("12 34"), "source": F.lit("s")})
    many = docs.where("text is not null").limit(3).crossJoin(docs.sparkSession.range(40)).drop("id")  # groups of copies
    both = docs.unionByName(alone).unionByName(lone).unionByName(many).cache()
    got = [tuple(r) for r in divergence.audit(both).collect()]
    want = gold_audit([tuple(r) for r in both.select("text", "lang", "source").collect()], least, 5, 50)
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("hot", [1000, 200])
def test_divergence_tokenizes_each_text_once(docs, spark, hot, monkeypatch):
    """Rows of a text stand together, one for each source, whatever the number of copies."""
    from evalsift.llm import divergence
    from evalsift.llm.divergence import collapsed, share

    monkeypatch.setattr(divergence, "HOT", hot)
    rows = spark.createDataFrame([(f"t{i % 7}", "en", f"s{i % 3}") for i in range(2100)], "text string, lang string, source string")
    got = collapsed(rows).withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == 21 and all(r["copies"] == 100 for r in got)
    assert len({(r["part"], r["text"]) for r in got}) == 7
    order = [r["text"] for r in got]
    assert sum(a != b for a, b in zip(order, order[1:])) == 6
    big = 10**12
    assert spark.range(1).select(F.lit(big).alias("n"), F.lit(7 * big + 1).alias("of"), F.lit(10**6).alias("v")).select(share("n", "of", "v").alias("p")).first()["p"] == 1 + 10**9 * (big + 5) // (7 * big + 1 + 5 * 10**6)


def test_empty(spark):
    from evalsift.llm import alignment, divergence, warc

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert alignment.align_documents(none).count() == 0
    assert divergence.audit(none).count() == 0
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _band(spark, texts, comps):
    """(placed, known) of one tree whose members are these texts."""
    import pyarrow as pa

    from evalsift.llm import jaccard_join as J

    sets = list(J.shingle_sets(pa.array(texts)))
    fps = [J.fingerprint(s) for s in sets]
    placed = spark.createDataFrame([(7, f, len(s), c) for f, s, c in zip(fps, sets, comps, strict=True)], "key long, fp long, n long, comp long")
    known = spark.createDataFrame([(f, *J.bitmap(s).tolist()) for f, s in zip(fps, sets, strict=True)], "fp long, " + ", ".join(f"{b} long" for b in J.BITMAP))
    return placed, known, sets


def test_one_stranger_in_a_band_of_near_copies(spark):
    """20,000 near copies and one that stands apart: about a row a member goes on, none where the stranger is out of reach."""
    from evalsift.llm import jaccard_join as J

    word = [f"w{i}" for i in range(120)]
    copies = [" ".join([*word[:60], f"x{i}", *word[60:]]) for i in range(20_000)]
    close = " ".join([*word[:50], "y", *word[50:]])
    far = " ".join([*word[:10], *[f"z{i}" for i in range(110)]])
    for stranger, least, most in ((close, 20_000, 60_000), (far, 0, 100)):
        placed, known, sets = _band(spark, [*copies, stranger], [1] * 20_000 + [2])
        rows, used = J.dealt(placed, known)
        got = rows.select("i", "j", "side", "comp").collect()
        assert least <= len(got) <= most, len(got)
        # the copies never meet each other, and each of them that goes on meets the stranger once
        assert all(r["i"] == 0 and (r["comp"] == 2) == (r["side"] == 0) for r in got)
        J.discard(*used)


def test_bitmaps_follow_the_sets():
    from evalsift.llm import jaccard_join as J

    rng = np.random.default_rng(2)
    for size in (3, 200, 20_000):
        sets = np.empty(4, object)
        sets[:] = [rng.integers(0, 2**63, size, dtype=np.uint64) for _ in range(4)]
        bits = J.bitmaps(sets)
        full = J._pop(bits) / (64 * bits.shape[1])
        assert full.max() < 0.4 and bits.nbytes <= max(4 * 8 * J.WORDS, sum(s.nbytes for s in sets) // 4)


def test_planted_pairs_at_the_threshold(spark):
    """300 pairs of similarity 0.75 to 0.8, 300 just below 0.75: all of the former link, none of the latter."""
    from evalsift.llm import jaccard_join as J

    rng = np.random.default_rng(11)
    rows, want = [], {}
    for i in range(600):
        n = int(rng.integers(60, 400))
        one = [f"p{i}q{k}" for k in range(n)]
        # the end differs: shared and own shingles can be counted
        m = n - 4
        cut = int(np.floor(m * (0.75 + 0.05 * rng.random()) * 2 / (1.75 + 0.05))) if i < 300 else int(m * 0.84)
        while i < 300 and 100 * cut < 75 * (2 * m - cut):
            cut += 1
        two = one[: cut + 4] + [f"r{i}s{k}" for k in range(n - cut - 4)]
        both = 100 * cut >= 75 * (2 * m - cut)
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
        want[2 * i + 1] = 2 * i if both else 2 * i + 1
    got = {r["doc_id"]: r["component_id"] for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(want[2 * i + 1] == 2 * i for i in range(300)) == 300 and sum(want[2 * i + 1] == 2 * i for i in range(300, 600)) == 0
    assert all(got[k] == v for k, v in want.items())
