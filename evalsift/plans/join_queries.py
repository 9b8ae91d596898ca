"""Queries over joins, set operations, language models, streams and negatives."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calibrate as K
from ..operators import cells as C
from ..operators import checks, lm, ngram, peers
from ..operators.quantiles import with_quantiles
from ..sources import io
from ..sources.io import table
from .base import NGRAMS_SQL, WORDS_SQL, audit, ben_tok, calib, doc_tok, matrix, models, query, sql

G13, G5 = NGRAMS_SQL.format(t="t", n=13), NGRAMS_SQL.format(t="t", n=5)
OVERLAP = "SELECT b.item_id, coalesce(hit / nullif(n, 0), 0.0::DOUBLE) AS overlap FROM ben_tok b LEFT JOIN (SELECT item_id, count(*) AS n, count(i.g) AS hit FROM (SELECT item_id, unnest({g}) AS g FROM ben_tok) x LEFT JOIN (SELECT DISTINCT unnest({g}) AS g FROM {c}) i USING (g) GROUP BY item_id) USING (item_id)"


@query(sql(OVERLAP.format(g=G13, c="doc_tok"), "ben_tok", "doc_tok", rnd="overlap"))
def ngram_overlap(spark, sf):
    """The flagship: how much of each benchmark item the corpus holds."""
    return ngram.overlap(ben_tok(spark, sf), doc_tok(spark, sf), 13)


@query(sql(OVERLAP.format(g=G13, c="doc_tok"), "ben_tok", "doc_tok", rnd="overlap"))
def stored_index_overlap(spark, sf):
    """The same from an index that is written once, bucketed and sorted by hash."""
    name = f"grams_{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select(F.lit("docs").alias("corpus"), "text")
    index = io.write_bucketed_index(docs, T.tokenize_words(F.col("text")), [13], name, io.scratch(spark, name), io.buckets_for(docs))
    return ngram.stored_overlap(ben_tok(spark, sf), index)


@query(sql(OVERLAP.format(g=G13, c="(SELECT t FROM doc_tok JOIN labels USING (doc_id) WHERE quality = 1)"), "ben_tok", "doc_tok", rnd="overlap"))
def self_ngram_overlap(spark, sf):
    """Against an index of the positives alone."""
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return ngram.overlap(ben_tok(spark, sf), doc_tok(spark, sf).join(good, "doc_id"), 13)


@query(sql(f"""SELECT lang, doc_id, coalesce(s.n, 0) AS size, round(coalesce(best, 0.0::DOUBLE), 6) AS best FROM doc_tok LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY 1) s USING (doc_id)
    LEFT JOIN (SELECT a AS doc_id, max(i / least(x.n, y.n)) AS best FROM (SELECT a.lang, a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.lang = b.lang AND a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3)
    JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY 1) x ON x.doc_id = a JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY 1) y ON y.doc_id = b GROUP BY 1) USING (doc_id)""", "doc_tok").replace(") SELECT lang", f"), g AS (SELECT DISTINCT lang, doc_id, unnest({G13}) AS g FROM doc_tok) SELECT lang", 1))
def canary_overlap(spark, sf):
    out = ngram.canary(doc_tok(spark, sf), 13, "doc_id", "lang")
    return out


@query(sql("SELECT a.model, a.benchmark, a.item_id, p, correct FROM (SELECT model, benchmark, item_id, p FROM audit WHERE stratum <> 1) a JOIN (SELECT model, benchmark, item_id, correct FROM audit WHERE stratum <> 2) b USING (model, benchmark, item_id)", "audit", rnd="p"))
def align_by_item(spark, sf):
    a = audit(spark, sf)
    return C.align_by_item(a.where("stratum <> 1").select("model", "benchmark", "item_id", "p"), a.where("stratum <> 2").select("model", "benchmark", "item_id", "correct"))


ITEMS = "SELECT doc_id AS item_id, source, text FROM documents"
POS = "SELECT DISTINCT text FROM documents JOIN labels USING (doc_id) WHERE quality = 1"


def _items(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "source", "text")
    pos = d.join(table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("item_id")), "item_id")
    return d, pos


@query(f"SELECT item_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('n2|' || item_id), item_id) AS r FROM ({ITEMS}) WHERE text NOT IN ({POS})) WHERE r <= 20")
def same_source_negatives(spark, sf):
    d, pos = _items(spark, sf)
    return K.same_source_negatives(d, pos, 20, "source", "n2").select("item_id", "source")


@query(f"SELECT item_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('n1|' || item_id), item_id) AS r FROM ({ITEMS}) WHERE text NOT IN ({POS})) WHERE r <= 12 ORDER BY md5('n1|' || item_id), item_id LIMIT 150")
def cross_source_negatives(spark, sf):
    d, pos = _items(spark, sf)
    return K.cross_source_negatives(d, pos, 150, "source", "n1", 12).select("item_id", "source")


@query(f"SELECT item_id, source FROM ({ITEMS}) WHERE text NOT IN ({POS}) ORDER BY md5('n3|' || item_id), item_id LIMIT (SELECT greatest(200, count(*) // 2) FROM labels WHERE quality = 0)")
def balanced_negatives(spark, sf):
    d, pos = _items(spark, sf)
    n = max(200, table(spark, sf, "labels").where("quality = 0").count() // 2)
    return K.cross_source_negatives(d, pos, n, "source", "n3").select("item_id", "source")


@query(sql("""SELECT variant, row_id, match, abs(v - w) AS distance FROM (SELECT p.variant, p.row_id, p.n_chars AS v, n.row_id AS match, n.n_chars AS w, row_number() OVER (PARTITION BY p.row_id ORDER BY abs(p.n_chars - n.n_chars), n.row_id) AS r
    FROM calib p JOIN calib n ON p.variant = n.variant AND p.label = 1 AND n.label = 0) WHERE r = 1""", "calib", rnd="distance"))
def nearest_match(spark, sf):
    c = calib(spark, sf)
    return peers.nearest_match(c.where("label = 1"), c.where("label = 0"), "n_chars", "row_id", ["variant"])


PEERS = """SELECT model, peer, diff, rank FROM (SELECT a.model, b.model AS peer, abs(a.acc - b.acc) AS diff, row_number() OVER (PARTITION BY a.model ORDER BY abs(a.acc - b.acc), b.model) AS rank, count(*) OVER (PARTITION BY a.model) AS n
    FROM models a JOIN models b ON a.family <> b.family AND round(abs(a.acc - b.acc), 9) <= 0.15) WHERE rank <= 7 AND n >= 3"""


@query(sql(PEERS, "models", rnd="diff"))
def capability_peers(spark, sf):
    return peers.capability_peers(models(spark, sf))


@query(sql("SELECT model, peer, rank FROM (SELECT a.model, b.model AS peer, row_number() OVER (PARTITION BY a.model ORDER BY abs(a.acc - b.acc), b.model) AS rank FROM models a JOIN models b ON a.family <> b.family) WHERE rank <= 3", "models"))
def knn_peers(spark, sf):
    return peers.capability_peers(models(spark, sf), 3, None, 1).select("model", "peer", "rank")


DELTA = f"""SELECT m.model, m.item_id, m.loss - t.l AS delta FROM matrix m JOIN (SELECT p.model, x.item_id, avg(x.loss) AS l FROM ({PEERS}) p JOIN matrix x ON x.model = p.peer JOIN (SELECT model, count(*) AS k FROM ({PEERS}) GROUP BY 1) s ON s.model = p.model
    GROUP BY p.model, x.item_id, s.k HAVING count(*) = s.k) t ON t.model = m.model AND t.item_id = m.item_id"""


def _delta(spark, sf, outcomes=None):
    m = io.stored(matrix(spark, sf)) if outcomes is None else outcomes
    return peers.peer_delta(m, peers.capability_peers(io.stored(models(spark, sf, m))))


@query(sql(DELTA, "models", rnd="delta"))
def peer_delta(spark, sf):
    return _delta(spark, sf).select("model", "item_id", "delta")


@query(sql("SELECT q.vec_id, greatest(0, max(list_dot_product(q.e, c.e))) AS best FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0) q LEFT JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) c ON c.vec_id <> q.vec_id GROUP BY 1", rnd="best"))
def max_cosine(spark, sf):
    """A stated query set, every twentieth vector, against all vectors but itself."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return checks.max_cosine(e.where("vec_id % 20 = 0"), e)


@query(sql("SELECT item_id, count(*) AS n_models, sum(loss) AS total FROM matrix GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT model) FROM matrix)", "matrix", rnd="total"))
def common_items(spark, sf):
    m = matrix(spark, sf)
    every = m.select("model").distinct().agg(F.count(F.lit(1)).alias("k"))
    return m.groupBy("item_id").agg(F.count_distinct("model").alias("n_models"), F.sum("loss").alias("total")).join(F.broadcast(every), F.col("n_models") == F.col("k")).drop("k")


@query(sql("SELECT model, benchmark, a.gap AS v2, b.gap AS v1, a.gap - b.gap AS diff FROM cells a JOIN cells1 b USING (model, benchmark)", "cells", "cells1", rnd="v2 v1 diff"))
def paired_versions(spark, sf):
    a = audit(spark, sf)
    both = C.gap(a, C.CELL).select(*C.CELL, F.col("gap").alias("v2")).join(C.gap(a.withColumn("p", F.col("p1")), C.CELL).select(*C.CELL, F.col("gap").alias("v1")), C.CELL)
    return both.withColumn("diff", F.col("v2") - F.col("v1"))


@query(sql("SELECT a.item_id, b.loss - a.loss AS delta, 1 / (1 + exp(-(0.3 * a.loss - 0.7 * (b.loss - a.loss) + 0.1))) AS p FROM matrix a JOIN matrix b USING (item_id) WHERE a.model = 'm2' AND b.model = 'm5'", "matrix", rnd="delta p"))
def swap_reference(spark, sf):
    """Rescores one model's items with another reference and fixed weights."""
    m = matrix(spark, sf)
    both = m.where("model = 'm2'").select("item_id", "loss").join(m.where("model = 'm5'").select("item_id", F.col("loss").alias("ref")), "item_id").withColumn("delta", F.col("ref") - F.col("loss"))
    model = {"features": {"loss": (0.0, 1.0, 0.3), "delta": (0.0, 1.0, -0.7)}, "intercept": 0.1}
    return both.select("item_id", "delta", K.score(model).alias("p"))


@query(sql("SELECT model, benchmark, detector, avg(correct) FILTER (s > m) - avg(correct) FILTER (s <= m) AS diff FROM (SELECT *, median(s) OVER (PARTITION BY model, benchmark, detector) AS m FROM (SELECT model, benchmark, correct, 'p' AS detector, p AS s FROM audit UNION ALL SELECT model, benchmark, correct, 'p1', p1 FROM audit UNION ALL SELECT model, benchmark, correct, 'loss', loss FROM audit)) GROUP BY 1, 2, 3", "audit", rnd="diff"))
def detector_join(spark, sf):
    """Detectors of a cell in long form, each split at its own median."""
    a = audit(spark, sf)
    scores = K.long_form(a, ["p", "p1", "loss"], ["model", "benchmark", "item_id"])
    rows = scores.join(a.select("model", "benchmark", "item_id", "correct"), ["model", "benchmark", "item_id"])
    r = with_quantiles(rows, "score", ["model", "benchmark", "detector"], {"m": 0.5})
    acc = lambda cond: F.avg(F.when(cond, F.col("correct")))
    return r.groupBy("model", "benchmark", "detector").agg((acc(F.col("score") > F.col("m")) - acc(F.col("score") <= F.col("m"))).alias("diff"))


@query(sql("SELECT k, tail, count(*) AS n_rows, avg(correct) AS acc FROM audit, (SELECT unnest([3, 5, 7]) AS k), (SELECT unnest([0.1, 0.2]) AS tail) WHERE p <= tail * k / 3.0 GROUP BY 1, 2", "audit", rnd="tail acc"))
def param_grid(spark, sf):
    """Every setting of a grid over all rows; the grid is a constant of six rows."""
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in (3, 5, 7)])).alias("k")).select("k", F.explode(F.array(F.lit(0.1), F.lit(0.2))).alias("tail"))
    a = audit(spark, sf).crossJoin(F.broadcast(grid)).where(F.col("p") <= F.col("tail") * F.col("k") / 3.0)
    return a.groupBy("k", "tail").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("correct").alias("acc"))


@query("SELECT doc_id, quality, text FROM labels JOIN documents USING (doc_id)")
def item_text_lookup(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("doc_id", "quality", "text")


@query(sql("SELECT 'v2' AS ensemble, model, benchmark, gap FROM cells UNION ALL SELECT 'v1', model, benchmark, gap FROM cells1", "cells", "cells1", rnd="gap"))
def union_versions(spark, sf):
    a = audit(spark, sf)
    one = lambda df, v: C.gap(df, C.CELL).select(F.lit(v).alias("ensemble"), *C.CELL, "gap")
    return one(a, "v2").unionByName(one(a.withColumn("p", F.col("p1")), "v1"))


@query(sql(f"SELECT lang, count(DISTINCT g) AS n FROM (SELECT lang, unnest({G13}) AS g FROM doc_tok) GROUP BY 1", "doc_tok"))
def distinct_ngrams(spark, sf):
    return ngram.exploded(doc_tok(spark, sf), F.col("t"), 13, ["lang"]).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT item_id FROM matrix GROUP BY 1 HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM matrix)", "matrix"))
def intersect_items(spark, sf):
    """Items of all models: intersections in a chain over the model names, which are few."""
    m = matrix(spark, sf)
    names = sorted(r["model"] for r in m.select("model").distinct().collect())
    return reduce(lambda a, b: a.intersect(b), [m.where(F.col("model") == x).select("item_id") for x in names])


@query(f"SELECT item_id FROM ({ITEMS}) WHERE text NOT IN ({POS})")
def except_positives(spark, sf):
    """An anti join, which keeps repeated candidates."""
    d, pos = _items(spark, sf)
    return d.join(pos.select("text").distinct(), "text", "left_anti").select("item_id")


@query("SELECT 'benchmark' AS benchmark, item_id, text FROM benchmark UNION ALL SELECT 'pages', page_id, url FROM pages UNION ALL SELECT 'turns', conv_id * 100 + turn, text FROM conversations")
def pool_benchmarks(spark, sf):
    t = lambda n: table(spark, sf, n)
    a = t("benchmark").select(F.lit("benchmark").alias("benchmark"), "item_id", "text")
    b = t("pages").select(F.lit("pages").alias("benchmark"), F.col("page_id").alias("item_id"), F.col("url").alias("text"))
    return a.unionByName(b).unionByName(t("conversations").select(F.lit("turns").alias("benchmark"), (F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), "text"))


LM = """lm AS (SELECT source, tok, count(*) AS c FROM (SELECT source, unnest(t) AS tok FROM doc_tok) GROUP BY 1, 2), tot AS (SELECT source, sum(c) AS n, (SELECT count(DISTINCT tok) FROM lm) AS v FROM lm GROUP BY 1),
    lp AS (SELECT tot.source, i.item_id, i.pos, ln((coalesce(c, 0) + 1) / (n + v)) AS lp FROM (SELECT item_id, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos FROM ben_tok) i CROSS JOIN tot LEFT JOIN lm ON lm.source = tot.source AND lm.tok = i.tok)"""


def lm_sql(body: str, rnd: str) -> str:
    base = sql("@", "doc_tok", "ben_tok")
    head = base.rsplit(" @", 1)[0] + ", " + LM + " "
    return f"{head}SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in rnd.split())}) FROM ({body})"


def _lps(spark, sf):
    model = io.stored(lm.unigram_lm(doc_tok(spark, sf)))
    return lm.token_logprobs(ben_tok(spark, sf), model), model


@query(lm_sql("SELECT source, tok, c, ln((c + 1) / (n + v)) AS lp FROM lm JOIN tot USING (source)", "lp"))
def unigram_lm(spark, sf):
    return lm.unigram_lm(doc_tok(spark, sf)).select("source", "tok", "c", lm.logprob(F.col("c"), F.col("n"), F.col("v")).alias("lp"))


@query(lm_sql("SELECT source, item_id, pos, lp FROM lp", "lp"))
def token_logprobs(spark, sf):
    return _lps(spark, sf)[0]


@query(lm_sql("SELECT source, (sum(ln((c + 1) / (n + v))) + (v - count(*)) * ln(1 / (n + v))) / v AS mu, sqrt((sum(ln((c + 1) / (n + v)) ** 2) + (v - count(*)) * ln(1 / (n + v)) ** 2 - (sum(ln((c + 1) / (n + v))) + (v - count(*)) * ln(1 / (n + v))) ** 2 / v) / (v - 1)) AS sigma FROM lm JOIN tot USING (source) GROUP BY source, n, v", "mu sigma"))
def vocab_moments(spark, sf):
    return lm.vocab_moments(lm.unigram_lm(doc_tok(spark, sf)))


@query(lm_sql("SELECT source, item_id, count(*) AS n, -avg(lp) AS loss FROM lp GROUP BY 1, 2 HAVING count(*) >= 2", "loss"))
def loss_matrix(spark, sf):
    return lm.item_loss(_lps(spark, sf)[0], ["source", "item_id"])


@query(lm_sql("SELECT item_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN -avg(lp) END AS loss FROM lp GROUP BY 1", "loss"))
def item_loss(spark, sf):
    return lm.item_loss(_lps(spark, sf)[0], ["item_id"])


@query(lm_sql("SELECT source, item_id, -avg(lp) AS span_loss FROM (SELECT *, max(pos) OVER (PARTITION BY source, item_id) AS n FROM lp) WHERE pos > n - 10 GROUP BY 1, 2", "span_loss"))
def span_loss(spark, sf):
    return lm.span_loss(_lps(spark, sf)[0], ["source", "item_id"], 10)


MINK = "(SELECT *, row_number() OVER (PARTITION BY source, item_id ORDER BY {v}, pos) AS r, count(*) OVER (PARTITION BY source, item_id) AS n FROM {t})"


@query(lm_sql("SELECT source, item_id, " + ", ".join(f"-avg(lp) FILTER (r <= greatest(1, n * {p} // 100)) AS mink_{p}" for p in (5, 10, 20, 30, 50)) + f" FROM {MINK.format(v='lp', t='lp')} GROUP BY 1, 2", "mink_5 mink_10 mink_20 mink_30 mink_50"))
def min_k(spark, sf):
    return lm.min_k(_lps(spark, sf)[0], ["source", "item_id"])


MOM = "(SELECT source, (sum(ln((c + 1) / (n + v))) + (v - count(*)) * ln(1 / (n + v))) / v AS mu, sqrt((sum(ln((c + 1) / (n + v)) ** 2) + (v - count(*)) * ln(1 / (n + v)) ** 2 - (sum(ln((c + 1) / (n + v))) + (v - count(*)) * ln(1 / (n + v))) ** 2 / v) / (v - 1)) AS sigma FROM lm JOIN tot USING (source) GROUP BY source, n, v)"


@query(lm_sql("SELECT source, item_id, avg(z) FILTER (r <= greatest(1, n * 20 // 100)) AS minkpp FROM " + MINK.format(v="z", t=f"(SELECT lp.*, (lp - mu) / sigma AS z FROM lp JOIN {MOM} USING (source))") + " GROUP BY 1, 2", "minkpp"))
def min_k_plus(spark, sf):
    lps, model = _lps(spark, sf)
    return lm.min_k_plus(lps, lm.vocab_moments(model), ["source", "item_id"])


CHANGED = r"""b AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text || ' 12 and 34' ELSE text END AS t FROM benchmark), n AS (SELECT item_id, t, regexp_extract_all(t, '[0-9]+') AS f, string_split_regex(t, '[0-9]+') AS g FROM b),
    d AS (SELECT item_id, t, f, g, list_transform(range(0, len(f)), lambda i: ('0x' || substr(md5(item_id || '|' || i), 1, 8))::BIGINT % 99 + 2) AS r FROM n),
    e AS (SELECT item_id, t, len(f) AS c, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(CASE WHEN i > 5 THEN f[i] WHEN r[i]::VARCHAR = f[i] THEN CASE WHEN r[i] = 100 THEN '2' ELSE (r[i] + 1)::VARCHAR END ELSE r[i]::VARCHAR END, '')), '') AS u FROM d),
    w AS (SELECT item_id, c, k, unnest(tok) AS tok FROM (SELECT item_id, c, 0 AS k, {own} AS tok FROM e UNION ALL SELECT item_id, c, 1, {other} FROM e)),
    z AS (SELECT tot.source, w.item_id, w.c, -avg(ln((coalesce(lm.c, 0) + 1) / (n + v))) FILTER (k = 0) AS own, -avg(ln((coalesce(lm.c, 0) + 1) / (n + v))) FILTER (k = 1) AS other, count(*) FILTER (k = 0) AS n0 FROM w CROSS JOIN tot LEFT JOIN lm ON lm.source = tot.source AND lm.tok = w.tok GROUP BY 1, 2, 3)"""


@query(lm_sql("SELECT source, item_id, least(c, 5)::BIGINT AS n_changed, CASE WHEN c = 0 THEN 0.0::DOUBLE WHEN n0 >= 2 THEN other - own END AS delta FROM z", "delta").replace(") SELECT * REPLACE", "), " + CHANGED.format(own=WORDS_SQL.format("t"), other=WORDS_SQL.format("u")) + " SELECT * REPLACE", 1))
def counterfactual_delta(spark, sf):
    """Loss of an item with other numbers in it minus its own; items without numbers have delta 0."""
    docs = doc_tok(spark, sf)
    model = io.stored(lm.unigram_lm(docs))
    b = table(spark, sf, "benchmark").withColumn("text", F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(" 12 and 34"))).otherwise(F.col("text")))
    new, n = T.perturb_numbers(F.col("text"), F.col("item_id"))
    loss = lambda text, name: lm.item_loss(lm.token_logprobs(b.select("item_id", T.tokenize_words(text).alias("t")), model), ["source", "item_id"]).select("source", "item_id", F.col("loss").alias(name))
    both = loss(F.col("text"), "own").join(loss(new, "other"), ["source", "item_id"])
    return both.join(b.select("item_id", n.alias("n_changed")), "item_id").select("source", "item_id", "n_changed", F.when(F.col("n_changed") == 0, 0.0).otherwise(F.col("other") - F.col("own")).alias("delta"))


@query(sql(f"""SELECT source, item_id, coalesce(hit = n, false)::BIGINT AS reproduced FROM (SELECT DISTINCT source FROM doc_tok) CROSS JOIN ben_tok LEFT JOIN (SELECT i.item_id, s.source, count(*) AS hit FROM (SELECT item_id, unnest({G5}) AS g FROM (SELECT item_id, t[len(t) // 2 + 1 :] AS t FROM ben_tok)) i
    JOIN (SELECT DISTINCT source, unnest({G5}) AS g FROM doc_tok) s USING (g) GROUP BY 1, 2) USING (source, item_id) LEFT JOIN (SELECT item_id, greatest(len(t) - len(t) // 2 - 4, 0) AS n FROM ben_tok) USING (item_id)""", "ben_tok", "doc_tok"))
def suffix_reproduction(spark, sf):
    return ngram.suffix_reproduction(ben_tok(spark, sf), doc_tok(spark, sf))


@query(sql(f"SELECT count(DISTINCT g)::BIGINT AS n_hashes FROM (SELECT unnest({G13}) AS g FROM doc_tok)", "doc_tok"))
def stream_index(spark, sf):
    """The index as a stream builds it from files, a third of them a trigger and each trigger over all cores; it holds what a
    batch over all would hold."""
    from ..streaming.index import stream_index as build

    src, idx, ckpt = (io.scratch(spark, x) for x in ("docs", "index", "ckpt"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    a_trigger = max(spark.sparkContext.defaultParallelism, -(-docs.rdd.getNumPartitions() // 3))
    docs.repartition(3 * a_trigger, "doc_id").write.parquet(src)
    build(spark, src, docs.schema, idx, ckpt, files=a_trigger)
    return spark.read.schema("h long").parquet(idx).agg(F.count_distinct("h").alias("n_hashes"))


@query(sql(OVERLAP.format(g=G13, c="doc_tok"), "ben_tok", "doc_tok", rnd="overlap"))
def stream_overlap(spark, sf):
    """Items scored as they arrive, against a static index."""
    from ..streaming.index import stream_overlap as run

    src, sink, ckpt = (io.scratch(spark, x) for x in ("items", "hits", "ckpt"))
    items = table(spark, sf, "benchmark").select("item_id", "text")
    items.write.parquet(src)
    index = ngram.exploded(doc_tok(spark, sf), F.col("t"), 13, []).distinct()
    run(spark, src, items.schema, index, sink, ckpt)
    got = spark.read.schema("item_id long, h long, hit int").parquet(sink).groupBy("item_id").agg(F.avg(F.col("hit").cast("double")).alias("o"))
    return items.join(got, "item_id", "left").select("item_id", F.coalesce("o", F.lit(0.0)).alias("overlap"))
