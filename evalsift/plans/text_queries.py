"""Queries over sources, sinks and text columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import grade as G
from ..functions import stats as S
from ..functions import text as T
from ..operators import cells as C
from ..sources import io
from ..sources.io import table
from ..sources.versioned import VersionedTable
from .base import NGRAMS_SQL, audit, ben_tok, calib, doc_tok, query, sql



@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS item_idx, item_id, text FROM benchmark")
def scan_items(spark, sf):
    """Items as JSON lines under an explicit schema, numbered."""
    path = io.scratch(spark, "items")
    table(spark, sf, "benchmark").select("item_id", "text").write.json(path)
    return io.scan_items(io.scan_jsonl(spark, path, "item_id long, text string"))


@query(sql("SELECT corpus, doc_id, len(t)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY doc_id) AS r FROM (SELECT 'docs_' || lang AS corpus, doc_id, t FROM doc_tok WHERE lang IN ('en', 'de', 'fr', 'es') AND len(t) >= 13)) WHERE r <= 200", "doc_tok"))
def scan_corpus(spark, sf):
    docs = table(spark, sf, "documents")
    tok = T.tokenize_words(F.col("text"))
    out = io.scan_corpora({f"docs_{x}": docs.where(F.col("lang") == x) for x in ("en", "de", "fr", "es")}, tok, 13, 200)
    return out.select("corpus", "doc_id", F.size(tok).alias("n"))


@query(sql("SELECT model, benchmark, item_id AS item_idx, p FROM audit WHERE benchmark = '1-URGENT'", "audit", rnd="p"))
def load_scores(spark, sf):
    rec = audit(spark, sf).groupBy("model", F.floor(F.col("item_id") / 4096).alias("part")).agg(F.collect_list(F.struct("benchmark", "item_id", "p")).alias("z"))
    return io.load_scores(rec.select("model", F.col("z.benchmark").alias("benchmarks"), F.col("z.item_id").alias("idx"), F.col("z.p").alias("p")), "1-URGENT")


@query(sql("SELECT model, benchmark, item_id, p FROM audit", "audit", rnd="p"))
def scan_partitioned(spark, sf):
    return io.roundtrip_partitioned(audit(spark, sf).select("model", "benchmark", "item_id", "p"), ["model"], io.scratch(spark, "scores"))


@query(sql("SELECT item_id, coalesce(max(loss) FILTER (stratum = 3), max(loss) FILTER (stratum = 2), max(loss) FILTER (stratum = 1), max(loss) FILTER (stratum = 0)) AS loss FROM (SELECT item_id // 16 AS item_id, stratum, max(loss) AS loss FROM audit GROUP BY 1, 2) GROUP BY item_id", "audit", rnd="loss"))
def layered_lookup(spark, sf):
    """Four layers over groups of neighbouring items; the last layer that has a group wins."""
    a = audit(spark, sf).groupBy(F.floor(F.col("item_id") / 16).alias("item_id"), "stratum").agg(F.max("loss").alias("loss"))
    return io.layered_lookup([a.where(F.col("stratum") == i).select("item_id", "loss") for i in range(4)], ["item_id"])


@query(sql("SELECT model, benchmark, n_clean, n_contam, gap FROM cells", "cells", rnd="gap"))
def csv_roundtrip(spark, sf):
    return io.roundtrip_csv(C.gap(audit(spark, sf), C.CELL).select("model", "benchmark", "n_clean", "n_contam", "gap"), io.scratch(spark, "cells"))


@query(sql("SELECT model, benchmark, n_items, round(p_mean, 6) AS p_mean, round(p_p90, 6) AS p_p90, round(high_risk_rate, 6) AS high_risk_rate FROM (SELECT model, benchmark, count(*) AS n_items, avg(p) AS p_mean, quantile_cont(p, 0.9) AS p_p90, avg((p > 0.5)::INT) AS high_risk_rate FROM audit GROUP BY 1, 2)", "audit"))
def summary_json(spark, sf):
    """A JSON object by benchmark for each model, and what a reader finds in it."""
    s = io.summary_json(C.audit_summary(audit(spark, sf)).select("model", "benchmark", "n_items", "p_mean", "p_p90", "high_risk_rate"), "benchmark", "model")
    found = F.from_json("summary", "map<string, struct<n_items: bigint, p_mean: double, p_p90: double, high_risk_rate: double>>")
    return s.select("model", F.explode(found).alias("benchmark", "v")).select("model", "benchmark", "v.*")


@query(sql("SELECT corpus, n, docs, tokens, ngrams FROM (SELECT lang AS corpus, n, count(DISTINCT g) AS ngrams FROM (SELECT lang, 8::BIGINT AS n, unnest(" + NGRAMS_SQL.format(t="t", n=8) + ") AS g FROM doc_tok UNION ALL SELECT lang, 13, unnest(" + NGRAMS_SQL.format(t="t", n=13) + ") FROM doc_tok) GROUP BY 1, 2) JOIN (SELECT lang AS corpus, count(*) AS docs, sum(len(t))::BIGINT AS tokens FROM doc_tok GROUP BY 1) USING (corpus)", "doc_tok"))
def write_index(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("corpus"), "doc_id", "text")
    return io.write_index(docs, T.tokenize_words(F.col("text")), [8, 13], io.scratch(spark, "index"))


@query(sql("SELECT item_id, coalesce(max(p) FILTER (stratum = 3), max(p) FILTER (stratum < 3)) AS p FROM (SELECT item_id // 16 AS item_id, stratum, p FROM audit) GROUP BY 1", "audit", rnd="p"))
def upsert_results(spark, sf):
    """New results (the last stratum) over old ones (all others), by groups of neighbouring items: two commits of a stored
    table, the second rewriting the buckets it touches."""
    a = audit(spark, sf).select(F.floor(F.col("item_id") / 16).alias("item_id"), "stratum", "p")
    of = lambda c: a.where(c).groupBy("item_id").agg(F.max("p").alias("p"))
    results = VersionedTable(spark, io.scratch(spark, "results"), ["item_id"], 16)
    results.merge(of("stratum < 3"), "first")
    results.merge(of("stratum = 3"), "second")
    return results.read()


@query(sql("SELECT text, quality AS label FROM documents JOIN labels USING (doc_id)"))
def labelled_texts(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("text", F.col("quality").alias("label"))
    return io.roundtrip_json(df, io.scratch(spark, "labelled"))


@query(sql("SELECT model, benchmark, item_id, p, loss FROM audit", "audit", rnd="p loss"))
def export_scores(spark, sf):
    return io.roundtrip_partitioned(audit(spark, sf).select("model", "benchmark", "item_id", "p", "loss"), ["benchmark"], io.scratch(spark, "export"))


@query(sql("SELECT doc_id, t FROM doc_tok", "doc_tok"))
def tokenize_words(spark, sf):
    return doc_tok(spark, sf).select("doc_id", "t")


@query(sql(r"SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS t FROM documents"))
def tokenize_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tokenize_ws(F.col("text")).alias("t"))


@query(sql("SELECT item_id, g FROM (SELECT item_id, unnest(" + NGRAMS_SQL.format(t="t", n=13) + ") AS g FROM ben_tok)", "ben_tok"))
def ngrams(spark, sf):
    return ben_tok(spark, sf).select("item_id", F.explode(T.ngrams(F.col("t"), 13)).alias("g"))


@query(sql("SELECT doc_id, len(t[1:2000])::BIGINT AS n, array_to_string(t[1:13], ' ') AS head FROM doc_tok WHERE len(t) >= 13", "doc_tok"))
def cap_tokens(spark, sf):
    capped = F.slice(F.col("t"), 1, 2000)
    return doc_tok(spark, sf).where(F.size("t") >= 13).select("doc_id", F.size(capped).alias("n"), F.concat_ws(" ", F.slice(capped, 1, 13)).alias("head"))


@query(sql("SELECT count(*)::BIGINT AS n_grams, count(DISTINCT g)::BIGINT AS n_hashes FROM (SELECT unnest(" + NGRAMS_SQL.format(t="t", n=13) + ") AS g FROM doc_tok)", "doc_tok"))
def hash_ngram(spark, sf):
    """Equal hashes stand for equal n-grams: as many distinct hashes as strings."""
    h = doc_tok(spark, sf).select(F.explode(T.ngram_hashes(F.col("t"), 13)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    return h.agg(F.sum("c").alias("n_grams"), F.count(F.lit(1)).alias("n_hashes"))


BENCHMARKS = ("gsm8k_test", "mmlu_test", "hellaswag_val", "arc_challenge", "humaneval", "mbpp", "math", "math500", "truthfulqa_mc", "bbh", "agieval", "aime2024", "livecodebench", "unknown")
ITEM_SQL = f"""SELECT *, page_id % len(choices) AS label, list_transform(range(0, len(choices)), lambda i: (i = page_id % len(choices))::INT::VARCHAR) AS marks, list_transform(range(1, len(choices) + 1), lambda i: i::VARCHAR) AS numbers
    FROM (SELECT page_id, {list(BENCHMARKS)}[page_id % {len(BENCHMARKS)} + 1] AS benchmark, url AS question, 'a' || page_id AS answer, 's' || page_id % 7 AS subject, string_split(url, '/') AS choices, substr(url, 1, 9) AS context, substr(html, 1, 60) AS solution FROM pages)"""


def rendered(spark, sf):
    """Pages as items of every benchmark in turn, and of one that has no template."""
    b = F.element_at(F.array(*[F.lit(x) for x in BENCHMARKS]), (F.col("page_id") % len(BENCHMARKS) + 1).cast("int"))
    n = F.size("choices")
    marks = F.transform("choices", lambda _, i: (i == F.col("page_id") % n).cast("int").cast("string"))
    numbers = F.transform("choices", lambda _, i: (i + 1).cast("string"))
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    p = table(spark, sf, "pages").withColumn("choices", F.split("url", "/"))
    return p.select("page_id", b.alias("benchmark"), F.col("url").alias("question"), text("a", F.col("page_id")).alias("answer"), text("s", F.col("page_id") % 7).alias("subject"), "choices", F.when(b == "truthfulqa_mc", marks).otherwise(numbers).alias("labels"), (F.col("page_id") % n).cast("int").alias("label"), F.substring("url", 1, 9).alias("context"), F.substring("html", 1, 60).alias("solution"))


@query(f"""SELECT page_id, CASE WHEN benchmark = 'gsm8k_test' THEN concat('Question: ', question, chr(10), 'Answer: ', answer)
    WHEN benchmark = 'mmlu_test' THEN concat('Subject: ', subject, chr(10), 'Question: ', question, chr(10), array_to_string(list_transform(range(1, len(choices) + 1), lambda i: chr((64 + i)::INT) || '. ' || choices[i]), chr(10)), chr(10), 'Answer: ', chr((65 + label)::INT))
    WHEN benchmark = 'hellaswag_val' THEN concat('Context: ', context, chr(10), 'Continuation: ', choices[label + 1])
    WHEN benchmark = 'arc_challenge' THEN concat('Question: ', question, chr(10), array_to_string(list_transform(range(1, len(choices) + 1), lambda i: numbers[i] || '. ' || choices[i]), chr(10)), chr(10), 'Answer: ', answer)
    WHEN benchmark = 'humaneval' THEN concat(question, solution) WHEN benchmark IN ('mbpp', 'livecodebench') THEN concat(question, chr(10), solution) WHEN benchmark IN ('math', 'math500') THEN concat('Problem: ', question, chr(10), 'Solution: ', solution)
    WHEN benchmark = 'truthfulqa_mc' THEN concat('Question: ', question, chr(10), array_to_string(list_transform(range(1, len(choices) + 1), lambda i: choices[i] || ' (' || marks[i] || ')'), chr(10)))
    WHEN benchmark IN ('bbh', 'agieval') THEN concat(question, chr(10), 'Answer: ', answer) WHEN benchmark = 'aime2024' THEN concat('Problem: ', question, chr(10), 'Answer: ', answer)
    ELSE concat('{{"question":"', question, '","answer":"', answer, '"}}') END AS text FROM ({ITEM_SQL})""")
def render_item(spark, sf):
    whole = F.to_json(F.struct("question", "answer"))
    return rendered(spark, sf).select("page_id", G.render_item(F.col("benchmark"), whole).alias("text"))


@query(f"SELECT page_id, array_to_string(list_transform(range(1, len(choices) + 1), lambda i: chr((64 + i)::INT) || '. ' || choices[i]), chr(10)) AS options FROM ({ITEM_SQL})")
def mc_options(spark, sf):
    return rendered(spark, sf).select("page_id", G.mc_options(F.col("choices")).alias("options"))


NUM_SQL = r"regexp_extract_all({}, '-?\d[\d,]*\.?\d*')"


@query(f"SELECT doc_id, replace({NUM_SQL.format('text')}[-1], ',', '') AS number FROM documents")
def last_number(spark, sf):
    return table(spark, sf, "documents").select("doc_id", G.last_number(F.col("text")).alias("number"))


@query(r"""SELECT conv_id, turn, CASE WHEN contains(a, '####') THEN replace(regexp_extract(string_split(a, '####')[-1], '-?\d[\d,]*\.?\d*'), ',', '') ELSE '' END AS gold FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || ' #### ' || (conv_id * 1234 + turn) || ' units' ELSE text END AS a FROM conversations)""")
def gold_number(spark, sf):
    a = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" #### "), (F.col("conv_id") * 1234 + F.col("turn")).cast("string"), F.lit(" units"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", G.gold_number(a).alias("gold"))


@query("SELECT conv_id, turn, coalesce((left(upper(trim(text)), 1) = substr('ABCDT', (conv_id % 5 + 1)::INT, 1))::BIGINT, 0) AS hit FROM conversations")
def letter_match(spark, sf):
    gold = F.substring(F.lit("ABCDT"), (F.col("conv_id") % 5 + 1).cast("int"), F.lit(1))
    return table(spark, sf, "conversations").select("conv_id", "turn", G.letter_match(F.col("text"), gold).alias("hit"))


@query("SELECT a.doc_id, coalesce((lower(left(trim(a.text), 30)) = lower(left(trim(b.text), 30)) AND length(lower(left(trim(b.text), 30))) > 5)::BIGINT, 0) AS hit FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2")
def prefix_match(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    half = d.select(F.col("doc_id").alias("h"), F.col("text").alias("gold"))
    return d.join(half, F.floor(F.col("doc_id") / 2) == F.col("h")).select("doc_id", G.prefix_match(F.col("text"), F.col("gold")).alias("hit"))


@query("SELECT vec_id, CASE WHEN list_position(l, 1) > 0 THEN chr((64 + list_position(l, 1))::INT) ELSE '?' END AS gold FROM (SELECT vec_id, list_transform(range(0, 6), lambda i: (i = label)::INT) AS l FROM embeddings)")
def mc1_gold(spark, sf):
    labels = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (i == F.col("label")).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", G.mc1_gold(labels).alias("gold"))




@query(r"""SELECT item, CASE item % 4 WHEN 0 THEN (abs(item / 4 - q) <= 1e-4)::BIGINT WHEN 3 THEN 0 ELSE (item = q)::BIGINT END AS hit FROM (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey / 4 ELSE o_orderkey END AS q FROM orders)""")
def grade_numeric(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"))
    s = F.col("item").cast("string")
    pred = F.when(F.col("item") % 4 == 0, F.concat(F.lit("so \\boxed{\\frac{"), s, F.lit("}{4}} ok"))).when(F.col("item") % 4 == 1, F.concat(F.lit("ans "), s)).when(F.col("item") % 4 == 2, F.concat(F.lit("x \\boxed{"), s, F.lit("}"))).otherwise("none")
    gold = F.when(F.col("item") % 3 == 0, (F.col("item") / 4).cast("string")).otherwise(s)
    return o.select("item", G.grade_numeric(pred, gold).alias("hit"))


@query(r"SELECT doc_id, steps, CASE WHEN steps <= 2 THEN '<=2' WHEN steps <= 4 THEN '3-4' WHEN steps <= 6 THEN '5-6' ELSE '7+' END AS bin FROM (SELECT doc_id, len(regexp_extract_all(a, '<<[^>]*>>'))::BIGINT AS steps FROM (SELECT doc_id, repeat('<<1+1=2>> ', (doc_id % 9)::INT) || left(text, 50) AS a FROM documents))")
def step_bins(spark, sf):
    a = F.concat(F.repeat(F.lit("<<1+1=2>> "), (F.col("doc_id") % 9).cast("int")), F.left("text", F.lit(50)))
    d = table(spark, sf, "documents").select("doc_id", T.step_count(a).alias("steps"))
    return d.withColumn("bin", T.step_bin(F.col("steps")))


@query(r"SELECT page_id, coalesce(try_cast(l AS INT), try_cast(regexp_extract(l, '\d') AS INT), 0)::BIGINT AS level FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Level ' || (page_id % 6) WHEN 1 THEN (page_id % 6)::VARCHAR ELSE 'none' END AS l FROM pages)")
def norm_level(spark, sf):
    i = F.col("page_id")
    level = F.when(i % 3 == 0, F.concat(F.lit("Level "), (i % 6).cast("string"))).when(i % 3 == 1, (i % 6).cast("string")).otherwise("none")
    return table(spark, sf, "pages").select("page_id", T.norm_level(level).alias("level"))


@query("SELECT item_id, coalesce(r, 'unknown') AS stratum FROM (SELECT o_orderkey AS item_id, n_name AS r FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30)")
def lookup_strata(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 30).alias("k"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return o.join(n, "k", "left").select("item_id", F.coalesce("n_name", F.lit("unknown")).alias("stratum"))


@query("SELECT doc_id, code FROM documents JOIN (SELECT source, (row_number() OVER (ORDER BY source) - 1)::BIGINT AS code FROM (SELECT DISTINCT source FROM documents)) USING (source)")
def dense_code(spark, sf):
    """Codes come from the distinct values (few), then join back: no window over all rows."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    codes = d.select("source").distinct().withColumn("code", F.row_number().over(W.orderBy("source")) - 1)
    return d.join(codes, "source").select("doc_id", "code")


@query(sql("SELECT doc_id, (n > q[1])::BIGINT + (n > q[2])::BIGINT + (n > q[3])::BIGINT AS bin_left, (n >= q[1])::BIGINT + (n >= q[2])::BIGINT + (n >= q[3])::BIGINT AS bin_digitize FROM (SELECT doc_id, lang, length(text) AS n FROM documents) JOIN (SELECT lang, quantile_cont(length(text), [0.25, 0.5, 0.75]) AS q FROM documents GROUP BY lang) USING (lang)"))
def length_quartile(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    a = C.length_quartile(d, "n", ["lang"], "left", "bin_left")
    return C.length_quartile(a, "n", ["lang"], "digitize", "bin_digitize").select("doc_id", "bin_left", "bin_digitize")


MODEL_SQL = "CASE s_suppkey % 6 WHEN 0 THEN 'Qwen/Qwen2.5-' || s_suppkey WHEN 1 THEN 'meta-llama/Llama-3-' || s_suppkey WHEN 2 THEN 'google/gemma-' || s_suppkey WHEN 3 THEN 'qwen3/' || s_suppkey WHEN 4 THEN 'microsoft/Phi-' || s_suppkey ELSE 'x/y' || s_suppkey END"


def model_names(spark, sf):
    k = F.col("s_suppkey")
    names = ["Qwen/Qwen2.5-", "meta-llama/Llama-3-", "google/gemma-", "qwen3/", "microsoft/Phi-", "x/y"]
    return table(spark, sf, "supplier").select(F.concat(F.element_at(F.array(*[F.lit(x) for x in names]), (k % 6 + 1).cast("int")), k.cast("string")).alias("model"))


@query(f"SELECT model, CASE WHEN contains(m, 'qwen') THEN 'qwen' WHEN contains(m, 'llama') THEN 'llama' WHEN contains(m, 'gemma') THEN 'gemma' WHEN contains(m, 'phi') THEN 'phi' ELSE 'other' END AS family, CASE WHEN contains(m, 'qwen3') THEN 'qwen3' WHEN contains(m, 'qwen2.5') THEN 'qwen2.5' WHEN contains(m, 'llama') THEN 'llama' WHEN contains(m, 'gemma') THEN 'gemma' WHEN contains(m, 'phi') THEN 'phi' ELSE 'other' END AS strict FROM (SELECT model, lower(model) AS m FROM (SELECT {MODEL_SQL} AS model FROM supplier))")
def family_of(spark, sf):
    return model_names(spark, sf).select("model", T.family_of(F.col("model")).alias("family"), T.family_of(F.col("model"), True).alias("strict"))


@query(f"SELECT replace(model, '/', '__') AS slug, model FROM (SELECT {MODEL_SQL} AS model FROM supplier)")
def slug_map(spark, sf):
    s = model_names(spark, sf).select(T.slug_of(F.col("model")).alias("slug"))
    return s.select("slug", T.model_of(F.col("slug")).alias("model"))


@query(sql("SELECT a.item_id, a.loss - b.loss AS refmodel_delta FROM matrix a JOIN matrix b USING (item_id) WHERE a.model = 'm0' AND b.model = 'm1'", "matrix", rnd="refmodel_delta"))
def refmodel_delta(spark, sf):
    from .base import matrix

    m = matrix(spark, sf)
    a, b = m.where("model = 'm0'").select("item_id", F.col("loss").alias("ref")), m.where("model = 'm1'").select("item_id", F.col("loss").alias("own"))
    return a.join(b, "item_id").select("item_id", (F.col("ref") - F.col("own")).alias("refmodel_delta"))


@query(sql("SELECT item_id, CASE WHEN p < 0.1 THEN 'clean' WHEN p > 0.5 THEN 'contam' WHEN p IS NOT NULL THEN 'mid' END AS risk FROM (SELECT item_id, CASE WHEN item_id % 50 = 0 THEN NULL ELSE p END AS p FROM audit)", "audit"))
def risk_class(spark, sf):
    p = F.when(F.col("item_id") % 50 == 0, float("nan")).otherwise(F.col("p"))
    return audit(spark, sf).select("item_id", S.risk_class(p).alias("risk"))


@query(r"""WITH x AS (SELECT o_orderkey, 'I have ' || o_custkey || ' and ' || (o_orderkey % 90) || ' of 7' AS t FROM orders), n AS (SELECT o_orderkey, t, regexp_extract_all(t, '[0-9]+') AS f FROM x),
    d AS (SELECT o_orderkey, f, list_transform(range(0, 3), lambda i: ('0x' || substr(md5(o_orderkey || '|' || i), 1, 8))::BIGINT % 99 + 2) AS r FROM n),
    e AS (SELECT o_orderkey, list_transform(range(1, 4), lambda i: CASE WHEN r[i]::VARCHAR = f[i] THEN CASE WHEN r[i] = 100 THEN 2 ELSE r[i] + 1 END ELSE r[i] END) AS r FROM d)
    SELECT o_orderkey, 'I have ' || r[1] || ' and ' || r[2] || ' of ' || r[3] AS text, 3::BIGINT AS n_changed FROM e""")
def perturb_numbers(spark, sf):
    t = F.concat(F.lit("I have "), F.col("o_custkey").cast("string"), F.lit(" and "), (F.col("o_orderkey") % 90).cast("string"), F.lit(" of 7"))
    new, n = T.perturb_numbers(t, F.col("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", new.alias("text"), n.alias("n_changed"))


@query("WITH x AS (SELECT page_id, unnest(string_split(url, '/')) AS choice, generate_subscripts(string_split(url, '/'), 1) - 1 AS i FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY md5('7|' || page_id || '|' || i), i) - 1 AS j FROM x) SELECT page_id, string_agg(choice, '|' ORDER BY j) AS options, max(j) FILTER (i = 0)::BIGINT AS gold FROM r GROUP BY page_id")
def shuffle_options(spark, sf):
    x = table(spark, sf, "pages").select("page_id", F.posexplode(F.split("url", "/")).alias("i", "choice"))
    r = x.withColumn("h", F.md5(F.concat_ws("|", F.lit("7"), F.col("page_id").cast("string"), F.col("i").cast("string"))))
    s = F.sort_array(F.collect_list(F.struct("h", "i", "choice")))
    return r.groupBy("page_id").agg(s.alias("s")).select("page_id", F.array_join("s.choice", "|").alias("options"), (F.array_position("s.i", F.lit(0)) - 1).alias("gold"))


@query(r"SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: length(p) BETWEEN 80 AND 1500)[1] AS para FROM documents")
def first_paragraph(spark, sf):
    t = F.regexp_replace("text", r"\n", "\n\n")
    return table(spark, sf, "documents").select("doc_id", T.first_paragraph(t).alias("para"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(t, 'RATING:\s*([1-5])', 1), ''), regexp_extract_all(t, '(?:^|[^0-9])([1-5])(?:$|[^0-9])', 1)[-1])::BIGINT AS rating, nullif(trim(regexp_extract(t, 'REASON:\s*([^\n]*)', 1)), '') AS reason FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'RATING: ' || (page_id % 5 + 1) || chr(10) || 'REASON: seen ' || url WHEN 1 THEN 'I say ' || (page_id % 5 + 1) || ' of it' ELSE 'no idea' END AS t FROM pages)")
def parse_rating(spark, sf):
    i, n = F.col("page_id"), (F.col("page_id") % 5 + 1).cast("string")
    t = F.when(i % 3 == 0, F.concat(F.lit("RATING: "), n, F.lit("\nREASON: seen "), F.col("url"))).when(i % 3 == 1, F.concat(F.lit("I say "), n, F.lit(" of it"))).otherwise("no idea")
    rating, reason = G.parse_rating(t)
    return table(spark, sf, "pages").select("page_id", rating.alias("rating"), reason.alias("reason"))


CASES = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[' || repeat(props || ',', (event_id % 9)::INT) || props || ']' WHEN 1 THEN '[]' ELSE '[' || props END AS t FROM events"


@query(f"SELECT event_id, coalesce(len(ks), 0)::BIGINT AS n, coalesce(list_sum(ks), 0)::BIGINT AS total FROM (SELECT event_id, list_transform((try_cast(t AS JSON)->'$[*].k')[1:5], lambda k: k::BIGINT) AS ks FROM ({CASES}))")
def json_cases(spark, sf):
    """Arrays of up to nine objects in a string, empty ones and malformed ones: at most five items of each."""
    props = F.col("props")
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), F.repeat(F.concat(props, F.lit(",")), (F.col("event_id") % 9).cast("int")), props, F.lit("]"))).when(F.col("event_id") % 3 == 1, "[]").otherwise(F.concat(F.lit("["), props))
    cases = G.json_cases(t, "struct<k: bigint>")
    return table(spark, sf, "events").select("event_id", F.size(cases).alias("n"), F.aggregate(cases, F.lit(0).cast("long"), lambda a, x: a + x["k"]).alias("total"))


@query(sql("SELECT row_id, x AS dropped, coalesce(x, avg(x) OVER (PARTITION BY variant)) AS filled, coalesce(x, 0) AS zeroed FROM (SELECT row_id, variant, CASE WHEN row_id % 7 = 0 THEN NULL ELSE n_chars END AS x FROM calib)", "calib", rnd="dropped filled zeroed"))
def na_policy(spark, sf):
    x = calib(spark, sf).withColumn("x", F.when(F.col("row_id") % 7 == 0, float("nan")).otherwise(F.col("n_chars")))
    means = x.groupBy("variant").agg(F.avg(S.na(F.col("x"), "drop")).alias("m"))
    return x.join(means, "variant").select("row_id", S.na(F.col("x"), "drop").alias("dropped"), S.na(F.col("x"), "mean", F.col("m")).alias("filled"), S.na(F.col("x"), "zero").alias("zeroed"))


@query(sql("SELECT item_id, least(2 * least(p, 1 - p), 1) AS p2 FROM audit", "audit", rnd="p2"))
def two_sided(spark, sf):
    return audit(spark, sf).select("item_id", S.two_sided(F.col("p")).alias("p2"))


@query(sql(f"SELECT item_id, {S.PHI_SQL.format(z='(delta * 3)')} AS phi, 2 * (1 - {S.PHI_SQL.format(z='abs(delta * 3)')}) AS two FROM audit", "audit", rnd="phi two"))
def normal_tails(spark, sf):
    z = F.col("delta") * 3
    return audit(spark, sf).select("item_id", S.phi(z).alias("phi"), (2 * (1 - S.phi(F.abs(z)))).alias("two"))


@query(r"SELECT doc_id, length(text) AS n_chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents")
def text_stats(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").alias("n_chars"), F.size(T.tokenize_ws(F.col("text"))).alias("n_words"))


@query("SELECT doc_id, left(text, 200) AS evidence FROM documents")
def truncate_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate_text(F.col("text"), 200).alias("evidence"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN CASE WHEN s <= 2 THEN '<=2' WHEN s <= 4 THEN '3-4' WHEN s <= 6 THEN '5-6' ELSE '7+' END WHEN 'de' THEN 'level' || (doc_id % 5) WHEN 'fr' THEN source ELSE 'all' END AS stratum FROM (SELECT *, doc_id % 9 AS s FROM documents)")
def difficulty_strata(spark, sf):
    """One stratifier a benchmark: steps, levels, a lookup, or a single stratum."""
    s = F.when(F.col("lang") == "en", T.step_bin(F.col("doc_id") % 9)).when(F.col("lang") == "de", F.concat(F.lit("level"), T.norm_level((F.col("doc_id") % 5).cast("string")).cast("string"))).when(F.col("lang") == "fr", F.col("source")).otherwise("all")
    return table(spark, sf, "documents").select("doc_id", s.alias("stratum"))


@query("SELECT conv_id, turn, CASE WHEN starts_with(a, 'ERR_') THEN 0 ELSE (contains(a, 'return ') OR contains(a, 'def '))::BIGINT END AS ok FROM (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'ERR_ def ' || text WHEN 1 THEN 'def f(): ' || text ELSE text END AS a FROM conversations)")
def plausible_code(spark, sf):
    a = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("ERR_ def "), "text")).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("def f(): "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", G.plausible_code(a).alias("ok"))
