"""The thirteen queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_mix_sources(spark, sf_dir):
    from .mixing import mix_documents

    return mix_documents(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op5_kd_shards(spark, sf_dir):
    from .sharding import shards

    return shards(_t(spark, sf_dir, "documents"), 24)


def op9_url_bloom_filter(spark, sf_dir):
    """The list: canonical urls of the pages whose id is divisible by 20."""
    from .urls import canonical, filter_urls

    pages = _t(spark, sf_dir, "pages")
    return filter_urls(pages, pages.where("page_id % 20 = 0").select(canonical(F.col("url")).alias("canonical")))


def op10_order_minhash(spark, sf_dir):
    from .order_minhash import fingerprints

    return fingerprints(_t(spark, sf_dir, "documents"))


def op3_secret_novelty(spark, sf_dir):
    from .secrets import find_secrets

    return find_secrets(_t(spark, sf_dir, "documents"))


def op6_toxicity_cnn(spark, sf_dir):
    from .toxicity import score_documents

    return score_documents(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op7_benchmark_containment(spark, sf_dir):
    from .containment import find

    return find(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op8_lm_backoff(spark, sf_dir):
    from .backoff import score_documents

    return score_documents(_t(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark, sf_dir):
    from .jaccard_join import join

    return join(_t(spark, sf_dir, "documents"))


def op1_pii_weak_supervision(spark, sf_dir):
    from .pii import find_pii

    return find_pii(_t(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark, sf_dir):
    from .alignment import align_documents

    return align_documents(_t(spark, sf_dir, "documents"))


def op12_warc_normaliser(spark, sf_dir):
    from .warc import archive_pages

    return archive_pages(_t(spark, sf_dir, "pages"))


def op13_source_divergence(spark, sf_dir):
    from .divergence import audit

    return audit(_t(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii_weak_supervision, op2_mix_sources, op3_secret_novelty, op4_ngram_jaccard_join, op5_kd_shards, op6_toxicity_cnn, op7_benchmark_containment, op8_lm_backoff, op9_url_bloom_filter, op10_order_minhash, op11_tokenizer_alignment, op12_warc_normaliser, op13_source_divergence)}
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
FIVES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

ORACLES: dict[str, str] = {
    "op2_mix_sources": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS h, CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight
            FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY 1),
        r AS (SELECT *, 2.0 * source_size / w AS r, 1.5 * sum(source_size) OVER () AS goal FROM s),
        l AS (SELECT *, (goal - coalesce(sum(2.0 * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM r WINDOW o AS (ORDER BY r, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, least(2.0 * source_size, w * (SELECT level FROM l WHERE level <= r ORDER BY r LIMIT 1))::DOUBLE AS target FROM l),
        k AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY 1 - pow((('0x' || substr(md5('17|' || doc_id || '|' || h), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE, 1 / weight), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t USING (source))
        SELECT doc_id, size, source_size, target, (floor(floor(target) / source_size) * size + greatest(0, least(size, floor(target) - floor(floor(target) / source_size) * source_size - before)))::BIGINT AS taken FROM k""",
    "op4_ngram_jaccard_join": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents), g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({FIVES}) AS g FROM d),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
        SELECT a AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a, n""",
    "op7_benchmark_containment": f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), i AS (SELECT item_id, {WORDS} AS w FROM benchmark), g AS (SELECT DISTINCT doc_id, unnest({FIVES}) AS g FROM d), h AS (SELECT DISTINCT item_id, unnest({FIVES}) AS g FROM i),
        q AS (SELECT item_id, count(*) AS q FROM h GROUP BY 1) SELECT doc_id, item_id, count(*) AS shared, q, count(*) / q AS containment FROM g JOIN h USING (g) JOIN q USING (item_id) GROUP BY doc_id, item_id, q HAVING count(*) >= 0.75 * q""",
    "op9_url_bloom_filter": f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UP}', '{LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        c AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(regexp_replace(path, '\\.html?$', ''), '/+$', '') AS canonical FROM h),
        r AS (SELECT *, canonical <> '' AND canonical IN (SELECT canonical FROM c WHERE page_id % 20 = 0) AS listed, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, canonical, listed FROM r""",
    "op12_warc_normaliser": """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p), r AS (SELECT *, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""",
    "op13_source_divergence": f"""WITH d AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UP}', '{LOW}') AS text, row_number() OVER () AS r FROM documents),
        o AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d), c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM o GROUP BY ALL),
        l AS MATERIALIZED (SELECT lang, term, sum(n) AS all_n FROM c GROUP BY ALL HAVING sum(docs) >= 30), v AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_n FROM l GROUP BY ALL), g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
        k AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0)::HUGEINT AS n, all_n::HUGEINT AS all_n FROM g JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
        w AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS group_n FROM k),
        p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (group_n + 5 * v)::HUGEINT AS p, 1 + (1000000000 * (all_n + 5)) // (lang_n + 5 * v)::HUGEINT AS q FROM w JOIN v USING (lang)),
        f AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN p x ON x.lang = g.lang AND x.source = g.source LEFT JOIN p y ON y.lang = g.lang AND y.source = h.source AND y.term = x.term GROUP BY ALL
            UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM f QUALIFY part = 'pair' OR rank <= 50""",
}
