"""The registry of queries, and derived views defined once for Spark and once for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import distinct_ratio, tokenize_words
from ..sources.io import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS_SQL = r"list_transform(regexp_extract_all(coalesce({}, ''), '[\p{{L}}\p{{N}}_]+'), lambda w: lower(w))"
NGRAMS_SQL = "list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i : i + {n} - 1], ' '))"
#: Synthetic audits over given tables: arithmetic on keys stands in for scores that need a model.
VIEWS = {
    "doc_tok": f"SELECT doc_id, source, lang, {WORDS_SQL.format('text')} AS t FROM documents",
    "ben_tok": f"SELECT item_id, {WORDS_SQL.format('text')} AS t FROM benchmark",
    "audit": """SELECT 'm' || (o_custkey % 12) AS model, o_orderpriority AS benchmark, o_orderkey AS item_id, ((o_orderkey * 37 + o_custkey) % 1009) / 1008.0::DOUBLE AS p,
        ((o_orderkey * 53 + o_custkey * 7) % 1013) / 1012.0::DOUBLE AS p1, (o_orderkey % 7 < 4)::INT AS correct, ((o_orderkey * 29 + o_custkey * 3) % 997) / 250.0::DOUBLE AS loss,
        ((o_orderkey * 31 + o_custkey * 11) % 991) / 495.0::DOUBLE - 1 AS delta, o_orderkey % 4 AS stratum FROM orders""",
    "matrix": """SELECT 'm' || (l_suppkey % 10) AS model, l_partkey AS item_id, sum(l_quantity) / count(*) / 10 AS loss, ((l_partkey * 7 + (l_suppkey % 10) * 13) % 10 < 6)::INT AS correct
        FROM lineitem GROUP BY l_suppkey % 10, l_partkey""",
    "models": """SELECT model, 'f' || (substr(model, 2)::INT % 4) AS family, sum(correct) / count(*) AS acc FROM matrix GROUP BY model""",
    "calib": f"""SELECT substr('ABCDE', (doc_id % 5 + 1)::INT, 1) AS variant, CASE WHEN doc_id % 5 < 3 THEN 'dev' ELSE 'val' END AS split, doc_id AS row_id, quality AS label, toxic, length(text)::DOUBLE AS n_chars,
        len(t)::DOUBLE AS n_words, CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) END AS distinct_ratio FROM (SELECT *, {WORDS_SQL.format('text')} AS t FROM documents JOIN labels USING (doc_id))""",
    "long_calib": """SELECT variant, split, row_id, label, 'n_chars' AS detector, n_chars AS score FROM calib UNION ALL SELECT variant, split, row_id, label, 'n_words', n_words FROM calib
        UNION ALL SELECT variant, split, row_id, label, 'distinct_ratio', distinct_ratio FROM calib""",
    "cells": """SELECT model, benchmark, count(*) FILTER (p < 0.1) AS n_clean, count(*) FILTER (p > 0.5) AS n_contam, avg(correct) FILTER (p < 0.1) AS clean_acc, avg(correct) FILTER (p > 0.5) AS contam_acc,
        avg(correct) FILTER (p < 0.1) - avg(correct) FILTER (p > 0.5) AS gap FROM audit GROUP BY model, benchmark HAVING count(*) FILTER (p < 0.1) >= 10 AND count(*) FILTER (p > 0.5) >= 10""",
    "cells1": """SELECT model, benchmark, count(*) FILTER (p1 < 0.1) AS n_clean, count(*) FILTER (p1 > 0.5) AS n_contam, avg(correct) FILTER (p1 < 0.1) AS clean_acc, avg(correct) FILTER (p1 > 0.5) AS contam_acc,
        avg(correct) FILTER (p1 < 0.1) - avg(correct) FILTER (p1 > 0.5) AS gap FROM audit GROUP BY model, benchmark HAVING count(*) FILTER (p1 < 0.1) >= 10 AND count(*) FILTER (p1 > 0.5) >= 10""",
    "se_cells": "SELECT *, sqrt(greatest(clean_acc * (1 - clean_acc), 0.01) / n_clean + greatest(contam_acc * (1 - contam_acc), 0.01) / n_contam) AS se FROM cells",
}
NEEDS = {"models": ["matrix"], "long_calib": ["calib"], "cells": ["audit"], "cells1": ["audit"], "se_cells": ["audit", "cells"]}


def sql(body: str, *views: str, rnd: str = "") -> str:
    """A SQL text with the views it needs, its named columns rounded to 6 places."""
    order: list[str] = []
    for v in views:
        for x in [*NEEDS.get(v, []), v]:
            if x not in order:
                order.append(x)
    head = "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in order) + " " if order else ""
    if not rnd:
        return head + body
    return f"{head}SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in rnd.split())}) FROM ({body})"


def query(oracle: str | None = None):
    """Registers a query; its doubles are rounded to 6 places, its integers widened."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            cast = {"double": lambda c: F.round(c, 6) + F.lit(0.0), "int": lambda c: F.col(c).cast("long")}
            return df.select(*[cast[t](f"`{c}`" if t == "double" else c).alias(c) if t in cast else F.col(c) for c, t in df.dtypes])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return run

    return add


def doc_tok(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", tokenize_words(F.col("text")).alias("t"))


def ben_tok(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tokenize_words(F.col("text")).alias("t"))


def audit(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")).select(
        F.concat(F.lit("m"), (c % 12).cast("string")).alias("model"), F.col("o_orderpriority").alias("benchmark"), k.alias("item_id"), ((k * 37 + c) % 1009 / 1008.0).alias("p"), ((k * 53 + c * 7) % 1013 / 1012.0).alias("p1"),
        (k % 7 < 4).cast("int").alias("correct"), ((k * 29 + c * 3) % 997 / 250.0).alias("loss"), ((k * 31 + c * 11) % 991 / 495.0 - 1).alias("delta"), (k % 4).alias("stratum"),
    )


def matrix(spark, sf):
    m = F.col("l_suppkey") % 10
    g = table(spark, sf, "lineitem").groupBy(m.alias("_m"), F.col("l_partkey").alias("item_id")).agg((F.sum("l_quantity") / F.count(F.lit(1)) / 10).alias("loss"))
    return g.select(F.concat(F.lit("m"), F.col("_m").cast("string")).alias("model"), "item_id", "loss", ((F.col("item_id") * 7 + F.col("_m") * 13) % 10 < 6).cast("int").alias("correct"))


def models(spark, sf, outcomes=None):
    g = (matrix(spark, sf) if outcomes is None else outcomes).groupBy("model").agg((F.sum("correct") / F.count(F.lit(1))).alias("acc"))
    return g.select("model", F.concat(F.lit("f"), (F.substring("model", 2, 9).cast("int") % 4).cast("string")).alias("family"), "acc")


def calib(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).join(table(spark, sf, "labels"), "doc_id").withColumn("t", tokenize_words(F.col("text")))
    v = F.col("doc_id") % 5
    return d.select(F.substring(F.lit("ABCDE"), (v + 1).cast("int"), F.lit(1)).alias("variant"), F.when(v < 3, "dev").otherwise("val").alias("split"), F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), "toxic", F.length("text").cast("double").alias("n_chars"), F.size("t").cast("double").alias("n_words"), distinct_ratio(F.col("t")).alias("distinct_ratio"))


FEATURES = ["n_chars", "n_words", "distinct_ratio"]
