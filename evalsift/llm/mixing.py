"""Mixing sources to target weights: Efraimidis-Spirakis order within sources, prefix sums against token budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, prefix_before, words, written

#: Weights of sources in code point order (null last), repeating; the mix's size; how often a source may be taken.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Quality weights of documents labelled 1, 0 and not at all.
QUALITY = {1: 2.0, 0: 0.5, None: 1.0}
ROWS_PER_BUCKET = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Filling up by weight until nothing exceeds ``epochs`` times a source's size is the level at which the first k
    sources, by size over weight, are full: the least k whose level does not reach the next source.
    """
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int")))
    s = s.withColumns({"_cap": F.col("source_size") * float(epochs), "_r": F.col("source_size") * float(epochs) / F.col("_w")})
    order, every = W.orderBy("_r", F.col("source").asc_nulls_last()), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({"_goal": F.sum("source_size").over(every) * share, "_full": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_rest": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    s = s.withColumn("_level", (F.col("_goal") - F.col("_full")) / F.col("_rest"))
    s = s.withColumn("_stop", F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_level"))).over(every))
    return s.select("source", "source_size", F.least("_cap", F.col("_w") * F.coalesce(F.col("_stop")["_level"], F.lit(math.inf))).alias("target"))


def place_in_source(doc_id: Column, h: Column, weight: Column, seed: int) -> Column:
    """1 - exp(-k) of the exponential key k = -ln(u) / weight: the same order, within (0, 1). u comes from an md5 of id
    and text, so that rows without id, or of one id, stand apart in the order."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), h)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.lit(1.0) - F.pow(u, F.lit(1.0) / weight)


def mix(sized: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, source, size, weight, ...) with ``source_size``, ``target``, ``epochs``, ``part`` and ``taken`` words of each row.

    A source whose target holds its size e whole times gives each row e times; the remainder goes to the rows first in
    its Efraimidis-Spirakis order, the last of them in part. Order is by (key, doc_id, size, h), h being a hash of the text: reruns agree. Sources are
    few rows even where one holds most documents; rows of one source meet only in buckets of their order. Buckets are
    equal parts of 1 - (1 - key) ** least weight, in which no weight's keys lie denser than its ratio to the least.
    """
    sized = written(sized)
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    goals = goals.select(F.col("source").alias("_source"), "source_size", "target")
    buckets = max(1, math.ceil(sized.count() / ROWS_PER_BUCKET))
    keyed = sized.withColumn("_key", place_in_source(F.col("doc_id"), F.col("h"), F.col("weight"), seed))
    even = F.lit(1.0) - F.pow(F.lit(1.0) - F.col("_key"), F.lit(float(sized.agg(F.min("weight")).first()[0] or 1.0)))
    ranked = prefix_before(keyed, ["source"], [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("h")], F.floor(even * buckets), F.col("size"), "_before")
    out = ranked.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - whole * F.col("source_size") - F.col("_before")))
    out = out.withColumns({"epochs": whole.cast("int"), "part": part.cast("long")})
    return out.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")).drop("_key", "_before")


def weighed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, size, h, weight) of each row; ``labels`` (doc_id, quality) may miss or repeat ids (the best counts)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_hash().alias("h"))
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_q")).withColumnRenamed("doc_id", "_id")
    weight = F.when(F.col("_q") == 1, QUALITY[1]).when(F.col("_q") == 0, QUALITY[0]).otherwise(QUALITY[None])
    return sized.join(best, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "source", "size", "h", weight.alias("weight"))


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row. Null texts have size 0; null sources form one source."""
    return mix(weighed(docs, labels)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix itself: a row of ``docs`` for each whole time it is taken, and one with its first words for a part.

    Texts meet the plan by (doc_id, hash of the text, rank among such rows), so repeated ids keep their own shares and
    rows without id do not meet; a cut text's words stand one blank apart and its n_chars follows.
    """
    plan = mix(weighed(docs, labels))
    rank = F.row_number().over(W.partitionBy("doc_id", "h").orderBy("source"))
    plan = plan.withColumn("_rank", rank).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "_rank", "epochs", "part")
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", text_hash().alias("h")).withColumn("_rank", rank)
    both = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (rows["_rank"] == plan["_rank"]))
    start = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("part").cast("int")), " ")
    whole = F.array_repeat(F.col("text"), F.col("epochs"))
    texts = F.when(F.col("part") > 0, F.concat(whole, F.array(start))).otherwise(whole)
    out = both.select("doc_id", F.explode(texts).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long"))
