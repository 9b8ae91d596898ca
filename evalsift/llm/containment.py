"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, row_key, words, written

SHINGLE, CONTAINMENT = 5, 0.75
#: Ids or item shingles up to this many (about 50 MB as a hash table) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _hash(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(k)], F.lit(k))


def shingles(w: Column, k: int) -> Column:
    """Hashes of all k-word shingles of a word array, repeats included; none for fewer words."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: _hash(w, i, k))).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, k, q, h): distinct shingles of each item; items of fewer than five words are one shingle of k words."""
    w = items.select("item_id", words(ascii_lower(F.col("text"))).alias("w")).where("item_id is not null")
    k = F.least(F.size("w"), F.lit(SHINGLE))
    hs = F.coalesce(*[F.when(k == n, shingles(F.col("w"), n)) for n in range(1, SHINGLE + 1)])
    return w.where(F.size("w") > 0).select("item_id", k.alias("k"), F.explode(F.array_distinct(hs)).alias("h")).distinct()


def sketches(table: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, k, q, sizes, h): each item's least hashes, one more than the shingles that a hit may lack, so that every
    hit shares one of them. ``sizes`` is the item's partition, by the logarithm of its size."""
    by_item = table.groupBy("item_id", "k").agg(F.sort_array(F.collect_list("h")).alias("hs")).withColumn("q", F.size("hs"))
    spare = F.floor(F.col("q") * (1 - containment) + 1e-9).cast("int")
    return by_item.select("item_id", "k", "q", F.floor(F.log2("q")).cast("int").alias("sizes"), F.explode(F.slice("hs", F.lit(1), spare + 1)).alias("h"))


def find(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, shared, q, containment): every item of whose q shingles the document holds the share or more.

    Items are partitioned by size. Each partition has its own bound, the greatest of its items' minima: a document's
    shingles above it need no look there, and those below meet that partition's minima alone. Documents that share a
    minimum with an item are candidates; only their shingles are compared in full. No hit is lost, whatever its size. A
    passage that many documents share makes a row for each of them, never pairs of documents. Null and empty texts and
    items match nothing; rows of one id count as one document, rows with a null id likewise (``drop_contaminated`` tells
    them apart); items without id are left out, those of one id are one item.
    """
    table = written(item_shingles(items))
    low = written(sketches(table, containment))
    tops = {(r["k"], r["sizes"]): r["top"] for r in low.groupBy("k", "sizes").agg(F.max("h").alias("top")).collect()}  # 5 * 32 rows at most
    if not tops:
        return docs.select("doc_id").limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("shared", "long"), ("q", "int"), ("containment", "double"))])
    ks = sorted({k for k, _ in tops})
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)))
    lower = docs.select(F.col("doc_id"), key.alias("_k"), words(ascii_lower(F.col("text"))).alias("w"))

    def probe(w: Column) -> Column:
        """(k, sizes, h) of all shingles below their partition's bound; of a repeated one, one at least."""

        def of(k: int) -> Column:
            mine = sorted((top, size) for (kk, size), top in tops.items() if kk == k)
            looks = lambda h: F.array(*[F.when(h <= top, F.struct(F.lit(k).alias("k"), F.lit(size).alias("sizes"), h.alias("h"))) for top, size in mine])
            low_ones = F.filter(F.array_distinct(shingles(w, k)), lambda h: h <= mine[-1][0])
            return F.flatten(F.transform(low_ones, lambda h: F.filter(looks(h), lambda x: x.isNotNull())))

        return of(ks[0]) if len(ks) == 1 else F.concat(*[of(k) for k in ks])

    probes = lower.select("_k", F.inline(let(F.col("w"), probe)))
    mins = low.select("k", "sizes", "h", "item_id")
    pairs = written(probes.join(_small(mins, low.count()), ["k", "sizes", "h"]).select("_k", "item_id").distinct())
    ids = pairs.select("_k").distinct()
    few = lower.join(_small(ids, ids.count()), "_k", "left_semi")
    every = let(F.col("w"), lambda w: F.array_distinct(F.concat(*[shingles(w, k) for k in ks])))
    held = few.select("doc_id", "_k", F.explode(every).alias("h"))
    sizes = low.select("item_id", "q").distinct()
    full = table.select("h", "item_id", "k").join(_small(sizes, sizes.count()), "item_id")
    hits = held.join(_small(full, table.count()), "h").groupBy("doc_id", "_k", "item_id", "q").agg(F.countDistinct("h").alias("shared"))
    hits = hits.join(pairs, ["_k", "item_id"], "left_semi").where(F.col("shared") >= F.col("q") * F.lit(containment) - 1e-9)
    return hits.select("doc_id", "item_id", "shared", "q", (F.col("shared") / F.col("q")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item; rows that stay are unchanged. Each row stands for its own text, whether
    its id is null, repeated or neither."""
    hits = written(find(docs.select(row_key().alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_evs_k")).distinct())
    return docs.withColumn("_evs_k", row_key()).join(_small(hits, hits.count()), "_evs_k", "left_anti").drop("_evs_k")
