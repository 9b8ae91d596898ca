"""Sources and sinks: items, corpora, score records, indices, summaries. All are Spark readers and writers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import ngram_hashes
from ..operators.prefix import numbered, part_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores (a small file, or one row group) dealt over all of them; any other as it
    is, so that large inputs are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; a local master gets one of its own where that is unset)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        where = spark.sparkContext.getCheckpointDir()
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scan_items(items: DataFrame, most: int | None = None) -> DataFrame:
    """Items with a stable index ``item_idx`` in order of their ids; with ``most``, the first so many (a top-k)."""
    first = items.orderBy("item_id").limit(most) if most else items
    return numbered(first, [], [F.col("item_id")], part_of(first, "item_id"), "item_idx")


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines source under an explicit schema; malformed lines become nulls."""
    return spark.read.schema(schema).json(path)


def scan_corpora(sources: dict[str, DataFrame], tokens: Column | None = None, least: int = 0, n_docs: int | None = None) -> DataFrame:
    """Corpora stacked with their name; null texts become empty; documents short of ``least`` tokens are left out, and
    of each corpus the first ``n_docs`` accepted ones are taken."""
    out = None
    for name, df in sources.items():
        one = df.select(F.lit(name).alias("corpus"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        out = one if out is None else out.unionByName(one)
    if tokens is not None:
        out = out.where(F.size(tokens) >= least)
    if n_docs:
        out = out.withColumn("_r", F.row_number().over(W.partitionBy("corpus").orderBy("doc_id"))).where(F.col("_r") <= n_docs).drop("_r")
    return out


def load_scores(records: DataFrame, benchmark: str | None = None) -> DataFrame:
    """(model, benchmark, item_idx, p) from records of parallel arrays ``benchmarks``, ``idx`` and ``p``."""
    rows = records.select("model", F.explode(F.arrays_zip("benchmarks", "idx", "p")).alias("z"))
    rows = rows.select("model", F.col("z.benchmarks").alias("benchmark"), F.col("z.idx").alias("item_idx"), F.col("z.p").alias("p"))
    return rows.where(F.col("benchmark") == benchmark) if benchmark else rows


def layered_lookup(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the last layer that has the key."""
    out = None
    for i, df in enumerate(layers):
        one = df.withColumn("_layer", F.lit(i))
        out = one if out is None else out.unionByName(one)
    rest = [c for c in layers[0].columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_layer").alias("r")).select(*keys, "r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` over ``old`` by key."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.withColumn("_o", F.lit(True)), new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in rest], F.lit(True).alias("_n"))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, *[F.when(F.col("_n"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def write_index(docs: DataFrame, tokens: Column, sizes: list[int], path: str) -> DataFrame:
    """Writes the distinct n-gram hashes of each size, partitioned by corpus and n; returns the manifest
    (corpus, n, docs, tokens, ngrams)."""
    toks = docs.select("corpus", "doc_id", tokens.alias("t"))
    # a text is cut once for all sizes, and its grams are dealt before they are made distinct: hardly any meet within a task
    each = F.array(*[F.struct(F.lit(n).alias("n"), ngram_hashes(F.col("t"), n).alias("hs")) for n in sizes])
    grams = toks.select("corpus", F.inline(each)).select("corpus", "n", F.explode("hs").alias("h"))
    grams.repartition("h").dropDuplicates(["corpus", "n", "h"]).write.partitionBy("corpus", "n").parquet(path)
    spark = docs.sparkSession
    unique = spark.read.parquet(path).groupBy("corpus", "n").agg(F.count(F.lit(1)).alias("ngrams"))
    counts = toks.groupBy("corpus").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("t")).alias("tokens"))
    return unique.join(counts, "corpus").select("corpus", F.col("n").cast("int").alias("n"), "docs", "tokens", "ngrams")


#: Bytes of text whose grams share a bucket: some 1.3 M grams.
BUCKET_BYTES = 8 << 20


def buckets_for(docs: DataFrame, least: int = 16) -> int:
    """As many buckets as keep one's grams within a task's memory, however large the corpus."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-size // BUCKET_BYTES))


def write_bucketed_index(docs: DataFrame, tokens: Column, sizes: list[int], name: str, path: str, buckets: int) -> DataFrame:
    """Writes the distinct n-gram hashes (corpus, n, h) as the table ``name``, in ``buckets`` buckets by hash, sorted within
    them, a file a bucket, with Bloom filters of the hashes for look-ups of few. Grams are dealt once: what makes them
    distinct is what the buckets need. Returns the table; a join on h with it moves the other side alone."""
    spark = docs.sparkSession
    toks = docs.select("corpus", tokens.alias("t"))
    each = F.array(*[F.struct(F.lit(n).alias("n"), ngram_hashes(F.col("t"), n).alias("hs")) for n in sizes])
    grams = toks.select("corpus", F.inline(each)).select("corpus", "n", F.explode("hs").alias("h"))
    writer = grams.repartition(buckets, "h").dropDuplicates(["corpus", "n", "h"]).write.bucketBy(buckets, "h").sortBy("h")
    writer.option("parquet.bloom.filter.enabled#h", "true").option("path", path).saveAsTable(name)
    return spark.table(name)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, however often it is read."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def roundtrip_csv(df: DataFrame, path: str) -> DataFrame:
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)


def roundtrip_json(df: DataFrame, path: str) -> DataFrame:
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def roundtrip_partitioned(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """One folder a key value; reading discovers them (names that begin with ``_`` are skipped by Spark itself)."""
    df.write.partitionBy(*keys).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path).select(*df.columns)


def summary_json(summary: DataFrame, key: str, group: str) -> DataFrame:
    """(group, summary): a JSON object by ``key`` of each group's rows."""
    rest = [c for c in summary.columns if c not in (key, group)]
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.struct(*rest).alias("value"))))
    return summary.groupBy(group).agg(F.to_json(F.map_from_entries(entries)).alias("summary"))
