"""Streams: an index of n-grams that grows by files, and items scored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import ngram_hashes, tokenize_words


def stream_index(spark: SparkSession, source: str, schema: StructType, index: str, checkpoint: str, n: int = 13, files: int = 1) -> None:
    """Consumes all files of ``source``; each batch adds the hashes that it holds.

    No state grows in the stream, and no batch reads what others wrote: each writes its distinct hashes into a folder of
    its own, which a batch repeated after a failure writes anew. Readers take distinct hashes over all batches.
    """
    spark.createDataFrame([], "h long").write.mode("ignore").parquet(f"{index}/batch=-1")

    def append(batch: DataFrame, number: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{index}/batch={number}")

    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    grams = docs.select(F.explode(ngram_hashes(tokenize_words(F.col("text")), n)).alias("h"))
    grams.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_overlap(spark: SparkSession, source: str, schema: StructType, index: DataFrame, sink: str, checkpoint: str, n: int = 13) -> None:
    """Appends (item_id, h, hit) of arriving items against a static index: a stream-static join without state."""
    items = spark.readStream.schema(schema).parquet(source).withColumn("h", F.explode(ngram_hashes(tokenize_words(F.col("text")), n)))
    hits = items.join(index.select("h", F.lit(1).alias("hit")), "h", "left").select("item_id", "h", F.coalesce("hit", F.lit(0)).alias("hit"))
    hits.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
