"""From raw documents to a sharded mix: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalsift.llm.common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects at its language's threshold."""
    from evalsift.llm.toxicity import score_documents

    verdicts = score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=COLUMNS)
    return verdicts.where("not rejected").select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: its smallest id, or a row without id where none has one."""
    from evalsift.llm.jaccard_join import keep_one

    return keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    from evalsift.llm.containment import drop_contaminated

    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents to the mix: a row for each time a document is taken, the last perhaps in part."""
    from evalsift.llm.mixing import mixed_texts

    return mixed_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the mix into 24 shards of near equal bytes."""
    from evalsift.llm.sharding import shards

    return shards(docs, 24)


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier's verdicts and the hash orders of mixing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet in the shared folder and read again."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
