"""What several operators share: lineage cuts in the shared folder, word hashes, distributed prefix sums."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word: whatever stands between ASCII white space (space, \t, \n, \v, \f, \r).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a folder
    of its own; any other is refused, since its executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


#: Bytes of one Arrow batch on its way to a Python worker, unless the session sets its own bound.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers wherever they run: Spark hands each of them a zip of it, once.
    Arrow batches are bound by bytes, so that rows with long texts need no more memory than others."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    if getattr(sc, "_evalsift_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    base = Path(tempfile.mkdtemp(prefix="spark-")) / "evalsift"
    sc.addPyFile(shutil.make_archive(str(base), "zip", root, "evalsift"))
    sc._evalsift_shipped = True


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/evalsift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
            if folder.getName().startswith("evalsift-"):
                folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text, in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def row_key() -> Column:
    """A 64-bit hash of a row's doc_id and text: rows that share it have the same text, whatever their ids."""
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers; 1 << 20 of them are kept between calls, longer runs (of a text above 1 MB) are not."""
    if len(_powers[kind]) >= n:
        return _powers[kind][:n]
    step = np.full(max(n, 1 << 20), _BASE if kind == "up" else _INV, np.uint64)
    step[0] = 1
    step = np.cumprod(step)
    _powers[kind] = step[: 1 << 20].copy()
    return step[:n]


def text_chunks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, their bytes, and the offsets of each text in them."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    offs = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_hashes(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, ASCII case folded; per text the index of its first word, with the total last; starts).

    With ``prefixes`` the hashes have a further column for the first so many bytes of each word (all of a shorter one).

    Linear work on whole arrays: prefix sums of byte codes times powers of an odd base modulo 2**64.
    """
    n = len(data)
    if not n:
        return np.zeros((0, len(prefixes) + 1) if prefixes else 0, np.uint64), np.zeros(len(offs), np.int64), np.zeros(0, np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~apart[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[FOLD[data]] * _power("up", n), out=total[1:])
    down = _power("down", n)[starts]
    upto = lambda e, salt: mix((total[e] - total[starts]) * down + (e - starts + salt).astype(np.uint64))
    hashes = upto(ends, 0)
    if prefixes:
        hashes = np.stack([hashes, *[upto(np.minimum(ends, starts + k), 1 << 20) for k in prefixes]], 1)
    return hashes, np.searchsorted(starts, offs), starts


#: Buckets whose sums meet in one task of ``prefix_before``.
GROUP = 2048


def prefix_before(df: DataFrame, part: list[str], order: list[Column], bucket: Column, value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``part`` that come before in the order.

    ``bucket`` must rise with the order. Three levels: rows meet only within (part, bucket), the sums of buckets within
    runs of GROUP buckets, and the sums of runs within a part, one row each: with 512 rows a bucket a part of 1e10 rows
    has 1e4 runs. No task ever holds a whole part.
    """
    keys = [f"_k{i}" for i in range(len(part))]
    named = [F.col(c).alias(k) for c, k in zip(part, keys, strict=True)]
    before = lambda by, order: W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sum_ = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    keyed = df.withColumn("_b", bucket).withColumn("_v", value)
    sums = keyed.groupBy(*named, F.col("_b").alias("_kb")).agg(F.sum("_v").alias("_s")).withColumn("_run", F.floor(F.col("_kb") / F.lit(GROUP)))
    runs = sums.groupBy(*[F.col(k).alias(f"_r{k}") for k in keys], F.col("_run").alias("_rr")).agg(F.sum("_s").alias("_rs"))
    runs = runs.withColumn("_far", sum_("_rs", before([f"_r{k}" for k in keys], ["_rr"]))).drop("_rs")
    within = sums.withColumn("_near", sum_("_s", before([*keys, "_run"], ["_kb"])))
    same = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys] + [F.col("_run") == F.col("_rr")]
    within = within.join(runs, same).select(*keys, "_kb", (F.col("_near") + F.col("_far")).alias("_pre"))
    local = keyed.withColumn("_in", sum_("_v", before([*part, "_b"], order)))
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(part, keys, strict=True)] + [F.col("_b") == F.col("_kb")]
    return local.join(within, on).withColumn(out, F.col("_in") + F.col("_pre")).drop("_b", "_v", "_in", "_pre", "_kb", *keys)
