"""A stored table that takes commits: buckets of keys as Parquet folders, and a manifest for each version that names them.

A commit merges rows by key, rewrites only the buckets it touches, into a folder of its own, and then becomes visible by
one rename of its manifest. What a killed commit has written is never read; the same commit given again starts over, or
does nothing if it is already in the table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import upsert


class VersionedTable:
    """``root``: a folder on any of Spark's file systems. ``keys``: what identifies a row. ``buckets``: parts by key hash,
    fixed when the table is made; the manifest has an entry for each."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def manifest(self) -> dict:
        """The newest version: {"version", "commits", "buckets": {bucket: folder}, "schema"}; version 0 is the empty table."""
        folder = self._path(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        versions = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not versions:
            return {"version": 0, "commits": [], "buckets": {}, "schema": None}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{max(versions):012d}.json", wholetext=True).first()[0])

    def read(self) -> DataFrame | None:
        """All rows of the newest version; none before the first commit."""
        return self._rows(self.manifest(), None)

    def _rows(self, manifest: dict, buckets: set[int] | None) -> DataFrame | None:
        from pyspark.sql.types import StructType

        if not manifest["schema"]:
            return None
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.root}/{v}" for k, v in manifest["buckets"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _publish(self, manifest: dict) -> None:
        target = self._path(f"{self.root}/manifests/{manifest['version']:012d}.json")
        draft = self._path(f"{self.root}/manifests/.{manifest['version']:012d}-{manifest['commits'][-1]}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"version {manifest['version']} is taken: another commit came first; give this one again")

    def merge(self, new: DataFrame, commit: str) -> int:
        """``new`` over the table by key (one row a key in it) as the commit of that name; the version that holds it."""
        old = self.manifest()
        if commit in old["commits"]:
            return old["version"]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in new.select(bucket).distinct().collect()}  # numbers below ``buckets``
        before = self._rows(old, touched)
        rows = new if before is None else upsert(before, new, self.keys)
        folder = f"data/{commit}"
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        named = old["buckets"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
        self._publish({"version": old["version"] + 1, "commits": [*old["commits"], commit], "buckets": named, "schema": json.loads(new.schema.json())})
        return old["version"] + 1
