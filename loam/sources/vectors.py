"""A store of vectors by (id, model): versions of buckets in Parquet, named by manifests.

An upsert writes the buckets it touches anew, in a folder of its own, and then a manifest
that names the current folder of every bucket.  Readers see the last manifest, so a run that
fails in between leaves nothing half done, and older versions can be read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.vectors import valid_vector

SCHEMA = "id long, model string, vector array<float>, updated long"


class VectorStore:
    """``root`` is a folder that driver and executors share, on any file system of Spark's."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(folder) if s.getPath().getName()[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """``buckets``: folder by bucket; ``batches``: the last batch of each source."""
        known = self.versions()
        if not known:
            return {"version": 0, "count": self.buckets, "buckets": {}, "batches": {}}
        name = f"{self.root}/_manifests/{known[-1] if version is None else version:010d}.json"
        return json.loads(self.spark.read.text(name, wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """``(id, model, vector, updated)`` as of a version, the last by default."""
        paths = [f"{self.root}/{folder}/bucket={b}" for b, folder in self.manifest(version)["buckets"].items()]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def upsert(self, rows: DataFrame, source: str = "", batch: int | None = None) -> int:
        """Put rows (id, model, vector, updated) and return the version that has them.

        Of one key the row with the largest ``updated`` stays, a new one before an old one
        with the same.  Rows with a null id or model, or a vector that is null, empty or not
        finite, raise an error before anything is written.  A ``batch`` of a source that came
        before changes nothing.  Only the buckets of the keys that come are read and written.
        """
        now = self.manifest()
        if batch is not None and now["batches"].get(source, -1) >= batch:
            return now["version"]
        bad = rows.where(F.col("id").isNull() | F.col("model").isNull() | ~F.coalesce(valid_vector(F.col("vector")), F.lit(False)))
        if not bad.isEmpty():
            raise ValueError(f"no key or no dense, finite vector: {bad.select('id', 'model').first()}")
        count = now["count"]
        bucket = F.pmod(F.xxhash64("id", "model"), F.lit(count)).cast("int")
        put = rows.select(F.col("id").cast("long"), "model", F.col("vector").cast("array<float>"), F.col("updated").cast("long"), F.lit(1).alias("new")).withColumn("bucket", bucket)
        touched = sorted(r["bucket"] for r in put.select("bucket").distinct().collect())  # at most as many as buckets
        old = [f"{self.root}/{now['buckets'][str(b)]}/bucket={b}" for b in touched if str(b) in now["buckets"]]
        every = put
        if old:
            every = put.unionByName(self.spark.read.schema(SCHEMA).parquet(*old).withColumn("new", F.lit(0)).withColumn("bucket", bucket))
        latest = F.max_by(F.struct("vector", "updated"), F.struct("updated", "new", F.xxhash64("vector")))
        kept = every.groupBy("bucket", "id", "model").agg(latest.alias("v")).select("bucket", "id", "model", "v.vector", "v.updated")
        folder = f"data-{uuid.uuid4().hex}"
        kept.repartition(max(1, len(touched)), "bucket").sortWithinPartitions("bucket", "model", "id").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        version = now["version"] + 1
        batches = now["batches"] | ({source: batch} if batch is not None else {})
        self._commit({"version": version, "count": count, "buckets": now["buckets"] | {str(b): folder for b in touched}, "batches": batches})
        return version

    def _commit(self, manifest: dict) -> None:
        """Name a manifest; of two writers of one version the second fails."""
        done = self._path(f"{self.root}/_manifests/{manifest['version']:010d}.json")
        part = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(done) or not self._fs.rename(part, done):
            raise RuntimeError(f"another writer made version {manifest['version']}")

    def follow(self, stream: DataFrame, source: str, checkpoint: str):
        """Upsert every micro-batch of a stream once, though it be delivered again."""
        put = lambda batch, number: self.upsert(batch, source, number)
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
