"""Shared storage: where lineage is cut and where archives are written."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only in a local session, as in
    tests, a temporary folder is set where neither that setting nor a checkpoint
    folder exists: executors elsewhere would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loam-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/loam/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark keeps it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Lets Spark drop a job's shuffle files when the job has ended.  Set for the session
#: by the first table that is kept, and left on.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run, in a folder of its own below the shared one.

    A kept table cuts lineage durably: a lost executor costs no recomputation of it,
    and the shuffle files behind it can go.  A run drops each table as soon as
    nothing reads it any more; what its result still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, shared_path(spark, name)
        spark.conf.set(_FREE_SHUFFLES, "true")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as the table ``name`` and read back."""
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")


def open_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or absolute path, and the path in it."""
    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def commit_parts(directory: str, parts: list[str]) -> None:
    """Name the parts of successful tasks in a manifest.

    Parts are written under their final names.  ``parts`` has one name per task, so it
    grows with tasks and not with rows.  What failed or repeated attempts left behind
    is in no manifest and is not read.
    """
    system, path = open_filesystem(directory)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}") as out:
        out.write("\n".join(sorted(parts)).encode())


def list_parts(directory: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of each part that a manifest names, in order of name; of all files
    with the suffix where there is no manifest, as in archives from elsewhere."""
    system, path = open_filesystem(directory)
    infos = [i for i in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.is_file]
    manifests = [i.path for i in infos if i.base_name.startswith("_manifest-")]
    named: set[str] = set()
    for manifest in manifests:
        with system.open_input_stream(manifest) as stream:
            named.update(stream.read().decode().split("\n"))
    found = [i for i in infos if i.path.endswith(suffix) and (not manifests or i.base_name in named)]
    return sorted((i.path, i.size) for i in found)
