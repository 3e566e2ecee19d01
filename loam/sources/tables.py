"""The tables that queries read, with their stand-in roles.

documents are memories, embeddings their vectors, events the access log, orders and
line items time series, conversations sessions.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names.

    Only a local session, as in tests, gets a folder of its own where none is named:
    executors elsewhere would not see it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        known = context._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loam-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return f"{folder.rstrip('/')}/loam/{name}-{uuid.uuid4().hex}"


#: Lets Spark drop a job's shuffle files when the job has ended.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage is cut,
    its size is known, and the shuffle files behind it are dropped."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "table")
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that :func:`checkpointed` wrote, once nothing reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def value_of(df: DataFrame):
    """The one value of a table of one row; what it shuffles is dropped too."""
    kept = checkpointed(df)
    value = kept.first()[0]
    dropped(kept)
    return value
