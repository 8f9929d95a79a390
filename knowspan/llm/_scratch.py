"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs only its own tasks. Nothing is ever written to a folder of a single machine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "file:///tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a default only where it is unset and Spark runs locally."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_DEFAULT


#: Spark's setting that removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows in an Arrow batch: texts are large, and a Python worker holds a few batches at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Scratch:
    """A folder of intermediate tables for one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return a scan of what was written. The shuffle files of this write go with its end."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer.parquet(self.at(name))
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def keep(self, *names: str) -> None:
        """Drop all tables but these."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        for found in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path):
            if found.getPath().getName() not in names:
                self.drop(found.getPath().getName())

    def drop(self, name: str = "") -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def others(df: DataFrame, added: list[str]) -> list[str]:
    """The columns of ``df`` that stay where ``added`` ones replace those of the same name."""
    lower = {c.lower() for c in added}
    return [c for c in df.columns if c.lower() not in lower]
