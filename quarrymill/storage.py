"""Tables that cut a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without one gets its own; a cluster has to name it."""
    if not spark.conf.get(KEY, None):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {KEY} to a folder that driver and executors share")
        spark.conf.set(KEY, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.conf.get(KEY).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarrymill-{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one job, by name: written once, read as often as needed, deleted when they are passed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back: it outlives executors."""
        self.paths[name] = path = new_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step and no result reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """One table that a lazy result goes on reading."""
    return Scratch(df.sparkSession).keep(df, name)
