"""Tables in the folder that driver and executors share, to cut lineage and read a step twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests), the warehouse, which is shared too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


class Scratch:
    """The intermediate tables of one operator call, in a new folder of their own.

    They are ordinary committed tables, so a lost executor costs only the tasks it was running.
    A table is dropped as soon as a later one replaces it; those that a returned DataFrame
    still reads stay in the shared folder.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.folder = f"{shared_root(spark)}/wirelark-llm/{purpose}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Writes the rows and reads them back."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets the driver's JVM collect its garbage: only then does Spark delete the broadcasts and shuffle files of
        the steps that are done. For operators of many small steps between tables."""
        self.spark._jvm.System.gc()
