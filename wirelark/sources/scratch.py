"""Places for intermediate results that every executor can reach."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the checkpoint folder the cluster names."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _made.append(f"{root.rstrip('/')}/wirelark/{purpose}-{uuid.uuid4().hex}")
    return _made[-1]


_made: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession):
    """Owns the folders that are made inside: they are deleted at the end of the block, when no
    DataFrame that reads them is needed any more."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            _delete(spark, path)
        del _made[before:]


def clear(spark: SparkSession) -> None:
    """Deletes every folder that this process has made below the shared one."""
    while _made:
        _delete(spark, _made.pop())


def cut_lineage(df: DataFrame, purpose: str) -> DataFrame:
    """Writes the rows to a shared table and reads them back."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
