"""Small tables that a stream's micro-batches hand from one to the next.

Batch n writes its table to `<path>/<name>/batch=n` and reads that of the last batch before it, so a batch that
is run again reads the same table and overwrites its own. The last few tables stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEPT = 3                           # one would do but for a batch that is run again


def numbers(spark: SparkSession, path: str, prefix: str = "batch=") -> list[int]:
    """The numbers of the folders `<prefix><number>` below a path, rising."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def read(spark: SparkSession, path: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """The table of the last batch, or of the last one before a batch; empty if there is none."""
    found = [n for n in numbers(spark, f"{path}/{name}") if before is None or n < before]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}/batch={found[-1]}")


def keep(df: DataFrame, path: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
    for n in numbers(df.sparkSession, f"{path}/{name}")[:-KEPT]:
        delete(df.sparkSession, f"{path}/{name}/batch={n}")
