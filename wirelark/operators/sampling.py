"""Reproducible samples, splits and folds with exact counts.

Rows are picked by the rank of a hash of their id within their class. Samples and splits only look
for each class's last hash and filter the rows where they are; folds need every rank, which comes
from `ordered.rank_within`, so a class that holds most of the rows is ranked by many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelark.operators.bounded import few_values, small_side
from wirelark.operators.ordered import rank_within

BUCKETS_LOG2 = 14


def row_hash(row_id: Column, seed: int = 42) -> Column:
    """A whole number below 2**32 that any SQL engine can work out."""
    folded = F.pmod(row_id, F.lit(2147483647)) * F.lit(2654435761)
    return F.pmod(folded + F.lit(seed * 40503), F.lit(4294967296))


def _ranked(df: DataFrame, keys, row_id: str, seed: int, shuffled: bool = True) -> DataFrame:
    if not shuffled:
        return rank_within(df, keys, [row_id], "_rank")
    hashed = df.withColumn("_hash", row_hash(F.col(row_id), seed))
    return rank_within(hashed, keys, ["_hash", row_id], "_rank").drop("_hash")


def _cutoffs(df: DataFrame, label: Column, quota: DataFrame, row_id: str, seed: int) -> DataFrame:
    """(_class, _cut): the last (hash, id) that is within each class's `_quota`.

    Counts per class and bucket of hashes find the bucket of the border; only its rows are ranked.
    Rows travel as (class, hash, id), and before the counts they are combined where they are."""
    narrow = df.select(label.alias("_class"), row_hash(F.col(row_id), seed).alias("_hash"), F.col(row_id).alias("_id"))
    narrow = narrow.withColumn("_bucket", F.shiftright("_hash", 32 - BUCKETS_LOG2))
    counts = narrow.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_n").over(upto)).join(
        quota.withColumnRenamed("_class", "_c"), F.col("_class").eqNullSafe(F.col("_c"))).where("_upto >= _quota and _quota > 0")
    border = counts.groupBy("_class").agg(F.min(F.struct("_bucket", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("left"))).alias("_b"))
    border = small_side(border.select(F.col("_class").alias("_c"), F.col("_b._bucket").alias("_at"), F.col("_b.left").alias("_left")))
    inside = narrow.join(border, F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_bucket") == F.col("_at")))
    rank = F.row_number().over(Window.partitionBy("_class").orderBy("_hash", "_id"))
    return inside.withColumn("_rank", rank).where("_rank = _left").select("_class", F.struct("_hash", "_id").alias("_cut"))


def _within(df: DataFrame, label: Column, quota: DataFrame, row_id: str, seed: int) -> DataFrame:
    """Adds `_inside`: whether a row is among the first `_quota` of its class by (hash, id)."""
    cuts = small_side(_cutoffs(df, label, quota, row_id, seed))
    own = F.struct(row_hash(F.col(row_id), seed).alias("_hash"), F.col(row_id).alias("_id"))
    return (df.join(cuts, label.eqNullSafe(F.col("_class")), "left")
            .withColumn("_inside", F.coalesce(own <= F.col("_cut"), F.lit(False))).drop("_class", "_cut"))


def stratified_sample(df: DataFrame, fraction: float, label: str = "Label", row_id: str = "row_id",
                      seed: int = 42) -> DataFrame:
    """round-half-even(fraction x rows) of every class."""
    quota = df.groupBy(F.col(label).alias("_class")).agg(F.bround(F.lit(fraction) * F.count("*"), 0).cast("long").alias("_quota"))
    return _within(df, F.col(label), quota, row_id, seed).where("_inside").select(*df.columns)


def bounded_sample(df: DataFrame, rows: int, label: str = "Label", row_id: str = "row_id", seed: int = 42,
                   least: int = 50) -> DataFrame:
    """About `rows` rows, each class by its share but with `least` of its rows, if it has so many."""
    counts = df.groupBy(F.col(label).alias("_class")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first().n
    if total <= rows:
        return df
    share = F.greatest(F.bround(F.col("_n") * F.lit(rows / total), 0).cast("long"), F.least(F.col("_n"), F.lit(least)))
    return _within(df, F.col(label), counts.select("_class", share.alias("_quota")), row_id, seed).where("_inside").select(*df.columns)


def simple_sample(df: DataFrame, fraction: float, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    quota = df.agg(F.lit(0).alias("_class"), F.bround(F.lit(fraction) * F.count("*"), 0).cast("long").alias("_quota"))
    return _within(df, F.lit(0), quota, row_id, seed).where("_inside").select(*df.columns)


def sample(df: DataFrame, fraction: float, label: str = "Label", row_id: str = "row_id",
           seed: int = 42) -> DataFrame:
    """By class where there is a label, else over all rows."""
    if fraction >= 1.0:
        return df
    if label in df.columns:
        return stratified_sample(df, fraction, label, row_id, seed)
    return simple_sample(df, fraction, row_id, seed)


def test_allocation(df: DataFrame, test_size: float, label: str) -> dict:
    """Rows per class that go to the test side: ceil(test_size x rows) in all, shared out by
    largest remainder (ties by class name)."""
    few_values(df, label)
    counts = sorted(((r[label], r["n"]) for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()), key=lambda c: (c[0] is not None, c[0]))
    rows = sum(n for _, n in counts)
    total = math.ceil(test_size * rows)
    share = {c: total * n // rows for c, n in counts}
    by_remainder = sorted(counts, key=lambda cn: (-(total * cn[1] % rows), str(cn[0])))
    for c, _ in by_remainder[:total - sum(share.values())]:
        share[c] += 1
    return share


def train_test_marks(df: DataFrame, test_size: float = 0.2, label: str = "target",
                     row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Adds `is_test`, stratified by class."""
    share = test_allocation(df, test_size, label)
    quota = df.sparkSession.createDataFrame(
        list(share.items()), f"_class {df.schema[label].dataType.simpleString()}, _quota long")
    return _within(df, F.col(label), quota, row_id, seed).withColumnRenamed("_inside", "is_test").select(*df.columns, "is_test")


def train_test_split(df: DataFrame, test_size: float = 0.2, label: str = "target",
                     row_id: str = "row_id", seed: int = 42):
    marked = train_test_marks(df, test_size, label, row_id, seed)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def stratified_folds(df: DataFrame, k: int = 5, label: str = "target", row_id: str = "row_id",
                     seed: int = 42, shuffled: bool = True, name: str = "fold") -> DataFrame:
    """Adds a fold number 0..k-1; every class is dealt out evenly."""
    return (_ranked(df, [label], row_id, seed, shuffled)
            .withColumn(name, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).select(*df.columns, name))


def growing_subsets(df: DataFrame, fractions=(0.2, 0.4, 0.6, 0.8, 1.0), row_id: str = "row_id") -> DataFrame:
    """Adds `first_step`: the index of the smallest fraction whose prefix holds the row; subset i
    is where(first_step <= i). Rows past the last fraction have null."""
    rows = df.count()
    ranked = _ranked(df.withColumn("_all", F.lit(0)), ["_all"], row_id, 0, shuffled=False)
    step = F.lit(None).cast("int")
    for i, f in reversed(list(enumerate(fractions))):
        step = F.when(F.col("_rank") <= math.floor(f * rows + 1e-9), F.lit(i)).otherwise(step)
    return ranked.withColumn("first_step", step).select(*df.columns, "first_step")
