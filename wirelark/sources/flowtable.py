"""Labelled flow tables: reading, cleaning and the target column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from wirelark.functions.net import protocol_number
from wirelark.operators.bounded import small_side
from wirelark.schemas import CONSTANT_COLUMNS, IDENTIFIER_COLUMNS

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def read(spark: SparkSession, path: str, schema=None, fmt: str = "csv") -> DataFrame:
    """CSV with a header (give a schema to save the inference pass) or parquet; names are trimmed."""
    if fmt != "csv":
        return strip_names(spark.read.format(fmt).load(path))
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return strip_names(reader.csv(path))


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def to_float32(df: DataFrame, keep=()) -> DataFrame:
    """All numeric columns except `keep` as 4-byte floats."""
    names = set(numeric_columns(df)) - set(keep)
    return df.select(*[F.col(f"`{c}`").cast("float").alias(c) if c in names else F.col(f"`{c}`")
                       for c in df.columns])


def blank_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns become null."""
    def blank(field):
        c = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return c
        infinite = F.abs(c) == F.lit(float("inf"))
        return F.when(~F.isnan(c) & ~infinite, c).alias(field.name)
    return df.select(*[blank(f) for f in df.schema.fields])


def drop_incomplete(df: DataFrame) -> DataFrame:
    return blank_non_finite(df).na.drop("any")


def drop_repeats(df: DataFrame, ids=()) -> DataFrame:
    """One row of those that are equal in all columns but `ids`: the one with the smallest ids."""
    ids = [c for c in ids if c in df.columns]
    if not ids:
        return df.dropDuplicates()
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ids]
    first = F.min(F.struct(*[F.col(f"`{c}`") for c in ids])).alias("_first")
    return df.groupBy(*rest).agg(first).select(*[F.col(f"_first.`{c}`") if c in ids else F.col(f"`{c}`") for c in df.columns])


def clean(df: DataFrame, keep=()) -> DataFrame:
    """Floats, complete rows, no exact repeats. Columns in `keep` are ids: they stay as they are and
    do not tell two rows apart."""
    return drop_repeats(drop_incomplete(to_float32(df, keep)), keep)


def with_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """A whole number from each row's content, the same in every run. The rows must differ (see
    `drop_repeats`); the few that share a hash get a second one by their order."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumn(out, F.shiftrightunsigned(F.xxhash64(*columns), 1))
    shared = small_side(hashed.groupBy(out).agg(F.count("*").alias("_n")).where("_n > 1").select(out))
    order = Window.partitionBy(out).orderBy(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    again = hashed.join(shared, out, "left_semi").withColumn("_place", F.row_number().over(order))
    again = again.withColumn(out, F.shiftrightunsigned(F.xxhash64(out, "_place"), 1)).drop("_place")
    return hashed.join(shared, out, "left_anti").unionByName(again)


def drop_irrelevant(df: DataFrame) -> DataFrame:
    """Without the identifier and constant columns, as far as they are there."""
    return df.drop(*IDENTIFIER_COLUMNS, *CONSTANT_COLUMNS)


def class_counts(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def drop_rare_classes(df: DataFrame, label: str = "Label", minimum: int = 5) -> DataFrame:
    """Without the classes that have fewer than `minimum` rows. A null label is no class; its rows stay."""
    rare = class_counts(df, label).where((F.col("n") < minimum) & F.col(label).isNotNull())
    return df.join(small_side(rare.select(label)), label, "left_anti")


def with_target(df: DataFrame, mode: str = "binary", label: str = "Label", out: str = "target") -> DataFrame:
    """Binary: 0 for benign, else 1. Multiclass: the trimmed class name. Drops the label column."""
    name = F.trim(F.col(label).cast("string"))
    if mode == "binary":
        target = F.when(F.upper(name) == "BENIGN", F.lit(0)).otherwise(F.lit(1))
    elif mode == "multiclass":
        target = name
    else:
        raise ValueError("mode must be 'binary' or 'multiclass'")
    return df.withColumn(out, target).drop(label)


def with_protocol(df: DataFrame, column: str = "Protocol") -> DataFrame:
    """One notation for the protocol, in training as in detection."""
    return df.withColumn(column, protocol_number(F.col(column).cast("string"))) if column in df.columns else df


def feature_columns(df: DataFrame, categorical=("Protocol",), leave=("target", "row_id")):
    """(numeric feature names, categorical feature names)."""
    cat = [c for c in categorical if c in df.columns]
    return [c for c in numeric_columns(df) if c not in cat and c not in leave], cat


def with_class_weights(df: DataFrame, label: str = "target", out: str = "weight") -> DataFrame:
    """Balanced weights: rows / (classes x rows of the class)."""
    counts = class_counts(df, label)
    whole = counts.agg(F.sum("n").alias("_rows"), F.count("*").alias("_classes")).first()
    weights = counts.select(label, (F.lit(float(whole["_rows"] or 0))
                                    / (F.lit(whole["_classes"]) * F.col("n"))).alias(out))
    return df.join(small_side(weights), label)
