"""Broadcasts only what was counted to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_SMALL_ROWS = 200_000


def small_side(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most `max_rows` rows; otherwise as it is, so
    the join shuffles both sides and adaptive execution splits skewed keys."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def few_values(df: DataFrame, column: str, max_rows: int = 10_000) -> list:
    """The distinct values of a column that is known to have few, such as classes; more than
    `max_rows` are an error."""
    rows = df.select(column).distinct().limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{column} has more than {max_rows} distinct values")
    return [r[0] for r in rows]
