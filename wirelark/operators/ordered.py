"""Ordered operators (running sum, previous/next value, rank) that survive a hot key.

A window partitioned by a key puts the whole key into one task. Here a key is cut into chunks
first: every row whose hashed position is 0 modulo `chunk_rows` opens a new chunk of its key, so a
key of n rows gets about n / chunk_rows chunks and a small key none. The window then runs per
(key, chunk) and a small table, one row per chunk, carries the value across chunk borders.

The table of openings holds about (rows / chunk_rows) entries whatever the key distribution is; it
is counted before it is broadcast and `chunk_rows` is doubled until it fits MAX_OPENINGS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_ROWS_CONF = "wirelark.chunkRows"
DEFAULT_CHUNK_ROWS = 2_000_000
MAX_OPENINGS = 500_000
WHOLE = -1                      # as `chunk_rows`: keys are known to be small, do not look

CHUNK = "_chunk"
OPENINGS = "_openings"


def chunk_rows_setting(df: DataFrame, chunk_rows: int | None = None) -> int:
    if chunk_rows:
        return chunk_rows
    return int(df.sparkSession.conf.get(CHUNK_ROWS_CONF, str(DEFAULT_CHUNK_ROWS)))


def _position(order) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _openings_before(openings: Column, position: Column) -> Column:
    """How many entries of a sorted array are <= position: a binary search with a fixed number of
    halving steps, so its cost is logarithmic in the number of chunks."""
    steps = list(range(MAX_OPENINGS.bit_length(), -1, -1))
    widths = F.array(*[F.lit(1 << s) for s in steps])

    def halve(found, width):
        probe = found + width
        inside = probe <= F.size(openings)
        return F.when(inside, F.when(F.get(openings, probe - 1) <= position, probe)
                      .otherwise(found)).otherwise(found)

    return F.aggregate(widths, F.lit(0), halve)


def worth_splitting(df: DataFrame, order) -> bool:
    """Would any chunk open in this table? Where several ordered steps follow on the same rows, one
    look spares them theirs: if not, they can be given chunk_rows=WHOLE."""
    rows = chunk_rows_setting(df)
    return not df.select(*order).where(F.pmod(F.xxhash64(*order), F.lit(rows)) == 0).isEmpty()


def with_chunks(df: DataFrame, keys, order, chunk_rows: int | None = None,
                probe: DataFrame | None = None):
    """Returns (df + `_chunk` [+ `_openings`], was anything split). Keys must not be null and
    `order` must identify a row within its key well enough to spread ties.

    An opening is only a position, so any table with the same keys and about the same positions
    will do to choose them: `probe` is one that is cheaper to compute than `df`."""
    rows = chunk_rows_setting(df, chunk_rows)
    if rows == WHOLE:
        return df.withColumn(CHUNK, F.lit(0)), False
    source = (df if probe is None else probe).select(*keys, *order)
    while True:
        opening_rows = (source.where(F.pmod(F.xxhash64(*order), F.lit(rows)) == 0)
                          .select(*keys, _position(order).alias("_at")))
        found = opening_rows.limit(MAX_OPENINGS + 1).count()
        if found <= MAX_OPENINGS:
            break
        rows *= 2
    if found == 0:
        return df.withColumn(CHUNK, F.lit(0)), False
    table = opening_rows.groupBy(*keys).agg(F.sort_array(F.collect_set("_at")).alias(OPENINGS))
    chunked = df.join(F.broadcast(table), list(keys), "left").withColumn(
        CHUNK, F.when(F.col(OPENINGS).isNull(), F.lit(0))
                .otherwise(_openings_before(F.col(OPENINGS), _position(order))))
    return chunked, True


def _attach(chunked: DataFrame, carry: DataFrame, keys) -> DataFrame:
    """Joins the per-chunk carry; it has at most one row per opening plus one per split key."""
    return chunked.join(F.broadcast(carry), [*keys, CHUNK], "left")


def running_sums(df: DataFrame, keys, order, sums: dict[str, Column],
                 chunk_rows: int | None = None, probe: DataFrame | None = None) -> DataFrame:
    """Adds sum(expr) over (partition by keys order by order rows up to the current one)."""
    keys, order = list(keys), list(order)
    chunked, split = with_chunks(df, keys, order, chunk_rows, probe)
    inside = (Window.partitionBy(*keys, CHUNK).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if not split:
        out = chunked.select(*df.columns, *[F.sum(e).over(inside).alias(n) for n, e in sums.items()])
        return out
    totals = (chunked.where(F.col(OPENINGS).isNotNull()).groupBy(*keys, CHUNK)
              .agg(*[F.sum(e).alias(n) for n, e in sums.items()]))
    earlier = (Window.partitionBy(*keys).orderBy(CHUNK)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*keys, CHUNK, *[
        F.sum(n).over(earlier).alias(f"_before_{n}") for n in sums])
    return _attach(chunked, carry, keys).select(*df.columns, *[
        (F.sum(e).over(inside) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n)
        for n, e in sums.items()])


def neighbours(df: DataFrame, keys, order, value: str, previous: str | None = None,
               following: str | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Adds the value of the previous and/or the following row of the key (null at the ends)."""
    keys, order = list(keys), list(order)
    chunked, split = with_chunks(df, keys, order, chunk_rows)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    near = {}
    if previous:
        near[previous] = F.lag(value).over(inside)
    if following:
        near[following] = F.lead(value).over(inside)
    if not split:
        return chunked.select(*df.columns, *[e.alias(n) for n, e in near.items()])
    ends = (chunked.where(F.col(OPENINGS).isNotNull()).groupBy(*keys, CHUNK)
            .agg(F.min_by(value, _position(order)).alias("_first"),
                 F.max_by(value, _position(order)).alias("_last")))
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    carry = ends.select(*keys, CHUNK, F.lag("_last").over(chunks).alias("_carry_previous"),
                        F.lead("_first").over(chunks).alias("_carry_following"))
    border = {previous: "_carry_previous", following: "_carry_following"}
    return _attach(chunked, carry, keys).select(*df.columns, *[
        F.coalesce(e, F.col(border[n])).alias(n) for n, e in near.items()])


def rank_within(df: DataFrame, keys, order, name: str, chunk_rows: int | None = None) -> DataFrame:
    """Adds a 1-based row number within the key by the given order (order must be unique)."""
    return running_sums(df, keys, order, {name: F.lit(1)}, chunk_rows)
