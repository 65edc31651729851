"""Mixing sources to target weights: hierarchical token budgets and seeded epochs, all in DataFrames.

Weights are propagated down a tree (such as domain, language, source). A node that has fewer tokens
than its share, in all its epochs together, gets what it has; what it lacks goes to its siblings by
their weights, and only when all siblings are used up to the siblings of an ancestor. A leaf is read
in epochs, each in an order of its own given by a seeded hash: whole epochs first, then the prefix
of the next one that fits into what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelark.llm.shared import Scratch
from wirelark.operators.bounded import small_side

BUCKETS_LOG2 = 12
_HASH_BITS = 60


@dataclass
class Level:
    """One level of the tree: a column's value for each row, and the weight (a whole number, 0 or
    more) of the node with that value among its siblings. A null value is a node of its own."""
    name: str
    value: Column
    weight: Column


def word_count(text: str = "text") -> Column:
    """Words between blanks; a null text has none. The default measure of a document's tokens."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t-\\r]+"), "")).cast("long")


def _key(value: Column) -> Column:
    """Text that differs for null and every value."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def _whole(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)")


def seeded(seed: int, epoch: Column, doc_id: str) -> Column:
    """A hash below 2**60 of the epoch and the row's id, the same in any engine with md5."""
    text = F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, _HASH_BITS // 4), 16, 10).cast("long")


def allot(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Shares out each parent's `budget` among its children (weight w, capacity cap): adds `given`.

    A child is saturated if the level at which it is full is no higher than that which the budget
    reaches; the others share the rest by weight, rounded down. Whole numbers throughout.
    """
    by = Window.partitionBy(*parent)
    rising = by.orderBy((F.col("cap") / F.col("w")).asc(), F.col(key))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    open_ = nodes.where("w > 0").withColumn("full_before", F.coalesce(F.sum(_whole("cap")).over(before), _whole(F.lit(0)))) \
        .withColumn("weight_onward", F.sum(_whole("w")).over(onward)) \
        .withColumn("full", _whole("full_before") * _whole("w") + _whole("cap") * _whole("weight_onward") <= _whole("budget") * _whole("w"))
    rest = F.sum(F.when(F.col("full"), _whole("cap"))).over(by)
    weights = F.sum(F.when(~F.col("full"), _whole("w"))).over(by)
    share = F.expr("cast(left_over * cast(w as decimal(38,0)) div free_weight as bigint)")
    return (open_.withColumn("left_over", _whole("budget") - F.coalesce(_whole(rest), _whole(F.lit(0))))
            .withColumn("free_weight", _whole(weights))
            .withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(share))
            .drop("full_before", "weight_onward", "full", "left_over", "free_weight"))


def leaf_budgets(leaves: DataFrame, keys: list[str], weights: list[str], share: float, epochs: int) -> DataFrame:
    """`given` for every leaf (its keys, weights and `tokens`), of share * all tokens in whole numbers."""
    total = leaves.agg(F.coalesce(F.floor(F.sum("tokens") * F.lit(share)), F.lit(0)).cast("long").alias("budget"))
    above = total
    for i, key in enumerate(keys):
        nodes = leaves.groupBy(*keys[:i + 1]).agg(
            (F.sum("tokens") * F.lit(epochs)).alias("cap"), F.max(weights[i]).alias("w"))
        nodes = nodes.join(above, keys[:i]) if i else nodes.crossJoin(F.broadcast(total))      # one row
        above = allot(nodes, keys[:i], key).select(*keys[:i + 1], F.col("given").alias("budget"))
    return leaves.join(above, keys, "left").withColumn("given", F.coalesce("budget", F.lit(0).cast("long"))).drop("budget")


def mix(docs: DataFrame, levels: list[Level], share: float = 1.0, epochs: int = 2, seed: int = 1,
        tokens: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the mixture, once for each epoch in which they are read: adds `epoch` (from 0)
    and `n_tokens`; columns of these names are replaced.

    The budget is `share` of all tokens of the input. No row is read in more than `epochs` epochs.
    Rows with the same id and text are read together or not at all. Rows whose id is null take part.
    An empty input gives no rows.
    """
    docs = docs.drop("epoch", "n_tokens")
    keys, weights = [f"_k{i}" for i in range(len(levels))], [f"_w{i}" for i in range(len(levels))]
    marked = docs.select(
        *docs.columns, *[_key(x.value).alias(k) for x, k in zip(levels, keys)],
        *[F.coalesce(x.weight.cast("long"), F.lit(1).cast("long")).alias(w) for x, w in zip(levels, weights)],
        (word_count(text) if tokens is None else tokens).alias("n_tokens"))
    tie = F.md5(F.coalesce(F.col(text), F.lit("")))
    scratch = Scratch(docs.sparkSession, "mixing")
    narrow = scratch.table("narrow", marked.select(*keys, *weights, F.col(doc_id).alias("_id"), tie.alias("_tie"), "n_tokens"))

    leaves = narrow.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), *[F.max(w).alias(w) for w in weights])
    plan = leaf_budgets(scratch.table("leaves", leaves), keys, weights, share, epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.lit(0)).cast("long")
    plan = scratch.table("plan", plan.withColumn("whole", whole)
                         .withColumn("rest", F.when(F.col("whole") < epochs, F.col("given") - F.col("whole") * F.col("tokens")).otherwise(F.lit(-1)))
                         .select(*keys, "whole", F.col("rest").cast("long").alias("rest")))

    # The border of each leaf's last prefix: first its bucket of hashes, then the row within the bucket.
    bucket = F.shiftright("h", _HASH_BITS - BUCKETS_LOG2)
    placed = narrow.join(small_side(plan, 20_000), keys).withColumn("h", seeded(seed, F.col("whole"), "_id")).withColumn("bucket", bucket)
    sums = placed.groupBy(*keys, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("n").over(upto)).where("upto > rest")
    border = sums.groupBy(*keys).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("b")) \
        .select(*keys, F.col("b.bucket").alias("border"), F.col("b.before").alias("before"))
    border = scratch.table("border", border)
    within = placed.join(small_side(border, 20_000), keys).where(F.col("bucket") == F.col("border"))
    within = within.groupBy(*keys, "h", "_id", "_tie").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    order = Window.partitionBy(*keys).orderBy("h", "_id", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    fits = within.withColumn("upto", F.col("before") + F.sum("n").over(order)).where("upto <= rest")
    cut = fits.groupBy(*keys).agg(F.max(F.struct("h", "_id", "_tie")).alias("cut"))
    final = scratch.table("final", plan.join(border, keys, "left").join(cut, keys, "left").select(*keys, "whole", "rest", "border", "cut"))

    chosen = marked.drop(*weights).join(small_side(final, 20_000), keys).withColumn("_h", seeded(seed, F.col("whole"), doc_id))
    at = F.shiftright("_h", _HASH_BITS - BUCKETS_LOG2)
    mine = F.struct(F.col("_h").alias("h"), F.col(doc_id).alias("_id"), tie.alias("_tie"))
    inside = (F.when(F.col("rest") < 0, F.lit(False)).when(F.col("border").isNull() | (at < F.col("border")), F.lit(True))
              .when(at == F.col("border"), F.coalesce(mine <= F.col("cut"), F.lit(False))).otherwise(F.lit(False)))
    times = F.col("whole") + inside.cast("long")
    return (chosen.withColumn("_times", times).where("_times > 0")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
            .select(*docs.columns, "epoch", "n_tokens"))
