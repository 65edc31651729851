"""Merkle manifest of a dataset: a tree of digests per group, a tree of their roots, and proofs by descent.

A leaf is the digest of a row. The leaves of a group, in order, are hashed in runs of `FAN` (the last run may
be shorter) until one node remains; the nodes of the groups, in the groups' order, are hashed likewise.
Every inner node is a record (digest, children), stored once whatever number of places it has.

Proofs are made from the records alone: a request for a leaf starts at the root, follows the digits of the
group's number and of the leaf's rank in base FAN, and keeps the children that it does not follow; reversed,
these segments are the siblings from the leaf upwards. Requests below one node share its way, so a level is
joined once for each of its nodes and only the last step has a row for each leaf.

Leaves are ranked by a range sort and an offset for each partition and group, so one group may hold most of
the rows. Nulls are values of their own; rows with the same id are ordered by their digest, and whole copies
are leaves of their own. Other columns of the input are not looked at. An empty table has no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirelark.llm.shared import Scratch
from wirelark.operators.bounded import small_side

FAN, DIGIT = 8, 3                  # children of a node, and the bits of a place among them
FEW = 4096                         # nodes of a level at most that are broadcast
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after another, in lower-case hex."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def field(value: Column) -> Column:
    """A value without ambiguity: `-` for null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """The leaf of a row with COLUMNS, some of them replaced."""
    return digest(*[field(changed.get(c, F.col(c))) for c in COLUMNS])


def ranked(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with `rank`, from 0, within their group, and the groups with their `size`.

    The rows are range sorted by (group, order) and stored with their place; a partition holds a run of
    places of each of its groups, whose first one and number are all that has to be known of it."""
    sorted_ = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    stored = scratch.table(name, sorted_)
    part = F.shiftright("_at", 33)
    runs = scratch.table(f"{name}-runs", stored.groupBy(F.col(group).alias("_group"), part.alias("_run")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n")))
    before = runs.select(F.col("_group").alias("_other"), F.col("_run").alias("_earlier"), F.col("_n").alias("_m"))
    offsets = (runs.join(before, F.col("_group").eqNullSafe(F.col("_other")) & (F.col("_earlier") < F.col("_run")), "left")
               .groupBy("_group", "_run", "_first").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_before")))
    ranks = (stored.withColumn("_part", part).join(
        small_side(offsets), (F.col("_part") == F.col("_run")) & F.col(group).eqNullSafe(F.col("_group")))
        .withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")))
    return ranks.select(*rows.columns, "rank"), runs.groupBy(F.col("_group").alias(group)).agg(F.sum("_n").alias("size"))


def height_of(size: int) -> int:
    """Levels above the leaves of a tree."""
    height = 0
    while size > 1:
        size, height = -(-size // FAN), height + 1
    return height


def build(leaves: DataFrame, tallest: int, scratch: Scratch, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, digest of its last node) and, level by level, the records (digest, children).

    `leaves` has tree, rank, size (of the tree) and digest. A tree that has come down to one node waits."""
    nodes, levels = leaves.select("tree", "rank", F.col("size").alias("left"), "digest"), []
    done = nodes.where("left = 1")
    for level in range(tallest):
        runs = (nodes.where("left > 1").groupBy("tree", F.shiftright("rank", DIGIT).alias("rank"))
                .agg(F.max("left").alias("_left"), F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("_run")))
        made = runs.select("tree", "rank", F.ceil(F.col("_left") / FAN).alias("left"), F.col("_run.digest").alias("children"))
        made = scratch.table(f"{name}-{level}", made.withColumn("digest", digest(F.array_join("children", ""))))
        levels.append(made.groupBy("digest").agg(F.first("children").alias("children")))
        nodes = made.select("tree", "rank", "left", "digest")
        done = done.unionByName(nodes.where("left = 1"))
    return done.select("tree", "digest"), levels


def descend(start: DataFrame, levels: list[DataFrame], scratch: Scratch, name: str) -> DataFrame:
    """From tree tops (`way`, `height`, `digest`, `path`) to the records above the leaves.

    `way` is the rank so far, `path` the segments so far, from the top. Rows with height 0 are leaves
    themselves. Comes back with the same columns, at the height 1 or 0."""
    at, arrived = start, start.where("height <= 1")
    for level in range(len(levels) - 1, 0, -1):
        here = at.where(F.col("height") == level + 1)
        step = small_side(here, FEW).join(levels[level], "digest").select(
            *[c for c in start.columns if c not in ("way", "height", "digest", "path")], "path", "way", "height",
            "children", F.posexplode("children").alias("digit", "digest"))
        down = step.withColumns({
            "way": F.shiftleft("way", DIGIT) + F.col("digit"), "height": F.col("height") - 1,
            "path": F.concat("path", F.array(F.struct("children", "digit")))}).select(*start.columns)
        down = scratch.table(f"{name}-{level}", down.unionByName(at.where((F.col("height") > 1) & (F.col("height") != level + 1))))
        arrived = arrived.unionByName(down.where("height = 1"))
        at = down.where("height > 1")
    return arrived


PATH = "array<struct<children: array<string>, digit: int>>"


def folded(leaf: Column, upwards: Column) -> Column:
    """The digest at the top, from a leaf and the segments from the leaf upwards."""
    def up(now, step):
        chosen = F.transform(step["children"], lambda c, i: F.when(i == step["digit"], now).otherwise(c))
        return F.sha2(F.array_join(chosen, "").cast("binary"), 256)
    return F.aggregate(upwards, leaf, up)


def siblings(upwards: Column) -> Column:
    """The digests of all siblings, from the leaf upwards and from left to right, in one string."""
    return F.array_join(F.flatten(F.transform(upwards, lambda step: F.filter(step["children"], lambda c, i: i != step["digit"]))), "")


def manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """(group, order, carried, leaf, subroot, root, upwards) for every row of (group, order, leaf, carried):
    its tree's last node, the root of all, and the segments of its proof from the leaf upwards."""
    scratch = Scratch(rows.sparkSession, "merkle")
    columns = [group, order, "leaf", *carried]
    leaves, sizes = ranked(rows.select(*columns), group, [order, "leaf", *carried], scratch, "leaves")
    trees, _ = ranked(sizes.withColumn("_all", F.lit(0)), "_all", [group], scratch, "trees")
    trees = scratch.table("numbered", trees.select(F.col(group).alias("_group"), F.col("rank").alias("tree"), "size"))
    few = trees.agg(F.count("*").alias("n"), F.max("size").alias("most")).first()
    leaves = scratch.table("ranked", leaves.join(small_side(trees), F.col(group).eqNullSafe(F.col("_group"))).drop("_group"))

    tops, levels = build(leaves.withColumnRenamed("leaf", "digest"), height_of(few.most or 0), scratch, "nodes")
    tops = scratch.table("tops", tops)
    root, upper = build(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("rank"), F.lit(few.n).alias("size"), "digest"),
                        height_of(few.n), scratch, "upper")

    # down to the trees, then down inside them
    none = F.array().cast(PATH)
    start = root.select(F.lit(0).cast("long").alias("way"), F.lit(height_of(few.n)).alias("height"), "digest", none.alias("path"), F.col("digest").alias("root"))
    found = descend(start, upper, scratch, "down-upper")
    if few.n > 1:
        found = found.join(upper[0], "digest").select("way", "path", "root", "children", F.posexplode("children").alias("digit", "digest")).select(
            (F.shiftleft("way", DIGIT) + F.col("digit")).alias("way"), "digest", "root",
            F.concat("path", F.array(F.struct("children", "digit"))).alias("path"))
    sizes = small_side(trees.select(F.col("tree").alias("way"), "size"))
    height = F.lit(0)
    for h in range(1, height_of(few.most or 0) + 1):
        height = F.when(F.col("size") > FAN ** (h - 1), F.lit(h)).otherwise(height)
    start = found.select("way", "digest", "root", "path").join(sizes, "way").select(
        F.col("way").alias("tree"), F.lit(0).cast("long").alias("way"), height.alias("height"), "digest", "path", "root",
        F.col("digest").alias("subroot"))
    start = scratch.table("starts", start)
    found = descend(start, levels, scratch, "down")
    last = found.where("height = 1")
    if levels:
        last = last.join(levels[0], "digest").drop("digest")
        lone = found.where("height = 0").drop("digest").withColumn("children", F.lit(None).cast("array<string>"))
        last = last.unionByName(lone)
    else:
        last = found.drop("digest").withColumn("children", F.lit(None).cast("array<string>"))
    last = last.select(F.col("tree").alias("_tree"), F.col("way").alias("_way"), "path", "children", "root", "subroot")
    digit = F.col("rank").bitwiseAND(F.lit(FAN - 1)).cast("int")
    own = F.when(F.col("children").isNotNull(), F.concat("path", F.array(F.struct("children", digit.alias("digit"))))).otherwise(F.col("path"))
    leaves = leaves.withColumn("_up", F.shiftright("rank", DIGIT))
    return leaves.join(last, (F.col("tree") == F.col("_tree")) & (F.col("_up") == F.col("_way"))).select(
        *columns, "subroot", "root", F.reverse(own).alias("upwards"))
