"""Near duplicates by MinHash: banded minima of universal hashes, links confirmed on whole sets, components.

A text's set holds its distinct shingles of five words. 192 hash functions (a * x + b, upper half) give
it 192 minima, cut into 32 bands of 6; texts that agree on a band share a bucket. A pair of similarity
0.85 shares none with chance (1 - 0.85 ** 6) ** 32, 3 in ten million. Candidates are first held against
each other by a byte of each of their minima, then by their sets, so every link is exact.

Pairs of a bucket are never written out. A bucket first compares its members with a centre, in a few
rounds; what one centre links is one component, and a bucket in one component is done. Of the rest go all
texts that cannot be linked: those with too many shingles that no other open text has. Only what is then
still open is compared all with all, in tiles inside tasks.

Null, empty and wordless texts have no shingles and are linked with nothing; a text of one to four words
is one shingle. Rows with the same text, or the same doc_id, are rows of one class. A null doc_id names
no component. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from wirelark.llm import shingles, texts
from wirelark.llm.shared import Scratch
from wirelark.llm.simhash import forest
from wirelark.operators.bounded import small_side


@dataclass(frozen=True)
class Settings:
    """Links have at least `over` of `under` parts of their union in common."""
    over: int = 85
    under: int = 100
    bands: int = 32
    rows: int = 6
    rounds: int = 2                # centres that a bucket tries before its rest is filtered and tiled
    tile: int = 256                # open members of a bucket in one tile, about
    seed: int = 42

    @property
    def agreeing(self) -> int:
        """The least agreeing bytes of two signatures; a link has fewer with chance 1 in ten million."""
        k, s = self.bands * self.rows, self.over / self.under
        return max(0, math.floor(k * s - 5.5 * math.sqrt(k * s * (1 - s))))

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        draw, k = np.random.default_rng(self.seed), self.bands * self.rows
        return (draw.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, k, dtype=np.uint64))


SPREAD = 4096                      # rows of one key that a join may send to one task, about
PIECE = 1 << 20                    # edges that a task reduces to stars at a time, about


def minima(hashes: np.ndarray, first: np.ndarray, settings: Settings) -> np.ndarray:
    """Sets x functions: the least hash (32 bits) of each set that is not empty."""
    begin = first[:-1][np.diff(first) > 0]
    factors, terms = settings.functions()
    out = np.empty((len(begin), len(factors)), np.uint32)
    if len(begin):
        room = np.empty_like(hashes)
        for i, (a, b) in enumerate(zip(factors, terms)):
            np.multiply(hashes, a, out=room)
            np.add(room, b, out=room)
            out[:, i] = np.minimum.reduceat(room, begin) >> np.uint64(32)
    return out


def buckets(least: np.ndarray, settings: Settings) -> np.ndarray:
    """Sets x bands: the bucket of each band."""
    out = np.tile(np.arange(1, settings.bands + 1, dtype=np.uint64), (len(least), 1))
    for j in range(settings.rows):
        out = texts.mix(out * np.uint64(0x9E3779B97F4A7C15) + least[:, j::settings.rows])
    return out


def _marked(docs: DataFrame, doc_id: str, text: str, settings: Settings) -> DataFrame:
    """(doc_id, key of the set, n of its shingles, bands) of every row."""
    schema = StructType([docs.schema[doc_id], StructField("key", LongType()), StructField("n", LongType()), StructField("bands", ArrayType(LongType()))])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in texts.blocks(batch, text):
                hashes, first = shingles.shingles_of(data, offsets)
                n = np.diff(first)
                found = buckets(minima(hashes, first, settings), settings)
                cuts = np.concatenate([[0], np.cumsum(np.where(n > 0, settings.bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(doc_id), pa.array(shingles.keys_of(hashes, first).view(np.int64)), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.ravel().view(np.int64)))], [doc_id, "key", "n", "bands"])
    return docs.select(*dict.fromkeys([doc_id, text])).mapInArrow(run, schema)


def _sets(whole: DataFrame, text: str, settings: Settings) -> DataFrame:
    """(key, signature, shingles) of every row, as bytes."""
    schema = StructType([StructField("key", LongType()), StructField("signature", BinaryType()), StructField("shingles", BinaryType())])

    def run(batches):
        for batch in batches:
            for _, data, offsets in texts.blocks(batch, text):
                hashes, first = shingles.shingles_of(data, offsets)
                some = np.flatnonzero(np.diff(first))
                low = minima(hashes, first, settings).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingles.keys_of(hashes, first)[some].view(np.int64)), pa.array([s.tobytes() for s in low], pa.binary()),
                     pa.array([hashes[first[i]:first[i + 1]].tobytes() for i in some], pa.binary())], ["key", "signature", "shingles"])
    return whole.select(text).mapInArrow(run, schema)


def hot_values(rows: DataFrame, on: str) -> DataFrame | None:
    """The values of `on` that many rows have, each with the tasks to deal its rows over; None if there are none."""
    hot = (rows.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * SPREAD)
           .select(F.col(on).alias("_hot"), (F.col("_n") / SPREAD).cast("int").alias("_parts")))
    return None if hot.isEmpty() else small_side(hot)


def dealt(rows: DataFrame, side: DataFrame, on: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Joins `side`, with one row for each value of `on`, to `rows`; the rows of a hot value are dealt over
    several tasks, each with a copy of its row of `side`."""
    if hot is None:
        return rows.join(side, on, how)
    parts = F.coalesce("_parts", F.lit(1))
    spread = (rows.join(hot, F.col(on) == F.col("_hot"), "left")
              .withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("_hot", "_parts"))
    copies = (side.join(hot, F.col(on) == F.col("_hot"), "left")
              .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts"))
    return spread.join(copies, [on, "_part"], how).drop("_part")


def attach(rows: DataFrame, side: DataFrame, on: str) -> DataFrame:
    """`dealt` by the hot values of `rows`, which are read twice and so had better be stored."""
    return dealt(rows, side, on, hot_values(rows, on))


def comparable(one: str, other: str, settings: Settings) -> Column:
    """Whether sets of these sizes can be linked at all."""
    return F.least(one, other) * settings.under >= F.greatest(one, other) * settings.over


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) of set keys, a stored table, that are links: signatures first, then the whole sets of those that pass."""
    hot = hot_values(pairs, "a")
    least, over, under = settings.agreeing, settings.over, settings.under

    def agree(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    def linked(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(under * common >= over * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for column, check in (("signature", agree), ("shingles", linked)):
        x, y = (sets.select(F.col("key").alias(k), F.col(column).alias(v)) for k, v in (("a", "x"), ("b", "y")))
        pairs = dealt(pairs.join(y, "b"), x, "a", hot).select("a", "b", "x", "y").mapInArrow(check, "a long, b long")
    return pairs


def _stars_of(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges as stars: from the least node of each component that they form to each of its others, by rising node."""
    nodes, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    label = forest(at[:len(lo)], at[len(lo):], len(nodes))
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[far]], nodes[far]


def _in_stars(edges: DataFrame) -> DataFrame:
    """The edges (lo, hi) of each task as stars, in pieces that do not part neighbouring rows of one `hi`."""
    most = PIECE

    def reduced(lo, hi):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars_of(lo, hi)], ["lo", "hi"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column("lo").to_numpy(), batch.column("hi").to_numpy()))
            size += batch.num_rows
            if size >= most:
                lo, hi = (np.concatenate(x) for x in zip(*held))
                cut = int(np.flatnonzero(np.append(True, hi[1:] != hi[:-1]))[-1])
                if cut:
                    yield reduced(lo[:cut], hi[:cut])
                held, size = [(lo[cut:], hi[cut:])], size - cut
        if size:
            yield reduced(*(np.concatenate(x) for x in zip(*held)))
    return edges.select("lo", "hi").mapInArrow(run, "lo long, hi long")


def _left_to_do(edges: DataFrame) -> tuple[int, int]:
    """How many nodes have a smaller neighbour and another one, and how many have so many larger ones that a join must deal them."""
    nodes = edges.selectExpr("stack(2, lo, 0, hi, 1) AS (node, above)").groupBy("node").agg(F.count("*").alias("n"), F.sum("above").alias("above"))
    return tuple(nodes.agg(F.count_if((F.col("above") > 0) & (F.col("n") > 1)), F.count_if(F.col("n") - F.col("above") > 2 * SPREAD)).first())


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots: the least node that it reaches.

    Tasks make stars of the edges they hold, so a node then has at most one smaller neighbour from each. Large star:
    every node links its larger neighbours to the least node it knows; small star: the edges meet by their larger
    node and become stars again. This goes on until all edges together are stars. A hub's edges are dealt over tasks.
    """
    scratch = Scratch(edges.sparkSession, "stars")
    now = scratch.table("edges-0", _in_stars(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi")))
    for n in range(1, 200):
        open_nodes, hubs = _left_to_do(now)
        if not open_nodes:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        # of a node's neighbours the least smaller one, if any, else the node itself
        least = now.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("least"))
        large = dealt(now, least, "lo", hot_values(now, "lo") if hubs else None, "left").select(F.coalesce("least", "lo").alias("lo"), "hi")
        now = scratch.table(f"edges-{n}", _in_stars(large.repartition("hi").sortWithinPartitions("hi")))
        scratch.drop(f"edges-{n - 1}")
    raise RuntimeError("the components of the links did not settle")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the least node that it reaches."""
    found = stars(edges)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _open(members: DataFrame) -> DataFrame:
    """The members of those buckets that lie in several components."""
    several = members.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi")
    return members.join(several.select("bucket"), "bucket", "left_semi")


def _can_link(members: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The keys that can be linked to another open one. The shingles that no other open text has are not in
    any intersection, so a text with too many of them is out, by exact counts and whatever else it holds."""
    def run(batches):
        for batch in batches:
            for key, s in zip(batch.column("key"), batch.column("shingles")):
                values = np.frombuffer(s.as_buffer(), np.int64)
                for i in range(0, len(values), 1 << 16):
                    part = values[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.repeat(key, len(part))], ["shingle", "key"])
    keys = members.select("key", "n").distinct()
    spread = sets.join(keys, "key", "left_semi").select("key", "shingles").mapInArrow(run, "shingle long, key long")
    single = spread.groupBy("shingle").agg(F.count("*").alias("_n"), F.min("key").alias("key")).where("_n = 1").groupBy("key").agg(F.count("*").alias("own"))
    return keys.join(single, "key", "left").where((F.col("n") - F.coalesce("own", F.lit(0))) * settings.under >= F.col("n") * settings.over).select("key")


def tile_links(table: pa.Table, settings: Settings) -> pa.Table:
    """Edges (a, b) that connect whatever the links between the rows (key, shingles) connect."""
    keys = table.column("key").to_numpy()
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
    size, order = np.array([len(s) for s in sets]), np.argsort(np.concatenate(sets), kind="stable")
    values, owner = np.concatenate(sets)[order], np.repeat(np.arange(len(sets)), size)[order]
    common = np.zeros((len(sets), len(sets)), np.int32)
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    for lo in range(0, len(begin), 2048):                  # 2,048 shingles at a time, as columns of zeros and ones
        b, e = begin[lo], begin[lo + 2048] if lo + 2048 < len(begin) else len(values)
        has = np.zeros((len(sets), 2048), np.float32)
        has[owner[b:e], np.searchsorted(begin[lo:lo + 2048], np.arange(b, e), "right") - 1] = 1
        common += (has @ has.T).astype(np.int32)
    a, b = np.nonzero(np.triu(settings.under * common.astype(np.int64) >= settings.over * (size[:, None] + size - common), 1))
    label = forest(a, b, len(sets))
    moved = np.flatnonzero(label != np.arange(len(sets)))
    return pa.table({"a": keys[label[moved]], "b": keys[moved]})


def rest_links(members: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): edges that connect the links inside the open buckets, all with all in tiles."""
    apart = _open(members.join(_can_link(members, sets, settings), "key", "left_semi"))
    # several bands often hold the same members: one of them will do
    same = (apart.groupBy("bucket").agg(F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("_sum"), F.count("*").alias("_size"))
            .groupBy("_sum", "_size").agg(F.min("bucket").alias("bucket")))
    parts = (F.col("_size") / settings.tile).cast("int")
    placed = (apart.join(same.select("bucket", parts.alias("last")), "bucket")
              .withColumn("part", F.pmod(F.xxhash64("key"), F.col("last") + 1).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), "last"))))
    tiles = placed.select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "key")
    return (tiles.join(sets.select("key", "shingles"), "key").groupBy("bucket", "lo", "hi")
            .applyInArrow(lambda t: tile_links(t, settings), "a long, b long").distinct())


def links(classes: DataFrame, docs: DataFrame, doc_id: str, text: str, settings: Settings, scratch: Scratch,
          more: DataFrame | None = None) -> DataFrame:
    """(node, root) of all set keys that are linked to a smaller one, directly or not; `classes` has key, n, bands and first_id.
    `more` are candidates (a, b) from elsewhere, as many as there are sets at most, about."""
    spread = classes.select("key", "n", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket")
    members = scratch.table("members-0", spread.join(shared, "bucket", "left_semi").withColumn("root", F.col("key")))
    needed = members.select("key")
    if more is not None:
        needed = needed.unionByName(more.select(F.explode(F.array("a", "b")).alias("key")))
    needed = needed.distinct()
    ids = classes.join(needed, "key").select(F.col("first_id").alias("_id")).distinct()
    whole = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).join(ids, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi")
    sets = scratch.table("sets", _sets(whole, "text", settings).join(needed, "key", "left_semi").dropDuplicates(["key"]))

    scratch.release()
    roots = None
    for i in range(settings.rounds + 1):
        if i < settings.rounds:
            centres = members.groupBy("bucket").agg(F.min(F.struct("key", "n", "root")).alias("_c"))
            centres = centres.select("bucket", F.col("_c.key").alias("a"), F.col("_c.n").alias("a_n"), F.col("_c.root").alias("a_root"))
            beside = scratch.table(f"beside-{i}", members.join(centres, "bucket").where("key != a"))
            pairs = beside.where((F.col("root") != F.col("a_root")) & comparable("n", "a_n", settings)).select("a", F.col("key").alias("b"))
            if more is not None and i == 0:
                pairs = pairs.unionByName(more)
            pairs = scratch.table(f"pairs-{i}", pairs.distinct())
            found = pairs if i and pairs.isEmpty() else confirmed(pairs, sets, settings)
        else:
            beside, found = None, rest_links(members, sets, settings)
        found = scratch.table(f"edges-{i}", found)
        if roots is None:
            roots = stars(found)
        elif not found.isEmpty():
            roots = stars(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(found))
        if beside is not None:                             # a centre is compared with all others of its bucket, so it is done
            renamed = beside.select("bucket", "key", "n").join(roots.withColumnRenamed("node", "key"), "key", "left")
            members = scratch.table(f"members-{i + 1}", _open(renamed.select("bucket", "key", "n", F.coalesce("root", "key").alias("root"))))
            for old in ("members", "beside", "pairs"):
                scratch.drop(f"{old}-{i}")
            scratch.release()
            if members.isEmpty():
                break
    return roots


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the smallest id that the row's set reaches."""
    scratch = Scratch(docs.sparkSession, "minhash")
    marked = scratch.table("marked", _marked(docs, doc_id, text, settings))
    classes = scratch.table("classes", marked.where("n > 0").groupBy("key").agg(
        F.min(doc_id).alias("first_id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    roots = links(classes, docs, doc_id, text, settings, scratch)
    named = scratch.table("named", classes.select("key", "first_id").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "first_id", F.coalesce("root", "key").alias("root")))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_key = attach(named.select("key", "root"), names, "root").select("key", "component_id")
    some = attach(marked.where("n > 0").select(doc_id, "key", "n"), of_key, "key")
    none = marked.where("n = 0").select(doc_id, "n", F.col(doc_id).alias("component_id"))
    return some.select(doc_id, "n", "component_id").unionByName(none).withColumnRenamed("n", "n_shingles")
