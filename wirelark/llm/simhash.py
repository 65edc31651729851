"""Near duplicates by SimHash: fingerprints of word shingles, exact links within a few bits, groups.

Links are found by comparing tiles of fingerprints with each other in numpy (exclusive or, bit
counts). A tile holds fingerprints with the same population counts in each quarter of their bits.
The counts of two fingerprints differ, summed over the quarters, by no more than their bits do, so
tile pairs whose counts are further apart than the radius are never formed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wirelark.llm import texts
from wirelark.llm.shared import Scratch

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 4096                        # fingerprints compared with as many others at a time
_QUARTERS = 4


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each document; zero without words."""
    low = texts.LOWER[data]
    starts, ends, first = texts.words(low, offsets, texts.VISIBLE)
    n_words = np.diff(first)
    # the words with one blank after each, so that every shingle is a slice
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(to[-1], 32, dtype=np.uint8)
    inside = np.repeat(starts - to[:-1], size + 1) + np.arange(to[-1])
    keep = np.ones(to[-1], dtype=bool)
    keep[to[1:] - 1] = False
    joined[keep] = low[inside[keep]]
    n = np.where(n_words == 0, 0, np.maximum(1, n_words - shingle + 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    last = np.minimum(at + shingle, np.repeat(first[1:], n))
    view, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[s:e], SEED) for s, e in zip(to[at].tolist(), (to[last] - 1).tolist())),
                         dtype=np.uint64, count=len(at))
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        for bit in range(64):
            ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), begin[some])
            out[some] |= (2 * ones > n[some]).astype(np.uint64) << np.uint64(bit)
    return out


FP = "_fp"


def fingerprints(docs: DataFrame, columns: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The named columns and the fingerprint (`_fp`, its bits as a long) of every row."""
    schema = StructType([docs.schema[c] for c in columns] + [StructField(FP, LongType())])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in texts.blocks(batch, text):
                fp = fingerprints_of(data, offsets, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in columns] + [pa.array(fp)], [*columns, FP])
    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


def _quarter_counts(fp) -> list:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(_QUARTERS)]


def _shifts(radius: int) -> list[tuple[int, ...]]:
    """Differences of the counts of two tiles within reach: one of each pair of opposite ones."""
    span = range(-radius, radius + 1)
    return [s for s in itertools.product(span, repeat=_QUARTERS) if sum(map(abs, s)) <= radius and s >= (0,) * _QUARTERS]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each node's component, from edges (a, b) between nodes below n."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def links_of(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, fingerprint) that connect whatever the links between two tiles connect.

    Of each component that the links form, one edge goes from every member to one of them; no two
    distinct fingerprints within the radius end up in different components.
    """
    nodes = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    label = np.arange(len(nodes))
    step = max(1, (1 << 20) // len(right))
    for lo in range(0, len(left), step):
        near = np.bitwise_count(left[lo:lo + step, None] ^ right[None, :]) <= radius
        a, b = np.nonzero(near)
        a, b = a + lo, b + shift
        other = a != b
        if other.any():
            a, b = label[a[other]], label[b[other]]
            pairs = np.unique(np.minimum(a, b) * len(nodes) + np.maximum(a, b))
            label = forest(pairs // len(nodes), pairs % len(nodes), len(nodes))[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _tiles(distinct: DataFrame) -> DataFrame:
    """Rows (key, part, fps): at most TILE distinct fingerprints of one tile key, as bytes."""
    key = F.concat(*[F.chr(F.lit(65) + c) for c in _quarter_counts(F.col("fp"))])
    # Large tiles are dealt over parts by hash, so no task collects a whole one.
    keyed = distinct.select("fp", key.alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
    parts = (2 * F.col("n") / TILE).cast("int") + 1
    placed = (keyed.join(sizes, "key")
              .withColumn("part", F.pmod(F.xxhash64("fp"), parts).cast("int")))
    return placed.groupBy("key", "part").agg(F.collect_list("fp").alias("fps"))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges between distinct fingerprints (`fp`) that connect all within `radius` bits.

    The edges of one tile pair are reduced to a forest, so a group of thousands of near copies gives
    about as many edges as it has members for each pair of tiles, not all its pairs.
    """
    scratch = Scratch(distinct.sparkSession, "simhash-tiles")
    tiles = scratch.table("tiles", _tiles(distinct))
    moves = F.array(*[F.array(*map(F.lit, s)) for s in _shifts(radius)])
    shifted = F.concat(*[F.chr(F.ascii(F.substring("key", i + 1, 1)) + F.col("move")[i]) for i in range(_QUARTERS)])
    seekers = (tiles.select("key", "part", "fps", F.explode(moves).alias("move"))
               .select(shifted.alias("key"), F.col("key").alias("own"), F.col("part").alias("own_part"), F.col("fps").alias("left")))
    pairs = seekers.join(tiles.withColumnRenamed("fps", "right"), "key").where(
        (F.col("key") != F.col("own")) | (F.col("own_part") <= F.col("part")))

    def run(batches):
        for batch in batches:
            found_a, found_b = [], []
            lefts, rights = batch.column("left"), batch.column("right")
            same = batch.column("same").to_pylist()
            for i in range(batch.num_rows):
                left = lefts[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                right = rights[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                a, b = links_of(left, right, radius, same[i])
                found_a.append(a.view(np.int64))
                found_b.append(b.view(np.int64))
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])
    same = (F.col("key") == F.col("own")) & (F.col("part") == F.col("own_part"))
    return pairs.select("left", "right", same.alias("same")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node that it reaches.

    Alternating large-star and small-star rounds, until a round changes nothing; each round's edges
    are written to the shared folder and replace those of the round before. Both are joins on the
    node with one row per node, so a hub's edges can be split over tasks.
    """
    scratch = Scratch(edges.sparkSession, "components")
    low, high = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    kept, n, state = "edges-0", 0, None
    now = scratch.table(kept, edges.select(low, high).where("lo < hi").distinct())
    while True:
        # large star: every node gives its larger neighbours its smallest one
        near = now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
        large = (now.join(near, F.col("lo") == F.col("node"), "left")
                 .select(F.least("lo", F.coalesce("least", "lo")).alias("lo"), "hi").distinct())
        # small star: every node links its smaller neighbours to the smallest
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = (large.join(least, "hi").select(F.explode(F.array(
            F.struct(F.col("least").alias("lo"), F.col("hi").alias("hi")),
            F.struct(F.col("least").alias("lo"), F.col("lo").alias("hi")))).alias("e"))
            .select("e.lo", "e.hi").where("lo < hi").distinct())
        n += 1
        after = scratch.table(f"edges-{n}", small)
        was, state = state, after.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        scratch.drop(kept)
        kept, now = f"edges-{n}", after
        if was == state:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
           shingle: int = SHINGLE, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, _fp, component_id) for every row: the smallest id that the row's fingerprint reaches.

    Null and empty texts have fingerprint zero and are linked like any other. component_id is null
    only if no row of the component has an id.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.table("fingerprints", fingerprints(docs, [doc_id, *extra], text, shingle))
    classes = scratch.table("classes", marked.groupBy(F.col(FP).alias("fp")).agg(F.min(doc_id).alias("first_id")))
    roots = scratch.table("roots", components(links(classes.select("fp"), radius)))
    scored = (classes.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    ids = scored.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = scored.join(ids, "root").select("fp", "component_id")
    return marked.join(named, F.col(FP) == F.col("fp")).drop("fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: one of each group, that with the smallest id.

    Of several rows with that id the first by fingerprint stays (then any, if they have the same one).
    Groups without any id keep nothing to name them by and stay whole.
    """
    found = groups(docs, doc_id, text)
    stays = found.where(F.col(doc_id) == F.col("component_id")).select(doc_id).distinct()
    named = docs.join(stays, doc_id, "left_semi").dropDuplicates([doc_id])
    return named.unionByName(docs.where(F.col(doc_id).isNull()))
