"""Near copies: texts that share four fifths of their shingles of five words, and the groups they form.

Two sources of candidates: SimHash fingerprints of the shingles within `simhash.RADIUS` bits, found by its tiles,
and MinHash bands for what fingerprints are too coarse to find (a similarity of 0.8 would need a radius of about
16, where the tiles leave out next to nothing). The shingles themselves decide, so no pair below the similarity is
linked. Of two texts of similarity s one band agrees with chance s ** ROWS; a pair of 0.8 is in no common bucket
with chance (1 - 0.8 ** 4) ** 25, 2 in a million. Buckets are compared as in `minhash`, in rows that grow with
their members and not with the pairs of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from wirelark.llm import minhash, simhash, texts
from wirelark.llm.shared import Scratch
from wirelark.llm.shingles import CHAIN as _CHAIN, SHINGLE, keys_of, shingles_of

SIMILAR = 4, 5                     # Jaccard similarity of a link at least, as a fraction
BANDS, ROWS = 25, 4
_DRAW = np.random.default_rng(42)
_FLIPS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FACTORS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Documents x bands: the buckets of each document that has shingles, in their order."""
    begin = first[:-1][np.diff(first) > 0]
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(begin), 1))
    if len(begin):
        for i in range(BANDS * ROWS):
            least = np.minimum.reduceat((hashes ^ _FLIPS[i]) * _FACTORS[i], begin)
            out[:, i // ROWS] = texts.mix(out[:, i // ROWS] * _CHAIN + least)
    return out


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, n, fp, bands) of every row."""
    schema = StructType([docs.schema[doc_id], StructField("key", LongType()), StructField("n", LongType()), StructField("fp", LongType()),
                         StructField("bands", ArrayType(LongType()))])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in texts.blocks(batch, text):
                hashes, first = shingles_of(data, offsets)
                n = np.diff(first)
                bands = pa.array(bands_of(hashes, first).ravel().view(np.int64))
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32))
                fp = simhash.fingerprints_of(data, offsets, SHINGLE).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(doc_id), pa.array(keys_of(hashes, first).view(np.int64)), pa.array(n.astype(np.int64)),
                                                  pa.array(fp), pa.ListArray.from_arrays(cuts, bands)], [doc_id, "key", "n", "fp", "bands"])
    return docs.select(*dict.fromkeys([doc_id, text])).mapInArrow(run, schema)


def _fingerprint_pairs(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): sets whose fingerprints are equal or near, each with the least set of its own or the other fingerprint."""
    least = scratch.table("least", classes.groupBy("fp").agg(F.min("key").alias("least")))
    same = minhash.attach(classes.select("key", "fp"), least, "fp").where("key != least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    near = simhash.links(least.select("fp"))
    near = near.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row: the smallest id that the row's text reaches by links.
    Texts without words are one group."""
    scratch = Scratch(docs.sparkSession, "nearcopies")
    settings = minhash.Settings(*SIMILAR)
    marked = scratch.table("marked", _marked(docs, doc_id, text))
    classes = scratch.table("classes", marked.groupBy("key").agg(
        F.min(doc_id).alias("first_id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    some = classes.where("n > 0")
    pairs = scratch.table("pairs", _fingerprint_pairs(some, scratch))
    scratch.release()
    roots = minhash.links(some, docs, doc_id, text, settings, scratch, pairs)
    named = scratch.table("named", classes.select("key", "first_id").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "first_id", F.coalesce("root", "key").alias("root")))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_key = minhash.attach(named.select("key", "root"), names, "root").select("key", "component_id")
    return minhash.attach(marked.select(doc_id, "key"), of_key, "key").select(doc_id, "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: one of each group, that with the smallest id; see simhash.keep_one."""
    found = groups(docs, doc_id, text)
    stays = found.where(F.col(doc_id) == F.col("component_id")).select(doc_id).distinct()
    return docs.join(stays, doc_id, "left_semi").dropDuplicates([doc_id]).unionByName(docs.where(F.col(doc_id).isNull()))
