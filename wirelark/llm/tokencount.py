"""Token counts of whole texts for a byte-level BPE tokenizer file, with a two-tier look-up.

Texts are cut into pre-tokens with numpy. The first tier is a compact hash table with the number of
tokens of frequent pre-tokens; it is broadcast and answers most of them. What it misses is counted
once per block, from the worker's cache or by the tokenizer library. Pre-tokens of the corpus are
never shuffled, and the counts do not depend on what the table or the cache hold.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wirelark.llm import texts

FREQUENT = 60_000                  # pre-tokens of the first tier at most
SAMPLE_ROWS = 2_000                # documents they are chosen from: about so many, by hash of the id
CACHE = 400_000                    # pre-tokens a worker remembers at most; then it starts again
_WAYS = 4
_LETTER, _NUMBER, _BLANK, _OTHER, _UNKNOWN = 0, 1, 2, 3, 255
#: The suffixes that the byte-level pattern splits off after an apostrophe (fixed values).
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@dataclass
class FrequentTable:
    """Open table of hashes: bucket b has the slots keys[b], values[b]; value 0 is an empty slot."""
    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def build(hashes: np.ndarray, lengths: np.ndarray) -> FrequentTable:
        """The first keys of a bucket win; others are left to the second tier."""
        bits = max(4, int(2 * len(hashes) / _WAYS).bit_length())
        keys, values = np.zeros((1 << bits, _WAYS), np.uint64), np.zeros((1 << bits, _WAYS), np.uint16)
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        way = np.arange(len(order)) - np.searchsorted(bucket[order], bucket[order])
        fits = (way < _WAYS) & (lengths[order] < 65_536)
        keys[bucket[order][fits], way[fits]] = hashes[order][fits]
        values[bucket[order][fits], way[fits]] = lengths[order][fits]
        return FrequentTable(keys, values)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Number of tokens, 0 where the table has none."""
        bucket = (hashes >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)
        out = np.zeros(len(hashes), np.int64)
        for way in range(_WAYS):
            out += np.where(self.keys[bucket, way] == hashes, self.values[bucket, way], 0)
        return out


class Counter:
    """A worker's tokenizer, classes of the code points met so far, and cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.cache: dict[int, int] = {}

    def _classify(self, points: np.ndarray) -> None:
        """Asks the library which class each code point is of: it joins a letter, a digit or a sign, or is blank."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            c = chr(p)
            self.classes[p] = next((kind for kind, head in ((_LETTER, "x"), (_NUMBER, "1"), (_OTHER, "!")) if len(cut(head + c)) == 1), _BLANK)

    def cut(self, points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the pre-tokens; none reaches across an edge (the first and last included)."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.classes[points]
        if (kind == _UNKNOWN).any():
            self._classify(np.unique(points[kind == _UNKNOWN]))
            kind = self.classes[points]
        edge = np.zeros(n + 1, bool)
        edge[edges] = True
        start = np.ones(n + 1, bool)
        start[1:-1] = kind[1:] != kind[:-1]
        start |= edge
        # the last blank of a run that something follows stands alone; a space joins what follows
        blank = kind == _BLANK
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:-1])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        # an apostrophe that begins a pre-token and a suffix right after it
        mark = np.flatnonzero((points == 39) & start[:-1] & start[1:] & ~edge[1:])
        for suffix in _SUFFIXES:
            fits = mark[mark + len(suffix) < n]
            for k, c in enumerate(suffix):
                fits = fits[(points[fits + 1 + k] == ord(c)) & ~edge[fits + 1 + k]]
            start[fits + 1] = False
            start[fits + 1 + len(suffix)] = True
        at = np.flatnonzero(start)
        return at[:-1], at[1:]

    def _special_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Byte spans of added tokens inside the documents, leftmost and longest first."""
        raw, spans = data.tobytes(), []
        marks = [t.encode() for t in self.special]
        if not any(m in raw for m in marks):
            return spans
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            at = lo
            while hits := [(p, -len(m)) for m in marks if (p := raw.find(m, at, hi)) >= 0]:
                p, size = min(hits)
                spans.append((p, p - size))
                at = p - size
        return spans

    def pieces(self, data: np.ndarray, offsets: np.ndarray):
        """(text, starts, ends, hashes, specials before each offset, offsets in code points)."""
        text = data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = lead[offsets]
        spans = np.array([(lead[b], lead[e]) for b, e in self._special_spans(data, offsets)], np.int64).reshape(-1, 2)
        starts, ends = self.cut(points, np.concatenate([at, spans.ravel()]))
        if len(spans):                      # an added token is cut like text above; it counts once instead
            inside = np.searchsorted(spans[:, 0], starts, "right")
            plain = (inside == 0) | (starts >= spans[np.maximum(inside - 1, 0), 1])
            starts, ends = starts[plain], ends[plain]
        return text, starts, ends, texts.word_hashes(points, starts, ends), np.searchsorted(spans[:, 0], at), at

    def encode(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def lengths(self, text: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token by cache or library, each distinct one once."""
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        found = [self.cache.get(h) for h in distinct.tolist()]
        new = [i for i, n in enumerate(found) if n is None]
        if new:
            spots = first[new]
            for i, n in zip(new, self.encode([text[s:e] for s, e in zip(starts[spots].tolist(), ends[spots].tolist())])):
                found[i] = n
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
            if len(new) <= CACHE:
                self.cache.update((int(distinct[i]), found[i]) for i in new)
        return np.array(found, np.int64)[which] if len(found) else np.zeros(0, np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray, table: FrequentTable) -> np.ndarray:
        """Tokens of each document."""
        text, starts, ends, hashes, specials, at = self.pieces(data, offsets)
        n = table.look_up(hashes)
        missed = np.flatnonzero(n == 0)
        n[missed] = self.lengths(text, starts[missed], ends[missed], hashes[missed])
        return texts.per_document(n, np.searchsorted(starts, at)) + np.diff(specials)


_counters: dict[str, Counter] = {}


def worker_counter(path: str) -> Counter:
    """One per Python worker and file, kept from task to task."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def frequent_table(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> FrequentTable:
    """The most frequent pre-tokens of a bounded sample of documents. It changes the time, not the counts."""
    rows = max(1, docs.count())
    share = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.where(share * rows <= SAMPLE_ROWS).select(text)

    def run(batches):
        counter = worker_counter(path)
        for batch in batches:
            for _, data, offsets in texts.blocks(batch, text):
                whole, starts, ends, hashes, _, _ = counter.pieces(data, offsets)
                found, first, n = np.unique(hashes, return_index=True, return_counts=True)
                lengths = counter.lengths(whole, starts[first], ends[first], found)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(lengths)], ["h", "n", "tokens"])
    best = (sample.mapInArrow(run, "h long, n long, tokens long").groupBy("h").agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens"))
            .orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow())
    return FrequentTable.build(best.column("h").to_numpy().view(np.uint64), best.column("tokens").to_numpy())


NEW = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]


def count_tokens(docs: DataFrame, path: str, table: FrequentTable | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds n_bytes (UTF-8) and n_tokens to every row; columns of these names are replaced.

    Counts are those of the tokenizer file without begin, end or padding; its added tokens inside a
    text count as one token each. A null or empty text has none. `path` must exist on every executor.
    """
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in NEW}]
    table = docs.sparkSession.sparkContext.broadcast(table or frequent_table(docs, path, doc_id, text))

    def run(batches):
        counter = worker_counter(path)
        for batch in batches:
            for rows, data, offsets in texts.blocks(batch, text):
                yield pa.RecordBatch.from_arrays(
                    [rows.column(f.name) for f in kept] + [pa.array(np.diff(offsets)), pa.array(counter.count(data, offsets, table.value))],
                    [f.name for f in kept] + [f.name for f in NEW])
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, StructType(kept + NEW))
