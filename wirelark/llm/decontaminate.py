"""Benchmark decontamination with an FM-index per training shard.

A shard is a block of whole documents. Its text becomes a string over the benchmark's vocabulary,
in which every stretch of other words, and every border of two documents, is one separator. The
shard's suffixes are sorted up to the first separator (ties by place), which gives the Burrows-Wheeler
transform; a wavelet matrix over it answers ranks. All test windows are searched backwards at once,
their occurrences are located by walking to sampled suffix positions, and the hit words of a
document are merged into spans.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from wirelark.llm import texts

WINDOW = 10
SAMPLE = 8                         # every so manieth position of a suffix is stored
#: Bytes of benchmark text that are broadcast to the tasks at most; more is an error, not a cut.
MOST_BENCHMARK_BYTES = 64 << 20


@dataclass
class Phrases:
    """The benchmark: its vocabulary and the distinct windows of its items."""
    hashes: np.ndarray             # of the distinct words, rising; word i is symbol i + 1
    spelling: np.ndarray           # bytes of the words, one after the other
    begin: np.ndarray              # word i is spelling[begin[i]:begin[i + 1]]
    windows: np.ndarray            # distinct windows x WINDOW symbols, right-aligned, 0 before short ones
    length: np.ndarray             # words of each window
    items: np.ndarray              # positions in `names`, by window
    items_at: np.ndarray           # window w occurs in the items items[items_at[w]:items_at[w + 1]]
    names: np.ndarray              # item ids as text


def read_phrases(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    """From (item_id, text). Items without a word have no window; equal ids count as one item."""
    data, offsets = texts.column_bytes(pa.array([t for _, t in items], pa.string()))
    data = texts.LOWER[data]
    starts, ends, first = texts.words(data, offsets, texts.ALNUM)
    all_hashes = texts.word_hashes(data, starts, ends)
    hashes, at, symbol = np.unique(all_hashes, return_index=True, return_inverse=True)
    spelling = np.concatenate([data[s:e] for s, e in zip(starts[at], ends[at])] or [np.zeros(0, np.uint8)])
    begin = np.concatenate([[0], np.cumsum((ends - starts)[at])]).astype(np.int64)
    names = sorted({i for i, _ in items if i is not None})
    number = {name: k for k, name in enumerate(names)}
    rows, owner = [], []
    for k, (item, _) in enumerate(items):
        own = symbol[first[k]:first[k + 1]] + 1
        if 0 < len(own) < window:
            rows.append(np.concatenate([np.zeros(window - len(own), np.int64), own])[None])
        elif len(own):
            rows.append(np.lib.stride_tricks.sliding_window_view(own, window))
        owner.append(np.full(len(rows[-1]) if len(own) else 0, number.get(item, -1)))
    table = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
    windows, which = np.unique(table, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner) if owner else np.zeros(0, np.int64)], 1).astype(np.int64), axis=0)
    pairs = pairs[pairs[:, 1] >= 0]
    return Phrases(hashes, spelling, begin, windows, (windows > 0).sum(1), pairs[:, 1],
                   np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), np.array(names, dtype=object))


def symbols_of(phrases: Phrases, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each word, 0 for words the benchmark does not have; spellings are compared."""
    if not len(phrases.hashes):
        return np.zeros(len(starts), np.int64)
    hashes = texts.word_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(phrases.hashes, hashes), len(phrases.hashes) - 1)
    size = np.diff(phrases.begin)
    found = np.flatnonzero((phrases.hashes[at] == hashes) & (size[at] == ends - starts))
    out = np.zeros(len(starts), np.int64)
    out[found] = at[found] + 1
    longest = int(size[at[found]].max()) if len(found) else 0
    for k in range(longest):
        found = found[size[at[found]] > k]
        out[found[data[starts[found] + k] != phrases.spelling[phrases.begin[at[found]] + k]]] = 0
    return out


def sort_suffixes(s: np.ndarray) -> np.ndarray:
    """The suffix array of a string in which 0 separates: suffixes are compared up to and with their
    first separator, and equal ones stand by place. Prefix doubling, only among what is still tied."""
    n = len(s)
    bits = max(1, int(s.max(initial=0)).bit_length())
    depth = max(1, 62 // bits)
    depth = 1 << (depth.bit_length() - 1)
    padded = np.concatenate([s, np.zeros(depth, s.dtype)]).astype(np.int64)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(depth):
        here = np.where(open_, padded[k:k + n], 0)
        key = key << bits | here
        open_ &= here > 0
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    # tied suffixes that have not met a separator go on; the others are in order, by place
    while True:
        tied = ~fresh | np.concatenate([~fresh[1:], [False]])
        places = np.flatnonzero(tied & open_[order])
        if not len(places):
            return order
        own = order[places]
        ahead = rank[own + depth]
        again = np.lexsort((own, ahead, rank[own]))
        own, ahead, head = own[again], ahead[again], rank[own[again]]
        order[places] = own
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (ahead[1:] != ahead[:-1])])
        fresh[places] = new
        open_next = open_[own + depth]
        rank[own] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        open_[own] = open_next
        depth *= 2


class FmIndex:
    """Ranks over the Burrows-Wheeler transform by a wavelet matrix, and sampled suffix positions."""

    def __init__(self, s: np.ndarray, sample: int = SAMPLE):
        n = len(s)
        order = sort_suffixes(s)
        before = np.where(order > 0, s[order - 1], 0)
        self.n = n
        self.bits = max(1, int(s.max(initial=0)).bit_length())
        self.ranks, self.zeros = [], []
        level = before
        for b in range(self.bits - 1, -1, -1):
            ones = (level >> b & 1).astype(bool)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(self.ranks[-1][-1]))
            level = np.concatenate([level[~ones], level[ones]])
        count = np.bincount(s, minlength=(1 << self.bits) + 1)
        self.smaller = np.concatenate([[0], np.cumsum(count)])
        # a position is stored if it is a multiple of `sample` or begins a stretch, so no walk crosses a separator
        stored = (order % sample == 0) | (before == 0)
        self.stored = np.concatenate([[0], np.cumsum(stored, dtype=np.int32)])
        self.positions = order[stored]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` symbols of the transform are `symbol`."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ranks, self.zeros)):
            bit = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            one_lo, one_hi = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + one_lo, lo - one_lo), np.where(bit, zeros + one_hi, hi - one_hi)
        return hi - lo

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The transform's symbols at these rows."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ranks, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit > 0, zeros + ones[at], at - ones[at])
        return out

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, low, high): the rows of each right-aligned window that occurs."""
        alive = np.arange(len(windows))
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n)
        for k in range(windows.shape[1] - 1, -1, -1):
            c = windows[alive, k]
            go = c > 0
            c = np.where(c < 1 << self.bits, c, 0)      # no such symbol here
            down, up = lo.copy(), hi.copy()
            at = np.flatnonzero(go)
            base = self.smaller[c[at]]
            down[at], up[at] = base + self.rank(c[at], lo[at]), base + self.rank(c[at], hi[at])
            up[at[c[at] == 0]] = 0
            some = up > down
            alive, lo, hi = alive[some], down[some], up[some]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of these rows' suffixes."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            here = self.stored[at + 1] > self.stored[at]
            out[todo[here]] = self.positions[self.stored[at[here]]] + steps[todo[here]]
            todo, at = todo[~here], at[~here]
            c = self.symbol(at)
            at = self.smaller[c] + self.rank(c, at)
            steps[todo] += 1
        return out


@dataclass
class Hits:
    words: np.ndarray              # of each document
    hit: np.ndarray                # of these, inside an occurrence
    items: list[list[str]]         # ids with occurring windows, sorted, by document
    spans: list[list[tuple[int, int]]]  # merged, in bytes of the document


def find(phrases: Phrases, data: np.ndarray, offsets: np.ndarray) -> Hits:
    """Indexes the documents as one shard and searches all windows in it."""
    low = texts.LOWER[data]
    starts, ends, first = texts.words(low, offsets, texts.ALNUM)
    n_docs, n = len(offsets) - 1, len(starts)
    result = Hits(np.diff(first), np.zeros(n_docs, np.int64), [[] for _ in range(n_docs)], [[] for _ in range(n_docs)])
    if not n or not len(phrases.windows):
        return result
    symbol = symbols_of(phrases, low, starts, ends)
    head = np.zeros(n, bool)
    head[first[:-1][result.words > 0]] = True
    known = symbol > 0
    fresh = known & (head | ~np.concatenate([[False], known[:-1]]))   # words before which a separator goes
    place = np.cumsum(known) + np.cumsum(fresh) - 1                   # of the known words in the string
    kept = np.flatnonzero(known)
    if not len(kept):
        return result
    s = np.zeros(place[-1] + 2, np.int64)
    s[place[kept]] = symbol[kept]
    word_at = np.zeros(len(s), np.int64)
    word_at[place[kept]] = kept
    index = FmIndex(s)
    window, lo, hi = index.search(phrases.windows)
    if not len(window):
        return result
    count = hi - lo
    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    window = np.repeat(window, count)
    at = word_at[index.locate(rows)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + phrases.length[window], -1)
    inside = np.cumsum(edge[:-1]) > 0
    result.hit = texts.per_document(inside, first)
    doc = np.searchsorted(first, at, "right") - 1
    pairs = np.unique(doc * len(phrases.windows) + window)
    doc, window = pairs // len(phrases.windows), pairs % len(phrases.windows)
    sizes = np.diff(phrases.items_at)[window]
    took = np.repeat(phrases.items_at[window] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    pairs = np.unique(np.repeat(doc, sizes) * max(1, len(phrases.names)) + phrases.items[took])
    for d, item in zip(pairs // max(1, len(phrases.names)), pairs % max(1, len(phrases.names))):
        result.items[d].append(phrases.names[item])
    begins = np.flatnonzero(inside & (head | ~np.concatenate([[False], inside[:-1]])))
    stops = np.flatnonzero(inside & np.concatenate([head[1:] | ~inside[1:], [True]]))
    for d, b, e in zip(np.searchsorted(first, begins, "right") - 1, starts[begins], ends[stops]):
        result.spans[d].append((int(b - offsets[d]), int(e - offsets[d])))
    return result


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans."""
    at, out = 0, []
    for begin, end in spans:
        out.append(text[at:begin])
        at = end
    return b"".join([*out, text[at:]])


SPAN = StructType([StructField("begin", LongType()), StructField("end", LongType())])
NEW = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()),
       StructField("items_sha256", StringType()), StructField("contaminated", BooleanType()),
       StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(SPAN)), StructField("clean_text", StringType())]


def load_phrases(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> Phrases:
    """The benchmark's windows, after a check of its size: they go to every task."""
    size = benchmark.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    if size > MOST_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; split it into parts of {MOST_BENCHMARK_BYTES}")
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).collect()
    return read_phrases([(r.i, r.t) for r in rows], window)


def mark(docs: DataFrame, phrases: Phrases, text: str = "text", only: list[str] | None = None) -> DataFrame:
    """Adds the columns NEW (or those in `only`) to every row; columns of these names are replaced.

    A null text has no words and stays null in clean_text. Spans are in bytes of the text's UTF-8.
    """
    new = [f for f in NEW if only is None or f.name in only]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]
    broadcast = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in texts.blocks(batch, text):
                hits = find(broadcast.value, data, offsets)
                made = {
                    "n_words": hits.words, "n_hit": hits.hit, "n_items": [len(x) for x in hits.items],
                    "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in hits.items],
                    "contaminated": hits.hit > 0, "items": hits.items,
                    "spans": [[{"begin": b, "end": e} for b, e in x] for x in hits.spans]}
                if any(f.name == "clean_text" for f in new):
                    column = rows.column(text)
                    made["clean_text"] = [
                        (cut(data[offsets[i]:offsets[i + 1]].tobytes(), x).decode() if x else column[i].as_py())
                        for i, x in enumerate(hits.spans)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(f.name) for f in kept] + [pa.array(made[f.name], _ARROW[f.name]) for f in new],
                    [f.name for f in kept] + [f.name for f in new])
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, StructType(kept + new))


_ARROW = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(),
          "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), "clean_text": pa.string()}
