"""Toxicity scores from a small bidirectional gated recurrent network with attention pooling.

A word enters the network as the sum of a word embedding and of character embeddings (its
beginnings of four and six bytes, its end and its trigrams), all found by hash. Overlapping windows
of a text run through a forward and a backward recurrent layer; attention pools each window into a
logit, and a text scores as its highest window. Training is plain numpy on a bounded sample of
labelled rows; scoring is a map over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from wirelark.llm import texts


@dataclass(frozen=True)
class Settings:
    window: int = 32               # words of a window
    stride: int = 24               # words from a window to the next, so 8 are shared
    fit_rows: int = 3_000          # labelled documents a fit reads at most, a third of them toxic at most
    fit_bytes: int = 16 << 20      # bytes of their texts at most, half for each label
    hidden: int = 8
    width: int = 12                # of an embedding
    table_log2: int = 15           # rows of each embedding table
    epochs: int = 5
    batch: int = 128
    rate: float = 0.01
    train_windows: int = 3         # of a document that an epoch trains on
    candidates: int = 8            # of a document among which an epoch looks for those
    table_rate: float = 0.002
    doubt: float = 0.2             # a toxic document whose best window scores less after two epochs is taken for mislabelled
    seed: int = 7


KINDS = ("word", "begin4", "begin6", "end4")


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))[at]


def _folded(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Words:
    """The distinct words of a block: rows of the tables by kind, and their trigrams."""
    ids: np.ndarray                # distinct words x kinds
    trigrams: np.ndarray           # table rows, flat
    first: np.ndarray              # word u has the trigrams first[u]:first[u + 1]
    which: np.ndarray              # distinct word of each word of the block
    documents: np.ndarray          # document i has the words documents[i]:documents[i + 1]


def read_words_in_parts(data: np.ndarray, offsets: np.ndarray, bits: int, size: int = 1 << 19) -> Words:
    """Like read_words, with the temporary arrays of a part of the documents at a time; a word that
    occurs in several parts is listed once for each."""
    parts, lo = [], 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        parts.append(read_words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], bits))
        lo = hi
    distinct = np.cumsum([0] + [len(p.ids) for p in parts])
    grams, words = np.cumsum([0] + [len(p.trigrams) for p in parts]), np.cumsum([0] + [len(p.which) for p in parts])
    return Words(np.concatenate([p.ids for p in parts]), np.concatenate([p.trigrams for p in parts]),
                 np.concatenate([p.first[:-1] + g for p, g in zip(parts, grams)] + [grams[-1:]]),
                 np.concatenate([p.which + d for p, d in zip(parts, distinct)]),
                 np.concatenate([p.documents[:-1] + w for p, w in zip(parts, words)] + [words[-1:]]))


def read_words(data: np.ndarray, offsets: np.ndarray, bits: int) -> Words:
    low = texts.LOWER[data]
    starts, ends, documents = texts.words(low, offsets, texts.ALNUM)
    _, at, which = np.unique(texts.word_hashes(low, starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[at], ends[at]
    size = ends - starts
    head, tail = _eight(low, starts), _eight(low, np.maximum(starts, ends - 4))

    def cut(value, n):
        return value & ((np.uint64(1) << (np.uint64(8) * n.astype(np.uint64))) - np.uint64(1))

    hashes = [texts.word_hashes(low, starts, ends),
              texts.mix(cut(head, np.minimum(size, 4)) + np.uint64(1 << 56)),
              texts.mix(cut(head, np.minimum(size, 6)) + np.uint64(2 << 56)),
              texts.mix(cut(tail, np.minimum(size, 4)) + np.uint64(3 << 56))]
    n = np.maximum(size - 2, 1)
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.repeat(starts - first[:-1], n) + np.arange(first[-1])
    three = cut(_eight(low, place), np.repeat(np.minimum(size, 3), n))
    return Words(np.stack([_folded(h, bits) for h in hashes], 1), _folded(texts.mix(three + np.uint64(4 << 56)), bits),
                 first, which, documents)


def window_starts(documents: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, document) of every window. A document has at least one word here or no window."""
    n = np.diff(documents)
    count = np.where(n > 0, np.maximum(0, -(-(n - settings.window) // settings.stride)) + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = step * settings.stride
    return documents[owner] + begin, np.minimum(settings.window, n[owner] - begin), owner


class Network:
    """The weights, the forward pass and the gradients. Gate columns: update, reset, candidate."""

    def __init__(self, settings: Settings):
        self.settings = s = settings
        draw = np.random.default_rng(s.seed)
        rows, h = 1 << s.table_log2, s.hidden
        self.w = {f"table_{k}": draw.normal(0, 0.02, (rows, s.width)) for k in (*KINDS, "tri")}
        for d in "fb":
            self.w[f"in_{d}"] = draw.normal(0, 0.5, (s.width, 3 * h))
            self.w[f"rec_{d}"] = draw.normal(0, 0.3, (h, 3 * h))
            self.w[f"bias_{d}"] = np.zeros(3 * h)
        self.w |= {"att": draw.normal(0, 0.3, (2 * h, h)), "att_v": draw.normal(0, 0.3, h), "out": draw.normal(0, 0.5, 2 * h), "out_b": np.array([-1.0])}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def embed(self, words: Words) -> np.ndarray:
        """Distinct words x width, some words at a time."""
        x = np.empty((len(words.ids), self.settings.width), self.w["table_tri"].dtype)
        for lo in range(0, len(x), 16_384):
            first = words.first[lo:lo + 16_385]
            grams = self.w["table_tri"][words.trigrams[first[0]:first[-1]]]
            part = np.add.reduceat(grams, first[:-1] - first[0], axis=0) / np.diff(first)[:, None].astype(x.dtype)
            for i, k in enumerate(KINDS):
                part += self.w[f"table_{k}"][words.ids[lo:lo + 16_384, i]]
            x[lo:lo + 16_384] = part
        return x

    def _direction(self, p: np.ndarray, mask: np.ndarray, d: str, keep: list | None):
        """p: steps x windows x gates, inputs already projected; returns all states."""
        h = np.zeros((p.shape[1], self.settings.hidden), np.float32)
        H, rec = self.settings.hidden, self.w[f"rec_{d}"]
        states = np.empty((*p.shape[:2], H), np.float32)
        whole = mask.all(1)
        for t in range(len(p)) if d == "f" else range(len(p) - 1, -1, -1):
            g = h @ rec
            zr = 0.5 * np.tanh(0.5 * (p[t, :, :2 * H] + g[:, :2 * H])) + 0.5
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(p[t, :, 2 * H:] + r * g[:, 2 * H:])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, g, z, r, n, mask[t][:, None]))
            h = new if whole[t] else np.where(mask[t][:, None], new, h)
            states[t] = h
        return states

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """x: distinct words x width; index, mask: steps x windows. Returns the logits of the windows."""
        tapes = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self._direction((x @ self.w[f"in_{d}"] + self.w[f"bias_{d}"])[index], mask, d, tapes[d]) for d in "fb"], axis=2)
        u = np.tanh(states @ self.w["att"])
        e = np.where(mask, u @ self.w["att_v"], np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a = np.where(mask, a, 0)
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = (a[:, :, None] * states).sum(0)
        if keep is not None:
            keep |= {"states": states, "u": u, "a": a, "pooled": pooled, "tapes": tapes, "x": x, "index": index}
        return pooled @ self.w["out"] + self.w["out_b"][0]

    def gradients(self, dlogit: np.ndarray, keep: dict) -> tuple[dict, np.ndarray]:
        """Of the dense weights, and of each distinct word's embedding."""
        w, H = self.w, self.settings.hidden
        states, u, a, pooled = keep["states"], keep["u"], keep["a"], keep["pooled"]
        out = {"out": pooled.T @ dlogit, "out_b": np.array([dlogit.sum()])}
        dpooled = dlogit[:, None] * w["out"]
        dstates = a[:, :, None] * dpooled
        da = (states * dpooled).sum(2)
        de = a * (da - (a * da).sum(0))
        out["att_v"] = np.einsum("tbh,tb->h", u, de)
        du = de[:, :, None] * w["att_v"] * (1 - u * u)
        out["att"] = np.einsum("tbs,tbh->sh", states, du)
        dstates = dstates + du @ w["att"].T
        dx = np.zeros_like(keep["x"])
        for d, lo in (("f", 0), ("b", H)):
            carry = np.zeros((dstates.shape[1], H), np.float32)
            dp = np.zeros((*dstates.shape[:2], 3 * H), np.float32)
            rec, drec = w[f"rec_{d}"], np.zeros_like(w[f"rec_{d}"])
            for t, h, g, z, r, n, m in reversed(keep["tapes"][d]):
                carry = carry + dstates[t][:, lo:lo + H]
                dnew = np.where(m, carry, 0)
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (h - n) * z * (1 - z)
                dr = dn * g[:, 2 * H:] * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], 1)
                dp[t] = np.concatenate([dz, dr, dn], 1)
                drec += h.T @ dg
                carry = np.where(m, dnew * z, carry) + dg @ rec.T
            out[f"rec_{d}"] = drec
            out[f"bias_{d}"] = dp.sum((0, 1))
            flat = np.zeros((len(dx), 3 * H), np.float32)
            np.add.at(flat, keep["index"].ravel(), dp.reshape(-1, 3 * H))
            out[f"in_{d}"] = keep["x"].T @ flat
            dx += flat @ w[f"in_{d}"].T
        return out, dx

    def window_scores(self, words: Words, windows: tuple | None = None, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(probability, document) of every window, or of those given."""
        first, size, owner = windows or window_starts(words.documents, self.settings)
        order = np.argsort(size, kind="stable")[::-1]      # whole windows together
        first, size = first[order], size[order]
        x, out = self.embed(words), np.zeros(len(first), np.float32)
        steps = np.arange(self.settings.window)[:, None]
        for lo in range(0, len(first), most):
            part = slice(lo, lo + most)
            mask = steps < size[part]
            index = words.which[np.where(mask, first[part] + steps, first[part])]
            out[part] = self.forward(x, index, mask)
        scores = np.empty_like(out)
        scores[order] = 1 / (1 + np.exp(-out))
        return scores, owner


def document_scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(highest window, number of windows) of each document; 0 without words."""
    scores, owner = net.window_scores(read_words(data, offsets, net.settings.table_log2))
    best = np.zeros(len(offsets) - 1)
    np.maximum.at(best, owner, scores)
    return best, np.bincount(owner, minlength=len(best))


def _evidence(ids: np.ndarray, owner: np.ndarray, toxic: np.ndarray, rows: int) -> np.ndarray:
    """How strongly each table row goes with toxic documents: the root of the log-likelihood ratio
    of document counts, as far as it is over 3 (less happens by chance), in units of 4, at most 2."""
    pairs = np.unique(owner.astype(np.int64) * rows + ids)
    doc, row = pairs // rows, pairs % rows
    a = np.bincount(row[toxic[doc] == 1], minlength=rows).astype(float)
    b = np.bincount(row[toxic[doc] == 0], minlength=rows).astype(float)
    A, B = max(1.0, toxic.sum()), max(1.0, (toxic == 0).sum())
    ea, eb = (a + b) * A / (A + B), (a + b) * B / (A + B)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / ea), 0) + np.where(b > 0, b * np.log(b / eb), 0))
    return np.where(a > ea, np.clip((np.sqrt(np.maximum(0, g)) - 3) / 4, 0, 2), 0)


def train(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, settings: Settings) -> Network:
    """Fits the network to whole labelled texts.

    The first coordinate of the embeddings starts from the counts of the training documents, the
    rest at random; then all weights follow the gradient of the cross-entropy (Adam; the tables
    with Adagrad). Each epoch trains on the windows of a document that now score highest.
    """
    net = Network(settings)
    words = read_words_in_parts(data, offsets, settings.table_log2)
    rows, owner = 1 << settings.table_log2, np.repeat(np.arange(len(toxic)), np.diff(words.documents))
    for i, kind in enumerate(KINDS):
        net.w[f"table_{kind}"][:, 0] = _evidence(words.ids[words.which, i], owner, toxic, rows)
    for d in "fb":
        net.w[f"in_{d}"][0, 2 * settings.hidden:] = np.abs(net.w[f"in_{d}"][0, 2 * settings.hidden:]) + 0.5
    net.w["out"] = np.abs(net.w["out"])
    steps, draw = np.arange(settings.window)[:, None], np.random.default_rng(settings.seed)
    first, size, of = _candidates(net, words, settings, draw)
    dense = [k for k in net.w if not k.startswith("table_")]
    moment = {k: np.zeros_like(net.w[k]) for k in dense}
    second = {k: np.zeros_like(net.w[k]) for k in dense}
    squares = {k: np.full(rows, 0.1, np.float32) for k in net.w if k.startswith("table_")}
    t = 0
    for epoch in range(settings.epochs):
        score = net.window_scores(words, (first, size, of))[0]
        order, rank = _ranked(score, of)
        chosen = order[rank < settings.train_windows]
        best = order[rank == 0]
        shown = best[(toxic[of[best]] == 1) & ((score[best] >= settings.doubt) | (epoch < 2))]
        chosen = np.concatenate([shown, chosen[toxic[of[chosen]] == 0]])
        weight = np.where(toxic[of] == 1, 1.0, 1.0 / settings.train_windows)
        draw.shuffle(chosen)
        for lo in range(0, len(chosen), settings.batch):
            pick = chosen[lo:lo + settings.batch]
            mask = steps < size[pick]
            index = words.which[np.where(mask, first[pick] + steps, first[pick])]
            used, index = np.unique(index, return_inverse=True)
            index = index.reshape(mask.shape)
            part = _some_words(words, used)
            keep: dict = {}
            logit = net.forward(net.embed(part), index, mask, keep)
            p = 1 / (1 + np.exp(-logit))
            grad, dx = net.gradients(((p - toxic[of[pick]]) * weight[pick] / len(pick)).astype(np.float32), keep)
            t += 1
            for k in dense:
                moment[k] = 0.9 * moment[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                net.w[k] = (net.w[k] - settings.rate * (moment[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
            for i, kind in enumerate(KINDS):
                _adagrad(net.w[f"table_{kind}"], squares[f"table_{kind}"], part.ids[:, i], dx, settings.table_rate)
            n = np.diff(part.first)
            _adagrad(net.w["table_tri"], squares["table_tri"], part.trigrams, np.repeat(dx / n[:, None], n, axis=0), settings.table_rate)
    return net


def _ranked(score: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows by document and falling score, and each one's place in its document."""
    order = np.lexsort((-score, of))
    return order, np.arange(len(of)) - np.searchsorted(of[order], of[order])


def _candidates(net: Network, words: Words, settings: Settings, draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows a fit trains on: of each document, half with the most evidence and half at random."""
    first, size, of = window_starts(words.documents, settings)
    sums = np.concatenate([[0], np.cumsum(sum(net.w[f"table_{k}"][words.ids[:, i], 0] for i, k in enumerate(KINDS))[words.which])])
    best, rank = _ranked(sums[first + size] - sums[first], of)
    other, place = _ranked(draw.random(len(of)), of)
    take = np.unique(np.concatenate([best[rank < settings.candidates // 2], other[place < settings.candidates // 2]]))
    return first[take], size[take], of[take]


def _some_words(words: Words, used: np.ndarray) -> Words:
    n = np.diff(words.first)[used]
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(words.first[used] - first[:-1], n) + np.arange(first[-1])
    return Words(words.ids[used], words.trigrams[at], first, np.arange(len(used)), np.array([0, len(used)]))


def _adagrad(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    own, place = np.unique(rows, return_inverse=True)
    total = np.zeros((len(own), grad.shape[1]), np.float32)
    np.add.at(total, place, grad)
    squares[own] += (total ** 2).mean(1)
    table[own] -= rate * total / np.sqrt(squares[own])[:, None]


def sample_labelled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(text, toxic) of at most fit_rows documents with a label, chosen by hash of the id."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    parts = [known.where(F.col("toxic") == kind).orderBy(order, "doc_id").limit(most)
             for kind, most in ((1, settings.fit_rows // 3), (0, settings.fit_rows - settings.fit_rows // 3))]
    chosen = parts[0].unionByName(parts[1])
    return docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def fitting(rows: list[tuple], fit_bytes: int) -> tuple[list[tuple], set]:
    """((doc_id, tie, label) of the texts that fit, labels that occur) from (doc_id, tie, label, bytes) in order."""
    left, taken = {0: fit_bytes // 2, 1: fit_bytes // 2}, []
    for doc_id, tie, kind, n in rows:
        if n <= left[kind]:
            left[kind] -= n
            taken.append((doc_id, tie, kind))
    return taken, {kind for _, _, kind, _ in rows}


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Network | None:
    """Trains on a bounded sample of the labelled documents; None unless both labels occur in it.

    Whole texts are used, in the order of the ids' hashes. Each label has half of fit_bytes; a text
    that does not fit in what its label has left is passed over and the next are tried. If a label
    has texts but none fits, that is an error. The sample is bounded, so one task trains on it; the
    driver gets the weights.
    """
    settings = settings or Settings()
    sample = sample_labelled(docs, labels, settings).withColumn("n", F.octet_length("text"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sizes = sample.select("doc_id", "toxic", "n", order.alias("h"), F.md5("text").alias("tie")).distinct()
    taken, labelled = fitting([tuple(r) for r in sizes.orderBy("h", "doc_id", "tie").select("doc_id", "tie", "toxic", "n").collect()], settings.fit_bytes)
    if labelled - {kind for *_, kind in taken}:
        raise ValueError("a label has texts, but none that fits in half of fit_bytes")
    if len(labelled) < 2:
        return None
    places = docs.sparkSession.createDataFrame([(d, tie, i) for i, (d, tie, _) in enumerate(taken)], StructType([sample.schema["doc_id"], StructField("tie", StringType()), StructField("place", LongType())]))
    chosen = sample.withColumn("tie", F.md5("text")).join(F.broadcast(places), ["doc_id", "tie"]).dropDuplicates(["place"])

    def run(batches):
        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"text": pa.array([], pa.string()), "toxic": pa.array([], pa.int32())})])
        toxic = np.asarray(table.column("toxic").to_numpy(), dtype=np.int64)
        if 0 < toxic.sum() < len(toxic):
            data, offsets = texts.column_bytes(table.column("text"))
            weights = train(data, offsets, toxic, settings).w
            yield pa.RecordBatch.from_pydict({"name": list(weights), "weights": pa.array([w.astype(np.float32).tobytes() for w in weights.values()], pa.binary())})
    ordered = chosen.coalesce(1).sortWithinPartitions("place").select("text", "toxic")
    trained = {r.name: r.weights for r in ordered.mapInArrow(run, "name string, weights binary").collect()}
    net = Network(settings)
    net.w = {k: np.frombuffer(trained[k], np.float32).reshape(w.shape) for k, w in net.w.items()}
    return net


NEW = [StructField("score", DoubleType()), StructField("n_windows", LongType())]


def score(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Adds score double and n_windows long to every row; columns of these names are replaced.

    The score is 0 for texts that are null or have no word, and for all texts without a network.
    """
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in NEW}]
    broadcast = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            for rows, data, offsets in texts.blocks(batch, text):
                best, n = document_scores(model, data, offsets) if model else (np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(f.name) for f in kept] + [pa.array(best.astype(np.float64)), pa.array(n.astype(np.int64))],
                    [f.name for f in kept] + [f.name for f in NEW])
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, StructType(kept + NEW))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1
