"""Language identification with language-bitmask n-gram filters.

Every language has a Bloom filter of the n-grams (four bytes of lower-cased text) that are typical
of it. The filters are bit-sliced: slot s holds a mask whose bit L is slot s of language L's filter,
so one look-up per hash function, and-ed together, gives all languages that contain an n-gram. A
text's language is the one with the most n-grams after the hits expected by chance are taken off.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from wirelark.llm import texts
from wirelark.operators.bounded import small_side

UNDETERMINED = "und"
_SPACE = np.uint8(32)
#: Everything in ASCII that is not a letter becomes a blank.
_FOLD = texts.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = _SPACE
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Settings:
    fit_rows: int = 600            # documents a language is learned from: about so many, by hash of doc_id
    ngrams: int = 6_000            # most frequent typical n-grams kept for a language
    least: int = 2                 # times an n-gram occurs in a language's sample at least
    typical: float = 0.5           # share of the highest rate of any language that makes an n-gram typical
    slots_log2: int = 17
    hashes: int = 3


@dataclass
class Model:
    languages: list[str]
    masks: np.ndarray              # words x slots, unsigned; bit L % 64 of word L // 64
    chance: np.ndarray             # share of unknown n-grams that a language's filter lets through
    settings: Settings


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, first): four-byte windows whose middle bytes are letters; document i has first[i]:first[i + 1]."""
    folded = _FOLD[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1          # capitals of the Latin-1 block
    capital = after[(folded[after] >= 0x80) & (folded[after] <= 0x9E) & (folded[after] != 0x97)]
    folded[capital] += 32
    padded = np.concatenate([[_SPACE], np.insert(folded, offsets[1:], _SPACE), [_SPACE, _SPACE]]).astype(np.uint8)
    at = offsets + np.arange(len(offsets))                 # where the documents begin, after their blanks
    letter = padded != _SPACE
    valid = np.flatnonzero(letter[1:-2] & letter[2:-1])
    grams = np.ndarray((len(padded) - 3,), dtype="<u4", buffer=padded.tobytes(), strides=(1,))[valid]
    return grams, np.searchsorted(valid, at)


def _slots(grams: np.ndarray, settings: Settings):
    shift = np.uint32(32 - settings.slots_log2)
    for k in range(settings.hashes):
        mixed = grams ^ (grams >> np.uint32(15 + k))
        yield (mixed * _MULTIPLIERS[k]) >> shift


def _counts(settings: Settings):
    """Arrow: (lang, text) rows to (lang, gram, n) per batch."""
    def run(batches):
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names, codes = langs.dictionary, np.asarray(langs.indices)
            for rows, data, offsets in texts.blocks(batch):
                own = codes[:rows.num_rows]
                codes = codes[rows.num_rows:]
                grams, first = _grams(data, offsets)
                key = np.repeat(own.astype(np.uint64), np.diff(first)) << np.uint64(32) | grams
                found, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array((found >> np.uint64(32)).astype(np.int64))).cast(pa.string()),
                     pa.array((found & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"])
    return run


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    """Learns the filters from the rows of `docs` (doc_id, text, lang) with a text and a language.

    A bounded sample is used: about `fit_rows` whole documents for each language, those with the
    smallest hash of their id. The n-grams are counted by Spark; the driver gets the filters' content.
    """
    settings = settings or Settings()
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sizes = known.groupBy("lang").agg(F.count("*").alias("all_rows"))
    sample = (known.withColumn("_share", share).join(small_side(sizes, 10_000), "lang")
              .where(F.col("_share") * F.col("all_rows") <= settings.fit_rows).select("lang", "text"))
    counts = (sample.mapInArrow(_counts(settings), "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    counts = [(r.lang, r.grams, r.ns, r.total) for r in _typical(counts, settings).collect()]
    languages = sorted(c[0] for c in counts)
    masks = np.zeros((max(1, -(-len(languages) // 64)), 1 << settings.slots_log2), dtype=np.uint64)
    chance = np.zeros(len(languages))
    for lang, grams, _, _ in counts:
        bit = languages.index(lang)
        word = masks[bit // 64]
        flag = np.uint64(1 << (bit % 64))
        for slots in _slots(np.array(grams, dtype=np.uint32), settings):
            word[slots] |= flag
        chance[bit] = float(np.mean((word & flag) != 0)) ** settings.hashes
    if len(languages) <= 8:
        masks = masks.astype(np.uint8)
    return Model(languages, masks, chance, settings)


def _typical(counts: DataFrame, settings: Settings) -> DataFrame:
    """One row per language: its most frequent typical n-grams (at most settings.ngrams)."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(small_side(totals, 10_000), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    good = (rated.join(top, "gram")
            .where((F.col("n") >= settings.least) & (F.col("rate") >= settings.typical * F.col("top"))))
    ranked = good.groupBy("lang").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "gram"))), 1, settings.ngrams).alias("best"),
        F.first("total").alias("total"))
    return ranked.select("lang", F.col("best.gram").alias("grams"), F.col("best.m").alias("ns"), "total")


def score_block(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corrected hits: documents x languages, n-grams by document)."""
    grams, first = _grams(data, offsets)
    n = np.diff(first).astype(np.float64)
    hits = np.zeros((len(n), len(model.languages)))
    slots = list(_slots(grams, model.settings))
    for w, word in enumerate(model.masks):
        mask = word[slots[0]]
        for s in slots[1:]:
            mask &= word[s]
        for bit in range(64 * w, min(64 * w + 64, len(model.languages))):
            flags = (mask >> mask.dtype.type(bit % 64)) & mask.dtype.type(1)
            hits[:, bit] = texts.per_document(flags, first)
    return np.maximum(0, (hits - n[:, None] * model.chance) / (1 - model.chance)), n


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; the texts without ASCII letters are searched one by one."""
    low = texts.LOWER[data]
    found = texts.per_document(((low >= 97) & (low <= 122)).astype(np.uint8), offsets) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = bool(_LETTER.search(data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred string, score double, known_share double and n_ngrams long to every row.

    Columns of the input that have one of these names are replaced; all others are kept.
    `und` with score 0 for texts that are null or have no letter, and for all texts if nothing
    was learned. The score is the winner's share of its and the runner-up's hits; known_share is
    the share of the text's n-grams in the winner's filter. Ties go to the first name.
    """
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("known_share", DoubleType()),
           StructField("n_ngrams", LongType())]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]
    names = pa.array([*model.languages, UNDETERMINED])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in texts.blocks(batch, text):
                hits, n = score_block(model, data, offsets)
                und = len(model.languages)
                pick = np.full(len(n), und)
                score = known = np.zeros(len(n))
                if und:
                    best = hits.argmax(1)
                    won = hits[np.arange(len(n)), best]
                    rest = hits.copy()
                    rest[np.arange(len(n)), best] = 0
                    letters = _has_letter(data, offsets)
                    pick = np.where(letters, best, und)
                    score = np.where(letters, won / np.maximum(won + rest.max(1), 1e-9), 0.0)
                    known = np.where(letters, np.minimum(1, won / np.maximum(n, 1)), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(f.name) for f in kept] + [names.take(pa.array(pick)), pa.array(score), pa.array(known),
                                                             pa.array(n.astype(np.int64))],
                    [f.name for f in kept] + [f.name for f in new])
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, StructType(kept + new))


def held_out(doc_id: str = "doc_id"):
    """Rows whose languages are never learned."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def accepted(known_share: float = 0.05, few: int = 20):
    """Whether a predicted row is in a known language. Texts of a few n-grams only need a letter."""
    return (F.col("lang_pred") != UNDETERMINED) & ((F.col("known_share") >= known_share) | (F.col("n_ngrams") < few))
