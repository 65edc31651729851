"""The distinct word shingles of texts, as 64-bit hashes, and a number for each set of them."""

from __future__ import annotations

import numpy as np

from wirelark.llm import texts

SHINGLE = 5
CHAIN = np.uint64(0x9E3779B97F4A7C15)


def shingles_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of document i, rising, are hashes[first[i]:first[i + 1]].
    A text of fewer than five words is one shingle, a text without words has none."""
    low = texts.LOWER[data]
    starts, ends, first = texts.words(low, offsets, texts.VISIBLE)
    words = texts.word_hashes(low, starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words == 0, 0, np.maximum(1, n_words - SHINGLE + 1))
    owner = np.repeat(np.arange(len(n)), n)
    at = np.repeat(first[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    stop, hashes = first[1:][owner], np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        inside = at + k < stop
        hashes = np.where(inside, texts.mix(hashes * CHAIN + words[np.where(inside, at + k, at)]), hashes)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(n) + 1))


def keys_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each set of shingles; 0 without any."""
    out, some = np.zeros(len(first) - 1, np.uint64), np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = texts.mix(np.add.reduceat(texts.mix(hashes ^ CHAIN), first[some]) + np.diff(first)[some].astype(np.uint64))
    return out
