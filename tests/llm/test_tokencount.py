import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from wirelark.llm import texts, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["'", "'s", "'re", "'ll", "'d", "s", "t", " ", "  ", "\n", "\t", " ", " ", "a", "Z", "é", "1", "²", "٣", "!", "?", "€", "中", "文", "́",
          "👍", "<|endoftext|>", "<|endof", "don't", "I'm", "\r\n", "_", "​", "ǅ", "ª", "Ⅷ", "\x1c", "\x85", "\x00"]


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(PATH)


def wanted(counter, docs):
    return [len(counter.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in docs]


def table_of(counter, docs):
    data, offsets = texts.column_bytes(pa.array(docs, pa.string()))
    whole, starts, ends, hashes, _, _ = counter.pieces(data, offsets)
    found, first = np.unique(hashes, return_index=True)
    return tokencount.FrequentTable.build(found, counter.lengths(whole, starts[first], ends[first], found))


@pytest.mark.parametrize("seed", range(30))
def test_like_the_library(counter, seed):
    draw = random.Random(seed)
    docs = ["".join(draw.choice(PIECES) for _ in range(draw.randrange(40))) for _ in range(60)] + [None, "", "<|endoftext|>"]
    data, offsets = texts.column_bytes(pa.array(docs, pa.string()))
    assert counter.count(data, offsets, table_of(counter, docs[::2])).tolist() == wanted(counter, docs)


def test_long_pieces(counter):
    docs = ["a" * 50_000, " " * 50_000, "ab" * 9_000 + "'" * 1_000, "x" * 300 + "\n" * 500]
    data, offsets = texts.column_bytes(pa.array(docs))
    assert counter.count(data, offsets, table_of(counter, ["a"])).tolist() == wanted(counter, docs)


def test_the_cache_starts_again(counter, monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE", 10)
    docs = [f"word{i} other{i}" for i in range(50)]
    data, offsets = texts.column_bytes(pa.array(docs))
    assert counter.count(data, offsets, table_of(counter, ["a"])).tolist() == wanted(counter, docs)
    assert len(counter.cache) <= 10 or len(counter.cache) < 200


def test_query_on_documents(spark, counter, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = tokencount.count_tokens(docs, PATH).collect()
    assert [r.n_tokens for r in rows] == wanted(counter, [r.text for r in rows])
    assert [r.n_bytes for r in rows] == [len(r.text.encode()) for r in rows]
    rows = tokencount.count_tokens(odd, PATH).collect()
    assert len(rows) == odd.count() and rows[0].n_tokens == rows[1].n_tokens == 0 and rows[0].score == "mine"
    assert tokencount.count_tokens(empty, PATH).count() == 0
