import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from wirelark.llm import decontaminate as dc, texts


def found(items, docs, window):
    data, offsets = texts.column_bytes(pa.array(docs, pa.string()))
    hits = dc.find(dc.read_phrases(items, window), data, offsets)
    return [(int(n), int(h), ids) for n, h, ids in zip(hits.words, hits.hit, hits.items)], hits


@pytest.mark.parametrize("seed", range(40))
def test_against_brute_force(seed):
    draw = random.Random(seed)
    letters, window = draw.choice(["ab", "abcde", "abcdefghijkl"]), draw.choice([3, 5, 10])

    def text(n):
        return " ".join(draw.choice(letters) for _ in range(n))
    items = [(str(i), text(draw.randrange(16))) for i in range(draw.randrange(8))]
    docs = [draw.choice([text(draw.randrange(60)), "", None, "x y z"]) for _ in range(9)]
    docs += docs[:3]
    assert found(items, docs, window)[0] == brute.decontaminate(items, docs, window)


def test_suffixes_are_sorted_up_to_the_separator():
    draw = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        s = np.append(draw.integers(0, 3, n), 0)
        def key(i):
            stop = i + int(np.argmax(s[i:] == 0))
            return [*s[i:stop].tolist(), 0], i
        assert dc.sort_suffixes(s).tolist() == sorted(range(len(s)), key=key)


def test_locate_gives_every_position():
    s = np.array([1, 2, 1, 2, 1, 0, 1, 2, 0])
    index = dc.FmIndex(s, sample=4)
    window, lo, hi = index.search(np.array([[1, 2], [2, 1], [2, 2], [0, 1]]))
    places = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(window, lo, hi)}
    assert places == {0: [0, 2, 6], 1: [1, 3], 3: [0, 2, 4, 6]}


def test_spans_are_merged_and_cut(spark):
    phrases = dc.read_phrases([("7", "one two three four"), ("8", "three four five six")], 4)
    docs = spark.createDataFrame([(1, "Zero ONE two, three four five six; eight é"), (2, "nothing"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in dc.mark(docs, phrases).collect()}
    assert rows[1].clean_text == "Zero ; eight é" and rows[1]["items"] == ["7", "8"] and rows[1].n_hit == 6
    assert [(s.begin, s.end) for s in rows[1].spans] == [(5, 33)]
    assert rows[2].clean_text == "nothing" and not rows[2].contaminated
    assert rows[3].clean_text is None and rows[3].n_words == 0


def test_odd_rows(odd, empty, spark):
    phrases = dc.read_phrases([(None, "no id"), ("2", None), ("3", "word of a long text")], 10)
    rows = dc.mark(odd, phrases).collect()
    assert len(rows) == odd.count() and rows[0].score == "mine"
    assert [r.contaminated for r in rows if r.doc_id is None] == [True]
    assert next(r for r in rows if r.doc_id == 6).n_items == 1
    assert dc.mark(empty, phrases).count() == 0
    nothing = dc.load_phrases(spark.createDataFrame([], "item_id long, text string"))
    assert {r.contaminated for r in dc.mark(odd, nothing).collect()} == {False}
