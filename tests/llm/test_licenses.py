import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from wirelark.llm import licenses, texts

INDEX = licenses.build()


def scan(docs):
    data, offsets = texts.column_bytes(pa.array(docs, pa.string()))
    return licenses.scan(INDEX, data, offsets)


def edited(words, draw, n):
    words = list(words)
    for _ in range(n):
        at = draw.randrange(len(words))
        words[at:at + 1] = draw.choice([[], ["altered"], [words[at], "added"]])
    return words


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_found_inside_prose(name):
    text = f"Prose é before.\n{licenses.TEMPLATES[name].upper()}\nand after it"
    (found,) = scan([text])
    assert [f[:2] for f in found] == [(name, 1.0)]
    raw = text.encode()[found[0][2]:found[0][3]].decode()
    assert brute.ALNUM.findall(brute.lower(raw)) == brute.ALNUM.findall(brute.lower(licenses.TEMPLATES[name]))


def test_edited_copies_against_the_full_alignment():
    """Copies with a few words altered: the banded alignment matches as many words as the whole table of
    alignments, wherever that is enough to report."""
    draw = random.Random(1)
    for name in ("mit-text", "apache-2.0-header", "gpl-header"):
        words = brute.ALNUM.findall(brute.lower(licenses.TEMPLATES[name]))
        for n in range(0, 6):
            copy = edited(words, draw, n)
            text = " ".join(["before", "it"] + copy + ["after"])
            best = longest_common(words, copy)
            found = [f for f in scan([text])[0] if f[0] == name]
            assert found and found[0][1] >= (best - 2) / len(words)


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def test_copies_at_several_places_and_borders():
    mit, cc = licenses.TEMPLATES["mit-notice"], licenses.TEMPLATES["cc-by-nc-4.0-notice"]
    got = scan([f"{mit}. x {cc}", "", None, mit, cc, f"{mit} {mit}", "Released under the", "MIT License", "the words are free"])
    assert [[f[0] for f in d] for d in got] == [["mit-notice", "cc-by-nc-4.0-notice"], [], [], ["mit-notice"], ["cc-by-nc-4.0-notice"], ["mit-notice"] * 2, [], [], []]


def test_winnowing_keeps_one_of_every_window():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50):
        grams = draw.integers(0, 5, n).astype(np.uint64)
        kept = set(licenses.winnow(grams).tolist())
        assert all(kept & set(range(i, i + licenses.WINNOW)) for i in range(n - licenses.WINNOW + 1))


def test_odd_rows(odd, empty):
    rows = licenses.find_licenses(odd, INDEX).collect()
    assert len(rows) == odd.count() and not any(r.findings for r in rows) and rows[0].score == "mine"
    assert licenses.find_licenses(empty, INDEX).count() == 0
    with pytest.raises(ValueError):
        licenses.build({"x": "two words"})
