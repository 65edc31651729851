import random

import numpy as np
import pyarrow as pa

from tests.llm import brute
from wirelark.llm import simhash, texts

WORDS = [f"w{i}" for i in range(300)]


def test_fingerprints_against_brute_force():
    docs = ["", None, "A", "a b", " é x\ty\n z ", "one two three", "x " * 500, "\x0b\x0c", *(" ".join(random.Random(i).choices(WORDS, k=i)) for i in range(1, 40))]
    data, offsets = texts.column_bytes(pa.array(docs, pa.string()))
    assert simhash.fingerprints_of(data, offsets).tolist() == [brute.simhash(t) for t in docs]


def test_groups_against_brute_force(spark):
    draw, docs = random.Random(3), []
    for i in range(60):
        words = draw.choices(WORDS, k=draw.choice([5, 60, 400]))
        docs.append((len(docs) + 10, " ".join(words)))
        for _ in range(draw.randrange(3)):
            words[draw.randrange(len(words))] = "other"
            docs.append((len(docs) + 10, " ".join(words)))
    docs += [(2, None), (3, ""), (4, docs[0][1]), (5, docs[0][1])]
    draw.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.groups(df).collect()}
    assert got == brute.simhash_groups(docs)
    kept = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    assert kept == sorted(set(got.values()))


def test_links_lose_nothing_and_stay_few(spark):
    """A dense cluster: one edge per member and tile pair at most, and the same components."""
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << draw.integers(0, 64, (40, 60, 2)).astype(np.uint64)
    fps = np.unique((base[:, None] ^ flips[:, :, 0] ^ flips[:, :, 1]).ravel())
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.links(df).collect()
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    a, b = np.array([(place[e.a], place[e.b]) for e in edges]).T
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    wanted = simhash.forest(*np.nonzero(near), len(fps))
    assert (simhash.forest(a, b, len(fps)) == wanted).all()
    assert all(near[x, y] or wanted[x] == wanted[y] for x, y in zip(a, b))


def test_components(spark):
    """A long chain, a star with a hub, repeated and looped edges."""
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(7, 1000), (5, 5), (1100, 3)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 3 for i in (3, 7, *range(1000, 1200))}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, empty):
    rows = simhash.groups(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 6] and kept[0].component_id == "mine"
    assert simhash.groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0
