import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from wirelark.llm import minhash, queries, shingles as sh, texts

WORDS = [f"w{i}" for i in range(3000)]


def shingles(text):
    words = brute.VISIBLE.findall(brute.lower(text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def wanted(docs):
    """doc_id -> (set size, smallest id reachable over pairs with 100 * intersection >= 85 * union)."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs)}


def found(df, **settings):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(df, settings=minhash.Settings(**settings)).collect()}


def changed(draw, words, n):
    words = list(words)
    for at in draw.sample(range(len(words)), n):
        words[at] = draw.choice(WORDS)
    return " ".join(words)


def test_links_around_the_bound(spark):
    """Texts of 60 to 500 words with a few replaced, some pairs just over and some just under the bound."""
    draw, docs = random.Random(3), []
    for size, n in ((60, 1), (100, 1), (100, 2), (200, 1), (200, 3), (200, 4), (500, 7), (500, 8), (500, 9)):
        for _ in range(12):
            words = draw.choices(WORDS, k=size)
            docs += [(len(docs) + 10, " ".join(words)), (len(docs) + 11, changed(draw, words, n).upper())]
    docs += [(2, None), (3, ""), (4, docs[0][1]), (5, "a b"), (6, "A  b"), (7, "a b c"), (8, " \n")]
    draw.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df) == wanted(docs)


@pytest.mark.parametrize("settings", [{}, {"rounds": 0, "tile": 20}, {"rounds": 1, "tile": 5}])
def test_one_loose_group(spark, settings):
    """Copies of one text of which each is near some of the others only, and texts with a common passage."""
    draw = random.Random(5)
    base, passage, docs = draw.choices(WORDS, k=150), draw.choices(WORDS, k=60), []
    for i in range(200):
        docs.append((i, changed(draw, base, draw.randint(0, 7))))
    for i in range(200, 260):
        docs.append((i, " ".join(passage + draw.choices(WORDS, k=15))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df, **settings) == wanted(docs)


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SPREAD", 10)
    draw = random.Random(6)
    base = draw.choices(WORDS, k=120)
    docs = [(i, changed(draw, base, 1) if i % 3 else " ".join(base)) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(df) == wanted(docs)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


@pytest.mark.parametrize("spread, piece", [(4096, 1 << 20), (2, 5)])
def test_stars_of_any_graph(spark, monkeypatch, spread, piece):
    """Sparse graphs, a long path in random order and hubs above their neighbours, dealt over tasks and in pieces."""
    monkeypatch.setattr(minhash, "SPREAD", spread)
    monkeypatch.setattr(minhash, "PIECE", piece)
    draw = random.Random(4)
    path = draw.sample(range(-10_000, 0), 300)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(250)] + list(zip(path, path[1:]))
    edges += [(9000, i) for i in range(5000, 5040)] + [(5000 + i, 9001 + i % 3) for i in range(40)] + [(3, 3)]
    draw.shuffle(edges)
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {x: i for i, x in enumerate(nodes)}
    a, b = (np.array([at[e[k]] for e in edges if e[0] != e[1]]) for k in (0, 1))
    root = minhash.forest(a, b, len(nodes))
    wanted = {x: nodes[root[i]] for i, x in enumerate(nodes)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = [(r.node, r.root) for r in minhash.stars(df).collect()]
    assert len(got) == len(dict(got)) and dict(got) == {x: r for x, r in wanted.items() if x != r}
    assert {r.node: r.root for r in minhash.components(df).collect()} == wanted
    assert minhash.stars(df.limit(0)).count() == 0


def test_recall_of_the_bands_at_the_bound():
    draw, docs = random.Random(9), []
    while len(docs) < 2000:
        words = draw.choices(WORDS, k=250)
        other = changed(draw, words, 4)
        both = len(shingles(" ".join(words)) & shingles(other))
        if both / (2 * 246 - both) < 0.87:
            docs += [" ".join(words), other]
    data, offsets = texts.column_bytes(pa.array(docs, pa.string()))
    hashes, first = sh.shingles_of(data, offsets)
    settings = minhash.Settings()
    least = minhash.minima(hashes, first, settings)
    bands = minhash.buckets(least, settings)
    assert (bands[0::2] == bands[1::2]).any(1).all()
    low = least.astype(np.uint8)
    assert ((low[0::2] == low[1::2]).sum(1) >= settings.agreeing).all()


def test_odd_rows(odd, empty):
    """Null, empty and blank texts are linked with nothing, repeated rows are one class, other columns do not matter."""
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in minhash.groups(odd).collect())
    assert rows == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (5, 1, 5), (6, 5, 6)]
    assert minhash.groups(empty).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = wanted(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op12_minhash(spark, sf).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
