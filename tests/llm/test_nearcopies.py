import random

import numpy as np
import pyarrow as pa

from tests.llm import brute
from wirelark.llm import nearcopies, texts

WORDS = [f"w{i}" for i in range(3000)]


def shingles(text):
    words = brute.VISIBLE.findall(brute.lower(text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def wanted_groups(docs):
    """doc_id -> smallest id reachable over pairs with a 5-word Jaccard similarity of at least 0.8."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, (i, _) in enumerate(docs)}


def copies(seed, sizes, changes, n):
    draw, docs = random.Random(seed), []
    for size, changed in zip(sizes, changes):
        for _ in range(n):
            words = draw.choices(WORDS, k=size)
            docs.append((len(docs) + 10, " ".join(words)))
            for at in draw.sample(range(size), changed):
                words[at] = "other"
            docs.append((len(docs) + 10, " ".join(words)))
    return docs


def test_stage_finds_copies_down_to_four_fifths(spark):
    """Texts of 100 to 500 words with a few replaced, most of them out of reach of radius 3."""
    import corpus_pipeline
    docs = copies(3, (100, 100, 200, 200, 200, 500, 500, 60), (1, 2, 1, 2, 4, 4, 8, 6), 15)
    docs += [(2, None), (3, ""), (4, docs[0][1]), (5, "a b"), (6, "A  b"), (7, "a b c")]
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.groups(df).collect()}
    assert got == wanted_groups(docs)
    kept = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near duplicates"](spark, df, "").collect())
    assert kept == sorted(set(got.values()))


def test_one_large_loose_group(spark):
    """Copies of one text that are close to some of the others only."""
    draw = random.Random(5)
    base, docs = draw.choices(WORDS, k=150), []
    for i in range(150):
        words = list(base)
        for at in draw.sample(range(150), 3):
            words[at] = draw.choice(WORDS)
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.groups(df).collect()} == wanted_groups(docs)


def test_jobs_stay_few(spark):
    """The plans of each job stay in the driver for a while: 200 jobs a call took it over its memory."""
    docs = copies(9, (60, 100, 200), (1, 2, 4), 10)
    spark.sparkContext.setJobGroup("near copies", "")
    try:
        got = {r.doc_id: r.component_id for r in nearcopies.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near copies"))
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert got == wanted_groups(docs) and 0 < jobs <= 90


def test_bands_recall_at_the_bound():
    """Pairs with a similarity of 0.80 to 0.83 share a bucket."""
    docs = copies(7, (200,), (4,), 1500)
    data, offsets = texts.column_bytes(pa.array([t for _, t in docs], pa.string()))
    hashes, first = nearcopies.shingles_of(data, offsets)
    assert [set(hashes[b:e]).__len__() for b, e in zip(first, first[1:])] == [len(shingles(t)) for _, t in docs]
    bands = nearcopies.bands_of(hashes, first)
    assert (bands[0::2] == bands[1::2]).any(1).all()


def test_odd_rows(odd, empty):
    rows = nearcopies.groups(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    kept = nearcopies.keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 6] and kept[0].component_id == "mine"
    assert nearcopies.keep_one(empty).count() == 0
