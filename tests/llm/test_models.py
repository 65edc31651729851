"""Language ID and toxicity: held-out accuracy, and the parts that can be computed plainly."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wirelark.llm import langid, texts, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_on_held_out_rows(docs):
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs.where(langid.held_out()), model).agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.avg(langid.accepted().cast("double")).alias("kept")).first()
    assert got.right > 0.99 and got.kept > 0.999


def test_bit_sliced_filters_hold_every_learned_gram():
    settings = langid.Settings(slots_log2=10, hashes=3)
    grams = {bit: np.random.default_rng(bit).integers(0, 1 << 32, 20, dtype=np.uint32) for bit in range(70)}
    masks = np.zeros((2, 1 << 10), np.uint64)
    for bit, own in grams.items():
        for slots in langid._slots(own, settings):
            masks[bit // 64][slots] |= np.uint64(1 << (bit % 64))
    for bit, own in grams.items():
        mask = np.bitwise_and.reduce([masks[bit // 64][s] for s in langid._slots(own, settings)])
        assert (mask >> np.uint64(bit % 64) & np.uint64(1)).all()


def test_more_than_64_languages(spark):
    """Every language has an alphabet of its own."""
    rows = [(i, " ".join(chr(0x4E00 + 40 * (i % 70) + k % 37) * 3 for k in range(60)), f"l{i % 70:02d}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 350"))
    assert len(model.languages) == 70
    assert langid.predict(docs.where("doc_id >= 350"), model).where("lang <> lang_pred").count() == 0


def test_language_of_odd_rows(odd, empty, docs):
    model = langid.fit(docs.limit(2000))
    rows = langid.predict(odd, model).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and {by_id[i].lang_pred for i in (1, 2, 3, 4)} == {"und"} and by_id[6].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows) and by_id[6].n_words == "mine"
    assert langid.predict(empty, model).count() == 0
    untaught = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(odd, untaught).collect()} == {"und"}


def test_toxicity_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    rows = toxicity.score(docs.where(toxicity.held_out()), net).join(labels, "doc_id").select("score", "toxic").collect()
    caught = np.mean([r.score >= 0.7 for r in rows if r.toxic == 1])
    wrong = np.mean([r.score >= 0.7 for r in rows if r.toxic == 0])
    assert caught > 0.8 and wrong < 0.02


def test_gradients_against_differences():
    settings = toxicity.Settings(window=5, stride=3, hidden=3, width=4, table_log2=8)
    net = toxicity.Network(settings)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data, offsets = texts.column_bytes(pa.array(["one two three one four five six", "seven two"]))
    words = toxicity.read_words(data, offsets, settings.table_log2)
    first, size, _ = toxicity.window_starts(words.documents, settings)
    steps = np.arange(settings.window)[:, None]
    mask = steps < size
    index = words.which[np.where(mask, first + steps, first)]
    weight = np.linspace(1, 2, len(first))
    keep: dict = {}
    net.forward(net.embed(words), index, mask, keep)
    grad, dx = net.gradients(weight, keep)
    draw = np.random.default_rng(0)
    for name in grad:
        at = tuple(int(draw.integers(n)) for n in net.w[name].shape)
        values = []
        for step in (1e-3, -2e-3):
            net.w[name][at] += step
            values.append(net.forward(net.embed(words), index, mask) @ weight)
        net.w[name][at] += 1e-3
        assert np.isclose((values[0] - values[1]) / 2e-3, np.asarray(grad[name])[at], rtol=2e-2, atol=2e-3), name
    x = net.embed(words)
    moved = x.copy()
    moved[0, 1] += 1e-3
    assert np.isclose((net.forward(moved, index, mask) - net.forward(x, index, mask)) @ weight / 1e-3, dx[0, 1], rtol=5e-2, atol=2e-3)


def test_windows_cover_every_word():
    settings = toxicity.Settings()
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        first, size, owner = toxicity.window_starts(np.array([0, n, n + 3]), settings)
        own = owner == 0
        covered = sorted({w for f, s in zip(first[own], size[own]) for w in range(f, f + s)})
        assert covered == list(range(n)) and (size > 0).all()
        assert all(b - a == settings.stride for a, b in zip(first[own], first[own][1:]))


def test_toxicity_of_odd_rows(spark, odd, empty):
    net = toxicity.Network(toxicity.Settings())
    rows = toxicity.score(odd, net).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (1, 2, 3)} == {0.0} and rows[0].kept == "mine"
    assert toxicity.score(empty, net).count() == 0
    assert toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
