import pytest

from wirelark.llm import toxicity


def rows(spark, long_ids=()):
    data = [(i, ("vile " if i % 4 == 0 else "kind ") * (20 if i not in long_ids else 2000) + "words", int(i % 4 == 0)) for i in range(80)]
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    return docs.select("doc_id", "text"), docs.select("doc_id", "toxic")


def test_a_text_that_does_not_fit_is_passed_over(spark):
    """Every document but the long ones is learned from, wherever the long ones stand in the order."""
    settings = toxicity.Settings(fit_bytes=18_000, batch=8)
    docs, labels = rows(spark, long_ids=range(0, 8))
    net = toxicity.fit(docs, labels, settings)
    assert net is not None
    got = toxicity.score(docs, net).join(labels, "doc_id").where("doc_id >= 8").collect()
    assert min(r.score for r in got if r.toxic) > max(r.score for r in got if not r.toxic)


def test_each_label_has_half_of_the_bytes():
    taken, labelled = toxicity.fitting([(1, "", 0, 90), (2, "", 0, 40), (3, "", 1, 30), (4, "", 1, 60), (5, "", 1, 20), (6, "", 0, 20)], 100)
    assert [d for d, _, _ in taken] == [2, 3, 5] and labelled == {0, 1}


def test_labels_without_a_text_that_fits_are_an_error(spark):
    docs, labels = rows(spark)
    with pytest.raises(ValueError):
        toxicity.fit(docs, labels, toxicity.Settings(fit_bytes=100))
