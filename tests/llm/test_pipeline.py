"""The pipeline's stages on the sample tables against plain versions of what each must keep."""

import pytest

import oracle
from tests.llm import brute
from tests.llm.test_nearcopies import wanted_groups
from wirelark.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    verdict = oracle.compare(name, queries.QUERIES[name], queries.ORACLES[name], spark, oracle.connect(SF), SF)
    assert verdict is None


def test_stages(spark):
    import corpus_pipeline
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = stages["language ID"](spark, docs, SF).cache()
    assert known.columns == docs.columns and known.count() > 0.99 * docs.count()
    mild = stages["toxicity"](spark, known, SF).cache()
    assert mild.columns == docs.columns and 0.85 * known.count() < mild.count() < known.count()
    unique = stages["near duplicates"](spark, mild, SF).cache()
    wanted = wanted_groups([(r.doc_id, r.text) for r in mild.collect()])
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(wanted.values()))
    clean = stages["benchmark decontamination"](spark, unique, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = unique.collect()
    hits = brute.decontaminate(items, [r.text for r in rows])
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r, h in zip(rows, hits) if not h[1])
    def number(source):
        digits = source[len(source.rstrip("0123456789")):] if source else ""
        return int(digits) if digits else 0
    rows = [(r.doc_id, r.text, number(r.source) % 4, r.lang, r.source) for r in clean.collect()]
    weights = [lambda v: v + 1, lambda v: 3 if v == "en" else 2, lambda v: number(v) % 3 + 1]
    mixed = sorted((r.doc_id, r.epoch) for r in stages["mixture"](spark, clean, SF).collect())
    assert mixed == sorted(brute.mixture(rows, 3, weights, queries.MIXTURE["share"], queries.MIXTURE["epochs"], queries.MIXTURE["seed"]))


def test_odd_rows(spark, odd, empty):
    """Each stage takes nulls, repeated rows, clashing names and an empty table."""
    import corpus_pipeline
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert set(docs.columns) <= set(out.columns)
            assert out.count() >= 0


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
