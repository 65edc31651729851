"""Every query with SQL against DuckDB on the smallest tables (the fits have tests of their own)."""

import pytest

import oracle
from wirelark.plans import all_queries

QUERIES, ORACLES = all_queries()
SLOW = ("train_", "oof_", "model_", "selected_", "stream_")


@pytest.fixture(scope="module")
def con():
    return oracle.connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [n for n in ORACLES if not n.startswith(SLOW)])
def test_oracle(spark, sf_dir, con, name):
    verdict = oracle.compare(name, QUERIES[name], ORACLES[name], spark, con, sf_dir)
    assert verdict in (None, "no rows")


def test_registry():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
