"""With tiny chunks every key is cut many times; results must not change."""

import pytest

from oracle import normalise
from wirelark.plans import all_queries

NAMES = ["flow_features70", "flow_sessions", "flow_early_emit", "port_scan", "conn_flood", "alert_suppressed",
         "log_segments", "stratified_sample", "simple_sample", "stratified_kfold", "impute_median",
         "roc_curve", "roc_auc", "roc_macro", "roc_macro_auc", "learning_curve_subsets"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_with_split_keys(spark, sf_dir, name):
    fn = all_queries()[0][name]
    spark.conf.unset("wirelark.chunkRows")
    whole = fn(spark, sf_dir)
    want = normalise(whole.columns, [tuple(r) for r in whole.collect()])
    spark.conf.set("wirelark.chunkRows", "40")
    try:
        cut = fn(spark, sf_dir)
        got = normalise(cut.columns, [tuple(r) for r in cut.collect()])
    finally:
        spark.conf.unset("wirelark.chunkRows")
    assert got[0] == want[0] and len(got[1]) == len(want[1]) > 0
    for g, w in zip(got[1], want[1]):
        assert g == pytest.approx(w) if not any(isinstance(x, str) for x in g) else g == w


def test_chunks_stay_small(spark):
    """Half of the rows under one key: its chunks are about as large as asked for."""
    from pyspark.sql import functions as F

    from wirelark.operators.ordered import CHUNK, with_chunks
    df = spark.range(40000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"),
                                   F.col("id").alias("t"))
    chunked, split = with_chunks(df, ["k"], ["t"], 500)
    sizes = chunked.groupBy("k", CHUNK).count()
    assert split and sizes.agg(F.max("count")).first()[0] < 500 * 12
    assert sizes.where("k = 0").count() > 15
