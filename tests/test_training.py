import math
import random
import statistics

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wirelark.operators import prep, sampling
from wirelark.sources import flowtable
from wirelark.sources.scratch import shared_folder


def test_drop_columns(spark):
    df = spark.createDataFrame([(1, "a", "b", "t", 0, 0.5), (2, "c", "d", "u", 0, 0.7)],
                               ["Flow ID", "Src IP", "Dst IP", "Timestamp", "Bwd PSH Flags", "Valid_Feature"])
    assert flowtable.drop_irrelevant(df).columns == ["Valid_Feature"]


def test_clean(spark):
    rows = [(1.0, "a"), (1.0 + 1e-9, "a"), (float("nan"), "a"), (float("-inf"), "b"), (2.0, None), (3.0, "c")]
    got = flowtable.clean(spark.createDataFrame(rows, "x double, Label string")).collect()
    assert sorted((r.x, r.Label) for r in got) == [(1.0, "a"), (3.0, "c")]      # near values merge


def test_csv_with_padded_names(spark, tmp_path):
    path = tmp_path / "flows.csv"
    path.write_text(" Flow Duration , Label\n1.5, BENIGN\nInfinity,DoS\nNaN,DoS\n")
    df = flowtable.read(spark, str(path), "a double, b string").toDF(" Flow Duration ", " Label")
    df = flowtable.strip_names(df)
    assert df.columns == ["Flow Duration", "Label"] and flowtable.clean(df).count() == 1
    assert flowtable.read(spark, str(path)).columns == ["Flow Duration", "Label"]


def test_rare_classes_and_target(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else " Benign ") for i in range(10)], "id long, Label string")
    assert {r.Label for r in flowtable.drop_rare_classes(df).collect()} == {"a"}
    assert [r.target for r in flowtable.with_target(df).orderBy("id").collect()] == [1] * 6 + [0] * 4
    assert {r.target for r in flowtable.with_target(df, "multiclass").collect()} == {"a", "Benign"}
    with pytest.raises(ValueError):
        flowtable.with_target(df, "other")


def labelled(spark, n=500):
    rng = random.Random(7)
    rows = [(i * 7919, rng.choice("aaaaaaabbc")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id long, target string")


def test_stratified_sample_counts(spark):
    rows, df = labelled(spark)
    got = sampling.stratified_sample(df, 0.25, "target").groupBy("target").count().collect()
    want = {c: round(0.25 * sum(r[1] == c for r in rows)) for c in "abc"}
    assert {r["target"]: r["count"] for r in got} == want
    assert sampling.simple_sample(df, 0.25).count() == round(0.25 * len(rows))
    assert sampling.sample(df, 1.0).count() == len(rows)


def test_split_and_folds(spark):
    rows, df = labelled(spark)
    train, test = sampling.train_test_split(df)
    assert test.count() == math.ceil(0.2 * len(rows)) and train.count() + test.count() == len(rows)
    assert train.join(test, "row_id").count() == 0
    for c in "abc":
        n = sum(r[1] == c for r in rows)
        assert abs(test.where(F.col("target") == c).count() - 0.2 * n) < 1
    folds = sampling.stratified_folds(df, 5).groupBy("target", "fold").count().collect()
    for c in "abc":
        sizes = [r["count"] for r in folds if r["target"] == c]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_exact_quantiles(spark):
    rng = random.Random(1)
    values = [rng.choice([None, round(rng.gauss(0, 5), 1)]) for _ in range(301)]
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(values)], "x double, y double")
    got = prep.exact_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75])
    known = sorted(v for v in values if v is not None)
    assert got["x"] == pytest.approx(statistics.quantiles(known, n=4, method="inclusive"))
    assert got["y"] == [75.0, 150.0, 225.0]
    assert prep.exact_quantiles(df.where("x is null"), ["x"], [0.5]) == {"x": [None]}
    # a coarse sketch over many rows and ties still ends in exact values
    many = spark.range(20000).select(((F.col("id") * 7919) % 20011).cast("double").alias("u"),
                                     F.floor(F.sqrt("id")).cast("double").alias("t"))
    for accuracy in (20, 200):
        got = prep.exact_quantiles(many, ["u", "t"], [0.0, 0.1, 0.5, 0.9, 1.0], accuracy)
        for c in ("u", "t"):
            known = sorted(r[0] for r in many.select(c).collect())
            cuts = statistics.quantiles(known, n=10, method="inclusive")
            assert got[c] == pytest.approx([known[0], cuts[0], cuts[4], cuts[8], known[-1]])


def test_robust_preprocessor_and_round_trip(spark):
    rows = [(1.0, 10.0, 7.0, "TCP"), (2.0, None, 7.0, "UDP"), (3.0, 30.0, 7.0, "TCP"), (100.0, 40.0, 7.0, None)]
    df = spark.createDataFrame(rows, "num1 double, num2 double, flat double, cat1 string")
    model = prep.fit_preprocessor(df, ["num1", "num2", "flat"], ["cat1"], "robust")
    out = prep.transform(model, df)
    got = [r[0] for r in out.select(vector_to_array("features")).collect()]
    assert len(got) == 4 and len(got[0]) == 2 + 3
    spread = 27.25 - 1.75
    assert [r[0] for r in got] == pytest.approx([(x - 2.5) / spread for x in (1, 2, 3, 100)])
    assert [r[1] for r in got] == pytest.approx([(x - 30) / 7.5 for x in (10, 30, 30, 40)])
    assert [r[2:] for r in got] == [[1, 0, 0], [0, 1, 0], [1, 0, 0], [0, 0, 1]]
    assert prep.feature_names(out, 5) == ["num1", "num2", "cat1_TCP", "cat1_UDP", "cat1_missing"]
    assert prep.feature_names(df.withColumn("features", F.lit(1)), 2) == ["feature_0", "feature_1"]
    from wirelark.operators import learners
    learners.save(model, folder := shared_folder(spark, "test"), "scaler", "binary")
    again = prep.transform(learners.load(folder, "scaler", "binary"), df.withColumn("cat1", F.lit("ICMP")))
    assert [r[0][2:] for r in again.select(vector_to_array("features")).collect()] == [[0, 0, 0]] * 4


def test_log_standard(spark):
    values = [0.0, -3.0, 9.0, 99.0]
    df = spark.createDataFrame([(v, "6") for v in values], "x double, Protocol string")
    out = prep.transform(prep.fit_preprocessor(df, ["x"], [], "log_standard"), df)
    logs = [math.log1p(max(v, 0)) for v in values]
    got = [r[0][0] for r in out.select(vector_to_array("features")).collect()]
    assert got == pytest.approx([(x - statistics.mean(logs)) / statistics.pstdev(logs) for x in logs])


def test_anova_selects_the_informative_column(spark):
    rng = random.Random(3)
    rows = [(rng.random(), i % 2 + rng.random() / 10, rng.random(), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, target double")
    top = prep.top_features(prep.anova_f(df, ["a", "b", "c"]), 1).collect()
    assert [r.feature for r in top] == ["b"]
    from pyspark.ml.feature import VectorAssembler
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    assert prep.fit_selector(vec, 1).getIndices() == [1]
    assert prep.fit_selector(vec, 0).getIndices() == [0, 1, 2]
    by_column = {r.feature: r.f_value for r in prep.anova_f(df, ["a", "b", "c"]).collect()}
    assert prep.vector_anova(vec) == pytest.approx([by_column[c] for c in "abc"])


def test_anova_keeps_the_spread_of_large_values(spark):
    """Values of 1e9 and a bit: the F value is that of the bits."""
    from pyspark.ml.linalg import Vectors
    rows = [(i % 3, float((i * 7) % 11 + i % 3)) for i in range(90)]
    small = prep.anova_f(spark.createDataFrame(rows, "target int, a double"), ["a"]).first().f_value
    large = spark.createDataFrame([(t, 1e9 + v) for t, v in rows], "target int, a double").repartition(5)
    assert prep.anova_f(large, ["a"]).first().f_value == pytest.approx(small, rel=1e-6)
    vectors = spark.createDataFrame([(t, Vectors.dense([1e9 + v])) for t, v in rows], ["target", "features"]).repartition(5)
    assert prep.vector_anova(vectors) == pytest.approx([small], rel=1e-6)
