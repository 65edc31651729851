import pytest
from pyspark.sql import functions as F

from wirelark.operators import evaluate as ev


def predictions(spark):
    pairs = [(1, 1)] * 5 + [(1, 0)] * 2 + [(0, 0)] * 8 + [(0, 1)] * 1
    return spark.createDataFrame([("m", t, p) for t, p in pairs], "model string, y_true int, y_pred int")


def test_binary_and_macro(spark):
    r = ev.metrics(predictions(spark)).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == pytest.approx((13 / 16, 5 / 6, 5 / 7, 10 / 13))
    r = ev.metrics(predictions(spark), "macro").first()
    assert (r.precision, r.recall) == pytest.approx(((5 / 6 + 8 / 10) / 2, (5 / 7 + 8 / 9) / 2))
    with pytest.raises(ValueError):
        ev.metrics(predictions(spark), "micro")


def test_zero_division(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 1, 0)], "model string, y_true int, y_pred int")
    r = ev.metrics(df).first()
    assert (r.precision, r.recall, r.f1) == (0, 0, 0)


def test_report_and_confusion(spark):
    report = {r.label: r for r in ev.classification_report(predictions(spark)).collect()}
    assert set(report) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert report["weighted avg"].recall == pytest.approx(13 / 16) and report["1"].support == 7
    cells = {(r.true_name, r.pred_name): r.share for r in ev.confusion_matrix(predictions(spark)).collect()}
    assert cells == pytest.approx({("Benigno", "Benigno"): 8 / 9, ("Benigno", "Maligno"): 1 / 9,
                                   ("Maligno", "Benigno"): 2 / 7, ("Maligno", "Maligno"): 5 / 7})
    lone = spark.createDataFrame([("m", "a", "b")], "model string, y_true string, y_pred string")
    assert {(r.y_true, r.y_pred): r.share for r in ev.confusion_matrix(lone).collect()} == {
        ("a", "a"): 0, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 0}


def test_roc(spark):
    rows = [("m", y, s) for y, s in [(1, 0.9), (1, 0.8), (0, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (0, 0.4), (1, 0.3)]]
    df = spark.createDataFrame(rows, "model string, y int, score double")
    points = [(r.fpr, r.tpr) for r in ev.roc_curve(df).orderBy("fpr", "tpr").collect()]
    assert points == [(0, 0), (0, .25), (.25, .5), (.25, .75), (.5, .75), (.75, .75), (1, .75), (1, 1)]
    fewer = [(r.fpr, r.tpr) for r in ev.roc_curve(df, drop_intermediate=True).orderBy("fpr", "tpr").collect()]
    assert fewer == [(0, 0), (0, .25), (.25, .5), (.25, .75), (1, .75), (1, 1)]
    wins = sum((a > b) + (a == b) / 2 for _, y, a in rows if y for _, z, b in rows if not z)
    assert ev.roc_auc(df).first().auc == pytest.approx(wins / 16)


def test_macro_roc_matches_interpolation(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    names, n = ["a", "b", "c"], 60
    y = [names[i % 3] for i in range(n)]
    proba = rng.integers(1, 9, (n, 3)) / 10
    df = spark.createDataFrame([("m", t, names, p) for t, p in zip(y, proba.tolist())],
                               "model string, y_true string, classes array<string>, proba array<double>")
    curves = []
    for j, c in enumerate(names):
        hit = np.array([t == c for t in y])
        cuts = sorted(set(proba[:, j]), reverse=True)
        curves.append(([0.0] + [(~hit & (proba[:, j] >= s)).sum() / (~hit).sum() for s in cuts],
                       [0.0] + [(hit & (proba[:, j] >= s)).sum() / hit.sum() for s in cuts]))
    grid = np.unique(np.concatenate([c[0] for c in curves]))
    mean = sum(np.interp(grid, *c) for c in curves) / 3
    got = ev.roc_macro(df).orderBy("fpr").collect()
    assert [r.fpr for r in got] == pytest.approx(grid.tolist()) and [r.tpr for r in got] == pytest.approx(mean.tolist())
    assert ev.curve_area(ev.roc_macro(df)).first().auc == pytest.approx(np.trapezoid(mean, grid))


@pytest.mark.parametrize("gap, verdict", [(0.2, "severe"), (0.08, "moderate"), (0.01, "good")])
def test_gap_verdict(spark, gap, verdict):
    table = lambda f1: spark.createDataFrame([("m", 0.9, 0.9, 0.9, f1)],
                                             "model string, accuracy double, precision double, recall double, f1 double")
    rows = ev.overfit_gap(table(0.9), table(0.9 - gap)).collect()
    assert len(rows) == 4 and {r.verdict for r in rows} == {verdict}


def test_comparison_and_class_weights(spark):
    m = ev.metrics(predictions(spark).union(predictions(spark).withColumn("model", F.lit("k")).select("model", "y_true", "y_pred")))
    rows = {r.metric: (r.m, r.k) for r in ev.comparison(m, ["m", "k"]).collect()}
    assert rows["accuracy"] == (81.25, 81.25)
    w = spark.createDataFrame([("f1", "a", -3.0), ("f1", "b", 1.0), ("f2", "a", 2.0)], "feature string, class string, coefficient double")
    (r,) = ev.top_weights_by_class(w, ["a", "b"], 1).collect()
    assert (r.feature, r.peak, r.a, r.b) == ("f1", 3.0, -3.0, 1.0)
