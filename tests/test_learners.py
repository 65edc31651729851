import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wirelark.operators import evaluate as ev
from wirelark.operators import learners
from wirelark.sources.scratch import shared_folder

SMALL = learners.Settings(changes={
    "linearsvc": dict(max_iter=10), "rf": dict(trees=3, depth=3), "et": dict(trees=3, depth=3), "dt": dict(depth=3),
    "mlp": dict(hidden=(4,), max_iter=5), "hgb": dict(rounds=2, depth=2), "meta": dict(max_iter=10),
    "linearsvcCalibrated": dict(max_iter=5, folds=2)})


def data(spark, classes=2, n=150):
    rng = random.Random(classes)
    rows = []
    for i in range(n):
        y = i % classes
        rows.append((i, float(y), Vectors.dense([y + rng.gauss(0, 0.4), rng.random(), -y + rng.gauss(0, 0.6)])))
    return spark.createDataFrame(rows, ["row_id", "label", "features"]).repartition(2).cache()


def probabilities(scored, name):
    return [r[0] for r in scored.select(vector_to_array(f"{name}_probability")).collect()]


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("name", learners.LEARNERS)
def test_learner(spark, name, classes):
    df = data(spark, classes)
    scored = learners.fit_learner(name, df, classes, SMALL).transform(df)
    if name == "linearsvc":
        assert learners.f1_of(scored, "linearsvc_prediction", classes) > 0.5
        return
    rows = probabilities(scored, name)
    assert len(rows) == 150 and all(len(r) == classes and sum(r) == pytest.approx(1) for r in rows)
    if name != "mlp":
        right = sum(max(range(classes), key=r.__getitem__) == int(l[0])
                    for r, l in zip(rows, scored.select("label").collect()))
        assert right > 80


def test_isotonic_calibration(spark):
    df = data(spark)
    settings = SMALL.but("linearsvcCalibrated", method="isotonic")
    rows = probabilities(learners.fit_learner("linearsvcCalibrated", df, 2, settings).transform(df), "linearsvcCalibrated")
    assert all(sum(r) == pytest.approx(1) for r in rows)


@pytest.mark.parametrize("classes, passthrough", [(2, False), (3, True)])
def test_stacking(spark, classes, passthrough):
    df, names = data(spark, classes), ["dt", "rf"]
    model = learners.fit_stacking(df, classes, names=names, cv_splits=2, passthrough=passthrough, settings=SMALL)
    rows = probabilities(model.transform(df), "stacking")
    assert all(len(r) == classes and sum(r) == pytest.approx(1) for r in rows)
    weights = learners.stacking_weights(model, names, classes)
    width = (2 if classes == 2 else 2 * classes) + (3 if passthrough else 0)
    assert len(weights) == width * (1 if classes == 2 else classes)
    folder = shared_folder(spark, "test")
    learners.save(model, folder, "stacking", "x")
    again = probabilities(learners.load(folder, "stacking", "x").transform(df), "stacking")
    assert sum(again, []) == pytest.approx(sum(rows, []))


def test_out_of_fold_rows_were_not_seen(spark):
    """A learner that only remembers its rows scores them at chance out of fold."""
    rng = random.Random(5)
    rows = [(i, float(rng.random() < 0.5), Vectors.dense([float(i)])) for i in range(30)]
    df = spark.createDataFrame(rows, ["row_id", "label", "features"])
    deep = SMALL.but("dt", depth=15, leaf=1, split=2, alpha=0.0)
    inside = learners.f1_of(learners.fit_learner("dt", df, 2, deep).transform(df), "dt_prediction", 2)
    oof = learners.out_of_fold(df, ["dt"], 2, 4, deep)
    assert oof.select("row_id").distinct().count() == oof.count() == 30
    guess = oof.withColumn("g", (F.get(vector_to_array("meta_features"), F.lit(0)) > 0.5).cast("double"))
    assert inside > 0.8 > learners.f1_of(guess, "g", 2)


def test_profiles():
    assert learners.profile_learners() == ["linearsvcCalibrated", "hgb", "rf"]
    assert learners.profile_learners("padrao") == ["linearsvcCalibrated", "dt"]
    assert learners.profile_learners(names=["rf", "nope", "dt"]) == ["rf", "dt"]
    with pytest.raises(ValueError):
        learners.profile_learners("nope")


def test_train_some_and_load_the_rest(spark):
    df, folder = data(spark), shared_folder(spark, "test")
    assert set(learners.train_models(df, 2, ["dt"], folder, "binary", settings=SMALL)) == {"dt"}
    assert set(learners.train_models(df, 2, ["rf"], folder, "binary", settings=SMALL)) == {"rf", "dt"}


def test_diagnostics(spark):
    df = data(spark)
    tree = learners.tree_complexity(learners.fit_learner("dt", df, 2, SMALL), 150)
    assert tree["depth"] <= 3 == tree["max_depth"] and tree["rows_per_leaf"] == 150 / tree["leaves"]
    scores = learners.cv_scores(df, 2, 3, SMALL)
    assert len(scores) == 3 and all(0 <= s <= 1 for _, s in scores)
    curve = learners.validation_curve(df, 2, (1, 3), 2, SMALL)
    assert [(d, f) for d, f, *_ in curve] == [(1, 0), (1, 1), (3, 0), (3, 1)]
    assert len(learners.learning_curve(df, 2, (0.5, 1.0), 2, SMALL)) == 4
    table = spark.createDataFrame([("m", f, s) for f, s in scores], "model string, fold int, score double")
    assert ev.fold_summary(table).first()["mean"] == pytest.approx(sum(s for _, s in scores) / 3)


def test_svm_weights(spark):
    df = data(spark)
    coefs = learners.svm_coefficients(learners.fit_learner("linearsvc", df, 2, SMALL), ["a", "b", "c"])
    table = spark.createDataFrame(coefs, "class int, feature string, coefficient double")
    top = ev.top_weights(table, 2).collect()
    assert len(top) == 2 and top[0].coefficient <= top[1].coefficient
    assert all((r.tendency == "Ataque") == (r.coefficient > 0) for r in top)
