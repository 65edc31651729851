"""Whole runs: a labelled flow table to trained, saved and evaluated models, and the diagnosis of
an overfitted tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from wirelark.operators import evaluate as ev
from wirelark.operators import learners, prep, sampling
from wirelark.operators.bounded import few_values
from wirelark.sources import flowtable
from wirelark.sources.scratch import cut_lineage


@dataclass
class Prepared:
    """Train and test rows with `label`, `features` and `target`, and what turned one into the other."""
    train: DataFrame
    test: DataFrame
    classes: list
    preprocessor: PipelineModel
    names: list[str]

    @property
    def k(self) -> int:
        return len(self.classes)


@dataclass
class Report:
    """Evaluation tables of several models on the same test rows."""
    metrics: DataFrame
    classification: DataFrame
    confusion: DataFrame
    roc: DataFrame | None
    auc: DataFrame | None
    comparison: DataFrame
    latency: dict[str, float]
    svm_weights: DataFrame | None = None
    stacking_weights: list = field(default_factory=list)


def unique_classes(rows: DataFrame, target: str = "target") -> list:
    """The classes that occur, in order; null is none."""
    return sorted(c for c in few_values(rows, target) if c is not None)


def prepare(flows: DataFrame, mode: str = "binary", sample_fraction: float = 1.0, scale: str = "log_standard",
            label: str = "Label", row_id: str = "row_id", seed: int = 42, drop_rare: bool = False,
            preprocessor: PipelineModel | None = None) -> Prepared:
    """Cleans, samples, labels, splits and preprocesses. Rare classes are dropped when the table is
    sampled, or when asked for. `row_id` is a unique whole number per row of the flow table; where
    there is no such column, one is made of the rows' content. A preprocessor that was saved before
    may be given; otherwise one is fitted on the training side."""
    rows = flowtable.clean(flowtable.with_protocol(flows), keep=(row_id,))
    if row_id not in rows.columns:
        rows = flowtable.with_row_id(cut_lineage(rows, "cleaned"), row_id)
    rows = cut_lineage(rows, "cleaned")
    if sample_fraction < 1.0:
        rows = sampling.sample(rows, sample_fraction, label, row_id, seed)
    if sample_fraction < 1.0 or drop_rare:
        rows = flowtable.drop_rare_classes(rows, label)
    rows = flowtable.with_target(flowtable.drop_irrelevant(rows), mode, label)
    classes = unique_classes(rows)
    label_of = F.array(*map(F.lit, classes))
    rows = rows.withColumn("label", (F.array_position(label_of, F.col("target")) - 1).cast("double"))
    marked = cut_lineage(sampling.train_test_marks(rows, 0.2, "target", row_id, seed)
                         .withColumnRenamed(row_id, "row_id"), "split")
    train = marked.where(~F.col("is_test"))
    if preprocessor is None:
        numeric, categorical = flowtable.feature_columns(train, leave=("target", "row_id", "label", "is_test"))
        preprocessor = prep.fit_preprocessor(train, numeric, categorical, scale)
    ready = prep.transform(preprocessor, marked)
    stored = cut_lineage(ready.select("row_id", "target", "label", "is_test", "features"), "features")
    names = prep.feature_names(ready, len(stored.select("features").first()["features"]))
    return Prepared(stored.where(~F.col("is_test")).drop("is_test"), stored.where("is_test").drop("is_test"),
                    classes, preprocessor, names)


def train(data: Prepared, folder: str, mode: str, wanted=("linearsvc", "rf", "dt", "mlp"),
          stacking: str | None = "edge", cv_splits: int = 5, passthrough: bool = False, n_jobs: int | None = None,
          settings: learners.Settings = learners.Settings()) -> dict[str, PipelineModel]:
    """Trains and saves what is wanted, and loads the rest where it was saved before. The tree and
    the ensemble are also saved together with the preprocessor, ready for detection."""
    learners.save(data.preprocessor, folder, "scaler", mode)
    models = learners.train_models(data.train, data.k, wanted, folder, mode, settings=settings)
    if "dt" in wanted:
        learners.save(learners.with_preprocessor(data.preprocessor, models["dt"]), folder, "dt_pipeline", mode)
    if stacking is not None:
        models["stacking"] = learners.fit_stacking(data.train, data.k, stacking, cv_splits=cv_splits,
                                                   passthrough=passthrough, n_jobs=n_jobs, settings=settings)
        learners.save(models["stacking"], folder, "stacking", mode)
        learners.save(PipelineModel([models["stacking"].stages[-1]]), folder, "meta_learner", mode)
        learners.save(learners.with_preprocessor(data.preprocessor, models["stacking"]), folder,
                      "stacking_pipeline", mode)
    return models


def predictions(models: dict[str, PipelineModel], data: Prepared) -> DataFrame:
    """(model, row_id, y_true, y_pred, classes, proba, score) of all models on the test rows."""
    names = F.array(*[F.lit(str(c)) for c in data.classes])
    parts = None
    for name, model in models.items():
        scored = model.transform(data.test)
        column = "linearsvcCalibrated" if name == "linearsvcCalibrated" else name
        if f"{column}_prediction" not in scored.columns:               # only probabilities
            p = vector_to_array(f"{column}_probability")
            scored = scored.withColumn(f"{column}_prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double"))
        if f"{column}_probability" in scored.columns:
            proba = vector_to_array(f"{column}_probability")
            score = F.get(proba, F.lit(1))
        else:
            proba = F.lit(None).cast("array<double>")
            score = F.get(vector_to_array(f"{column}_raw"), F.lit(1))
        part = scored.select(F.lit(name).alias("model"), "row_id", F.get(names, F.col("label").cast("int")).alias("y_true"),
                             F.get(names, F.col(f"{column}_prediction").cast("int")).alias("y_pred"),
                             names.alias("classes"), proba.alias("proba"), score.alias("score"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def evaluate(models: dict[str, PipelineModel], data: Prepared, stacked=()) -> Report:
    """All evaluation tables. With two classes the second one counts as positive. `stacked` names
    the learners inside the ensemble."""
    rows = data.test.count()
    latency = {n: ev.latency_ms_per_1000(m.transform(data.test), rows) for n, m in models.items()}
    scored = cut_lineage(predictions(models, data), "scored")
    two = data.k == 2
    metrics = ev.metrics(scored, "binary" if two else "macro", str(data.classes[-1]))
    if two:
        curve_rows = scored.select("model", (F.col("y_true") == str(data.classes[1])).cast("int").alias("y"), "score")
        roc, auc = ev.roc_curve(curve_rows), ev.roc_auc(curve_rows)
    elif scored.where("proba is not null").isEmpty():
        roc = auc = None
    else:
        roc = cut_lineage(ev.roc_macro(scored), "roc")
        auc = ev.curve_area(roc)
    weights = None
    if "linearsvc" in models:
        table = data.train.sparkSession.createDataFrame(
            learners.svm_coefficients(models["linearsvc"], data.names), "class int, feature string, coefficient double")
        weights = (ev.top_weights(table.drop("class")) if two
                   else ev.top_weights_by_class(table, list(range(data.k))))
    stacking = learners.stacking_weights(models["stacking"], list(stacked), data.k) if "stacking" in models and stacked else []
    return Report(metrics, ev.classification_report(scored), ev.confusion_matrix(scored), roc, auc,
                  ev.comparison(metrics, list(models)), latency, weights, stacking)


def diagnose_tree(data: Prepared, k_best: int = 60, cv_folds: int = 5, curves: bool = True,
                  depths=(2, 4, 6, 8, 10, 12, 15, 18, 22), settings: learners.Settings = learners.Settings()) -> dict:
    """Does the decision tree overfit? Gap between train and test, complexity, fold scores, report
    and, if wanted, the validation and learning curves; on the k best features by F value."""
    train, test = data.train, data.test
    if 0 < k_best < len(data.names):
        selector = prep.fit_selector(train, k_best, "label")
        narrow = lambda df: selector.transform(df).drop("features").withColumnRenamed("selected", "features")
        train, test = cut_lineage(narrow(train), "selected"), narrow(test)
    tree = learners.fit_learner("dt", train, data.k, settings)

    def scored(df):
        return tree.transform(df).select(F.lit("dt").alias("model"), F.col("label").cast("int").alias("y_true"),
                                         F.col("dt_prediction").cast("int").alias("y_pred"))
    average = "binary" if data.k == 2 else "macro"
    scores = learners.cv_scores(train, data.k, cv_folds, settings)
    out = {
        "gap": ev.overfit_gap(ev.metrics(scored(train), average), ev.metrics(scored(test), average)),
        "complexity": learners.tree_complexity(tree),
        "folds": scores,
        "fold_summary": ev.fold_summary(train.sparkSession.createDataFrame(
            [("dt", f, s) for f, s in scores], "model string, fold int, score double")),
        "report": ev.classification_report(scored(test)),
    }
    if curves:
        out["validation_curve"] = learners.validation_curve(train, data.k, depths, settings=settings)
        out["learning_curve"] = learners.learning_curve(train, data.k, settings=settings)
    return out
