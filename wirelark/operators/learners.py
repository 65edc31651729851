"""Classifiers as Spark ML pipelines, calibration, and stacking.

A fitted learner is an ordinary PipelineModel that adds `<name>_prediction` and, where the learner
has probabilities, `<name>_probability`; so a stacked ensemble is again a PipelineModel that can be
saved, loaded and put behind a fitted preprocessor. `fits` does the fitting: linear SVM with squared
hinge, forests, extra trees with drawn thresholds, a tree with weakest-link pruning, boosting on
second-order gradients with one softmax over all classes, a ReLU perceptron with early stopping.

Input rows carry `features`, a numeric `label` 0..k-1 and, for folds, a unique `row_id`.

`Settings.fit_rows` bounds the labelled rows of one fit: a larger table is thinned by
`sampling.bounded_sample`, which keeps rare classes. Scoring always covers all rows.
"""

from __future__ import annotations

import base64
import io
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelark.operators import evaluate as ev, fits, solvers
from wirelark.operators.sampling import bounded_sample, growing_subsets, stratified_folds
from wirelark.sources.scratch import cut_lineage

# Hyper-parameters of the learners.
DEFAULTS = {
    "linearsvc": dict(c=1.0, tol=1e-3, max_iter=5000),
    "rf": dict(trees=100, depth=15, leaf=2, split=4),
    "et": dict(trees=100, depth=15, leaf=2, split=4),
    "dt": dict(depth=12, leaf=8, split=20, alpha=0.00015),
    "mlp": dict(hidden=(64, 32), block=128, max_iter=200, rate=0.001, l2=0.0001, patience=10, held=0.1, rows=100_000),
    "hgb": dict(rounds=100, depth=12, leaf=20, rate=0.1, leaves=31),
    "linearsvcCalibrated": dict(c=1.0, tol=1e-3, max_iter=5000, folds=3, method="sigmoid"),
    "meta": dict(c=1.0, max_iter=2000),
}
LEARNERS = ["linearsvc", "rf", "et", "dt", "mlp", "hgb", "linearsvcCalibrated"]

# Which learners a stacking profile combines.
PROFILES = {
    "edge": ["linearsvcCalibrated", "hgb", "rf"],
    "balanced": ["linearsvcCalibrated", "rf", "et", "hgb"],
    "performance": ["linearsvcCalibrated", "rf", "et", "hgb", "mlp"],
    "legacy": ["linearsvcCalibrated", "rf", "et", "dt"],
    "padrao": ["linearsvcCalibrated", "dt"],
}


@dataclass(frozen=True)
class Settings:
    """Seed, changes to DEFAULTS, e.g. Settings(changes={"rf": {"trees": 20}}), and the most labelled
    rows that one fit reads (None: all)."""
    seed: int = 42
    changes: dict = field(default_factory=dict)
    fit_rows: int | None = None
    local_rows: int = fits.LOCAL_ROWS            # rows that go to every task in a broadcast; more stay in their table

    def of(self, name: str) -> dict:
        return DEFAULTS[name] | self.changes.get(name, {})

    def but(self, name: str, **values) -> "Settings":
        return replace(self, changes=self.changes | {name: self.changes.get(name, {}) | values})


def class_rows(train: DataFrame) -> dict[int, int]:
    return {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}


def weighted(train: DataFrame, counts: dict[int, int] | None = None) -> DataFrame:
    """Adds `weight`, balanced over the classes that are there."""
    counts = counts or class_rows(train)
    n, k = sum(counts.values()), len(counts)
    weight = F.lit(1.0)
    for label, rows in counts.items():
        weight = F.when(F.col("label") == label, F.lit(n / (k * rows))).otherwise(weight)
    return train.withColumn("weight", weight)


class LargestPlace(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The place of the largest value of a vector, the first one on a tie, as a prediction."""

    @keyword_only
    def __init__(self, inputCols=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        values = vector_to_array(self.getInputCols()[0])
        place = F.array_position(values, F.array_max(values)) - 1
        return df.withColumn(self.getOutputCol(), place.cast("double"))


class ArrayModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted learner as arrays. Adds `<name>_probability` (the margins `<name>_raw` for a linear SVM) and
    `<name>_prediction`, the place of the largest value. Rows are scored in Arrow batches."""

    learner = Param(Params._dummy(), "learner", "what the arrays are a model of", TypeConverters.toString)
    arrays = Param(Params._dummy(), "arrays", "the model, as the text of a compressed archive of arrays", TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels that a tree was allowed", TypeConverters.toInt)
    fitRows = Param(Params._dummy(), "fitRows", "rows that the fit read", TypeConverters.toInt)

    @classmethod
    def of(cls, learner: str, model: dict, depth: int = 0, rows: int = 0) -> "ArrayModel":
        out, room = cls(), io.BytesIO()
        np.savez_compressed(room, **model)
        out._set(learner=learner, arrays=base64.b64encode(room.getvalue()).decode(), maxDepth=depth, fitRows=rows)
        return out

    def model(self) -> dict:
        with np.load(io.BytesIO(base64.b64decode(self.getOrDefault(self.arrays)))) as held:
            return {k: held[k] for k in held.files}

    @property
    def numNodes(self) -> int:
        return len(self.model()["feature"])

    @property
    def depth(self) -> int:
        """Levels below the root of the first tree."""
        m, level = self.model(), 0
        at = [0]
        while at := [int(c) for n in at if m["feature"][n] >= 0 for c in (m["left"][n], m["right"][n])]:
            level += 1
        return level

    @property
    def coefficients(self) -> np.ndarray:
        """Binary problems x features of a linear SVM."""
        return self.model()["w"][:, :-1]

    def _transform(self, df):
        name = self.getOrDefault(self.learner)
        shared = df.sparkSession.sparkContext.broadcast(self.model())

        def score(features: pa.Array) -> pa.Array:
            n = len(features)
            x = features.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
            out = score_rows(name, shared.value, x) if n else np.zeros((0, 1))
            offsets = np.arange(n + 1, dtype=np.int32) * out.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel(), pa.float64()))
        column = f"{name}_raw" if name == "linearsvc" else f"{name}_probability"
        values = F.arrow_udf(score, "array<double>")(vector_to_array("features"))
        scored = df.withColumn(column, array_to_vector(values))
        return LargestPlace(inputCols=[column], outputCol=f"{name}_prediction").transform(scored)


def score_rows(name: str, model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of the rows, or margins of a linear SVM."""
    if name == "linearsvc":
        m = fits.margins(model["w"], x)
        return np.hstack([-m, m]) if m.shape[1] == 1 else m
    if name == "linearsvcCalibrated":
        return fits.calibrated_chances(model, x)
    if name == "mlp":
        return solvers.forward([(model[f"w{i}"], model[f"b{i}"]) for i in range(int(model["layers"]))], x)[1]
    if name == "hgb":
        raw = np.zeros((len(x), int(model["columns"])))
        for t, value in enumerate(fits.leaf_values(model, x)):
            raw[:, t % raw.shape[1]] += value
        return fits.chances(raw)
    return sum(fits.leaf_values(model, x)) / (len(model["begin"]) - 1)


def fit_learners(train: DataFrame, wanted, classes: int, settings: Settings, n_jobs: int | None = None) -> list[PipelineModel]:
    """Fits all `wanted` (name, parameters, fold to leave out) on one stored sample, together."""
    if settings.fit_rows:
        train = bounded_sample(train, settings.fit_rows, "label", "row_id", settings.seed)
    rows = train.count()
    models = fits.fit_all(train, [fits.Fit(n, p, f) for n, p, f in wanted], classes, settings.seed,
                          lambda df: cut_lineage(df, "fit"), settings.local_rows, jobs_setting(n_jobs))
    out = []
    for (name, p, _), model in zip(wanted, models):
        if name == "hgb":
            model = model | {"columns": np.array(1 if classes == 2 else classes)}
        out.append(PipelineModel([ArrayModel.of(name, model, p.get("depth", 0), rows)]))
    return out


def fit_learner(name: str, train: DataFrame, classes: int, settings: Settings = Settings()) -> PipelineModel:
    """Fits one of LEARNERS, on at most `settings.fit_rows` rows."""
    if name not in LEARNERS:
        raise ValueError(f"unknown learner: {name}")
    return fit_learners(train.drop("fold"), [(name, settings.of(name), None)], classes, settings)[0]


def profile_learners(profile: str = "edge", names=None) -> list[str]:
    """The learners of a profile, or the known ones among `names`."""
    if names is not None:
        return [n for n in names if n in LEARNERS]
    if profile not in PROFILES:
        raise ValueError(f"unknown stacking profile: {profile}; known are {', '.join(PROFILES)}")
    return list(PROFILES[profile])


def _meta_assembler(names, classes, passthrough):
    """Stages that gather the meta features: P(1) of each learner, or all of its probabilities."""
    slicers, columns = [], []
    for n in names:
        if classes == 2:
            slicers.append(VectorSlicer(inputCol=f"{n}_probability", outputCol=f"{n}_p1", indices=[1]))
            columns.append(f"{n}_p1")
        else:
            columns.append(f"{n}_probability")
    inputs = columns + (["features"] if passthrough else [])
    return [*slicers, VectorAssembler(inputCols=inputs, outputCol="meta_features")]


def jobs_setting(n_jobs: int | None = None) -> int:
    """How many fits run at a time: the argument, else STACKING_N_JOBS, else two."""
    return max(1, int(n_jobs or os.getenv("STACKING_N_JOBS", "").strip() or min(2, os.cpu_count() or 1)))


def _fold_models(folded: DataFrame, names, classes: int, folds: int, settings: Settings, whole: bool, n_jobs: int | None) -> dict:
    """(name, fold) -> the model that has not seen the fold; with `whole`, also (name, None)."""
    wanted = [(n, settings.of(n), f) for f in [*range(folds), *([None] if whole else [])] for n in names]
    return {(n, f): m for (n, _, f), m in zip(wanted, fit_learners(folded, wanted, classes, settings, n_jobs))}


def _score_folds(folded: DataFrame, fitted: dict, names, classes: int, folds: int, passthrough: bool) -> DataFrame:
    gather = _meta_assembler(names, classes, passthrough)
    parts = None
    for f in range(folds):
        scorer = PipelineModel([fitted[n, f] for n in names] + gather)
        part = scorer.transform(folded.where(F.col("fold") == f)).select("row_id", "label", "fold", "meta_features")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def out_of_fold(train: DataFrame, names, classes: int, folds: int = 5, settings: Settings = Settings(),
                passthrough: bool = False, n_jobs: int | None = None) -> DataFrame:
    """(row_id, label, fold, meta_features): every row scored by learners that have not seen it.
    The parts of the folds are put under one another, so nothing is joined."""
    folded = cut_lineage(stratified_folds(train, folds, "label", seed=settings.seed), "folds")
    return _score_folds(folded, _fold_models(folded, names, classes, folds, settings, False, n_jobs), names, classes, folds, passthrough)


def fit_stacking(train: DataFrame, classes: int, profile: str = "edge", names=None, cv_splits: int = 5,
                 passthrough: bool = False, n_jobs: int | None = None, settings: Settings = Settings()) -> PipelineModel:
    """Base learners on all rows, then a logistic regression on their probabilities that was fitted on
    out-of-fold ones. All folds' learners and those on all rows are fitted together, on one stored sample.
    Adds `stacking_probability` and `stacking_prediction`."""
    names = profile_learners(profile, names)
    folded = cut_lineage(stratified_folds(train.select("row_id", "label", "features"), cv_splits, "label", seed=settings.seed), "folds")
    fitted = _fold_models(folded, names, classes, cv_splits, settings, True, n_jobs)
    oof = cut_lineage(_score_folds(folded, fitted, names, classes, cv_splits, passthrough), "oof")
    p = settings.of("meta")
    counts = class_rows(oof)
    meta = LogisticRegression(
        featuresCol="meta_features", regParam=1.0 / (p["c"] * sum(counts.values())), standardization=False,
        maxIter=p["max_iter"], weightCol="weight", probabilityCol="stacking_probability",
        predictionCol="stacking_prediction", rawPredictionCol="stacking_raw").fit(weighted(oof, counts))
    return PipelineModel([*[fitted[n, None] for n in names], *_meta_assembler(names, classes, passthrough), meta])


def stacking_weights(model: PipelineModel, names, classes: int) -> list[tuple]:
    """(class, estimator, coefficient, intercept) of the meta learner; empty if there is none."""
    meta = model.stages[-1]
    if not hasattr(meta, "coefficientMatrix"):
        return []
    width = 1 if classes == 2 else classes
    labels = [f"{n}[{c}]" if width > 1 else n for n in names for c in range(width)]
    matrix, intercepts = meta.coefficientMatrix.toArray(), meta.interceptVector.toArray()
    extra = [f"feature_{i}" for i in range(matrix.shape[1] - len(labels))]
    return [(row, label, float(matrix[row][j]), float(intercepts[row]))
            for row in range(matrix.shape[0]) for j, label in enumerate(labels + extra)]


def svm_coefficients(model: PipelineModel, names) -> list[tuple]:
    """(class, feature, coefficient) of a fitted linear SVM."""
    return [(c, feature, float(w)) for c, row in enumerate(model.stages[0].coefficients) for feature, w in zip(names, row)]


def save(model: PipelineModel, folder: str, name: str, mode: str) -> str:
    path = f"{folder}/{name}_{mode}"
    model.write().overwrite().save(path)
    return path


def is_saved(spark: SparkSession, folder: str, name: str, mode: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}_{mode}/metadata")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def load(folder: str, name: str, mode: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/{name}_{mode}")


def with_preprocessor(preprocessor: PipelineModel, classifier: PipelineModel) -> PipelineModel:
    """One model from raw columns to predictions; left alone if it has a preprocessor already."""
    head = classifier.stages[0] if classifier.stages else None
    if isinstance(head, PipelineModel) and head.stages and isinstance(head.stages[0], SQLTransformer):
        return classifier
    return PipelineModel([preprocessor, classifier])


def train_models(train: DataFrame, classes: int, wanted, folder: str, mode: str, load_others: bool = True,
                 settings: Settings = Settings()) -> dict[str, PipelineModel]:
    """Fits and saves the wanted learners; the others are loaded if they were saved before."""
    models = {}
    for name in LEARNERS:
        if name in wanted:
            models[name] = fit_learner(name, train, classes, settings)
            save(models[name], folder, name, mode)
        elif load_others and is_saved(train.sparkSession, folder, name, mode):
            models[name] = load(folder, name, mode)
    return models


# Diagnostics ---------------------------------------------------------------------------------

def f1_of(scored: DataFrame, prediction: str, classes: int) -> float:
    """F1 of class 1, or the macro F1 when there are more than two classes."""
    rows = scored.select(F.lit("m").alias("model"), F.col("label").cast("int").alias("y_true"),
                         F.col(prediction).cast("int").alias("y_pred"))
    return ev.metrics(rows, "binary" if classes == 2 else "macro").first()["f1"]


def tree_complexity(model: PipelineModel, train_rows: int | None = None) -> dict:
    """Configured and real depth, leaves and training rows per leaf of a fitted tree; the rows are those
    that the fit read, unless given."""
    tree = model.stages[0]
    leaves = (tree.numNodes + 1) // 2
    per_leaf = (tree.getOrDefault("fitRows") if train_rows is None else train_rows) / max(1, leaves)
    return {"max_depth": tree.getOrDefault("maxDepth"), "depth": tree.depth, "leaves": leaves,
            "rows_per_leaf": per_leaf, "few_rows": per_leaf < ev.FEW_ROWS_PER_LEAF}


def _scores(train: DataFrame, held: DataFrame, classes: int, name: str, settings: Settings) -> list[float]:
    model = fit_learner(name, train, classes, settings)
    return [f1_of(model.transform(part), f"{name}_prediction", classes) for part in (train, held)]


def _together(work, tasks) -> list:
    """Runs fits that do not depend on each other, a few at a time."""
    with ThreadPoolExecutor(jobs_setting()) as pool:
        return list(pool.map(work, tasks))


def _fold_scores(folded: DataFrame, wanted, classes: int, settings: Settings) -> list[tuple[float, float]]:
    """(train, validation) score of each (parameters, fold) of the tree: all fits together on one sample, then
    all scores in one pass."""
    models = fit_learners(folded, [("dt", p, f) for p, f in wanted], classes, settings)
    parts = None
    for i, ((_, f), model) in enumerate(zip(wanted, models)):
        side = F.when(F.col("fold") == f, F.lit("held")).otherwise(F.lit("train"))
        part = model.transform(folded).select(F.concat(F.lit(f"{i} "), side).alias("model"), F.col("label").cast("int").alias("y_true"),
                                              F.col("dt_prediction").cast("int").alias("y_pred"))
        parts = part if parts is None else parts.unionByName(part)
    counted = {r.model: r.f1 for r in ev.metrics(parts, "binary" if classes == 2 else "macro").collect()}
    return [(counted.get(f"{i} train", 0.0), counted.get(f"{i} held", 0.0)) for i in range(len(wanted))]


def cv_scores(train: DataFrame, classes: int, folds: int = 5, settings: Settings = Settings()) -> list[tuple]:
    """(fold, score) over shuffled stratified folds."""
    folded = cut_lineage(stratified_folds(train, folds, "label", seed=settings.seed), "cv")
    return [(f, held) for f, (_, held) in enumerate(_fold_scores(folded, [(settings.of("dt"), f) for f in range(folds)], classes, settings))]


def validation_curve(train: DataFrame, classes: int, depths=(2, 4, 6, 8, 10, 12, 15, 18, 22), folds: int = 3,
                     settings: Settings = Settings()) -> list[tuple]:
    """(depth, fold, train score, validation score)."""
    folded = cut_lineage(stratified_folds(train, folds, "label", shuffled=False), "curve")
    points = [(d, f) for d in depths for f in range(folds)]
    scores = _fold_scores(folded, [(settings.but("dt", depth=d).of("dt"), f) for d, f in points], classes, settings)
    return [(*point, *score) for point, score in zip(points, scores)]


def learning_curve(train: DataFrame, classes: int, fractions=(0.2, 0.4, 0.6, 0.8, 1.0), folds: int = 3,
                   settings: Settings = Settings()) -> list[tuple]:
    """(fraction, fold, train score, validation score); each subset is a prefix by row id of the
    training part, with at least two classes in it for a fit to make sense."""
    folded = cut_lineage(stratified_folds(train, folds, "label", shuffled=False), "curve")

    def bounded(part):                                     # once, so that the fractions are of what a fit may read
        return bounded_sample(part, settings.fit_rows, "label", "row_id", settings.seed) if settings.fit_rows else part
    steps = [cut_lineage(growing_subsets(bounded(folded.where(F.col("fold") != f)), fractions), "subsets") for f in range(folds)]

    def score(task):
        f, i = task
        return (fractions[i], f, *_scores(steps[f].where(F.col("first_step") <= i), folded.where(F.col("fold") == f), classes, "dt", settings))
    return _together(score, [(f, i) for f in range(folds) for i in range(len(fractions))])
