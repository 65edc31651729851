"""Evaluation tables: metrics, confusion, ROC and comparisons.

Everything starts from counts per (model, true, predicted) or per (model, score), so the scored
rows are reduced before they are shuffled. Curves are running sums cut into chunks.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from wirelark.operators.bounded import small_side
from wirelark.operators.ordered import neighbours, running_sums
from wirelark.sources.scratch import cut_lineage

METRICS = ["accuracy", "precision", "recall", "f1"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def pair_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model", "y_true", "y_pred").agg(F.count("*").alias("n"))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per model and class, over true and predicted classes."""
    hit = F.col("y_true") == F.col("y_pred")
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(hit, F.col("n")).otherwise(F.lit(0)).alias("hits")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("hits")))
    counts = (pairs.select("model", F.explode(sides).alias("s")).groupBy("model", F.col("s.label").alias("label"))
              .agg(F.sum("s.support").alias("support"), F.sum("s.called").alias("called"),
                   F.sum("s.hits").alias("hits")))
    return counts.select(
        "model", "label", _ratio(F.col("hits"), F.col("called")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("called") + F.col("support")).alias("f1"), "support")


def accuracy(pairs: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0)))
    return pairs.groupBy("model").agg((right / F.sum("n")).alias("accuracy"), F.sum("n").alias("rows"))


def metrics(predictions: DataFrame, average: str | None = None, positive=1) -> DataFrame:
    """(model, accuracy, precision, recall, f1). Without `average`: macro when there are more than
    two true classes, else the figures of the positive class."""
    pairs = pair_counts(predictions)
    if average is None:
        average = "macro" if pairs.select("y_true").distinct().limit(3).count() > 2 else "binary"
    per_class = class_metrics(pairs)
    if average == "macro":
        chosen = per_class.groupBy("model").agg(*[F.avg(m).alias(m) for m in METRICS[1:]])
    elif average == "binary":
        chosen = per_class.where(F.col("label") == F.lit(positive)).select("model", *METRICS[1:])
    else:
        raise ValueError("average must be 'binary' or 'macro'")
    return (accuracy(pairs).select("model", "accuracy").join(chosen, "model", "left")
            .na.fill(0.0, METRICS[1:]))


def classification_report(predictions: DataFrame) -> DataFrame:
    """(model, label, precision, recall, f1, support): the classes, then accuracy (as f1), macro
    and weighted averages."""
    pairs = pair_counts(predictions)
    classes = class_metrics(pairs).withColumn("label", F.col("label").cast("string"))
    means = classes.groupBy("model")
    macro = means.agg(*[F.avg(m).alias(m) for m in METRICS[1:]], F.sum("support").alias("support"))
    weighted = means.agg(*[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m)
                           for m in METRICS[1:]], F.sum("support").alias("support"))
    right = accuracy(pairs).select("model", F.lit("accuracy").alias("label"),
                                   F.lit(None).cast("double").alias("precision"),
                                   F.lit(None).cast("double").alias("recall"),
                                   F.col("accuracy").alias("f1"), F.col("rows").alias("support"))
    order = ["model", "label", *METRICS[1:], "support"]
    return (classes.select(*order).unionByName(right)
            .unionByName(macro.withColumn("label", F.lit("macro avg")).select(*order))
            .unionByName(weighted.withColumn("label", F.lit("weighted avg")).select(*order)))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """(model, y_true, y_pred, n, share): every cell, shares by true class. With the classes 0 and
    1 the display names are added."""
    pairs = pair_counts(predictions)
    classes = pairs.groupBy("model").agg(F.array_union(F.collect_set("y_true"), F.collect_set("y_pred")).alias("c"))
    cells = (classes.withColumn("y_true", F.explode("c")).withColumn("y_pred", F.explode("c")).drop("c"))
    filled = cells.join(pairs, ["model", "y_true", "y_pred"], "left").na.fill(0, ["n"])
    rows = pairs.groupBy("model", "y_true").agg(F.sum("n").alias("rows"))
    out = filled.join(rows, ["model", "y_true"], "left").select(
        "model", "y_true", "y_pred", "n", _ratio(F.col("n"), F.coalesce(F.col("rows"), F.lit(0))).alias("share"))
    shown = lambda c: (F.when(F.col(c).cast("string") == "0", F.lit("Benigno"))          # noqa: E731
                       .when(F.col(c).cast("string") == "1", F.lit("Maligno"))
                       .otherwise(F.col(c).cast("string")))
    return out.withColumn("true_name", shown("y_true")).withColumn("pred_name", shown("y_pred"))


def _score_counts(scored: DataFrame, keys) -> DataFrame:
    """Positives and negatives per distinct score (`y` is 0 or 1), stored: the scored rows are
    read once and all curves start from these counts."""
    return cut_lineage(scored.groupBy(*keys, "score").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "scores")


def _score_steps(counts: DataFrame, keys) -> DataFrame:
    """Positives and negatives at and above every distinct score."""
    return running_sums(counts.withColumn("_down", -F.col("score")), keys, ["_down"],
                        {"tp": F.col("pos"), "fp": F.col("neg")})


def roc_curve(scored: DataFrame, keys=("model",), drop_intermediate: bool = False) -> DataFrame:
    """(keys, threshold, fpr, tpr) at every distinct score, plus the point (0, 0). Expects `y` and
    `score`. Points on a straight line between their neighbours can be left out. Where all rows are
    of one side, the other side's rate is null."""
    keys = list(keys)
    counts = _score_counts(scored, keys)
    totals = small_side(counts.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")))
    points = _score_steps(counts, keys)
    if drop_intermediate:
        near = neighbours(points.withColumn("_step", F.struct("pos", "neg")), keys, ["_down"], "_step",
                          following="_next")
        straight = F.col("pos") * F.col("_next.neg") == F.col("neg") * F.col("_next.pos")
        points = near.where(F.col("_next").isNull() | ~straight)
    points = points.join(totals, keys).select(
        *keys, F.col("score").alias("threshold"), F.try_divide("fp", "_n").alias("fpr"), F.try_divide("tp", "_p").alias("tpr"))
    origin = totals.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                           F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def roc_auc(scored: DataFrame, keys=("model",)) -> DataFrame:
    """Trapezoid area: each score adds its negatives times the positives above it, ties half. Null
    where all rows are of one side."""
    keys = list(keys)
    twice = F.col("neg").cast("double") * (2 * F.col("tp") - F.col("pos"))
    area = _score_steps(_score_counts(scored, keys), keys).groupBy(*keys).agg(
        F.sum(twice).alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return area.select(*keys, F.try_divide(F.col("a"), F.lit(2.0) * F.col("p") * F.col("n")).alias("auc"))


def one_vs_rest(predictions: DataFrame) -> DataFrame:
    """(model, class, y, score) per row and class from `classes` and `proba`; rows of models that
    give no vector are skipped."""
    return (predictions.where(F.col("proba").isNotNull())
            .select("model", "y_true", F.explode(F.arrays_zip("classes", "proba")).alias("c"))
            .select("model", F.col("c.classes").alias("class"), F.col("c.proba").alias("score"),
                    (F.col("y_true") == F.col("c.classes")).cast("int").alias("y")))


def roc_macro(predictions: DataFrame) -> DataFrame:
    """(model, fpr, tpr): the mean of the class curves on the union of their false-positive rates.
    Classes without a row, or with all rows, have no curve and are left out.

    A class curve is a line between its knots, so all that a knot changes is the height, by its jump, and
    the slope. Both changes are summed over the classes of a rate; one running sum gives the slope of the
    summed curve behind each rate, and another its height. There is one row for each rate, whatever the
    number of classes."""
    ovr = one_vs_rest(predictions)
    curves = roc_curve(ovr, ["model", "class"])
    sided = curves.groupBy("model", "class").agg((F.count("fpr") > 1).alias("_f"), (F.count("tpr") > 1).alias("_t"))
    sided = small_side(sided.where("_f and _t").select("model", "class"))
    knots = cut_lineage(curves.join(sided, ["model", "class"], "left_semi").groupBy("model", "class", "fpr").agg(
        F.min("tpr").alias("low"), F.max("tpr").alias("high")), "knots")
    near = neighbours(knots.withColumn("_at", F.struct("fpr", "low", "high")), ["model", "class"], ["fpr"], "_at", previous="_was", following="_next")
    before = (F.col("low") - F.col("_was.high")) / (F.col("fpr") - F.col("_was.fpr"))
    after = (F.col("_next.low") - F.col("high")) / (F.col("_next.fpr") - F.col("fpr"))
    jump = F.col("high") - F.when(F.col("_was").isNull(), F.lit(0.0)).otherwise(F.col("low"))
    turns = cut_lineage(near.groupBy("model", "fpr").agg(
        F.sum(F.coalesce(after, F.lit(0.0)) - F.coalesce(before, F.lit(0.0))).alias("turn"), F.sum(jump).alias("jump")), "turns")
    sloped = running_sums(turns, ["model"], ["fpr"], {"slope": F.col("turn")}, probe=turns)
    steps = neighbours(sloped.withColumn("_at", F.struct("fpr", "slope")), ["model"], ["fpr"], "_at", previous="_was")
    risen = F.coalesce(F.col("_was.slope") * (F.col("fpr") - F.col("_was.fpr")), F.lit(0.0)) + F.col("jump")
    heights = running_sums(steps.withColumn("_step", risen), ["model"], ["fpr"], {"height": F.col("_step")}, probe=turns)
    classes = small_side(sided.groupBy("model").agg(F.count("*").alias("_classes")))
    return heights.join(classes, "model").select("model", "fpr", (F.col("height") / F.col("_classes")).alias("tpr"))


def curve_area(curve: DataFrame, keys=("model",)) -> DataFrame:
    """Trapezoid area of (fpr, tpr) points with one point per rate."""
    points = curve.withColumn("_at", F.struct("fpr", "tpr"))
    near = neighbours(points, list(keys), ["fpr"], "_at", previous="_was")
    area = (F.col("fpr") - F.col("_was.fpr")) * (F.col("tpr") + F.col("_was.tpr")) / 2
    return near.groupBy(*keys).agg(F.sum(area).alias("auc"))


def long_form(table: DataFrame, names=tuple(METRICS)) -> DataFrame:
    """(model, metric, value)."""
    return table.unpivot(["model"], list(names), "metric", "value")


def comparison(table: DataFrame, models) -> DataFrame:
    """One row per metric, one percent column per model."""
    return (long_form(table).groupBy("metric").pivot("model", list(models))
            .agg(F.first(F.col("value") * 100)))


# Limits of the F1 gap and of the deviation between folds.
SEVERE_GAP, MODERATE_GAP, UNSTABLE_STD, FEW_ROWS_PER_LEAF = 0.10, 0.05, 0.05, 5


def overfit_gap(train: DataFrame, test: DataFrame) -> DataFrame:
    """(model, metric, train, test, gap, verdict); the verdict goes by the F1 gap."""
    both = long_form(train).withColumnRenamed("value", "train").join(
        long_form(test).withColumnRenamed("value", "test"), ["model", "metric"])
    both = both.withColumn("gap", F.col("train") - F.col("test"))
    f1 = both.where("metric = 'f1'").select(
        "model", F.when(F.col("gap") > SEVERE_GAP, F.lit("severe"))
                  .when(F.col("gap") > MODERATE_GAP, F.lit("moderate"))
                  .otherwise(F.lit("good")).alias("verdict"))
    return both.join(f1, "model")


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of `score` per group of fold scores, with a stability note."""
    keys = [c for c in scores.columns if c not in ("fold", "score")]
    out = scores.groupBy(*keys).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return out.withColumn("unstable", F.col("std") > UNSTABLE_STD)


def latency_ms_per_1000(scored: DataFrame, rows: int) -> float:
    """Wall time to score the whole table, per 1000 rows."""
    began = time.perf_counter()
    scored.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) * 1000 / (rows / 1000.0)


def top_weights(weights: DataFrame, n: int = 25) -> DataFrame:
    """The n features with the largest absolute coefficient, ascending by coefficient."""
    return (weights.withColumn("tendency", F.when(F.col("coefficient") > 0, F.lit("Ataque"))
                               .otherwise(F.lit("Benigna")))
            .orderBy(F.desc(F.abs("coefficient")), "feature").limit(n).orderBy("coefficient", "feature"))


def top_weights_by_class(weights: DataFrame, classes, n: int = 25) -> DataFrame:
    """The n features with the largest absolute coefficient in any class, one column per class."""
    top = (weights.groupBy("feature").agg(F.max(F.abs("coefficient")).alias("peak"))
           .orderBy(F.desc("peak"), "feature").limit(n))
    return (weights.join(F.broadcast(top), "feature").groupBy("feature", "peak")
            .pivot("class", list(classes)).agg(F.first("coefficient")))
