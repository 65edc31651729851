"""Fitting and applying feature preprocessing.

What is learned (medians, quartiles, means, deviations, categories) comes from aggregates over the
training rows; what is kept is an ordinary Spark ML PipelineModel, so it can be saved, loaded and
put in front of a classifier.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler,
                                VectorSlicer)
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from wirelark.operators.ordered import running_sums
from wirelark.sources.scratch import cut_lineage

SCALES = ("log_standard", "robust", "standard")
MISSING = "missing"


def _brackets(narrow: DataFrame, sizes: dict[int, int], ranks: list[tuple[int, int]], accuracy: int):
    """(column, rank, low, high, values below low) such that each wanted rank (from 0) lies in low..high."""
    names, slack = narrow.columns, 2.0 / accuracy
    wanted = {i: [r for j, r in ranks if j == i] for i in sizes}
    ends = {i: [min(max(r / max(sizes[i] - 1, 1) + side, 0.0), 1.0) for r in own for side in (-slack, slack)] for i, own in wanted.items() if own}
    row = narrow.agg(*[f(names[i]).alias(f"{n}{i}") for i in ends for n, f in (
        ("min", F.min), ("max", F.max), ("q", lambda c, e=ends[i]: F.percentile_approx(c, e, accuracy)))]).first()
    guesses = []
    for i in ends:
        for k, r in enumerate(wanted[i]):
            low = row[f"min{i}"] if ends[i][2 * k] <= 0 else row[f"q{i}"][2 * k]
            high = row[f"max{i}"] if ends[i][2 * k + 1] >= 1 else row[f"q{i}"][2 * k + 1]
            guesses.append((i, r, low, high))
    seen = narrow.agg(*[F.count_if(F.col(names[i]) < low).alias(f"b{g}") for g, (i, _, low, _) in enumerate(guesses)],
                      *[F.count_if(F.col(names[i]) <= high).alias(f"u{g}") for g, (i, _, _, high) in enumerate(guesses)]).first()
    return [(i, r, low, high, seen[f"b{g}"]) if seen[f"b{g}"] <= r < seen[f"u{g}"]
            else (i, r, row[f"min{i}"], row[f"max{i}"], 0)                 # the guess missed: take all values
            for g, (i, r, low, high) in enumerate(guesses)]


def order_statistics(df: DataFrame, columns, ranks_of, accuracy: int = 10_000) -> tuple[list[int], dict[tuple[int, int], float]]:
    """(values per column, {(column, rank): value}): the values at the ranks (from 0) that
    `ranks_of(values, nulls)` names for a column; null and NaN are no values.

    A sketch of all columns gives a narrow bracket around every wanted rank, and one more pass
    counts what lies below it. Only the values inside the brackets are then counted together,
    stored and ranked by a chunked running sum; no column is shuffled or sorted as a whole."""
    columns = list(columns)
    value = lambda c: F.col(f"`{c}`").cast("double")
    narrow = df.select(*[F.when(~F.isnan(value(c)), value(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    row = narrow.agg(F.count("*").alias("rows"), *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    counts = [row[f"n{i}"] for i in range(len(columns))]
    sizes = {i: n for i, n in enumerate(counts) if n}
    ranks = [(i, r) for i, n in sizes.items() for r in sorted(set(ranks_of(n, row["rows"] - n)))]
    if not ranks:
        return counts, {}
    brackets = _brackets(narrow, sizes, ranks, accuracy)
    inside = F.array(*[
        F.when(F.col(f"v{i}").between(low, high), F.struct(F.lit(b).alias("name"), F.col(f"v{i}").alias("value")))
        for b, (i, _, low, high, _) in enumerate(brackets)])
    long = narrow.select(F.explode(F.array_compact(inside)).alias("p")).select("p.name", "p.value")
    stored = cut_lineage(long.groupBy("name", "value").agg(F.count("*").alias("n")), "values")
    upto = running_sums(stored, ["name"], ["value"], {"upto": F.col("n")})
    wanted = df.sparkSession.createDataFrame([(b, r - below) for b, (_, r, _, _, below) in enumerate(brackets)], "name int, rank long")
    found = {r["name"]: r["value"] for r in upto.join(F.broadcast(wanted), "name").where(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).collect()}
    return counts, {(i, r): found[b] for b, (i, r, *_) in enumerate(brackets)}


def _between(at: float, low: float, high: float) -> float:
    return low + (high - low) * (at - math.floor(at))


def exact_quantiles(df: DataFrame, columns, probabilities, accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, ignoring nulls and NaN; None for columns without values."""
    columns, probabilities = list(columns), list(probabilities)
    if not columns:
        return {}
    counts, found = order_statistics(df, columns, lambda n, _: [
        f(p * (n - 1)) for p in probabilities for f in (math.floor, math.ceil)], accuracy)

    def quantile(i, n, p):
        at = p * (n - 1)
        return _between(at, found[i, math.floor(at)], found[i, math.ceil(at)])
    return {c: [quantile(i, n, p) if n else None for p in probabilities] for i, (c, n) in enumerate(zip(columns, counts))}


def filled_quartiles(df: DataFrame, columns) -> dict[str, tuple[float, float, float]]:
    """(lower, median, upper) of each column after its nulls were given its median, without filling it:
    the filled column is the old one and so many copies of the median, which stand in its middle."""
    columns = list(columns)
    if not columns:
        return {}

    def places(n, nulls):
        """Ranks in the old column for the median, then those for the two quartiles of the filled one."""
        last = n + nulls - 1
        middle, low, high = (n - 1) / 2, last * 0.25, last * 0.75
        return ([math.floor(middle), math.ceil(middle)], [min(f(low), n - 1) for f in (math.floor, math.ceil)],
                [max(f(high) - nulls, 0) for f in (math.floor, math.ceil)])
    rows = df.count()
    counts, found = order_statistics(df, columns, lambda n, nulls: [r for own in places(n, nulls) for r in own])
    out = {}
    for i, (c, n) in enumerate(zip(columns, counts)):
        if not n:
            continue
        middle, low, high = ([found[i, r] for r in own] for own in places(n, rows - n))
        median = _between((n - 1) / 2, *middle)
        lower = _between((rows - 1) * 0.25, *[min(x, median) for x in low])
        upper = _between((rows - 1) * 0.75, *[max(x, median) for x in high])
        out[c] = lower, median, upper
    return out


def varying_columns(df: DataFrame, columns) -> list[str]:
    """Columns with more than one value. Nulls and NaN are imputed later, so they are no values;
    empty columns do not vary."""
    if not columns:
        return []
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    ends = df.agg(*[F.min(value(c)).alias(f"a{i}") for i, c in enumerate(columns)],
                  *[F.max(value(c)).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if ends[f"a{i}"] is not None and ends[f"a{i}"] != ends[f"b{i}"]]


def log1p_clip(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def mean_and_deviation(df: DataFrame, expressions: dict[str, str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of SQL expressions, in one pass; a zero deviation reads 1."""
    names = list(expressions)
    row = df.agg(*[F.avg(F.expr(expressions[c])).alias(f"m{i}") for i, c in enumerate(names)],
                 *[F.stddev_pop(F.expr(expressions[c])).alias(f"s{i}") for i, c in enumerate(names)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(names)}


def _number(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def scaling_sql(train: DataFrame, numeric, scale: str) -> dict[str, str]:
    """Learns the numeric steps: name -> SQL expression of the scaled column."""
    if scale not in SCALES:
        scale = "standard"
    kept = varying_columns(train, numeric)
    if not kept:
        return {}
    if scale == "robust":
        quartiles = filled_quartiles(train, kept)
        median = {c: quartiles[c][1] for c in kept}
    else:
        median = {c: q[0] for c, q in exact_quantiles(train, kept, [0.5]).items()}
    filled = {c: f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), {_number(median[c])})" for c in kept}
    if scale == "robust":
        return {c: f"({filled[c]} - {_number(median[c])}) / {_number((quartiles[c][2] - quartiles[c][0]) or 1.0)}"
                for c in kept}
    if scale == "log_standard":
        filled = {c: f"log1p(greatest({e}, CAST(0 AS DOUBLE)))" for c, e in filled.items()}
    moments = mean_and_deviation(train, filled)
    return {c: f"({filled[c]} - {_number(moments[c][0])}) / {_number(moments[c][1])}" for c in kept}


def fit_preprocessor(train: DataFrame, numeric, categorical=(), scale: str = "log_standard",
                     out: str = "features") -> PipelineModel:
    """Imputes, drops constant columns, scales, one-hot encodes (a category not seen in training
    is all zeros) and assembles: first the numeric block, then the categorical one. The training
    rows are read a few times, so hand in a stored table."""
    scaled = scaling_sql(train, list(numeric), scale)
    categorical = list(categorical)
    columns = [f"{e} AS `num__{c}`" for c, e in scaled.items()]
    columns += [f"coalesce(`{c}`, '{MISSING}') AS `str__{c}`" for c in categorical]
    stages = [SQLTransformer(statement="SELECT " + ", ".join(["*", *columns]) + " FROM __THIS__")]
    if categorical:
        stages += [
            StringIndexer(inputCols=[f"str__{c}" for c in categorical],
                          outputCols=[f"idx__{c}" for c in categorical],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            # the place for unseen values is the last one, and the last one is dropped
            OneHotEncoder(inputCols=[f"idx__{c}" for c in categorical],
                          outputCols=[f"cat__{c}" for c in categorical], dropLast=True)]
    stages.append(VectorAssembler(inputCols=[f"num__{c}" for c in scaled]
                                  + [f"cat__{c}" for c in categorical], outputCol=out))
    return Pipeline(stages=stages).fit(train)


def transform(model: PipelineModel, df: DataFrame, out: str = "features") -> DataFrame:
    """The input columns plus the feature vector, without the columns in between."""
    return model.transform(df).select(*[F.col(f"`{c}`") for c in df.columns], out)


def feature_names(df: DataFrame, size: int | None = None, column: str = "features") -> list[str]:
    """Names of the vector's places from its metadata, without the block prefixes; feature_<i> when
    the metadata is missing or does not fit."""
    groups = (df.schema[column].metadata.get("ml_attr", {}) or {}).get("attrs", {})
    attrs = sorted((a for g in groups.values() for a in g), key=lambda a: a["idx"])
    names = [a.get("name", "").replace("num__", "").replace("cat__", "") for a in attrs]
    if names and all(names) and (size is None or len(names) == size):
        return names
    return [f"feature_{i}" for i in range(size if size is not None else len(names))]


def _f_statistics(groups) -> list[float]:
    """F per feature from [(rows, means, sums of squared distances from the mean)] per class."""
    k, n = len(groups), sum(g[0] for g in groups)
    out = []
    for j in range(len(groups[0][1]) if groups else 0):
        middle = sum(g[0] / n * g[1][j] for g in groups)
        between = sum(g[0] * (g[1][j] - middle) ** 2 for g in groups)
        within = sum(g[2][j] for g in groups)
        if k < 2 or n <= k or (within <= 0 and between <= 0):
            out.append(float("nan"))
        else:
            out.append(float("inf") if within <= 0 else (between / (k - 1)) / (within / (n - k)))
    return out


def anova_f(df: DataFrame, columns, label: str = "target") -> DataFrame:
    """F value per column. One aggregate per class over the wide table, of counts, means and variances, which
    are merged around their means, so large, nearly equal values keep their spread; only (classes x columns)
    of them go on from there."""
    columns = list(columns)
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    parts = df.groupBy(label).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("m"),
                                  F.array(*[F.var_pop(c) for c in x]).alias("v"))
    long = parts.select("n", F.posexplode(F.arrays_zip("m", "v")).alias("place", "p")).select("n", "place", "p.m", "p.v")
    middles = long.groupBy("place").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("middle"))
    away = F.col("m") - F.col("middle")
    per = long.join(middles, "place").groupBy("place").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * away * away).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    f = F.when(F.col("within") > 0, (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))))
    names = F.array(*map(F.lit, columns))
    return per.where(F.col("k") > 1).select("place", F.get(names, F.col("place")).alias("feature"),
                                            f.alias("f_value"))


def top_features(scores: DataFrame, k: int = 40) -> DataFrame:
    """The k largest F values (all when k <= 0); of equal values the later column wins."""
    ordered = scores.orderBy(F.desc_nulls_last("f_value"), F.desc("place"))
    return ordered.limit(k) if k > 0 else ordered


def vector_anova(df: DataFrame, label: str = "target", features: str = "features") -> list[float]:
    """F value per place of a feature vector."""
    stats = Summarizer.metrics("count", "mean", "variance")
    rows = df.groupBy(label).agg(stats.summary(F.col(features)).alias("s")).collect()
    return _f_statistics([(r["s"]["count"], r["s"]["mean"].toArray().tolist(),
                           (r["s"]["variance"].toArray() * max(0, r["s"]["count"] - 1)).tolist()) for r in rows])


def fit_selector(df: DataFrame, k: int = 40, label: str = "target", features: str = "features",
                 out: str = "selected") -> VectorSlicer:
    """A slicer that keeps the k places with the largest F value, in their old order."""
    scores = vector_anova(df, label, features)
    rank = sorted(range(len(scores)), key=lambda i: (scores[i] == scores[i], scores[i], i), reverse=True)
    places = sorted(rank[:k] if 0 < k < len(rank) else range(len(scores)))
    return VectorSlicer(inputCol=features, outputCol=out, indices=places)
