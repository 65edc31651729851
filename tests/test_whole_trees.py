"""Trees that tasks grow whole, and rows scored by bits: as the passes over a table and plain walks give them."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from test_fits import SMALL, sample
from wirelark.operators import fits, trees
from wirelark.operators.learners import Settings, score_rows
from wirelark.sources.scratch import cut_lineage


def table(spark, data):
    rows = [(int(i), float(y), Vectors.dense(x), int(f)) for i, y, x, f in zip(data["row_id"], data["y"], data["x"], data["fold"])]
    return spark.createDataFrame(rows, ["row_id", "label", "features", "fold"]).repartition(3)


def fitted(spark, data, wanted, local_rows=0):
    return fits.fit_all(table(spark, data), wanted, 3, 42, lambda t: cut_lineage(t, "test"), local_rows=local_rows)


def test_whole_trees_are_those_of_a_sample_and_of_passes(spark, monkeypatch):
    data, settings = sample(240, 3), Settings(changes=SMALL)
    wanted = [fits.Fit(n, settings.of(n), f) for n in ("rf", "dt") for f in (1, None)]
    inside, whole = fitted(spark, data, wanted, 10**6), fitted(spark, data, wanted)
    monkeypatch.setattr(fits, "TREE_CELLS", 0)
    passes = fitted(spark, data, wanted)
    for fit, a, b, c in zip(wanted, inside, whole, passes):
        p, q, r = (score_rows(fit.name, m, data["x"]) for m in (a, b, c))
        assert (np.abs(p - q).max(1) < 1e-6).mean() > 0.9 and (np.abs(q - r).max(1) < 1e-6).mean() > 0.9, fit


def test_a_forest_takes_as_many_jobs_for_deep_trees_as_for_shallow_ones(spark):
    """One shuffle of rows; a pass for each level read all rows again, down all trees from their roots."""
    data, tracker, jobs = sample(600, 3), spark.sparkContext.statusTracker(), []
    for depth in (2, 12):
        spark.sparkContext.setJobGroup(f"depth {depth}", "")
        fitted(spark, data, [fits.Fit("rf", dict(trees=3, depth=depth, leaf=2, split=4), None)])
        jobs.append(len(tracker.getJobIdsForGroup(f"depth {depth}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_a_tree_that_draws_no_row_tells_nothing(spark, monkeypatch):
    data = sample(40, 3)
    monkeypatch.setattr(fits, "bag", lambda ids, seed, tree: np.full(len(ids), tree, int))
    model = fitted(spark, data, [fits.Fit("rf", dict(trees=2, depth=3, leaf=2, split=4), None)])[0]
    first, second = fits.leaf_values(model, data["x"])
    assert np.allclose(first, 1 / 3) and not np.allclose(second, 1 / 3)


def plain(arrays, row):
    feature, threshold, left, right = arrays
    node = 0
    while feature[node] >= 0:
        node = left[node] if row[feature[node]] <= threshold[node] else right[node]
    return node


@pytest.mark.parametrize("words", [trees.WORDS, 0])
def test_scoring_by_bits_and_by_walks_finds_the_leaf_of_each_row(monkeypatch, words):
    monkeypatch.setattr(trees, "WORDS", words)
    data = sample(900, 3)
    data["y"] = np.random.default_rng(1).integers(0, 3, 900)                    # noise, for trees of several words of leaves
    model = fits.fit_local(data, fits.Fit("et", dict(trees=4, depth=15, leaf=1, split=2)), [0, 1, 2, 3], 3, None, 1)
    grown = [tuple(model[k][b:e] for k in ("feature", "threshold", "left", "right")) for b, e in zip(model["begin"][:-1], model["begin"][1:])]
    x = np.vstack([data["x"], [[np.nan, 0, 1, 2], [0, np.nan, np.inf, -np.inf]], [t[1][:1].repeat(4) for t in grown]])
    bare = trees.Tree().arrays()
    ready = trees.Ensemble([*grown, bare])
    assert max((t[0] < 0).sum() for t in grown) > 128 and isinstance(ready.ready[0], trees.Walk) == (words == 0)
    for arrays, leaves in zip([*grown, bare], ready.leaves(x)):
        assert list(leaves) == [plain(arrays, r) for r in x] == list(trees.place(arrays, x))
