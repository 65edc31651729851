"""The learners' own fits, against brute force, dense solutions and differences, and over a table that stays in place."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from wirelark.operators import fits, learners, solvers, trees
from wirelark.operators.learners import Settings, score_rows
from wirelark.sources.scratch import cut_lineage, shared_folder


def sample(n=300, classes=2, seed=0, width=4):
    draw = np.random.default_rng(seed)
    x = np.round(draw.standard_normal((n, width)), 1)
    y = ((x[:, 0] + x[:, 1] ** 2 > 0.7) | (draw.random(n) < 0.1)).astype(int)
    if classes == 3:
        y = np.where((y == 1) & (x[:, 2] > 0.3), 2, y)
    return {"x": x, "y": y, "fold": np.arange(n) % 3, "row_id": np.arange(n)}


def impurity(how, y, weights, classes):
    w = np.array([weights[c] * (y == c).sum() for c in range(classes)])
    share = w[w > 0] / w.sum()
    return w.sum() * ((1 - (share ** 2).sum()) if how == "gini" else -(share * np.log2(share)).sum())


def brute_tree(x, y, weights, classes, rule, how, depth=0):
    """Nested splits, by trying every threshold of every feature."""
    best = None
    if depth < rule.depth and len(y) >= max(rule.split, 2 * rule.leaf) and len(set(y)) > 1:
        whole = impurity(how, y, weights, classes)
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= t
                if min(left.sum(), (~left).sum()) < rule.leaf:
                    continue
                gain = whole - impurity(how, y[left], weights, classes) - impurity(how, y[~left], weights, classes)
                if gain > 1e-9 * whole and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, t)
    if best is None:
        return {"n": len(y)}
    _, f, t = best
    left = x[:, f] <= t
    return {"f": f, "l": brute_tree(x[left], y[left], weights, classes, rule, how, depth + 1), "r": brute_tree(x[~left], y[~left], weights, classes, rule, how, depth + 1)}


def shape(tree, node=0):
    if tree.feature[node] < 0:
        return {"n": int(round(tree.stats[node][0]))}
    return {"f": tree.feature[node], "l": shape(tree, tree.left[node]), "r": shape(tree, tree.right[node])}


def local_engine(data, classes, edges, drawn=None):
    weights = fits.balanced(np.bincount(data["y"], minlength=classes).astype(float))
    bins = None if edges is None else trees.binned(data["x"], edges)
    return trees.Local(trees.Block(data["x"], bins, lambda t: fits.class_stats(data, classes, None, weights, drawn))), weights


@pytest.mark.parametrize("how, classes", [("gini", 2), ("entropy", 3)])
def test_tree_is_that_of_all_splits_tried(how, classes):
    data = sample(classes=classes)
    edges = fits.edges_of(data["x"])
    rule = trees.Rule(how, leaf=4, split=20, depth=6)
    engine, weights = local_engine(data, classes, edges)
    grown = trees.grow(engine, 1, 4, rule, edges)[0]
    assert shape(grown) == brute_tree(data["x"], data["y"], weights, classes, rule, how)
    assert all(grown.stats[i][0] >= 4 for i in range(len(grown.feature))) and max(grown.depth) <= 6


def subtrees(tree, node=0):
    """All prunings below a node: (cost, leaves, inner nodes)."""
    total = tree.stats[0][1:].sum()
    out = [(float(trees.impurity("entropy", tree.stats[node])) / total, 1, frozenset())]
    if tree.feature[node] >= 0:
        for a in subtrees(tree, tree.left[node]):
            out += [(a[0] + b[0], a[1] + b[1], a[2] | b[2] | {node}) for b in subtrees(tree, tree.right[node])]
    return out


@pytest.mark.parametrize("alpha", [0.0, 0.002, 0.01, 0.03, 0.1, 1.0])
def test_pruning_is_the_best_of_all_subtrees(alpha):
    data = sample()
    edges = fits.edges_of(data["x"])
    engine, _ = local_engine(data, 2, edges)
    tree = trees.grow(engine, 1, 4, trees.Rule("entropy", leaf=5, depth=4), edges)[0]
    cost, leaves, _ = min(subtrees(tree), key=lambda s: (round(s[0] + alpha * s[1], 12), s[1]))
    pruned = trees.prune(tree, "entropy", alpha)
    n = sum(f < 0 for f in pruned.feature)
    got = sum(float(trees.impurity("entropy", s)) for s, f in zip(pruned.stats, pruned.feature) if f < 0) / tree.stats[0][1:].sum()
    assert got + alpha * n == pytest.approx(cost + alpha * leaves) and n == leaves


def test_extra_trees_draw_their_thresholds():
    """Thresholds differ by tree, lie inside the node's range, and the drawn splits are the best of those drawn."""
    data = sample()
    engine, weights = local_engine(data, 2, None)
    rule = trees.Rule("gini", leaf=2, split=4, depth=8)
    a, b = trees.grow(engine, 2, 4, rule, None, seeds=[(7, 0), (7, 1)], per_node=2, random_cuts=True)
    assert a.threshold[0] != b.threshold[0]
    for t, tree in enumerate((a, b)):
        node = trees.place(tree.arrays(), data["x"])
        assert {int(n): int((node == n).sum()) for n in set(node)} == {i: int(tree.stats[i][0]) for i, f in enumerate(tree.feature) if f < 0}
        order = trees._order_of(7, t, 0, 4)[:2]
        draws = np.random.default_rng([7, t, 0, 1]).random(2)
        gains = []
        for f, u in zip(order, draws):
            x = data["x"][:, f]
            left = x <= x.min() + u * (x.max() - x.min())
            y = data["y"]
            gains.append(impurity("gini", y, weights, 2) - impurity("gini", y[left], weights, 2) - impurity("gini", y[~left], weights, 2))
        assert tree.feature[0] == order[int(np.argmax(gains))]


def test_bags_are_poisson():
    times = fits.bag(np.arange(20_000), 42, 3)
    assert abs(times.mean() - 1) < 0.03 and abs((times == 0).mean() - np.exp(-1)) < 0.02
    assert (times != fits.bag(np.arange(20_000), 42, 4)).mean() > 0.3


def one_by_one(data, weight, p, edges, width, columns, column, raw):
    """The boosting tree that always splits the leaf with the largest gain, one pass for each."""
    stats = fits.boost_stats(raw, data["y"], weight, column)
    engine = trees.Local(trees.Block(data["x"], trees.binned(data["x"], edges), lambda t: stats))
    rule, tree, gains = fits._rule("hgb", p), trees.Tree(), {}

    def look(node):
        found = engine.best([trees.Open(0, node, np.arange(width))], {0: tree.arrays()}, rule)
        if found:
            _, slot, at, gain, left, own = found[0]
            tree.stats[node] = own
            if slot >= 0 and trees.may_split(tree, node, rule):
                gains[node] = (gain, slot, at, left)
    look(0)
    for _ in range(p["leaves"] - 1):
        if not gains:
            break
        node = max(gains, key=lambda n: (gains[n][0], -n))
        _, slot, at, left = gains.pop(node)
        for child in tree.split(node, slot, float(edges[slot][at]), left, tree.stats[node] - left):
            look(child)
    return tree


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting(classes):
    data = sample(600, classes)
    p = dict(rounds=25, depth=6, leaf=10, rate=0.1, leaves=8)
    edges = fits.edges_of(data["x"])
    weight = fits.balanced(np.bincount(data["y"], minlength=classes).astype(float))[data["y"]]
    log = []
    model = fits.boost_local(data, trees.binned(data["x"], edges), p, classes, 4, weight, edges, log)
    assert all(b < a for a, b in zip([np.log(classes), *log], log))               # log-loss falls in every round
    columns = 1 if classes == 2 else classes
    first = one_by_one(data, weight, p, edges, 4, columns, 0, np.zeros((600, columns)))
    assert sorted(first.threshold) == sorted(model["threshold"][:model["begin"][1]]) and len(first.feature) == model["begin"][1]
    out = score_rows("hgb", model | {"columns": np.array(columns)}, data["x"])
    assert out.shape == (600, classes) and np.allclose(out.sum(1), 1)


def dense_svm(x, sign, weight, c):
    """The same minimum by plain gradient descent with momentum."""
    a = np.column_stack([x, np.ones(len(x))])
    w, v = np.zeros(a.shape[1]), np.zeros(a.shape[1])
    rate = 1 / (1 + 2 * c * np.linalg.norm(a * np.sqrt(weight)[:, None], 2) ** 2)
    for k in range(20_000):
        at = w + k / (k + 3) * v
        gradient = at - 2 * c * a.T @ (weight * sign * np.maximum(0, 1 - sign * (a @ at)))
        v = at - rate * gradient - w
        w = w + v
    return w


def test_svm_is_the_dense_solution():
    data = sample(400)
    weights = fits.balanced(np.bincount(data["y"]).astype(float))
    got = fits._svm_local(data["x"], data["y"], 2, dict(c=1.0, tol=1e-3, max_iter=100))[0]
    want = dense_svm(data["x"], np.where(data["y"] == 1, 1.0, -1.0), weights[data["y"]], 1.0)
    assert np.abs(got - want).max() < 1e-3


@pytest.mark.parametrize("classes", [2, 3])
def test_perceptron_gradients(classes):
    draw = np.random.default_rng(0)
    x, y = draw.standard_normal((20, 3)), draw.integers(0, classes, 20)
    sizes = [3, 5, 4, 1 if classes == 2 else classes]
    layers = [(draw.standard_normal((a, b)), draw.standard_normal(b)) for a, b in zip(sizes[:-1], sizes[1:])]
    _, gradients = solvers.loss_and_gradients(layers, x, y, 0.3)
    for i, layer in enumerate(layers):
        for j, value in enumerate(layer):
            for at in list(np.ndindex(value.shape))[:7]:
                old, losses = value[at], []
                for step in (1e-6, -1e-6):
                    value[at] = old + step
                    losses.append(solvers.loss_and_gradients(layers, x, y, 0.3)[0])
                value[at] = old
                assert gradients[i][j][at] == pytest.approx((losses[0] - losses[1]) / 2e-6, abs=1e-6)


def test_perceptron_keeps_its_best_epoch():
    data = sample(400)
    layers, scores = solvers.fit_perceptron(data["x"], data["y"], 2, (8,), 32, 200, 0.01, 1e-4, 5, 0.2, 1)
    assert len(scores) < 200 and max(scores) > 0.8
    draw, test = np.random.default_rng(1), np.zeros(400, bool)
    for c in (0, 1):
        own = draw.permutation(np.flatnonzero(data["y"] == c))
        test[own[:int(round(0.2 * len(own)))]] = True
    assert (solvers.forward(layers, data["x"][test])[1].argmax(1) == data["y"][test]).mean() == pytest.approx(max(scores))


def test_isotonic_rises_and_is_the_mean_of_its_pools():
    at, chance = fits.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 1, 0]))
    assert list(at) == [1, 2, 3, 4, 5] and list(chance) == pytest.approx([0, 0.5, 0.5, 2 / 3, 2 / 3])


SMALL = {"rf": dict(trees=4, depth=5), "et": dict(trees=3, depth=4), "dt": dict(depth=5), "hgb": dict(rounds=12, depth=4, leaves=6),
         "linearsvcCalibrated": dict(folds=2), "mlp": dict(max_iter=5, rows=1000)}


@pytest.mark.parametrize("classes", [2, 3])
def test_a_table_in_place_gives_the_models_of_a_sample(spark, classes):
    """The same folds and learners through passes over the table and inside tasks."""
    data = sample(240, classes)
    rows = [(int(i), float(y), Vectors.dense(x), int(f)) for i, y, x, f in zip(data["row_id"], data["y"], data["x"], data["fold"])]
    df = spark.createDataFrame(rows, ["row_id", "label", "features", "fold"]).repartition(5)
    settings = Settings(changes=SMALL)
    wanted = [fits.Fit(n, settings.of(n), f) for n in ("rf", "et", "dt", "hgb", "linearsvc", "linearsvcCalibrated", "mlp") for f in (0, None)]
    store = lambda t: cut_lineage(t, "test")
    inside = fits.fit_all(df, wanted, classes, 42, store)
    spread = fits.fit_all(df, wanted, classes, 42, store, local_rows=0)
    for fit, a, b in zip(wanted, inside, spread):
        if fit.name == "hgb":
            a, b = (m | {"columns": np.array(1 if classes == 2 else classes)} for m in (a, b))
        p, q = score_rows(fit.name, a, data["x"]), score_rows(fit.name, b, data["x"])
        same = np.abs(p - q).max(1) < 1e-6
        assert same.mean() > (0.9 if fit.name in ("rf", "et", "dt", "hgb") else 0.999), (fit.name, fit.without, same.mean())


@pytest.mark.parametrize("name", learners.LEARNERS)
def test_models_are_saved_and_loaded(spark, name):
    data = sample(120)
    df = spark.createDataFrame([(int(i), float(y), Vectors.dense(x)) for i, y, x in zip(data["row_id"], data["y"], data["x"])], ["row_id", "label", "features"])
    model = learners.fit_learner(name, df, 2, Settings(changes=SMALL))
    folder = shared_folder(spark, "test")
    learners.save(model, folder, name, "x")
    column = f"{name}_raw" if name == "linearsvc" else f"{name}_probability"
    first, again = ([r[0] for r in m.transform(df).orderBy("row_id").select(column).collect()] for m in (model, learners.load(folder, name, "x")))
    assert first == again
