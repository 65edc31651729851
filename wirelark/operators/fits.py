"""Fits of the learners: many at a time, over one stored table of training rows.

A fit is (learner, parameters, fold to leave out). Up to LOCAL_ROWS rows they are a bounded sample that goes to
every task in a broadcast, and each task makes some fits, or some trees of one: one job for all of them. Beyond
that the rows stay where they are. Trees of all fits then grow in common passes, linear models take Newton steps
on partial sums, and only the perceptron still wants a sample (`rows` in its parameters).

Rows have `features`, `label` (0..k-1), `fold` and `row_id`. Rows weigh as much as balances the classes of a fit.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from wirelark.operators import solvers, trees
from wirelark.operators.sampling import bounded_sample, stratified_folds
from wirelark.operators.trees import BINS, Block, Local, Rule, Spread

LOCAL_ROWS = 25_000
TREES_PER_TASK = 25
TREE_CELLS = 1 << 26               # rows times features and some, of a tree that one task grows
REFRESH = 10                       # rounds of boosting after which a stored table gets new scores


@dataclass(frozen=True)
class Fit:
    name: str
    p: dict = field(hash=False)
    without: int | None = None


# Rows as arrays ----------------------------------------------------------------------------------

def stored_columns(train: DataFrame) -> DataFrame:
    """(x, y, fold, row_id) of training rows; a table without ids takes them from its contents."""
    row_id = F.col("row_id").cast("long") if "row_id" in train.columns else F.xxhash64(vector_to_array("features"))
    fold = F.col("fold").cast("int") if "fold" in train.columns else F.lit(-1)
    return train.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), fold.alias("fold"), row_id.alias("row_id"))


def to_arrays(table) -> dict:
    n = table.num_rows
    column = table.column("x")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
    return {"x": np.ascontiguousarray(x), **{c: table.column(c).to_numpy() for c in ("y", "fold", "row_id")}}


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    """Borders of at most BINS bins for each feature, in the middle between values."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) >= BINS:
            at = np.quantile(column, np.arange(1, BINS) / BINS, method="lower")
            middle = np.unique(middle[np.minimum(np.searchsorted(values, at), len(middle) - 1)])
        out.append(middle)
    return out


def balanced(counts: np.ndarray) -> np.ndarray:
    """The weight of a row of each class; classes without rows have none."""
    there = counts > 0
    return np.where(there, counts.sum() / np.maximum(counts, 1) / max(1, there.sum()), 0.0)


def bag(row_id: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a row is drawn for a tree: Poisson with mean 1, by a hash of its id."""
    start = ((seed * 1_000_003 + tree * 7919 + 1) * 0xD1B54A32D192ED03) % 2 ** 64
    h = row_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    chances = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040]))
    return np.searchsorted(chances, (h >> np.uint64(11)).astype(float) / 2.0 ** 53)


def class_stats(data: dict, classes: int, without, weights: np.ndarray, drawn: tuple[int, int] | None) -> np.ndarray:
    """(1 if the row is in the fit, its weight at the place of its class)."""
    times = bag(data["row_id"], *drawn).astype(float) if drawn else np.ones(len(data["y"]))
    if without is not None:
        times = times * (data["fold"] != without)
    stats = np.zeros((len(times), classes + 1))
    stats[:, 0] = times > 0
    stats[np.arange(len(times)), data["y"] + 1] = times * weights[data["y"]]
    return stats


# Trees -------------------------------------------------------------------------------------------

def _rule(name: str, p: dict) -> Rule:
    how = {"dt": "entropy", "hgb": "newton"}.get(name, "gini")
    return Rule(how, leaf=p["leaf"], split=p.get("split", 2), depth=p["depth"])


def _forest(engine, fit: Fit, numbers, width: int, edges, seed: int):
    """Trees with these numbers of one forest, extra trees, or the one tree of 'dt'."""
    rule = _rule(fit.name, fit.p)
    per_node = None if fit.name == "dt" else max(1, int(np.sqrt(width)))
    grown = trees.grow(engine, len(numbers), width, rule, edges, seeds=[(seed, n) for n in numbers], per_node=per_node, random_cuts=fit.name == "et")
    return [trees.prune(t, rule.how, fit.p["alpha"]) for t in grown] if fit.p.get("alpha") else grown


def leaf_shares(tree, classes: int) -> np.ndarray:
    out = np.array([np.zeros(classes + 1) if s is None else s for s in tree.stats])[:, 1:]
    out = np.where(out > 1e-9 * out.sum(1, keepdims=True), out, 0.0)       # what differences of sums have left of nothing
    total = out.sum(1, keepdims=True)
    return np.where(total > 0, out / np.where(total > 0, total, 1), 1.0 / classes)


def packed(grown, values) -> dict:
    """Arrays of several trees, one after another; nodes keep their numbers within their tree."""
    parts = [t.arrays() for t in grown]
    return {"feature": np.concatenate([p[0] for p in parts]), "threshold": np.concatenate([p[1] for p in parts]),
            "left": np.concatenate([p[2] for p in parts]), "right": np.concatenate([p[3] for p in parts]),
            "value": np.concatenate(values), "begin": np.cumsum([0] + [len(p[0]) for p in parts])}


def joined(parts: list[dict]) -> dict:
    out = {k: np.concatenate([p[k] for p in parts]) for k in ("feature", "threshold", "left", "right", "value")}
    sizes = np.concatenate([np.diff(p["begin"]) for p in parts])
    return out | {"begin": np.concatenate([[0], np.cumsum(sizes)])}


_READY: dict[int, tuple] = {}      # of the models scored last


def _ensemble(model: dict) -> trees.Ensemble:
    key, found = id(model["feature"]), _READY.get(id(model["feature"]))
    if found is None or found[0] is not model["feature"]:
        if len(_READY) >= 8:
            _READY.pop(next(iter(_READY)))
        parts = zip(model["begin"][:-1], model["begin"][1:])
        found = _READY[key] = (model["feature"], trees.Ensemble([tuple(model[k][b:e] for k in ("feature", "threshold", "left", "right")) for b, e in parts]))
    return found[1]


def leaf_values(model: dict, x: np.ndarray):
    """For each tree the values of the rows' leaves."""
    for begin, leaves in zip(model["begin"], _ensemble(model).leaves(x)):
        yield model["value"].take(leaves + begin, axis=0)


def chances(raw: np.ndarray) -> np.ndarray:
    """Probabilities of boosted scores: logistic for one column, else softmax."""
    if raw.shape[1] == 1:
        one = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
        return np.hstack([1 - one, one])
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def boost_stats(raw: np.ndarray, y: np.ndarray, weight: np.ndarray, column: int) -> np.ndarray:
    """(1, gradient, hessian) of the weighted cross entropy for one column of scores."""
    p = chances(raw)
    p, hit = (p[:, 1], y == 1) if raw.shape[1] == 1 else (p[:, column], y == column)
    return np.column_stack([weight > 0, weight * (p - hit), weight * np.maximum(p * (1 - p), 1e-16)])


def leaf_steps(tree, rate: float) -> np.ndarray:
    stats = np.array([np.zeros(3) if s is None else s for s in tree.stats])
    return -rate * stats[:, 1] / np.maximum(stats[:, 2], 1e-12)


def boost_local(data: dict, bins, p: dict, classes: int, width: int, weight: np.ndarray, edges, log=None) -> dict:
    """Rounds of one tree for each column of scores, on the gradients of all columns."""
    columns = 1 if classes == 2 else classes
    raw, made = np.zeros((len(data["y"]), columns)), []
    for _ in range(p["rounds"]):
        stats = [boost_stats(raw, data["y"], weight, c) for c in range(columns)]
        grown = trees.grow_best_first(Local(Block(data["x"], bins, stats.__getitem__)), list(range(columns)), width, _rule("hgb", p), edges, p["leaves"])
        for c in range(columns):
            raw[:, c] += leaf_steps(grown[c], p["rate"])[trees.place(grown[c].arrays(), data["x"])]
        made += [grown[c] for c in range(columns)]
        if log is not None:
            log.append(float(-(weight * np.log(np.maximum(chances(raw)[np.arange(len(raw)), data["y"]], 1e-300))).sum() / weight.sum()))
    return packed(made, [leaf_steps(t, p["rate"]) for t in made])


# Linear models -----------------------------------------------------------------------------------

def svm_targets(y: np.ndarray, classes: int, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sign, weight) of the rows for each binary problem: one for two classes, else each class against
    the rest, whose rows then weigh 1."""
    if classes == 2:
        return [(np.where(y == 1, 1.0, -1.0), weights[y])]
    return [(np.where(y == c, 1.0, -1.0), np.where(y == c, weights[c], 1.0)) for c in range(classes)]


def _svm_local(x, y, classes, p) -> np.ndarray:
    weights = balanced(np.bincount(y, minlength=classes).astype(float))

    def solve(sign, weight):
        return solvers.newton(lambda w: solvers.with_penalty(solvers.squared_hinge(x, sign, weight, w), w, p["c"]),
                              x.shape[1] + 1, min(p["tol"], 1e-6), p["max_iter"])
    return np.stack([solve(*t) for t in svm_targets(y, classes, weights)])


def margins(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:, :-1].T + w[:, -1]


def isotonic(margin: np.ndarray, hit: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(margins, rising chances) by pooling neighbours that fall."""
    at, inverse = np.unique(margin, return_inverse=True)
    n = np.bincount(inverse, weights=weight).astype(float)
    total = np.bincount(inverse, weights=hit * (1.0 if weight is None else weight))
    pools: list[list] = []
    for i in range(len(at)):
        pools.append([total[i], n[i], i, i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    out = np.empty(len(at))
    for t, m, b, e in pools:
        out[b:e + 1] = t / m
    return at, out


def _calibrated_local(data: dict, classes: int, p: dict) -> dict:
    """Per inner fold a linear model on the others and a calibration of its margins on the fold itself."""
    x, y = data["x"], data["y"]
    place = np.empty(len(y), int)
    for c in np.unique(y):
        own = np.flatnonzero(y == c)
        place[own[np.argsort(data["row_id"][own], kind="stable")]] = np.arange(len(own))
    inner, out = place % p["folds"], {}
    for f in range(p["folds"]):
        w = _svm_local(x[inner != f], y[inner != f], classes, p)
        seen, labels = margins(w, x[inner == f]), y[inner == f]
        out[f"w{f}"] = w
        for j, c in enumerate([1] if classes == 2 else range(classes)):
            hit = labels == c
            if p["method"] == "isotonic":
                at, chance = isotonic(seen[:, j], hit) if len(hit) else (np.zeros(1), np.full(1, 0.5))
                out[f"at{f}_{j}"], out[f"chance{f}_{j}"] = at, chance
            else:
                target = solvers.platt_targets(hit, int(hit.sum()), int((~hit).sum()))
                out[f"platt{f}_{j}"] = solvers.newton(lambda v: solvers.logistic(seen[:, j], target, v), 2, 1e-9, 100)
    return out | {"folds": np.array(p["folds"]), "isotonic": np.array(p["method"] == "isotonic")}


def calibrated_chances(model: dict, x: np.ndarray) -> np.ndarray:
    total = 0.0
    for f in range(int(model["folds"])):
        seen, parts = margins(model[f"w{f}"], x), []
        for j in range(seen.shape[1]):
            if model["isotonic"]:
                parts.append(np.interp(seen[:, j], model[f"at{f}_{j}"], model[f"chance{f}_{j}"]))
            else:
                a, b = model[f"platt{f}_{j}"]
                parts.append(1 / (1 + np.exp(-np.clip(a * seen[:, j] + b, -500, 500))))
        p = np.column_stack(parts)
        if p.shape[1] == 1:
            p = np.hstack([1 - p, p])
        else:
            s = p.sum(1, keepdims=True)
            p = np.where(s > 0, p / np.where(s > 0, s, 1), 1.0 / p.shape[1])
        total = total + p
    return total / int(model["folds"])


# A sample in every task --------------------------------------------------------------------------

def _part(data: dict, without) -> dict:
    keep = slice(None) if without is None else data["fold"] != without
    return {k: v[keep] for k, v in data.items()}


def fit_local(data: dict, fit: Fit, numbers, classes: int, edges, seed: int) -> dict:
    """One fit, or the trees `numbers` of it, on rows in memory."""
    own, width = _part(data, fit.without), data["x"].shape[1]
    counts = np.bincount(own["y"], minlength=classes).astype(float)
    weights = balanced(counts)
    if fit.name in ("rf", "et", "dt"):
        bins = None if fit.name == "et" else trees.binned(own["x"], edges)
        stats = {i: class_stats(own, classes, None, weights, (seed, n) if fit.name == "rf" else None) for i, n in enumerate(numbers)}
        grown = _forest(Local(Block(own["x"], bins, stats.__getitem__)), fit, numbers, width, edges, seed)
        return packed(grown, [leaf_shares(t, classes) for t in grown])
    if fit.name == "hgb":
        return boost_local(own, trees.binned(own["x"], edges), fit.p, classes, width, weights[own["y"]], edges)
    if fit.name == "linearsvc":
        return {"w": _svm_local(own["x"], own["y"], classes, fit.p)}
    if fit.name == "linearsvcCalibrated":
        return _calibrated_local(own, classes, fit.p)
    if fit.name == "mlp":
        p = fit.p
        order = np.argsort(own["row_id"], kind="stable")     # the same whatever order the rows came in
        layers, _ = solvers.fit_perceptron(own["x"][order], own["y"][order].astype(int), classes, p["hidden"], p["block"], p["max_iter"], p["rate"],
                                           p["l2"], p["patience"], p["held"], seed)
        return {"layers": np.array(len(layers))} | {f"{k}{i}": v for i, layer in enumerate(layers) for k, v in zip("wb", layer)}
    raise ValueError(f"unknown learner: {fit.name}")


def _in_tasks(spark, data: dict, fits: list[Fit], classes: int, seed: int) -> list[dict]:
    tasks = []
    for i, fit in enumerate(fits):
        n = fit.p["trees"] if fit.name in ("rf", "et") else 1
        tasks += [(i, list(range(b, min(n, b + TREES_PER_TASK)))) for b in range(0, n, TREES_PER_TASK)]
    # the longest first
    tasks.sort(key=lambda t: fits[t[0]].name not in ("hgb", "mlp"))
    edges = edges_of(data["x"]) if any(f.name in ("rf", "dt", "hgb") for f in fits) else None
    shared = spark.sparkContext.broadcast((data, edges))

    def run(batches):
        import pickle
        for batch in batches:
            for t in batch.column("id").to_pylist():
                rows, borders = shared.value
                i, numbers = tasks[t]
                yield pa.RecordBatch.from_pydict({"id": [t], "model": [pickle.dumps(fit_local(rows, fits[i], numbers, classes, borders, seed))]})
    import pickle
    found = {r.id: pickle.loads(bytes(r.model)) for r in spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, "id long, model binary").collect()}
    shared.unpersist()
    parts: dict[int, list] = {}
    for t, (i, numbers) in sorted(enumerate(tasks), key=lambda e: (e[1][0], e[1][1])):
        parts.setdefault(i, []).append(found[t])
    return [joined(parts[i]) if len(parts[i]) > 1 else parts[i][0] for i in range(len(fits))]


# A table that stays where it is ------------------------------------------------------------------

def _blocks(edges, stats_of):
    """Batches of (x, y, fold, row_id) as Blocks; `stats_of(data)` gives the function of a tree's statistics."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                data = to_arrays(batch)
                yield Block(data["x"], None if edges is None else trees.binned(data["x"], edges), stats_of(data))
    return run


def table_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    places = [i / BINS for i in range(1, BINS)]
    wanted = [F.percentile_approx(F.get("x", F.lit(i)), places, 20_000).alias(f"f{i}") for i in range(width)]
    found = rows.agg(*wanted).first()
    return [np.unique(np.array(found[i], float)) for i in range(width)]


def _spread_forests(rows, fits: list[Fit], classes: int, width: int, edges, weights, seed: int) -> list[dict]:
    """All trees of the fits of one learner in common passes."""
    name, p = fits[0].name, fits[0].p
    n = 1 if name == "dt" else p["trees"]
    each = [(i, j) for i in range(len(fits)) for j in range(n)]
    left_out = [f.without for f in fits]

    def stats_of(data):
        def of(tree):
            i, j = each[tree]
            return class_stats(data, classes, left_out[i], weights[i], (seed, j) if name == "rf" else None)
        return of
    per_node = None if name == "dt" else max(1, int(np.sqrt(width)))
    engine = Spread(rows, _blocks(None if name == "et" else edges, stats_of))
    grown = trees.grow(engine, len(each), width, _rule(name, p), edges, seeds=[(seed, j) for _, j in each], per_node=per_node, random_cuts=name == "et")
    if p.get("alpha"):
        grown = [trees.prune(t, _rule(name, p).how, p["alpha"]) for t in grown]
    return [packed(grown[i * n:(i + 1) * n], [leaf_shares(t, classes) for t in grown[i * n:(i + 1) * n]]) for i in range(len(fits))]


def _whole_trees(rows, fits: list[Fit], classes: int, width: int, edges, weights, seed: int) -> list[dict]:
    """All trees of the fits of one learner, each grown by one task: a block of rows goes there as bins of a byte,
    classes, and how often each row is drawn."""
    name, p = fits[0].name, fits[0].p
    n = 1 if name == "dt" else p["trees"]
    each = [(i, j) for i in range(len(fits)) for j in range(n)]
    left_out = [f.without for f in fits]

    def send(batches):
        for batch in batches:
            if batch.num_rows:
                data = to_arrays(batch)
                held = trees.binned(data["x"], edges).astype(np.uint8)
                ids, packs = [], []
                for tree, (i, j) in enumerate(each):
                    times = bag(data["row_id"], seed, j) if name == "rf" else np.ones(len(data["y"]), int)
                    own = np.flatnonzero(times if left_out[i] is None else times * (data["fold"] != left_out[i]))
                    if len(own):
                        ids.append(tree)
                        packs.append(held[own].tobytes() + data["y"][own].astype(np.uint16).tobytes() + times[own].astype(np.uint8).tobytes())
                    if ids and (len(ids) == 100 or tree == len(each) - 1):
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packs, pa.binary())], ["tree", "rows"])
                        ids, packs = [], []

    def made(tree, packs):
        i, j = each[tree]
        x, y, times = [], [], []
        for pack in packs:
            m = len(pack) // (width + 3)
            x.append(np.frombuffer(pack, np.uint8, m * width).reshape(m, width))
            y.append(np.frombuffer(pack, np.uint16, m, m * width))
            times.append(np.frombuffer(pack, np.uint8, m, len(pack) - m))
        engine = trees.Counted(np.concatenate(x), np.concatenate(y).astype(np.int64), np.concatenate(times).astype(float), weights[i], edges)
        grown = _forest(engine, fits[i], [j], width, edges, seed)
        return packed(grown, [leaf_shares(grown[0], classes)])

    def grow(batches):
        import pickle
        now, packs = None, []
        for batch in trees._with_end(batches):
            pairs = [(None, None)] if batch is None else zip(batch.column("tree").to_pylist(), batch.column("rows").to_pylist())
            for tree, pack in pairs:
                if tree != now and packs:
                    yield pa.RecordBatch.from_pydict({"tree": [now], "model": [pickle.dumps(made(now, packs))]})
                    packs = []
                now = tree
                packs.append(pack)
    import pickle
    sent = rows.mapInArrow(send, "tree long, rows binary").repartition(min(len(each), 200), "tree").sortWithinPartitions("tree")
    found = {r.tree: pickle.loads(bytes(r.model)) for r in sent.mapInArrow(grow, "tree long, model binary").collect()}
    bare = packed([trees.Tree()], [np.full((1, classes), 1.0 / classes)])         # of a tree that drew no row
    return [joined([found.get(i * n + j, bare) for j in range(n)]) for i in range(len(fits))]


def _spread_boost(rows: DataFrame, fits: list[Fit], classes: int, width: int, edges, weights, store) -> list[dict]:
    """Boosting of all fits in common rounds. Scores are worked out from the rounds since they were last stored."""
    p, columns = fits[0].p, 1 if classes == 2 else classes
    made: list[list] = [[] for _ in fits]
    left_out, fresh = [f.without for f in fits], 0
    now = rows.withColumn("raw", F.array_repeat(F.lit(0.0), len(fits) * columns))

    def scores(batch, new):
        raw = batch.column("raw").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(fits), columns).copy()
        x = to_arrays(batch)["x"]
        for i, model in enumerate(new):
            for t, value in enumerate(leaf_values(model, x)) if model else ():
                raw[:, i, t % columns] += value
        return raw

    for done in range(p["rounds"]):
        new = [packed(m[fresh:], [leaf_steps(t, p["rate"]) for t in m[fresh:]]) if m[fresh:] else None for m in made]
        if done and done % REFRESH == 0:
            def refreshed(batches, new=new):
                for batch in batches:
                    if batch.num_rows:
                        raw = scores(batch, new)
                        yield batch.set_column(batch.schema.get_field_index("raw"), "raw", pa.array(list(raw.reshape(batch.num_rows, -1)), pa.list_(pa.float64())))
            now = store(now.mapInArrow(refreshed, now.schema))
            fresh, new = done * columns, [None] * len(fits)

        def blocks(batches, new=new):
            for batch in batches:
                if batch.num_rows:
                    data, raw = to_arrays(batch), scores(batch, new)

                    def of(tree, data=data, raw=raw):
                        i, c = divmod(tree, columns)
                        weight = weights[i][data["y"]] * (1.0 if left_out[i] is None else data["fold"] != left_out[i])
                        return boost_stats(raw[:, i], data["y"], weight, c)
                    yield Block(data["x"], trees.binned(data["x"], edges), of)
        grown = trees.grow_best_first(Spread(now, blocks), list(range(len(fits) * columns)), width, _rule("hgb", p), edges, p["leaves"])
        for i in range(len(fits)):
            made[i] += [grown[i * columns + c] for c in range(columns)]
    return [packed(m, [leaf_steps(t, p["rate"]) for t in m]) for m in made]


def _table_sums(rows: DataFrame, of) -> tuple[float, np.ndarray, np.ndarray]:
    """The sum over blocks of of(data) = (loss, gradient, Hessian): one partial sum for each task."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                loss, gradient, hessian = of(to_arrays(batch))
                part = np.concatenate([[loss], gradient, hessian.ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])
    found = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(found))
    for r in found:
        flat[r.i] = r.v
    n = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)         # 1 + n + n * n entries
    return float(flat[0]), flat[1:n + 1], flat[n + 1:].reshape(n, n)


def _table_counts(rows: DataFrame, classes: int) -> np.ndarray:
    out = np.zeros(classes)
    for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect():
        out[r.y] = r.n
    return out


def _spread_svm(rows: DataFrame, classes: int, width: int, p: dict) -> np.ndarray:
    weights = balanced(_table_counts(rows, classes))

    def solve(k):
        def sums(w):
            return solvers.with_penalty(_table_sums(rows, lambda d: solvers.squared_hinge(d["x"], *svm_targets(d["y"], classes, weights)[k], w)), w, p["c"])
        return solvers.newton(sums, width + 1, min(p["tol"], 1e-6), p["max_iter"])
    return np.stack([solve(k) for k in range(1 if classes == 2 else classes)])


def _spread_calibrated(rows: DataFrame, classes: int, width: int, p: dict) -> dict:
    folded = stratified_folds(rows, p["folds"], "y", shuffled=False, name="_cal")
    out = {"folds": np.array(p["folds"]), "isotonic": np.array(p["method"] == "isotonic")}
    for f in range(p["folds"]):
        w = out[f"w{f}"] = _spread_svm(folded.where(F.col("_cal") != f).drop("_cal"), classes, width, p)
        held = folded.where(F.col("_cal") == f).drop("_cal")
        counts = _table_counts(held, classes)
        for j, c in enumerate([1] if classes == 2 else range(classes)):
            if p["method"] == "isotonic":
                at, chance = _table_isotonic(held, w, j, c)
                out[f"at{f}_{j}"], out[f"chance{f}_{j}"] = at, chance
            else:
                def of(d, v):
                    hit = d["y"] == c
                    return solvers.logistic(margins(w, d["x"])[:, j], solvers.platt_targets(hit, int(counts[c]), int(counts.sum() - counts[c])), v)
                out[f"platt{f}_{j}"] = solvers.newton(lambda v: _table_sums(held, lambda d: of(d, v)), 2, 1e-9, 100)
    return out


def _table_isotonic(held: DataFrame, w: np.ndarray, j: int, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic chances over about a thousand points, each the rows between two quantiles of the margin."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = to_arrays(batch)
                yield pa.RecordBatch.from_arrays([pa.array(margins(w, d["x"])[:, j]), pa.array((d["y"] == c).astype(float))], ["m", "hit"])
    seen = held.mapInArrow(run, "m double, hit double")
    borders = F.array(*[F.lit(float(v)) for v in sorted(set(seen.agg(F.percentile_approx("m", [i / 1000 for i in range(1001)], 100_000)).first()[0]))])
    points = seen.groupBy(F.size(F.filter(borders, lambda b: b <= F.col("m"))).alias("p")).agg(
        F.avg("m").alias("m"), F.avg("hit").alias("hit"), F.count("*").alias("n")).orderBy("m").collect()
    return isotonic(np.array([r.m for r in points]), np.array([r.hit for r in points]), np.array([float(r.n) for r in points]))


def _over_table(rows: DataFrame, fits: list[Fit], classes: int, width: int, seed: int, store, jobs: int) -> list[dict]:
    def part(without):
        return rows if without is None else rows.where(F.col("fold") != without)
    edges = table_edges(rows, width) if any(f.name in ("rf", "dt", "hgb") for f in fits) else None
    counts = np.zeros((len(fits), classes))
    for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect():
        for i, f in enumerate(fits):
            counts[i, r.y] += r.n * (f.without is None or r.fold != f.without)
    weights, out = [balanced(c) for c in counts], {}
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(fits):
        groups.setdefault((f.name, str(f.p)), []).append(i)
    for (name, _), own in groups.items():
        some, w = [fits[i] for i in own], [weights[i] for i in own]
        if name in ("rf", "et", "dt"):
            whole = name != "et" and max(c.sum() for c in counts[own]) * (width + 16) <= TREE_CELLS
            models = (_whole_trees if whole else _spread_forests)(rows, some, classes, width, edges, w, seed)
        elif name == "hgb":
            models = _spread_boost(rows, some, classes, width, edges, w, store)
        elif name == "mlp":
            models = [_in_tasks(rows.sparkSession, to_arrays(bounded_sample(part(f.without), f.p["rows"], "y", "row_id", seed).toArrow()),
                                [Fit(name, f.p)], classes, seed)[0] for f in some]
        else:
            solve = (lambda f: {"w": _spread_svm(part(f.without), classes, width, f.p)}) if name == "linearsvc" else (
                lambda f: _spread_calibrated(part(f.without), classes, width, f.p))
            with ThreadPoolExecutor(jobs) as pool:
                models = list(pool.map(solve, some))
        out |= dict(zip(own, models))
    return [out[i] for i in range(len(fits))]


def fit_all(train: DataFrame, fits: list[Fit], classes: int, seed: int, store, local_rows: int = LOCAL_ROWS, jobs: int = 2) -> list[dict]:
    """The model of each fit, as arrays. `store(df)` writes a table and reads it back; `jobs` linear fits over a
    table run at a time."""
    rows = store(stored_columns(train))
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    if not found.n:
        raise ValueError("there are no rows to learn from")
    if found.n <= local_rows:
        return _in_tasks(train.sparkSession, to_arrays(rows.toArrow()), fits, classes, seed)
    return _over_table(rows, fits, classes, found.width, seed, store, jobs)
