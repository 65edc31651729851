"""Decision trees, forests and boosted trees from sums of statistics over blocks of rows.

A pass takes all open nodes of all trees, whatever fold or class they belong to: every task adds up, for each
(node, feature, bin), the statistics of its rows; the sums meet in one shuffle and the best split of each node
comes back. So a pass costs one job for all trees together, and no task sees more than its own rows.

The same passes run inside one task when the rows are a bounded sample (`Local`), and over a stored table of
any size (`Spread`). Both give the same trees, up to the order of floating-point sums.

Statistics are (rows, weight of each class) for classification and (rows, gradient, hessian) for boosting. Splits
are `x <= threshold`; thresholds are the borders of bins of about equal rows, or drawn for each node and feature.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

BINS = 255
_TINY = 1e-12


@dataclass
class Tree:
    """Nodes by number; node 0 is the root and `feature` is -1 in leaves."""
    feature: list = field(default_factory=lambda: [-1])
    threshold: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    depth: list = field(default_factory=lambda: [0])
    stats: list = field(default_factory=lambda: [None])

    def split(self, node: int, feature: int, threshold: float, left, right) -> tuple[int, int]:
        first = len(self.feature)
        for stats in (left, right):
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.depth.append(self.depth[node] + 1)
            self.stats.append(stats)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, first, first + 1
        return first, first + 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int32), np.array(self.threshold, float), np.array(self.left, np.int32), np.array(self.right, np.int32))


class Walk:
    """A tree made ready to be walked by many rows at once: leaves lead to themselves."""

    def __init__(self, arrays):
        feature, threshold, left, right = arrays
        inner, own = feature >= 0, np.arange(len(feature))
        self.feature = np.where(inner, feature, 0).astype(np.intp)
        self.threshold = np.where(inner, threshold, np.inf)
        self.next = np.column_stack([np.where(inner, right, own), np.where(inner, left, own)]).astype(np.intp).ravel()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        flat, begin, node = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.intp)
        while len(self.feature) > 1:
            below = self.next.take(2 * node + (flat.take(begin + self.feature.take(node)) <= self.threshold.take(node)))
            if np.array_equal(below, node):
                break
            node = below
        return node


def place(arrays, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    return Walk(arrays)(x)


WORDS = 8                          # of 64 leaves, for trees that are scored by bits
TABLE_BYTES = 1 << 26


class Ensemble:
    """Many trees made ready to score rows.

    The thresholds of all trees cut each feature into intervals, which are looked up once for a row. A tree of
    some hundred leaves then has, for each feature and interval, the leaves that the tree's nodes on that feature
    leave possible, as bits; of those that all features leave possible the first is the row's leaf. So a tree
    costs one lookup for each feature instead of some for each level. Larger trees are walked."""

    def __init__(self, trees: list[tuple]):
        width = max([0, *(int(t[0].max()) + 1 for t in trees)])
        self.cuts = [np.unique(np.concatenate([t[1][t[0] == f] for t in trees])) for f in range(width)]
        room, self.ready = TABLE_BYTES, []
        for arrays in trees:
            words = -(-int((arrays[0] < 0).sum()) // 64)
            room -= 8 * words * sum(len(c) + 1 for c in self.cuts)
            self.ready.append(_Bits(arrays, self.cuts, words) if words <= WORDS and room >= 0 else Walk(arrays))

    def leaves(self, x: np.ndarray):
        """For each tree the leaves of the rows."""
        at = [np.searchsorted(c, x[:, f]) for f, c in enumerate(self.cuts)]
        for tree in self.ready:
            yield tree(x) if isinstance(tree, Walk) else tree(at, len(x))


class _Bits:
    def __init__(self, arrays, cuts, words: int):
        feature, threshold, left, right = arrays
        span, order, ways = {}, [], [(0, False)]
        while ways:                                        # leaves from left to right, and those below each node
            node, seen = ways.pop()
            if feature[node] < 0:
                span[node] = (len(order), len(order) + 1)
                order.append(node)
            elif seen:
                span[node] = (span[left[node]][0], span[right[node]][1])
            else:
                ways += [(node, True), (right[node], False), (left[node], False)]
        self.order, self.tables = np.array(order), []
        for f in np.unique(feature[feature >= 0]):
            table = np.full((words, len(cuts[f]) + 1), ~np.uint64(0))
            for node in np.flatnonzero(feature == f):
                begin, end = span[left[node]]
                above = np.searchsorted(cuts[f], threshold[node]) + 1
                for w in range(begin // 64, (end - 1) // 64 + 1):
                    low, high = max(begin - 64 * w, 0), min(end - 64 * w, 64)
                    table[w, above:] &= ~np.uint64((1 << high) - (1 << low))
            self.tables.append((f, table))
        self.words = words

    def __call__(self, at, rows: int) -> np.ndarray:
        if not self.tables:
            return np.zeros(rows, np.intp)
        leaf = None
        for w in range(self.words - 1, -1, -1):
            bits = None
            for f, table in self.tables:
                some = table[w].take(at[f])
                bits = some if bits is None else np.bitwise_and(bits, some, out=bits)
            first = np.bitwise_count(~bits & (bits - np.uint64(1))).astype(np.intp) + 64 * w
            leaf = first if leaf is None else np.where(bits != 0, first, leaf)
        return self.order.take(leaf)


@dataclass(frozen=True)
class Rule:
    """When a node may be split, and how good a split is. `how`: 'gini', 'entropy' or 'newton'."""
    how: str
    leaf: int                      # rows of a child at least
    split: int = 2                 # rows of a node at least
    depth: int = 15


def impurity(how: str, stats: np.ndarray) -> np.ndarray:
    """Impurity times weight of nodes; for 'newton' the loss that is left, up to a constant."""
    if how == "newton":
        return -stats[..., 1] ** 2 / np.maximum(stats[..., 2], _TINY)
    weights = stats[..., 1:]
    total = weights.sum(-1)
    share = weights / np.maximum(total, _TINY)[..., None]
    if how == "gini":
        return total * (1 - (share ** 2).sum(-1))
    return -total * (share * np.log2(np.where(share > 0, share, 1.0))).sum(-1)


@dataclass(frozen=True)
class Open:
    """An open node: its tree, number and candidate features, and drawn thresholds where there are no bins."""
    tree: int
    node: int
    features: np.ndarray
    cuts: np.ndarray | None = None


# Work on a block of rows -----------------------------------------------------------------------

@dataclass
class Block:
    """Rows in memory: features, their bins, and for each tree the statistics (rows x S; the first is 0 or 1)."""
    x: np.ndarray
    bins: np.ndarray | None
    stats_of: object               # tree -> rows x S


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1).astype(np.int16) if edges else np.zeros(x.shape, np.int16)


def _open_rows(block: Block, opened: list[Open], arrays: dict):
    """Per tree: (numbers of its open nodes within `opened`, rows, the open node of each row, statistics)."""
    by_tree: dict[int, list[int]] = {}
    for i, o in enumerate(opened):
        by_tree.setdefault(o.tree, []).append(i)
    for tree, numbers in by_tree.items():
        place_of = np.full(len(arrays[tree][0]), -1)
        place_of[[opened[i].node for i in numbers]] = np.arange(len(numbers))
        own = place_of[place(arrays[tree], block.x)]
        stats = block.stats_of(tree)
        rows = np.flatnonzero((own >= 0) & (stats[:, 0] > 0))
        yield np.array(numbers), rows, own[rows], stats[rows]


def tally(block: Block, opened: list[Open], arrays: dict) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums): keys are (number of the open node, slot of the feature, bin) in one number, rising."""
    keys, values = [], []
    for numbers, rows, own, stats in _open_rows(block, opened, arrays):
        features = np.stack([opened[i].features for i in numbers])[own]
        if opened[numbers[0]].cuts is None:
            at = block.bins[rows[:, None], features]
        else:
            at = block.x[rows[:, None], features] > np.stack([opened[i].cuts for i in numbers])[own]
        m = features.shape[1]
        keys.append(((numbers[own][:, None] * m + np.arange(m)) * (BINS + 1) + at).ravel())
        values.append(np.repeat(stats, m, axis=0))
    return merged(np.concatenate(keys), np.concatenate(values)) if keys else (np.zeros(0, np.int64), np.zeros((0, 3)))


def merged(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(values, begin, axis=0)


def ranges(block: Block, opened: list[Open], arrays: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the open node * slots + slot, least, greatest) of the candidate features."""
    keys, low, high = [], [], []
    for numbers, rows, own, _ in _open_rows(block, opened, arrays):
        order = np.argsort(own, kind="stable")
        rows, own = rows[order], own[order]
        if len(rows):
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            values = block.x[rows[:, None], np.stack([opened[i].features for i in numbers])[own]]
            keys.append((numbers[own[begin]][:, None] * values.shape[1] + np.arange(values.shape[1])).ravel())
            low.append(np.minimum.reduceat(values, begin, axis=0).ravel())
            high.append(np.maximum.reduceat(values, begin, axis=0).ravel())
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(keys, np.int64), join(low, float), join(high, float)


def best_splits(keys: np.ndarray, sums: np.ndarray, slots: int, rule: Rule) -> list[tuple]:
    """For each open node (number, slot or -1, bin, gain, statistics of the left child, and of the node)."""
    if not len(keys):
        return []
    feature = keys // (BINS + 1)
    begin = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
    size = np.diff(np.append(begin, len(keys)))
    upto = np.cumsum(sums, axis=0)
    # sums that start anew with each feature: cancellation is no worse than in the whole column
    left = upto - np.repeat(upto[begin] - sums[begin], size, axis=0)
    node = np.repeat(np.add.reduceat(sums, begin, axis=0), size, axis=0)
    right = node - left
    gain = impurity(rule.how, node) - impurity(rule.how, left) - impurity(rule.how, right)
    floor = 1e-9 * np.abs(impurity(rule.how, node)) + _TINY
    last = np.zeros(len(keys), bool)
    last[begin + size - 1] = True
    fits = ~last & (left[:, 0] > rule.leaf - 0.5) & (right[:, 0] > rule.leaf - 0.5) & (gain > floor)
    if rule.how == "newton":
        fits &= (left[:, 2] > 1e-3) & (right[:, 2] > 1e-3)
    gain = np.where(fits, gain, -1.0)
    number = feature // slots
    nodes = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    most = np.repeat(np.maximum.reduceat(gain, nodes), np.diff(np.append(nodes, len(keys))))
    hits = np.flatnonzero(gain == most)                    # the first of the best in each node
    firsts = hits[np.concatenate([[True], number[hits][1:] != number[hits][:-1]])]
    return [(int(number[i]), int(feature[i] % slots) if gain[i] > 0 else -1, int(keys[i] % (BINS + 1)), float(gain[i]), left[i], node[i]) for i in firsts]


class Local:
    """Passes over a bounded sample in this process."""

    def __init__(self, block: Block):
        self.block = block

    def best(self, opened, arrays, rule):
        keys, sums = tally(self.block, opened, arrays)
        return best_splits(keys, sums, len(opened[0].features), rule)

    def ranges(self, opened, arrays):
        return ranges(self.block, opened, arrays)


CELLS = 1 << 22                    # sums that are held at a time


class Counted:
    """Passes over the rows of one classification tree in this process: their bins, classes, and how often each was
    drawn, at least once. A row stays with its node from pass to pass, and sums are counts, so nothing is sorted and
    the order of the rows does not matter."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, times: np.ndarray, weights: np.ndarray, edges):
        self.bins, self.y, self.times, self.weights, self.edges = bins, y, times, weights, edges
        self.node = np.zeros(len(y), np.int32)

    def _step(self, arrays):
        """Takes the rows down to nodes that are not split."""
        feature, threshold, left, right = arrays
        inner, cut = feature >= 0, np.zeros(len(feature), np.int64)
        for f in np.unique(feature[inner]):
            own = feature == f
            cut[own] = np.searchsorted(self.edges[f], threshold[own])
        while len(rows := np.flatnonzero(inner.take(self.node))):
            at = self.node[rows]
            self.node[rows] = np.where(self.bins[rows, feature[at]] <= cut[at], left[at], right[at])

    def best(self, opened, arrays, rule):
        arrays, = arrays.values()
        self._step(arrays)
        slots, classes, found = len(opened[0].features), len(self.weights), []
        features, slot = np.stack([o.features for o in opened]), np.arange(len(opened[0].features))
        place_of = np.full(len(arrays[0]), -1)
        place_of[[o.node for o in opened]] = np.arange(len(opened))
        own = place_of.take(self.node)
        few = max(1, CELLS // (slots * (BINS + 1) * classes))
        for first in range(0, len(opened), few):
            size = min(few, len(opened) - first) * slots * (BINS + 1)
            rows = np.flatnonzero((own >= first) & (own < first + few))
            key = ((own[rows, None] - first) * slots + slot) * (BINS + 1) + self.bins[rows[:, None], features[own[rows]]]
            times = np.repeat(self.times[rows], slots)
            weight = np.bincount((key * classes + self.y[rows, None]).ravel(), times, size * classes).reshape(size, classes)
            count = np.bincount(key.ravel(), minlength=size)
            there = np.flatnonzero(count)
            found += best_splits(there + first * slots * (BINS + 1), np.column_stack([count[there], weight[there] * self.weights]), slots, rule)
        return found


class Spread:
    """Passes over the blocks of a stored table: `blocks(batches)` turns a task's batches into Blocks."""

    def __init__(self, rows, blocks):
        self.rows, self.blocks = rows, blocks

    def best(self, opened, arrays, rule):
        import pyarrow as pa
        blocks, slots = self.blocks, len(opened[0].features)

        def add(batches):
            held_keys, held_sums, size = [], [], 0

            def out():
                keys, sums = merged(np.concatenate(held_keys), np.concatenate(held_sums))
                return pa.RecordBatch.from_arrays([pa.array(keys // ((BINS + 1) * slots)), pa.array(keys), pa.array(list(sums), pa.list_(pa.float64()))], ["number", "key", "sums"])
            for block in blocks(batches):
                keys, sums = tally(block, opened, arrays)
                held_keys.append(keys)
                held_sums.append(sums)
                size += len(keys)
                if size > 1 << 20:                         # sums of many blocks meet before they leave the task
                    keys, sums = merged(np.concatenate(held_keys), np.concatenate(held_sums))
                    held_keys, held_sums, size = [keys], [sums], len(keys)
                    if size > 1 << 19:
                        yield out()
                        held_keys, held_sums, size = [], [], 0
            if size:
                yield out()

        def find(batches):
            rest = None
            for batch in _with_end(batches):
                if batch is not None:
                    keys = batch.column("key").to_numpy()
                    sums = batch.column("sums").flatten().to_numpy().reshape(len(keys), -1) if len(keys) else np.zeros((0, 3))
                    if not len(keys):
                        continue
                    if rest is not None:
                        keys, sums = np.concatenate([rest[0], keys]), np.concatenate([rest[1], sums])
                    number = keys // ((BINS + 1) * slots)
                    whole = int(np.searchsorted(number, number[-1]))       # the last node may go on in the next batch
                    rest, keys, sums = merged(keys[whole:], sums[whole:]), keys[:whole], sums[:whole]
                elif rest is not None:
                    (keys, sums), rest = rest, None
                else:
                    continue
                found = best_splits(*merged(keys, sums), slots, rule)
                if found:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64()),
                         pa.array(columns[4], pa.list_(pa.float64())), pa.array(columns[5], pa.list_(pa.float64()))], ["number", "slot", "bin", "gain", "left", "node"])
        sums = self.rows.mapInArrow(add, "number long, key long, sums array<double>")
        found = (sums.repartition("number").sortWithinPartitions("key")
                 .mapInArrow(find, "number long, slot long, bin long, gain double, left array<double>, node array<double>"))
        return [(r.number, r.slot, r.bin, r.gain, np.array(r.left), np.array(r.node)) for r in sorted(found.collect(), key=lambda r: r.number)]

    def ranges(self, opened, arrays):
        import pyarrow as pa
        from pyspark.sql import functions as F
        blocks = self.blocks

        def run(batches):
            for block in blocks(batches):
                keys, low, high = ranges(block, opened, arrays)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["key", "low", "high"])
        found = self.rows.mapInArrow(run, "key long, low double, high double").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        found.sort(key=lambda r: r.key)
        return np.array([r.key for r in found], np.int64), np.array([r.low for r in found]), np.array([r.high for r in found])


def _with_end(batches):
    yield from batches
    yield None


# Growing ----------------------------------------------------------------------------------------

def _order_of(seed: int, tree: int, node: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, node]).permutation(width)


def grow(engine, trees: int, width: int, rule: Rule, edges, seeds=None, per_node: int | None = None, random_cuts: bool = False) -> list[Tree]:
    """Classification trees. `per_node` features are looked at in each node (None: all); where none of them
    can be split, the next ones are. `random_cuts`: a threshold is drawn for each, instead of the best bin."""
    grown = [Tree() for _ in range(trees)]
    slots = min(width, per_node or width)
    frontier = [(t, 0, 0) for t in range(trees)]
    seeds = seeds if seeds is not None else [(0, t) for t in range(trees)]
    every = np.arange(width)
    while frontier:
        opened, tries = [], []
        for t, node, tried in frontier:
            order = every if slots == width else _order_of(*seeds[t], node, width)
            some = order[tried * slots:(tried + 1) * slots]
            if len(some):
                opened.append(Open(t, node, np.resize(some, slots)))
                tries.append(tried)
        if not opened:
            break
        arrays = {t: grown[t].arrays() for t in {o.tree for o in opened}}
        if random_cuts:
            keys, low, high = engine.ranges(opened, arrays)
            cuts = np.full(len(opened) * slots, np.inf)
            for i in np.unique(keys // slots):
                own = slice(*np.searchsorted(keys, [i * slots, (i + 1) * slots]))
                o = opened[i]
                draws = np.random.default_rng([*seeds[o.tree], o.node, tries[i] + 1]).random(slots)[keys[own] % slots]
                drawn = low[own] + draws * (high[own] - low[own])
                cuts[keys[own]] = np.where(high[own] > low[own], np.where(drawn >= high[own], low[own], drawn), np.inf)
            opened = [Open(o.tree, o.node, o.features, cuts[i * slots:(i + 1) * slots]) for i, o in enumerate(opened)]
        frontier = []
        for number, slot, at, _, left, node_stats in engine.best(opened, arrays, rule):
            o = opened[number]
            tree = grown[o.tree]
            tree.stats[o.node] = node_stats
            if slot < 0 or not may_split(tree, o.node, rule):
                if slot < 0 and slots < width and may_split(tree, o.node, rule):
                    frontier.append((o.tree, o.node, tries[number] + 1))
                continue
            feature = int(o.features[slot])
            threshold = float(o.cuts[slot] if random_cuts else edges[feature][at])
            for child in tree.split(o.node, feature, threshold, left, node_stats - left):
                if may_split(tree, child, rule):
                    frontier.append((o.tree, child, 0))
    return grown


def may_split(tree: Tree, node: int, rule: Rule) -> bool:
    stats = tree.stats[node]
    return bool(tree.depth[node] < rule.depth and stats[0] > max(rule.split, 2 * rule.leaf) - 0.5
                and (rule.how == "newton" or impurity(rule.how, stats) > 1e-9 * max(stats[1:].sum(), _TINY)))


def grow_best_first(engine, names: list[int], width: int, rule: Rule, edges, leaves: int) -> dict[int, Tree]:
    """For each name a tree of at most `leaves` leaves, in which always the leaf with the largest gain was split.

    A pass looks at all nodes that this order would reach by what is known so far; when it asks for no more
    of them, the order is that of splitting one leaf after another."""
    grown = {t: Tree() for t in names}
    known: dict[tuple[int, int], tuple] = {}
    every = np.arange(width)
    wanted = [(t, 0) for t in names]
    while wanted:
        opened = [Open(t, node, every) for t, node in wanted]
        for number, slot, at, gain, left, stats in engine.best(opened, {t: grown[t].arrays() for t in {t for t, _ in wanted}}, rule):
            t, node = wanted[number]
            tree = grown[t]
            tree.stats[node] = stats
            usable = slot >= 0 and may_split(tree, node, rule)
            if usable:                                     # its children are there from now on; they count only if the order takes it
                tree.split(node, slot, float(edges[slot][at]), left, stats - left)
            known[t, node] = (gain if usable else 0.0,)
        for key in wanted:
            known.setdefault(key, (0.0,))
        wanted = []
        for t in {t for t, _ in known}:
            wanted += [(t, n) for n in _taken(grown[t], known, t, leaves)[1] if may_split(grown[t], n, rule)]
            for n in _taken(grown[t], known, t, leaves)[1]:
                if not may_split(grown[t], n, rule):
                    known[t, n] = (0.0,)
    return {t: _subtree(grown[t], _taken(grown[t], known, t, leaves)[0]) for t in names}


def _taken(tree: Tree, known, t: int, leaves: int) -> tuple[set[int], list[int]]:
    """(the nodes that are split, those of which that is not known yet) by largest gain first."""
    heap, split, unknown, n = [], set(), [], 1

    def look(node):
        if (t, node) not in known:
            unknown.append(node)
        elif known[t, node][0] > 0:
            heapq.heappush(heap, (-known[t, node][0], node))
    look(0)
    while heap and n < leaves:
        _, node = heapq.heappop(heap)
        split.add(node)
        n += 1
        look(tree.left[node])
        look(tree.right[node])
    return split, unknown


def _subtree(tree: Tree, inner: set[int]) -> Tree:
    """The tree in which only `inner` nodes are split."""
    out = Tree(stats=[tree.stats[0]])
    ways = [(0, 0)]
    while ways:
        old, new = ways.pop()
        if old in inner and tree.feature[old] >= 0:
            a, b = tree.left[old], tree.right[old]
            ways += zip((a, b), out.split(new, tree.feature[old], tree.threshold[old], tree.stats[a], tree.stats[b]))
    return out


def prune(tree: Tree, how: str, alpha: float) -> Tree:
    """Weakest-link pruning: as long as the cheapest inner node costs at most `alpha` for each leaf that it
    saves, it becomes a leaf. Costs are impurities as a share of the root's weight."""
    total = max(float(tree.stats[0][1:].sum()), _TINY)
    own = [float(impurity(how, s)) / total for s in tree.stats]
    below = [(cost, 1) for cost in own]                    # (cost of the leaves, their number), of what is left
    inner = set()
    for node in range(len(own) - 1, -1, -1):               # children have larger numbers than their parent
        if tree.feature[node] >= 0:
            (a, n), (b, m) = below[tree.left[node]], below[tree.right[node]]
            if (own[node] - a - b) / (n + m - 1) > alpha:
                below[node] = (a + b, n + m)
                inner.add(node)
    return _subtree(tree, inner)
