"""Greedy, start-anchored cuts of an ordered key.

A run of rows ends when a row lies `active` or more after the run's own first row, `inactivity` or
more after the row before it, or when a closing row was seen; after a closing row, rows up to
`linger` later are absorbed and belong to no run. Where a run starts depends on where the one
before started, which no window frame can express. The same rule makes flows out of packets,
throttles alerts (a run is one cooldown period) and cuts a log into segments (the axis is a byte
offset instead of a time).

How it is spread: rows are shuffled once by (key, chunk) and sorted; a partition is then scanned
in Arrow batches with numpy. For every row the scan finds, by binary search, where the next run
would start if one started at this row; the runs are then the path through these links. A batch that
goes on with the key of the one before enters in the state in which that one ended, so memory is one
batch, however many rows a key or chunk has. Keys that hold several chunks (see `ordered.with_chunks`) need one pass
more: it condenses each of their chunks into a step function from the state at its entry to the
state at its exit, a stream over these per-chunk rows settles the entry states, and the scan then
starts each chunk from its entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from wirelark.operators.ordered import CHUNK, OPENINGS, with_chunks

NEVER = 1 << 60          # stands for an infinite limit
_NONE, _OPEN, _CLOSED = 0, 1, 2
_BEFORE_ALL = -(1 << 62)

_ENTRY_FIELDS = ["mode", "limit", "start_t", "start_seq", "start_side", "prev_t", "mark_t",
                 "t0", "seq0", "t1", "seq1", "rows"]
_ENTRY_SCHEMA = T.StructType([T.StructField(f, T.LongType()) for f in _ENTRY_FIELDS])

# What the scan adds to a row.
RUN_COLUMNS = T.StructType([
    T.StructField("run_t", T.LongType()),          # position of the first row of the run;
    T.StructField("run_seq", T.LongType()),        # null on absorbed rows
    T.StructField("run_side", T.IntegerType()),    # `side` of that row
    T.StructField("absorbed", T.BooleanType()),
    T.StructField("prev_t", T.LongType()),         # row before in the key
    T.StructField("side_prev_t", T.LongType()),    # row before in the key with the same `side`
    T.StructField("side_prev_seq", T.LongType()),
    T.StructField("mark_t", T.LongType()),         # last row so far whose gap exceeded `idle`
    T.StructField("prev_mark_t", T.LongType()),    # the same, as of the row before
    T.StructField("run_pos", T.LongType()),        # rows of the run before this one
    T.StructField("prev_run_pos", T.LongType()),   # of the row before; null if its run was closed
])


class _Limits:
    def __init__(self, active, inactivity, linger, idle):
        self.active = min(int(active), NEVER)
        self.inactivity = min(int(inactivity), NEVER)
        self.linger = min(int(linger), NEVER)
        self.idle = min(int(idle), NEVER)


def _next_at_or_after(flags: np.ndarray) -> np.ndarray:
    """For each index the first flagged index >= it, or len(flags)."""
    n = len(flags)
    spots = np.where(flags, np.arange(n), n)
    return np.minimum.accumulate(spots[::-1])[::-1]


def _first_past(axis, group_end, reach, side):
    """First index of the row's group at or past axis + reach (its group's end if none)."""
    if reach >= NEVER:
        return group_end
    return np.minimum(np.searchsorted(axis, axis + reach, side=side), group_end)


class _Links:
    """For each row of a batch of whole groups: where the next run starts if one starts here."""

    def __init__(self, t, closes, first, limits):
        n = len(t)
        self.n, self.t, self.first, self.limits = n, t, first, limits
        group = np.cumsum(first) - 1
        firsts = np.flatnonzero(first)
        self.firsts = firsts
        self.group_end = np.append(firsts[1:], n)[group]
        # one increasing axis over all groups, further apart than any finite limit reaches
        reach = max([x for x in (limits.active, limits.linger) if x < NEVER], default=0) + 1
        gaps = np.diff(t, prepend=t[:1])
        gaps[firsts] = reach
        self.axis = np.cumsum(gaps)
        gaps[firsts] = 0
        self.gaps = gaps
        too_long = gaps >= limits.inactivity
        too_long[firsts] = False
        self.closes = closes
        self.too_long = too_long
        later_gap = np.append(_next_at_or_after(too_long)[1:], n) if n else np.empty(0, int)
        self.cut = np.minimum(_first_past(self.axis, self.group_end, limits.active, "left"),
                              np.minimum(later_gap, self.group_end))
        self.close = _next_at_or_after(closes)
        resume = _first_past(self.axis, self.group_end, limits.linger, "right")
        self.resume = resume
        self.closed = self.close < self.cut
        safe = np.minimum(self.close, max(n - 1, 0))
        self.next = np.where(self.closed, resume[safe], self.cut)

    def first_run(self, g0, g1, entry):
        """(index of the first run start in rows g0..g1, index from which rows are absorbed) for
        a group that begins in the given entry state."""
        t = self.t
        if entry["mode"] == _CLOSED:
            start = g0 + int(np.searchsorted(t[g0:g1], entry["limit"], side="right"))
            return start, g0
        if t[g0] - entry["prev_t"] >= self.limits.inactivity:
            return g0, g0
        cut = g0 + int(np.searchsorted(t[g0:g1], entry["limit"], side="left"))
        gap = g0 + int(np.argmax(self.too_long[g0:g1])) if self.too_long[g0:g1].any() else g1
        cut = min(cut, gap)
        close = int(self.close[g0])
        if close < cut:
            return int(self.resume[close]), close + 1
        return cut, cut


def _last_before(flags, first_of_row):
    """For each row the last flagged index < it inside its group, or -1."""
    n = len(flags)
    seen = np.maximum.accumulate(np.where(flags, np.arange(n), -1))
    before = np.concatenate(([-1], seen[:-1])) if n else seen
    return np.where(before >= first_of_row, before, -1)


def _scan(t, seq, side, closes, first, limits, entries):
    """(state after the last row, run columns). `entries` maps a group's first index to the state in
    which it is entered; a group may end with more of its rows to come."""
    n = len(t)
    links = _Links(t, closes, first, limits)
    index = np.arange(n)
    first_of_row = links.firsts[np.cumsum(first) - 1]
    ends = dict(zip(links.firsts.tolist(), np.append(links.firsts[1:], n).tolist()))

    pending = {g: links.first_run(g, ends[g], e) for g, e in entries.items() if e["mode"] != _NONE}
    absorb_from = {g: absorbed for g, (_, absorbed) in pending.items()}
    following = links.next.tolist()
    starts = []
    i = 0
    while i < n:
        here = pending.pop(i, None)
        if here is not None and here[0] != i:
            i = here[0]
            continue
        starts.append(i)
        i = following[i]

    is_start = np.zeros(n, dtype=bool)
    is_start[starts] = True
    run = np.maximum.accumulate(np.where(is_start, index, -1))
    own = run >= first_of_row
    safe = np.maximum(run, 0)
    absorbed = own & links.closed[safe] & (index > links.close[safe])
    run_t = np.where(own, t[safe], 0)
    run_seq = np.where(own, seq[safe], 0)
    run_side = np.where(own, side[safe], 0)
    run_pos = np.where(own, index - safe, 0)

    has_prev = ~first.copy()
    prev_t = np.where(has_prev, np.concatenate((t[:1], t[:-1])), 0)
    same0, same1 = _last_before(side == 0, first_of_row), _last_before(side != 0, first_of_row)
    same = np.where(side == 0, same0, same1)
    has_same = same >= 0
    same_safe = np.maximum(same, 0)
    side_prev_t = np.where(has_same, t[same_safe], 0)
    side_prev_seq = np.where(has_same, seq[same_safe], 0)
    long_gap = links.gaps > limits.idle
    for g, e in entries.items():
        if e["mode"] != _NONE and t[g] - e["prev_t"] > limits.idle:
            long_gap[g] = True
    prev_mark = _last_before(long_gap, first_of_row)
    mark = np.where(long_gap, index, prev_mark)
    mark_t, has_mark = np.where(mark >= 0, t[np.maximum(mark, 0)], 0), mark >= 0
    prev_mark_t, has_prev_mark = np.where(prev_mark >= 0, t[np.maximum(prev_mark, 0)], 0), prev_mark >= 0

    for g, e in entries.items():
        if e["mode"] == _NONE:
            continue
        rows = slice(g, ends[g])
        head = slice(g, ends[g])
        outside = ~own[rows]
        if outside.any():
            absorbed[rows] |= outside & (index[rows] >= absorb_from[g])
            run_t[rows] = np.where(outside, e["start_t"], run_t[rows])
            run_seq[rows] = np.where(outside, e["start_seq"], run_seq[rows])
            run_side[rows] = np.where(outside, e["start_side"], run_side[rows])
            run_pos[rows] = np.where(outside, e["rows"] + index[rows] - g, run_pos[rows])
        prev_t[g], has_prev[g] = e["prev_t"], True
        for k, at, at_seq in ((0, e["t0"], e["seq0"]), (1, e["t1"], e["seq1"])):
            if at == _BEFORE_ALL:
                continue
            lacking = ~has_same[head] & ((side[head] == 0) == (k == 0))
            side_prev_t[head] = np.where(lacking, at, side_prev_t[head])
            side_prev_seq[head] = np.where(lacking, at_seq, side_prev_seq[head])
            has_same[head] |= lacking
        if e["mark_t"] != _BEFORE_ALL:
            for values, known in ((mark_t, has_mark), (prev_mark_t, has_prev_mark)):
                values[head] = np.where(known[head], values[head], e["mark_t"])
                known[head] = True
    in_run = ~absorbed
    state = _state_after(links, t, seq, side, run, absorbed, (run_t, run_seq, run_side, run_pos),
                         mark_t[-1] if has_mark[-1] else _BEFORE_ALL, entries)
    prev_run_pos = np.concatenate((run_pos[:1], run_pos[:-1]))
    still_open = in_run & ~closes
    prev_in_run = has_prev & np.concatenate((still_open[:1], still_open[:-1]))
    for g, e in entries.items():
        if e["mode"] != _NONE:
            prev_run_pos[g], prev_in_run[g] = e["rows"] - 1, e["mode"] == _OPEN
    return state, [
        pa.array(run_t, pa.int64(), mask=~in_run), pa.array(run_seq, pa.int64(), mask=~in_run),
        pa.array(run_side, pa.int32(), mask=~in_run), pa.array(absorbed, pa.bool_()),
        pa.array(prev_t, pa.int64(), mask=~has_prev),
        pa.array(side_prev_t, pa.int64(), mask=~has_same),
        pa.array(side_prev_seq, pa.int64(), mask=~has_same),
        pa.array(mark_t, pa.int64(), mask=~has_mark),
        pa.array(prev_mark_t, pa.int64(), mask=~has_prev_mark),
        pa.array(run_pos, pa.int64(), mask=~in_run),
        pa.array(prev_run_pos, pa.int64(), mask=~prev_in_run),
    ]


def _state_after(links, t, seq, side, run, absorbed, of_run, mark_t, entries):
    """The entry state of a row that follows the last one in its group."""
    g, i, limits = int(links.firsts[-1]), len(t) - 1, links.limits
    entry = entries.get(g)
    entry = dict(entry) if entry is not None and entry["mode"] != _NONE else dict.fromkeys(_ENTRY_FIELDS, _BEFORE_ALL) | {"mode": _NONE}
    run_t, run_seq, run_side, run_pos = (int(c[i]) for c in of_run)
    state = entry | {"prev_t": int(t[i]), "mark_t": int(mark_t)}
    for k, rows in ((0, np.flatnonzero(side[g:] == 0)), (1, np.flatnonzero(side[g:] != 0))):
        if len(rows):
            state[f"t{k}"], state[f"seq{k}"] = int(t[g + rows[-1]]), int(seq[g + rows[-1]])
    if absorbed[i] or links.closes[i]:
        closed_at = None
        if not absorbed[i]:
            closed_at = i
        elif run[i] >= g:
            closed_at = int(links.close[run[i]])
        elif entry["mode"] == _OPEN:                    # the run it was entered in closed here
            closed_at = int(links.close[g])
        limit = entry["limit"] if closed_at is None else int(t[closed_at]) + limits.linger
        return state | {"mode": _CLOSED, "limit": limit, "start_t": 0, "start_seq": 0, "start_side": 0, "rows": 0}
    return state | {"mode": _OPEN, "limit": run_t + limits.active, "start_t": run_t, "start_seq": run_seq,
                    "start_side": run_side, "rows": run_pos + 1}


def _group_starts(table, group_columns):
    """Flags the rows at which a group begins, the first row always."""
    first = np.zeros(len(table), dtype=bool)
    first[0] = True
    for name in group_columns:
        column = table.column(name)
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
        first[1:] |= differs.to_numpy(zero_copy_only=False)
    return first


def _whole_groups(batches, group_columns):
    """Re-slices sorted batches so that no group straddles two of them; yields (table, first)."""
    held = []

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        return table, _group_starts(table.to_batches()[0], group_columns)

    def same_group(batch):
        last = held[-1]
        return all(last.column(c)[len(last) - 1].as_py() == batch.column(c)[len(batch) - 1].as_py()
                   for c in map(last.schema.get_field_index, group_columns))

    for batch in batches:
        if not len(batch):
            continue
        if held and same_group(batch):        # still inside one long group: only keep collecting
            held.append(batch)
            continue
        held.append(batch)
        table, first = joined()
        tail = int(np.flatnonzero(first)[-1])
        if tail:
            yield table.slice(0, tail), first[:tail]
        held = table.slice(tail).combine_chunks().to_batches()
    if held:
        yield joined()


def _numbers(table, name):
    return table.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _inputs(table, t, seq, side, closes):
    n = len(table)
    return (_numbers(table, t), _numbers(table, seq),
            _numbers(table, side) if side else np.zeros(n, dtype=np.int64),
            (table.column(closes).to_numpy(zero_copy_only=False).astype(bool) if closes
             else np.zeros(n, dtype=bool)))


def greedy_cuts(df: DataFrame, key: str, t: str, seq: str, *, active=NEVER, inactivity=NEVER,
                linger=NEVER, idle=NEVER, closes: str | None = None, side: str | None = None,
                chunk_rows: int | None = None, probe: DataFrame | None = None) -> DataFrame:
    """Adds RUN_COLUMNS. `key` is one string column, `t` a bigint axis and (t, seq) unique within
    the key; `closes` and `side` are non-null boolean / 0-1 columns; for `probe` see
    `ordered.with_chunks`."""
    limits = _Limits(active, inactivity, linger, idle)
    chunked, split = with_chunks(df, [key], [t, seq], chunk_rows, probe)
    if split:
        chunked = chunked.join(F.broadcast(_entry_states(chunked, key, t, seq, side, closes, limits)),
                               [key, CHUNK], "left").drop(OPENINGS)
    names = list(df.columns)
    out_schema = T.StructType(df.schema.fields + RUN_COLUMNS.fields)

    def scan(batches):
        group, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            first = _group_starts(batch, [key, CHUNK])
            entries = {}
            if split:
                firsts = np.flatnonzero(first)
                entries = {int(g): e for g, e in zip(firsts, batch.column("_entry").take(pa.array(firsts)).to_pylist())
                           if e is not None}
            ends = [(batch.column(key)[i].as_py(), batch.column(CHUNK)[i].as_py()) for i in (0, len(batch) - 1)]
            if ends[0] == group:
                entries[0] = state
            state, added = _scan(*_inputs(batch, t, seq, side, closes), first, limits, entries)
            group = ends[1]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + added, names + RUN_COLUMNS.names)

    return (chunked.repartition(key, CHUNK).sortWithinPartitions(key, CHUNK, t, seq)
            .mapInArrow(scan, out_schema))


# Only for keys that hold several chunks -------------------------------------------------------

_STATE_FIELDS = ["mode", "limit", "start_t", "start_seq", "start_side", "rows"]
_STATE = T.StructType([T.StructField(f, T.LongType()) for f in _STATE_FIELDS])
_STEP = T.StructType([T.StructField("upto", T.LongType()), *_STATE.fields])
_DIGEST = T.StructType([
    T.StructField("rows", T.LongType()),
    T.StructField("first_t", T.LongType()), T.StructField("last_t", T.LongType()),
    T.StructField("t0", T.LongType()), T.StructField("seq0", T.LongType()),
    T.StructField("t1", T.LongType()), T.StructField("seq1", T.LongType()),
    T.StructField("mark_t", T.LongType()),
    T.StructField("close_t", T.LongType()), T.StructField("gap_t", T.LongType()),
    T.StructField("close_first", T.BooleanType()),
    T.StructField("at_first", _STATE), T.StructField("at_close", _STATE),
    T.StructField("at_gap", _STATE), T.StructField("steps", T.ArrayType(_STEP)),
])


def _digest(t, seq, side, closes, limits):
    """Condenses one chunk: where each reachable entry state leads to."""
    n = len(t)
    first = np.zeros(n, dtype=bool)
    first[0] = True
    links = _Links(t, closes, first, limits)
    root = np.where(links.next >= n, np.arange(n), links.next)
    while True:                                     # follow the links, doubling the stride
        further = root[root]
        if np.array_equal(further, root):
            break
        root = further

    def after(i):
        """State at the chunk's end when a run starts at row i."""
        r = int(root[i])
        if links.closed[r]:
            return {"mode": _CLOSED, "limit": int(t[links.close[r]]) + limits.linger,
                    "start_t": 0, "start_seq": 0, "start_side": 0, "rows": 0}
        return {"mode": _OPEN, "limit": int(t[r]) + limits.active, "start_t": int(t[r]),
                "start_seq": int(seq[r]), "start_side": int(side[r]), "rows": n - r}

    reach = max([x for x in (limits.active, limits.linger) if x < NEVER], default=0)
    reachable = min(int(np.searchsorted(t, t[0] + reach, side="right")) + 1, n)
    heads = np.flatnonzero(np.diff(root[:reachable], append=-1) != 0)   # last row of each step
    steps = [{"upto": int(t[i]), **after(int(i))} for i in heads.tolist()]

    close = int(links.close[0])
    gap = int(np.argmax(links.too_long)) if links.too_long.any() else n
    at_close = None
    if close < n:
        resume = int(links.resume[close])
        at_close = after(resume) if resume < n else {
            "mode": _CLOSED, "limit": int(t[close]) + limits.linger,
            "start_t": 0, "start_seq": 0, "start_side": 0, "rows": 0}
    long_gap = links.gaps > limits.idle
    zero, one = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    return {
        "rows": n, "first_t": int(t[0]), "last_t": int(t[-1]),
        "t0": int(t[zero[-1]]) if len(zero) else None, "seq0": int(seq[zero[-1]]) if len(zero) else None,
        "t1": int(t[one[-1]]) if len(one) else None, "seq1": int(seq[one[-1]]) if len(one) else None,
        "mark_t": int(t[np.flatnonzero(long_gap)[-1]]) if long_gap.any() else None,
        "close_t": int(t[close]) if close < n else None, "gap_t": int(t[gap]) if gap < n else None,
        "close_first": close < gap, "at_first": after(0), "at_close": at_close,
        "at_gap": after(gap) if gap < n else None, "steps": steps,
    }


def _leave(state, digest, limits):
    """State after a chunk, given the state (with prev_t) before it."""
    unchanged = {**state, "rows": state["rows"] + digest["rows"]}

    def step(limit, strict):
        for s in digest["steps"]:
            if s["upto"] > limit or (s["upto"] == limit and not strict):
                return s
        return None

    if state["mode"] == _NONE:
        return digest["at_first"]
    if state["mode"] == _CLOSED:
        return step(state["limit"], True) or unchanged
    if digest["first_t"] - state["prev_t"] >= limits.inactivity:
        return digest["at_first"]
    close, gap = digest["close_t"], digest["gap_t"]
    if close is not None and digest["close_first"] and close < state["limit"]:
        return digest["at_close"]
    if gap is not None and gap < state["limit"]:
        return digest["at_gap"]
    return step(state["limit"], False) or unchanged


def _entry_states(chunked, key, t, seq, side, closes, limits) -> DataFrame:
    """One row per (key, chunk) of the split keys: the state in which the chunk is entered. The
    rows pass through as a sorted stream, one chunk at a time, so no key is held in memory."""
    wanted = [key, CHUNK, t, seq, *[c for c in (side, closes) if c]]
    key_field = chunked.schema[key]
    group_fields = [key_field, T.StructField(CHUNK, T.IntegerType())]

    def condense(batches):
        for table, first in _whole_groups(batches, [key, CHUNK]):
            bounds = np.append(np.flatnonzero(first), len(table))
            columns = _inputs(table, t, seq, side, closes)
            keys, chunks = table.column(key), table.column(CHUNK)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                row = {key: keys[a].as_py(), CHUNK: chunks[a].as_py(),
                       "digest": _digest(*[c[a:b] for c in columns], limits)}
                yield pa.RecordBatch.from_pylist([row], schema=digest_arrow)

    def settle(batches):
        current, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                d = row["digest"]
                if row[key] != current:
                    current = row[key]
                    state = dict.fromkeys(_ENTRY_FIELDS, _BEFORE_ALL) | {"mode": _NONE}
                yield pa.RecordBatch.from_pylist(
                    [{key: row[key], CHUNK: row[CHUNK], "_entry": dict(state)}], schema=entry_arrow)
                left = _leave(state, d, limits)
                if state["mode"] != _NONE and d["first_t"] - state["prev_t"] > limits.idle:
                    state["mark_t"] = d["first_t"]
                state.update({f: left[f] for f in _STATE_FIELDS})
                state["prev_t"] = d["last_t"]
                for f in ("t0", "seq0", "t1", "seq1", "mark_t"):
                    if d[f] is not None:
                        state[f] = d[f]

    from pyspark.sql.pandas.types import to_arrow_schema
    digest_schema = T.StructType([*group_fields, T.StructField("digest", _DIGEST)])
    entry_schema = T.StructType([*group_fields, T.StructField("_entry", _ENTRY_SCHEMA)])
    digest_arrow, entry_arrow = to_arrow_schema(digest_schema), to_arrow_schema(entry_schema)

    digests = (chunked.where(F.col(OPENINGS).isNotNull()).select(*wanted)
               .repartition(key, CHUNK).sortWithinPartitions(key, CHUNK, t, seq)
               .mapInArrow(condense, digest_schema))
    return (digests.repartition(key).sortWithinPartitions(key, CHUNK)
            .mapInArrow(settle, entry_schema))
