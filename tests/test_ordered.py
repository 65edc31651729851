import random

import pytest
from pyspark.sql import functions as F

from brute import runs
from wirelark.operators import cuts, ordered


def _rows(seed, keys=6, n=400):
    rng = random.Random(seed)
    rows, clock = [], {k: 0 for k in range(keys)}
    for seq in range(n):
        k = 0 if rng.random() < 0.5 else rng.randrange(keys)
        clock[k] += rng.choice([0, 1, 2, 3, 5, 9, 20])
        rows.append((f"k{k}", clock[k], seq, rng.random() < 0.12, rng.randrange(2)))
    return rows


LIMITS = [(30, 8, 3), (12, 100, 0), (cuts.NEVER, 9, 4), (25, cuts.NEVER, 6),
          (cuts.NEVER, cuts.NEVER, cuts.NEVER), (10, 10, 15)]


@pytest.mark.parametrize("chunk_rows", [None, 5, 20])
@pytest.mark.parametrize("limits", LIMITS)
def test_greedy_cuts_match_sequential_rule(spark, limits, chunk_rows):
    active, inactivity, linger = limits
    rows = _rows(hash(limits) % 1000)
    df = spark.createDataFrame(rows, "key string, t long, seq long, closes boolean, side int")
    got = cuts.greedy_cuts(df, "key", "t", "seq", active=active, inactivity=inactivity,
                           linger=linger, idle=4, closes="closes", side="side",
                           chunk_rows=chunk_rows).collect()
    want = runs([r[:4] for r in rows], active, inactivity, linger)
    assert {(r.key, r.seq): (r.run_seq, r.absorbed) for r in got} == want
    by_key = {}
    for r in sorted(got, key=lambda r: (r.key, r.t, r.seq)):
        before = by_key.setdefault(r.key, [])
        same = [b for b in before if b.side == r.side]
        assert r.prev_t == (before[-1].t if before else None)
        assert (r.side_prev_t, r.side_prev_seq) == ((same[-1].t, same[-1].seq) if same else (None, None))
        marks = [b.t for a, b in zip(before + [r], (before + [r])[1:]) if b.t - a.t > 4]
        assert r.mark_t == (marks[-1] if marks else None)
        if r.run_seq is not None:
            start = next(b for b in before + [r] if b.seq == r.run_seq)
            assert (r.run_t, r.run_side) == (start.t, start.side)
            assert r.run_pos == sum(b.run_seq == r.run_seq for b in before)
        assert r.prev_run_pos == (before[-1].run_pos if before and not before[-1].closes else None)
        before.append(r)


@pytest.mark.parametrize("chunk_rows", [None, 5])
def test_running_sums_and_neighbours(spark, chunk_rows):
    rows = [(r[0], r[1], r[2], r[4]) for r in _rows(3)]
    df = spark.createDataFrame(rows, "key string, t long, seq long, v int")
    out = ordered.running_sums(df, ["key"], ["t", "seq"], {"s": F.col("v"), "n": F.lit(1)}, chunk_rows)
    out = ordered.neighbours(out, ["key"], ["t", "seq"], "seq", "before", "after", chunk_rows)
    groups = {}
    for r in sorted(out.collect(), key=lambda r: (r.key, r.t, r.seq)):
        groups.setdefault(r.key, []).append(r)
    for g in groups.values():
        total = 0
        for i, r in enumerate(g):
            total += r.v
            assert (r.s, r.n) == (total, i + 1)
            assert r.before == (g[i - 1].seq if i else None)
            assert r.after == (g[i + 1].seq if i + 1 < len(g) else None)
