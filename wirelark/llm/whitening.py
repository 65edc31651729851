"""Whitening of embeddings by spectral divide and conquer on their covariance.

The covariance of the distinct vectors is summed where the rows are, around their mean; only a matrix of the
vectors' width leaves the tasks. Its eigenvectors come from polar decompositions: the unitary factor of the
shifted matrix is its matrix sign, (sign + 1) / 2 projects on the eigenvectors above the shift, and an
orthonormal basis of that space and of its complement splits the matrix in two smaller ones. The polar factor
comes from the QR-based, dynamically weighted Halley iteration (QDWH). Mean and whitening matrix then go to
all rows in a broadcast, whose size is set by the width alone.

Vectors are taken in whole numbers, x = floor(64 * c) + 1000000, so that sums and deviations are exact. Rows
whose vector is null or empty, or holds null, NaN or infinite entries, are left out; so are directions without spread
(fewer components come back, none for an empty table or a single vector). Vectors of several widths, and sums
that a long cannot hold, are errors. Repeated rows each get their result. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wirelark.llm.shared import Scratch

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
NO_SPREAD = 1e-13                  # of the largest eigenvalue: below, a direction counts as constant
WIDEST = 4096                      # a covariance of this width is 128 MB on the driver
_EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary factor of the polar decomposition of a symmetric matrix, by QDWH."""
    n = len(a)
    largest = np.linalg.norm(a, "fro")
    if largest == 0:
        return np.eye(n)
    x, low = a / largest, np.finfo(float).eps             # all singular values lie in [low, 1], but for noise
    for _ in range(30):
        d = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * np.sqrt(1 + d))))
        q = (p - 1) ** 2 / 4
        c = p + q - 1
        top, r = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        after = q / c * x + (p - q / c) / np.sqrt(c) * top[:n] @ top[n:].T
        low = min(1.0, low * (p + q * low ** 2) / (1 + c * low ** 2))
        moved, x = np.linalg.norm(after - x, "fro"), after
        if moved < 5 * np.cbrt(_EPS) and abs(1 - low) < 10 * _EPS:
            break
    return (x + x.T) / 2


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces that make up the whole, if a shift between them is found."""
    n, spread = len(a), np.diag(a)
    for shift in (np.median(spread), spread.mean(), *np.quantile(spread, (0.25, 0.75, 0.1, 0.9)), (spread.min() + spread.max()) / 2):
        sign = polar(a - shift * np.eye(n))
        projector = (sign + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        # columns of a projector of rank k: those of largest norm, then all others, span space and complement
        order = np.argsort(-np.linalg.norm(projector, axis=0))
        basis, _ = np.linalg.qr(projector[:, order] @ _mixer(n))
        for _ in range(2):                                 # subspace iteration, which the projector ends at once
            basis, _ = np.linalg.qr(np.hstack([projector @ basis[:, :k], (np.eye(n) - projector) @ basis[:, k:]]))
        first, second = basis[:, :k], basis[:, k:]
        if np.linalg.norm(second.T @ a @ first) <= 1e3 * n * _EPS * np.linalg.norm(a):
            return first, second
    return None


def _mixer(n: int) -> np.ndarray:
    """A fixed dense square matrix, so that no column of a projector is left out of its range by chance."""
    return np.random.default_rng(n).standard_normal((n, n))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors as columns) of a symmetric matrix."""
    n, whole = len(a), np.linalg.norm(a)
    vectors, blocks = np.eye(n), [(np.eye(n), a)]
    found = []
    while blocks:
        basis, part = blocks.pop()
        part = (part + part.T) / 2
        off = part - np.diag(np.diag(part))
        if len(part) == 1 or np.linalg.norm(off) <= _EPS * whole:
            found.append(basis)
        elif (halves := _halves(part)) is not None:
            blocks += [(basis @ h, h.T @ part @ h) for h in halves]
        elif len(part) == 2:
            found.append(basis @ _rotation(part))
        else:                                              # eigenvalues too close to part: split by plane rotations
            found.append(basis @ _jacobi(part))
    vectors = np.hstack(found) if found else vectors
    vectors, r = np.linalg.qr(vectors)
    vectors = vectors @ _jacobi(vectors.T @ a @ vectors, sweeps=2)      # takes out what rounding has left between blocks
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _rotation(a: np.ndarray) -> np.ndarray:
    angle = 0.5 * np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1])
    return np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])


def _jacobi(a: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """Plane rotations that make a nearly diagonal matrix diagonal."""
    n, v, a = len(a), np.eye(len(a)), (a + a.T) / 2
    for _ in range(sweeps):
        off = np.abs(np.triu(a, 1))
        if off.max(initial=0.0) <= _EPS * np.linalg.norm(a):
            break
        for i, j in zip(*np.nonzero(off > _EPS * np.linalg.norm(a) / n)):
            turn = _rotation(a[np.ix_([i, j], [i, j])])
            a[:, [i, j]] = a[:, [i, j]] @ turn
            a[[i, j], :] = turn.T @ a[[i, j], :]
            v[:, [i, j]] = v[:, [i, j]] @ turn
    return v


@dataclass(frozen=True)
class Whitening:
    """What `apply` needs: n distinct vectors, their sums, and for each component its direction (a column of
    `vectors`), eigenvalue and share of the trace; `identity_error` is measured on the distinct vectors."""
    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    identity_error: float = 0.0

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def whole_numbers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds `x`, the vector less SHIFT in whole numbers; rows without a usable vector go."""
    c = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(usable).withColumn("x", F.transform(c, lambda v: F.floor(v * SCALE)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _second_moments(distinct: DataFrame, width: int, of) -> np.ndarray:
    """The sum over all distinct vectors of f f', where f = of(x)."""
    def run(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                f = of(_matrix(batch.column("x"), width))
                total = total + f.T @ f
        if not np.isscalar(total):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])
    entries = distinct.select("x").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = 1 + max(e.i for e in entries)
    out = np.zeros((size, size))
    for e in entries:
        out[e.i, e.j] = out[e.j, e.i] = e.v
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct `x` of whole_numbers(); None if there is no row."""
    scratch = Scratch(rows.sparkSession, "whitening")
    distinct = scratch.table("distinct", rows.select("x").distinct())
    seen = distinct.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if not seen.n or not seen.most:
        return None
    if seen.least != seen.most or seen.most > WIDEST:
        raise ValueError(f"vectors of one width up to {WIDEST} are needed, found {seen.least} to {seen.most}")
    n, width = seen.n, seen.most
    sums = np.zeros(width, object)
    for r in distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect():
        sums[r.i] = int(r.s)
    mean = np.array([s / n for s in sums], float)
    covariance = _second_moments(distinct, width, lambda x: x - mean) / n
    values, vectors = eigen(covariance)
    total = float(np.trace(covariance))
    keep = [i for i in range(min(components, width)) if values[i] > NO_SPREAD * max(values[0], 0.0) and values[i] > 0]
    found = Whitening(n, sums, vectors[:, keep], values[keep], values[keep] / total if keep else values[keep])
    if keep:
        matrix = found.matrix
        again = _second_moments(distinct, width, lambda x: (x - mean) @ matrix) / n
        found = Whitening(n, sums, found.vectors, found.values, found.shares, float(np.abs(again - np.eye(len(keep))).max()))
    scratch.drop("distinct")
    return found


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The sum over the dimensions of (n * x - S) ** 2, exactly."""
    away = np.abs(x.astype(float) * n - sums.astype(float))
    if (away ** 2).sum(1).max(initial=0.0) >= 2.0 ** 63 or np.abs(x).max(initial=0) * float(n) >= 2.0 ** 62:
        raise OverflowError("deviations of these vectors do not fit a long")
    gap = x * n - sums.astype(np.int64)
    return (gap * gap).sum(1)


def apply(rows: DataFrame, vec_id: str, whitening: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    kind = rows.schema[vec_id].dataType.simpleString()
    schema = f"`{vec_id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if whitening is None or not len(whitening.values):
        return rows.sparkSession.createDataFrame([], schema)
    w = whitening
    mean = np.array([s / w.n for s in w.sums], float)
    shared = rows.sparkSession.sparkContext.broadcast((w.n, w.sums, mean, w.matrix, w.shares, w.identity_error))

    def run(batches):
        n, sums, mean, matrix, shares, error = shared.value
        k = len(shares)
        for batch in batches:
            m = batch.num_rows
            if m:
                x = _matrix(batch.column("x"), len(mean))
                white = (x - mean) @ matrix
                yield pa.RecordBatch.from_arrays(
                    [batch.column(vec_id).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n)), pa.array(np.repeat(deviations(x, n, sums), k)), pa.array(white.ravel()),
                     pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))],
                    [vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.select(vec_id, "x").mapInArrow(run, schema)
