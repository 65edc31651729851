import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelark.llm import queries, whitening


def matrices():
    for seed, n in ((0, 1), (1, 2), (2, 5), (3, 33), (4, 64)):
        draw = np.random.default_rng(seed)
        q, _ = np.linalg.qr(draw.standard_normal((n, n)))
        yield q, draw.random(n) * 10.0 ** draw.integers(-5, 3, n)
        yield q, np.resize([3.0, 1.0, 1.0, 0.0], n)                # equal and vanishing eigenvalues
    yield np.eye(4), np.zeros(4)


def test_eigenvectors():
    for q, values in matrices():
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        got, vectors = whitening.eigen(a)
        size = max(1e-300, np.abs(values).max())
        assert np.abs(got - np.sort(values)[::-1]).max() < 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
        assert np.abs(a @ vectors - vectors * got).max() < 1e-13 * size


def test_polar_factor_is_the_sign():
    for q, values in matrices():
        if np.abs(values).min() > 1e-6 * np.abs(values).max():
            signs = np.where(np.arange(len(values)) % 2, 1.0, -1.0)
            u = whitening.polar((q * (values * signs)) @ q.T)
            assert np.abs(u - (q * signs) @ q.T).max() < 1e-9


def brute(vectors):
    """(n, deviations, whitened up to signs, shares) with numpy's own eigenvectors."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    v = np.cov((distinct - sums / n).T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    return n, ((n * x - sums) ** 2).sum(1), np.abs((x - sums / n) @ u / np.sqrt(e)), e / np.trace(v)


def check(spark, rows, got):
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    n, deviations, white, shares = brute([v for _, v in usable])
    k = len(shares)
    assert len(got) == k * len(usable) and {r.n for r in got} == {n}
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    order = np.argsort([i for i, _ in usable], kind="stable")
    assert [r.deviation for r in got[::k]] == list(deviations[order])
    assert np.abs(np.abs([r.whitened for r in got]).reshape(-1, k) - white[order]).max() < 1e-8
    assert np.abs(np.array([r.explained for r in got[:k]]) / shares - 1).max() < 1e-9
    assert max(r.identity_error for r in got) < 1e-9


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(spark, rows, queries.op13_whitening(spark, sf).collect())


def test_few_dimensions_copies_and_unusable_rows(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(c) for c in draw.standard_normal(5) * 7]) for i in range(60)]
    rows += [(60 + i, rows[0][1]) for i in range(40)] + [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] + [0.0] * 4),
                                                        (103, [float("inf")] + [0.0] * 4), (104, [float("-inf")] + [0.0] * 4), (105, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("x", "n", "component", "whitened")})
    usable = whitening.whole_numbers(df)
    check(spark, rows, whitening.apply(usable, "vec_id", whitening.fit(usable)).collect())


def test_without_spread(spark):
    """A constant direction has no component; one vector, or none, has none at all."""
    def run(rows):
        usable = whitening.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        return whitening.apply(usable, "vec_id", whitening.fit(usable)).collect()
    got = run([(i, [float(i), 1.0, float(i * i)]) for i in range(9)])
    assert {r.component for r in got} == {1, 2} and len(got) == 18
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == [] and run([(1, None)]) == [] and run([]) == []
    with pytest.raises(ValueError):
        run([(1, [1.0]), (2, [1.0, 2.0])])


def test_deviations_are_exact_or_an_error():
    x, sums = np.array([[10 ** 6 + 3, 10 ** 6]]), np.array([10 ** 9, 10 ** 9 + 1], object)
    assert whitening.deviations(x, 1001, sums)[0] == (1001 * (10 ** 6 + 3) - 10 ** 9) ** 2 + (1001 * 10 ** 6 - 10 ** 9 - 1) ** 2
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[10 ** 6]]), 10 ** 10, np.array([0], object))
