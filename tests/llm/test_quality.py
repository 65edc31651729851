import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wirelark.llm import quality


def test_counts_against_brute_force(spark):
    draw, texts = random.Random(2), ["", None, "a", "a b c a b c", "x\nx\n \n \nx", "x " * 400, "a\x0bb\x0cc\r\nd", "é#*$%&|<>é"]
    for _ in range(120):
        texts.append("".join(draw.choice(["a ", "b ", "c\t", "\n", "a b c ", "long# ", "é|", " "]) for _ in range(draw.randrange(90))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.counts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality_counts(texts[r.doc_id]), texts[r.doc_id]


def test_estimates_ignore_outliers(spark):
    """A fifth of far rows: centre and covariance are those of the rest, as numpy's steps find them."""
    draw = np.random.default_rng(3)
    good = draw.multivariate_normal([500] * 5, np.diag([400.0**2] * 5) + 300.0**2, 800)
    rows = np.round(np.concatenate([good, draw.normal(9000, 50, (200, 5))])).astype(int)
    df = spark.createDataFrame([("g", *map(int, r)) for r in rows], "grp string, x0 long, x1 long, x2 long, x3 long, x4 long")
    model = quality.estimates(df, ["grp"]).first().asDict()

    def factor(part):
        cov = np.cov(part.T, bias=True) * quality.CONSISTENCY
        return part.mean(0), np.linalg.cholesky(cov + np.diag(np.square(quality.FLOORS, dtype=float)))
    centre = np.median(rows, 0)
    low = np.diag(np.sqrt((1.4826 * np.median(np.round(np.abs(rows - centre)), 0)) ** 2 + np.square(quality.FLOORS, dtype=float)))
    for _ in range(quality.STEPS):
        far = np.minimum(np.round(np.square(np.linalg.solve(low, (rows - centre).T)).sum(0) * 100 + 1e-9), 1e6)
        centre, low = factor(rows[far <= np.percentile(far, 75)])
    assert np.allclose([model[f"m{i}"] for i in range(5)], centre)
    assert np.allclose([[model[f"l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)], low)


def test_outliers_are_rejected_and_the_rest_kept(spark):
    draw = random.Random(1)
    words = [f"word{i}" for i in range(900)]
    rows = [(i, " ".join(draw.choices(words, k=draw.randrange(60, 400))), "en", "s") for i in range(150)]
    rows += [(1000 + i, " ".join(w + "###" for w in draw.choices(words, k=200)), "en", "s") for i in range(8)]
    rows += [(2000 + i, " ".join(draw.choices(words, k=100)), "en", "tiny") for i in range(3)] + [(3000, "same three words " * 50, "en", "s")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(150)) and not any(got[1000 + i].kept for i in range(8))
    assert all(got[2000 + i].kept and got[2000 + i].distance is None for i in range(3))
    assert got[3000].base_failed and not got[3000].kept


def test_plan_has_no_python(odd):
    plan = quality.judge(odd)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))


def test_odd_rows(odd, empty):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count() and next(r for r in rows if r.doc_id == 6).n_repeat_words == 100_000
    assert not any(r.kept for r in rows)
    assert quality.judge(empty).count() == 0
