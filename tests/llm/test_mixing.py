import random

from pyspark.sql import functions as F

from tests.llm import brute
from wirelark.llm import mixing



def levels():
    return [mixing.Level("lang", F.col("lang"), F.when(F.col("lang") == "en", 3).otherwise(1)),
            mixing.Level("source", F.col("source"), F.length(F.coalesce("source", F.lit("x"))))]


WEIGHTS = [lambda v: 3 if v == "en" else 1, lambda v: len(v) if v is not None else 1]


def test_against_brute_force(spark):
    draw, rows = random.Random(4), []
    for i in range(300):
        lang = draw.choice(["en", "en", "en", "fr", None])
        rows.append((i, "w " * draw.randrange(0, 30), lang, draw.choice(["a", "bb", "ccc"] if lang == "en" else ["a", None])))
    rows += [(5, rows[5][1], rows[5][2], rows[5][3]), (None, "no id", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for share, epochs in ((0.5, 1), (1.0, 2), (1.7, 3), (9.0, 2), (0.0, 2)):
        got = sorted(((r.doc_id, r.epoch) for r in mixing.mix(docs, levels(), share, epochs, 11).collect()), key=str)
        assert got == sorted(brute.mixture(rows, 2, WEIGHTS, share, epochs, 11), key=str)


def test_siblings_come_before_ancestors(spark):
    """en/a runs short: en/b gets the rest as long as it lasts, and only then fr."""
    rows = [(1, "w " * 10, "en", "a")] + [(10 + i, "w " * 10, "en", "b") for i in range(10)] + [(50 + i, "w " * 10, "fr", "a") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    two = [mixing.Level("lang", F.col("lang"), F.lit(1)), mixing.Level("source", F.col("source"), F.lit(1))]

    def tokens(share):
        return {(r.lang, r.source): r.n for r in mixing.mix(docs, two, share, 1, 1).groupBy("lang", "source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert tokens(80 / 210) == {("en", "a"): 10, ("en", "b"): 30, ("fr", "a"): 40}
    assert tokens(1.0) == {("en", "a"): 10, ("en", "b"): 100, ("fr", "a"): 100}


def test_plan_has_no_python(spark, odd):
    plan = mixing.mix(odd, levels())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(odd, empty):
    rows = mixing.mix(odd, levels(), 2.0, 2, 1).collect()
    assert {r.epoch for r in rows} == {0, 1} and {r.score for r in rows} == {"mine"}
    assert [r.doc_id for r in rows].count(5) == 4
    assert mixing.mix(empty, levels()).count() == 0
