from pyspark.sql import functions as F

from wirelark.operators import learners


def test_the_points_of_a_bounded_curve_grow(spark, monkeypatch):
    """Each point is fitted on its own fraction of fit_rows, also where 0.2 of the table is more."""
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("double").alias("label"))
    seen = {}

    def scores(train, held, classes, name, settings):
        n = learners.bounded_sample(train, settings.fit_rows, "label", "row_id", settings.seed).count()
        return [float(n), 0.0]
    monkeypatch.setattr(learners, "_scores", scores)
    for fraction, fold, n, _ in learners.learning_curve(df, 2, (0.2, 0.6, 1.0), 2, learners.Settings(fit_rows=100)):
        seen.setdefault(fold, []).append((fraction, n))
    for points in seen.values():
        assert [abs(n - 100 * f) <= 5 for f, n in sorted(points)] == [True] * 3
