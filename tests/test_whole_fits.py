"""Queries whose fits read every row, also where there are more than a bounded fit would read."""

from wirelark.plans import model_queries as mq


def test_the_tree_of_the_complexity_reads_all_rows(spark, sf_dir):
    rows, _ = mq.training_rows(spark, sf_dir)
    r = mq.tree_complexity_figures(spark, sf_dir).first()
    assert round(r.leaves * r.rows_per_leaf) == rows.count() > mq.FIT_ROWS


def test_the_models_of_latency_and_f1_read_all_rows(spark, sf_dir, monkeypatch):
    read, fit = [], mq.learners.fit_learners

    def fit_and_note(*args):
        models = fit(*args)
        read.extend(m.stages[0].getOrDefault("fitRows") for m in models)
        return models
    monkeypatch.setattr(mq.learners, "fit_learners", fit_and_note)
    assert [(r.timed, r.scored, r.learned) for r in mq.latency_f1(spark, sf_dir).collect()] == [(True, True, True)] * 3
    assert read == [mq.training_rows(spark, sf_dir)[0].count()] * 3
