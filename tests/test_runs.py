"""Whole runs on the smallest tables: training, evaluation, diagnosis, detection in batch and stream."""

import pytest
from pyspark.sql import functions as F

from packets import packet
from test_learners import SMALL
from test_streaming import stream_files, traffic
from packets import frame
from wirelark.operators import detect, learners, prep, training
from wirelark.operators import flows as fl
from wirelark.sources import tables
from wirelark.sources.scratch import shared_folder
from wirelark.streaming import sinks


@pytest.mark.parametrize("mode", ["binary", "multiclass"])
def test_train_and_evaluate(spark, sf_dir, mode):
    data = training.prepare(tables.flow_table(spark, sf_dir), mode, sample_fraction=0.5)
    assert data.classes == ([0, 1] if mode == "binary" else ["BENIGN", "DoS", "Reconnaissance"])
    total = data.train.count() + data.test.count()
    assert data.train.join(data.test, "row_id").count() == 0 and abs(data.test.count() - 0.2 * total) <= 1
    folder = shared_folder(spark, "test")
    models = training.train(data, folder, mode, ["linearsvc", "dt"], "padrao", cv_splits=2, settings=SMALL)
    assert set(models) == {"linearsvc", "dt", "stacking"}
    report = training.evaluate(models, data, stacked=learners.profile_learners("padrao"))
    assert {r.model for r in report.metrics.collect()} == set(models)
    assert all(0 <= r.auc <= 1 for r in report.auc.collect())
    assert {r.model for r in report.auc.collect()} == (set(models) if mode == "binary" else {"dt", "stacking"})
    assert report.comparison.count() == 4 and set(report.latency) == set(models)
    assert report.svm_weights.count() == len(data.names) and report.stacking_weights
    assert report.confusion.count() == 3 * data.k ** 2
    again = learners.load(folder, "stacking_pipeline", mode)
    assert len(again.stages) == 2
    reused = training.prepare(tables.flow_table(spark, sf_dir), mode, 0.5, preprocessor=learners.load(folder, "scaler", mode))
    assert reused.names == data.names


def test_diagnose(spark, sf_dir):
    data = training.prepare(tables.flow_table(spark, sf_dir), drop_rare=True)
    out = training.diagnose_tree(data, k_best=3, cv_folds=2, depths=(2, 3), settings=SMALL)
    assert out["gap"].count() == 4 and len(out["folds"]) == 2 and out["complexity"]["depth"] <= 3
    assert len(out["validation_curve"]) == 6 and len(out["learning_curve"]) == 15


def test_detection_in_batch_and_stream(spark, tmp_path):
    rows = traffic(3, 80)
    flows = fl.build_flows(frame(spark, rows), marks=detect.DEFAULT_MARKS)
    numeric = [c for c in fl.FEATURE_NAMES if c != "Protocol"]
    preprocessor = prep.fit_preprocessor(flows, numeric, ["Protocol"])
    labelled = prep.transform(preprocessor, flows).withColumn("label", (F.col("rst") > 0).cast("double"))
    tree = learners.fit_learner("dt", labelled, 2, SMALL.but("dt", leaf=1))
    model = learners.with_preprocessor(preprocessor, tree)
    args = dict(second=model, second_classes=["Benign", "DoS"])
    batch = detect.detect(frame(spark, rows), model, "dt", ["0", "1"], **args)
    show = lambda df: sorted(map(tuple, df.where("src_ip <> 'end'").select(
        "flow_key", "start_us", "is_attack", "attack_type", "probability").collect()))
    got = show(batch)
    assert {r[3] for r in got if r[2]} == {"DoS"} and any(not r[2] for r in got)
    stream = detect.detect_stream(stream_files(spark, f"{tmp_path}/in", [rows[:40], rows[40:]]), model, "dt", ["0", "1"], **args)
    kept = stream.select("src_ip", "flow_key", "start_us", "is_attack", "attack_type", "probability")
    sinks.run_to_table(kept, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert show(spark.read.parquet(f"{tmp_path}/out")) == got
    direct = detect.detect(frame(spark, rows), model, "dt", ["Benign", "DoS"], mode="multiclass")
    assert {r.attack_type for r in direct.collect()} == {"DoS", "Benign"}
    with pytest.raises(ValueError):
        detect.detect(frame(spark, rows), model, "dt", ["0", "1"], mode="other")


def test_ignored_traffic_never_reaches_the_flows(spark):
    rows = [packet(0, 1, "10.0.0.2:9", "10.0.0.255:99", proto="17"), packet(1, 1, "10.0.0.2:9", "10.0.0.3:1900", proto="17"),
            packet(2, 1, "10.0.0.2:9", "10.0.0.3:99", proto="1"), packet(3, 1, "10.0.0.2:9", "10.0.0.3:99", "S")]
    assert [r.seq for r in detect.relevant(frame(spark, rows)).collect()] == [3]
    assert detect.relevant(frame(spark, rows), ignore_broadcast=False, ignore_ports=()).count() == 3
