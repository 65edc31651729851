"""A decided stream runs its stateful operators once, whatever stages the decision has."""

import re

from test_runs import SMALL, frame, stream_files
from packets import packet
from wirelark.operators import detect, flows as fl, learners, prep
from wirelark.sources.scratch import cut_lineage


def test_marks_and_flows_are_two_operators(spark, tmp_path):
    rows = [packet(i, i, f"10.0.0.{i % 5}:{9 + i}", "10.1.0.1:80", "R" if i % 3 else "S") for i in range(60)]
    flows = cut_lineage(fl.build_flows(frame(spark, rows)), "flows")
    numeric = [c for c in fl.FEATURE_NAMES if c != "Protocol"]
    preprocessor = prep.fit_preprocessor(flows, numeric, ["Protocol"])
    labelled = prep.transform(preprocessor, flows).withColumn("label", (flows["rst"] > 0).cast("double"))
    model = learners.with_preprocessor(preprocessor, learners.fit_learner("dt", labelled, 2, SMALL.but("dt", leaf=1)))
    stream = detect.detect_stream(stream_files(spark, f"{tmp_path}/in", [rows]), model, "dt", ["0", "1"], second=model, second_classes=["Benign", "DoS"])
    assert stream.isStreaming and {"is_attack", "attack_type", "dt_probabilities"} <= set(stream.columns)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"^[\s:+|~!-]*TransformWithState", plan, re.M)) == 2
