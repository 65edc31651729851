"""Cases in which an earlier version gave a wrong answer."""

import math
import statistics
import struct

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from packets import frame, packet
from wirelark.operators import auditlog, evaluate as ev, flows as fl, prep, sampling, training
from wirelark.sources import flowtable, pcap, scratch
from wirelark.streaming import processors as pr
from wirelark.streaming import sinks

NAN = float("nan")


def test_variance_of_large_steady_gaps(spark):
    """Gaps of 3,000,000,000 and 3,000,000,001 microseconds."""
    rows, t = [], 10**12
    for i in range(41):
        rows.append(packet(i, t / 1e6, "10.0.0.1:1", "10.0.0.2:2", "A", 700))
        rows[-1] = rows[-1][:8] + (t,) + rows[-1][9:]
        t += 3 * 10**9 + i % 2
    flow = fl.build_flows(frame(spark, rows), fl.REPLAY).first()
    gaps = [3 * 10**9 + i % 2 for i in range(40)]
    assert math.isclose(flow["Flow IAT Std"], statistics.stdev(gaps), rel_tol=1e-12)
    assert flow["Packet Length Variance"] == 0.0 and flow["Fwd IAT Mean"] == 3 * 10**9 + 0.5


def test_repeats_with_ids_of_their_own(spark):
    rows = [(7, 1.0, "a"), (3, 1.0, "a"), (5, 2.0, "a"), (9, None, "a")]
    df = spark.createDataFrame(rows, "row_id long, `x y` double, Label string")
    got = flowtable.clean(df, keep=("row_id",))
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(3, 1.0, "a"), (5, 2.0, "a")]


def test_row_ids_from_content(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), "a" if i % 3 else None) for i in range(500)], "x double, Label string")
    first = {r.x: r.row_id for r in flowtable.with_row_id(df).collect()}
    assert len(set(first.values())) == 500 and min(first.values()) >= 0
    assert first == {r.x: r.row_id for r in flowtable.with_row_id(df.repartition(7)).collect()}
    monkeypatch.setattr(flowtable.F, "xxhash64", lambda *c: 2 * F.col("_place") if isinstance(c[-1], str) else F.lit(0).cast("long"))
    assert sorted(r.row_id for r in flowtable.with_row_id(df.limit(20)).collect()) == list(range(1, 21))


def test_prepare_without_an_id_column(spark):
    rows = [(float(i % 40), float(i), "DoS" if i % 3 else "BENIGN", "6") for i in range(120)] * 2
    data = training.prepare(spark.createDataFrame(rows, "a double, b double, Label string, Protocol string"))
    assert data.train.count() + data.test.count() == 120 and data.classes == [0, 1]


def test_null_labels_are_no_class(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")] + [(10 + i, "c") for i in range(6)], "id long, Label string")
    assert sorted(r.id for r in flowtable.drop_rare_classes(df).collect()) == [1, *range(10, 16)]


def test_roc_with_one_side(spark):
    scored = spark.createDataFrame([("m", 1, 0.3), ("m", 1, 0.7), ("n", 0, 0.1), ("n", 1, 0.9)], "model string, y int, score double")
    curve = {(r.model, r.threshold): (r.fpr, r.tpr) for r in ev.roc_curve(scored).collect()}
    assert curve["m", 0.7] == (None, 0.5) and curve["n", 0.1] == (1.0, 1.0)
    assert {r.model: r.auc for r in ev.roc_auc(scored).collect()} == {"m": None, "n": 1.0}


def test_macro_roc_leaves_out_an_absent_class(spark):
    rows = [("A", "x", [0.9, 0.1, 0.0]), ("A", "y", [0.2, 0.7, 0.1]), ("A", "x", [0.4, 0.5, 0.1]), ("A", "y", [0.3, 0.6, 0.1])]
    df = spark.createDataFrame(rows, "model string, y_true string, proba array<double>").withColumn("classes", F.array(*map(F.lit, "xyz")))
    two = df.withColumn("classes", F.slice("classes", 1, 2)).withColumn("proba", F.slice("proba", 1, 2))
    show = lambda d: sorted(map(tuple, ev.roc_macro(d).collect()))
    assert show(df) == show(two) and len(show(df)) > 1


def test_broken_lines_keep_their_place(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"epoch": 1, "seq": 1}\n{"epoch": 2, "seq": 2}\n{broken\n\n')
    rows = auditlog.recent(spark, str(tmp_path), "epoch bigint, seq bigint", 2).collect()
    assert [(r.epoch, r.seq, r.raw) for r in rows] == [(2, 2, None), (None, None, "{broken")]
    (tmp_path / "log.jsonl").write_text('{first\n{"epoch": 5, "seq": 1}\n{"epoch": 9, "seq": 2}\n')
    rows = auditlog.recent(spark, str(tmp_path), "epoch bigint, seq bigint", 9).collect()
    assert [r.raw for r in rows] == ["{first", None, None]


def test_constant_column_with_nan(spark):
    df = spark.createDataFrame([(1.0, NAN, 1.0, NAN), (1.0, 2.0, NAN, NAN), (1.0, 2.0, 3.0, None)], "a double, b double, c double, d double")
    assert prep.varying_columns(df, ["a", "b", "c", "d"]) == ["c"]
    model = prep.fit_preprocessor(df, ["a", "b"])
    assert [r.features.size for r in prep.transform(model, df).collect()] == [0, 0, 0]


@pytest.mark.parametrize("seed", range(6))
def test_quartiles_of_filled_columns(spark, seed):
    draw = np.random.default_rng(seed)
    values = draw.integers(0, [3, 50, 10**6][seed % 3], 60).astype(float)
    values[draw.random(60) < [0.0, 0.1, 0.45, 0.9, 0.02, 0.6][seed]] = np.nan
    df = spark.createDataFrame([(None if math.isnan(v) else float(v), NAN if math.isnan(v) else float(v)) for v in values], "x double, y double")
    median = np.nanmedian(values)
    filled = np.where(np.isnan(values), median, values)
    for got in prep.filled_quartiles(df, ["x", "y"]).values():
        assert np.allclose(got, np.percentile(filled, [25, 50, 75]))


def test_samples_take_the_smallest_hashes(spark):
    df = spark.createDataFrame([(i, "ab"[i % 5 == 0] if i % 7 else None) for i in range(1000)], "row_id long, Label string")
    got = {r.row_id for r in sampling.stratified_sample(df, 0.1).collect()}
    want = set()
    rows = df.withColumn("h", sampling.row_hash(F.col("row_id"))).collect()
    for label in ("a", "b", None):
        own = sorted((r.h, r.row_id) for r in rows if r.Label == label)
        want |= {i for _, i in own[:round(0.1 * len(own))]}
    assert got == want
    assert sampling.simple_sample(df, 0.25).count() == 250 and sampling.simple_sample(df, 0.0).count() == 0
    assert sampling.simple_sample(df, 0.999).count() == 999


def test_late_attempts_are_judged_by_what_was_before_them(spark, tmp_path):
    """A row at 9 s that arrives after those at 10 s and 11 s is no flood because of them."""
    at = lambda seq, t, port=80: packet(seq, t, "10.0.0.5:4000", f"10.0.0.6:{port}", "S")
    batches = [[at(0, 100)], [at(2, 110), at(3, 111)], [at(1, 109)], [at(4, 112, 81)], [at(5, 90, 7), at(6, 113)]]
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = pr.with_event_time(pr.read_packets(spark, f"{tmp_path}/in", frame(spark, batches[0]).schema, maxFilesPerTrigger=1))
    sinks.run_to_table(pr.mark_stream(stream, scan_threshold=2, flood_threshold=3), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.seq: (r.is_port_scan, r.is_conn_flood) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got.pop(5, None) is None                                            # behind the watermark
    assert got == {0: (False, False), 2: (False, False), 3: (False, False), 1: (False, False), 4: (True, False), 6: (True, False)}


@pytest.mark.parametrize("seed", range(5))
def test_mark_state_keeps_what_decides(seed):
    """The pruned list answers like the whole one for every row from the watermark on."""
    import random
    draw = random.Random(seed)
    marks = pr.MarkProcessor([], 3, 4, 50, 40)
    held = sorted((draw.randrange(200), i, draw.randrange(5)) for i in range(80))
    pruned = marks._deciding(held, 150)
    assert len([h for h in pruned if h[0] < 150]) <= 3 + 4
    for t in range(150, 260):
        for rows in (held, pruned):
            at = len([h for h in rows if h[0] <= t])
            scan, flood = marks._scans(rows, at, t), at >= 4 and rows[at - 4][0] >= t - 40
            inside = [h for h in held if t - 50 <= h[0] <= t]
            assert scan == (len({h[2] for h in inside}) >= 3)
            assert flood == (len([h for h in held if t - 40 <= h[0] <= t]) >= 4)


def test_throttle_keeps_the_event(spark, tmp_path):
    rows = [("k", 10, 1, "first"), ("k", 11, 2, "second"), ("k", 10**9, 3, "third"), ("end", 10**12, -1, None)]
    for r in rows:
        spark.createDataFrame([r], "alert_key string, ts_us long, seq long, body string").write.mode("append").parquet(f"{tmp_path}/in")
    stream = pr.with_event_time(pr.read_packets(spark, f"{tmp_path}/in", "alert_key string, ts_us long, seq long, body string"))
    sinks.run_to_table(pr.stream_throttle(stream, 1_000_000), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.body: (r.sent, r.suppressed_count) for r in spark.read.parquet(f"{tmp_path}/out").where("seq > 0").collect()}
    assert got == {"first": (True, 0), "second": (False, 1), "third": (True, 1)}


def _capture(path, sizes, cut=0):
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1)
    for i, n in enumerate(sizes):
        data += struct.pack("<IIII", i, 0, n, n) + bytes([i % 250]) * n
    path.write_bytes(data[:len(data) - cut])


def test_damaged_captures_are_reported(spark, tmp_path):
    _capture(tmp_path / "a.pcap", [60] * 50, cut=20)
    with pytest.raises(pcap.Damaged, match="reaches past the end"):
        pcap.read_frames(spark, str(tmp_path))
    assert pcap.read_frames(spark, str(tmp_path), on_damage="skip").count() == 49
    (place,) = pcap.damage(spark, str(tmp_path), 500).collect()
    assert place.damaged == 24 + 49 * 76
    (tmp_path / "b.pcap").write_bytes(b"short")
    with pytest.raises(Exception, match="not a capture file"):
        pcap.read_frames(spark, str(tmp_path)).count()


def test_damage_inside_a_file_costs_one_range(spark, tmp_path):
    _capture(tmp_path / "a.pcap", [60] * 100)
    data = bytearray((tmp_path / "a.pcap").read_bytes())
    at = 24 + 30 * 76
    data[at + 8:at + 16] = struct.pack("<II", 200_000, 200_000)                # a length past the end
    (tmp_path / "a.pcap").write_bytes(bytes(data))
    whole = {r.ts_us for r in pcap.read_frames(spark, str(tmp_path), 800, on_damage="skip").collect()}
    assert {i * 10**6 for i in range(30)} <= whole and {i * 10**6 for i in range(45, 100)} <= whole


def test_paths_for_arrow():
    assert pcap.arrow_uri("file:/x/y") == pcap.arrow_uri("file:///x/y") == "file:///x/y"
    assert pcap.arrow_uri("s3a://b/k") == "s3://b/k" and pcap.arrow_uri("hdfs://n:1/x") == "hdfs://n:1/x"
    with pytest.raises(ValueError):
        pcap.arrow_uri("/no/scheme")


def test_stored_tables_have_an_owner(spark):
    with scratch.temporary(spark):
        stored = scratch.cut_lineage(spark.range(5), "mine")
        path = stored.inputFiles()[0]
        assert stored.count() == 5
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
