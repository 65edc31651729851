import json

import pytest
from pyspark.sql import functions as F

from wirelark.operators import alerts, auditlog, decide

TEN = ["Analysis", "Backdoor", "Benign", "DoS", "Exploits", "Fuzzers", "Generic", "Reconnaissance",
       "Shellcode", "Worms"]


def scores(spark, proba, dt=None, scan=False, flood=False, classes=("0", "1"), dt_classes=TEN):
    return spark.createDataFrame(
        [(list(classes), proba, list(dt_classes), dt, scan, flood)],
        "classes array<string>, proba array<double>, dt_classes array<string>, dt_proba array<double>, "
        "is_port_scan boolean, is_conn_flood boolean")


def weights(**named):
    return [named.get(c, 0.0) for c in TEN]


@pytest.mark.parametrize("proba, dt, scan, flood, want", [
    ([0.1, 0.9], weights(DoS=0.92, Benign=0.08), False, False, (True, "DoS", 0.9, 0.92)),
    ([0.1, 0.9], weights(Fuzzers=0.85, Benign=0.15), False, False, (True, "Fuzzers", 0.9, 0.85)),
    ([0.1, 0.9], weights(Benign=0.6, Exploits=0.35, DoS=0.05), False, False, (True, "Exploits", 0.9, 0.35)),
    ([0.1, 0.9], weights(Benign=1.0), False, False, (True, "Maligno (Indeterminado)", 0.9, 0.0)),
    ([0.1, 0.9], None, False, False, (True, "Maligno (Ataque Detectado)", 0.9, 0.0)),
    ([0.8, 0.2], weights(DoS=1.0), False, False, (False, "Benign", 0.8, 0.0)),
    ([0.85, 0.15], None, True, False, (True, "Reconnaissance", 0.99, 0.99)),
    ([0.85, 0.15], None, False, True, (True, "DoS", 0.99, 0.99)),
    ([0.1, 0.9], weights(Worms=1.0), True, False, (True, "Worms", 0.9, 1.0)),
    ([0.1, 0.9], weights(Worms=1.0), True, True, (True, "DoS", 0.99, 0.99)),
    (None, None, True, False, (False, "Error", 0.0, None)),
    ([float("nan"), 0.5], None, False, False, (False, "Error", 0.0, None)),
])
def test_binary_decision(spark, proba, dt, scan, flood, want):
    r = decide.decide_binary(scores(spark, proba, dt, scan, flood)).first()
    assert (r.is_attack, r.attack_type, r.probability, r.dt_confidence) == want


def test_second_stage_off_or_without_attack_classes(spark):
    r = decide.decide_binary(scores(spark, [0.1, 0.9], weights(DoS=1.0)), second_stage=False).first()
    assert (r.attack_type, r.dt_probabilities) == ("Maligno (Ataque Detectado)", {})
    r = decide.decide_binary(scores(spark, [0.1, 0.9], [1.0], dt_classes=["Benign"])).first()
    assert (r.attack_type, r.dt_confidence) == ("Maligno (Ataque Detectado)", 0.0)


@pytest.mark.parametrize("proba, scan, flood, want", [
    (weights(Exploits=0.95, Benign=0.05), False, False, (True, "Exploits", 0.95)),
    (weights(Exploits=0.4, Benign=0.3, DoS=0.3), False, False, (False, "Benign", 0.4)),
    (weights(Benign=1.0), True, False, (True, "Reconnaissance", 0.99)),
    (weights(Worms=0.9, Benign=0.1), True, False, (True, "Worms", 0.9)),
    (weights(Worms=0.9, Benign=0.1), False, True, (True, "DoS", 0.99)),
])
def test_multiclass_decision(spark, proba, scan, flood, want):
    r = decide.decide_multiclass(scores(spark, proba, None, scan, flood, classes=TEN)).first()
    assert (r.is_attack, r.attack_type, r.probability) == want
    assert r.all_probabilities["Worms"] == proba[-1]


def test_cooldown(spark):
    at = [100.0, 100.5, 101.0, 102.5]
    events = spark.createDataFrame([("k", round(t * 1e6), i) for i, t in enumerate(at)], "alert_key string, ts_us long, seq long")
    got = alerts.throttle(events, 2_000_000).orderBy("seq").collect()
    assert [(r.sent, r.suppressed_count) for r in got] == [(True, 0), (False, 1), (False, 2), (True, 2)]


def alert_row(spark, **changes):
    row = dict(seq=1, ts_us=0, attack_type="DoS", probability=0.985, src_ip="1.2.3.4", src_port=5, dst_ip="5.6.7.8",
               dst_port=80, protocol_name="TCP", duration_sec=1.5, total_packets=10, total_bytes=12345,
               interface="eth0", suppressed_count=5) | changes
    return spark.createDataFrame([tuple(row.values())], ", ".join(
        f"{n} {'double' if isinstance(v, float) else 'string' if isinstance(v, str) else 'long'}" for n, v in row.items()))


def test_alert_texts(spark):
    r = alerts.render(alert_row(spark)).first()
    assert "5 evento(s)" in r.text and "98.50%" in r.html and "12,345 bytes" in r.text
    r = alerts.render(alert_row(spark, suppressed_count=0)).first()
    assert "ANTI-FLOOD" not in r.text and "suprimido" not in r.html
    df = spark.createDataFrame([("a@x, b@y,",)], "t string")
    assert df.select(alerts.recipients(F.col("t"))).first()[0] == ["a@x", "b@y"]


def detection(spark, attack=True):
    return spark.createDataFrame(
        [(attack, "DoS" if attack else "Benign", 0.97, "10.0.0.9", 4444, "10.0.0.1", 80, "TCP", 0.5, 4, 1160, 3, 1,
          1160, 0, 7, 1_500_000, 0, 1160, 0, 1, 0, 1, 3)],
        "is_attack boolean, attack_type string, probability double, src_ip string, src_port int, dst_ip string, "
        "dst_port int, protocol_name string, duration_sec double, total_packets long, total_bytes long, "
        "fwd_packets long, bwd_packets long, fwd_bytes long, bwd_bytes long, start_seq long, last_us long, "
        "len_min long, len_max long, fin long, syn long, rst long, psh long, ack long")


def test_records_in_all_formats(spark):
    recs = auditlog.records(detection(spark), "eth0", "h")
    doc = json.loads(auditlog.json_lines(recs).first().line)
    assert doc["flow_metrics"]["total_packets"] == 4 and doc["packet_stats"]["length_max"] == 1160
    assert doc["mitigation_rule"] == "sudo iptables -A INPUT -s 10.0.0.9 -j DROP"
    assert doc["dt_attack_type"] == "DoS" and doc["dt_confidence"] is None and doc["flow_metrics"]["bytes_per_sec"] == 2320
    assert list(doc)[:3] == ["timestamp", "epoch", "event"]
    assert len(auditlog.csv_rows(recs).columns) == 22
    line = auditlog.text_lines(recs).first().line
    assert line.startswith("[1970-01-01 00:00:01.500] [INTRUSION_DETECTED] Type: DoS (Conf: 97.00%)")
    assert "Bytes: 1,160, Dur: 0.5000s" in line


def test_log_filter_and_defaults(spark):
    benign = detection(spark, attack=False)
    assert auditlog.to_log(benign).count() == 0 and auditlog.to_log(benign, log_all=True).count() == 1
    assert auditlog.to_log(benign, True, enabled=False).count() == 0
    bare = spark.createDataFrame([(True, 0)], "is_attack boolean, last_us long")
    r = auditlog.records(bare).first()
    assert (r.attack_type, r.src_ip, r.protocol, r.interface, r.mitigation_rule) == (
        "Maligno", "0.0.0.0", "TCP/UDP", "unknown", "N/A")


def test_log_format():
    assert [auditlog.log_format(p) for p in ("a.csv", "a.log", "a.txt", "a.jsonl", "a")] == [
        "csv", "text", "text", "jsonl", "jsonl"]
    assert auditlog.log_format("a.csv", " BOTH ") == "both"


def test_write_and_read_back(spark, tmp_path):
    recs = auditlog.records(detection(spark), "eth0", "h")
    auditlog.write(recs, f"{tmp_path}/d.jsonl", "both")
    assert spark.read.option("header", True).csv(f"{tmp_path}/d.csv").first().attack_type == "DoS"
    with open(f"{tmp_path}/d.jsonl/part-broken.txt", "w") as f:
        f.write("not json\n\n")
    got = auditlog.recent(spark, f"{tmp_path}/d.jsonl", "epoch double, attack_type string").collect()
    assert {(r.attack_type, r.raw) for r in got} == {("DoS", None), (None, "not json")}
    with pytest.raises(ValueError):
        auditlog.write(recs, str(tmp_path), "xml")


@pytest.mark.parametrize("chunk_rows", [None, 3])
def test_segments(spark, chunk_rows):
    rows = [("h", i, i, "x" * (i % 7 * 10 + 20)) for i in range(40)]
    lines = spark.createDataFrame(rows, "hostname string, ts_us long, seq long, line string")
    got = auditlog.segments(lines, max_bytes=250, backup_count=2, chunk_rows=chunk_rows).orderBy("age").collect()
    size, cuts = 0, [[]]
    for *_, line in rows:
        if size >= 250:
            size, cuts = 0, cuts + [[]]
        cuts[-1].append(len(line) + 1)
        size += len(line) + 1
    assert [(r.records, r.bytes) for r in got] == [(len(c), sum(c)) for c in cuts[::-1][:3]]
    assert auditlog.segments(lines, max_bytes=250, backup_count=0).count() == 1
