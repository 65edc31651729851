import random

import pytest
from pyspark.sql import functions as F

from brute import scans
from packets import frame, packet
from wirelark.functions import net
from wirelark.operators import flows as fl
from wirelark.operators import heuristics
from wirelark.schemas import FEATURE_NAMES

CLIENT, SERVER = "192.168.1.50:50000", "10.0.0.1:80"


def handshake(spark):
    return frame(spark, [
        packet(0, 1000.00, CLIENT, SERVER, "S", window=65535),
        packet(1, 1000.01, SERVER, CLIENT, "SA", window=32768),
        packet(2, 1000.02, CLIENT, SERVER, "A", window=65535),
        packet(3, 1000.05, CLIENT, SERVER, "PA", 18, window=65535),
        packet(4, 1000.10, CLIENT, SERVER, "FA", window=65535)])


def test_handshake_is_one_flow(spark):
    (f,) = fl.build_flows(handshake(spark)).collect()
    assert (f.fwd_packets, f.bwd_packets, f.fin) == (4, 1, 1)
    assert (f["FWD Init Win Bytes"], f["Bwd Init Win Bytes"], f["Protocol"]) == (65535, 32768, "6")
    assert (f["Flow Duration"], f.duration_sec, f.src_ip, f.dst_port) == (100000, 0.1, "192.168.1.50", 80)
    assert f["Flow IAT Max"] == 50000 and f["Fwd IAT Total"] == 100000 and f["Bwd IAT Total"] == 0
    assert f["Active Max"] == 100000 and f["Idle Max"] == 0


def test_feature_schema(spark):
    features = fl.features(fl.build_flows(handshake(spark)))
    assert features.columns == FEATURE_NAMES and len(FEATURE_NAMES) == 70
    assert dict(features.dtypes)["Protocol"] == "string"
    assert {t for c, t in features.dtypes if c != "Protocol"} == {"double"}


def test_reversed_traffic_swaps_directions(spark):
    """Starting from the other side, forward and backward statistics change places."""
    rows = [packet(i, 1 + i * 0.3, *((CLIENT, SERVER) if i % 2 else (SERVER, CLIENT)), "A", 10 * i) for i in range(9)]
    flipped = [(*r[:1], r[3], r[4], r[1], r[2], *r[5:]) for r in rows]
    (a,), (b,) = (fl.build_flows(frame(spark, x)).collect() for x in (rows, flipped))
    for name in FEATURE_NAMES:
        if name not in ("Src Port", "Dst Port"):
            assert a[name] == b[name]
    assert (a.src_ip, a.dst_ip) == (b.dst_ip, b.src_ip)


def test_inactivity(spark):
    one = fl.build_flows(frame(spark, [packet(0, 10.0, CLIENT, SERVER, "S")]))
    limits = fl.FlowLimits(inactivity=5_000_000)
    assert fl.flush_expired(one, 12_000_000, limits).count() == 0
    assert fl.flush_expired(one, 16_000_000, limits).count() == 1
    assert fl.flush_expired(one, 12_000_000, limits, force=True).count() == 1


def test_single_udp_packet_has_no_rates(spark):
    (f,) = fl.build_flows(frame(spark, [packet(0, 5, "10.0.0.9:5000", "8.8.8.8:53", payload=64, proto="17")])).collect()
    assert [f[n] for n in ("Flow Duration", "Flow Bytes/s", "Flow Packets/s", "Fwd Packets/s", "Bwd Packets/s")] == [0] * 5
    assert (f["Protocol"], f["Fwd Seg Size Min"], f.protocol_name) == ("17", 8, "UDP")


def test_single_tcp_packet_keeps_rates(spark):
    (syn,) = fl.build_flows(frame(spark, [packet(0, 5, CLIENT, SERVER, "S")])).collect()
    assert (syn["Flow Duration"], syn["Flow Packets/s"], syn["Flow Bytes/s"]) == (1, 10000, 0)
    (data,) = fl.build_flows(frame(spark, [packet(0, 5, CLIENT, SERVER, "PA", 7)])).collect()
    assert data["Flow Bytes/s"] == 7 / 1e-4


def test_two_packets_at_one_instant(spark):
    (f,) = fl.build_flows(frame(spark, [packet(i, 5, CLIENT, SERVER, "A", 3) for i in range(2)])).collect()
    assert (f["Flow Duration"], f["Flow Packets/s"]) == (1, 2e6)


def test_headers_without_a_length(spark):
    rows = [packet(0, 1, CLIENT, SERVER, "A", header=0), packet(1, 2, CLIENT, SERVER, "A", header=32)]
    (f,) = fl.build_flows(frame(spark, rows)).collect()
    assert f["Fwd Seg Size Min"] == 20
    (f,) = fl.build_flows(frame(spark, rows[::-1][:1] + [packet(2, 3, CLIENT, SERVER, "A", header=28)])).collect()
    assert f["Fwd Seg Size Min"] == 28


def test_active_and_idle_periods(spark):
    at = [0, 1, 2, 8, 9, 20, 30.5]
    (f,) = fl.build_flows(frame(spark, [packet(i, t, CLIENT, SERVER, "A") for i, t in enumerate(at)]),
                          fl.REPLAY).collect()
    assert (f["Active Mean"], f["Active Max"], f["Active Min"]) == (1.5e6, 2e6, 1e6)
    assert (f["Idle Mean"], f["Idle Max"], f["Idle Min"]) == (pytest.approx(27.5e6 / 3), 11e6, 6e6)


def test_reset_is_evaluated_once(spark):
    rows = [packet(0, 1, CLIENT, SERVER, "S"), packet(1, 1.001, SERVER, CLIENT, "RA"),
            packet(2, 1.5, CLIENT, SERVER, "A"), packet(3, 2.5, CLIENT, SERVER, "S")]
    flows = fl.build_flows(frame(spark, rows)).orderBy("start_us").collect()
    assert [(f.total_packets, f.rst) for f in flows] == [(2, 1), (1, 0)]
    assert fl.build_flows(frame(spark, rows), fl.REPLAY).count() == 1


def scan_rows(ports, sources, letters="S"):
    return [packet(i, 100 + i * 0.01, f"10.0.0.5:{s}", f"10.0.0.6:{p}", letters)
            for i, (s, p) in enumerate(zip(sources, ports))]


def marks(spark, rows, **thresholds):
    marked = heuristics.mark_packets(frame(spark, rows), **thresholds)
    return [(r.is_port_scan, r.is_conn_flood) for r in marked.orderBy("seq").collect()]


def test_port_scan(spark):
    got = marks(spark, scan_rows(range(1, 7), [4000] * 6), scan_threshold=5, flood_threshold=6)
    assert got == [(False, False)] * 4 + [(True, False)] * 2


def test_connection_flood(spark):
    got = marks(spark, scan_rows([80] * 6, range(4000, 4006)), scan_threshold=10, flood_threshold=5)
    assert got == [(False, False)] * 4 + [(False, True)] * 2


def test_replies_are_no_attempts(spark):
    got = marks(spark, scan_rows([80] * 6, range(50001, 50007), "SA"), scan_threshold=2, flood_threshold=2)
    assert got == [(False, False)] * 6


@pytest.mark.parametrize("chunk_rows", [None, 6])
@pytest.mark.parametrize("windows", [(50, 50), (30, 80), (90, 20)])
def test_window_counts_match_brute_force(spark, windows, chunk_rows):
    rng = random.Random(sum(windows))
    rows = [("a" if rng.random() < 0.7 else "b", rng.randrange(0, 900, 3), seq, rng.randrange(6)) for seq in range(150)]
    df = spark.createDataFrame(rows, "src_ip string, ts_us long, seq long, dst_port int").withColumn("dst_ip", F.lit("x"))
    got = heuristics.window_counts(df, *windows, chunk_rows=chunk_rows).collect()
    ports, attempts = scans(rows, windows[0]), scans(rows, windows[1])
    assert {r.seq: (r.scan_ports, r.flood_attempts) for r in got} == {s: (ports[s][0], attempts[s][1]) for s in ports}


def test_filters(spark):
    rows = [packet(0, 1, "10.0.0.2:9", "239.255.255.250:1900", proto="17"),
            packet(1, 1, "10.0.0.2:9", "224.0.0.251:5353", proto="17"),
            packet(2, 1, "10.0.0.2:9", "10.0.0.255:99", proto="17"),
            packet(3, 1, "10.0.0.2:9", "255.255.255.255:99", proto="17"),
            packet(4, 1, "10.0.0.2:9", "10.0.0.3:99", proto="17"),
            packet(5, 1, "10.0.0.2:68", "10.0.0.3:99", proto="17")]
    kept = net.without_ports(net.unicast_only(frame(spark, rows)))
    assert [r.seq for r in kept.collect()] == [4]
    df = spark.createDataFrame([("",), ("x.1",), ("223.1.1.1",), ("240.0.0.1",), ("224.0.0.1",), ("1.2.255",)], "ip string")
    assert [r[0] for r in df.select(net.is_broadcast_or_multicast(F.col("ip"))).collect()] == [
        False, False, False, False, True, True]
    assert net.parse_ports("53, x,67,,-1") == [53, 67]
    ports = spark.createDataFrame([("53, x,67",)], "t string").select(net.parse_ports_column(F.col("t"))).first()[0]
    assert ports == [53, 67]


def test_no_cartesian_product_and_one_packet_shuffle(spark, sf_dir):
    from wirelark.plans import flow_queries as fq
    plan = fq.live_flows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 2     # packets by (key, chunk), partial sums by flow
    assert "PushedFilters" in plan and "HashAggregate" in plan and "SortAggregate" not in plan
