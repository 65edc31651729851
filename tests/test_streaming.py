import json
import os
import random

import pytest
from pyspark.sql import functions as F

from brute import runs
from packets import frame, packet
from wirelark.operators import alerts
from wirelark.operators import flows as fl
from wirelark.operators import heuristics
from wirelark.schemas import FEATURE_NAMES, PACKET
from wirelark.streaming import processors as pr
from wirelark.streaming import sinks


def traffic(seed, n=160):
    rng = random.Random(seed)
    rows, t = [], 100.0
    for seq in range(n):
        t += rng.choice([0, 0.001, 0.3, 2.0, 6.0, 11.0])
        client, server = f"10.0.0.{rng.randrange(3)}:4000", "10.1.0.1:80"
        ends = (client, server) if rng.random() < 0.6 else (server, client)
        letters = rng.choice(["S", "A", "PA", "A", "PA", "FA", "RA", "A"])
        rows.append(packet(seq, t, *ends, letters, rng.randrange(0, 900), window=rng.randrange(100)))
    return rows


def stream_files(spark, folder, batches):
    """One file per batch, written in order, then a sentinel far in the future."""
    for i, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        os.utime(folder)
    last = max(r[8] for rows in batches for r in rows)
    end = packet(-1, last / 1e6 + 86400, "end:0", "end:0", proto="17")
    frame(spark, [end]).coalesce(1).write.mode("append").parquet(folder)
    return pr.with_event_time(pr.read_packets(spark, folder, PACKET, maxFilesPerTrigger=1))


def batch_rows(df):
    columns = ["start_us", "start_seq", *FEATURE_NAMES]
    return sorted(tuple(r) for r in df.where("src_ip <> 'end'").select(*[F.col(f"`{c}`") for c in columns]).collect())


@pytest.mark.parametrize("limits", [fl.LIVE, fl.FlowLimits(active=20_000_000, linger=0, idle=1_000_000)])
def test_stream_equals_batch(spark, tmp_path, limits):
    rows = traffic(1)
    shuffled = [rows[i:i + 40] for i in range(0, len(rows), 40)]
    for b in shuffled:
        random.Random(2).shuffle(b)                    # any order inside a micro-batch
    stream = stream_files(spark, f"{tmp_path}/in", shuffled)
    sinks.run_to_table(pr.stream_flows(stream, limits), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert batch_rows(spark.read.parquet(f"{tmp_path}/out")) == batch_rows(fl.build_flows(frame(spark, rows), limits))


def test_rows_late_within_the_delay_are_put_in_order(spark, tmp_path):
    rows = [packet(i, 100 + i, "10.0.0.1:1", "10.0.0.2:2", "A", i) for i in range(8)]
    order = [[rows[0], rows[3]], [rows[1], rows[4]], [rows[2], rows[6]], [rows[5], rows[7]]]
    stream = stream_files(spark, f"{tmp_path}/in", order)
    sinks.run_to_table(pr.stream_flows(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert batch_rows(spark.read.parquet(f"{tmp_path}/out")) == batch_rows(fl.build_flows(frame(spark, rows)))


def test_open_flows_stay_until_the_watermark_passes(spark, tmp_path):
    frame(spark, [packet(0, 100, "10.0.0.1:1", "10.0.0.2:2", "S")]).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = pr.with_event_time(pr.read_packets(spark, f"{tmp_path}/in", PACKET))
    sinks.run_to_table(pr.stream_flows(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.schema("start_us long").parquet(f"{tmp_path}/out").count() == 0


def test_marks_and_flows_in_one_query(spark, tmp_path):
    rows = [packet(i, 100 + i * 0.01, f"10.0.0.5:{4000 + i % 3}", f"10.0.0.6:{i % 9}", "S") for i in range(30)]
    marks = dict(scan_threshold=5, flood_threshold=12)
    stream = stream_files(spark, f"{tmp_path}/in", [rows[:10], rows[10:20], rows[20:]])
    sinks.run_to_table(pr.stream_flows(pr.mark_stream(stream, **marks)), f"{tmp_path}/out", f"{tmp_path}/cp")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert batch_rows(out) == batch_rows(fl.build_flows(frame(spark, rows), marks=marks))
    assert out.where("is_port_scan").count() > 0


def test_marks_match_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [packet(i, 100 + i * 0.1, f"10.0.0.5:{4000 + i}", f"10.0.0.6:{rng.randrange(8)}", "S") for i in range(120)]
    marks = dict(scan_threshold=7, flood_threshold=9, scan_window=1_000_000, flood_window=900_000)
    stream = stream_files(spark, f"{tmp_path}/in", [rows[:50], rows[50:]])
    sinks.run_to_table(pr.mark_stream(stream, **marks), f"{tmp_path}/out", f"{tmp_path}/cp")
    show = lambda df: sorted(map(tuple, df.where("src_ip <> 'end'").select("seq", "is_port_scan", "is_conn_flood").collect()))
    assert show(spark.read.parquet(f"{tmp_path}/out")) == show(heuristics.mark_packets(frame(spark, rows), **marks))


def test_throttle_stream_matches_rule(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((f"k{rng.randrange(3)}", rng.randrange(0, 10**8), i) for i in range(90))
    schema = "alert_key string, ts_us long, seq long"
    by_time = sorted(rows, key=lambda r: r[1])
    for part in (by_time[:45], by_time[45:], [("end", 10**11, -1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = pr.with_event_time(pr.read_packets(spark, f"{tmp_path}/in", schema, maxFilesPerTrigger=1))
    sinks.run_to_table(pr.stream_throttle(stream, 5_000_000), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.alert_key, r.seq): r.sent for r in spark.read.parquet(f"{tmp_path}/out").where("seq >= 0").collect()}
    want = runs([(k, t, s, False) for k, t, s in rows], 5_000_000, 1 << 60, 0)
    assert got == {ks: run == ks[1] for ks, (run, _) in want.items()}
    batch = alerts.throttle(spark.createDataFrame(rows, schema), 5_000_000)
    keep = ["alert_key", "seq", "sent", "suppressed_count"]
    assert sorted(map(tuple, batch.select(*keep).collect())) == sorted(
        map(tuple, spark.read.parquet(f"{tmp_path}/out").where("seq >= 0").select(*keep).collect()))


def test_log_batches_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(True, "DoS", 0.9, 5)], "is_attack boolean, attack_type string, probability double, last_us long")
    write = sinks.log_batches(f"{tmp_path}/log", "both", hostname="h")
    for _ in range(2):                                   # a repeated attempt of the same batch
        write(rows, 0)
    sinks.log_batches(f"{tmp_path}/log", "csv", dry_run=True)(rows, 1)
    lines = spark.read.text(f"{tmp_path}/log/batch-0.jsonl").collect()
    assert [json.loads(r.value)["attack_type"] for r in lines] == ["DoS"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/log/batch-0.csv").count() == 1
    assert sorted(os.listdir(f"{tmp_path}/log")) == ["batch-0.csv", "batch-0.jsonl"]


def test_status_report(spark, tmp_path):
    report = sinks.StatusReport()
    spark.streams.addListener(report)
    try:
        spark.createDataFrame([(True,), (False,), (True,)], "is_attack boolean").write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("is_attack boolean").parquet(f"{tmp_path}/in")
        seen = []
        query = (sinks.with_status(stream).writeStream.foreachBatch(lambda df, i: seen.append(df.count()))
                 .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
        query.awaitTermination()
        import time
        for _ in range(50):
            if report.rows:
                break
            time.sleep(0.1)
        assert (report.rows, report.attacks, sum(seen)) == (3, 2, 3)
    finally:
        spark.streams.removeListener(report)
