"""Throttle, segments and totals from batch to batch, against the batch operators over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from wirelark.operators import alerts, auditlog
from wirelark.streaming import sinks, watch

COOLDOWN = 50


def flows(spark, n=120, seed=1):
    """Decided flows as they leave a stream, in order of `ts_us`."""
    draw, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += draw.choice([0, 3, 10, 40])
        attack = draw.random() < 0.8
        rows.append((i, t, t, f"10.0.0.{draw.randint(1, 3)}", "DoS" if attack else "Benign", attack, 0.9, i * 7, "x" * draw.randint(0, 30)))
    df = spark.createDataFrame(rows, "seq long, ts_us long, last_us long, src_ip string, attack_type string, is_attack boolean, probability double, start_seq long, dst_ip string")
    df = df.withColumns({"src_port": F.lit(1), "dst_port": F.lit(2), "protocol_name": F.lit("TCP"), "duration_sec": F.lit(0.5), "total_packets": F.lit(3).cast("long"),
                         "total_bytes": F.lit(100).cast("long"), "seq": F.col("start_seq"), "alert_key": alerts.throttle_key(F.col("src_ip"), F.col("attack_type"))})
    return df.cache()


def parts(df, borders):
    for lo, hi in zip([-1, *borders], [*borders, 10**9]):
        yield df.where((F.col("ts_us") > lo) & (F.col("ts_us") <= hi))


@pytest.mark.parametrize("borders", [[], [200], [10, 11, 400, 900, 5000]])
def test_throttle_goes_on(spark, borders):
    events = flows(spark).where("is_attack")
    want = sorted(map(tuple, alerts.throttle(events, COOLDOWN).select("seq", "sent", "suppressed_count").collect()))
    state, got = spark.createDataFrame([], watch.STATES["cooldowns"]), []
    for part in parts(events, borders):
        out, after = watch.throttle_on(part, state, COOLDOWN)
        got += map(tuple, out.select("seq", "sent", "suppressed_count").collect())
        state = spark.createDataFrame(after.collect(), watch.STATES["cooldowns"])
    assert sorted(got) == want and any(n > 1 for _, _, n in want)


@pytest.mark.parametrize("backup", [0, 2])
def test_segments_go_on(spark, backup):
    lines = flows(spark).select(F.lit("h").alias("hostname"), "ts_us", "seq", F.concat("src_ip", "dst_ip").alias("line"))
    want = {(r.start_offset, r.records, r.bytes, r.first_us, r.last_us) for r in auditlog.segments(lines, 300, backup).collect()}
    state, names = spark.createDataFrame([], watch.STATES["segments"]), set()
    for part in parts(lines, [10, 300, 301, 1200]):
        placed, after = watch.segments_on(part, state, 300, backup)
        names |= {r.segment for r in placed.collect()}
        state = spark.createDataFrame(after.collect(), watch.STATES["segments"])
    assert {(r.start_offset, r.records, r.bytes, r.first_us, r.last_us) for r in state.collect()} == want
    assert names >= {w[0] for w in want} and len(want) == backup + 1


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    df = flows(spark)
    to = watch.Outputs(str(tmp_path), COOLDOWN, max_bytes=2000, backup_count=2, style=alerts.AlertStyle(hostname="h"))
    write = watch.fan_out(to)

    def seen():
        sent = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/alerts")
        logs = spark.read.option("recursiveFileLookup", True).text(f"{tmp_path}/log")
        return (sorted((r.seq, r.suppressed_count) for r in sent.collect()), sorted(r.value for r in logs.collect()),
                *[sorted(map(str, watch.state(spark, str(tmp_path), n).collect())) for n in watch.STATES])
    for n, part in enumerate(parts(df, [300, 800])):
        write(part, n)
        before = seen()
        write(part, n)
        assert seen() == before
    events = df.where("is_attack")
    want = alerts.throttle(events, COOLDOWN).where("sent")
    sent, lines, _, segments, totals = seen()
    assert sent == sorted((r.seq, r.suppressed_count) for r in want.collect())
    assert sum(r.records for r in watch.state(spark, str(tmp_path), "segments").collect()) == len(lines) and len(segments) == 3
    dos = next(r for r in watch.state(spark, str(tmp_path), "totals").collect() if r.attack_type == "DoS")
    assert (dos.rows, dos.attacks, dos.alerts_sent) == (events.count(), events.count(), len(sent))
    assert dos.alerts_suppressed == dos.rows - dos.alerts_sent


def test_empty_batches(spark, tmp_path):
    write = watch.fan_out(watch.Outputs(str(tmp_path), COOLDOWN))
    for n in range(2):
        write(flows(spark).limit(0), n)
    assert watch.state(spark, str(tmp_path), "totals").count() == 0


def test_totals_over_many_batches_and_a_restart(spark, tmp_path):
    rows = [(("DoS", "Benign", None)[i % 3], i % 3 == 0) for i in range(30)]
    for n, some in enumerate((rows[:17], rows[17:])):
        spark.createDataFrame(some, "attack_type string, is_attack boolean").repartition(12).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("attack_type string, is_attack boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        sinks.keep_totals(stream, str(tmp_path), f"{tmp_path}/cp", once=True).awaitTermination()
    got = {r.attack_type: (r.rows, r.attacks) for r in sinks.totals_of(spark, str(tmp_path)).collect()}
    assert got == {"DoS": (10, 10), "Benign": (10, 0), None: (10, 0)}
