"""Port-scan and connection-flood marks over sliding windows of connection attempts.

A distinct count over a sliding window is turned into a running sum. A port counts from its first
attempt until `window` after its last one: an attempt whose port was not seen in the window adds
one, and if no attempt on the port follows in time, one is taken off when the window has passed.
Attempts are counted in the same way. Every attempt yields at most three rows, whatever the rate,
and the sum runs per host pair in chunks, so a flooded pair does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wirelark.functions.net import is_client_syn
from wirelark.operators.ordered import neighbours, running_sums

PAIR = ["src_ip", "dst_ip"]


def window_counts(syns: DataFrame, scan_window: int = 5_000_000, flood_window: int = 5_000_000,
                  chunk_rows: int | None = None) -> DataFrame:
    """Adds `scan_ports` and `flood_attempts`: distinct ports and attempts of the host pair in the
    window that ends with (and includes) the row."""
    near = neighbours(syns, [*PAIR, "dst_port"], ["ts_us", "seq"], "ts_us", "_before", "_after",
                      chunk_rows)
    opens = F.col("_before").isNull() | (F.col("ts_us") - F.col("_before") > scan_window)
    runs_out = F.col("_after").isNull() | (F.col("_after") - F.col("ts_us") > scan_window)
    at = F.col("ts_us")
    steps = F.array(
        F.struct(at.alias("at"), F.lit(1).alias("arrival"), opens.cast("int").alias("ports"),
                 F.lit(1).alias("attempts")),
        F.struct((at + scan_window + 1).alias("at"), F.lit(0).alias("arrival"),
                 (-runs_out.cast("int")).alias("ports"), F.lit(0).alias("attempts")),
        F.struct((at + flood_window + 1).alias("at"), F.lit(0).alias("arrival"),
                 F.lit(0).alias("ports"), F.lit(-1).alias("attempts")))
    timeline = (near.withColumn("_step", F.explode(steps))
                .where((F.col("_step.ports") != 0) | (F.col("_step.attempts") != 0))
                .withColumn("_at", F.col("_step.at")).withColumn("_arrival", F.col("_step.arrival")))
    arrivals = syns.withColumn("_at", F.col("ts_us")).withColumn("_arrival", F.lit(1))
    summed = running_sums(timeline, PAIR, ["_at", "_arrival", "seq"],
                          {"scan_ports": F.col("_step.ports"),
                           "flood_attempts": F.col("_step.attempts")}, chunk_rows, probe=arrivals)
    return summed.where(F.col("_arrival") == 1).drop("_before", "_after", "_step", "_at", "_arrival")


def mark_attempts(syns: DataFrame, scan_threshold: int = 15, flood_threshold: int = 20,
                  scan_window: int = 5_000_000, flood_window: int = 5_000_000,
                  chunk_rows: int | None = None) -> DataFrame:
    """A scan mark wins over a flood mark on the same row."""
    scan = F.col("scan_ports") >= scan_threshold
    return (window_counts(syns, scan_window, flood_window, chunk_rows)
            .withColumn("is_port_scan", scan)
            .withColumn("is_conn_flood", ~scan & (F.col("flood_attempts") >= flood_threshold)))


def mark_packets(packets: DataFrame, **thresholds) -> DataFrame:
    """All packets with `is_port_scan` / `is_conn_flood`. Only connection attempts are windowed;
    the rest passes by unshuffled, and the two parts are put together again without a join."""
    attempt = is_client_syn()
    marked = mark_attempts(packets.where(attempt), **thresholds).drop("scan_ports", "flood_attempts")
    others = (packets.where(~attempt).withColumn("is_port_scan", F.lit(False))
              .withColumn("is_conn_flood", F.lit(False)))
    return others.unionByName(marked)
