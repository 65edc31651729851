"""Detection records as nested JSON, flat CSV and text lines, with their sinks and statistics."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wirelark.functions.net import mitigation_rule, seconds_to_4_places
from wirelark.operators.cuts import greedy_cuts
from wirelark.operators.ordered import running_sums
from wirelark.schemas import DETECTION_CSV_COLUMNS

# Stand-ins for fields a detection does not carry.
DEFAULTS = {"src_ip": "0.0.0.0", "src_port": 0, "dst_ip": "0.0.0.0", "dst_port": 0,
            "protocol_name": "TCP/UDP", "duration_sec": 0.0, "total_packets": 0, "total_bytes": 0,
            "fwd_packets": 0, "bwd_packets": 0, "fwd_bytes": 0, "bwd_bytes": 0, "probability": 0.0}
FLAG_COUNTS = ["fin", "syn", "rst", "psh", "ack"]


def to_log(detections: DataFrame, log_all: bool = False, enabled: bool = True) -> DataFrame:
    if not enabled:
        return detections.limit(0)
    return detections if log_all else detections.where("is_attack")


def records(detections: DataFrame, interface: str | None = None, hostname: str = "localhost") -> DataFrame:
    """One wide row per detection; time is the flow's last packet. Packet statistics come from the
    flow when `len_min`, `len_max` and the flag counts are there, else from the totals."""
    have = set(detections.columns)
    col = lambda n, d: F.coalesce(F.col(n), F.lit(d)) if n in have else F.lit(d)
    attack = col("is_attack", False)
    base = detections.select(
        "*", *[col(n, d).alias(f"r_{n}") for n, d in DEFAULTS.items()], attack.alias("r_attack"))
    duration, total = F.col("r_duration_sec"), F.col("r_total_packets")
    rate = lambda c: F.when(duration > 0, F.bround(F.col(c) / duration, 2)).otherwise(
        F.col(c).cast("double"))
    kind = F.col("attack_type") if "attack_type" in have else F.lit(None).cast("string")
    kind = F.coalesce(kind, F.when(F.col("r_attack"), F.lit("Maligno")).otherwise(F.lit("Benign")))
    mean = F.when(total > 0, F.bround(F.col("r_total_bytes") / total, 2)).otherwise(F.lit(0.0))
    stat = lambda n: F.coalesce(F.col(n), F.lit(0)) if n in have else F.lit(0)
    flags = (F.struct(*[F.col(f).alias(f.upper()) for f in FLAG_COUNTS])
             if set(FLAG_COUNTS) <= have else F.lit(None))
    text = F.date_format(F.timestamp_micros("last_us"), "yyyy-MM-dd HH:mm:ss.SSS")
    columns = {
        "timestamp": text, "epoch": seconds_to_4_places(F.col("last_us")),
        "event": F.when(F.col("r_attack"), F.lit("INTRUSION_DETECTED")).otherwise(F.lit("BENIGN_FLOW")),
        "attack_type": kind, "is_attack": F.col("r_attack"),
        "confidence": F.bround("r_probability", 4),
        "confidence_pct": F.concat(F.format_string("%.2f", F.col("r_probability") * 100), F.lit("%")),
        "dt_attack_type": (F.col("dt_attack_type") if "dt_attack_type" in have
                           else F.when(F.col("r_attack"), kind)),
        "dt_confidence": (F.bround(F.coalesce(F.col("dt_confidence"), F.lit(0.0)), 4)
                          if "dt_confidence" in have else F.lit(None).cast("double")),
        "dt_probabilities": (F.col("dt_probabilities") if "dt_probabilities" in have
                             else F.lit(None).cast("map<string,double>")),
        "src_ip": F.col("r_src_ip"), "src_port": F.col("r_src_port"),
        "dst_ip": F.col("r_dst_ip"), "dst_port": F.col("r_dst_port"),
        "protocol": F.col("r_protocol_name"), "interface": F.lit(interface or "unknown"),
        "duration_sec": F.bround(duration, 4), "total_packets": total,
        "total_bytes": F.col("r_total_bytes"), "fwd_packets": F.col("r_fwd_packets"),
        "bwd_packets": F.col("r_bwd_packets"), "fwd_bytes": F.col("r_fwd_bytes"),
        "bwd_bytes": F.col("r_bwd_bytes"), "packets_per_sec": rate("r_total_packets"),
        "bytes_per_sec": rate("r_total_bytes"),
        "length_min": stat("len_min"), "length_max": stat("len_max"), "length_mean": mean,
        "tcp_flags": flags,
        "mitigation_rule": mitigation_rule(F.col("r_attack"), F.col("r_src_ip")),
        "hostname": F.lit(hostname),
        "seq": F.col("start_seq") if "start_seq" in have else F.lit(0),
        "last_us": F.col("last_us"),
    }
    return base.select(*[c.alias(n) for n, c in columns.items()])


def json_lines(recs: DataFrame) -> DataFrame:
    """Adds `line`, the nested record as JSON with its empty fields kept."""
    flow = ["duration_sec", "total_packets", "total_bytes", "fwd_packets", "bwd_packets",
            "fwd_bytes", "bwd_bytes", "packets_per_sec", "bytes_per_sec"]
    body = F.struct(
        "timestamp", "epoch", "event", "attack_type", "is_attack", "confidence", "confidence_pct",
        "dt_attack_type", "dt_confidence", "dt_probabilities",
        F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")).alias("source"),
        F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")).alias("destination"),
        "protocol", "interface", F.struct(*flow).alias("flow_metrics"),
        F.struct("length_min", "length_max", "length_mean", "tcp_flags").alias("packet_stats"),
        "mitigation_rule", "hostname")
    return recs.withColumn("line", F.to_json(body, {"ignoreNullFields": "false"}))


def csv_rows(recs: DataFrame) -> DataFrame:
    return recs.select(*DETECTION_CSV_COLUMNS)


def text_lines(recs: DataFrame) -> DataFrame:
    """Adds `line` in the human-readable form."""
    s = lambda n: F.col(n).cast("string")
    return recs.withColumn("line", F.concat(
        F.lit("["), s("timestamp"), F.lit("] ["), s("event"), F.lit("] Type: "), s("attack_type"),
        F.lit(" (Conf: "), s("confidence_pct"), F.lit(") | "),
        s("src_ip"), F.lit(":"), s("src_port"), F.lit(" -> "), s("dst_ip"), F.lit(":"), s("dst_port"),
        F.lit(" ("), s("protocol"), F.lit(") | Pkts: "), s("total_packets"),
        F.lit(", Bytes: "), F.format_number("total_bytes", 0),
        F.lit(", Dur: "), F.format_string("%.4f", F.col("duration_sec")),
        F.lit("s | Action: "), s("mitigation_rule")))


def log_format(path: str, wanted: str = "") -> str:
    """The format asked for, else the one the file extension stands for."""
    if wanted.strip():
        return wanted.strip().lower()
    extension = os.path.splitext(path)[1].lower()
    return {".csv": "csv", ".log": "text", ".txt": "text"}.get(extension, "jsonl")


def write(recs: DataFrame, path: str, wanted: str = "", mode: str = "append") -> None:
    """Writes the records below `path` in one format, or JSON lines and CSV for 'both' / 'all'."""
    form = log_format(path, wanted)
    if form in ("json", "jsonl"):
        json_lines(recs).select("line").write.mode(mode).text(path)
    elif form == "csv":
        csv_rows(recs).write.mode(mode).option("header", True).csv(path)
    elif form == "text":
        text_lines(recs).select("line").write.mode(mode).text(path)
    elif form in ("both", "all"):
        kept = recs.persist()
        try:
            write(kept, path, "jsonl", mode)
            write(kept, os.path.splitext(path)[0] + ".csv", "csv", mode)
        finally:
            kept.unpersist()
    else:
        raise ValueError(f"unknown log format: {form}")


def recent(spark: SparkSession, path: str, schema: str, limit: int = 10) -> DataFrame:
    """The newest `limit` records of a JSON-lines log, oldest first. A line that is no JSON is kept
    as it is in `raw`, in its place after the line before it; blank lines are skipped."""
    lines = spark.read.text(path).select(
        F.trim("value").alias("raw"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line")).where(F.col("raw") != "")
    return newest(placed(parse_lines(lines, schema)), limit).drop(*_PLACE)


_PLACE = ["_at", "_file", "_block", "_line"]


def placed(parsed: DataFrame) -> DataFrame:
    """Adds `_at`, a record's (epoch, seq). A broken line gets that of the record before it in its
    block of the file, or of the one after it where it comes first."""
    fields = [c for c in ("epoch", "seq") if c in parsed.columns]
    own = F.when(F.col("raw").isNull(), F.struct(*fields))
    block = Window.partitionBy("_file", "_block").orderBy("_line")
    before = F.last(own, True).over(block.rowsBetween(Window.unboundedPreceding, 0))
    # with none before it, the next record is the block's first; a frame that begins at each row would be quadratic
    first = F.first(own, True).over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return parsed.withColumn("_at", F.coalesce(before, first))


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    parsed = lines.withColumn("record", F.from_json(
        "raw", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.select(*[c for c in lines.columns if c != "raw"], "record.*",
                         F.when(F.col("record._bad").isNotNull(), F.col("raw")).alias("raw")).drop("_bad")


def newest(parsed: DataFrame, limit: int) -> DataFrame:
    """Takes the newest rows per task first, so only `limit` of each travel on."""
    order = [c for c in (_PLACE if "_at" in parsed.columns else ["epoch", "seq"]) if c in parsed.columns]
    return parsed.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(limit).orderBy(*order)


def segments(lines: DataFrame, max_bytes: int = 10 * 1024 * 1024, backup_count: int = 5,
             host: str = "hostname", chunk_rows: int | None = None) -> DataFrame:
    """Log segments per host in record order (`ts_us`, `seq`): a record opens a new segment when
    the current one already holds `max_bytes`. Keeps the newest `backup_count` plus the current."""
    # the texts stay behind: only their sizes travel
    sized = lines.select(host, "ts_us", "seq", (F.octet_length("line") + 1).cast("long").alias("_bytes"))
    placed = running_sums(sized, [host], ["ts_us", "seq"], {"_end": F.col("_bytes")}, chunk_rows,
                          probe=lines)
    placed = placed.withColumn("_offset", F.col("_end") - F.col("_bytes"))
    if backup_count <= 0:              # nothing is ever set aside, so the log is one segment
        max_bytes = 1 << 60
    cut = greedy_cuts(placed, host, "_offset", "seq", active=max_bytes, chunk_rows=chunk_rows)
    per_segment = cut.groupBy(host, F.col("run_t").alias("start_offset")).agg(
        F.count("*").alias("records"), F.sum("_bytes").alias("bytes"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    # one row per segment from here on
    newer = running_sums(per_segment.withColumn("_back", -F.col("start_offset")), [host], ["_back"],
                         {"age": F.lit(1)}, chunk_rows)
    return (newer.withColumn("age", F.col("age") - 1).where(F.col("age") <= max(backup_count, 0))
            .drop("_back"))


def log_stats(recs: DataFrame) -> DataFrame:
    """`recs` carries `line`, the text that was written."""
    return recs.agg(F.count("*").alias("total_logged"),
                    F.count_if("is_attack").alias("total_attacks_logged"),
                    F.count_if(~F.col("is_attack")).alias("total_benign_logged"),
                    F.max("last_us").alias("last_log_us"),
                    F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("file_size_bytes"))
