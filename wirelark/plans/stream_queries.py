"""Streams over the sample tables, checked against the same SQL as their batch counterparts."""

from pyspark.sql import functions as F

from wirelark.operators import alerts, detect
from wirelark.operators import flows as fl
from wirelark.plans import packet_sql as sql
from wirelark.plans.catalog import ORACLES, query
from wirelark.plans.flow_queries import MARKS, MARKS_SQL, SYN_MARKS, SYN_SQL, clean_packets, feature_columns
from wirelark.plans.decision_queries import COOLDOWN_US, throttle_sql
from wirelark.plans.model_queries import ATTACK_CLASSES, VERDICT_SQL, two_stages
from wirelark.sources import tables
from wirelark.sources.scratch import cut_lineage, shared_folder
from wirelark.streaming import processors as pr
from wirelark.streaming import sinks, watch


def _through_stream(spark, rows, key_column, key, purpose, build):
    """Writes rows and a sentinel as files, streams them through `build`, returns what came out."""
    folder = shared_folder(spark, purpose)
    rows.write.parquet(f"{folder}/in")
    stored = spark.read.parquet(f"{folder}/in")
    last = stored.agg(F.max("ts_us")).first()[0] or 0
    pr.sentinel(stored, key_column, key, last).write.mode("append").parquet(f"{folder}/in")
    stream = pr.with_event_time(pr.read_packets(spark, f"{folder}/in", stored.schema))
    sinks.run_to_table(build(stream), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


def _packet_stream(spark, sf_dir, build):
    """The sentinel is a packet between unused addresses; it never finishes a flow itself."""
    def built(stream):
        ends = F.col("src_ip") == "end"
        whole = stream.withColumns({
            c: F.when(ends, F.lit(v)).otherwise(F.col(c)) for c, v in (
                ("dst_ip", "end"), ("src_port", 0), ("dst_port", 0), ("proto", "17"), ("payload_len", 0),
                ("header_len", 8), ("tcp_window", 0), ("pkt_len", 28))})
        return build(whole)
    return _through_stream(spark, clean_packets(spark, sf_dir), "src_ip", "end", "packets", built)


@query("stream_packets", "WITH " + sql.CLEAN_PACKETS + """ SELECT proto, count(*) AS n,
  sum(payload_len)::BIGINT AS bytes FROM packets GROUP BY 1""")
def stream_packets(spark, sf_dir):
    out = _packet_stream(spark, sf_dir, lambda s: s.where("src_ip <> 'end'").select("seq", "proto", "payload_len"))
    return out.groupBy("proto").agg(F.count("*").alias("n"), F.sum("payload_len").alias("bytes"))


@query("stream_flows", sql.live_flows() + " SELECT flow_key, start_us, start_seq, "
       + sql.feature_list(fl.FEATURE_NAMES) + " FROM flow")
def stream_flows(spark, sf_dir):
    out = _packet_stream(spark, sf_dir, pr.stream_flows)
    return out.select(*fl.FLOW, *feature_columns(fl.FEATURE_NAMES))


@query("stream_marked_flows", sql.live_flows(MARKS_SQL)
       + " SELECT flow_key, start_us, start_seq, is_port_scan, is_conn_flood, len_n AS total_packets FROM flow")
def stream_marked_flows(spark, sf_dir):
    """Marks and flows as two stateful operators of one query."""
    out = _packet_stream(spark, sf_dir, lambda s: pr.stream_flows(pr.mark_stream(s, **MARKS)))
    return out.select(*fl.FLOW, "is_port_scan", "is_conn_flood", "total_packets")


def _marked(spark, sf_dir):
    out = _through_stream(spark, tables.syn_packets(spark, sf_dir), "src_ip", "end", "syn",
                          lambda s: pr.mark_stream(s, **SYN_MARKS))
    return out.where("src_ip <> 'end'")


@query("stream_scan", SYN_SQL + " SELECT seq, src_ip, dst_ip, ts_us, scan_mark AS is_port_scan, "
       "flood_mark AS is_conn_flood FROM marked")
def stream_scan(spark, sf_dir):
    return _marked(spark, sf_dir).select("seq", "src_ip", "dst_ip", "ts_us", "is_port_scan", "is_conn_flood")


@query("stream_cooldown", ORACLES["alert_suppressed"])
def stream_cooldown(spark, sf_dir):
    events = tables.alert_events(spark, sf_dir).withColumn(
        "alert_key", alerts.throttle_key(F.col("src_ip"), F.col("attack_type")))
    out = _through_stream(spark, events, "alert_key", "end", "alerts",
                          lambda s: pr.stream_throttle(s, COOLDOWN_US))
    return out.where("alert_key <> 'end'").select("seq", "alert_key", "sent", "suppressed_count")


@query("stream_final_flush", sql.live_flows() + """ SELECT flow_key, start_us, start_seq, last_us, len_n AS total_packets FROM flow
  WHERE fin + rst = 0 AND (SELECT max(ts_us) FROM packets) - last_us < 10000000 AND (SELECT max(ts_us) FROM packets) - start_us < 60000000""")
def stream_final_flush(spark, sf_dir):
    """The flows that were open when the input ended and came out because of the sentinel."""
    last = clean_packets(spark, sf_dir).agg(F.max("ts_us")).first()[0]
    out = _packet_stream(spark, sf_dir, pr.stream_flows).where("src_ip <> 'end' and fin + rst = 0")
    still = out.where((F.lit(last) - F.col("last_us") < fl.LIVE.inactivity) & (F.lit(last) - F.col("start_us") < fl.LIVE.active))
    return still.select(*fl.FLOW, "last_us", F.col("len_n").alias("total_packets"))


def _ending(packets, last):
    """The sentinel packet of a packet stream."""
    return pr.sentinel(packets, "src_ip", "end", last).withColumns({
        "dst_ip": F.lit("end"), "src_port": F.lit(0), "dst_port": F.lit(0), "proto": F.lit("17"), "payload_len": F.lit(0),
        "header_len": F.lit(8), "tcp_window": F.lit(0), "pkt_len": F.lit(28)})


def _in_parts(spark, parts, folder, run):
    """Puts one part after the other into a folder, and after each takes in what is new, on one checkpoint."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        run(pr.with_event_time(pr.read_packets(spark, f"{folder}/in", part.schema)))


def _thirds(packets, last):
    """Three parts in time, the last one with the sentinel."""
    third, t = last // 3, F.col("ts_us")
    return [packets.where(t <= third), packets.where((t > third) & (t <= 2 * third)), packets.where(t > 2 * third).unionByName(_ending(packets, last))]


@query("stream_late_rows", sql.live_flows() + " SELECT flow_key, start_us, start_seq, len_n AS total_packets FROM flow")
def stream_late_rows(spark, sf_dir):
    """Copies of old packets that arrive two batches late, after the watermark has passed them, change no flow."""
    packets = clean_packets(spark, sf_dir)
    last = packets.agg(F.max("ts_us")).first()[0]
    late = packets.where(F.col("ts_us") < last // 3 - 60_000_000).withColumn("seq", F.col("seq") + 10**12)
    first, second, rest = _thirds(packets, last)
    folder = shared_folder(spark, "late")
    _in_parts(spark, [first, second, rest.unionByName(late)], folder,
              lambda s: sinks.run_to_table(pr.stream_flows(s), f"{folder}/out", f"{folder}/checkpoint"))
    out = spark.read.parquet(f"{folder}/out").where("src_ip <> 'end'")
    return out.select(*fl.FLOW, F.col("len_n").alias("total_packets"))


_WATCHED = sql.live_flows(MARKS_SQL) + f""", judged AS (SELECT *, {VERDICT_SQL}, CASE WHEN fin + rst > 0 OR is_conn_flood OR is_port_scan THEN last_us + 1
    ELSE least(last_us + {fl.LIVE.inactivity}, start_us + {fl.LIVE.active}) END AS ts_us, start_seq AS seq FROM flow),
  ev AS (SELECT *, src_ip || '_' || attack_type AS alert_key FROM judged WHERE is_attack), """ + throttle_sql(COOLDOWN_US)


def _watch(spark, sf_dir):
    """The folder to which packets, in two runs on one checkpoint, were watched with two trained models."""
    packets = clean_packets(spark, sf_dir)
    first, second = two_stages(cut_lineage(fl.build_flows(packets, marks=MARKS), "flows"))
    folder = shared_folder(spark, "watch")
    to = watch.Outputs(f"{folder}/out", COOLDOWN_US, max_bytes=65_536)

    def run(stream):
        flows = pr.stream_flows(pr.mark_stream(stream, **MARKS))
        decided = detect.score_flows(flows, first, "dt", ["0", "1"], "cascade", second=second, second_name="rf", second_classes=ATTACK_CLASSES)
        watch.watch(decided, to, f"{folder}/checkpoint", once=True).awaitTermination()
    last = packets.agg(F.max("ts_us")).first()[0]
    first_two, third = _thirds(packets, last)[:2], _thirds(packets, last)[2]
    _in_parts(spark, [first_two[0].unionByName(first_two[1]), third], folder, run)
    return to.path


@query("stream_alerts", _WATCHED + " SELECT seq, alert_key, attack_type, ts_us, suppressed_count FROM throttled WHERE sent")
def stream_alerts(spark, sf_dir):
    """From packets to throttled alerts, log and totals in one query, across batches and a restart."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{_watch(spark, sf_dir)}/alerts").select(
        "seq", "alert_key", "attack_type", "ts_us", "suppressed_count")


def _detections(spark, sf_dir, folder):
    """Events as detections, stored so that a stream can read them."""
    kind = F.col("event_type")
    rows = tables.table(spark, sf_dir, "events").select(
        kind.isin("error", "purchase").alias("is_attack"), kind.alias("attack_type"), F.lit(0.9).alias("probability"),
        tables.compressed_us().alias("last_us"))
    rows.write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


@query("stream_status", "SELECT count(*) AS n_rows, count(*) FILTER (event_type IN ('error', 'purchase')) AS attacks FROM events")
def stream_status(spark, sf_dir):
    folder = shared_folder(spark, "status")
    running = (sinks.with_status(_detections(spark, sf_dir, folder)).writeStream.format("noop")
               .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    running.awaitTermination()
    seen = sinks.status_of(running)
    return spark.createDataFrame([(seen["rows"], seen["attacks"])], "n_rows long, attacks long")


@query("stream_type_totals", "SELECT event_type AS attack_type, count(*) AS n_rows, count(*) FILTER (event_type IN ('error', 'purchase')) AS attacks FROM events GROUP BY 1")
def stream_type_totals(spark, sf_dir):
    """Totals by type from the stateful aggregate, over as many batches as there are files and a restart."""
    folder = shared_folder(spark, "totals")
    rows = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("attack_type"), F.col("event_type").isin("error", "purchase").alias("is_attack"), "event_id")
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).drop("event_id").repartition(4).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("attack_type string, is_attack boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        sinks.keep_totals(stream, folder, f"{folder}/checkpoint", once=True).awaitTermination()
    return sinks.totals_of(spark, folder).withColumnRenamed("rows", "n_rows")


@query("stream_log_sink", "SELECT event_type AS attack_type, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1")
def stream_log_sink(spark, sf_dir):
    """Attacks written by foreachBatch as JSON lines and read back."""
    folder = shared_folder(spark, "log")
    running = (_detections(spark, sf_dir, folder).writeStream.foreachBatch(sinks.log_batches(f"{folder}/log", "jsonl", hostname="h"))
               .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    running.awaitTermination()
    lines = spark.read.text(f"{folder}/log/*")
    return lines.groupBy(F.get_json_object("value", "$.attack_type").alias("attack_type")).agg(F.count("*").alias("n"))
