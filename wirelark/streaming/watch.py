"""One running query from packets to throttled alerts, rotating logs and totals.

Decided flows leave the stream when the watermark passes their end, so micro-batch after micro-batch they come
in order of that end. Throttle and log segments go on from where the batch before stopped: what they need of it
(open cooldowns, the current segment, totals) is a small table that each batch writes beside its output. A batch
that is run again after a failure starts from the same table and overwrites its own output, so nothing is
alerted, logged or counted twice. Within a batch both are the greedy cuts of the batch operators, entered in
the stored state, and spread over tasks like them.

Folders below `path`: `alerts`, `log` (lines by segment), `state`; each with one folder for each batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wirelark.operators import alerts, auditlog
from wirelark.operators import flows as fl
from wirelark.operators.bounded import small_side
from wirelark.operators.cuts import greedy_cuts
from wirelark.operators.ordered import running_sums
from wirelark.streaming import ledger, sinks

_BEFORE = -(1 << 62)               # sequence number of what is carried over from the batch before

STATES = {
    "cooldowns": "alert_key string, last_sent long, held long",
    "segments": "hostname string, start_offset long, records long, bytes long, first_us long, last_us long",
    "totals": "attack_type string, rows long, attacks long, alerts_sent long, alerts_suppressed long",
}


@dataclass(frozen=True)
class Outputs:
    """Where and how a watch writes. `send` gets an iterator of alert rows for each partition."""
    path: str
    cooldown_us: int = 60_000_000
    max_bytes: int = 10 * 1024 * 1024
    backup_count: int = 5
    interface: str = "eth0"
    style: alerts.AlertStyle = field(default_factory=alerts.AlertStyle)
    log_all: bool = False
    send: object = None


def ended_us(limits: fl.FlowLimits = fl.LIVE) -> Column:
    """When a flow is handed out: just after the packet that closed it, or when one of its limits has passed."""
    closed = (F.col("fin") + F.col("rst") > 0) | F.col("is_port_scan") | F.col("is_conn_flood")
    return F.when(closed, F.col("last_us") + 1).otherwise(
        F.least(F.col("last_us") + F.lit(limits.inactivity), F.col("start_us") + F.lit(limits.active)))


def events_of(decided: DataFrame, limits: fl.FlowLimits = fl.LIVE) -> DataFrame:
    """Decided flows as events: `ts_us` is their end, `seq` their first packet's number."""
    return decided.withColumns({"ts_us": ended_us(limits), "seq": F.col("start_seq"),
                                "alert_key": alerts.throttle_key(F.col("src_ip"), F.col("attack_type"))})


# State between batches ---------------------------------------------------------------------------

def state(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame:
    """The state that the last batch, or the last one before a batch, has left; `name` is one of STATES."""
    return ledger.read(spark, f"{path}/state", name, STATES[name], before)


# What a batch adds -------------------------------------------------------------------------------

def throttle_on(events: DataFrame, cooldowns: DataFrame, cooldown_us: int) -> tuple[DataFrame, DataFrame]:
    """(events with `sent` and `suppressed_count`, cooldowns afterwards), from the cooldowns before."""
    carried = cooldowns.select("alert_key", F.col("last_sent").alias("ts_us"), F.lit(_BEFORE).alias("seq"), F.col("held").alias("_held"))
    narrow = events.select("alert_key", "ts_us", "seq", F.lit(None).cast("long").alias("_held"))
    cut = greedy_cuts(narrow.unionByName(carried), "alert_key", "ts_us", "seq", active=cooldown_us)
    own = F.col("seq") != _BEFORE
    first = cut.where(own & (F.col("run_pos") == 0)).groupBy("alert_key").agg(F.min(F.struct("ts_us", "seq")).alias("_first"))
    marked = (cut.where(own).drop("_held").join(small_side(cooldowns.select("alert_key", F.col("held").alias("_held"))), "alert_key", "left")
              .join(small_side(first), "alert_key", "left"))
    sent, before = F.col("run_pos") == 0, F.coalesce("_held", F.lit(0))
    is_first = F.struct("ts_us", "seq") == F.col("_first")
    shown = (F.when(sent, F.coalesce("prev_run_pos", F.lit(0)) + F.when(is_first, before).otherwise(F.lit(0)))
             .otherwise(F.col("run_pos") + F.when(F.col("run_seq") == _BEFORE, before).otherwise(F.lit(0))))
    runs = cut.groupBy("alert_key", "run_t", "run_seq").agg((F.count("*") - 1 + F.coalesce(F.max("_held"), F.lit(0))).alias("held"))
    last = runs.groupBy("alert_key").agg(F.max(F.struct("run_t", "run_seq", "held")).alias("_r"))
    after = last.select("alert_key", F.col("_r.run_t").alias("last_sent"), F.col("_r.held").alias("held"))
    verdict = marked.select("alert_key", "ts_us", "seq", sent.alias("sent"), shown.alias("suppressed_count"))
    return events.join(verdict, ["alert_key", "ts_us", "seq"]).select(*events.columns, "sent", "suppressed_count"), after


def segments_on(lines: DataFrame, segments: DataFrame, max_bytes: int, backup_count: int) -> tuple[DataFrame, DataFrame]:
    """(lines with `segment`, the offset at which theirs starts, segments afterwards), from those before.
    `lines` have hostname, ts_us, seq and line; only their sizes travel."""
    current = segments.groupBy("hostname").agg(F.max(F.struct("start_offset", "bytes")).alias("_c")).select(
        "hostname", F.col("_c.start_offset").alias("_start"), (F.col("_c.start_offset") + F.col("_c.bytes")).alias("_upto"))
    sized = lines.select("hostname", "ts_us", "seq", (F.octet_length("line") + 1).cast("long").alias("_bytes"))
    placed = running_sums(sized, ["hostname"], ["ts_us", "seq"], {"_end": F.col("_bytes")}, probe=lines)
    placed = placed.join(small_side(current), "hostname", "left").withColumn("_offset", F.coalesce("_upto", F.lit(0)) + F.col("_end") - F.col("_bytes"))
    opened = current.select("hostname", F.col("_start").alias("_offset"), F.lit(_BEFORE).alias("seq"), F.lit(0).cast("long").alias("_bytes"))
    rows = placed.select("hostname", "ts_us", "seq", "_bytes", "_offset").unionByName(opened, allowMissingColumns=True)
    cut = greedy_cuts(rows, "hostname", "_offset", "seq", active=1 << 60 if backup_count <= 0 else max_bytes)
    own = cut.where(F.col("seq") != _BEFORE)
    added = own.groupBy("hostname", F.col("run_t").alias("start_offset")).agg(
        F.count("*").alias("records"), F.sum("_bytes").alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    every = segments.unionByName(added).groupBy("hostname", "start_offset").agg(
        F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    # one row for each segment of one batch, and the few that were kept
    newest = running_sums(every.withColumn("_back", -F.col("start_offset")), ["hostname"], ["_back"], {"_age": F.lit(1)})
    after = newest.where(F.col("_age") <= max(backup_count, 0) + 1).select(*every.columns)
    return own.select("hostname", "ts_us", "seq", F.col("run_t").alias("segment")), after


def _totals_on(events: DataFrame, totals: DataFrame) -> DataFrame:
    attack, sent = F.col("is_attack"), F.col("sent")
    added = events.groupBy("attack_type").agg(F.count("*").alias("rows"), F.count_if(attack).alias("attacks"), F.count_if(attack & sent).alias("alerts_sent"),
                                              F.count_if(attack & ~sent).alias("alerts_suppressed"))
    return totals.unionByName(added).groupBy("attack_type").agg(*[F.sum(c).alias(c) for c in ("rows", "attacks", "alerts_sent", "alerts_suppressed")])


def fan_out(to: Outputs):
    """A foreachBatch function for decided flows with ts_us, seq and alert_key (see `events_of`)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, to.path
        own = f"{path}/events/batch={batch_id}"
        batch.drop("ts").write.mode("overwrite").parquet(own)             # read several times below, worked out once
        events = spark.read.schema(batch.drop("ts").schema).parquet(own)
        last = events.agg(F.max("ts_us")).first()[0]
        if last is None:                                                  # nothing ended: the state stays as it is
            ledger.delete(spark, own)
            return
        attacks, cooldowns = throttle_on(events.where("is_attack"), state(spark, path, "cooldowns", batch_id), to.cooldown_us)
        attacks.write.mode("overwrite").parquet(f"{own}-throttled")
        attacks = spark.read.schema(attacks.schema).parquet(f"{own}-throttled")
        # a cooldown that has passed, and held nothing back, is over
        cooldowns = cooldowns.where((F.col("held") > 0) | (F.col("last_sent") + to.cooldown_us > last))
        ledger.keep(cooldowns, f"{path}/state", "cooldowns", batch_id)

        shown = alerts.alert_payload(attacks.where("sent"), to.interface).join(
            attacks.where("sent").select("seq", "alert_key", "suppressed_count"), "seq")
        alerts.render(shown, to.style).write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")
        if to.send is not None:
            alerts.hand_over(spark.read.parquet(f"{path}/alerts/batch={batch_id}"), to.send)

        records = auditlog.records(auditlog.to_log(events, to.log_all), to.interface, to.style.hostname)
        lines = auditlog.json_lines(records).select("seq", "hostname", "line").join(events.select("seq", "ts_us"), "seq")
        before = state(spark, path, "segments", batch_id)
        placed, segments = segments_on(lines, before, to.max_bytes, to.backup_count)
        lines.join(placed, ["hostname", "ts_us", "seq"]).select("line", "segment").write.mode("overwrite").partitionBy("segment").text(f"{path}/log/batch={batch_id}")
        ledger.keep(segments, f"{path}/state", "segments", batch_id)
        _drop_old_segments(spark, path)

        sent = events.where(~F.coalesce(F.col("is_attack"), F.lit(False))).withColumn("sent", F.lit(False)).select("attack_type", "is_attack", "sent").unionByName(
            attacks.select("attack_type", "is_attack", "sent"))
        ledger.keep(_totals_on(sent, state(spark, path, "totals", batch_id)), f"{path}/state", "totals", batch_id)
        for folder in (own, f"{own}-throttled"):
            ledger.delete(spark, folder)
    return write


def _drop_old_segments(spark: SparkSession, path: str) -> None:
    """Deletes the lines of segments that are no longer kept."""
    live = {r.start_offset for r in state(spark, path, "segments").select("start_offset").collect()}
    for batch in ledger.numbers(spark, f"{path}/log"):
        for segment in ledger.numbers(spark, f"{path}/log/batch={batch}", "segment="):
            if live and segment < min(live):
                ledger.delete(spark, f"{path}/log/batch={batch}/segment={segment}")


def watch(decided: DataFrame, to: Outputs, checkpoint: str, limits: fl.FlowLimits = fl.LIVE, once: bool = False):
    """Starts the query on a stream of decided flows. `once`: takes in what is there now and stops."""
    sinks.use_rocksdb(decided.sparkSession)
    writer = events_of(decided, limits).writeStream.foreachBatch(fan_out(to)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
