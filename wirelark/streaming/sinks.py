"""Running streams: state store, multi-format sinks and status reports."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from wirelark.operators import auditlog
from wirelark.streaming import ledger

log = logging.getLogger("wirelark.streaming")

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with changes saved to the checkpoint folder, as timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Takes in what is there now, including what the watermark then releases, and stops."""
    use_rocksdb(stream.sparkSession)
    query = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start(path))
    query.awaitTermination()


def log_batches(path: str, wanted: str = "", log_all: bool = False, interface: str | None = None,
                hostname: str = "localhost", dry_run: bool = False):
    """A foreachBatch function that writes detections in one or more formats. A batch goes to a
    folder of its own that a repeated attempt overwrites, so nothing is logged twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if dry_run:
            return
        rows = auditlog.records(auditlog.to_log(batch, log_all), interface, hostname)
        form = auditlog.log_format(path, wanted)
        suffix = {"csv": ".csv", "text": ".log"}.get(form, ".jsonl")
        auditlog.write(rows, f"{path}/batch-{batch_id}{suffix}", form, mode="overwrite")
    return write


TOTALS = "attack_type string, rows long, attacks long"


def keep_totals(detections: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Starts a query that keeps rows and attacks by attack type: a stateful aggregate whose changed groups
    replace those of the batch before in a small table. Restarts go on from the checkpoint, and a batch that
    is run again changes nothing. `totals_of` reads the table."""
    attacks = F.count_if("is_attack") if "is_attack" in detections.columns else F.lit(0).cast("long")
    totals = detections.groupBy("attack_type").agg(F.count(F.lit(1)).alias("rows"), attacks.alias("attacks"))

    def write(batch: DataFrame, batch_id: int) -> None:
        before = ledger.read(batch.sparkSession, path, "totals", TOTALS, batch_id)
        unchanged = before.join(F.broadcast(batch.select(F.col("attack_type").alias("_t"))), F.col("attack_type").eqNullSafe(F.col("_t")), "left_anti")
        ledger.keep(unchanged.unionByName(batch).coalesce(1), path, "totals", batch_id)
    writer = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def totals_of(spark: SparkSession, path: str) -> DataFrame:
    """(attack_type, rows, attacks) so far."""
    return ledger.read(spark, path, "totals", TOTALS)


def with_status(stream: DataFrame, name: str = "status") -> DataFrame:
    """Counts rows and attacks as they pass."""
    attacks = F.count_if("is_attack") if "is_attack" in stream.columns else F.lit(0)
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), attacks.alias("attacks"))


def status_of(query, name: str = "status") -> dict[str, int]:
    """Sums of `with_status` over the latest micro-batches, those that a query remembers; `keep_totals` forgets none."""
    seen = [p.observedMetrics.get(name) for p in query.recentProgress]
    return {k: sum(s[k] for s in seen if s is not None) for k in ("rows", "attacks")}


class StatusReport(StreamingQueryListener):
    """Logs the counts of `with_status` after every micro-batch and keeps their totals."""

    def __init__(self, name: str = "status"):
        self.name, self.rows, self.attacks = name, 0, 0

    def onQueryStarted(self, event):
        log.info("stream %s started", event.name or event.id)

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.rows += seen["rows"]
            self.attacks += seen["attacks"]
            log.info("rows %d, attacks %d, input rate %.1f/s", self.rows, self.attacks,
                     event.progress.inputRowsPerSecond)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        log.info("stream %s ended", event.id)
