"""Packets to bidirectional flows with their 70 statistics.

One shuffle of the packets by (flow key, chunk) cuts them into flows; the statistics are then one
hash aggregate of plain sums, minima and maxima, so it is combined before its shuffle and a flow
whose packets lie in many chunks costs no more than any other. Variances come from sums of whole
numbers that are exact to the last digit, so they hold for values that are large and nearly equal,
and do not depend on the order of addition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wirelark.functions import net
from wirelark.operators.cuts import NEVER, greedy_cuts
from wirelark.operators.heuristics import mark_packets
from wirelark.operators.ordered import WHOLE, worth_splitting
from wirelark.schemas import FEATURE_NAMES


@dataclass(frozen=True)
class FlowLimits:
    """All in microseconds. A flow ends `inactivity` after its last packet, `active` after its
    first, or with a FIN, RST or flagged packet; packets up to `linger` after such an end are
    ignored. `idle` separates bursts inside a flow."""
    inactivity: int = 10_000_000
    active: int = 60_000_000
    linger: int = 1_000_000
    idle: int = 5_000_000


LIVE = FlowLimits()
AGGREGATOR_ONLY = FlowLimits(inactivity=15_000_000, active=120_000_000)
REPLAY = FlowLimits(inactivity=NEVER, active=NEVER, linger=NEVER)

FLOW = ["flow_key", "start_us", "start_seq"]
_CARRIED = ["payload_len", "header_len", "tcp_window", "tcp_flags", "is_port_scan", "is_conn_flood"]


def _flag(name: str) -> Column:
    return F.coalesce(F.col(f"tcp_flags.{name}"), F.lit(False))


def cut_into_flows(packets: DataFrame, limits: FlowLimits = LIVE,
                   marks: dict | None = None, columns=None) -> DataFrame:
    """Adds flow identity (flow_key, start_us, start_seq), `is_fwd`, `absorbed` and the gaps that
    the statistics need. With `marks` (thresholds, see `heuristics.mark_packets`) scans and floods
    are marked first and a marked packet closes its flow; marks already present are used too.
    Of the packets' columns `columns` are carried along (all if not given)."""
    probe, chunk_rows = net.with_direction_key(packets), None
    if marks is not None:
        if not worth_splitting(packets, ["ts_us", "seq"]):
            chunk_rows = WHOLE
        packets = mark_packets(packets, **marks, chunk_rows=chunk_rows)
    for name in ("is_port_scan", "is_conn_flood"):
        if name not in packets.columns:
            packets = packets.withColumn(name, F.lit(False))
    closing = _flag("FIN") | _flag("RST") | F.col("is_port_scan") | F.col("is_conn_flood")
    keyed = net.with_direction_key(packets).withColumn("closes", closing)
    if columns is not None:
        keyed = keyed.select("flow_key", "side", "ts_us", "seq", "closes", *columns)
    cut = greedy_cuts(keyed, "flow_key", "ts_us", "seq", closes="closes", side="side",
                      active=limits.active, inactivity=limits.inactivity,
                      linger=limits.linger, idle=limits.idle, chunk_rows=chunk_rows, probe=probe)
    is_first = (F.col("ts_us") == F.col("run_t")) & (F.col("seq") == F.col("run_seq"))
    same_side_inside = (F.struct("side_prev_t", "side_prev_seq")
                        >= F.struct(F.col("run_t").alias("side_prev_t"),
                                    F.col("run_seq").alias("side_prev_seq")))
    return (cut.withColumns({
        "start_us": F.col("run_t"), "start_seq": F.col("run_seq"),
        "is_fwd": F.col("side") == F.col("run_side"), "is_first": is_first,
        "gap_us": F.when(~is_first, F.col("ts_us") - F.col("prev_t")),
        "side_gap_us": F.when(F.col("side_prev_t").isNotNull() & same_side_inside,
                              F.col("ts_us") - F.col("side_prev_t")),
        "burst_us": F.greatest("run_t", "mark_t"),
        "ended_burst_us": F.when(~is_first & (F.col("ts_us") - F.col("prev_t") > F.lit(limits.idle)),
                                 F.col("prev_t") - F.greatest("run_t", "prev_mark_t"))})
            .drop("run_t", "run_seq", "prev_t", "side_prev_t", "side_prev_seq", "mark_t",
                  "prev_mark_t", "closes"))


def gap_sessions(packets: DataFrame, gap_us: int) -> DataFrame:
    """(flow_key, start_us, last_us, packets) of runs without a pause of `gap_us`, whatever the
    flags; the built-in session window would bring a whole key into one task."""
    cut = greedy_cuts(net.with_direction_key(packets), "flow_key", "ts_us", "seq", inactivity=gap_us)
    return (cut.groupBy("flow_key", F.col("run_t").alias("start_us"), "run_seq")
            .agg(F.max("ts_us").alias("last_us"), F.count("*").alias("packets")).drop("run_seq"))


def _squares(v: Column) -> Column:
    """The exact sum of squares as decimal(38,0). The values are added up in two halves of their
    bits, in plain longs; gaps of one flow sum to its time span, which keeps the halves in range."""
    high, low = F.shiftright(v, 20), v.bitwiseAND(F.lit((1 << 20) - 1))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)")
    return (whole(high * high) * F.lit(1 << 40) + whole(high * low) * F.lit(1 << 21) + whole(low * low)).cast("decimal(38,0)")


def _moments(name: str, value: Column, present: Column) -> list[Column]:
    v = F.when(present, value)
    return [F.count(v).alias(f"{name}_n"),
            F.coalesce(F.sum(v), F.lit(0)).alias(f"{name}_s"),
            _squares(v).alias(f"{name}_q"),
            F.coalesce(F.min(v), F.lit(0)).alias(f"{name}_min"),
            F.coalesce(F.max(v), F.lit(0)).alias(f"{name}_max")]


def flow_moments(cut: DataFrame, limits: FlowLimits = LIVE) -> DataFrame:
    """One row per flow with counts, sums, sums of squares, minima and maxima."""
    rows = cut.where(~F.col("absorbed"))
    fwd, bwd, every = F.col("is_fwd"), ~F.col("is_fwd"), F.lit(True)
    count = lambda cond: F.count(F.when(cond, 1))                       # noqa: E731
    size, gap, side_gap = F.col("payload_len").cast("long"), F.col("gap_us"), F.col("side_gap_us")
    ended = F.col("ended_burst_us")
    idle = F.when(gap > F.lit(limits.idle), gap)
    head = F.col("header_len").cast("long")
    return rows.groupBy(*FLOW, "run_side").agg(
        F.max("ts_us").alias("last_us"), F.max("burst_us").alias("burst_us"),
        *_moments("len", size, every), *_moments("len_f", size, fwd), *_moments("len_b", size, bwd),
        *_moments("iat", gap, every), *_moments("iat_f", side_gap, fwd),
        *_moments("iat_b", side_gap, bwd),
        *_moments("act", ended, ended > 0), *_moments("idle", idle, every),
        F.coalesce(F.sum(F.when(fwd, head)), F.lit(0)).alias("head_f"),
        F.coalesce(F.sum(F.when(bwd, head)), F.lit(0)).alias("head_b"),
        F.coalesce(F.sum(F.when(F.col("is_first"), F.col("tcp_window"))), F.lit(0)).alias("win_f"),
        F.coalesce(F.sum(F.when(bwd & side_gap.isNull(), F.col("tcp_window"))), F.lit(0)).alias("win_b"),
        count(fwd & (size > 0)).alias("data_f"),
        F.min(F.when(fwd & (head > 0), head)).alias("head_min"),
        F.sum(F.when(F.col("is_first"), head)).alias("head_first"),
        count(fwd & _flag("PSH")).alias("psh_f"),
        *[count(_flag(n)).alias(n.lower()) for n in ("FIN", "SYN", "RST", "PSH", "ACK")],
        F.max(F.col("is_port_scan").cast("int")).alias("scan"),
        F.max(F.col("is_conn_flood").cast("int")).alias("flood"))


def with_endpoints(flows: DataFrame) -> DataFrame:
    """Source and destination as seen by the first packet of the flow."""
    part = F.split("flow_key", r"\|")
    low_first = F.col("run_side") == 0
    pick = lambda a, b: F.when(low_first, part[a]).otherwise(part[b])
    return flows.withColumns({
        "src_ip": pick(0, 2), "src_port": pick(1, 3).cast("int"),
        "dst_ip": pick(2, 0), "dst_port": pick(3, 1).cast("int"),
        "protocol": net.protocol_number(part[4])})


def _mean(name: str) -> Column:
    return F.when(F.col(f"{name}_n") > 0, F.col(f"{name}_s") / F.col(f"{name}_n")).otherwise(F.lit(0.0))


def variance_from_sums(n: Column, s: Column, q: Column) -> Column:
    """Sample variance; 0 when there are fewer than two values. Rounded once, from exact sums."""
    whole = lambda c: c.cast("decimal(38,0)")
    spread = (whole(n) * whole(q)).cast("decimal(38,0)") - (whole(s) * whole(s)).cast("decimal(38,0)")
    return F.when(n > 1, spread.cast("double") / (n * (n - 1)).cast("double")).otherwise(F.lit(0.0))


def _var(name: str) -> Column:
    return variance_from_sums(F.col(f"{name}_n"), F.col(f"{name}_s"), F.col(f"{name}_q"))


def with_features(flows: DataFrame) -> DataFrame:
    """The 70 statistics, from `flow_moments` rows with endpoints."""
    d = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    udp = F.col("protocol") == "17"
    span = F.col("last_us") - F.col("start_us")
    single = F.col("len_n") <= 1
    # divisor of the rates in seconds: a lone TCP probe counts as 100 microseconds, several
    # packets at one instant as one microsecond
    seconds = F.when(single, F.lit(1e-4)).otherwise(F.greatest(span, F.lit(1)) / F.lit(1e6))
    rate = lambda c: F.when(single & udp, F.lit(0.0)).otherwise(d(c) / seconds)

    last_burst = F.col("last_us") - F.col("burst_us")
    extra = (last_burst > 0) | (F.col("act_n") == 0)
    flows = flows.withColumns({
        "act_min": F.when(~extra, F.col("act_min")).when(F.col("act_n") == 0, last_burst)
                    .otherwise(F.least(F.col("act_min"), last_burst)),
        "act_max": F.when(extra, F.greatest(F.col("act_max"), last_burst)).otherwise(F.col("act_max")),
        "act_q": F.when(extra, F.col("act_q") + (last_burst.cast("decimal(18,0)") * last_burst.cast("decimal(18,0)"))
                        .cast("decimal(38,0)")).otherwise(F.col("act_q")).cast("decimal(38,0)"),
        "act_s": F.when(extra, F.col("act_s") + last_burst).otherwise(F.col("act_s")),
        "act_n": F.when(extra, F.col("act_n") + 1).otherwise(F.col("act_n"))})

    default_head = F.when(udp, F.lit(8)).otherwise(F.lit(20)).cast("long")
    segment_min = (F.when(F.col("head_first") > 0, F.col("head_min"))
                   .otherwise(F.least(default_head, F.col("head_min"))))
    values = {
        "Src Port": d("src_port"), "Dst Port": d("dst_port"), "Protocol": F.col("protocol"),
        "Flow Duration": F.when(single & udp, F.lit(0.0)).when(span <= 0, F.lit(1.0)).otherwise(d(span)),
        "Total Fwd Packet": d("len_f_n"), "Total Bwd packets": d("len_b_n"),
        "Total Length of Fwd Packet": d("len_f_s"), "Total Length of Bwd Packet": d("len_b_s"),
        "Flow Bytes/s": rate("len_s"), "Flow Packets/s": rate("len_n"),
        "Fwd Packets/s": rate("len_f_n"),
        "Bwd Packets/s": F.when(single, F.lit(0.0)).otherwise(rate("len_b_n")),
        "Fwd IAT Total": d("iat_f_s"), "Bwd IAT Total": d("iat_b_s"),
        "Fwd PSH Flags": d("psh_f"),
        "Fwd Header Length": d("head_f"), "Bwd Header Length": d("head_b"),
        "Packet Length Variance": _var("len"),
        "Down/Up Ratio": F.when(F.col("len_f_n") > 0, F.col("len_b_n") / F.col("len_f_n"))
                          .otherwise(F.lit(0.0)),
        "Average Packet Size": _mean("len"),
        "Fwd Segment Size Avg": _mean("len_f"), "Bwd Segment Size Avg": _mean("len_b"),
        "Bwd Bytes/Bulk Avg": F.lit(0.0), "Bwd Packet/Bulk Avg": F.lit(0.0),
        "Bwd Bulk Rate Avg": F.lit(0.0),
        "Subflow Fwd Packets": d("len_f_n"), "Subflow Fwd Bytes": d("len_f_s"),
        "Subflow Bwd Packets": d("len_b_n"), "Subflow Bwd Bytes": d("len_b_s"),
        "FWD Init Win Bytes": d("win_f"), "Bwd Init Win Bytes": d("win_b"),
        "Fwd Act Data Pkts": d("data_f"), "Fwd Seg Size Min": d(segment_min),
    }
    for label, name in (("Packet Length", "len"), ("Fwd Packet Length", "len_f"),
                        ("Bwd Packet Length", "len_b"), ("Flow IAT", "iat"), ("Fwd IAT", "iat_f"),
                        ("Bwd IAT", "iat_b"), ("Active", "act"), ("Idle", "idle")):
        values |= {f"{label} Mean": _mean(name), f"{label} Std": F.sqrt(_var(name)),
                   f"{label} Max": d(f"{name}_max"), f"{label} Min": d(f"{name}_min")}
    for flag in ("FIN", "SYN", "RST", "PSH", "ACK"):
        values[f"{flag} Flag Count"] = d(flag.lower())
    # column names ignore case, so "Protocol" takes the place of "protocol"
    kept = [c for c in flows.columns if c != "protocol" and not c.startswith(("act_", "idle_"))]
    return flows.select(*kept, *[values[n].alias(n) for n in FEATURE_NAMES])


def with_summary(flows: DataFrame) -> DataFrame:
    """Summary columns used by logs and alerts."""
    span = F.greatest(F.col("last_us") - F.col("start_us"), F.lit(0))
    return flows.withColumns({
        "protocol_name": net.protocol_name(F.col("protocol")),
        "start_time": F.col("start_us") / F.lit(1e6), "last_time": F.col("last_us") / F.lit(1e6),
        "duration_sec": net.seconds_to_4_places(span),
        "total_packets": F.col("len_n"), "total_bytes": F.col("len_s"),
        "fwd_packets": F.col("len_f_n"), "bwd_packets": F.col("len_b_n"),
        "fwd_bytes": F.col("len_f_s"), "bwd_bytes": F.col("len_b_s")})


SUMMARY_COLUMNS = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol", "protocol_name",
                   "start_time", "last_time", "duration_sec", "total_packets", "total_bytes",
                   "fwd_packets", "bwd_packets"]


def build_flows(packets: DataFrame, limits: FlowLimits = LIVE, marks: dict | None = None) -> DataFrame:
    """Filtered packets to flows with features and summary."""
    moments = flow_moments(cut_into_flows(packets, limits, marks, _CARRIED), limits)
    flows = with_summary(with_features(with_endpoints(moments)))
    return (flows.withColumn("is_port_scan", F.col("scan") == 1)
            .withColumn("is_conn_flood", F.col("flood") == 1))


def features(flows: DataFrame) -> DataFrame:
    return flows.select(*[F.col(f"`{n}`") for n in FEATURE_NAMES])


def is_due(now_us: int, limits: FlowLimits = LIVE) -> Column:
    return ((F.col("fin") + F.col("rst") > 0)
            | (F.lit(now_us) - F.col("last_us") >= F.lit(limits.inactivity))
            | (F.lit(now_us) - F.col("start_us") >= F.lit(limits.active)))


def flush_expired(flows: DataFrame, now_us: int, limits: FlowLimits = LIVE,
                  force: bool = False) -> DataFrame:
    """Flows of a snapshot that are due for evaluation at `now_us`; all of them when forced."""
    return flows if force else flows.where(is_due(now_us, limits))


def aggregator_stats(flows: DataFrame, now_us: int, limits: FlowLimits = LIVE) -> DataFrame:
    """Packets taken in, flows flushed and flows still open as of `now_us`."""
    due = is_due(now_us, limits)
    return flows.agg(F.coalesce(F.sum("len_n"), F.lit(0)).alias("total_packets_processed"),
                     F.count_if(due).alias("total_flows_flushed"),
                     F.count_if(~due).alias("active_flows"))


def oldest_flows(flows: DataFrame, max_flows: int) -> DataFrame:
    """The flows a table capped at `max_flows` would let go first."""
    return flows.orderBy("last_us", "flow_key", "start_us", "start_seq").limit(
        max(10, int(0.05 * max_flows)))
