"""Packet filters, flow building, flow statistics and sliding-window marks."""

from pyspark.sql import functions as F

from wirelark.functions import net
from wirelark.operators import flows as fl
from wirelark.operators import heuristics
from wirelark.operators.cuts import NEVER
from wirelark.plans import packet_sql as sql
from wirelark.plans.catalog import query
from wirelark.sources import tables

# Sample traffic is thin: two attempts of a host pair in five seconds already count, as a scan if
# they go to two ports, else as a flood.
MARKS = dict(scan_threshold=2, flood_threshold=2)
MARKS_SQL = sql.attempt_marks("directed", 2, 2)
SYN_MARKS = dict(scan_threshold=12, flood_threshold=11)
SNAPSHOT_US = 300_000_000
RUN_LIMITS = fl.FlowLimits(linger=0)


def clean_packets(spark, sf_dir):
    return net.without_ports(net.unicast_only(net.tcp_udp_only(tables.raw_packets(spark, sf_dir))))


def live_flows(spark, sf_dir):
    return fl.build_flows(clean_packets(spark, sf_dir))


def marked_flows(spark, sf_dir):
    return fl.build_flows(clean_packets(spark, sf_dir), marks=MARKS)


_PACKET_COLUMNS = "seq, src_ip, src_port, dst_ip, dst_port, proto, payload_len, ts_us"


def _packet_columns(df):
    return df.select(*_PACKET_COLUMNS.split(", "))


@query("tcp_udp_only", f"WITH {sql.RAW_PACKETS} SELECT {_PACKET_COLUMNS} FROM raw_packets "
       "WHERE proto IN ('6', '17')")
def tcp_udp_only(spark, sf_dir):
    return _packet_columns(net.tcp_udp_only(tables.raw_packets(spark, sf_dir)))


@query("drop_broadcast", f"""WITH {sql.RAW_PACKETS} SELECT {_PACKET_COLUMNS} FROM raw_packets
  WHERE NOT regexp_matches(src_ip, '(\\.255$)|^(22[4-9]|23[0-9])\\.')
    AND NOT regexp_matches(dst_ip, '(\\.255$)|^(22[4-9]|23[0-9])\\.')""")
def drop_broadcast(spark, sf_dir):
    return _packet_columns(net.unicast_only(tables.raw_packets(spark, sf_dir)))


@query("drop_discovery_ports", f"""WITH {sql.RAW_PACKETS} SELECT {_PACKET_COLUMNS} FROM raw_packets
  WHERE NOT list_contains([1900,5353,5355,137,138,27036,67,68], src_port)
    AND NOT list_contains([1900,5353,5355,137,138,27036,67,68], dst_port)""")
def drop_discovery_ports(spark, sf_dir):
    return _packet_columns(net.without_ports(tables.raw_packets(spark, sf_dir)))


_LETTERS = {"signup": "S", "click": "A", "view": "A", "purchase": "PA", "error": "RFAUEC"}
_LETTER_SQL = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in _LETTERS.items()) + " ELSE '' END"


@query("tcp_flags", "SELECT seq, " + ", ".join(
    f"contains(letters, '{n[0]}') AS {n.lower()}" for n in
    ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR"))
    + f" FROM (SELECT event_id AS seq, {_LETTER_SQL} AS letters FROM events)")
def tcp_flags(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    flags = net.flags_from_letters(F.expr(_LETTER_SQL))
    return events.select(F.col("event_id").alias("seq"), flags.alias("f")).select(
        "seq", *[F.col(f"f.{n}").alias(n.lower()) for n in net.TCP_FLAG_NAMES])


@query("protocol_norm", """
  SELECT l_linenumber AS line, label AS proto,
    CASE WHEN label IN (' tcp ', '6', '6.0') THEN '6' WHEN label IN ('UDP', '17') THEN '17'
         ELSE label END AS number,
    CASE WHEN label IN (' tcp ', '6', '6.0') THEN 'TCP' WHEN label IN ('UDP', '17') THEN 'UDP'
         ELSE 'Proto-' || label END AS name, count(*) AS n
  FROM (SELECT l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN ' tcp ' WHEN 1 THEN '6'
          WHEN 2 THEN '6.0' WHEN 3 THEN 'UDP' WHEN 4 THEN '17' WHEN 5 THEN '1' ELSE 'GRE' END AS label
        FROM lineitem) GROUP BY ALL""")
def protocol_norm(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, (" tcp ", "6", "6.0", "UDP", "17", "1", "GRE"))),
                         F.col("l_linenumber") % 7 + 1)
    return (tables.table(spark, sf_dir, "lineitem").withColumn("proto", label)
            .groupBy(F.col("l_linenumber").alias("line"), "proto",
                     net.protocol_number(F.col("proto")).alias("number"),
                     net.protocol_name(F.col("proto")).alias("name"))
            .agg(F.count("*").alias("n")))


@query("flow_id", f"""WITH {sql.RAW_PACKETS} SELECT seq, src_ip || '-' || dst_ip || '-' || src_port
  || '-' || dst_port || '-' || proto AS flow_id FROM raw_packets""")
def flow_id(spark, sf_dir):
    c = F.col
    return tables.raw_packets(spark, sf_dir).select("seq", net.flow_id(
        c("src_ip"), c("dst_ip"), c("src_port"), c("dst_port"), c("proto")).alias("flow_id"))


@query("bidir_flow_key", sql.live_flows()
       + " SELECT seq, flow_key, start_us, start_seq, fwd AS is_fwd FROM numbered")
def bidir_flow_key(spark, sf_dir):
    cut = fl.cut_into_flows(clean_packets(spark, sf_dir)).where(~F.col("absorbed"))
    return cut.select("seq", *fl.FLOW, "is_fwd")


_GROUPS = {
    "flow_duration": ["Flow Duration"],
    "flow_volume": ["Total Fwd Packet", "Total Bwd packets", "Total Length of Fwd Packet",
                    "Total Length of Bwd Packet"],
    "flow_pktlen_stats": [f"{p}Packet Length {s}" for p in ("", "Fwd ", "Bwd ")
                          for s in ("Max", "Min", "Mean", "Std")] + ["Packet Length Variance"],
    "flow_rates": ["Flow Bytes/s", "Flow Packets/s", "Fwd Packets/s", "Bwd Packets/s"],
    "flow_iat": [f"{p} IAT {s}" for p in ("Flow", "Fwd", "Bwd")
                 for s in ("Mean", "Std", "Max", "Min")] + ["Fwd IAT Total", "Bwd IAT Total"],
    "flow_flags": ["Fwd PSH Flags"] + [f"{f} Flag Count" for f in ("FIN", "SYN", "RST", "PSH", "ACK")],
    "flow_headers": ["Fwd Header Length", "Bwd Header Length", "FWD Init Win Bytes",
                     "Bwd Init Win Bytes", "Fwd Act Data Pkts", "Fwd Seg Size Min"],
    "flow_ratios": ["Down/Up Ratio", "Average Packet Size", "Fwd Segment Size Avg",
                    "Bwd Segment Size Avg", "Subflow Fwd Packets", "Subflow Fwd Bytes",
                    "Subflow Bwd Packets", "Subflow Bwd Bytes", "Bwd Bytes/Bulk Avg",
                    "Bwd Packet/Bulk Avg", "Bwd Bulk Rate Avg"],
    "flow_active_idle": [f"{p} {s}" for p in ("Active", "Idle") for s in ("Mean", "Std", "Max", "Min")],
    "flow_features70": fl.FEATURE_NAMES,
}


def feature_columns(names):
    """The columns as they are compared: deviations to the places that engines agree on."""
    def column(n):
        c = F.col(f"`{n}`")
        return c if sql.places(n) is None else F.round(c, sql.places(n)).alias(n)
    return [column(n) for n in names]


def _feature_query(names):
    return lambda spark, sf_dir: live_flows(spark, sf_dir).select(*fl.FLOW, *feature_columns(names))


for _name, _columns in _GROUPS.items():
    query(_name, sql.live_flows() + " SELECT flow_key, start_us, start_seq, "
          + sql.feature_list(_columns) + " FROM flow")(_feature_query(_columns))


_SUMMARY_SQL = f"""flow_key, start_us, start_seq, src_ip, src_port, dst_ip, dst_port, protocol,
  CASE protocol WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' ELSE 'Proto-' || protocol END AS protocol_name,
  start_us / 1e6 AS start_time, last_us / 1e6 AS last_time,
  {sql.seconds_to_4_places('span')} AS duration_sec, len_n AS total_packets, len_s::BIGINT AS total_bytes,
  len_f_n AS fwd_packets, len_b_n AS bwd_packets"""


@query("flow_summary", sql.live_flows() + f" SELECT {_SUMMARY_SQL} FROM flow")
def flow_summary(spark, sf_dir):
    return live_flows(spark, sf_dir).select(*fl.FLOW, *fl.SUMMARY_COLUMNS)


_RUN_SQL = """ SELECT flow_key, start_us, start_seq, max(ts_us) AS last_us, count(*) AS packets,
  bool_or(f_fin OR f_rst) AS finished FROM numbered GROUP BY flow_key, start_us, start_seq"""


def _runs(packets, limits):
    cut = fl.cut_into_flows(packets, limits).where(~F.col("absorbed"))
    finished = F.coalesce(F.col("tcp_flags.FIN") | F.col("tcp_flags.RST"), F.lit(False))
    return cut.groupBy(*fl.FLOW).agg(F.max("ts_us").alias("last_us"), F.count("*").alias("packets"),
                                     F.max(finished).alias("finished"))


@query("flow_sessions", sql.live_flows(active=1 << 60, linger=0) + _RUN_SQL)
def flow_sessions(spark, sf_dir):
    return _runs(clean_packets(spark, sf_dir), fl.FlowLimits(active=NEVER, linger=0))


@query("flow_active_cut", sql.live_flows(inactivity=1 << 60, active=20_000_000) + _RUN_SQL)
def flow_active_cut(spark, sf_dir):
    return _runs(clean_packets(spark, sf_dir), fl.FlowLimits(inactivity=NEVER, active=20_000_000))


@query("flow_replay", sql.live_flows(inactivity=1 << 60, active=1 << 60, linger=1 << 60) + _RUN_SQL)
def flow_replay(spark, sf_dir):
    return _runs(clean_packets(spark, sf_dir), fl.REPLAY)


@query("flow_sessions_simple", "WITH " + sql.CLEAN_PACKETS + sql.DIRECTED + """,
  g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w < 10000000 THEN 0 ELSE 1 END AS fresh
        FROM directed WINDOW w AS (PARTITION BY flow_key ORDER BY ts_us, seq)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY flow_key ORDER BY ts_us, seq) AS session FROM g)
  SELECT flow_key, min(ts_us) AS start_us, max(ts_us) AS last_us, count(*) AS packets
  FROM s GROUP BY flow_key, session""")
def flow_sessions_simple(spark, sf_dir):
    sessions = fl.gap_sessions(clean_packets(spark, sf_dir), 10_000_000)
    return sessions.select("flow_key", "start_us", "last_us", "packets")


@query("flow_early_emit", sql.live_flows(MARKS_SQL) + _RUN_SQL.replace(
    "bool_or(f_fin", "bool_or(scan_mark OR flood_mark OR f_fin"))
def flow_early_emit(spark, sf_dir):
    cut = fl.cut_into_flows(clean_packets(spark, sf_dir), marks=MARKS).where(~F.col("absorbed"))
    ended = (F.coalesce(F.col("tcp_flags.FIN") | F.col("tcp_flags.RST"), F.lit(False))
             | F.col("is_port_scan") | F.col("is_conn_flood"))
    return cut.groupBy(*fl.FLOW).agg(F.max("ts_us").alias("last_us"), F.count("*").alias("packets"),
                                     F.max(ended).alias("finished"))


@query("flow_heuristic_flags", sql.live_flows(MARKS_SQL)
       + " SELECT flow_key, start_us, start_seq, is_port_scan, is_conn_flood FROM flow")
def flow_heuristic_flags(spark, sf_dir):
    return marked_flows(spark, sf_dir).select(*fl.FLOW, "is_port_scan", "is_conn_flood")


SYN_SQL = """WITH raw AS (
  SELECT event_id AS seq, '10.1.0.' || (user_id // 75 + 1) AS src_ip, '192.168.2.1' AS dst_ip,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS dst_port,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 5000 // 100000 * 100000 AS ts_us,
    '6' AS proto, true AS f_syn, false AS f_ack
  FROM events WHERE event_type = 'signup')""" + sql.attempt_marks("raw", 12, 11)


def _marked_syns(spark, sf_dir):
    return heuristics.mark_attempts(tables.syn_packets(spark, sf_dir), **SYN_MARKS)


@query("port_scan", SYN_SQL + " SELECT m.seq, src_ip, dst_ip, ts_us, ports AS scan_ports, "
       "scan_mark AS is_port_scan FROM marked m JOIN counted c USING (seq)")
def port_scan(spark, sf_dir):
    return _marked_syns(spark, sf_dir).select("seq", "src_ip", "dst_ip", "ts_us", "scan_ports",
                                              "is_port_scan")


@query("conn_flood", SYN_SQL + " SELECT m.seq, src_ip, dst_ip, ts_us, attempts AS flood_attempts, "
       "flood_mark AS is_conn_flood FROM marked m JOIN counted c USING (seq)")
def conn_flood(spark, sf_dir):
    return _marked_syns(spark, sf_dir).select("seq", "src_ip", "dst_ip", "ts_us", "flood_attempts",
                                              "is_conn_flood")


_SNAPSHOT = sql.live_flows().replace("AND dst_port NOT IN (1900",
                                     f"AND ts_us <= {SNAPSHOT_US} AND dst_port NOT IN (1900")
_DUE = (f"(fin + rst > 0 OR {SNAPSHOT_US} - last_us >= 10000000 "
        f"OR {SNAPSHOT_US} - start_us >= 60000000)")


def _snapshot(spark, sf_dir):
    return fl.build_flows(clean_packets(spark, sf_dir).where(F.col("ts_us") <= SNAPSHOT_US))


@query("flush_expired", _SNAPSHOT + " SELECT flow_key, start_us, start_seq, last_us, "
       f"len_n AS total_packets FROM flow WHERE {_DUE}")
def flush_expired(spark, sf_dir):
    return fl.flush_expired(_snapshot(spark, sf_dir), SNAPSHOT_US).select(
        *fl.FLOW, "last_us", "total_packets")


@query("aggregator_stats", _SNAPSHOT + " SELECT sum(len_n)::BIGINT AS total_packets_processed, "
       f"count(*) FILTER ({_DUE}) AS total_flows_flushed, "
       f"count(*) FILTER (NOT {_DUE}) AS active_flows FROM flow")
def aggregator_stats(spark, sf_dir):
    return fl.aggregator_stats(_snapshot(spark, sf_dir), SNAPSHOT_US)


@query("oldest_flows", sql.live_flows() + " SELECT flow_key, start_us, start_seq, last_us FROM flow "
       "ORDER BY last_us, flow_key, start_us, start_seq LIMIT 50")
def oldest_flows(spark, sf_dir):
    return fl.oldest_flows(live_flows(spark, sf_dir), 1000).select(*fl.FLOW, "last_us")
