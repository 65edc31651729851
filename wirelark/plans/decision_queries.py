"""Decisions, alerts and detection logs."""

from pyspark.sql import functions as F

from wirelark.functions import net
from wirelark.operators import alerts, auditlog, decide
from wirelark.operators import flows as fl
from wirelark.plans import packet_sql as sql
from wirelark.plans.catalog import query
from wirelark.plans.flow_queries import MARKS, MARKS_SQL, clean_packets
from wirelark.sources import tables
from wirelark.sources.scratch import shared_folder

HOST = "probe-1"
COOLDOWN_US = 10_000_000


def score_sql(source: str, row: str, k: str, scan: str, flood: str) -> str:
    names = ", ".join(f"'{c}'" for c in tables.ATTACK_CLASSES)
    return f"""
weighted AS (SELECT *, {row} AS rid, {k} AS kk, {scan} AS scan, {flood} AS flood,
    list_transform(range(10), lambda i: CAST(CASE WHEN {row} % 37 = 0 THEN CASE WHEN i = 2 THEN 1 ELSE 0 END
      ELSE ({k} * (i + 3) + {row} * (i + 1)) % 17 + CASE WHEN i = 2 THEN 1 ELSE 0 END END AS DOUBLE)) AS w
  FROM {source}),
scored AS (SELECT *, [{names}] AS dtc, list_transform(w, lambda x: x / list_sum(w)) AS dtp,
    rid % 29 <> 0 AND rid % 31 <> 0 AS works,
    (100 - kk) / 100.0::DOUBLE AS p0, kk / 100.0::DOUBLE AS p1 FROM weighted),
tops AS (SELECT *, dtc[list_position(dtp, list_max(dtp))] AS top,
    list_filter(dtp, lambda x, i: i <> 3) AS atk, list_filter(dtc, lambda x, i: i <> 3) AS atkc
  FROM scored),
stage2 AS (SELECT *,
    CASE WHEN top <> 'Benign' THEN top
         WHEN list_max(atk) > 0 THEN atkc[list_position(atk, list_max(atk))]
         ELSE 'Maligno (Indeterminado)' END AS second,
    CASE WHEN top <> 'Benign' THEN list_max(dtp) WHEN list_max(atk) > 0 THEN list_max(atk)
         ELSE 0.0 END AS second_conf
  FROM tops),
verdict AS (SELECT *, works AND (p1 >= 0.5 OR scan OR flood) AS is_attack,
    flood OR (scan AND p1 < 0.5) AS by_rule FROM stage2),
decided AS (SELECT *,
    CASE WHEN NOT works THEN 'Error' WHEN NOT is_attack THEN 'Benign' WHEN flood THEN 'DoS'
         WHEN by_rule THEN 'Reconnaissance' ELSE second END AS attack_type,
    CASE WHEN NOT works THEN 0.0 WHEN NOT is_attack THEN p0 WHEN by_rule THEN 0.99 ELSE p1 END AS probability,
    CASE WHEN NOT works THEN NULL WHEN is_attack AND by_rule THEN 0.99 ELSE p1 END AS binary_probability,
    CASE WHEN is_attack THEN CASE WHEN flood THEN 'DoS' WHEN by_rule THEN 'Reconnaissance'
         ELSE second END END AS dt_attack_type,
    CASE WHEN NOT works THEN NULL WHEN NOT is_attack THEN 0.0 WHEN by_rule THEN 0.99
         ELSE second_conf END AS dt_confidence,
    CASE WHEN is_attack AND NOT by_rule THEN dtp[4] END AS p_dos,
    CASE WHEN works THEN CASE WHEN is_attack AND NOT by_rule THEN 10 ELSE 0 END END AS n_classes
  FROM verdict)"""


_EVENTS_SCORED = ("WITH ev AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k "
                  "FROM events)," + score_sql("ev", "event_id", "k", "event_id % 11 = 0",
                                              "event_id % 13 = 0"))
_VERDICT = ["is_attack", "attack_type", "probability", "binary_probability", "dt_attack_type",
            "dt_confidence"]
_NUMBERS = ("is_attack", "attack_type", "probability::DOUBLE AS probability",
            "binary_probability::DOUBLE AS binary_probability", "dt_attack_type",
            "dt_confidence::DOUBLE AS dt_confidence")
_VERDICT_SQL = ", ".join(_NUMBERS)


@query("decide_binary", _EVENTS_SCORED + f" SELECT event_id AS seq, {_VERDICT_SQL}, p_dos, n_classes FROM decided")
def decide_binary(spark, sf_dir):
    return decide.decide_binary(tables.scored_events(spark, sf_dir)).select(
        "seq", *_VERDICT, F.try_element_at("dt_probabilities", F.lit("DoS")).alias("p_dos"),
        F.when(F.col("dt_probabilities").isNotNull(), F.size("dt_probabilities")).alias("n_classes"))


@query("cascade_label", _EVENTS_SCORED + " SELECT event_id AS seq, second AS label, "
       "second_conf::DOUBLE AS confidence FROM stage2")
def cascade_label(spark, sf_dir):
    second = decide.with_second_stage(tables.scored_events(spark, sf_dir))
    return second.select("seq", "second.label", "second.confidence")


@query("argmax_class", _EVENTS_SCORED + " SELECT event_id AS seq, top AS label, list_max(dtp) AS p FROM tops")
def argmax_class(spark, sf_dir):
    return tables.scored_events(spark, sf_dir).select(
        "seq", decide.best(F.col("dt_classes"), F.col("dt_proba")).alias("b")).select(
        "seq", "b.label", "b.p")


@query("decide_multiclass", _EVENTS_SCORED + """
  SELECT event_id AS seq, works2 AND (model OR scan OR flood) AS is_attack,
    CASE WHEN NOT works2 THEN 'Error' WHEN flood THEN 'DoS' WHEN scan AND NOT model THEN 'Reconnaissance'
         WHEN model THEN top ELSE 'Benign' END AS attack_type,
    CASE WHEN NOT works2 THEN 0.0 WHEN flood OR (scan AND NOT model) THEN 0.99
         ELSE list_max(dtp) END::DOUBLE AS probability
  FROM (SELECT *, rid % 29 <> 0 AS works2, top <> 'Benign' AND list_max(dtp) >= 0.2 AS model FROM tops)""")
def decide_multiclass(spark, sf_dir):
    scored = tables.scored_events(spark, sf_dir).withColumn("classes", F.col("dt_classes")).withColumn(
        "proba", F.when(F.col("event_id") % 29 != 0, F.col("dt_proba")))
    return decide.decide_multiclass(scored, threshold=0.2).select(
        "seq", "is_attack", "attack_type", "probability")


@query("decide_error", _EVENTS_SCORED + " SELECT event_id AS seq, false AS is_attack, "
       "'Error' AS attack_type, 0.0::DOUBLE AS probability FROM scored WHERE NOT works")
def decide_error(spark, sf_dir):
    return decide.decide_binary(tables.scored_events(spark, sf_dir)).where(
        F.col("attack_type") == decide.ERROR).select("seq", "is_attack", "attack_type", "probability")


_DETECTIONS = (sql.live_flows(MARKS_SQL) + ","
               + score_sql("flow", "start_seq", "start_seq % 100", "is_port_scan", "is_conn_flood"))


def detections(spark, sf_dir):
    """Packets to decided flows; every packet table is read whole."""
    flows = fl.build_flows(clean_packets(spark, sf_dir), marks=MARKS)
    scored = tables.with_sample_scores(flows, F.col("start_seq"), F.col("start_seq") % 100)
    return decide.decide_binary(scored).withColumns({"seq": F.col("start_seq"), "ts_us": F.col("last_us")})


@query("detect_end_to_end", _DETECTIONS + f""" SELECT flow_key, start_us, start_seq, {_VERDICT_SQL},
  is_port_scan, is_conn_flood, len_n AS total_packets, len_s::BIGINT AS total_bytes FROM decided""")
def detect_end_to_end(spark, sf_dir):
    return detections(spark, sf_dir).select(*fl.FLOW, *_VERDICT, "is_port_scan", "is_conn_flood",
                                            "total_packets", "total_bytes")


@query("detector_stats", _DETECTIONS + """ SELECT count(*) AS total_flows_evaluated,
  count(*) FILTER (is_attack) AS total_attacks_detected FROM decided""")
def detector_stats(spark, sf_dir):
    return decide.detector_stats(detections(spark, sf_dir))


@query("attack_type_counts", _DETECTIONS + " SELECT attack_type, count(*) AS n FROM decided "
       "WHERE is_attack GROUP BY attack_type")
def attack_type_counts(spark, sf_dir):
    return decide.attack_type_counts(detections(spark, sf_dir))


def throttle_sql(cooldown: int) -> str:
    """Walks each key event by event; expects `ev` with alert_key, ts_us, seq."""
    return f"""
el AS (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY ts_us, seq) AS ern FROM ev),
ew AS (
  SELECT alert_key, ern, ts_us AS last_sent, true AS sent, 0 AS held, 0 AS shown FROM el WHERE ern = 1
  UNION ALL
  SELECT n.alert_key, n.ern,
    CASE WHEN n.ts_us - w.last_sent >= {cooldown} THEN n.ts_us ELSE w.last_sent END,
    n.ts_us - w.last_sent >= {cooldown},
    CASE WHEN n.ts_us - w.last_sent >= {cooldown} THEN 0 ELSE w.held + 1 END,
    CASE WHEN n.ts_us - w.last_sent >= {cooldown} THEN w.held ELSE w.held + 1 END
  FROM ew w JOIN el n ON n.alert_key = w.alert_key AND n.ern = w.ern + 1),
throttled AS (SELECT el.*, ew.sent, ew.shown::BIGINT AS suppressed_count FROM el JOIN ew USING (alert_key, ern))"""


_ALERT_EVENTS = """WITH RECURSIVE ev AS (
  SELECT event_id AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 5000 AS ts_us,
    '10.0.0.' || (user_id % 20) AS src_ip, event_type AS attack_type,
    '10.0.0.' || (user_id % 20) || '_' || event_type AS alert_key
  FROM events WHERE event_type IN ('error', 'purchase')),""" + throttle_sql(COOLDOWN_US)


def throttled_events(spark, sf_dir):
    events = tables.alert_events(spark, sf_dir).withColumn(
        "alert_key", alerts.throttle_key(F.col("src_ip"), F.col("attack_type")))
    return alerts.throttle(events, COOLDOWN_US)


@query("alert_cooldown", _ALERT_EVENTS + " SELECT seq, alert_key, ts_us, sent FROM throttled")
def alert_cooldown(spark, sf_dir):
    return throttled_events(spark, sf_dir).select("seq", "alert_key", "ts_us", "sent")


@query("alert_suppressed", _ALERT_EVENTS + " SELECT seq, alert_key, sent, suppressed_count FROM throttled")
def alert_suppressed(spark, sf_dir):
    return throttled_events(spark, sf_dir).select("seq", "alert_key", "sent", "suppressed_count")


@query("alert_totals", _ALERT_EVENTS + " SELECT count(*) FILTER (sent) AS alerts_sent, "
       "count(*) FILTER (NOT sent) AS alerts_suppressed FROM throttled")
def alert_totals(spark, sf_dir):
    return alerts.throttle_totals(throttled_events(spark, sf_dir))


_STYLE = alerts.AlertStyle(product="Sensor", device="edge", hostname=HOST, cooldown_seconds=10)
_NAMED = _DETECTIONS + f""",
named AS (SELECT *, CASE protocol WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' ELSE 'Proto-' || protocol END
    AS protocol_name, {sql.seconds_to_4_places('span')} AS duration_sec, len_n AS total_packets,
    len_s::BIGINT AS total_bytes, src_ip || '_' || attack_type AS alert_key,
    start_seq AS seq, last_us AS ts_us FROM decided)"""
_ALERTS = _NAMED + ", ev AS (SELECT * EXCLUDE (ts_us, seq), last_us AS ts_us, start_seq AS seq FROM named WHERE is_attack)," \
    + throttle_sql(COOLDOWN_US)


def sent_alerts(spark, sf_dir):
    payload = alerts.alert_payload(detections(spark, sf_dir), interface="eth0").withColumn(
        "alert_key", alerts.throttle_key(F.col("src_ip"), F.col("attack_type")))
    return alerts.throttle(payload, COOLDOWN_US).where("sent")


_PAYLOAD = ["seq", "attack_type", "probability", "src_ip", "src_port", "dst_ip", "dst_port",
            "protocol_name", "duration_sec", "total_packets", "total_bytes", "interface",
            "alert_key", "suppressed_count"]


@query("alerts", _ALERTS + """ SELECT seq, attack_type, probability::DOUBLE AS probability, src_ip, src_port,
  dst_ip, dst_port, protocol_name, duration_sec, total_packets, total_bytes, 'eth0' AS interface, alert_key,
  suppressed_count FROM throttled WHERE sent""")
def alerts_table(spark, sf_dir):
    return sent_alerts(spark, sf_dir).select(*_PAYLOAD)


@query("alert_text", _ALERTS + """ SELECT seq,
  '🚨 [Sensor] Alerta de Segurança: ' || attack_type || ' detectado de ' || src_ip AS subject,
  repeat('=', 53) || chr(10) || '🚨 [Sensor] ALERTA DE INTRUSÃO DETECTADA' || chr(10) || repeat('=', 53) || chr(10)
  || 'Dispositivo : edge (probe-1)' || chr(10) || 'Interface   : eth0' || chr(10)
  || 'Timestamp   : ' || strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') || chr(10) || chr(10)
  || 'DETALHES DO ATAQUE:' || chr(10) || repeat('-', 53) || chr(10)
  || 'Classificação : ' || attack_type || chr(10)
  || 'Confiança     : ' || printf('%.2f', probability::DOUBLE * 100) || '%' || chr(10)
  || 'Origem        : ' || src_ip || ':' || src_port || chr(10)
  || 'Destino       : ' || dst_ip || ':' || dst_port || chr(10)
  || 'Protocolo     : ' || protocol_name || chr(10) || chr(10)
  || 'ESTATÍSTICAS DO FLUXO:' || chr(10) || repeat('-', 53) || chr(10)
  || 'Duração Total : ' || printf('%.4f', duration_sec) || ' s' || chr(10)
  || 'Total Pacotes : ' || total_packets || chr(10)
  || 'Total Volume  : ' || format('{:,}', total_bytes) || ' bytes' || chr(10)
  || CASE WHEN suppressed_count > 0 THEN chr(10) || '[AVISO ANTI-FLOOD]: ' || suppressed_count
     || ' evento(s) semelhante(s) foram agregados durante a janela de cooldown de 10s.' || chr(10)
     ELSE '' END || chr(10)
  || 'Ação Recomendada: Verificar regras de firewall (iptables/nftables) para o IP ' || src_ip || '.' || chr(10)
  || repeat('=', 53) || chr(10) AS text
  FROM throttled WHERE sent""")
def alert_text(spark, sf_dir):
    return alerts.render(sent_alerts(spark, sf_dir), _STYLE).select("seq", "subject", "text")


_RECORDS = _NAMED + f""",
rec AS (SELECT start_seq AS seq, strftime(make_timestamp(last_us), '%Y-%m-%d %H:%M:%S.%g') AS timestamp,
  {sql.seconds_to_4_places('last_us')} AS epoch,
  CASE WHEN is_attack THEN 'INTRUSION_DETECTED' ELSE 'BENIGN_FLOW' END AS event, attack_type, is_attack,
  round_even(probability::DOUBLE, 4) AS confidence, printf('%.2f', probability::DOUBLE * 100) || '%' AS confidence_pct,
  dt_attack_type, round_even(coalesce(dt_confidence, 0.0)::DOUBLE, 4) AS dt_confidence,
  src_ip, src_port, dst_ip, dst_port, protocol_name AS protocol, 'eth0' AS interface, duration_sec,
  total_packets, total_bytes, len_f_n AS fwd_packets, len_b_n AS bwd_packets,
  len_f_s::BIGINT AS fwd_bytes, len_b_s::BIGINT AS bwd_bytes,
  CASE WHEN duration_sec > 0 THEN round_even(total_packets / duration_sec, 2) ELSE total_packets::DOUBLE END AS packets_per_sec,
  CASE WHEN duration_sec > 0 THEN round_even(total_bytes / duration_sec, 2) ELSE total_bytes::DOUBLE END AS bytes_per_sec,
  len_min::INTEGER AS length_min, len_max::INTEGER AS length_max,
  round_even(total_bytes::DOUBLE / total_packets, 2) AS length_mean,
  CASE WHEN is_attack AND src_ip <> '0.0.0.0' THEN 'sudo iptables -A INPUT -s ' || src_ip || ' -j DROP'
       ELSE 'N/A' END AS mitigation_rule, '{HOST}' AS hostname, last_us, fin, syn, rst, psh, ack, p_dos
  FROM named)"""


def recs(spark, sf_dir, log_all=True):
    return auditlog.records(auditlog.to_log(detections(spark, sf_dir), log_all=log_all), "eth0", HOST)


_CSV = ", ".join(auditlog.DETECTION_CSV_COLUMNS)
_WIDE = (f"seq, {_CSV}, confidence_pct, dt_attack_type, dt_confidence, length_min, length_max, "
         "length_mean, hostname")


@query("log_record", _RECORDS + f" SELECT {_WIDE} FROM rec")
def log_record(spark, sf_dir):
    return recs(spark, sf_dir).select(*_WIDE.split(", "))


@query("log_filter", _RECORDS + " SELECT seq, attack_type FROM rec WHERE is_attack")
def log_filter(spark, sf_dir):
    return recs(spark, sf_dir, log_all=False).select("seq", "attack_type")


@query("log_csv", _RECORDS + f" SELECT {_CSV} FROM rec")
def log_csv(spark, sf_dir):
    return auditlog.csv_rows(recs(spark, sf_dir))


_TEXT_SQL = """'[' || timestamp || '] [' || event || '] Type: ' || attack_type || ' (Conf: ' || confidence_pct
  || ') | ' || src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port || ' (' || protocol
  || ') | Pkts: ' || total_packets || ', Bytes: ' || format('{:,}', total_bytes) || ', Dur: '
  || printf('%.4f', duration_sec) || 's | Action: ' || mitigation_rule"""


@query("log_text", _RECORDS + f" SELECT seq, {_TEXT_SQL} AS line FROM rec")
def log_text(spark, sf_dir):
    return auditlog.text_lines(recs(spark, sf_dir)).select("seq", "line")


_JSON_FIELDS = {
    "epoch": "double", "event": "string", "attack_type": "string", "is_attack": "boolean",
    "confidence": "double", "dt_attack_type": "string", "dt_confidence": "double",
    "dt_probabilities": "map<string,double>",
    "source": "struct<ip:string,port:int>", "destination": "struct<ip:string,port:int>",
    "protocol": "string", "flow_metrics": "struct<total_bytes:bigint,bytes_per_sec:double>",
    "packet_stats": "struct<length_max:int,tcp_flags:struct<FIN:bigint,ACK:bigint>>",
    "mitigation_rule": "string", "hostname": "string", "timestamp": "string"}
_JSON_SCHEMA = ", ".join(f"{n} {t}" for n, t in _JSON_FIELDS.items())
_JSON_SQL = """timestamp, epoch, event, attack_type, is_attack, confidence, dt_attack_type, dt_confidence,
  src_ip, src_port, dst_ip, dst_port, protocol, total_bytes, bytes_per_sec, length_max, fin, ack,
  mitigation_rule, hostname, p_dos"""


def _json_scalars(parsed):
    return parsed.select(
        "timestamp", "epoch", "event", "attack_type", "is_attack", "confidence", "dt_attack_type",
        "dt_confidence", F.col("source.ip").alias("src_ip"), F.col("source.port").alias("src_port"),
        F.col("destination.ip").alias("dst_ip"), F.col("destination.port").alias("dst_port"),
        "protocol", "flow_metrics.total_bytes", "flow_metrics.bytes_per_sec",
        "packet_stats.length_max", F.col("packet_stats.tcp_flags.FIN").alias("fin"),
        F.col("packet_stats.tcp_flags.ACK").alias("ack"), "mitigation_rule", "hostname",
        F.try_element_at("dt_probabilities", F.lit("DoS")).alias("p_dos"))


@query("log_json", _RECORDS + f" SELECT {_JSON_SQL} FROM rec")
def log_json(spark, sf_dir):
    lines = auditlog.json_lines(recs(spark, sf_dir)).select("line")
    return _json_scalars(lines.select(F.from_json("line", _JSON_SCHEMA).alias("r")).select("r.*"))


@query("sink_jsonl", _RECORDS + f" SELECT {_JSON_SQL} FROM rec")
def sink_jsonl(spark, sf_dir):
    path = shared_folder(spark, "jsonl") + "/detections.jsonl"
    auditlog.write(recs(spark, sf_dir), path)
    return _json_scalars(spark.read.schema(_JSON_SCHEMA).json(path))


_CSV_READ = ("timestamp string, epoch double, event string, attack_type string, is_attack boolean, "
             "confidence double, src_ip string, src_port int, dst_ip string, dst_port int, "
             "protocol string, interface string, duration_sec double, total_packets bigint, "
             "total_bytes bigint, fwd_packets bigint, bwd_packets bigint, fwd_bytes bigint, "
             "bwd_bytes bigint, packets_per_sec double, bytes_per_sec double, mitigation_rule string")


@query("sink_csv", _RECORDS + f" SELECT {_CSV} FROM rec")
def sink_csv(spark, sf_dir):
    path = shared_folder(spark, "csv") + "/detections.csv"
    auditlog.write(recs(spark, sf_dir), path)
    return spark.read.schema(_CSV_READ).option("header", True).csv(path)


@query("sink_text", _RECORDS + f" SELECT {_TEXT_SQL} AS line FROM rec")
def sink_text(spark, sf_dir):
    path = shared_folder(spark, "text") + "/detections.log"
    auditlog.write(recs(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("sink_both", _RECORDS + " SELECT 'csv' AS kind, attack_type, count(*) AS n FROM rec GROUP BY ALL "
       "UNION ALL SELECT 'jsonl', attack_type, count(*) FROM rec GROUP BY ALL")
def sink_both(spark, sf_dir):
    path = shared_folder(spark, "both") + "/detections"
    auditlog.write(recs(spark, sf_dir), path + ".jsonl", "both")
    csv = spark.read.schema(_CSV_READ).option("header", True).csv(path + ".csv")
    js = spark.read.schema(_JSON_SCHEMA).json(path + ".jsonl")
    both = csv.select(F.lit("csv").alias("kind"), "attack_type").unionByName(
        js.select(F.lit("jsonl").alias("kind"), "attack_type"))
    return both.groupBy("kind", "attack_type").agg(F.count("*").alias("n"))


@query("log_stats", _RECORDS + f"""SELECT count(*) AS total_logged, count(*) FILTER (is_attack) AS total_attacks_logged,
  count(*) FILTER (NOT is_attack) AS total_benign_logged, max(last_us) AS last_log_us,
  sum(octet_length(encode({_TEXT_SQL})) + 1)::BIGINT AS file_size_bytes FROM rec""")
def log_stats(spark, sf_dir):
    return auditlog.log_stats(auditlog.text_lines(recs(spark, sf_dir)))


_LINES_SQL = """lined_log AS (
  SELECT event_id AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 5000 AS ts_us,
    'host-' || (user_id % 2) AS hostname, event_type || ' ' || value AS line FROM events)"""


def _event_lines(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), tables.compressed_us().alias("ts_us"),
        F.concat(F.lit("host-"), F.col("user_id") % 2).alias("hostname"),
        F.concat_ws(" ", "event_type", F.col("value").cast("string")).alias("line"))


@query("log_segments", "WITH RECURSIVE " + _LINES_SQL + """,
  so AS (SELECT *, octet_length(encode(line)) + 1 AS b,
           row_number() OVER (PARTITION BY hostname ORDER BY ts_us, seq) AS rn FROM lined_log),
  sw AS (SELECT hostname, rn, b::BIGINT AS held, 0 AS segment FROM so WHERE rn = 1
    UNION ALL SELECT n.hostname, n.rn, CASE WHEN w.held >= 4096 THEN n.b ELSE w.held + n.b END,
      CASE WHEN w.held >= 4096 THEN w.segment + 1 ELSE w.segment END
    FROM sw w JOIN so n ON n.hostname = w.hostname AND n.rn = w.rn + 1),
  sg AS (SELECT hostname, segment, count(*) AS records, sum(so.b)::BIGINT AS bytes, min(ts_us) AS first_us,
      max(ts_us) AS last_us FROM sw JOIN so USING (hostname, rn) GROUP BY ALL),
  st AS (SELECT *, (sum(bytes) OVER (PARTITION BY hostname ORDER BY segment) - bytes)::BIGINT AS start_offset,
      max(segment) OVER (PARTITION BY hostname) - segment AS age FROM sg)
  SELECT hostname, start_offset, records, bytes, first_us, last_us, age::BIGINT AS age FROM st WHERE age <= 5""")
def log_segments(spark, sf_dir):
    return auditlog.segments(_event_lines(spark, sf_dir), max_bytes=4096, backup_count=5)


@query("recent_logs", """WITH j AS (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 5000
    AS ts_us, event_type, value, event_id % 10 = 7 AS broken FROM events),
  p AS (SELECT *, CASE WHEN broken THEN lag(ts_us) OVER w ELSE ts_us END AS at_us,
    CASE WHEN broken THEN lag(event_id) OVER w ELSE event_id END AS at_id FROM j WINDOW w AS (ORDER BY event_id))
  SELECT CASE WHEN NOT broken THEN ts_us END AS epoch, CASE WHEN NOT broken THEN event_id END AS seq,
    CASE WHEN NOT broken THEN event_type END AS event, CASE WHEN NOT broken THEN value END AS value,
    CASE WHEN broken THEN '{broken ' || event_id END AS raw FROM p ORDER BY at_us DESC, at_id DESC, event_id DESC LIMIT 25""")
def recent_logs(spark, sf_dir):
    """Every tenth line is broken, so there are some among the last ones."""
    path = shared_folder(spark, "recent") + "/events.jsonl"
    body = F.to_json(F.struct(tables.compressed_us().alias("epoch"), F.col("event_id").alias("seq"),
                              F.col("event_type").alias("event"), "value"))
    line = F.when(F.col("event_id") % 10 == 7, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(body)
    ordered = tables.table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    files = max(2, ordered.count() // 100_000)
    ordered.repartitionByRange(files, F.floor(F.col("event_id") / 10)).sortWithinPartitions("event_id").select("value").write.text(path)
    return auditlog.recent(spark, path, "epoch bigint, seq bigint, event string, value double", 25)
