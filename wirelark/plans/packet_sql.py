"""DuckDB text shared by the packet and flow checks."""

RAW_PACKETS = """
raw AS (
  SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 5000 AS ts_us
  FROM events),
sided AS (
  SELECT *, event_id % 3 = 0 AS reply, user_id % 4 = 0 AS udp,
    '10.0.' || (user_id // 250) || '.' || (user_id % 250 + 1) AS client_ip,
    CAST(40000 + user_id % 1000 AS INTEGER) AS client_port,
    '192.168.1.' || (user_id % 3 + 1) AS server_ip,
    CAST(CASE WHEN user_id % 50 = 9 THEN 5353 WHEN user_id % 10 = 3 AND event_type = 'signup' THEN 2000 + k
      ELSE 80 + user_id % 5 END AS INTEGER) AS server_port
  FROM raw),
raw_packets AS (
  SELECT event_id AS seq,
    CASE WHEN reply THEN server_ip ELSE client_ip END AS src_ip,
    CASE WHEN reply THEN server_port ELSE client_port END AS src_port,
    CASE WHEN user_id % 50 = 7 THEN '239.255.255.250' WHEN user_id % 50 = 8 THEN '192.168.1.255'
         WHEN reply THEN client_ip ELSE server_ip END AS dst_ip,
    CASE WHEN reply THEN client_port ELSE server_port END AS dst_port,
    CASE WHEN udp THEN '17' ELSE '6' END AS proto,
    CAST(CASE WHEN udp THEN 8 ELSE 20 + k % 4 * 4 END AS INTEGER) AS header_len,
    CAST(CASE WHEN event_type = 'signup' THEN 0 ELSE k * 14 END AS INTEGER) AS payload_len,
    ts_us,
    NOT udp AND event_type = 'error' AND k >= 90 AS f_fin,
    NOT udp AND event_type = 'signup' AS f_syn,
    NOT udp AND event_type = 'error' AND k < 20 AS f_rst,
    NOT udp AND event_type = 'purchase' AS f_psh,
    NOT udp AND event_type <> 'signup' AND NOT (event_type = 'error' AND k < 20) AS f_ack,
    CAST(CASE WHEN udp THEN 0 ELSE 1024 * (k + 1) END AS INTEGER) AS tcp_window
  FROM sided)"""

CLEAN_PACKETS = RAW_PACKETS + """,
packets AS (
  SELECT *, 20 + header_len + payload_len AS pkt_len FROM raw_packets
  WHERE proto IN ('6', '17')
    AND NOT (src_ip LIKE '%.255' OR dst_ip LIKE '%.255')
    AND NOT (CAST(split_part(src_ip, '.', 1) AS INTEGER) BETWEEN 224 AND 239)
    AND NOT (CAST(split_part(dst_ip, '.', 1) AS INTEGER) BETWEEN 224 AND 239)
    AND src_port NOT IN (1900, 5353, 5355, 137, 138, 27036, 67, 68)
    AND dst_port NOT IN (1900, 5353, 5355, 137, 138, 27036, 67, 68))"""

DIRECTED = """,
directed AS (
  SELECT *,
    CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN 0 ELSE 1 END AS side,
    CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port)
         THEN concat_ws('|', src_ip, src_port, dst_ip, dst_port, proto)
         ELSE concat_ws('|', dst_ip, dst_port, src_ip, src_port, proto) END AS flow_key
  FROM packets)"""

NO_MARKS = """,
marked AS (SELECT *, false AS scan_mark, false AS flood_mark FROM directed)"""


def attempt_marks(source: str, scan: int, flood: int, window: int = 5_000_000) -> str:
    """Marks by a self-join over the window."""
    return f""",
syn AS (SELECT * FROM {source} WHERE proto = '6' AND f_syn AND NOT f_ack),
counted AS (
  SELECT a.seq, count(DISTINCT b.dst_port) AS ports, count(*) AS attempts
  FROM syn a JOIN syn b ON a.src_ip = b.src_ip AND a.dst_ip = b.dst_ip
   AND b.ts_us >= a.ts_us - {window} AND (b.ts_us, b.seq) <= (a.ts_us, a.seq)
  GROUP BY a.seq),
marked AS (
  SELECT p.*, coalesce(c.ports >= {scan}, false) AS scan_mark,
         coalesce(c.ports < {scan} AND c.attempts >= {flood}, false) AS flood_mark
  FROM {source} p LEFT JOIN counted c USING (seq))"""


def runs(inactivity: int, active: int, linger: int, idle: int = 5_000_000) -> str:
    """Walks each flow key packet by packet; yields `cut` (kept packets with their flow)."""
    never = 1 << 60
    wait = min(linger, never)
    return f""",
lined AS (
  SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY ts_us, seq) AS rn,
         f_fin OR f_rst OR scan_mark OR flood_mark AS closes FROM marked),
walk AS (
  SELECT flow_key, rn, ts_us, seq, ts_us AS start_us, seq AS start_seq, side AS run_side,
         CASE WHEN closes THEN ts_us END AS closed_at, false AS absorbed
  FROM lined WHERE rn = 1
  UNION ALL
  SELECT flow_key, rn, ts_us, seq,
    CASE WHEN fresh THEN ts_us ELSE start_us END, CASE WHEN fresh THEN seq ELSE start_seq END,
    CASE WHEN fresh THEN side ELSE run_side END,
    CASE WHEN fresh OR closed_at IS NULL THEN CASE WHEN closes THEN ts_us END ELSE closed_at END,
    NOT fresh AND closed_at IS NOT NULL
  FROM (
    SELECT n.flow_key, n.rn, n.ts_us, n.seq, n.side, n.closes, w.start_us, w.start_seq, w.run_side,
           w.closed_at,
           CASE WHEN w.closed_at IS NOT NULL THEN n.ts_us - w.closed_at > {wait}
                ELSE n.ts_us - w.ts_us >= {inactivity} OR n.ts_us - w.start_us >= {active} END AS fresh
    FROM walk w JOIN lined n ON n.flow_key = w.flow_key AND n.rn = w.rn + 1) s),
cut AS (
  SELECT l.*, w.start_us, w.start_seq, w.run_side, l.side = w.run_side AS fwd,
         l.seq = w.start_seq AS is_first
  FROM lined l JOIN walk w USING (flow_key, rn) WHERE NOT w.absorbed),
gapped AS (
  SELECT *, ts_us - lag(ts_us) OVER f AS gap, ts_us - lag(ts_us) OVER d AS side_gap
  FROM cut WINDOW f AS (PARTITION BY flow_key, start_us, start_seq ORDER BY ts_us, seq),
                  d AS (PARTITION BY flow_key, start_us, start_seq, fwd ORDER BY ts_us, seq)),
numbered AS (
  SELECT *, sum(CASE WHEN gap > {idle} THEN 1 ELSE 0 END)
            OVER (PARTITION BY flow_key, start_us, start_seq ORDER BY ts_us, seq) AS burst
  FROM gapped)"""


def _moments(name, value, cond="true"):
    v = f"CASE WHEN {cond} THEN {value} END"
    return f"""
  count({v}) AS {name}_n, coalesce(sum({v}), 0) AS {name}_s,
  coalesce(var_samp({v}), 0.0) AS {name}_v,
  coalesce(min({v}), 0) AS {name}_min, coalesce(max({v}), 0) AS {name}_max"""


def flows(idle: int = 5_000_000) -> str:
    flags = ", ".join(f"count(CASE WHEN f_{f} THEN 1 END) AS {f}"
                      for f in ("fin", "syn", "rst", "psh", "ack"))
    return f""",
base AS (
  SELECT flow_key, start_us, start_seq, run_side, max(ts_us) AS last_us,
  {_moments('len', 'payload_len')}, {_moments('len_f', 'payload_len', 'fwd')},
  {_moments('len_b', 'payload_len', 'NOT fwd')}, {_moments('iat', 'gap')},
  {_moments('iat_f', 'side_gap', 'fwd')}, {_moments('iat_b', 'side_gap', 'NOT fwd')},
  {_moments('idle', 'gap', f'gap > {idle}')},
  coalesce(sum(CASE WHEN fwd THEN header_len END), 0) AS head_f,
  coalesce(sum(CASE WHEN NOT fwd THEN header_len END), 0) AS head_b,
  coalesce(sum(CASE WHEN is_first THEN tcp_window END), 0) AS win_f,
  coalesce(sum(CASE WHEN NOT fwd AND side_gap IS NULL THEN tcp_window END), 0) AS win_b,
  count(CASE WHEN fwd AND payload_len > 0 THEN 1 END) AS data_f,
  min(CASE WHEN fwd AND header_len > 0 THEN header_len END) AS head_min,
  count(CASE WHEN fwd AND f_psh THEN 1 END) AS psh_f, {flags},
  bool_or(scan_mark) AS is_port_scan, bool_or(flood_mark) AS is_conn_flood
  FROM numbered GROUP BY flow_key, start_us, start_seq, run_side),
burst_rows AS (
  SELECT flow_key, start_us, start_seq, burst, max(ts_us) - min(ts_us) AS dur,
         burst = max(burst) OVER (PARTITION BY flow_key, start_us, start_seq) AS final
  FROM numbered GROUP BY flow_key, start_us, start_seq, burst),
burst_kept AS (
  SELECT *, count(CASE WHEN dur > 0 AND NOT final THEN 1 END)
            OVER (PARTITION BY flow_key, start_us, start_seq) AS others
  FROM burst_rows),
activity AS (
  SELECT flow_key, start_us, start_seq, {_moments('act', 'dur')}
  FROM burst_kept WHERE dur > 0 OR (final AND others = 0)
  GROUP BY flow_key, start_us, start_seq),
flow AS (
  SELECT b.*, a.act_n, a.act_s, a.act_v, a.act_min, a.act_max,
    split_part(flow_key, '|', CASE WHEN run_side = 0 THEN 1 ELSE 3 END) AS src_ip,
    CAST(split_part(flow_key, '|', CASE WHEN run_side = 0 THEN 2 ELSE 4 END) AS INTEGER) AS src_port,
    split_part(flow_key, '|', CASE WHEN run_side = 0 THEN 3 ELSE 1 END) AS dst_ip,
    CAST(split_part(flow_key, '|', CASE WHEN run_side = 0 THEN 4 ELSE 2 END) AS INTEGER) AS dst_port,
    split_part(flow_key, '|', 5) AS protocol, split_part(flow_key, '|', 5) = '17' AS udp,
    len_n <= 1 AS single, last_us - start_us AS span,
    CASE WHEN len_n <= 1 THEN 1e-4::DOUBLE
         ELSE greatest(last_us - start_us, 1)::DOUBLE / 1e6::DOUBLE END AS seconds
  FROM base b JOIN activity a USING (flow_key, start_us, start_seq))"""


def _mean(n):
    return f"CASE WHEN {n}_n > 0 THEN {n}_s::DOUBLE / {n}_n ELSE 0.0 END"


def _var(n):
    return f"{n}_v"


def _rate(value):
    return f"CASE WHEN single AND udp THEN 0.0 ELSE {value}::DOUBLE / seconds END"


FEATURE_SQL = {
    "Src Port": "src_port::DOUBLE", "Dst Port": "dst_port::DOUBLE", "Protocol": "protocol",
    "Flow Duration": "CASE WHEN single AND udp THEN 0.0 WHEN span <= 0 THEN 1.0 ELSE span::DOUBLE END",
    "Total Fwd Packet": "len_f_n::DOUBLE", "Total Bwd packets": "len_b_n::DOUBLE",
    "Total Length of Fwd Packet": "len_f_s::DOUBLE", "Total Length of Bwd Packet": "len_b_s::DOUBLE",
    "Flow Bytes/s": _rate("len_s"), "Flow Packets/s": _rate("len_n"),
    "Fwd Packets/s": _rate("len_f_n"),
    "Bwd Packets/s": f"CASE WHEN single THEN 0.0 ELSE {_rate('len_b_n')} END",
    "Fwd IAT Total": "iat_f_s::DOUBLE", "Bwd IAT Total": "iat_b_s::DOUBLE",
    "Fwd PSH Flags": "psh_f::DOUBLE",
    "Fwd Header Length": "head_f::DOUBLE", "Bwd Header Length": "head_b::DOUBLE",
    "Packet Length Variance": _var("len"),
    "Down/Up Ratio": "CASE WHEN len_f_n > 0 THEN len_b_n::DOUBLE / len_f_n ELSE 0.0 END",
    "Average Packet Size": _mean("len"),
    "Fwd Segment Size Avg": _mean("len_f"), "Bwd Segment Size Avg": _mean("len_b"),
    "Bwd Bytes/Bulk Avg": "0.0::DOUBLE", "Bwd Packet/Bulk Avg": "0.0::DOUBLE",
    "Bwd Bulk Rate Avg": "0.0::DOUBLE",
    "Subflow Fwd Packets": "len_f_n::DOUBLE", "Subflow Fwd Bytes": "len_f_s::DOUBLE",
    "Subflow Bwd Packets": "len_b_n::DOUBLE", "Subflow Bwd Bytes": "len_b_s::DOUBLE",
    "FWD Init Win Bytes": "win_f::DOUBLE", "Bwd Init Win Bytes": "win_b::DOUBLE",
    "Fwd Act Data Pkts": "data_f::DOUBLE", "Fwd Seg Size Min": "head_min::DOUBLE",
}
for _label, _name in (("Packet Length", "len"), ("Fwd Packet Length", "len_f"),
                      ("Bwd Packet Length", "len_b"), ("Flow IAT", "iat"), ("Fwd IAT", "iat_f"),
                      ("Bwd IAT", "iat_b"), ("Active", "act"), ("Idle", "idle")):
    FEATURE_SQL |= {f"{_label} Mean": _mean(_name), f"{_label} Std": f"sqrt({_var(_name)})",
                    f"{_label} Max": f"{_name}_max::DOUBLE", f"{_label} Min": f"{_name}_min::DOUBLE"}
for _flag in ("FIN", "SYN", "RST", "PSH", "ACK"):
    FEATURE_SQL[f"{_flag} Flag Count"] = f"{_flag.lower()}::DOUBLE"


def places(name: str) -> int | None:
    """Decimal places to which engines agree on a deviation: they add in different orders."""
    if name.endswith("Variance"):
        return 4
    if name.endswith(" Std"):
        return 6 if "Length" in name else 2
    return None


def feature_list(names) -> str:
    def text(n):
        return FEATURE_SQL[n] if places(n) is None else f"round({FEATURE_SQL[n]}, {places(n)})"
    return ", ".join(f'{text(n)} AS "{n}"' for n in names)


def live_flows(marks: str = NO_MARKS, inactivity: int = 10_000_000, active: int = 60_000_000,
               linger: int = 1_000_000) -> str:
    return ("WITH RECURSIVE " + CLEAN_PACKETS + DIRECTED + marks
            + runs(inactivity, active, linger) + flows())


def seconds_to_4_places(us: str) -> str:
    return (f"(({us} // 100 + CASE WHEN {us} % 100 > 50 OR ({us} % 100 = 50 AND {us} // 100 % 2 <> 0) "
            "THEN 1 ELSE 0 END) / 10000.0::DOUBLE)")
