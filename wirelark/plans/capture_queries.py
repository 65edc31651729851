"""Frames and capture files made of the sample packets and read back."""

from pyspark.sql import functions as F

from wirelark.plans import packet_sql as sql
from wirelark.plans.catalog import query
from wirelark.sources import pcap, tables
from wirelark.sources.scratch import cut_lineage, shared_folder

_FIELDS = """src_ip, src_port, dst_ip, dst_port, proto, header_len, payload_len, ts_us,
  20 + header_len + payload_len AS pkt_len, CASE WHEN proto = '17' THEN 0 ELSE tcp_window % 65536 END AS tcp_window,
  CASE WHEN proto = '6' THEN f_fin END AS fin, CASE WHEN proto = '6' THEN f_syn END AS syn,
  CASE WHEN proto = '6' THEN f_rst END AS rst, CASE WHEN proto = '6' THEN f_psh END AS psh,
  CASE WHEN proto = '6' THEN f_ack END AS ack"""


def _fields(packets, *more):
    flags = [F.col(f"tcp_flags.{n}").alias(n.lower()) for n in ("FIN", "SYN", "RST", "PSH", "ACK")]
    return packets.select(*more, "src_ip", "src_port", "dst_ip", "dst_port", "proto", "header_len", "payload_len",
                          "ts_us", "pkt_len", "tcp_window", *flags)


@query("packet_decode", f"WITH {sql.RAW_PACKETS} SELECT seq, {_FIELDS} FROM raw_packets")
def packet_decode(spark, sf_dir):
    framed = tables.with_frames(tables.raw_packets(spark, sf_dir), some_bare=True)
    stored = cut_lineage(framed.select("seq", "ts_us", "linktype", "frame"), "frames")
    return _fields(pcap.decode(stored), "seq")


@query("pcap_scan", f"WITH {sql.RAW_PACKETS} SELECT {_FIELDS} FROM raw_packets")
def pcap_scan(spark, sf_dir):
    """All packets of the sample through capture files that are read in small ranges."""
    folder = shared_folder(spark, "captures")
    tables.write_captures(tables.with_frames(tables.raw_packets(spark, sf_dir)), folder)
    return _fields(pcap.read_packets(spark, folder, split_bytes=256 * 1024))


@query("pcapng_scan", f"WITH {sql.RAW_PACKETS} SELECT {_FIELDS} FROM raw_packets")
def pcapng_scan(spark, sf_dir):
    """The same with files of both containers in one folder."""
    folder = shared_folder(spark, "captures")
    tables.write_captures(tables.with_frames(tables.raw_packets(spark, sf_dir)), folder, mixed=True)
    return _fields(pcap.read_packets(spark, folder, split_bytes=256 * 1024))
