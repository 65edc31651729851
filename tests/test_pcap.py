import struct

import pytest
from pyspark.sql import functions as F

from packets import frame, packet
from wirelark.sources import pcap, tables

ETHERNET = b"\x02" * 12


def capture(path, frames, order="<", magic=0xA1B2C3D4, link=1, tail=b""):
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 262144, link))
        for seconds, fraction, data in frames:
            f.write(struct.pack(order + "IIII", seconds, fraction, len(data), len(data)) + data)
        f.write(tail)


def ipv4(proto, body, total=None, src=(10, 0, 0, 1), dst=(10, 0, 0, 2)):
    total = 20 + len(body) if total is None else total
    return struct.pack(">BBHHHBBH4B4B", 0x45, 0, total, 0, 0, 64, proto, 0, *src, *dst) + body


def tcp(payload=b"", words=5, flags=2):
    return struct.pack(">HHIIBBHHH", 1234, 80, 0, 0, words << 4, flags, 555, 0, 0) + b"\0" * max(0, words * 4 - 20) + payload


def udp(payload=b""):
    return struct.pack(">HHHH", 53, 5353, 8 + len(payload), 0) + payload


def rows(spark, path, split_bytes=pcap.SPLIT_BYTES):
    return pcap.read_packets(spark, str(path), split_bytes).orderBy("seq").collect()


def test_headers(spark, tmp_path):
    frames = [
        (1, 5, ETHERNET + b"\x08\x00" + ipv4(6, tcp(b"abc", 8, 0x12)) + b"\0" * 9),          # padded
        (2, 6, ETHERNET + b"\x81\x00\x00\x01\x08\x00" + ipv4(17, udp(b"xy"))),               # VLAN
        (3, 7, ETHERNET + b"\x86\xdd" + b"\x60" + b"\0" * 60),                              # IPv6
        (4, 8, ETHERNET + b"\x08\x00" + ipv4(1, b"\0" * 16)),                               # ICMP
        (5, 9, ETHERNET + b"\x08\x00" + ipv4(6, tcp(b"abcd", 0), total=0)),                 # no lengths given
        (6, 1, ETHERNET + b"\x08\x06" + b"\0" * 40),                                        # ARP
        (7, 2, ETHERNET + b"\x08"),                                                         # cut short
    ]
    capture(tmp_path / "a.pcap", frames)
    a, b, c = rows(spark, tmp_path)
    assert (a.src_ip, a.src_port, a.dst_ip, a.dst_port, a.proto) == ("10.0.0.1", 1234, "10.0.0.2", 80, "6")
    assert (a.ts_us, a.header_len, a.payload_len, a.tcp_window, a.pkt_len) == (1_000_005, 32, 3, 555, 55)
    assert a.tcp_flags.SYN and a.tcp_flags.ACK and not a.tcp_flags.FIN
    assert (b.proto, b.header_len, b.payload_len, b.tcp_flags, b.tcp_window) == ("17", 8, 2, None, 0)
    assert (c.header_len, c.payload_len, c.pkt_len) == (20, 4, 44)


@pytest.mark.parametrize("link, lead", [(101, b""), (0, b"\x02\0\0\0"), (113, b"\0" * 14 + b"\x08\x00")])
@pytest.mark.parametrize("order, magic, fraction", [("<", 0xA1B2C3D4, 7), (">", 0xA1B2C3D4, 7), ("<", 0xA1B23C4D, 7999)])
def test_link_types_and_byte_orders(spark, tmp_path, link, lead, order, magic, fraction):
    capture(tmp_path / "a.pcap", [(1, fraction, lead + ipv4(17, udp(b"123")))], order, magic, link, tail=b"\1\2\3")
    (r,) = rows(spark, tmp_path)
    assert (r.ts_us, r.src_port, r.payload_len) == (1_000_007, 53, 3)


@pytest.mark.parametrize("split_bytes", [300, 1000, 4096])
def test_ranges_meet_even_with_captures_inside_packets(spark, tmp_path, split_bytes):
    """Payloads that hold record chains of their own lead the first guess astray."""
    inner = b"".join(struct.pack("<IIII", 9, 9, 20, 20) + b"z" * 20 for _ in range(30))
    frames = [(i, i, ETHERNET + b"\x08\x00" + ipv4(17, udp(inner if i % 3 else b"q" * (i % 50)))) for i in range(60)]
    capture(tmp_path / "a.pcap", frames)
    capture(tmp_path / "b.pcap", frames[:7])
    whole = rows(spark, tmp_path)
    assert [r.ts_us for r in whole] == [i * 1_000_001 for i in range(60)] + [i * 1_000_001 for i in range(7)]
    assert rows(spark, tmp_path, split_bytes) == whole


def test_not_a_capture(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="not a capture file"):
        rows(spark, tmp_path)


def test_written_frames_decode_to_the_same_packets(spark, tmp_path):
    packets = frame(spark, [packet(i, 10 + i, "10.0.0.1:99", "10.0.0.2:80", "SFPA"[: 1 + i % 4], i * 7, window=i)
                            for i in range(20)] + [packet(20, 40, "10.0.0.1:9", "10.0.0.2:8", payload=3, proto="17")])
    tables.write_captures(tables.with_frames(packets), str(tmp_path / "c"))
    back = pcap.read_packets(spark, str(tmp_path / "c"), 500)
    assert sorted(map(tuple, back.drop("seq").collect())) == sorted(map(tuple, packets.drop("seq").select(back.drop("seq").columns).collect()))
