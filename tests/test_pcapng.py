import random
import struct

import pytest

from test_pcap import ETHERNET, capture, ipv4, rows, tcp, udp
from wirelark.sources import pcap, pcapng


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(order + "I", 12 + len(body))
    return struct.pack(order + "I", kind) + size + body + size


def section(order):
    return block(order, pcapng.SECTION, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))


def interface(order, link, options=b""):
    return block(order, pcapng.INTERFACE, struct.pack(order + "HHI", link, 0, 0) + options)


def option(order, code, value):
    return struct.pack(order + "HH", code, len(value)) + value + b"\0" * (-len(value) % 4)


def packet(order, number, ticks, data):
    return block(order, pcapng.PACKET, struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data)


def sample(n=300, seed=0):
    """(bytes of a file of two sections in either byte order, the (us, link type, frame) of its packets)."""
    draw, out, want = random.Random(seed), b"", []
    for order, first in (("<", 0), (">", n)):
        out += section(order)
        out += interface(order, 1)                                                              # microseconds
        out += interface(order, 101, option(order, 9, b"\x09") + option(order, 14, struct.pack(order + "q", 7)) + option(order, 0, b""))
        for i in range(n):
            if i == n // 2:
                out += interface(order, 1, option(order, 9, b"\x8a"))                           # 1/1024 of a second
            number = draw.randint(0, 2 if i > n // 2 else 1)
            bare = ipv4(6, tcp(b"x" * draw.randint(0, 60))) if i % 2 else ipv4(17, udp(b"y" * draw.randint(0, 60)))
            data, ticks = (bare if number == 1 else ETHERNET + b"\x08\x00" + bare), 10**6 * (first + i) + 5
            out += packet(order, number, ticks, data)
            units, offset = [(10**6, 0), (10**9, 7), (1024, 0)][number]
            want.append((offset * 10**6 + ticks * 10**6 // units, 101 if number == 1 else 1, data))
            if i % 50 == 0:
                out += block(order, 0xBAD, b"something of a vendor" * draw.randint(1, 90))
    return out, want


def blocks(data):
    return pcapng.Blocks(lambda place, size: data[place:place + max(0, min(size, len(data) - place))], len(data), pcap.Damaged)


@pytest.mark.parametrize("size", [64, 1000, 5000, 1 << 20])
def test_ranges_meet_and_know_their_interfaces(size):
    data, want = sample()
    file = blocks(data)
    starts = [file.guess(b) for b in range(0, len(data), size)]
    walked = [file.walk(s, b + size) if s is not None and s < len(data) else (s, None, "[]") for s, b in zip(starts, range(0, len(data), size))]
    for (stop, damaged, _), start in zip(walked, starts[1:]):
        assert damaged is None and (start is None or start == stop or start > stop)
    got = []
    import json
    for (stop, _, _), start, known in zip(walked, starts, pcapng.contexts([w[2] for w in walked])):
        if start is not None and start < stop:
            got += [f[1:] for f in file.frames(start, stop, json.loads(known))]
    assert got == want


def test_both_containers_in_one_folder(spark, tmp_path):
    data, want = sample(120)
    (tmp_path / "b.pcapng").write_bytes(data)
    frames = [(i, i, ETHERNET + b"\x08\x00" + ipv4(17, udp(b"12"))) for i in range(1, 40)]
    capture(tmp_path / "a.pcap", frames)
    for size in (700, pcap.SPLIT_BYTES):
        got = [(r.ts_us, r.linktype, bytes(r.frame)) for r in pcap.read_frames(spark, str(tmp_path), size).orderBy("seq").collect()]
        assert got == [(s * 10**6 + f, 1, d) for s, f, d in frames] + want
    assert len(rows(spark, tmp_path)) == len(frames) + len(want)


def test_a_cut_file_is_an_error(spark, tmp_path):
    data, want = sample(30)
    (tmp_path / "a.pcapng").write_bytes(data[:-10])
    with pytest.raises(pcap.Damaged):
        rows(spark, tmp_path)
    kept = pcap.read_frames(spark, str(tmp_path), on_damage="skip").count()
    assert kept == len(want) - 1


def test_simple_and_old_packets():
    data = section("<") + interface("<", 101) + block("<", pcapng.SIMPLE, struct.pack("<I", 5) + b"hello") \
        + block("<", pcapng.OLD_PACKET, struct.pack("<HHIIII", 0, 0, 0, 9, 3, 3) + b"abc")
    assert [f[1:] for f in blocks(data).frames(0, len(data), [])] == [(0, 101, b"hello"), (9, 101, b"abc")]


@pytest.mark.parametrize("tail", [0, 5])
def test_a_last_range_in_which_no_block_begins(spark, tmp_path, tail):
    """A range that begins inside the last block has nothing to read; it is no damage."""
    data, want = sample(40)
    (tmp_path / "a.pcapng").write_bytes(data + b"\1" * tail)
    last, = struct.unpack("<I" if data[-1] == 0 else ">I", data[-4:])
    for inside in (4, last - 8):
        size = next(s for s in range(300, len(data)) if len(data) - inside <= (len(data) + tail - 1) // s * s < len(data) + tail)
        got = [(r.ts_us, r.linktype, bytes(r.frame)) for r in pcap.read_frames(spark, str(tmp_path), size).orderBy("seq").collect()]
        assert got == want and pcap.damage(spark, str(tmp_path), size).isEmpty()
