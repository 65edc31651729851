"""Capture files that grow while they are read."""

import pytest

from test_pcap import ETHERNET, capture, ipv4, udp
from test_pcapng import sample
from wirelark.sources import live, pcap


def frames(first, n):
    return [(i, i, ETHERNET + b"\x08\x00" + ipv4(17, udp(b"z" * (i % 9)))) for i in range(first, first + n)]


def run(spark, folder, out, size=500):
    query = (live.stream_frames(spark, str(folder), size).writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint")
             .trigger(availableNow=True).start(str(out)))
    query.awaitTermination()
    return sorted((r.ts_us, r.linktype, bytes(r.frame)) for r in spark.read.parquet(str(out)).collect())


def test_restarts_neither_lose_nor_repeat(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    capture(tmp_path / "whole", frames(1, 60))
    whole = (tmp_path / "whole").read_bytes()
    blocks, want_blocks = sample(40)
    want = [(s * 10**6 + f, 1, d) for s, f, d in frames(1, 60)]

    (folder / "a.pcap").write_bytes(whole[:1007])                     # ends inside a record
    (folder / "b.pcapng").write_bytes(blocks[:2000 + 2])
    got = run(spark, folder, out)
    assert 0 < len(got) < 100 and set(got) <= set(want + want_blocks)
    (folder / "a.pcap").write_bytes(whole[:1007 + 3])                 # still the same record
    assert run(spark, folder, out) == got
    (folder / "a.pcap").write_bytes(whole)
    (folder / "b.pcapng").write_bytes(blocks)
    (folder / "c.pcap").write_bytes(whole[:20])                       # not even a header
    assert run(spark, folder, out) == sorted(want + want_blocks)
    capture(folder / "c.pcap", frames(100, 5))
    assert run(spark, folder, out) == sorted(want + want_blocks + [(s * 10**6 + f, 1, d) for s, f, d in frames(100, 5)])


def test_offsets(tmp_path):
    """Parts cover exactly what lies between two offsets, and a file that shrinks is an error."""
    capture(tmp_path / "a.pcap", frames(1, 50))
    reader = live.CaptureReader({"path": f"file://{tmp_path}", "splitBytes": "300"})
    first = reader.latestOffset()
    parts = reader.partitions({}, first)
    assert [p.start for p in parts][1:] == [p.stop for p in parts][:-1] and parts[-1].stop == next(iter(first.values()))[1]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 50
    assert reader.partitions(first, reader.latestOffset()) == []
    capture(tmp_path / "a.pcap", frames(1, 5))
    with pytest.raises(FileNotFoundError):
        reader.partitions({}, first)
    assert pcap.GLOBAL_HEADER == parts[0].start
