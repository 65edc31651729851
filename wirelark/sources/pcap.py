"""Capture files as a DataFrame of frames, and frames as packets.

A capture file is a chain of records, so a reader in the middle of a file does not know where the
next record begins. Files are cut into byte ranges all the same: one job finds, for every range, a
place where a long chain of plausible record headers starts, and walks the headers to the first
record past the range. Where the walk of one range does not end at the start found for the next,
that start was wrong; the range is walked again from the true place, until all ranges meet. The
frames are then read range by range, so one huge file keeps as many tasks busy as many small ones.

A record that reaches past the end of its file is damage: reading stops with an error that names the
place, or, with on_damage="skip", goes on at the next range that begins with a plausible record.
`damage` lists such places. Fewer bytes than a record header at the end of a file are ignored.

Files of blocks (pcapng) may lie among the others; see `pcapng` for what their ranges need besides.
"""

from __future__ import annotations

import json
import struct

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wirelark.functions.net import flags_from_bits
from wirelark.operators.ordered import rank_within
from wirelark.sources import pcapng
from wirelark.sources.scratch import cut_lineage

SPLIT_BYTES = 128 * 1024 * 1024
MAX_FRAME = 262_144
CHAIN = 20                       # headers that must follow one another to accept a start
GLOBAL_HEADER, RECORD_HEADER = 24, 16
WALKED_BYTES = 64 * 1024         # read at a time by a walk over record headers

# First four bytes of a capture file -> (byte order, fractions per second).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6),
         b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}

_RANGE = "path string, length long, file_no long, range_no long, start long, stop long, damaged long, known string"
_FRAME = "seq long, ts_us long, linktype int, frame binary"


def arrow_uri(path: str) -> str:
    """A fully qualified Hadoop path as the file systems of pyarrow name it."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        raise ValueError(f"{path} names no file system")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest


class Damaged(ValueError):
    pass


class _File:
    """A chain of records, or `blocks` where the file is one of those."""

    def __init__(self, path: str, length: int):
        source, name = fs.FileSystem.from_uri(arrow_uri(path))
        self.handle, self.length = source.open_input_file(name), length
        head = self.at(0, GLOBAL_HEADER)
        self.blocks = pcapng.Blocks(self.at, length, Damaged) if head[:4] == pcapng.SECTION_START else None
        if self.blocks:
            return
        if head[:4] not in MAGIC:
            raise ValueError(f"not a capture file: {path}")
        self.order, self.fractions = MAGIC[head[:4]]
        self.linktype = struct.unpack(self.order + "I", head[20:24])[0] & 0xFFFF

    def at(self, place: int, size: int) -> bytes:
        return self.handle.read_at(max(0, min(size, self.length - place)), place)

    def header(self, data: bytes, place: int = 0):
        return struct.unpack_from(self.order + "IIII", data, place)

    def plausible(self, window: bytes, place: int, base: int) -> bool:
        """Do plausible headers follow one another from here to the window's or the file's end? The
        window begins at `base`."""
        for _ in range(CHAIN):
            if place + RECORD_HEADER > len(window):
                return True
            _, fraction, kept, whole = self.header(window, place)
            if fraction >= self.fractions or kept > MAX_FRAME or whole > MAX_FRAME or kept > whole or kept == 0:
                return False
            place += RECORD_HEADER + kept
            if base + place > self.length:
                return False
        return True

    def guess(self, start: int) -> int | None:
        """First place at or after `start` that looks like a record."""
        if self.blocks:
            return self.blocks.guess(start)
        if start <= GLOBAL_HEADER:
            return GLOBAL_HEADER
        window = self.at(start, 4 * MAX_FRAME)
        for place in range(0, min(len(window) - RECORD_HEADER, MAX_FRAME + RECORD_HEADER) + 1):
            if self.plausible(window, place, start):
                return start + place
        return None

    def records(self, start: int, stop: int, block: int = 8 * 1024 * 1024):
        """(place, seconds, fraction, frame) of the records that begin in start..stop."""
        data, base, place = b"", start, start
        while place < stop and place + RECORD_HEADER <= self.length:
            if place + RECORD_HEADER > base + len(data):
                data, base = self.at(place, block), place
            seconds, fraction, kept, _ = self.header(data, place - base)
            end = place + RECORD_HEADER + kept
            if end > self.length:
                raise Damaged(place)
            if end > base + len(data):
                data, base = self.at(place, max(block, RECORD_HEADER + kept)), place
            yield place, seconds, fraction, data[place - base + RECORD_HEADER:end - base]
            place = end

    def walk(self, start: int, stop: int) -> tuple[int, int | None, str | None]:
        """Place of the first record at or past `stop`, from the true start of a record; where a damaged
        record ended the walk before, if one did; and what blocks say about those behind. Frames longer
        than what is read at a time are stepped over."""
        if self.blocks:
            return self.blocks.walk(start, stop)
        data, base, place = b"", start, start
        while place < stop and place + RECORD_HEADER <= self.length:
            if place + RECORD_HEADER > base + len(data):
                data, base = self.at(place, WALKED_BYTES), place
            end = place + RECORD_HEADER + self.header(data, place - base)[2]
            if end > self.length:
                return place, place, None
            place = end
        return place, None, None

    def frames(self, start: int, stop: int, interfaces: list):
        """(place, microseconds, link type, frame) of the records that begin in start..stop."""
        if self.blocks:
            yield from self.blocks.frames(start, stop, interfaces)
        else:
            for place, seconds, fraction, frame in self.records(start, stop):
                yield place, seconds * 10**6 + fraction * 10**6 // self.fractions, self.linktype, frame


def _ranges(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "length").withColumn("_all", F.lit(0)))
    files = rank_within(files, ["_all"], ["path"], "file_no").drop("_all")
    last = F.greatest(F.ceil(F.col("length") / split_bytes) - 1, F.lit(0))
    return files.withColumn("range_no", F.explode(F.sequence(F.lit(0), last.cast("long"))))


def _walked(ranges: DataFrame, split_bytes: int) -> DataFrame:
    """Adds `start` (guessed where null) and `stop`, the place of the first record past the range."""
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                file = _File(r["path"], r["length"])
                begin = r["range_no"] * split_bytes
                start = file.guess(begin) if r["start"] is None else r["start"]
                if start is None:                       # nothing to go by; the range before may know
                    out.append(r | {"start": -1, "stop": -1, "damaged": begin, "known": None})
                    continue
                stop, damaged, known = file.walk(start, begin + split_bytes)
                out.append(r | {"start": start, "stop": stop, "damaged": damaged, "known": known})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema.append(
                pa.field("stop", pa.int64())).append(pa.field("damaged", pa.int64())).append(pa.field("known", pa.string())))
    spread = ranges.repartition("path", "range_no")
    return spread.select("path", "length", "file_no", "range_no", "start").mapInArrow(run, _RANGE)


def _splits(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    found = cut_lineage(_walked(_ranges(spark, path, split_bytes).withColumn("start", F.lit(None).cast("long")),
                                split_bytes), "ranges")
    neighbours = Window.partitionBy("path").orderBy("range_no")
    while True:
        # behind damage nobody knows better than the guess
        claim = F.when(F.lag("damaged").over(neighbours).isNull(), F.lag("stop").over(neighbours))
        checked = found.withColumn("true_start", F.coalesce(claim, F.col("start")))
        wrong = checked.where(F.col("start") != F.col("true_start"))
        if wrong.isEmpty():
            return found
        again = _walked(wrong.withColumn("start", F.col("true_start")), split_bytes)
        right = checked.where(F.col("start") == F.col("true_start")).drop("true_start")
        found = cut_lineage(right.unionByName(again), "ranges")


def _with_contexts(splits: DataFrame) -> DataFrame:
    """`known` becomes what a reader has to know at the start of its range; a file has few ranges."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("range_no")
        place = table.schema.get_field_index("known")
        return table.set_column(place, "known", pa.array(pcapng.contexts(table.column("known").to_pylist()), pa.string()))
    return splits.groupBy("path").applyInArrow(run, _RANGE).select(*splits.columns)


def damage(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, damaged): places of records that reach past the end of their file."""
    return _splits(spark, path, split_bytes).where("damaged is not null").select("path", "damaged")


def read_frames(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, on_damage: str = "fail") -> DataFrame:
    """(seq, ts_us, linktype, frame) of all capture files below `path`; seq follows the files by
    name and the records within a file."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                file = _File(r["path"], r["length"])
                rows, size = [], 0
                for place, ts_us, linktype, frame in file.frames(r["start"], r["stop"], json.loads(r["known"])):   # up to any damage
                    rows.append((r["file_no"] << 40 | place, ts_us, linktype, frame))
                    size += len(frame)
                    if size > 4_000_000 or len(rows) >= 10_000:
                        yield _frame_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame_batch(rows)
    splits = _splits(spark, path, split_bytes)
    if on_damage == "fail":
        broken = splits.where("damaged is not null").limit(1).collect()
        if broken:
            raise Damaged(f"{broken[0].path}: the record at byte {broken[0].damaged} reaches past the end of the file")
    splits = _with_contexts(splits).where(F.col("start") < F.col("stop"))
    return splits.repartition("path", "range_no").mapInArrow(run, _FRAME)


def _frame_batch(rows):
    seq, ts, link, frame = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(seq, pa.int64()), pa.array(ts, pa.int64()), pa.array(link, pa.int32()),
         pa.array(frame, pa.binary())], names=["seq", "ts_us", "linktype", "frame"])


def _number(data: Column, place, size: int) -> Column:
    """Big-endian unsigned number at a 0-based place of a binary column; null past its end."""
    text = F.hex(F.substring(data, place + 1, size))
    return F.when(F.length(text) == 2 * size, F.conv(text, 16, 10).cast("int"))


def _address(data: Column, place: int) -> Column:
    return F.concat_ws(".", *[_number(data, place + i, 1).cast("string") for i in range(4)])


def decode(frames: DataFrame) -> DataFrame:
    """IPv4 TCP and UDP frames as packets; all others are dropped. Built-in expressions only."""
    frame = F.col("frame")
    ethertype = _number(frame, 12, 2)
    # Link types and where their IPv4 header begins.
    offset = (F.when(F.col("linktype") == 1, F.when(ethertype == 0x0800, F.lit(14)).when(
                  (ethertype == 0x8100) & (_number(frame, 16, 2) == 0x0800), F.lit(18)))
              .when(F.col("linktype").isin(12, 101, 228), F.lit(0))
              .when(F.col("linktype").isin(0, 108), F.lit(4))
              .when((F.col("linktype") == 113) & (_number(frame, 14, 2) == 0x0800), F.lit(16)))
    ip = F.col("_ip")
    first = _number(ip, 0, 1)
    lower = (frames.withColumn("_offset", offset).where(F.col("_offset").isNotNull())
             .withColumn("_ip", F.expr("substring(frame, _offset + 1, 70000)"))
             .where((F.length(ip) >= 20) & (F.shiftright(first, 4) == 4))
             .withColumns({"_head": first.bitwiseAND(15) * 4, "_proto": _number(ip, 9, 1), "_len": _number(ip, 2, 2)})
             .where(F.col("_proto").isin(6, 17))
             .withColumn("_whole", F.when(F.col("_len") == 0, F.length(ip)).otherwise(F.col("_len")))
             .withColumn("_l4", F.expr("substring(_ip, _head + 1, 70000)")))
    l4, tcp = F.col("_l4"), F.col("_proto") == 6
    words = F.shiftright(_number(l4, 12, 1), 4)
    header = F.when(~tcp, F.lit(8)).when(words == 0, F.lit(20)).otherwise(words * 4)
    held = F.least(F.col("_whole"), F.length(ip))
    return (lower.where(F.length(l4) >= F.when(tcp, F.lit(20)).otherwise(F.lit(8)))
            .withColumn("_l4head", header).select(
        "seq", _address(ip, 12).alias("src_ip"), _number(l4, 0, 2).alias("src_port"),
        _address(ip, 16).alias("dst_ip"), _number(l4, 2, 2).alias("dst_port"),
        F.col("_proto").cast("string").alias("proto"), F.col("_whole").alias("pkt_len"),
        F.col("_l4head").alias("header_len"), "ts_us",
        F.when(tcp, flags_from_bits(_number(l4, 13, 1))).alias("tcp_flags"),
        F.when(tcp, _number(l4, 14, 2)).otherwise(F.lit(0)).alias("tcp_window"),
        F.greatest(held - F.col("_head") - F.col("_l4head"), F.lit(0)).alias("payload_len")))


def read_packets(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, on_damage: str = "fail") -> DataFrame:
    return decode(read_frames(spark, path, split_bytes, on_damage))
