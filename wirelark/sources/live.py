"""Capture files that are still being written, as a stream.

The source `capture` tails all capture files below a folder. How far each is read is a place between two records,
so a record that is not whole yet waits for the next look. These places are the stream's offsets: they are kept
in its checkpoint, and a query that is started again goes on from them, without loss or repeats. New bytes of a
file are dealt over tasks in parts of about `splitBytes`. A file that shrinks or goes is an error, as its records
could not be read again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from wirelark.sources import pcap, pcapng

SCHEMA = "seq long, ts_us long, linktype int, frame binary"
SPLIT_BYTES = 32 * 1024 * 1024


class Part(InputPartition):
    def __init__(self, uri: str, number: int, length: int, start: int, stop: int, interfaces: str):
        self.uri, self.number, self.length, self.start, self.stop, self.interfaces = uri, number, length, start, stop, interfaces


class CaptureReader(DataSourceStreamReader):
    """Offsets are {file: [number, place]}; numbers are given in the order in which files are first seen."""

    def __init__(self, options):
        self.folder, self.split_bytes = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.seen: dict[str, list[int]] = {}

    def _files(self) -> dict[str, int]:
        source, root = fs.FileSystem.from_uri(pcap.arrow_uri(self.folder))
        found = source.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        store = self.folder.rstrip("/").removesuffix(root.rstrip("/"))            # arrow names files without it
        return {store + f.path: f.size for f in found if f.is_file and not f.base_name.startswith((".", "_"))}

    def initialOffset(self) -> dict:
        return {}

    def _known(self, start: dict) -> None:
        for path, place in start.items():
            if path not in self.seen or self.seen[path][1] < place[1]:
                self.seen[path] = list(place)

    def latestOffset(self) -> dict:
        for path, length in sorted(self._files().items()):
            number, place = self.seen.get(path, [len(self.seen), 0])
            if length <= max(place, pcap.GLOBAL_HEADER):
                continue                                   # nothing new, or not even a header yet
            file = pcap._File(path, length)
            begin = place or (0 if file.blocks else pcap.GLOBAL_HEADER)
            stop = file.walk(begin, length)[0]             # a record that is not whole ends the walk
            if stop > begin:
                self.seen[path] = [number, stop]
        return {path: list(place) for path, place in self.seen.items()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self._known(start)
        self._known(end)
        out, sizes = [], self._files()
        for path, (number, stop) in sorted(end.items()):
            begin = start.get(path, [number, 0])[1]
            if begin >= stop:
                continue
            if sizes.get(path, 0) < stop:
                raise FileNotFoundError(f"{path} is shorter than what was seen of it")
            file = pcap._File(path, stop)
            begin = begin or (0 if file.blocks else pcap.GLOBAL_HEADER)
            known = [file.walk(0, begin)[2]] if file.blocks and begin else []
            while begin < stop:
                upto, damaged, more = file.walk(begin, min(stop, begin + self.split_bytes))
                if damaged is not None:
                    raise pcap.Damaged(f"{path}: the record at byte {damaged} is damaged")
                out.append(Part(path, number, stop, begin, upto, pcapng.contexts([*known, None])[-1]))
                known.append(more)
                begin = upto
        return out

    def read(self, partition: Part) -> Iterator:
        file, rows, size = pcap._File(partition.uri, partition.length), [], 0
        for place, ts_us, linktype, frame in file.frames(partition.start, partition.stop, json.loads(partition.interfaces)):
            rows.append((partition.number << 40 | place, ts_us, linktype, frame))
            size += len(frame)
            if size > 4_000_000 or len(rows) >= 10_000:
                yield pcap._frame_batch(rows)
                rows, size = [], 0
        if rows:
            yield pcap._frame_batch(rows)

    def commit(self, end: dict) -> None:
        self._known(end)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def stream_frames(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(seq, ts_us, linktype, frame) of the capture files below `path` as they grow; see `pcap.decode`."""
    spark.dataSource.register(CaptureSource)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return spark.readStream.format("capture").option("path", uri).option("splitBytes", split_bytes).load()
