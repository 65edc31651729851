"""Web archives: WARC files with revisit records, and capture histories from merged indexes.

Pages become WARC/1.1 records in plain SQL expressions; Spark's text writer puts them into gzip
files of about `ARCHIVE_BYTES`, so the commit protocol of any Hadoop file system applies. Reading
back gives one sorted run of index entries per archive. The runs are dealt out by ranges of URL key
and time, and each range is merged from its slices of all runs with a loser tree, which gives
the captures of every URL in order, over all archives.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ARCHIVE_BYTES = 32 << 20           # records of one archive file, before compression, on average
REVISIT_BYTES = 100                # shorter payloads are always stored again
RANGE_ROWS = 200_000               # index entries merged by one task, about
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"
_END = "\r\n\r\n"


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(record): one WARC record per row, without the two line ends that close it.

    The payload is the html in UTF-8; null is empty. Of rows with equal payloads of REVISIT_BYTES or
    more, those with the smallest id are responses and the others revisit it; an id of null is larger
    than any other. The tables have no capture time: it is the id in seconds after the start of 2020.
    """
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("body"))
    rows = rows.withColumns({"digest": F.sha2("body", 256), "size": F.octet_length("body").cast("long")})
    # the body stays out of this branch; short payloads get keys of their own, so they meet no hot key
    firsts = (rows.where(F.col("size") >= REVISIT_BYTES).groupBy(F.col("digest").alias("key")).agg(F.min("id").alias("first_id")))
    key = F.when(F.col("size") >= REVISIT_BYTES, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = rows.withColumn("key", key).join(firsts, "key", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))

    def name(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(">"))
    when = F.date_format(F.expr("timestampadd(SECOND, cast(pmod(coalesce(id, 0), 1000000000) as int), timestamp_ntz'2020-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("size").cast("string"), F.lit(_END))
    block = F.when(F.col("revisit"), F.col("http")).otherwise(F.concat("http", "body"))
    head = F.concat(
        F.lit("WARC/1.1" + _EOL + "WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(_EOL + "WARC-Record-ID: "), name("id"), F.lit(_EOL + "WARC-Date: "), when,
        F.coalesce(F.concat(F.lit(_EOL + "WARC-Target-URI: "), line), F.lit("")),
        F.lit(_EOL + "WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(F.col("revisit"), F.concat(F.lit(f"{_EOL}WARC-Profile: {PROFILE}{_EOL}WARC-Refers-To: "), name("first_id"))).otherwise(""),
        F.lit(_EOL + "Content-Type: application/http; msgtype=response" + _EOL + "Content-Length: "),
        (F.octet_length("http") + F.when(F.col("revisit"), F.lit(0).cast("long")).otherwise(F.col("size"))).cast("string"), F.lit(_END))
    rows = rows.withColumn("revisit", revisit).withColumn("http", http)
    return rows.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes the records of all pages to gzip files in the folder."""
    size = pages.agg(F.avg(F.octet_length(html)).alias("n")).first().n or 0
    each = max(1, int(ARCHIVE_BYTES / (size + 600)))
    records(pages, page_id, url, html).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", each).text(folder)


def url_key(url: str) -> str:
    """The host's labels in reverse, then path and query: captures of one site stand together."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    port = "" if port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{port}"
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def unpack(content: bytes) -> bytes:
    """All gzip members of a file."""
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        if not member.eof:
            raise ValueError("archive is cut off")
        content = member.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record; a damaged archive is an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(h.split(": ", 1) for h in data[at:end].decode("utf-8").split("\r\n")[1:])
        begin = end + 4
        stop = begin + int(headers["Content-Length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield at, stop + 4 - at, headers, data[begin:stop]
        at = stop + 4


ENTRY = ("urlkey string, captured string, page_id long, run string, seq long, offset long, length long, record_type string, "
         "payload_bytes long, payload_digest string, refers_to long")
_FIELDS = [f.split()[0] for f in ENTRY.split(", ")]
_ARROW = pa.schema([(f.split()[0], pa.string() if f.split()[1] == "string" else pa.int64()) for f in ENTRY.split(", ")])


def _number(name: str | None) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">") if name else "-"
    return None if value == "-" else int(value)


def _order(entry: tuple) -> tuple:
    """URL key, time, then id with null first."""
    return entry[0] or "", entry[1], entry[2] is not None, entry[2] or 0


def run_of(path: str, content: bytes) -> list[tuple]:
    """One archive's index entries, sorted. Payloads are hashed again and held against their headers."""
    run, out = path.rsplit("/", 1)[-1], []
    for offset, length, headers, block in parse(unpack(content)):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(dict(h.split(": ", 1) for h in http.decode().split("\r\n")[1:])["Content-Length"])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        kind = headers["WARC-Type"]
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"{path}: payload at byte {offset} is damaged")
        url = headers.get("WARC-Target-URI")
        out.append([url_key(url) if url is not None else None, headers["WARC-Date"], _number(headers["WARC-Record-ID"]), run, 0, offset, length,
                    kind, size, digest, _number(headers.get("WARC-Refers-To"))])
    out.sort(key=_order)
    for i, entry in enumerate(out):
        entry[4] = i
    return [tuple(e) for e in out]


def _table(entries: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in entries], _ARROW.field(i).type) for i in range(len(_FIELDS))], schema=_ARROW)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The index entries of all archives of a folder, sorted within each archive (run, seq)."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                entries = run_of(path.as_py(), content.as_py())
                for lo in range(0, len(entries), 10_000):
                    yield _table(entries[lo:lo + 10_000])
    return files.mapInArrow(run, ENTRY)


class LoserTree:
    """Merges sorted lists: every inner node remembers the list that lost there, so the next
    smallest entry costs one comparison for each level."""

    def __init__(self, lists: list[list], key):
        self.lists, self.key = lists, key
        self.size = 1
        while self.size < max(1, len(lists)):
            self.size *= 2
        self.place = [0] * self.size
        self.heads = [self._head(i) for i in range(self.size)]
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _head(self, i: int):
        """(exhausted, key) of list i: the end of a list is larger than any key."""
        if i >= len(self.lists) or self.place[i] >= len(self.lists[i]):
            return (True,)
        return (False, self.key(self.lists[i][self.place[i]]), i)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self.heads[b] < self.heads[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        heads, losers = self.heads, self.losers
        while not heads[self.winner][0]:
            i = self.winner
            yield self.lists[i][self.place[i]]
            self.place[i] += 1
            heads[i] = self._head(i)
            node = (i + self.size) // 2
            while node:
                if heads[losers[node]] < heads[i]:
                    i, losers[node] = losers[node], i
                node //= 2
            self.winner = i


def histories(runs: DataFrame, rows: int) -> DataFrame:
    """All entries in the order of URL key, time and id: each partition in order, and the partitions
    one after the other. `rows` is their number; a URL with very many captures is split by time."""
    order = [F.coalesce("urlkey", F.lit("")), F.col("captured"), F.col("page_id").asc_nulls_first(), F.col("run"), F.col("seq")]
    dealt = runs.repartitionByRange(max(1, -(-rows // RANGE_ROWS)), *order).sortWithinPartitions("run", "seq")

    def run(batches):
        lists, last = [], None
        for batch in batches:
            columns = [batch.column(f).to_pylist() for f in _FIELDS]
            for entry in zip(*columns):
                if entry[3] != last:
                    lists.append([])
                    last = entry[3]
                lists[-1].append(entry)
        out = []
        for entry in LoserTree(lists, _order):
            out.append(entry)
            if len(out) == 10_000:
                yield _table(out)
                out = []
        if out:
            yield _table(out)
    return dealt.mapInArrow(run, ENTRY)
