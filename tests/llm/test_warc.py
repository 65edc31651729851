import gzip
import hashlib
import random

import pytest

from wirelark.llm import warc


def written(spark, tmp_path, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    folder = f"file://{tmp_path}/archives"
    warc.write_archives(pages, folder)
    return folder


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 40
    rows = [(5, "http://b.org/x", big, "r"), (3, "http://a.org/", big, "r"), (9, None, big, "r"), (4, "http://a.org/", "short", "r"), (8, "http://a.org/", "short", "r"),
            (1, "http://c.org/\r\nWARC-Type: fake", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "r"), (2, "not a url", None, "r"), (7, "http://[bad", "", "r"),
            (None, "http://n.org", big, "r"), (3, "http://a.org/", big, "r"), (11, "", "x" * 300_000, "r")]
    runs = warc.read_runs(spark, written(spark, tmp_path, rows))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.histories(runs, len(rows)).collect()), key=str)
    want = []
    for page, _, html, _ in rows:
        body = (html or "").encode()
        revisit = html == big and page != 3
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=str)


def test_histories_are_in_order_over_all_archives(spark, tmp_path, monkeypatch):
    draw = random.Random(1)
    rows = [(i, draw.choice(["http://hot.org/a", f"http://h{i % 7}.net/{i % 3}"]), f"page {i} " * 20, "r") for i in range(900)]
    draw.shuffle(rows)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 100)
    runs = warc.read_runs(spark, written(spark, tmp_path, rows))
    assert runs.select("run").distinct().count() > 8
    merged = warc.histories(runs, 900).collect()
    keys = [(r.urlkey, r.captured, r.page_id) for r in merged]
    assert keys == sorted(keys) and len(keys) == 900


def test_loser_tree():
    draw = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16, 33):
        lists = [sorted(draw.randrange(50) for _ in range(draw.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(lists, lambda x: x)) == sorted(x for own in lists for x in own)


def test_damage_is_an_error():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for *_, b in warc.parse(record * 2)] == [b"abc"] * 2
    with pytest.raises(ValueError):
        list(warc.parse(record[:-2]))
    with pytest.raises(ValueError):
        list(warc.parse(b"junk" + record))
    with pytest.raises(ValueError):
        warc.unpack(gzip.compress(record)[:-9])
    assert warc.unpack(gzip.compress(record) + gzip.compress(record)) == record * 2


def test_url_keys():
    assert warc.url_key("HTTP://www.Example.org:80/a?b=1#c") == "org,example)/a?b=1"
    assert warc.url_key("https://x.example.org:8080") == "org,example,x:8080)/"


def test_empty(spark, tmp_path):
    folder = written(spark, tmp_path, [])
    assert warc.histories(warc.read_runs(spark, folder), 0).count() == 0
