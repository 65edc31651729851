"""The newest records of a long log: the place of its broken lines is found in one pass."""

from pyspark.sql import functions as F

from wirelark.operators import auditlog

SCHEMA = "epoch bigint, seq bigint"


def log(spark, folder, lines):
    folder.mkdir()
    (folder / "a.jsonl").write_text("".join(f"{line}\n" for line in lines))
    return str(folder)


def test_a_broken_line_has_the_place_of_the_record_before_it_or_else_of_the_first_one(spark, tmp_path):
    record = lambda i: f'{{"epoch": {i}, "seq": {i}}}'
    path = log(spark, tmp_path / "log", ["{first", "{second", record(5), record(7), "{third", record(6), "{fourth"])
    want = [("{first", None), ("{second", None), (None, 5), (None, 6), ("{fourth", None), (None, 7), ("{third", None)]
    assert [(r.raw, r.seq) for r in auditlog.recent(spark, path, SCHEMA, 9).collect()] == want
    assert [(r.raw, r.seq) for r in auditlog.recent(spark, log(spark, tmp_path / "none", ["{a", "{b"]), SCHEMA, 9).collect()] == [("{a", None), ("{b", None)]


def test_no_frame_begins_anew_at_each_line(spark, tmp_path):
    """A frame from each row to the end of its block is summed again for every row: 100,000 lines took minutes."""
    n = 30_000
    path = log(spark, tmp_path / "log", ["{broken 0" if i == 0 or i % 10 == 7 else f'{{"epoch": {i}, "seq": {i}}}' for i in range(n)])
    out = auditlog.recent(spark, path, SCHEMA, 12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "currentrow$(), unboundedfollowing$()" not in plan
    got = out.select(F.coalesce(F.col("seq").cast("string"), "raw").alias("v")).collect()
    assert [r.v for r in got] == [str(i) if i % 10 != 7 else "{broken 0" for i in range(n - 12, n)]
