"""Streams give what their batch twins give; late rows are dropped."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.plans.requests import parse_requests
from gravure.registry.fixtures import table
from gravure.streaming import jobs


def test_stream_plan_equals_batch(spark, sf_dir):
    columns = ["req_id", "width", "height", "resizing_type", "source_url", "option_error"]
    events = jobs.table_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    stream = jobs.run_available(jobs.stream_plan(table(spark, sf_dir, "requests", events=events)).select(*columns))
    batch = parse_requests(table(spark, sf_dir, "requests")).select(*columns)
    assert stream.exceptAll(batch).count() == 0 and batch.count() == stream.count()


def test_late_rows_are_dropped(spark, tmp_path):
    """One file per batch: the fourth is older than the watermark of the batch before it."""
    schema = "ts timestamp, status int, duration_us long"
    stamps = ("01 00:05:00", "01 06:00:00", "01 06:30:00", "01 00:10:00", "02 00:00:00")
    for i, stamp in enumerate(f"2024-01-{s}" for s in stamps):
        spark.createDataFrame([(stamp, 200, 5)], "t string, status int, duration_us long").select(
            F.col("t").cast("timestamp").alias("ts"), "status", "duration_us"
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))
    rows = jobs.run_available(jobs.stream_metrics(stream, "1 hour")).collect()
    assert sum(r.n for r in rows if r.window_start.hour == 0 and r.window_start.day == 1) == 1


def test_ingest_reads_the_head_of_a_file_only(spark, tmp_path):
    """Files beyond what the reader of whole files takes; heads, paths and sizes are those of the files."""
    files = {
        "a b%.jpg": b"\xff\xd8\xff\xe0" + b"x\n" * 5000, "n.jxl": b"\xff\x0a", "cut.jxl": b"\xff", "p.png": b"\x89PNG\r\n\x1a\n" + b"\0" * 90000,
        "s.svg": b"y" * 20000 + b"\r\n<svg>", "open.svg": b"<svg", "marked.svg": b"\xef\xbb\xbf<svg", "far.svg": b"y\n" * 20000 + b"<svg>", "z.gz": b"\x89PNG\r\n\x1a\nz",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        rows = jobs.run_available(jobs.stream_ingest(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {r.path: r.length for r in rows} == {f"file:{tmp_path}/{n}": len(c) for n, c in files.items()} and len(rows) == len(files)
    types = {r.path.rsplit("/", 1)[1]: r.format for r in rows}
    expected = {"a b%.jpg": "jpeg", "n.jxl": "jxl", "p.png": "png", "s.svg": "svg", "z.gz": "png"}
    assert types == {n: expected.get(n) for n in files}
