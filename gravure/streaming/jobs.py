"""Structured Streaming jobs: the batch operators on unbounded tables.

The request log and the landing folder arrive as streams. Stateless planning reuses the
batch functions as they are; state lives only in Spark's own windows, deduplication,
sessions and interval joins, all bounded by a watermark on event time. Every query
checkpoints to the shared folder, so it survives the loss of executors or of the driver.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravure.plans.requests import parse_requests
from gravure.session import shared_dir
from gravure.sources.scan import DETECTION_WINDOW, detect_type, limit_file_size

WATERMARK = "10 minutes"
# Names of files that Spark's text reader would decompress.
COMPRESSED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|zstd|xz)$"
_HEAD = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream; zone-less `ts` becomes an event time."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace(".parquet", "*.parquet"))
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, into Parquet under the shared folder, and return the result."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{base}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def stream_plan(requests: DataFrame, presets: DataFrame | None = None, **settings) -> DataFrame:
    """Requests to typed plans, row by row; no state."""
    return parse_requests(requests, presets=presets, **settings)


def _heads(batches):
    """The first bytes of each file from its lines, which come in order; a file's first block holds them all."""
    path, facts, lines, size = None, None, [], 0

    def row():
        # A newline was put behind the last line, too, which may have none; a byte order mark (3 bytes) was left out.
        head = b"".join(lines)
        head = head[:-1] if size < DETECTION_WINDOW and size - facts[1] in (1, -2) else head[:DETECTION_WINDOW]
        out = {"path": unquote(path), "modificationTime": facts[0], "length": facts[1], "content": head}
        return pa.RecordBatch.from_pylist([out], schema=_HEAD)

    for batch in batches:
        stamps, lengths = batch.column("modificationTime"), batch.column("length")
        for i, (name, line) in enumerate(zip(batch.column("path").to_pylist(), batch.column("line").to_pylist())):
            if name != path:
                if path is not None:
                    yield row()
                path, facts, lines, size = name, (stamps[i].as_py(), lengths[i].as_py()), [], 0
            if size < DETECTION_WINDOW:
                lines.append(line + b"\n")
                size += len(line) + 1
    if path is not None:
        yield row()


def stream_ingest(spark: SparkSession, folder: str, pattern: str = "*", max_bytes: int = 0) -> DataFrame:
    """Files landing in a folder, with their type and the size gate.

    A type shows in the first bytes, and Spark's reader of whole files would read a file of any size in one task. The
    text reader deals a file out by blocks; only lines of its first block are kept. Empty files have no lines, and files
    named as compressed would be opened by that reader: those come from the reader of whole files.
    """
    read = lambda kind: spark.readStream.format(kind).option("pathGlobFilter", pattern)
    schema = "path string, modificationTime timestamp, length long, content binary"
    name, size = F.col("_metadata.file_name"), F.col("_metadata.file_size")
    apart = name.rlike(COMPRESSED) | (size == 0)
    whole = read("binaryFile").schema(schema).load(folder).where(apart)
    lines = read("text").option("lineSep", "\n").schema("value string").load(folder).where(~apart & (F.col("_metadata.file_block_start") == 0))
    lines = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modificationTime"), size.alias("length"),
        F.substring(F.col("value").cast("binary"), 1, DETECTION_WINDOW).alias("line"),
    )
    files = whole.select("path", "modificationTime", "length", "content").unionByName(lines.mapInArrow(_heads, schema))
    named = limit_file_size(files, max_bytes).withColumns(
        {"ext": F.regexp_extract("path", r"\.[^./]*$", 0), "content_type": F.lit("")}
    )
    return detect_type(named).drop("content", "content_type")


def stream_metrics(log: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Requests and errors per status and window; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        log.withWatermark("ts", WATERMARK)
        .groupBy(window.alias("w"), "status")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("duration_us").alias("sum_us"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "n", "sum_us")
    )


def stream_dedupe(requests: DataFrame, key: Column) -> DataFrame:
    """First request of a rendition within the watermark's horizon."""
    keyed = requests.withColumn("rendition_key", key).withWatermark("ts", WATERMARK)
    return keyed.dropDuplicatesWithinWatermark(["rendition_key"])


def client_sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of requests per client, closed by a gap."""
    return (
        log.withWatermark("ts", WATERMARK)
        .groupBy(F.session_window("ts", gap).alias("s"), "client")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("client", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
    )


def unfinished_requests(starts: DataFrame, ends: DataFrame, timeout: str = "10 seconds") -> DataFrame:
    """Started requests without an end in time.

    starts(req_id, ts), ends(req_id, end_ts). On streams, an outer interval join whose state
    the two watermarks bound; on tables, the same join over the whole log.
    """
    if starts.isStreaming:
        starts, ends = starts.withWatermark("ts", WATERMARK), ends.withWatermark("end_ts", WATERMARK)
    left, right = starts.alias("s"), ends.alias("e")
    in_time = (
        (F.col("s.req_id") == F.col("e.req_id"))
        & (F.col("e.end_ts") >= F.col("s.ts"))
        & (F.col("e.end_ts") <= F.col("s.ts") + F.expr(f"INTERVAL {timeout}"))
    )
    joined = left.join(right, in_time, "left_outer")
    return joined.filter(F.col("e.req_id").isNull()).select(F.col("s.req_id").alias("req_id"), F.col("s.ts").alias("ts"))
