"""Queries A: sources, detection, admission and the sink, with their SQL checks."""

from __future__ import annotations

import os
import re
import struct
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gravure.operators import pixels as px
from gravure.plans import dims
from gravure.registry.fixtures import table, with_tables
from gravure.registry.pixels import digest, scanlines
from gravure.session import shared_dir
from gravure.sources import scan

FALLBACK = b"GIF89a-fallback"


def _blobs(spark, sf):
    return table(spark, sf, "blobs").withColumn("content", F.unhex("head"))


def _urls(spark, sf):
    return scan.split_source_url(table(spark, sf, "object_urls"))


def _a02(spark, sf):
    aliases = table(spark, sf, "region").select(
        F.concat(F.lit("bucket"), F.col("r_regionkey")).alias("bucket"), F.lower("r_name").alias("alias")
    )
    return scan.object_uri(_urls(spark, sf), aliases).select("image_id", "object_uri", "object_status")


def _a05(spark, sf):
    names = lambda prefix, keep: table(spark, sf, "nation").filter(keep).select(
        F.concat(F.lit(prefix), F.col("n_nationkey")).alias("bucket")
    )
    allow = names("bucket", F.col("n_nationkey") < 6).unionByName(names("bkt", F.col("n_nationkey") < 3))
    deny = names("bucket", F.col("n_nationkey").isin(1, 4))
    return scan.bucket_acl(_urls(spark, sf), allow, deny).select("image_id", "bucket")


def _bmp(rows):
    """Top-down 24-bit BMP of one image: rows of (y, bytes in B, G, R order)."""
    lines = [line for _, line in sorted(rows)]
    width = len(lines[0]) // 3
    pad = b"\0" * (-len(lines[0]) % 4)
    body = b"".join(line + pad for line in lines)
    head = struct.pack("<IiiHHIIiiII", 40, width, -len(lines), 1, 24, 0, len(body), 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + head + body


def _bgr(lines):
    """Scanlines of one image as (y, bytes in B, G, R order); lines that come repeatedly are merged by place."""
    of = {}
    for line in lines:
        of.setdefault(line["y"], []).append(np.frombuffer(line["px"], np.uint8).reshape(-1, 4)[:, 2::-1].tobytes())
    merge = lambda same: b"".join(p for _, p in sorted((at, line[at : at + 3]) for line in same for at in range(0, len(line), 3)))
    return [(y, same[0] if len(same) == 1 else merge(same)) for y, same in of.items()]


def _write_files(folder):
    def write(batches):
        for batch in batches:
            for image_id, lines in zip(batch.column("image_id").to_pylist(), batch.column("lines").to_pylist()):
                with open(os.path.join(folder, f"{image_id}.bmp"), "wb") as out:
                    out.write(_bmp(_bgr(lines)))
            yield pa.RecordBatch.from_arrays([batch.column("image_id")], names=["image_id"])

    return write


def _a16(spark, sf):
    """Every image written as a BMP file in the shared folder, scanned back and compared by digest."""
    folder = tempfile.mkdtemp(prefix="scan-", dir=re.sub("^file:/*", "/", shared_dir(spark)))
    images = scanlines(spark, sf).groupBy("image_id").agg(F.collect_list(F.struct("y", "px")).alias("lines"))
    images.mapInArrow(_write_files(folder), "image_id long").write.format("noop").mode("overwrite").save()
    rasters = scan.decode_scan(spark, folder).withColumn(
        "image_id", F.regexp_extract("origin", r"([0-9]+)\.bmp$", 1).cast("bigint")
    )
    return digest(px.unpack_raster(rasters, lines=True))


def _a17(spark, sf):
    folder = os.path.join(tempfile.mkdtemp(prefix="out-", dir=shared_dir(spark)), "renditions")
    log = table(spark, sf, "request_log").select("req_id", "format", "origin_bytes", "result_bytes")
    scan.write_renditions(log, folder)
    return (
        spark.read.parquet(folder)
        .groupBy("format")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("origin_bytes").alias("origin_bytes"), F.sum("result_bytes").alias("result_bytes"))
    )


def _a15(spark, sf):
    """A watermark from base64 data, its bytes matched against every file head."""
    aux = scan.aux_image(spark, base64_data="/9j/4A==").select(F.hex("content").alias("head"))
    return table(spark, sf, "blobs").join(aux, "head").select("image_id", "head")


QUERIES = {
    "a01_scan_local": lambda spark, sf: scan.scan_local(spark, sf, "*.parquet", content=False).select(
        F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length"
    ),
    "a02_scan_object_store": _a02,
    "a03_split_source_url": lambda spark, sf: _urls(spark, sf).select("image_id", "scheme", "bucket", "key", "query"),
    "a04_gate_scheme": lambda spark, sf: scan.gate_scheme(_urls(spark, sf), ["s3", "gs", "local"]).select(
        "image_id", "scheme_status"
    ),
    "a05_bucket_acl": _a05,
    "a06_detect_type": lambda spark, sf: scan.detect_type(_blobs(spark, sf)).select("image_id", "format", "type_status"),
    "a07_exclude_raw": lambda spark, sf: scan.exclude_raw(_blobs(spark, sf)).select("image_id", "ext", "content_type"),
    "a08_detect_svg": lambda spark, sf: table(spark, sf, "pages").select(
        "page_id",
        scan.is_svg(
            F.encode(
                F.concat(
                    F.when(F.col("page_id") % 4 == 0, "<!-- <svg> -->")
                    .when(F.col("page_id") % 4 == 1, "<x:svg width='1'>")
                    .when(F.col("page_id") % 4 == 2, "<svgx>")
                    .otherwise("<svg\n>"),
                    F.col("html"),
                ),
                "UTF-8",
            )
        ).alias("is_svg"),
    ),
    "a09_limit_file_size": lambda spark, sf: scan.limit_file_size(_blobs(spark, sf), 400).select("image_id", "length", "size_status"),
    "a10_file_etag": lambda spark, sf: scan.file_etag(_blobs(spark, sf)).select("image_id", "etag"),
    "a11_content_type": lambda spark, sf: scan.content_type(scan.detect_type(_blobs(spark, sf))).select("image_id", "mime"),
    "a12_slice_range": lambda spark, sf: scan.slice_range(_blobs(spark, sf)).select(
        "image_id", F.hex("part").alias("part"), "content_range", "range_status"
    ),
    "a13_fetch_outcome": lambda spark, sf: scan.fetch_outcome(_blobs(spark, sf)).select("image_id", "status", "error"),
    "a14_fallback_image": lambda spark, sf: scan.fallback_image(scan.fetch_outcome(_blobs(spark, sf)), FALLBACK, 200).select(
        "image_id", "status", F.hex("content").alias("content"), "expires", "last_modified", "is_fallback"
    ),
    "a15_aux_image": _a15,
    "a16_decode_scan": _a16,
    "a17_write_renditions": _a17,
}

_IN = lambda names: ", ".join(f"'{n}'" for n in names)
_RAW = f"(lower(ext) IN ({_IN(dims.RAW_EXTENSIONS)}) OR content_type IN ({_IN(dims.RAW_MIME_TYPES)}))"
_TYPE = f"""dt AS (SELECT *, CASE WHEN head LIKE 'FFD8%' THEN 'jpeg' WHEN head LIKE 'FF0A%' OR head LIKE '0000000C4A584C200D0A870A%' THEN 'jxl'
  WHEN head LIKE '89504E470D0A1A0A%' THEN 'png' WHEN head LIKE '52494646________57454250%' THEN 'webp' WHEN head LIKE '47494638__61%' THEN 'gif'
  WHEN head LIKE '00000100%' THEN 'ico' WHEN substr(head, 9, 8) = '66747970' AND substr(head, 17, 8) IN ('68656963', '68656978', '68657663',
    '6865696D', '68656973', '6865766D', '68657673', '6D696631') THEN 'heic'
  WHEN substr(head, 9, 16) = '6674797061766966' THEN 'avif' WHEN head LIKE '424D%' THEN 'bmp'
  WHEN (head LIKE '49492A00%' OR head LIKE '4D4D002A%') AND NOT {_RAW} THEN 'tiff' WHEN image_id % 20 IN (16, 18) THEN 'svg' END AS fmt FROM blobs)"""
_SPLIT = """sp AS (SELECT image_id, split_part(source_url, '://', 1) AS scheme, split_part(substr(source_url, strpos(source_url, '://') + 3), '/', 1) AS bucket,
    regexp_replace(regexp_replace(substr(source_url, strpos(source_url, '://') + 3), '^[^/]*', ''), '^/+', '') AS rest FROM object_urls),
sq AS (SELECT *, split_part(rest, '?', 1) AS key, CASE WHEN contains(rest, '?') THEN substr(rest, strpos(rest, '?') + 1) ELSE '' END AS query FROM sp)"""
_OUTCOME = """oc AS (SELECT *, regexp_extract(coalesce(content_range, ''), '^bytes ((\\*|(\\d+)-(\\d+))/(\\*|\\d+))$', 1) AS cr FROM blobs),
of AS (SELECT *, CASE WHEN origin_status IN (200, 304) THEN origin_status WHEN origin_status = 206 THEN CASE
    WHEN cr = '0-99/100' OR (cr = '0-99/*' AND content_length = 100) THEN 200 ELSE 404 END
  WHEN origin_status BETWEEN 400 AND 499 THEN origin_status WHEN origin_status >= 500 THEN 502 ELSE 404 END AS st FROM oc)"""

ORACLES = {
    "a02_scan_object_store": with_tables(
        "object_urls",
        f"""{_SPLIT},
al AS (SELECT 'bucket' || r_regionkey AS bucket, lower(r_name) AS alias FROM region)
SELECT image_id, CASE WHEN key <> '' AND (sq.bucket <> '' OR scheme = 'local') THEN
  CASE scheme WHEN 's3' THEN 's3a' WHEN 'abs' THEN 'abfss' WHEN 'local' THEN 'file' ELSE scheme END || '://' || coalesce(alias, sq.bucket) || '/' || key END AS object_uri,
  CAST(CASE WHEN key <> '' AND (sq.bucket <> '' OR scheme = 'local') THEN NULL ELSE 404 END AS BIGINT) AS object_status
FROM sq LEFT JOIN al ON al.bucket = sq.bucket""",
    ),
    "a03_split_source_url": with_tables("object_urls", _SPLIT + "\nSELECT image_id, scheme, bucket, key, query FROM sq"),
    "a04_gate_scheme": with_tables(
        "object_urls",
        _SPLIT
        + """
SELECT image_id, CAST(CASE WHEN scheme IN ('http', 'https', 's3', 'gs', 'local') THEN NULL ELSE 404 END AS BIGINT) AS scheme_status FROM sq""",
    ),
    "a05_bucket_acl": with_tables(
        "object_urls",
        _SPLIT
        + """
SELECT image_id, bucket FROM sq WHERE bucket IN (SELECT 'bucket' || n_nationkey FROM nation WHERE n_nationkey < 6
  UNION ALL SELECT 'bkt' || n_nationkey FROM nation WHERE n_nationkey < 3)
  AND bucket NOT IN (SELECT 'bucket' || n_nationkey FROM nation WHERE n_nationkey IN (1, 4))""",
    ),
    "a06_detect_type": with_tables(
        "blobs",
        _TYPE + "\nSELECT image_id, fmt AS format, CAST(CASE WHEN fmt IS NULL THEN 422 END AS BIGINT) AS type_status FROM dt",
    ),
    "a07_exclude_raw": with_tables("blobs", f"SELECT image_id, ext, content_type FROM blobs WHERE NOT {_RAW}"),
    "a08_detect_svg": """SELECT page_id, page_id % 4 IN (1, 3) OR regexp_matches(regexp_replace(html, '(?s)<!--.*?(-->|$)', '', 'g'),
  '<([A-Za-z_][A-Za-z0-9_.-]*:)?svg[\\s/>]') AS is_svg FROM pages""",
    "a09_limit_file_size": "SELECT p_partkey AS image_id, 100 + p_partkey * 3 AS length, CAST(CASE WHEN 100 + p_partkey * 3 > 400 THEN 422 END AS BIGINT) AS size_status FROM part",
    "a10_file_etag": with_tables(
        "blobs",
        """SELECT image_id, '"' || rtrim(translate(to_base64(unhex(sha256(path || '__' || length || '__' || mtime_ns))), '+/', '-_'), '=') || '"' AS etag FROM blobs""",
    ),
    "a11_content_type": with_tables(
        "blobs",
        f"""{_TYPE}
SELECT image_id, CASE WHEN fmt = 'ico' THEN 'image/x-icon' WHEN fmt = 'svg' THEN 'image/svg+xml' WHEN fmt = 'heic' THEN 'image/heif'
  WHEN fmt IS NOT NULL THEN 'image/' || fmt WHEN ext = '.tiff' THEN 'image/tiff' WHEN ext = '.jpg' THEN 'image/jpeg' WHEN ext = '.svg' THEN 'image/svg+xml'
  ELSE 'application/octet-stream' END AS mime FROM dt""",
    ),
    "a12_slice_range": with_tables(
        "blobs",
        """r AS (SELECT *, len(head) // 2 AS n, CASE image_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 4 THEN 1 END AS s,
  CASE image_id % 9 WHEN 0 THEN 3 WHEN 1 THEN len(head) // 2 - 1 WHEN 4 THEN 2 END AS e FROM blobs)
SELECT image_id, CASE WHEN s IS NOT NULL THEN substr(head, 2 * s + 1, greatest(0, 2 * (e - s + 1))) WHEN image_id % 9 IN (6, 7, 8) THEN head END AS part,
  CASE WHEN s IS NOT NULL THEN 'bytes ' || s || '-' || e || '/' || n END AS content_range,
  CAST(CASE WHEN s IS NOT NULL THEN 206 WHEN image_id % 9 IN (6, 7, 8) THEN 200 ELSE 416 END AS BIGINT) AS range_status FROM r""",
    ),
    "a13_fetch_outcome": with_tables(
        "blobs",
        _OUTCOME
        + """
SELECT image_id, CAST(st AS BIGINT) AS status, CASE WHEN origin_status = 304 THEN 'not modified' WHEN origin_status = 206 THEN
  CASE WHEN cr = '' THEN 'invalid content range' WHEN st = 404 THEN 'incomplete content' END
  WHEN origin_status <> 200 THEN 'status: ' || origin_status END AS error FROM of""",
    ),
    "a14_fallback_image": with_tables(
        "blobs",
        _OUTCOME
        + f"""
SELECT image_id, CAST(CASE WHEN st >= 400 THEN 200 ELSE st END AS BIGINT) AS status,
  CASE WHEN st >= 400 THEN '{FALLBACK.hex().upper()}' ELSE head END AS content, CASE WHEN st < 400 THEN expires END AS expires,
  CASE WHEN st < 400 THEN last_modified END AS last_modified, st >= 400 AS is_fallback FROM of""",
    ),
    "a15_aux_image": with_tables("blobs", "SELECT image_id, head FROM blobs WHERE head = 'FFD8FFE0'"),
    "a16_decode_scan": with_tables(
        "pixels",
        """dg AS (SELECT image_id, y, md5(string_agg(concat_ws(',', r, g, b, 255), ';' ORDER BY x)) AS d, count(*) AS n FROM pixels GROUP BY ALL)
SELECT image_id, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(d, '' ORDER BY y)) AS digest FROM dg GROUP BY image_id""",
    ),
    "a17_write_renditions": with_tables(
        "request_log",
        """SELECT format, count(*) AS n, CAST(sum(origin_bytes) AS BIGINT) AS origin_bytes, CAST(sum(result_bytes) AS BIGINT) AS result_bytes
FROM request_log GROUP BY format""",
    ),
}
