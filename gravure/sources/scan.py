"""Sources: file and object scans, URL mapping, type detection, admission, the sink."""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravure.functions.text import b64url_encode
from gravure.plans import dims

# Fixed value: bytes looked at when a type is detected.
DETECTION_WINDOW = 32_768
# Hex patterns of leading bytes, first match wins.
MAGIC = (
    ("jpeg", "^FFD8"),
    ("jxl", "^(FF0A|0000000C4A584C200D0A870A)"),
    ("png", "^89504E470D0A1A0A"),
    ("webp", "^52494646.{8}57454250"),
    ("gif", "^47494638..61"),
    ("ico", "^00000100"),
    ("heic", "^.{8}66747970(68656963|68656978|68657663|6865696D|68656973|6865766D|68657673|6D696631)"),
    ("avif", "^.{8}6674797061766966"),
    ("bmp", "^424D"),
)
TIFF_MAGIC = "^(49492A00|4D4D002A)"
# Source schemes and the file-system scheme each is read through.
SCHEME_FILESYSTEMS = {"s3": "s3a", "gs": "gs", "abs": "abfss", "swift": "swift", "local": "file"}
WEB_SCHEMES = ("http", "https")


def scan_local(spark: SparkSession, root: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """Files under a root: path, modificationTime, length, content (left unread unless asked)."""
    df = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    return df if content else df.drop("content")


def scan_objects(spark: SparkSession, uris: list[str], content: bool = True) -> DataFrame:
    """Objects of any Hadoop file system, by mapped URIs (see object_uri)."""
    df = spark.read.format("binaryFile").load(uris)
    return df if content else df.drop("content")


def split_source_url(df: DataFrame, separator: str = "?", url: str = "source_url") -> DataFrame:
    """scheme, bucket, key and query; '%', '?' and '#' are plain characters of a key."""
    value = F.col(url)
    after = F.regexp_extract(value, "^[a-zA-Z][a-zA-Z0-9+.-]*://(.*)$", 1)
    path = F.ltrim(F.when(F.instr(after, "/") > 0, F.substr(after, F.instr(after, "/"))).otherwise(F.lit("")), F.lit("/"))
    df = df.withColumns(
        {
            "scheme": F.regexp_extract(value, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1),
            "bucket": F.substring_index(after, "/", 1),
            "_path": path,
        }
    )
    if not separator:
        return df.withColumns({"key": F.col("_path"), "query": F.lit("")}).drop("_path")
    at = F.instr(F.col("_path"), separator)
    return df.withColumns(
        {
            "key": F.when(at > 0, F.left("_path", at - 1)).otherwise(F.col("_path")),
            "query": F.when(at > 0, F.substr(F.col("_path"), at + len(separator))).otherwise(F.lit("")),
        }
    ).drop("_path")


def gate_scheme(df: DataFrame, enabled: list[str]) -> DataFrame:
    """scheme_status is 404 for schemes that are not registered (after split_source_url)."""
    known = F.col("scheme").isin(*WEB_SCHEMES, *enabled)
    return df.withColumn("scheme_status", F.when(~known, 404).cast("bigint"))


def bucket_acl(df: DataFrame, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
    """Rows whose bucket is on the allow-list (if any) and not on the deny-list."""
    if allow is not None:
        df = df.join(allow.select("bucket").distinct(), "bucket", "left_semi")
    return df.join(deny.select("bucket").distinct(), "bucket", "left_anti") if deny is not None else df


def object_uri(df: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Hadoop URI of an object, its bucket replaced by an access-point alias where one is given."""
    if aliases is not None:
        df = df.join(aliases.select("bucket", "alias"), "bucket", "left")
        bucket = F.coalesce("alias", "bucket")
    else:
        bucket = F.col("bucket")
    scheme = F.col("scheme")
    for name, filesystem in SCHEME_FILESYSTEMS.items():
        scheme = F.when(F.col("scheme") == name, F.lit(filesystem)).otherwise(scheme)
    usable = (F.col("key") != "") & ((F.col("bucket") != "") | (F.col("scheme") == "local"))
    uri = F.concat(scheme, F.lit("://"), bucket, F.lit("/"), F.col("key"))
    return df.withColumns(
        {"object_uri": F.when(usable, uri), "object_status": F.when(~usable, 404).cast("bigint")}
    ).drop("alias")


# --- types ------------------------------------------------------------------------------


def is_raw(ext: Column, content_type: Column) -> Column:
    """Camera-RAW by extension or MIME type."""
    return F.coalesce(F.lower(ext).isin(*dims.RAW_EXTENSIONS), F.lit(False)) | F.coalesce(
        content_type.isin(*dims.RAW_MIME_TYPES), F.lit(False)
    )


def is_svg(content: Column) -> Column:
    """An element named svg starts within the detection window (comments and CDATA aside)."""
    text = F.substring(content, 1, DETECTION_WINDOW).cast("string")
    bare = F.regexp_replace(text, r"(?s)<!--.*?(-->|$)|<!\[CDATA\[.*?(\]\]>|$)", "")
    return bare.rlike(r"<([A-Za-z_][\w.-]*:)?svg[\s/>]")


def detect_type(df: DataFrame) -> DataFrame:
    """format by leading bytes, then TIFF (unless camera-RAW), then SVG; unknown is a 422."""
    head = F.hex(F.substring("content", 1, 12))
    found = None
    for name, pattern in MAGIC:
        found = F.when(head.rlike(pattern), name) if found is None else found.when(head.rlike(pattern), name)
    found = found.when(head.rlike(TIFF_MAGIC) & ~is_raw(F.col("ext"), F.col("content_type")), "tiff").when(
        is_svg(F.col("content")), "svg"
    )
    df = df.withColumn("format", found)
    return df.withColumn("type_status", F.when(F.col("format").isNull(), 422).cast("bigint"))


def exclude_raw(df: DataFrame) -> DataFrame:
    return df.filter(~is_raw(F.col("ext"), F.col("content_type")))


def limit_file_size(df: DataFrame, max_bytes: int) -> DataFrame:
    """size_status is 422 for files beyond the limit (0: no limit), whose content is left out; no row goes."""
    over = (F.col("length") > max_bytes) if max_bytes else F.lit(False)
    df = df.withColumn("size_status", F.when(over, 422).cast("bigint"))
    return df.withColumn("content", F.when(~over, F.col("content"))) if max_bytes and "content" in df.columns else df


def file_etag(df: DataFrame) -> DataFrame:
    """Quoted digest of path, size and modification time (columns path, length, mtime_ns)."""
    text = F.concat_ws("__", "path", F.col("length").cast("string"), F.col("mtime_ns").cast("string"))
    return df.withColumn(
        "etag", F.concat(F.lit('"'), b64url_encode(F.unhex(F.sha2(text, 256))), F.lit('"'))
    )


def content_type(df: DataFrame) -> DataFrame:
    """MIME type by content, or by extension where the content says nothing specific."""
    mime = F.lit(None).cast("string")
    by_ext = F.lit(None).cast("string")
    for row in dims.IMAGE_TYPES:
        mime = F.when(F.col("format") == row[0], F.lit(row[2])).otherwise(mime)
        by_ext = F.when(F.lower("ext") == row[1], F.lit(row[2])).otherwise(by_ext)
    return df.withColumn("mime", F.coalesce(mime, by_ext, F.lit("application/octet-stream")))


# --- fetching ---------------------------------------------------------------------------


def slice_range(df: DataFrame) -> DataFrame:
    """Part of the content a Range header asks for; unusable ranges are a 416."""
    spec = F.regexp_extract("range", r"^bytes=[\s,]*([^,]*)", 1)
    asked = F.coalesce(F.col("range") != "", F.lit(False))
    good = r"^\s*(\d+)\s*-\s*(\d*)\s*$"
    start = F.regexp_extract(spec, good, 1).try_cast("bigint")
    end = F.regexp_extract(spec, good, 2).try_cast("bigint")
    size = F.length("content").cast("bigint")
    df = df.withColumns({"_start": start, "_end": end, "_size": size, "_asked": asked})
    broken = F.col("_start").isNull() | F.coalesce(F.col("_start") > F.col("_end"), F.lit(False))
    # Fixed value: an end of 0 means the whole file in the scanned store.
    whole = ~F.col("_asked") | F.coalesce(F.col("_end") == 0, F.lit(False))
    df = df.withColumn("range_status", F.when(whole & ~(F.col("_asked") & broken), 200).when(broken, 416).otherwise(206))
    last = F.coalesce("_end", F.col("_size") - 1)
    partial = F.col("range_status") == 206
    return df.withColumns(
        {
            "part": F.when(
                partial, F.substr("content", (F.col("_start") + 1).cast("int"), (last - F.col("_start") + 1).cast("int"))
            ).when(F.col("range_status") == 200, F.col("content")),
            "content_range": F.when(
                partial, F.concat(F.lit("bytes "), F.col("_start"), F.lit("-"), last, F.lit("/"), F.col("_size"))
            ),
            "range_status": F.col("range_status").cast("bigint"),
        }
    ).drop("_start", "_end", "_size", "_asked")


def fetch_outcome(df: DataFrame) -> DataFrame:
    """Status and error of a fetch from the origin's status, Content-Range and Content-Length."""
    pattern = r"^bytes ((\*|(\d+)-(\d+))/(\*|\d+))$"
    code = F.col("origin_status")
    part = lambda i: F.regexp_extract("content_range", pattern, i)
    total = F.when(part(5) == "*", F.col("content_length")).otherwise(part(5).try_cast("bigint"))
    invalid = ~F.coalesce(F.col("content_range").rlike(pattern), F.lit(False))
    entire = (part(3) == "0") & (total > 0) & (part(4).try_cast("bigint") == total - 1)
    incomplete = ~F.coalesce(entire, F.lit(False))
    return df.withColumns(
        {
            "status": F.when(code.isin(200, 304), code)
            .when(code == 206, F.when(invalid | incomplete, 404).otherwise(200))
            .when(code.between(400, 499), code)
            .when(code >= 500, 502)
            .otherwise(404)
            .cast("bigint"),
            "error": F.when(code == 304, "not modified")
            .when(code == 206, F.when(invalid, "invalid content range").when(incomplete, "incomplete content"))
            .when(code != 200, F.concat(F.lit("status: "), code.cast("string"))),
        }
    )


def fallback_image(df: DataFrame, image: bytes | None, code: int = 0) -> DataFrame:
    """Failed sources get the configured image (configuration, a literal) and its status."""
    failed = F.col("status") >= 400
    if image is None:
        return df.withColumn("is_fallback", F.lit(False))
    status = F.lit(code).cast("bigint") if code else F.col("status")
    return df.withColumns(
        {
            "content": F.when(failed, F.lit(bytearray(image))).otherwise(F.col("content")),
            "expires": F.when(~failed, F.col("expires")),
            "last_modified": F.when(~failed, F.col("last_modified")),
            "is_fallback": failed,
            "status": F.when(failed, status).otherwise(F.col("status")),
        }
    )


def aux_image(spark: SparkSession, base64_data: str = "", path: str = "") -> DataFrame:
    """The one watermark or fallback image: base64 data first, else a file."""
    if base64_data:
        return spark.range(1).select(F.unbase64(F.lit(re.sub(r"\s", "", base64_data))).alias("content"))
    if not path:
        raise ValueError("an auxiliary image needs data or a path")
    return spark.read.format("binaryFile").load(path).select("content")


def _plain_bmp(content: Column) -> Column:
    """Whether bytes are a whole BMP of 24 bits a pixel, uncompressed and without a palette, as written by most tools."""
    head = F.hex(F.substring(content, 1, 54))
    number = lambda at, n=4: F.conv(F.concat(*[F.substring(head, 2 * (at + k) + 1, 2) for k in reversed(range(n))]), 16, 10).cast("long")
    signed = lambda at: F.when(number(at) >= 1 << 31, number(at) - (1 << 32)).otherwise(number(at))
    width, height = signed(18), signed(22)
    stride = F.floor((width * 3 + 3) / 4) * 4
    fields = (number(14) == 40) & (number(26, 2) == 1) & (number(28, 2) == 24) & (number(30) == 0) & (number(46) == 0) & (number(10) == 54)
    # Fixed value: above so many pixels a side the JVM's decoder decides.
    size = width.between(1, 1 << 15) & F.abs(height).between(1, 1 << 15) & (F.octet_length(content) >= 54 + stride * F.abs(height))
    return F.coalesce(head.startswith("424D") & (F.length(head) == 108) & fields & size, F.lit(False))


def _raster(content: bytes) -> tuple[int, int, bytes]:
    """Width, height and pixels of a plain BMP: padding goes, lines that come bottom-up are turned."""
    width, height = struct.unpack_from("<ii", content, 18)
    stride = -(-3 * width // 4) * 4
    lines = np.frombuffer(content, np.uint8, stride * abs(height), 54).reshape(abs(height), stride)[:, : 3 * width]
    return width, abs(height), (lines if height < 0 else lines[::-1]).tobytes()


def _rasters(origins: pa.Array, found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    width, height = np.array([r[:2] for r in found], np.int32).reshape(-1, 2).T
    columns = [origins, pa.array(width), pa.array(height), pa.array(np.full(len(found), 3, np.int32)), pa.array([r[2] for r in found], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["origin", "width", "height", "channels", "data"])


def _bmp_rasters(batches):
    """Plain BMP files as rasters."""
    for batch in batches:
        yield _rasters(batch.column("origin"), [_raster(content) for content in batch.column("content").to_pylist()])


# What Java's URIs leave as it is in a path.
_LEFT_ALONE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789/_-!.~'()*,;:$&+=@")
_RASTERS = "origin string, width int, height int, channels int, data binary"
# Fixed value: files of a task that reads them one by one.
FILES_AT_ONCE = 10_000


def _mounted(spark: SparkSession, path: str) -> str | None:
    """A local or mounted folder by its plain name; None for other stores, single files and patterns."""
    if not path.startswith("file:") and (re.match(r"[A-Za-z][\w+.-]*:", path) or not spark.conf.get("spark.hadoop.fs.defaultFS", "file:///").startswith("file:")):
        return None
    root = os.path.abspath(re.sub("^file:/*", "/", path))
    return None if re.search(r"[{}\[\]*?\\]", root) or not os.path.isdir(root) else root


def _listed(root: str):
    """Files below a folder as Spark lists them: names that begin with a dot or an underscore are left out."""

    def hidden(name: str) -> bool:
        out = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
        return out and not name.startswith(("_common_metadata", "_metadata"))

    def run(batches):
        for _ in batches:
            folders, files = [root], []
            while folders:
                with os.scandir(folders.pop()) as entries:
                    for entry in entries:
                        if hidden(entry.name):
                            continue
                        if entry.is_dir():
                            folders.append(entry.path)
                            continue
                        files.append(entry.path)
                        if len(files) == FILES_AT_ONCE:
                            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])
                            files = []
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])

    return run


def _plain_head(head: bytes, size: int) -> bool:
    """_plain_bmp by the first 54 bytes of a file and its size."""
    if len(head) < 54 or head[:2] != b"BM" or struct.unpack_from("<IIiiHHI", head, 10)[:2] != (54, 40):
        return False
    width, height, planes, bits, packing = struct.unpack_from("<iiHHI", head, 18)
    sides = 1 <= width <= 1 << 15 and 1 <= abs(height) <= 1 << 15
    return (planes, bits, packing) == (1, 24, 0) and head[46:50] == b"\0" * 4 and sides and size >= 54 + -(-3 * width // 4) * 4 * abs(height)


def _is_plain(file: str) -> bool:
    if not file.lower().endswith(".bmp"):
        return False
    with open(file, "rb") as at:
        return _plain_head(at.read(54), os.fstat(at.fileno()).st_size)


def _read_plain(batches):
    """Rasters of the plain BMP files of a list, read one by one."""
    for batch in batches:
        origins, found, size = [], [], 0
        for file in batch.column("file").to_pylist():
            if not _is_plain(file):
                continue
            with open(file, "rb") as at:
                found.append(_raster(at.read()))
            origins.append("file://" + "".join(c if c in _LEFT_ALONE or (ord(c) > 127 and c.isprintable()) else "".join(f"%{b:02X}" for b in c.encode()) for c in file))
            size += len(found[-1][2])
            if size > 16 << 20:
                yield _rasters(pa.array(origins), found)
                origins, found, size = [], [], 0
        yield _rasters(pa.array(origins, pa.string()), found)


def _not_plain(batches):
    for batch in batches:
        yield batch.filter(pa.array([not _is_plain(file) for file in batch.column("file").to_pylist()], pa.bool_()))


def _images(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(list(paths))


def _as_rasters(images: DataFrame) -> DataFrame:
    return images.select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def _decode_mounted(spark: SparkSession, root: str) -> DataFrame | None:
    """decode_scan of a folder that all tasks see: a task lists it, others read the files, and none is planned by the driver.

    Files for Spark's image source are named to it one by one; None where they are too many for that.
    """
    files = spark.range(0, 1, 1, 1).mapInArrow(_listed(root), "file string")
    tasks = max(spark.sparkContext.defaultParallelism, -(-files.count() // FILES_AT_ONCE))
    dealt = files.repartition(tasks)
    others = [row["file"] for row in dealt.mapInArrow(_not_plain, "file string").limit(FILES_AT_ONCE + 1).collect()]
    if len(others) > FILES_AT_ONCE:
        return None
    rasters = dealt.mapInArrow(_read_plain, _RASTERS)
    named = ["file://" + re.sub(r"([{}\[\]*?\\])", r"\\\1", file) for file in others]
    return rasters.unionByName(_as_rasters(_images(spark, *named))) if named else rasters


def decode_scan(spark: SparkSession, path: str) -> DataFrame:
    """Rasters of loadable files: origin, width, height, channels, data (top-down, B, G, R[, A]).

    Spark's image source plans a serializer anew for every file, which takes far longer than decoding a small one. Plain
    BMP files are decoded from their bytes; it reads all others, and files named .bmp only where some are not plain. Spark's file
    sources keep every file in the driver's memory; in a local or mounted folder tasks list and read the files themselves.
    """
    root = _mounted(spark, path)
    mounted = _decode_mounted(spark, root) if root else None
    if mounted is not None:
        return mounted
    named = F.lower(F.col("_metadata.file_name")).endswith(".bmp")
    file = F.col("_metadata.file_path")
    # The image source spells an origin without a host with three slashes.
    origin = F.regexp_replace(file, "^([^:/]+):/(?!/)", "$1:///")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(named).select(file.alias("file"), origin.alias("origin"), "content")
    plain = _plain_bmp(F.col("content"))
    # Fixed value: Spark counts 4 MB for opening a file, so a task would have 32 small ones.
    files = files.coalesce(max(spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // 16))
    rasters = files.where(plain).mapInArrow(_bmp_rasters, _RASTERS)
    rasters = rasters.unionByName(_as_rasters(_images(spark, path).where(~named)))
    odd = files.where(~plain).select("file")
    return rasters if odd.isEmpty() else rasters.unionByName(_as_rasters(_images(spark, path).where(named).withColumn("file", file).join(odd, "file", "left_semi")))


def write_renditions(df: DataFrame, path: str) -> None:
    """Renditions as Parquet by format; many small formats share no directory."""
    df.write.mode("errorifexists").partitionBy("format").parquet(path)
