"""Metadata jobs: tag rows validated, typed, filtered and audited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Record, tag, title, format, repeatable, least and largest size in bytes.
TAGS = (
    (1, 0, "Model Version", "short", False, 2, 2),
    (1, 5, "Destination", "string", True, 0, 1024),
    (1, 20, "File Format", "short", False, 2, 2),
    (1, 22, "File Version", "short", False, 2, 2),
    (1, 30, "Service Identifier", "string", False, 0, 10),
    (1, 40, "Envelope Number", "string", False, 8, 8),
    (1, 50, "Product I.D.", "string", True, 0, 32),
    (1, 60, "Envelope Priority", "string", False, 1, 1),
    (1, 70, "Date Sent", "date", False, 8, 8),
    (1, 80, "Time Sent", "time", False, 11, 11),
    (1, 90, "Coded Character Set", "binary", False, 0, 32),
    (1, 100, "Unique Name of Object", "string", False, 14, 80),
    (1, 120, "ARM Identifier", "short", False, 2, 2),
    (1, 122, "ARM Version", "short", False, 2, 2),
    (2, 0, "Record Version", "short", False, 2, 2),
    (2, 3, "Object Type Reference", "string", False, 3, 67),
    (2, 4, "Object Attribute Reference", "string", True, 4, 68),
    (2, 5, "Object Name", "string", False, 0, 64),
    (2, 7, "Edit Status", "string", False, 0, 64),
    (2, 8, "Editorial Update", "string", False, 2, 2),
    (2, 10, "Urgency", "string", False, 1, 1),
    (2, 12, "Subject Reference", "string", True, 13, 236),
    (2, 15, "Category", "string", False, 0, 3),
    (2, 20, "Supplemental Category", "string", True, 0, 32),
    (2, 22, "Fixture Identifier", "string", False, 0, 32),
    (2, 25, "Keywords", "string", True, 0, 64),
    (2, 26, "Content Location Code", "string", True, 3, 3),
    (2, 27, "Content Location Name", "string", True, 0, 64),
    (2, 30, "Release Date", "date", False, 8, 8),
    (2, 35, "Release Time", "time", False, 11, 11),
    (2, 37, "Expiration Date", "date", False, 8, 8),
    (2, 38, "Expiration Time", "time", False, 11, 11),
    (2, 40, "Special Instructions", "string", False, 0, 256),
    (2, 42, "Action Advised", "string", False, 2, 2),
    (2, 45, "Reference Service", "string", True, 0, 10),
    (2, 47, "Reference Date", "date", True, 8, 8),
    (2, 50, "Reference Number", "string", True, 8, 8),
    (2, 55, "Date Created", "date", False, 8, 19),
    (2, 60, "Time Created", "time", False, 6, 11),
    (2, 62, "Digital Creation Date", "date", False, 8, 8),
    (2, 63, "Digital Creation Time", "time", False, 11, 11),
    (2, 65, "Originating Program", "string", False, 0, 32),
    (2, 70, "Program Version", "string", False, 0, 10),
    (2, 75, "Object Cycle", "string", False, 1, 1),
    (2, 80, "By-line", "string", True, 0, 32),
    (2, 85, "By-line Title", "string", True, 0, 32),
    (2, 90, "City", "string", False, 0, 32),
    (2, 92, "Sub-location", "string", False, 0, 32),
    (2, 95, "Province/State", "string", False, 0, 32),
    (2, 100, "Country Code", "string", False, 3, 3),
    (2, 101, "Country Name", "string", False, 0, 64),
    (2, 103, "Original Transmission Reference", "string", False, 0, 32),
    (2, 105, "Headline", "string", False, 0, 256),
    (2, 110, "Credit", "string", False, 0, 32),
    (2, 115, "Source", "string", False, 0, 32),
    (2, 116, "Copyright Notice", "string", False, 0, 128),
    (2, 118, "Contact", "string", True, 0, 128),
    (2, 120, "Caption/Abstract", "string", False, 0, 2000),
    (2, 122, "Writer/Editor", "string", True, 0, 32),
    (2, 125, "Rasterized Caption", "binary", False, 7360, 7360),
    (2, 130, "Image Type", "string", False, 2, 2),
    (2, 131, "Image Orientation", "string", False, 1, 1),
    (2, 135, "Language Identifier", "string", False, 2, 3),
    (2, 150, "Audio Type", "string", False, 2, 2),
    (2, 151, "Audio Sampling Rate", "string", False, 6, 6),
    (2, 152, "Audio Sampling Resolution", "string", False, 2, 2),
    (2, 153, "Audio Duration", "string", False, 6, 6),
    (2, 154, "Audio Outcue", "string", False, 0, 64),
    (2, 200, "Preview File Format", "short", False, 2, 2),
    (2, 201, "Preview File Format Version", "short", False, 2, 2),
    (2, 202, "Preview Data", "binary", False, 0, 256000),
    (7, 10, "Size Mode", "byte", False, 1, 1),
    (7, 20, "Max Subfile Size", "long", False, 3, 4),
    (7, 90, "Object Size Announced", "long", False, 3, 4),
    (7, 95, "Maximum Object Size", "long", False, 3, 4),
    (8, 10, "Subfile", "binary", True, 0, 4294967295),
    (9, 10, "Confirmed Data Size", "long", False, 3, 4),
)
TAG_FIELDS = ("record", "tag", "title", "format", "repeatable", "min_size", "max_size")
# Further names of two tags of record 2.
TAG_NAMES = {5: "Name", 120: "Caption"}
# Record-2 tags that hold copyright.
COPYRIGHT_TAGS = (80, 110, 116)
# Header fields that survive stripping, always / for copyright / for animations.
KEEP_ALWAYS = ("icc-profile-data", "bits-per-sample", "palette", "palette-bit-depth", "background", "vips-loader")
KEEP_COPYRIGHT = ("exif-data", "exif-ifd0-Copyright", "exif-ifd0-Artist")
KEEP_ANIMATION = ("page-height", "delay", "loop", "n-pages")
# XMP namespaces and, within dc, names that hold copyright.
XMP_NAMESPACES = ("dc", "xmpRights", "cc")
XMP_DC_NAMES = ("rights", "contributor", "creator", "publisher")


def tag_dictionary(spark: SparkSession) -> DataFrame:
    """The fixed tag table; its size never grows, so it is broadcast."""
    return spark.createDataFrame(
        list(TAGS), "record int, tag int, title string, format string, repeatable boolean, min_size long, max_size long"
    )


def iptc_validate(raw: DataFrame) -> DataFrame:
    """Known tags of valid size: all values of a repeatable tag, the last of any other.

    raw(image_id, seq, record, tag, raw). The last value is a maximum, so it is found by
    partial aggregation before the shuffle, whatever one image holds.
    """
    known = raw.join(
        F.broadcast(tag_dictionary(raw.sparkSession).select("record", "tag", "repeatable", "min_size", "max_size")),
        ["record", "tag"],
    ).filter(F.length("raw").between(F.col("min_size"), F.col("max_size")))
    columns = ("image_id", "record", "tag", "seq", "raw")
    single = (
        known.filter(~F.col("repeatable"))
        .groupBy("image_id", "record", "tag")
        .agg(F.max(F.struct("seq", "raw")).alias("last"))
        .select("image_id", "record", "tag", "last.seq", "last.raw")
    )
    return known.filter("repeatable").select(*columns).unionByName(single)


def big_endian(raw: Column) -> Column:
    """1 to 4 leading bytes as a number; no bytes are 0."""
    return F.coalesce(F.conv(F.hex(F.substring(raw, 1, 4)), 16, 10).try_cast("bigint"), F.lit(0))


def iptc_typed(meta: DataFrame) -> DataFrame:
    """key and value (text) of validated tags, with the second names of two of them."""
    df = meta.join(F.broadcast(tag_dictionary(meta.sparkSession).select("record", "tag", "title", "format")), ["record", "tag"])
    value = (
        F.when(F.col("format").isin("byte", "short", "long"), big_endian(F.col("raw")).cast("string"))
        .when(F.col("format") == "binary", F.base64("raw"))
        .otherwise(F.col("raw").cast("string"))
    )
    second = F.lit(None).cast("string")
    for tag, name in TAG_NAMES.items():
        second = F.when((F.col("record") == 2) & (F.col("tag") == tag), F.lit(name)).otherwise(second)
    names = F.filter(F.array("title", second), lambda n: n.isNotNull())
    return df.select("image_id", "seq", F.explode(names).alias("key"), value.alias("value"))


def strip_metadata(fields: DataFrame, plan: DataFrame) -> DataFrame:
    """Header fields kept under a plan(image_id, strip, keep_copyright, animated); resolution back to 72 dpi."""
    df = fields.join(plan.select("image_id", "strip", "keep_copyright", "animated"), "image_id")
    name = F.col("name")
    kept = (
        ~F.col("strip")
        | name.isin(*KEEP_ALWAYS)
        | name.startswith("internal-")
        | (F.col("keep_copyright") & name.isin(*KEEP_COPYRIGHT, "iptc-data", "xmp-data"))
        | (F.col("animated") & name.isin(*KEEP_ANIMATION))
        | name.isin("xres", "yres")
    )
    reset = F.col("strip") & name.isin("xres", "yres")
    return df.filter(kept).select(
        "image_id", "name", F.when(reset, F.lit("2.8346")).otherwise(F.col("value")).alias("value")
    )


def keep_copyright_iptc(meta: DataFrame) -> DataFrame:
    return meta.filter((F.col("record") != 2) | F.col("tag").isin(*COPYRIGHT_TAGS))


def keep_copyright_xmp(rows: DataFrame) -> DataFrame:
    """rows(image_id, ns, name, kind, value): copyright namespaces, and in dc only copyright names."""
    named = (F.col("ns") != "dc") | F.col("name").isin(*XMP_DC_NAMES)
    return rows.filter(F.col("ns").isin(*XMP_NAMESPACES) & named)


def metadata_audit(meta: DataFrame, plan: DataFrame) -> DataFrame:
    """Images by (strip, keep_copyright): tags held, tags that would leak, copyright that would go."""
    df = meta.join(plan.select("image_id", "strip", "keep_copyright"), "image_id")
    owned = (F.col("record") == 2) & F.col("tag").isin(*COPYRIGHT_TAGS)
    leaks = ~F.col("strip") | (F.col("keep_copyright") & (F.col("record") != 2))
    lost = F.col("strip") & ~F.col("keep_copyright") & owned
    return df.groupBy("strip", "keep_copyright").agg(
        F.count(F.lit(1)).alias("tags"), F.count_if(leaks & ~owned).alias("leaked"), F.count_if(lost).alias("lost")
    )
