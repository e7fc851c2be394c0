"""Tables derived from the test data, as one SQL text that both engines read.

`{name}` refers to a test table or to another derived table; DIALECT lists the few
expressions the engines spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gravure.session import spread

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

# Tables whose rows each cost much work (parsing, pixels, markup) and that come as few small files: rows for a task.
COMPUTE_HEAVY = {"events": 50_000, "part": 5_000, "pages": 5_000}

FIXTURES: dict[str, str] = {}

FIXTURES["images"] = """
SELECT p_partkey AS image_id,
       40 + (p_partkey * 37) % 961 AS width,
       40 + (p_partkey * 53) % 701 AS height,
       CASE WHEN p_partkey % 11 IN (3, 4) THEN 1 + p_partkey % 7 ELSE CAST(1 AS BIGINT) END AS frames,
       1 + p_partkey % 8 AS orientation,
       p_partkey % 3 = 0 AS has_alpha,
       CASE p_partkey % 11 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'jxl' WHEN 2 THEN 'png' WHEN 3 THEN 'webp'
            WHEN 4 THEN 'gif' WHEN 5 THEN 'ico' WHEN 6 THEN 'svg' WHEN 7 THEN 'heic' WHEN 8 THEN 'avif'
            WHEN 9 THEN 'bmp' ELSE 'tiff' END AS format,
       (40 + (p_partkey * 37) % 961) * (40 + (p_partkey * 53) % 701) * (1 + p_partkey % 3) AS bytes,
       concat('http://img', CAST(p_partkey % 5 AS VARCHAR(20)), '.example.com/p/',
              CAST(p_partkey AS VARCHAR(20)), '.',
              CASE p_partkey % 11 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'jxl' WHEN 2 THEN 'png' WHEN 3 THEN 'webp'
            WHEN 4 THEN 'gif' WHEN 5 THEN 'ico' WHEN 6 THEN 'svg' WHEN 7 THEN 'heic' WHEN 8 THEN 'avif'
            WHEN 9 THEN 'bmp' ELSE 'tiff' END) AS source_url
FROM {part}
"""

# Request options cycle over eleven shapes, one of them invalid on purpose.
FIXTURES["requests"] = """
SELECT e.event_id AS req_id, @TS_US AS ts_us, e.user_id AS user_id, i.image_id AS image_id,
       concat('/unsafe/',
         CASE e.event_id % 11
           WHEN 0 THEN concat('rs:fit:', CAST(20 + e.event_id % 700 AS VARCHAR(20)), ':0')
           WHEN 1 THEN concat('rs:fill:', CAST(20 + e.event_id % 500 AS VARCHAR(20)), ':',
                              CAST(20 + e.event_id % 300 AS VARCHAR(20)), '/g:no:3:0.1')
           WHEN 2 THEN concat('s:300:200:1/rot:90/q:', CAST(e.event_id % 101 AS VARCHAR(20)))
           WHEN 3 THEN 'w:400/h:400/ex:1:ce/pd:10:20'
           WHEN 4 THEN 'c:0.5:0.5:fp:0.3:0.7/dpr:2/w:120'
           WHEN 5 THEN 'rt:fill-down/w:800/h:600/fl:1:0/bg:fa0/fq:webp:55:avif:40:webp:61'
           WHEN 6 THEN concat('pr:thumb/mb:', CAST(1000 + e.event_id % 9000 AS VARCHAR(20)))
           WHEN 7 THEN 'w:abc'
           WHEN 8 THEN concat('trim:10:ff00ff:1/pd:5/pd::7/z:0.5/z:2:1.5/cb:', CAST(e.event_id % 13 AS VARCHAR(20)),
                              '/skp:png:gif/skp:svg')
           WHEN 9 THEN 'g:ce:10:20/g:sm/wm:0.5:re:10:10:0.2/bg:10:20:300'
           ELSE concat('exp:', CAST(1704067200 + (e.event_id * 977) % 2592000 AS VARCHAR(20)),
                       '/fn:bmFtZQ:1/att:t/raw:', CAST(e.event_id % 2 AS VARCHAR(20)),
                       '/el:yes/mw:50/g:fp:0.2:0.8/exar:1:noea:2:3') END,
         '/plain/', i.source_url, CASE WHEN e.event_id % 2 = 0 THEN '@webp' ELSE '' END,
         CASE WHEN e.event_id % 5 = 0 THEN '?v=1' ELSE '' END) AS uri
FROM {events} e JOIN {images} i ON i.image_id = 1 + e.event_id % (SELECT max(p_partkey) FROM {part})
"""

# Typed plans with every planner input varied, by coprime moduli of the event id.
FIXTURES["plans"] = """
SELECT e.event_id AS req_id, 1 + e.event_id % (SELECT max(p_partkey) FROM {part}) AS image_id,
  CASE WHEN e.event_id % 5 = 0 THEN 0 ELSE 20 + (e.event_id * 13) % 700 END AS width,
  CASE WHEN e.event_id % 4 = 1 THEN 0 ELSE 20 + (e.event_id * 29) % 500 END AS height,
  CASE e.event_id % 7 WHEN 1 THEN 'fill' WHEN 2 THEN 'fill-down' WHEN 3 THEN 'force' WHEN 4 THEN 'auto'
       WHEN 6 THEN 'fill' ELSE 'fit' END AS resizing_type,
  CASE WHEN e.event_id % 9 = 3 THEN 50 + e.event_id % 300 ELSE 0 END AS min_width,
  CASE WHEN e.event_id % 9 IN (5, 7) THEN 50 + e.event_id % 400 ELSE 0 END AS min_height,
  CASE e.event_id % 11 WHEN 2 THEN 1.5e0 WHEN 3 THEN 0.7e0 ELSE 1.0e0 END AS zoom_w,
  CASE e.event_id % 11 WHEN 2 THEN 0.8e0 WHEN 3 THEN 0.7e0 ELSE 1.0e0 END AS zoom_h,
  CASE e.event_id % 13 WHEN 1 THEN 2.0e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 1.25e0 ELSE 1.0e0 END AS dpr,
  e.event_id % 3 = 0 AS enlarge,
  e.event_id % 10 IN (4, 9) AS extend,
  e.event_id % 10 IN (2, 7) AS extend_ar,
  CASE e.event_id % 17 WHEN 1 THEN 90 WHEN 2 THEN 180 WHEN 3 THEN 270 WHEN 4 THEN -90 WHEN 5 THEN 450 ELSE 0 END
    AS rotate,
  e.event_id % 19 < 10 AS auto_rotate,
  e.event_id % 6 IN (1, 5) AS flip_h,
  e.event_id % 8 IN (2, 5) AS flip_v,
  CASE e.event_id % 23 WHEN 1 THEN 0.5e0 WHEN 2 THEN 120.0e0 WHEN 3 THEN 300.7e0 WHEN 4 THEN 0.33e0 WHEN 5 THEN 60.0e0
       ELSE 0.0e0 END AS crop_w,
  CASE e.event_id % 23 WHEN 1 THEN 0.5e0 WHEN 3 THEN 0.25e0 WHEN 4 THEN 90.0e0 WHEN 5 THEN 60.0e0 ELSE 0.0e0 END
    AS crop_h,
  CASE e.event_id % 29 WHEN 0 THEN 'ce' WHEN 1 THEN 'no' WHEN 2 THEN 'ea' WHEN 3 THEN 'so' WHEN 4 THEN 'we'
       WHEN 5 THEN 'nowe' WHEN 6 THEN 'noea' WHEN 7 THEN 'sowe' WHEN 8 THEN 'soea' WHEN 9 THEN 'sm' WHEN 10 THEN 'fp'
       WHEN 11 THEN 'fp' WHEN 12 THEN 'no' WHEN 13 THEN 'soea' END AS crop_type,
  CASE WHEN e.event_id % 29 IN (10, 11) THEN (e.event_id % 9 + 1) / 10.0e0
       ELSE CASE e.event_id % 6 WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.1e0 WHEN 2 THEN -0.2e0 WHEN 3 THEN 15.0e0
            WHEN 4 THEN -7.5e0 ELSE 2.5e0 END END AS crop_x,
  CASE WHEN e.event_id % 29 IN (10, 11) THEN (e.event_id % 7 + 1) / 10.0e0
       ELSE CASE e.event_id % 5 WHEN 0 THEN 0.0e0 WHEN 1 THEN -0.15e0 WHEN 2 THEN 9.0e0 WHEN 3 THEN -3.0e0
            ELSE 0.05e0 END END AS crop_y,
  CASE e.event_id % 12 WHEN 0 THEN 'ce' WHEN 1 THEN 'no' WHEN 2 THEN 'ea' WHEN 3 THEN 'so' WHEN 4 THEN 'we'
       WHEN 5 THEN 'nowe' WHEN 6 THEN 'noea' WHEN 7 THEN 'sowe' WHEN 8 THEN 'soea' WHEN 9 THEN 'sm' WHEN 10 THEN 'fp'
       ELSE 'ce' END AS gravity_type,
  CASE WHEN e.event_id % 12 = 10 THEN (e.event_id % 9 + 1) / 10.0e0
       ELSE CASE e.event_id % 7 WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.07e0 WHEN 2 THEN -12.5e0 WHEN 3 THEN 4.0e0
            ELSE 0.0e0 END END AS gravity_x,
  CASE WHEN e.event_id % 12 = 10 THEN (e.event_id % 7 + 1) / 10.0e0
       ELSE CASE e.event_id % 5 WHEN 0 THEN 0.0e0 WHEN 1 THEN -0.1e0 WHEN 2 THEN 6.5e0 ELSE 0.0e0 END END AS gravity_y,
  CASE e.event_id % 8 WHEN 1 THEN 'no' WHEN 4 THEN 'soea' WHEN 7 THEN 'we' ELSE 'ce' END AS extend_type,
  CASE e.event_id % 3 WHEN 1 THEN 5.0e0 WHEN 2 THEN 0.1e0 ELSE 0.0e0 END AS extend_x,
  CASE e.event_id % 4 WHEN 1 THEN -3.0e0 ELSE 0.0e0 END AS extend_y,
  CASE e.event_id % 7 WHEN 1 THEN 'so' WHEN 4 THEN 'nowe' ELSE 'ce' END AS extend_ar_type,
  CASE e.event_id % 5 WHEN 1 THEN 2.0e0 ELSE 0.0e0 END AS extend_ar_x,
  CASE e.event_id % 6 WHEN 1 THEN 0.2e0 ELSE 0.0e0 END AS extend_ar_y,
  CASE WHEN e.event_id % 8 = 6 THEN 1 + e.event_id % 20 ELSE 0 END AS pad_top,
  CASE WHEN e.event_id % 8 = 6 THEN e.event_id % 15 ELSE 0 END AS pad_right,
  CASE WHEN e.event_id % 8 = 6 THEN e.event_id % 11 ELSE 0 END AS pad_bottom,
  CASE WHEN e.event_id % 8 = 6 THEN e.event_id % 9 ELSE 0 END AS pad_left,
  CASE WHEN e.event_id % 31 IN (5, 6, 7) THEN 200 ELSE 0 END AS max_dim,
  CASE e.event_id % 37 WHEN 1 THEN 'webp' WHEN 2 THEN 'avif' WHEN 3 THEN 'gif' WHEN 4 THEN 'ico' WHEN 5 THEN 'png'
       WHEN 6 THEN 'jpeg' WHEN 7 THEN 'jxl' WHEN 8 THEN 'svg' WHEN 9 THEN 'ico' END AS format,
  CASE WHEN e.event_id % 4 = 0 THEN 0.0e0 ELSE (e.event_id % 10 + 1) / 10.0e0 END AS wm_opacity,
  CASE e.event_id % 10 WHEN 0 THEN 'ce' WHEN 1 THEN 'no' WHEN 2 THEN 'ea' WHEN 3 THEN 'so' WHEN 4 THEN 'we'
       WHEN 5 THEN 'nowe' WHEN 6 THEN 'noea' WHEN 7 THEN 're' WHEN 8 THEN 'soea' ELSE 're' END AS wm_position,
  CASE e.event_id % 6 WHEN 0 THEN 0.0e0 WHEN 1 THEN 11.0e0 WHEN 2 THEN 0.05e0 WHEN 3 THEN -20.0e0 ELSE 3.0e0 END AS wm_x,
  CASE e.event_id % 7 WHEN 0 THEN 0.0e0 WHEN 1 THEN 7.0e0 WHEN 2 THEN 0.1e0 WHEN 3 THEN -30.0e0 ELSE 5.0e0 END AS wm_y,
  CASE WHEN e.event_id % 3 = 1 THEN 0.0e0 ELSE (1 + e.event_id % 8) / 10.0e0 END AS wm_scale
FROM {events} e
"""

# Typed plans joined with the facts of their image.
FIXTURES["geo"] = """
SELECT p.*, i.width AS img_w, i.height AS img_h, i.frames, i.orientation, i.has_alpha, i.format AS src_format,
       i.bytes AS src_bytes
FROM {plans} p JOIN {images} i ON p.image_id = i.image_id
"""


# Mark -> text for Spark, text for the check engine.
DIALECT = {
    "@TS_US": ("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', e.ts)", "epoch_us(e.ts)"),
    "@QUALITIES": ("explode(sequence(1, 100))", "unnest(range(1, 101))"),
    "@FORMATS": ("explode(array('jpeg', 'webp', 'avif'))", "unnest(['jpeg', 'webp', 'avif'])"),
    "@SPANS": (
        "explode(array('Queue', 'Downloading image', 'Processing image'))",
        "unnest(['Queue', 'Downloading image', 'Processing image'])",
    ),
    "@ROWS": ("explode(sequence(0, 15))", "unnest(range(0, 16))"),
    "@COLUMNS": ("explode(sequence(0, 23))", "unnest(range(0, 24))"),
    "@LEFT": ("`left`", '"left"'),
    "@TILE": ("posexplode(embedding) AS (pos, e)", "unnest(range(0, 64)) AS pos, unnest(embedding) AS e"),
}


def _check_text(name: str) -> str:
    sql = re.sub(r"\{(\w+)\}", r"\1", FIXTURES[name])
    for mark, (_, check_sql) in DIALECT.items():
        sql = sql.replace(mark, check_sql)
    return sql


def _deps(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def table(spark: SparkSession, sf_dir: str, name: str, events: DataFrame | None = None) -> DataFrame:
    """A test table or a derived table, read lazily; `events` may be given, as a stream for one."""
    if name == "events" and events is not None:
        return events
    if name in BASE_TABLES:
        base = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(base, COMPUTE_HEAVY[name]) if name in COMPUTE_HEAVY else base
    sql = FIXTURES[name]
    if events is not None:
        # A stream takes the largest key as a literal instead of a subquery.
        largest = table(spark, sf_dir, "part").agg({"p_partkey": "max"}).first()[0]
        sql = sql.replace("(SELECT max(p_partkey) FROM {part})", str(largest))
    for mark, (spark_sql, _) in DIALECT.items():
        sql = sql.replace(mark, spark_sql)
    return spark.sql(sql, **{dep: table(spark, sf_dir, dep, events) for dep in set(_deps(sql))})


def with_tables(names: str, body: str) -> str:
    """Check SQL: the derived tables (and what they need) as CTEs, then the body.

    The body may open with further CTEs, written as `name AS (...), ... SELECT`.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BASE_TABLES or name in order:
            return
        for dep in _deps(FIXTURES[name]):
            visit(dep)
        order.append(name)

    for name in names.split():
        visit(name)
    ctes = [f"{name} AS ({_check_text(name)})" for name in order]
    body = body.strip()
    head = "WITH RECURSIVE " + ",\n".join(ctes)
    if re.match(r"\w+(\([\w, ]*\))? AS (MATERIALIZED )?\(", body):
        return f"{head},\n{body}"
    return f"{head}\n{body}"

_TEXT = "CAST({} AS VARCHAR(20))"


def _shapes(shapes: list[str]) -> str:
    """CASE over event_id: '<expr>' in a shape stands for a number computed from the event."""

    def concat(shape: str) -> str:
        parts = re.split(r"<(.*?)>", shape)
        pieces = [f"'{p}'" if i % 2 == 0 else _TEXT.format(p) for i, p in enumerate(parts)]
        return f"concat({', '.join(pieces)})"

    whens = " ".join(f"WHEN {i} THEN {concat(s)}" for i, s in enumerate(shapes))
    return f"CASE e.event_id % {len(shapes)} {whens} END"


# Request lines with the oddities of prefixes, proxies and missing parts.
FIXTURES["uris"] = (
    "SELECT e.event_id AS req_id, "
    + _shapes(
        [
            "/pfx/sig<e.event_id>/rs:fill:300:200/plain/http://example.com/<e.event_id>.jpg?x=1",
            "/sig/rs%3Afill%3A<e.event_id>/plain/https:/example.com/a%3Ab/<e.event_id>.jpg",
            "/only_signature<e.event_id>",
            "/",
            "//w:1/abc<e.event_id>",
            "/sig/plain/local:/dir/<e.event_id>.png",
            "/pfx/sig/w%3A5/aHR0cDovL2V4YW1wbGUuY29tLw/<e.event_id>.png",
            "/sig/w:1/plain/s3:/bucket<e.event_id>/a:/b?q",
            "/sig/h:<e.event_id>/plain/http://example.com/x/plain/https:/y",
        ]
    )
    + " AS uri FROM {events} e"
)

OPTION_SHAPES = [
    "rs:fit:<e.event_id % 700>:<e.event_id % 300>:1:1:no:0.1:5",
    "s:<e.event_id % 700>::t:1:fp:0.2:0.9",
    "rt:auto/w:<e.event_id % 900>/h:<e.event_id % 800>/mw:10/mh:20",
    "z:1.5/z:0.5:2/dpr:1.5",
    "ex:1:sm",
    "exar:true:soea:3:-2.5/ex:f",
    "g:no:3:0.1/g:sm/g:so::7",
    "g:fp:0.3",
    "g:fp:0.3:1.7",
    "c:100:0.5:we:5:6/c:50",
    "c:-1",
    "t:10:ff00ff:1:0/t:5",
    "t:/t:20:zzz",
    "pd:10:20/pd::5/pd:7::::",
    "pd:10:20/pd::5",
    "pd::3/pd:1:2:3:4/pd::::9",
    "ar:0/rot:<90 * (e.event_id % 5)>/fl::1",
    "rot:45",
    "bg:ff0/bg:10:20:30",
    "bg:fff/bg:",
    "bg:1:2",
    "bg:1:2:+3",
    "bl:2.5/sh:0.7/pix:<e.event_id % 20>",
    "wm:0.5:re:10:-5:0.2",
    "wm:1.5",
    "wm:0.3:sm",
    "sm:1/kcr:0/scp:T/ph:yes/eth:1/att:1",
    "q:<e.event_id % 130>",
    "fq:webp:50:avif:60:webp:70/fq:jpg:10",
    "fq:webp",
    "f:jpg/mb:<e.event_id % 5000>",
    "f:tif",
    "skp:png:jpg/skp:gif",
    "raw:1/cb:abc/cb:/exp:<1704067200 + (e.event_id * 977) % 2592000>",
    "fn:bmFtZQ:1/fn:other<e.event_id>",
    "fn:@@@:1",
    "msr:1.5/mafr:0.25",
    "maf:3/mrd:100/msfs:-5",
    "foo:1",
    "w:abc/foo:1",
    "w:5:6",
    "el:/w:",
    "s:1:2:3:4:5:6:7:8",
    "rs:bogus:1:1",
    "pr:nosuch/w:1",
    "c:10:20:sm:1",
    "rs::<e.event_id % 50>:60:::no/g:sm/g:ea",
]
FIXTURES["option_paths"] = (
    "SELECT e.event_id AS req_id, @TS_US AS ts_us, concat("
    + _shapes(OPTION_SHAPES)
    + ", '/plain/http://example.com/a.jpg') AS path FROM {events} e"
)

# Preset configuration, one row per option of a preset.
PRESET_ROWS = [
    ("thumb", 0, "rs", "fill:150:150"),
    ("thumb", 1, "q", "70"),
    ("default", 0, "ar", "1"),
    ("wide", 0, "pr", "thumb"),
    ("wide", 1, "w", "320"),
    ("loop_a", 0, "pr", "loop_b"),
    ("loop_b", 0, "pr", "loop_a"),
    ("loop_b", 1, "w", "10"),
    ("mixed", 0, "el", "1"),
    ("mixed", 1, "pr", "wide:loop_a"),
    ("mixed", 2, "h", "99"),
]
FIXTURES["presets"] = "SELECT * FROM (VALUES {}) AS t(name, pos, opt, argtext)".format(
    ", ".join(f"('{n}', {p}, '{o}', '{a}')" for n, p, o, a in PRESET_ROWS)
)
FIXTURES["preset_paths"] = (
    "SELECT e.event_id AS req_id, concat("
    + _shapes(
        [
            "w:<e.event_id % 99>/pr:thumb/h:5",
            "pr:wide:mixed",
            "pr:loop_a/q:<e.event_id % 100>",
            "h:<e.event_id>",
            "pr:nosuch:thumb",
            "preset:mixed/pr:mixed",
        ]
    )
    + ", '/plain/http://example.com/a.jpg') AS path FROM {events} e"
)
FIXTURES["preset_lines"] = """
SELECT c.c_custkey AS line_id, CASE c.c_custkey % 9
  WHEN 0 THEN concat('p', CAST(c.c_custkey AS VARCHAR(20)), '=resize:fit:100:200/sharpen:2')
  WHEN 1 THEN 'resize:fit:100:200/sharpen:2'
  WHEN 2 THEN concat('=w:', CAST(c.c_custkey AS VARCHAR(20)))
  WHEN 3 THEN concat('p', CAST(c.c_custkey AS VARCHAR(20)), '=')
  WHEN 4 THEN concat('p', CAST(c.c_custkey AS VARCHAR(20)), '=w:1/blur')
  WHEN 5 THEN '   '
  WHEN 6 THEN concat('#  p=w:', CAST(c.c_custkey AS VARCHAR(20)))
  WHEN 7 THEN concat('  p', CAST(c.c_custkey AS VARCHAR(20)), ' = w:', CAST(c.c_custkey AS VARCHAR(20)), '/pr:thumb  ')
  ELSE 'a=b=c' END AS line FROM {customer} c
"""
# Source part of a request: what follows the options, already split.
FIXTURES["source_paths"] = (
    "SELECT e.event_id AS req_id, "
    + _shapes(
        [
            "plain/http://example.com/img<e.event_id>.jpg@webp",
            "plain/http://example.com/a%20b+c/<e.event_id>.jpg",
            "plain/http://example.com/bad%zz/<e.event_id>.jpg",
            "plain/http://example.com/a@b@<e.event_id>",
            "plain/@png",
            "aHR0cDovL2V4YW1wbGUuY29t/L2E.png",
            "aHR0cDovL2V4YW1wbGUuY29tL2E=",
            "aHR0cDovL2V4YW1wbGUuY29tL2.x.y",
            ".png",
            "!!!<e.event_id>",
            "plain",
            "aHR0cDovL2V4YW1wbGUuY29tL2Fi/L2Nk.jpg",
        ]
    )
    + " AS tail FROM {events} e"
)
# Client headers.
FIXTURES["client_headers"] = """
SELECT e.event_id AS req_id,
  CASE e.event_id % 5 WHEN 0 THEN 'image/avif,image/webp,*/*' WHEN 1 THEN 'image/webp' WHEN 2 THEN 'image/jxl,*/*'
       WHEN 3 THEN '*/*' END AS accept,
  CASE e.event_id % 7 WHEN 0 THEN '2.0' WHEN 1 THEN '9' WHEN 2 THEN 'x' WHEN 3 THEN '0' END AS sec_ch_dpr,
  CASE e.event_id % 3 WHEN 0 THEN '1.5' WHEN 1 THEN '' END AS dpr_header,
  CASE e.event_id % 4 WHEN 0 THEN CAST(e.event_id % 900 AS VARCHAR(20)) WHEN 1 THEN '-5' END AS sec_ch_width,
  CASE e.event_id % 6 WHEN 0 THEN '640' WHEN 1 THEN '10.5' END AS width_header
FROM {events} e
"""
# Addresses: IPv4 over the whole key range and IPv6 forms that embed it.
FIXTURES["source_ips"] = (
    "SELECT e.event_id AS id, "
    + _shapes(
        [
            "<(e.event_id * 7) % 256>.<(e.event_id * 11) % 256>.<e.event_id % 256>.<(e.event_id * 3) % 256>",
            "10.<e.event_id % 256>.0.1",
            "172.<e.event_id % 48>.5.6",
            "192.168.<e.event_id % 256>.9",
            "100.<60 + e.event_id % 70>.0.0",
            "169.254.<e.event_id % 256>.1",
            "127.0.0.<e.event_id % 256>",
            "0.0.0.<e.event_id % 2>",
            "224.0.<e.event_id % 2>.251",
            "::<e.event_id % 3>",
            "::ffff:10.0.0.<e.event_id % 256>",
            "::<e.event_id % 256>.0.0.1",
            "2002:7f00:1::<e.event_id % 100>",
            "64:ff9b::192.168.0.<e.event_id % 256>",
            "64:ff9b::8.8.8.<e.event_id % 256>",
            "64ff:9b01:0:0a00:00<e.event_id % 90 + 10>:1::",
            "2001:0:1:2:3:4:f5ff:fff<e.event_id % 10>",
            "2001:db8::200:5efe:127.0.0.<e.event_id % 256>",
            "fe80::<e.event_id % 1000>",
            "fd00::<e.event_id % 1000>",
            "ff02::<e.event_id % 10>",
            "2606:4700::<e.event_id % 1000>",
            "not-an-ip<e.event_id>",
            "1.2.3.<250 + e.event_id % 10>",
        ]
    )
    + " AS ip FROM {events} e"
)

# Planned requests with everything an output decision looks at.
FIXTURES["decisions"] = """
SELECT g.req_id, g.image_id, g.src_format, g.format, g.frames, g.orientation, g.has_alpha, g.img_w, g.img_h, g.extend,
  g.pad_top, g.pad_right, g.pad_bottom, g.pad_left,
  CASE WHEN g.req_id % 9 = 4 THEN 'ffaa00' END AS background,
  g.req_id % 13 = 1 AS prefer_jxl, g.req_id % 11 = 2 AS prefer_avif, g.req_id % 7 = 3 AS prefer_webp,
  g.req_id % 17 = 1 AS enforce_jxl, g.req_id % 19 = 2 AS enforce_avif, g.req_id % 23 = 3 AS enforce_webp,
  CASE g.req_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 100 END AS max_frames,
  CASE WHEN g.req_id % 6 = 1 THEN 10.0e0 END AS trim_threshold,
  CASE WHEN g.req_id % 10 = 3 THEN 100000 END AS max_src_resolution,
  CASE WHEN g.req_id % 10 IN (3, 5) THEN 90000 END AS max_frame_resolution,
  CASE WHEN g.req_id % 4 = 1 THEN 1 + g.req_id % 100 ELSE 0 END AS quality,
  CASE g.req_id % 5 WHEN 0 THEN 'webp=50,avif=40' WHEN 1 THEN 'jpeg=33' ELSE '' END AS fq_text,
  CASE g.req_id % 8 WHEN 0 THEN 'png,gif' WHEN 3 THEN 'jpeg,svg,webp' ELSE '' END AS skip_text,
  CASE g.req_id % 9 WHEN 0 THEN 'rgb' WHEN 1 THEN 'srgb' WHEN 2 THEN 'b-w' WHEN 3 THEN 'rgb16' WHEN 4 THEN 'grey16'
       WHEN 5 THEN 'cmyk' WHEN 6 THEN 'lab' WHEN 7 THEN 'scrgb' ELSE 'xyz' END AS interpretation,
  g.req_id % 2 = 0 AS preserve_hdr, g.req_id % 5 < 3 AS has_profile, g.req_id % 3 = 1 AS strip_color_profile,
  g.req_id % 4 = 0 AS quantize, 1 + g.req_id % 40 AS quantize_colors, g.req_id % 3 < 2 AS palette,
  CASE WHEN g.req_id % 7 <> 2 THEN 1 + g.req_id % 12 END AS palette_bits,
  4 + g.req_id % 60 AS result_w, 8 + g.req_id % 45 AS result_h
FROM {geo} g
"""
# Measured sizes of every image at every quality.
FIXTURES["encodings"] = """
SELECT image_id, format, quality,
  500 + CAST(floor(width * height * quality * (3 + image_id % 5) / 1000) AS BIGINT) AS bytes
FROM (SELECT f.*, @QUALITIES AS quality
      FROM (SELECT i.image_id, i.width, i.height, @FORMATS AS format FROM {images} i) f)
"""
FIXTURES["fit_renditions"] = """
SELECT e.event_id AS req_id, 1 + e.event_id % (SELECT max(p_partkey) FROM {part}) AS image_id,
  CASE e.event_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'webp' WHEN 2 THEN 'avif' ELSE 'png' END AS format,
  CASE WHEN e.event_id % 10 = 7 THEN 0 ELSE 1000 + (e.event_id * 131) % 60000 END AS max_bytes,
  CASE e.event_id % 3 WHEN 0 THEN 80 WHEN 1 THEN 100 ELSE 1 + e.event_id % 100 END AS start_quality
FROM {events} e
"""

# 24 x 16 pixels per part.
FIXTURES["pixels"] = """
SELECT k AS image_id, CAST(0 AS BIGINT) AS frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x,
  (k * 31 + x * 7 + y * 13) % 256 AS r, (k * 17 + x * 3 + y * 29) % 256 AS g, (k * 5 + x * 11 + y * 2) % 256 AS b,
  CASE WHEN k % 3 = 0 THEN CAST((x * 16 + y) % 256 AS BIGINT) ELSE CAST(255 AS BIGINT) END AS a
FROM (SELECT k, y, @COLUMNS AS x FROM (SELECT p_partkey AS k, @ROWS AS y FROM {part}) t) u
"""
# What happens to each of those images.
FIXTURES["pixel_params"] = """
SELECT p_partkey AS image_id, 24 AS w, 16 AS h,
  (p_partkey % 4) * 90 AS angle, p_partkey % 2 = 1 AS flip_h, p_partkey % 3 = 1 AS flip_v,
  p_partkey % 9 AS @LEFT, p_partkey % 5 AS top, 5 + p_partkey % 10 AS box_w, 4 + p_partkey % 7 AS box_h,
  CASE p_partkey % 4 WHEN 0 THEN 0.5e0 WHEN 1 THEN 1.5e0 WHEN 2 THEN 0.3e0 ELSE 1.0e0 END AS w_scale,
  CASE p_partkey % 5 WHEN 0 THEN 0.5e0 WHEN 1 THEN 1.25e0 WHEN 2 THEN 0.2e0 ELSE 1.0e0 END AS h_scale,
  24 + p_partkey % 9 AS canvas_w, 16 + p_partkey % 5 AS canvas_h, p_partkey % 4 AS off_x, p_partkey % 3 AS off_y,
  30 + p_partkey % 40 AS cover_w, 10 + p_partkey % 50 AS cover_h,
  p_partkey % 20 - 3 AS wm_left, p_partkey % 12 - 2 AS wm_top, 8 AS mark_w, 8 AS mark_h,
  (1 + p_partkey % 10) / 10.0e0 AS wm_opacity,
  10 + p_partkey % 30 AS threshold,
  CASE WHEN p_partkey % 7 = 3 THEN 255 END AS colour_r, CASE WHEN p_partkey % 7 = 3 THEN 0 END AS colour_g,
  CASE WHEN p_partkey % 7 = 3 THEN 255 END AS colour_b, p_partkey % 2 = 0 AS equal_h, p_partkey % 3 = 0 AS equal_v
FROM {part}
"""
# 8 x 8 grey tiles out of the embeddings.
FIXTURES["tiles"] = """
SELECT image_id, CAST(floor(pos / 8) AS BIGINT) AS y, CAST(pos % 8 AS BIGINT) AS x,
  CAST(floor((CAST(e AS DOUBLE) + 1.0e0) * 127.5e0) AS BIGINT) AS v
FROM (SELECT vec_id AS image_id, @TILE FROM {embeddings}) t
"""

_IMAGE_OF = "1 + e.event_id % (SELECT max(p_partkey) FROM {part})"
# Request log: a duration up to five seconds, errors in the share of error events.
FIXTURES["request_log"] = f"""
SELECT e.event_id AS req_id, @TS_US AS start_us, CAST(round(e.value * 10000) AS BIGINT) AS duration_us, e.user_id,
  CASE WHEN e.event_type <> 'error' THEN 200 WHEN e.event_id % 4 = 0 THEN 404 WHEN e.event_id % 4 = 1 THEN 422
       WHEN e.event_id % 4 = 2 THEN 403 ELSE 503 END AS status,
  CASE WHEN e.event_id % 40 = 9 THEN 500 END AS error_status,
  CASE WHEN e.event_type <> 'error' THEN NULL WHEN e.event_id % 4 = 0 THEN 'path_parsing' WHEN e.event_id % 4 = 1 THEN 'processing'
       WHEN e.event_id % 4 = 2 THEN 'security' ELSE 'download' END AS error_category,
  i.source_url, i.format, i.bytes AS origin_bytes,
  CAST(floor(i.bytes * (20 + e.event_id % 70) / 100) AS BIGINT) AS result_bytes
FROM {{events}} e JOIN {{images}} i ON i.image_id = {_IMAGE_OF}
"""
FIXTURES["span_log"] = """
SELECT req_id, span, CAST(floor(duration_us * CASE span WHEN 'Queue' THEN 10 WHEN 'Downloading image' THEN 30 ELSE 60 END
  / 100) AS BIGINT) AS duration_us
FROM (SELECT l.req_id, l.duration_us, @SPANS AS span FROM {request_log} l) t
"""
# Weighted URL groups of the load profile.
FIXTURES["load_urls"] = (
    "SELECT * FROM (VALUES ('jpeg', 5), ('png', 2), ('gif', CAST(NULL AS INTEGER)), ('none', 1)) AS t(grp, weight)"
)


def _date(day: str, hour: str) -> str:
    two = lambda v: f"lpad(CAST({v} AS VARCHAR(20)), 2, '0')"
    return f"concat('Mon, ', {two(day)}, ' Jan 2024 ', {two(hour)}, ':10:00 GMT')"


FIXTURES["headers_log"] = f"""
SELECT e.event_id AS req_id, @TS_US AS now_us, CASE WHEN e.event_id % 7 = 3 THEN 404 ELSE 200 END AS status,
  e.event_id % 5 = 2 AS is_fallback,
  CASE e.event_id % 3 WHEN 0 THEN 1704067200 + (e.event_id * 977) % 2592000 WHEN 1 THEN 1900000000 END AS expires_s,
  CASE e.event_id % 6 WHEN 0 THEN concat('"etag', CAST(e.event_id % 5 AS VARCHAR(20)), '"')
    WHEN 1 THEN concat('W/"etag', CAST(e.event_id % 5 AS VARCHAR(20)), '"') WHEN 2 THEN '"b1/ImV0YWci"' WHEN 3 THEN '"b1/!!"'
    WHEN 4 THEN '' END AS if_none_match,
  CASE e.event_id % 8 WHEN 0 THEN concat('"etag', CAST(e.event_id % 5 AS VARCHAR(20)), '"') WHEN 1 THEN ''
    WHEN 2 THEN concat('W/"etag', CAST(e.event_id % 7 AS VARCHAR(20)), '"') WHEN 4 THEN '"etag"' WHEN 6 THEN '"x/y"' END AS etag,
  CASE e.event_id % 5 WHEN 0 THEN {_date("1 + e.event_id % 28", "e.event_id % 24")} WHEN 1 THEN 'yesterday' WHEN 2 THEN ''
    WHEN 3 THEN {_date("1 + e.event_id % 9", "e.event_id % 24")} END AS if_modified_since,
  CASE e.event_id % 4 WHEN 0 THEN {_date("1 + e.event_id % 27", "e.event_id % 23")} WHEN 1 THEN 'Mon, 99 Jan 2024 00:00:00 GMT'
    WHEN 2 THEN {_date("1 + e.event_id % 9", "e.event_id % 11")} END AS last_modified,
  CASE e.event_id % 6 WHEN 0 THEN 'no-store' WHEN 1 THEN '' END AS origin_cache_control,
  CASE e.event_id % 7 WHEN 0 THEN {_date("1 + e.event_id % 28", "e.event_id % 24")} WHEN 1 THEN 'soon' END AS origin_expires,
  concat(CASE e.event_id % 4 WHEN 0 THEN 's3' WHEN 1 THEN 'https' ELSE 'http' END, '://h', CAST(e.event_id % 9 AS VARCHAR(20)), '/a.b/',
    CASE e.event_id % 5 WHEN 0 THEN 'pic.tar.gz' WHEN 1 THEN 'noext' WHEN 2 THEN '' WHEN 3 THEN '.png' ELSE 'x"y.jpg' END) AS url,
  CASE e.event_id % 7 WHEN 0 THEN 'my "file"' WHEN 1 THEN '' END AS filename,
  CASE e.event_id % 6 WHEN 0 THEN '.webp' WHEN 1 THEN '' END AS ext,
  CASE e.event_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/x' ELSE '' END AS content_type,
  e.event_id % 2 = 0 AS attachment,
  CASE WHEN e.event_id % 5 = 0 THEN concat('9.9.9.', CAST(e.event_id % 200 AS VARCHAR(20))) WHEN e.event_id % 5 = 1 THEN '' END AS cf_connecting_ip,
  CASE e.event_id % 4 WHEN 0 THEN concat('8.8.8.', CAST(e.event_id % 200 AS VARCHAR(20)), ', 10.0.0.1') WHEN 1 THEN '7.7.7.7'
    WHEN 2 THEN ',1.1.1.1' END AS x_forwarded_for,
  CASE WHEN e.event_id % 3 = 0 THEN '6.6.6.6' END AS x_real_ip,
  concat('5.5.5.', CAST(e.user_id % 250 AS VARCHAR(20))) AS remote_addr
FROM {{events}} e
"""

FIXTURES["object_urls"] = (
    "SELECT p.p_partkey AS image_id, "
    + _shapes(
        [
            "s3://bucket<e.p_partkey % 7>/dir%20x/<e.p_partkey>.png?versionId=v<e.p_partkey % 5>",
            "gs://bkt<e.p_partkey % 7>/a#b/<e.p_partkey>?x?y",
            "local:///dir/<e.p_partkey>.jpg",
            "http://h/p?q=<e.p_partkey>",
            "abs://cont<e.p_partkey % 3>//k/<e.p_partkey>",
            "swift://acc/obj<e.p_partkey>",
            "ftp://h/<e.p_partkey>",
            "s3://only<e.p_partkey>",
            "https://h<e.p_partkey % 9>/<e.p_partkey>",
        ]
    ).replace("e.event_id", "p.p_partkey").replace("e.p_partkey", "p.p_partkey")
    + " AS source_url FROM {part} p"
)
# First bytes of files, as hex, with what the server said about them.
_HEADS = [
    "FFD8FFE0", "FF0A00", "0000000C4A584C200D0A870A", "89504E470D0A1A0A0000", "524946461234567857454250", "474946383961",
    "00000100", "00000018667479706865696300", "000000186674797061766966", "424D3600", "49492A0008", "4D4D002A00",
    "000000186674797069736F6D", "FF", "", "474946383761",
]
FIXTURES["blobs"] = (
    "SELECT p.p_partkey AS image_id, CASE p.p_partkey % 20 "
    + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADS))
    + """ WHEN 16 THEN '3C3F786D6C3F3E3C212D2D203C737667203E202D2D3E3C737667202F3E'
      WHEN 17 THEN '3C212D2D203C737667203E202D2D3E3C68746D6C3E' WHEN 18 THEN '3C783A7376673E'
      ELSE '3C215B43444154415B3C737667203E5D5D3E3C623E' END AS head,
  CASE p.p_partkey % 7 WHEN 0 THEN '.tiff' WHEN 1 THEN '.NEF' WHEN 2 THEN '.jpg' WHEN 3 THEN '' WHEN 4 THEN '.dng' WHEN 5 THEN '.svg'
    ELSE '.bin' END AS ext,
  CASE p.p_partkey % 5 WHEN 0 THEN 'image/x-canon-cr2' WHEN 1 THEN 'image/tiff' WHEN 2 THEN '' ELSE 'text/plain' END AS content_type,
  100 + p.p_partkey * 3 AS length, 1704067200000000000 + p.p_partkey * 1000003 AS mtime_ns,
  concat('/dir/', CAST(p.p_partkey AS VARCHAR(20)), '.bin') AS path,
  CASE p.p_partkey % 9 WHEN 0 THEN 'bytes=0-3' WHEN 1 THEN 'bytes=2-' WHEN 2 THEN 'bytes=-5' WHEN 3 THEN 'bytes=3-1'
    WHEN 4 THEN 'bytes=1-2,4-5' WHEN 5 THEN 'bytes=x' WHEN 6 THEN '' WHEN 7 THEN 'bytes=0-0' END AS "range",
  CASE p.p_partkey % 11 WHEN 0 THEN 304 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN 302 WHEN 4 THEN 206 WHEN 5 THEN 206 WHEN 6 THEN 206
    WHEN 7 THEN 206 WHEN 8 THEN 429 ELSE 200 END AS origin_status,
  CASE p.p_partkey % 11 WHEN 4 THEN 'bytes 0-99/100' WHEN 5 THEN 'bytes 0-99/*' WHEN 6 THEN 'bytes 5-99/100' WHEN 7 THEN 'junk' END
    AS content_range,
  CASE WHEN p.p_partkey % 2 = 0 THEN 100 ELSE 50 END AS content_length,
  concat('exp', CAST(p.p_partkey AS VARCHAR(20))) AS expires, concat('lm', CAST(p.p_partkey AS VARCHAR(20))) AS last_modified
FROM {part} p
""".replace('AS "range"', "AS @RANGE")
)
DIALECT["@RANGE"] = ("`range`", '"range"')

FIXTURES["raw_tags"] = """
SELECT l_partkey AS image_id, l_orderkey * 10 + l_linenumber AS seq,
  CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 2 END AS record,
  CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN 20 WHEN 1 THEN 90 ELSE
    CASE (l_orderkey * 7 + l_linenumber) % 8 WHEN 0 THEN 5 WHEN 1 THEN 25 WHEN 2 THEN 80 WHEN 3 THEN 110 WHEN 4 THEN 116
      WHEN 5 THEN 120 WHEN 6 THEN 10 ELSE 99 END END AS tag,
  CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN concat(l_returnflag, l_linestatus)
    WHEN 1 THEN concat(l_returnflag, l_linestatus, CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN 'yz' ELSE 'yzq' END)
    ELSE repeat(concat(l_returnflag, CAST(l_partkey AS VARCHAR(20))), CAST(1 + l_suppkey % 12 AS INTEGER)) END AS raw_text
FROM {lineitem}
"""
FIXTURES["strip_plan"] = """
SELECT p_partkey AS image_id, p_partkey % 4 <> 0 AS strip, p_partkey % 3 <> 0 AS keep_copyright, p_partkey % 5 = 0 AS animated FROM {part}
"""
META_NAMES = [
    "icc-profile-data", "exif-data", "exif-ifd0-Copyright", "exif-ifd0-Model", "iptc-data", "xmp-data", "page-height",
    "delay", "loop", "n-pages", "xres", "yres", "background", "internal-note", "comment", "palette",
]
XMP_NAMES = [
    "dc:rights", "dc:title", "dc:creator", "dc:format", "xmpRights:Marked", "cc:license", "photoshop:Credit", "tiff:Make",
]
DIALECT["@METANAMES"] = tuple(
    f.format(", ".join(f"'{n}'" for n in META_NAMES)) for f in ("explode(array({}))", "unnest([{}])")
)
DIALECT["@XMPNAMES"] = tuple(
    f.format(", ".join(f"'{n}'" for n in XMP_NAMES)) for f in ("explode(array({}))", "unnest([{}])")
)
FIXTURES["meta_fields"] = """
SELECT image_id, name, concat(name, CAST(image_id AS VARCHAR(20))) AS value
FROM (SELECT p.p_partkey AS image_id, @METANAMES AS name FROM {part} p) t
"""
FIXTURES["xmp_rows"] = """
SELECT image_id, substr(q, 1, @POS - 1) AS ns, substr(q, @POS + 1) AS name, CASE WHEN image_id % 2 = 0 THEN 'node' ELSE 'attr' END AS kind,
  concat(q, CAST(image_id AS VARCHAR(20))) AS value
FROM (SELECT p.p_partkey AS image_id, @XMPNAMES AS q FROM {part} p) t
"""
DIALECT["@POS"] = ("instr(q, ':')", "strpos(q, ':')")
# Web pages with the markup a sanitiser looks for added behind them.
FIXTURES["docs"] = """
SELECT page_id AS doc_id, concat(html, CASE page_id % 4
  WHEN 0 THEN '<svg onload="x()" onclick=''y'' width="5"><use href="#a"/><use xlink:href="http://e/x"/><g onfoo="1" onmouseover=z></g><g onload><a b="1"onclick="x"xlink:href="javascript:x"href=''ok''/onfocus=1></a></g><a x:y:onblur = "1" href></a></svg>'
  WHEN 1 THEN '<iframe src="x">abc</iframe><form><b>t</b></form><s:script/>k<script  a="b">1</script >tail'
  WHEN 2 THEN '<a href="javascript:alert(1)">x</a><a href=" JaVaScript&#58;x">y</a><a href="mailto:a">z</a><a href="jav&#97;script:al(1)">n</a><use href="&#35;ok"/><a href="jAv&#x61script:q">m</a><a href=''http&colon;//q''>w</a>'
  ELSE '<image href="data:image/png;base64,AA"/><a href="data:text/html,x">q</a><a href="x y">r</a><script>unclosed <b>z' END) AS body
FROM {pages}
"""
