"""Queries G and H: metadata and markup jobs, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.operators import markup, metadata
from gravure.registry.fixtures import table, with_tables
from gravure.registry.requests import _values


def _raw(spark, sf):
    return table(spark, sf, "raw_tags").withColumn("raw", F.encode("raw_text", "UTF-8")).drop("raw_text")


def _valid(spark, sf):
    return metadata.iptc_validate(_raw(spark, sf))


def _tag_rows(df):
    return df.select("image_id", "seq", "record", "tag", F.hex("raw").alias("raw"))


def _docs(spark, sf):
    return table(spark, sf, "docs")


QUERIES = {
    "g01_iptc_validate": lambda spark, sf: _tag_rows(_valid(spark, sf)),
    "g02_iptc_typed": lambda spark, sf: metadata.iptc_typed(_valid(spark, sf)),
    "g03_strip_metadata": lambda spark, sf: metadata.strip_metadata(
        table(spark, sf, "meta_fields"), table(spark, sf, "strip_plan")
    ),
    "g04_keep_copyright_iptc": lambda spark, sf: _tag_rows(metadata.keep_copyright_iptc(_valid(spark, sf))),
    "g05_keep_copyright_xmp": lambda spark, sf: metadata.keep_copyright_xmp(table(spark, sf, "xmp_rows")),
    "g06_metadata_audit": lambda spark, sf: metadata.metadata_audit(_valid(spark, sf), table(spark, sf, "strip_plan")),
    "h01_sanitize_markup": lambda spark, sf: markup.sanitize_markup(_docs(spark, sf)),
    "h02_href_audit": lambda spark, sf: markup.href_audit(_docs(spark, sf)).select("doc_id", "tag", "href", "safe"),
    "h03_unsafe_attr_audit": lambda spark, sf: markup.unsafe_attr_audit(_docs(spark, sf)),
    "h04_element_audit": lambda spark, sf: markup.element_audit(_docs(spark, sf)),
}

_TAGS = f"dict({', '.join(metadata.TAG_FIELDS)}) AS (VALUES {_values(metadata.TAGS)})"
_VALID = f"""{_TAGS},
kn AS (SELECT r.*, d.repeatable, d.title, d.format FROM raw_tags r JOIN dict d ON d.record = r.record AND d.tag = r.tag
  WHERE octet_length(encode(raw_text)) BETWEEN min_size AND max_size),
vt AS (SELECT image_id, seq, record, tag, raw_text, title, format FROM kn WHERE repeatable
  UNION ALL SELECT image_id, seq, record, tag, raw_text, title, format FROM kn WHERE NOT repeatable
  QUALIFY row_number() OVER (PARTITION BY image_id, record, tag ORDER BY seq DESC, raw_text DESC) = 1)"""
_ROWS = "SELECT image_id, seq, record, tag, hex(encode(raw_text)) AS raw FROM vt"
_ASCII = lambda i: f"ascii(substr(raw_text, {i}, 1))"
_TYPED = f"""CASE WHEN format IN ('byte', 'short', 'long') THEN CAST(CASE len(raw_text) WHEN 2 THEN {_ASCII(1)} * 256 + {_ASCII(2)}
  WHEN 3 THEN {_ASCII(1)} * 65536 + {_ASCII(2)} * 256 + {_ASCII(3)}
  ELSE CAST({_ASCII(1)} AS BIGINT) * 16777216 + {_ASCII(2)} * 65536 + {_ASCII(3)} * 256 + {_ASCII(4)} END AS VARCHAR) ELSE raw_text END"""


# The check engine's own forms: comments, CDATA, tags, text; start and end tags of forbidden elements.
_PIECES = r"""(?s:<!--.*?-->|<!\[CDATA\[.*?\]\]>)|<(?:[^<>"']|"[^"]*"|'[^']*')*>|[^<]+|<"""
_FORBIDDEN = r"^<(/?)(?:[A-Za-z_][A-Za-z0-9_.-]*:)?(script|iframe|form)(?:\s[^\x00]*|/)?>$"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _href_sql(attr):
    value = " || ".join(f"regexp_extract({attr}, {_q(markup.HREF_VALUE)}, {i})" for i in (1, 2, 3))
    out = rf"regexp_replace({value}, '^\s+|\s+$', '', 'g')"
    for code in range(127, 0, -1):
        if chr(code).isalnum() or code in (9, 10, 13, 32, 35, 43, 45, 46, 47, 58):
            out = f"regexp_replace({out}, '(?i)&#(?:0*{code}|x0*{code:x});?', chr({code}), 'g')"
    for entity, char in (
        ("&colon;", "':'"), ("&Tab;", "chr(9)"), ("&NewLine;", "chr(10)"), ("&lt;", "'<'"), ("&gt;", "'>'"),
        ("&quot;", "'\"'"), ("&amp;", "'&'"),
    ):
        out = f"replace({out}, '{entity}', {char})"
    return out


def _safe_sql(tag, value):
    scheme = f"lower(regexp_extract({value}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))"
    return f"""CASE WHEN {value} = '' OR starts_with({value}, '#') THEN true WHEN {tag} = 'use' THEN false
  WHEN {scheme} IN ('', 'http', 'https') THEN true ELSE {tag} = 'image' AND {scheme} = 'data' END"""


#: The check's own way through a tag: what follows the head, attribute by attribute, names without their prefixes.
_ATTRIBUTE = r"""\s*[^\s"'=<>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']*))?|[\s"'=<>/]"""
_TIGHT = r"""^[^\s"'=<>/]"""
_HEAD = r"""^<[^\s/>"'=]+"""


def _parts_sql(p):
    return f"regexp_extract_all(substr({p}, 1 + length(regexp_extract({p}, {_q(_HEAD)}))), {_q(_ATTRIBUTE)})"


def _local_sql(a):
    return f"list_last(string_split(regexp_extract({a}, {_q(r'^' + chr(92) + 's*([^' + chr(92) + 's' + chr(34) + chr(39) + '=<>/]+)')}, 1), ':'))"


def _sanitize_sql():
    tag = f"regexp_extract(p, {_q(markup.TAG_NAME)}, 1)"
    events = ", ".join(_q(a) for a in markup.EVENT_ATTRIBUTES)
    safe = f"{_local_sql('a')} NOT IN ({events}) AND ({_local_sql('a')} <> 'href' OR {_safe_sql('t', _href_sql('a'))})"
    # Forbidden tags are walked one by one: name and depth of the open element after each.
    return f"""al AS MATERIALIZED (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS p FROM (SELECT doc_id, regexp_extract_all(body, {_q(_PIECES)}) AS l FROM docs)),
ev AS MATERIALIZED (SELECT doc_id, i, f[2] AS name, CASE WHEN f[1] = '/' THEN 'end' WHEN p LIKE '%/>' THEN 'whole' ELSE 'start' END AS kind,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT *, [regexp_extract(p, {_q(_FORBIDDEN)}, 1), regexp_extract(p, {_q(_FORBIDDEN)}, 2)] AS f FROM al) WHERE f[2] <> ''),
wk(doc_id, k, i, kind, name, depth, was) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', '', 0, 0 FROM ev
  UNION ALL
  SELECT e.doc_id, e.k, e.i, e.kind, CASE WHEN w.depth > 0 THEN w.name ELSE e.name END,
    CASE WHEN w.depth = 0 THEN CAST(e.kind = 'start' AS INTEGER) WHEN e.name <> w.name OR e.kind = 'whole' THEN w.depth
      WHEN e.kind = 'start' THEN w.depth + 1 ELSE w.depth - 1 END, w.depth
  FROM wk w JOIN ev e ON e.doc_id = w.doc_id AND e.k = w.k + 1),
pcs AS (SELECT a.doc_id, a.i, a.p FROM al a ASOF LEFT JOIN wk w ON a.doc_id = w.doc_id AND a.i >= w.i
  WHERE NOT coalesce(w.depth > 0 OR (w.i = a.i AND (w.was > 0 OR w.kind = 'whole')), false)),
qt AS (SELECT doc_id, i, p, {tag} AS t FROM pcs),
cl AS (SELECT doc_id, i, CASE WHEN regexp_matches(p, '^<[A-Za-z_]') THEN regexp_extract(p, {_q(_HEAD)}) ||
  array_to_string(list_transform(list_filter({_parts_sql("p")}, lambda a: {safe}), lambda a: CASE WHEN regexp_matches(a, {_q(_TIGHT)}) THEN ' ' || a ELSE a END), '') ELSE p END AS p FROM qt)
SELECT c.doc_id, coalesce(string_agg(p, '' ORDER BY i), '') AS body FROM docs c LEFT JOIN cl USING (doc_id) GROUP BY c.doc_id"""


_START = f"""st AS (SELECT doc_id, unnest(regexp_extract_all(body, {_q(_PIECES)})) AS m FROM docs),
tg AS (SELECT doc_id, m, regexp_extract(m, {_q(markup.TAG_NAME)}, 1) AS tag FROM st),
pa AS (SELECT doc_id, tag, unnest({_parts_sql("m")}) AS a FROM tg WHERE tag <> ''),
ab AS (SELECT *, {_local_sql("a")} AS name FROM pa)"""

ORACLES = {
    "g01_iptc_validate": with_tables("raw_tags", f"{_VALID}\n{_ROWS}"),
    "g02_iptc_typed": with_tables(
        "raw_tags",
        f"""{_VALID},
ty AS (SELECT *, {_TYPED} AS value FROM vt)
SELECT image_id, seq, title AS key, value FROM ty
UNION ALL SELECT image_id, seq, CASE tag WHEN 5 THEN 'Name' ELSE 'Caption' END, value FROM ty WHERE record = 2 AND tag IN (5, 120)""",
    ),
    "g03_strip_metadata": with_tables(
        "meta_fields strip_plan",
        """SELECT image_id, name, CASE WHEN strip AND name IN ('xres', 'yres') THEN '2.8346' ELSE value END AS value
FROM meta_fields JOIN strip_plan USING (image_id)
WHERE NOT strip OR name IN ('icc-profile-data', 'palette', 'background', 'internal-note', 'xres', 'yres')
  OR (keep_copyright AND name IN ('exif-data', 'exif-ifd0-Copyright', 'iptc-data', 'xmp-data'))
  OR (animated AND name IN ('page-height', 'delay', 'loop', 'n-pages'))""",
    ),
    "g04_keep_copyright_iptc": with_tables("raw_tags", f"{_VALID}\n{_ROWS} WHERE record <> 2 OR tag IN (80, 110, 116)"),
    "g05_keep_copyright_xmp": with_tables(
        "xmp_rows",
        "SELECT * FROM xmp_rows WHERE ns IN ('xmpRights', 'cc') OR (ns = 'dc' AND name IN ('rights', 'creator'))",
    ),
    "g06_metadata_audit": with_tables(
        "raw_tags strip_plan",
        f"""{_VALID}
SELECT strip, keep_copyright, count(*) AS tags,
  count(*) FILTER (WHERE (NOT strip OR (keep_copyright AND record <> 2)) AND NOT (record = 2 AND tag IN (80, 110, 116))) AS leaked,
  count(*) FILTER (WHERE strip AND NOT keep_copyright AND record = 2 AND tag IN (80, 110, 116)) AS lost
FROM vt JOIN strip_plan USING (image_id) GROUP BY 1, 2""",
    ),
    "h01_sanitize_markup": with_tables("docs", _sanitize_sql()),
    "h02_href_audit": with_tables(
        "docs",
        f"""{_START},
hr AS (SELECT doc_id, tag, a FROM ab WHERE name = 'href'),
hv AS (SELECT doc_id, tag, {_href_sql("a")} AS href FROM hr)
SELECT doc_id, tag, href, {_safe_sql("tag", "href")} AS safe FROM hv""",
    ),
    "h03_unsafe_attr_audit": with_tables(
        "docs",
        f"""{_START},
ea AS (SELECT doc_id, name AS attr FROM ab)
SELECT doc_id, attr, count(*) AS n FROM ea WHERE attr IN ({", ".join(_q(a) for a in markup.EVENT_ATTRIBUTES)}) GROUP BY 1, 2""",
    ),
    "h04_element_audit": with_tables(
        "docs",
        f"{_START}\nSELECT doc_id, tag, count(*) AS n FROM tg WHERE tag IN ('script', 'iframe', 'form') GROUP BY 1, 2",
    ),
}
