"""Boilerplate lines by their spread over sites, with Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravure.llm.common import stored

#: Sites on which a line must stand to be boilerplate; log2 of the sketches' registers.
MIN_SITES, REGISTERS = 10, 12


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line with anything but spaces: the document's key, site, position and the line's key.

    Keys are two 64-bit hashes. Lines are parted by line feeds and compared without spaces at their ends.
    """
    line = F.trim("line")
    return (
        docs.select("_id", "_key", "_site", F.posexplode(F.split("_text", "\n")).alias("at", "line"))
        .where(F.length(line) > 0)
        .select("_id", "_key", "_site", "at", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")).alias("line"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, registers: int = REGISTERS) -> DataFrame:
    """Lines on at least `min_sites` different sites, and the first row of each (smallest id, document, position).

    A HyperLogLog sketch of the sites of each line is merged by the aggregation, so a hot line costs one
    sketch per task. A sketch of 2^12 registers errs by 1.6 %; lines estimated within a tenth (six
    deviations) and one site of the threshold get exact distinct counts, so no decision rests on an estimate.
    """
    low, high = 0.9 * min_sites - 1, 1.1 * min_sites + 1
    spread = stored(
        lines.groupBy("line")
        .agg(F.hll_sketch_agg("_site", registers).alias("sites"), F.min(F.struct("_id", "_key", "at")).alias("first"))
        .select("line", F.hll_sketch_estimate("sites").alias("about"), "first")
        .where(F.col("about") >= low)
    )
    near = spread.where(F.col("about") <= high).select("line")
    exact = (
        lines.where(F.col("_site").isNotNull())
        .join(near, "line", "left_semi")
        .groupBy("line", "_site")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_sites)
        .select(F.col("line").alias("sure"))
    )
    wide = spread.where(F.col("about") > high).select("line", "first")
    return wide.union(spread.join(exact, F.col("line") == F.col("sure")).select("line", "first"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` (doc_id, text, source and any other columns) without repeated boilerplate, and lines_removed.

    A line that stands on at least `min_sites` different sources stays once, at its first place (smallest
    doc_id, then document hash, then position), and goes everywhere else; other lines stay as they are.
    Documents always stay, if need be with an empty text. `lines_removed` replaces a column of that name.

    Null sources are no site. Null texts stay null, lines of spaces are never boilerplate, null doc_ids sort
    first, equal rows (same doc_id and text) are treated as one document, an empty table gives no rows.
    Nothing depends on a line's length; a document's lines are one row's array, bounded by the document.
    """
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    ident, text, site = (F.col(named[c]) for c in ("doc_id", "text", "source"))
    key = F.struct(F.xxhash64(ident, text).alias("a"), F.xxhash64(F.lit(1), text, ident).alias("b"))
    keyed = docs.select("*", ident.cast("long").alias("_id"), key.alias("_key"), site.cast("string").alias("_site"), text.cast("string").alias("_text"))
    lines = stored(line_rows(keyed.select("_id", "_key", "_site", "_text")))
    common = stored(boilerplate(lines, min_sites)).select(F.col("line").alias("found"), "first")
    here = F.struct("_id", "_key", "at")
    gone = (
        lines.join(common, F.col("line") == F.col("found"))
        .where(~here.eqNullSafe(F.col("first")))
        .groupBy(F.col("_key").alias("of"))
        .agg(F.collect_set("at").alias("gone"))
    )
    joined = keyed.join(stored(gone), F.col("_key") == F.col("of"), "left")
    left = F.filter(F.split("_text", "\n"), lambda _, i: ~F.array_contains("gone", i))
    cleaned = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))
    out = [(cleaned if c == "text" else F.col(n)).alias(c) for c, n in named.items() if c.lower() != "lines_removed"]
    return joined.select(*out, F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"))


#: The same for the given tables, with exact counts throughout.
SQL = f"""
WITH lines AS (
  SELECT doc_id, source, text, u.pos, trim(string_split(text, chr(10))[u.pos]) AS line
  FROM documents, UNNEST(range(1, len(string_split(text, chr(10))) + 1)) AS u(pos)
  WHERE text IS NOT NULL
), common AS (
  SELECT line, min(doc_id) AS first_id FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT l.doc_id, l.pos, string_split(l.text, chr(10))[l.pos] AS raw,
    c.line IS NOT NULL AND NOT (l.doc_id = c.first_id AND l.pos = min(l.pos) OVER (PARTITION BY l.doc_id, l.line)) AS gone
  FROM lines l LEFT JOIN common c ON l.line = c.line
), rebuilt AS (
  SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS lines_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, r.text, CAST(coalesce(r.lines_removed, 0) AS INTEGER) AS lines_removed
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""
