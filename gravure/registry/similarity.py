"""Queries K: hashes, distances, duplicates and goldens, with their SQL checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from gravure.operators import similarity as sim
from gravure.registry.fixtures import table, with_tables
from gravure.registry.pixels import scanlines
from gravure.session import cut_lineage

NEAR = 40.0


def _px(spark, sf):
    return table(spark, sf, "pixels")


def _params(spark, sf):
    return table(spark, sf, "pixel_params").select("image_id", "w", "h", (F.col("image_id") % 5 == 0).alias("grey"))


def _hashes(spark, sf, lines=None):
    return sim.pack_hash(sim.dct_hash(scanlines(spark, sf) if lines is None else lines, _params(spark, sf), long=False))


def _milli(c):
    return F.round(F.col(c) * 1000).cast("bigint")


def _redder(batches):
    """Lines whose red is greater by image_id % 3, 255 at most."""
    for batch in batches:
        image, px = batch.column("image_id"), batch.column("px")
        size = pc.binary_length(px).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        values = np.frombuffer(b"".join(px.to_pylist()), np.uint8).reshape(-1, 4).copy()
        more = np.fmod(image.fill_null(0).to_numpy(), 3).repeat(size // 4)
        values[:, 0] = np.minimum(255, values[:, 0] + more)
        changed = pa.Array.from_buffers(pa.binary(), len(px), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])
        yield pa.RecordBatch.from_arrays([image, batch.column("frame"), batch.column("y"), changed], names=["image_id", "frame", "y", "px"])


def _k03(spark, sf):
    parts = table(spark, sf, "part")
    most = F.lit(parts.agg(F.max("p_partkey")).first()[0])
    pairs = parts.select(F.col("p_partkey").alias("a"), (1 + (F.col("p_partkey") * 7 + 3) % most).alias("b"))
    df = sim.hash_distance(pairs, _hashes(spark, sf))
    finite = F.col("distance") < F.lit(float("inf"))
    return df.select("a", "b", F.when(finite, _milli("distance")).otherwise(-1).alias("distance"))


def _k04(spark, sf):
    # The search reads the hashes several times: they are a stored table, not a recomputation.
    df = sim.near_duplicates(cut_lineage(_hashes(spark, sf)), NEAR)
    return df.select("a", "b", _milli("distance").alias("distance"), "copies_a", "copies_b")


def _k06(spark, sf):
    shifted = scanlines(spark, sf).mapInArrow(_redder, "image_id long, frame int, y int, px binary")
    new = _hashes(spark, sf).filter(F.col("image_id") % 4 != 0)
    golden = _hashes(spark, sf, shifted).filter(F.col("image_id") % 7 != 0)
    return sim.golden_match(new, golden, 0.5)


QUERIES = {
    "k01_dct_hash": lambda spark, sf: sim.dct_hash(scanlines(spark, sf), _params(spark, sf)).select(
        "image_id", "ch", "v", "u", _milli("coef").alias("coef")
    ),
    "k02_pixel_hash": lambda spark, sf: sim.pixel_hash(_px(spark, sf)),
    "k03_hash_distance": _k03,
    "k04_near_duplicates": _k04,
    "k05_exact_duplicates": lambda spark, sf: sim.exact_duplicates(sim.pixel_hash(_px(spark, sf))),
    "k06_golden_match": _k06,
    "k07_conversion_matrix": lambda spark, sf: sim.conversion_matrix(table(spark, sf, "images")),
}


def _hash_sql(src, name):
    lin = lambda c: f"(CASE WHEN {c} / 255.0e0 <= 0.04045e0 THEN {c} / 255.0e0 / 12.92e0 ELSE pow(({c} / 255.0e0 + 0.055e0) / 1.055e0, 2.4e0) END)"
    over = lambda c, back: f"({lin(c)} * (a / 255.0e0) + (1.0e0 - a / 255.0e0) * {back})"
    f = lambda t: f"(CASE WHEN {t} > 0.008856e0 THEN cbrt({t}) ELSE {t} * 7.787e0 + 16.0e0 / 116.0e0 END)"
    return f"""
{name}_l AS (SELECT image_id, y, x, {over("r", "1.0e0")} AS r, {over("g", "0.0e0")} AS g, {over("b", "1.0e0")} AS b FROM {src}),
{name}_x AS (SELECT image_id, y, x, {f("((r * 0.4124e0 + g * 0.3576e0 + b * 0.1805e0) / 0.95047e0)")} AS fx,
    {f("(r * 0.2126e0 + g * 0.7152e0 + b * 0.0722e0)")} AS fy, {f("((r * 0.0193e0 + g * 0.1192e0 + b * 0.9505e0) / 1.08883e0)")} AS fz FROM {name}_l),
{name}_r AS (SELECT image_id, y, u, sum((fy * 116.0e0 - 16.0e0) * k) AS c0, sum((fx - fy) * 500.0e0 * k) AS c1, sum((fy - fz) * 200.0e0 * k) AS c2
  FROM (SELECT image_id, y, x, fx, fy, fz, unnest(range(0, 8)) AS u FROM {name}_x)
  JOIN (SELECT x AS kx, u AS ku, cos((2 * x + 1) * u * pi() / 48) AS k FROM (SELECT unnest(range(0, 24)) AS x) CROSS JOIN (SELECT unnest(range(0, 8)) AS u))
    ON kx = x AND ku = u GROUP BY ALL),
{name}_v AS (SELECT image_id, u, v, sum(c0 * k) AS c0, sum(c1 * k) AS c1, sum(c2 * k) AS c2
  FROM (SELECT *, unnest(range(0, 8)) AS v FROM {name}_r)
  JOIN (SELECT y AS ky, v AS kv, cos((2 * y + 1) * v * pi() / 32) AS k FROM (SELECT unnest(range(0, 16)) AS y) CROSS JOIN (SELECT unnest(range(0, 8)) AS v))
    ON ky = y AND kv = v GROUP BY ALL),
{name}_c AS (SELECT image_id, v, u, unnest([0, 1, 2]) AS ch, unnest([c0, c1, c2]) * sqrt(CASE WHEN u = 0 THEN 1.0e0 ELSE 2.0e0 END / 24.0e0)
    * sqrt(CASE WHEN v = 0 THEN 1.0e0 ELSE 2.0e0 END / 16.0e0) AS coef FROM {name}_v),
{name} AS (SELECT * FROM {name}_c WHERE ch = 0 OR image_id % 5 <> 0),
{name}_h AS MATERIALIZED (SELECT image_id, list(round(coef, 6) ORDER BY ch, v, u) AS h FROM {name} GROUP BY image_id)"""


_DIST = "pow(list_distance(p.h, q.h), 2) / len(p.h)"
_SHA = """ln AS (SELECT image_id, y, string_agg(printf('%02x%02x%02x%02x', r, g, b, a), '' ORDER BY x) AS l FROM pixels GROUP BY ALL),
ph AS (SELECT image_id, sha256(unhex(string_agg(l, '' ORDER BY y))) AS hash FROM ln GROUP BY image_id)"""

ORACLES = {
    "k01_dct_hash": with_tables(
        "pixels", _hash_sql("pixels", "dc").strip() + "\nSELECT image_id, ch, v, u, CAST(round(coef * 1000) AS BIGINT) AS coef FROM dc"
    ),
    "k02_pixel_hash": with_tables("pixels", _SHA + "\nSELECT image_id, hash FROM ph"),
    "k03_hash_distance": with_tables(
        "pixels",
        _hash_sql("pixels", "dc").strip()
        + f"""
SELECT p_partkey AS a, 1 + (p_partkey * 7 + 3) % (SELECT max(p_partkey) FROM part) AS b, CAST(CASE WHEN len(p.h) = len(q.h) THEN round({_DIST} * 1000) ELSE -1 END AS BIGINT) AS distance
FROM part JOIN dc_h p ON p.image_id = p_partkey JOIN dc_h q ON q.image_id = 1 + (p_partkey * 7 + 3) % (SELECT max(p_partkey) FROM part)""",
    ),
    "k04_near_duplicates": with_tables(
        "pixels",
        _hash_sql("pixels", "dc").strip()
        + f""",
ds AS MATERIALIZED (SELECT min(image_id) AS image_id, count(*) AS n, any_value(h) AS h FROM dc_h GROUP BY list_transform(h, lambda v: round(v * 1000000))),
pr AS (SELECT p.image_id AS a, q.image_id AS b, {_DIST} AS d, p.n AS copies_a, q.n AS copies_b FROM ds p JOIN ds q
  ON p.image_id < q.image_id AND len(p.h) = len(q.h))
SELECT a, b, CAST(round(d * 1000) AS BIGINT) AS distance, copies_a, copies_b FROM pr WHERE d <= {NEAR}""",
    ),
    "k05_exact_duplicates": with_tables(
        "pixels", _SHA + "\nSELECT hash, count(*) AS n, min(image_id) AS first FROM ph GROUP BY hash HAVING count(*) > 1"
    ),
    "k06_golden_match": with_tables(
        "pixels",
        "sh AS (SELECT image_id, y, x, least(255, r + image_id % 3) AS r, g, b, a FROM pixels),"
        + _hash_sql("pixels", "dc")
        + ","
        + _hash_sql("sh", "go")
        + f"""
SELECT coalesce(p.image_id, q.image_id) AS image_id, CASE WHEN p.h IS NULL THEN 'stale' WHEN q.h IS NULL THEN 'missing'
  WHEN {_DIST} <= 0.5 THEN 'match' ELSE 'differ' END AS status
FROM (SELECT * FROM dc_h WHERE image_id % 4 <> 0) p FULL JOIN (SELECT * FROM go_h WHERE image_id % 7 <> 0) q ON p.image_id = q.image_id""",
    ),
    "k07_conversion_matrix": with_tables(
        "images",
        f"""m AS (SELECT unnest({list(sim.MATRIX)!r}) AS f)
SELECT s.f AS source, t.f AS target, n AS images, CASE WHEN s.f <> 'svg' AND t.f = 'svg' THEN 'skip: raster to vector'
  WHEN t.f = 'svg' THEN 'skip: cannot save' ELSE 'run' END AS verdict
FROM (SELECT format AS f, count(*) AS n FROM images GROUP BY 1) s JOIN m k ON k.f = s.f CROSS JOIN m t""",
    ),
}
