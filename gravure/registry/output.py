"""Queries C: output decisions over the planned requests, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.plans import dims, output
from gravure.registry.fixtures import table, with_tables
from gravure.registry.requests import _values


def _decisions(spark, sf):
    """The decision table with its list and map columns built."""
    df = table(spark, sf, "decisions")
    pairs = F.filter(F.split("fq_text", ","), lambda p: p != "")
    entry = lambda p: F.struct(
        F.split_part(p, F.lit("="), F.lit(1)).alias("key"), F.split_part(p, F.lit("="), F.lit(2)).cast("bigint").alias("value")
    )
    return df.withColumns(
        {
            "skip_formats": F.split("skip_text", ","),
            "format_quality": F.map_from_entries(F.transform(pairs, entry)),
        }
    )


def _formatted(spark, sf):
    return output.output_format(output.may_animate(output.expect_alpha(_decisions(spark, sf))))


def _c01(spark, sf):
    types = dims.image_types(spark)
    counts = table(spark, sf, "images").groupBy("format").agg(
        F.count(F.lit(1)).alias("images"), F.sum("bytes").alias("bytes")
    )
    return types.join(counts, "format", "left")


def _c11(spark, sf):
    fitted = output.fit_max_bytes(table(spark, sf, "fit_renditions"), table(spark, sf, "encodings"))
    return fitted.select("req_id", "final_quality", "attempts", "final_bytes", "fit_status")


QUERIES = {
    "c01_type_capabilities": _c01,
    "c02_check_load_save": lambda spark, sf: output.check_load_save(_decisions(spark, sf)).select(
        "req_id", "load_status", "save_status"
    ),
    "c03_skip_processing": lambda spark, sf: output.skip_processing(_decisions(spark, sf))
    .withColumnRenamed("skip", "skip_default")
    .transform(lambda df: output.skip_processing(df, always_rasterize_svg=True))
    .select("req_id", "skip_default", "skip"),
    "c04_output_format": lambda spark, sf: _formatted(spark, sf).select("req_id", "out_format", "format_status"),
    "c05_expect_alpha": lambda spark, sf: output.expect_alpha(_decisions(spark, sf)).select("req_id", "expect_alpha"),
    "c06_resolve_animation": lambda spark, sf: output.resolve_animation(_formatted(spark, sf)).select(
        "req_id", "animated", "load_frames", "trim_on"
    ),
    "c07_check_dimensions": lambda spark, sf: output.check_dimensions(_decisions(spark, sf), 400_000).select(
        "req_id", "size_status"
    ),
    "c08_oriented_size": lambda spark, sf: output.oriented_size(_decisions(spark, sf)).select(
        "req_id", "shown_w", "shown_h"
    ),
    "c09_small_avif_fallback": lambda spark, sf: output.small_avif_fallback(_formatted(spark, sf)).select(
        "req_id", "saved_format"
    ),
    "c10_resolve_quality": lambda spark, sf: output.resolve_quality(_formatted(spark, sf)).select(
        "req_id", "out_quality"
    ),
    "c11_fit_max_bytes": _c11,
    "c12_palette_depth": lambda spark, sf: output.palette_depth(
        _decisions(spark, sf).withColumn("out_format", F.when(F.col("req_id") % 3 == 0, "gif").otherwise("png"))
    ).select("req_id", "bit_depth"),
    "c13_target_colourspace": lambda spark, sf: output.target_colourspace(_formatted(spark, sf)).select(
        "req_id", "colourspace"
    ),
    "c14_profile_policy": lambda spark, sf: output.profile_policy(_formatted(spark, sf)).select(
        "req_id", "profile_action"
    ),
    "c15_flatten_needed": lambda spark, sf: output.flatten_needed(_formatted(spark, sf)).select(
        "req_id", "flatten", "flatten_colour"
    ),
}

_TYPES = f"types({', '.join(dims.TYPE_FIELDS)}) AS (VALUES {_values(dims.IMAGE_TYPES)})"
_FMT = f"""{_TYPES},
f0 AS (SELECT *, background IS NULL AND (has_alpha OR pad_top + pad_right + pad_bottom + pad_left > 0 OR extend) AS ea,
  max_frames > 1 AND frames > 1 AS ani FROM decisions),
f1 AS (SELECT *, CASE WHEN format = 'svg' THEN NULL WHEN format IS NULL THEN
    CASE WHEN prefer_jxl AND NOT ani THEN 'jxl' WHEN prefer_avif AND NOT ani THEN 'avif' WHEN prefer_webp THEN 'webp'
      WHEN src_format IN ('jpeg', 'png', 'gif') THEN src_format
      WHEN ani THEN 'gif' WHEN ea THEN 'png' ELSE 'jpeg' END
    WHEN enforce_jxl AND NOT ani THEN 'jxl' WHEN enforce_avif AND NOT ani THEN 'avif' WHEN enforce_webp THEN 'webp'
    ELSE format END AS out_format FROM f0),
f2 AS (SELECT f1.*, t.anim_save, t.alpha, t.icc, t.hdr FROM f1 LEFT JOIN types t ON t.format = f1.out_format)"""


def _f(cols):
    return with_tables("decisions", f"{_FMT}\nSELECT req_id, {cols} FROM f2")


ORACLES = {
    "c01_type_capabilities": with_tables(
        "images",
        f"""{_TYPES}
SELECT t.*, n AS images, b AS bytes FROM types t LEFT JOIN (SELECT format, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS b
  FROM images GROUP BY 1) c ON c.format = t.format""",
    ),
    "c02_check_load_save": with_tables(
        "decisions",
        """SELECT req_id, CAST(NULL AS BIGINT) AS load_status, CAST(CASE WHEN format = 'svg' THEN 422 END AS BIGINT) AS save_status
FROM decisions""",
    ),
    "c03_skip_processing": with_tables(
        "decisions",
        """s AS (SELECT *, list_contains(string_split(skip_text, ','), src_format) AS l FROM decisions)
SELECT req_id, CASE WHEN src_format = 'svg' THEN coalesce(format = 'svg', true) ELSE l AND coalesce(format = src_format, true) END AS skip_default,
  CASE WHEN src_format = 'svg' THEN coalesce(format = 'svg', l) ELSE l AND coalesce(format = src_format, true) END AS skip FROM s""",
    ),
    "c04_output_format": _f("out_format, CAST(CASE WHEN out_format IS NULL THEN 422 END AS BIGINT) AS format_status"),
    "c05_expect_alpha": _f("ea AS expect_alpha"),
    "c06_resolve_animation": _f(
        """ani AND coalesce(anim_save, false) AS animated,
  CAST(CASE WHEN ani AND anim_save THEN least(frames, max_frames) ELSE 1 END AS BIGINT) AS load_frames,
  trim_threshold IS NOT NULL AND NOT (ani AND coalesce(anim_save, false)) AS trim_on"""
    ),
    "c07_check_dimensions": with_tables(
        "decisions",
        """SELECT req_id, CAST(CASE WHEN src_format = 'svg' THEN NULL
  WHEN frames > 1 AND coalesce(max_frame_resolution, 0) > 0 THEN CASE WHEN img_w * img_h > max_frame_resolution THEN 422 END
  WHEN img_w * img_h * frames > coalesce(max_src_resolution, 400000) THEN 422 END AS BIGINT) AS size_status FROM decisions""",
    ),
    "c08_oriented_size": with_tables(
        "decisions",
        """SELECT req_id, CASE WHEN orientation < 5 THEN img_w ELSE img_h END AS shown_w,
  CASE WHEN orientation < 5 THEN img_h ELSE img_w END AS shown_h FROM decisions""",
    ),
    "c09_small_avif_fallback": _f(
        """CASE WHEN out_format = 'avif' AND (result_w < 16 OR result_h < 16) THEN CASE WHEN has_alpha THEN 'png' ELSE 'jpeg' END
  ELSE out_format END AS saved_format"""
    ),
    "c10_resolve_quality": _f(
        """CAST(CASE WHEN quality > 0 THEN quality WHEN req_id % 5 = 0 AND out_format = 'webp' THEN 50
  WHEN req_id % 5 = 0 AND out_format = 'avif' THEN 40 WHEN req_id % 5 = 1 AND out_format = 'jpeg' THEN 33
  WHEN out_format = 'webp' THEN 79 WHEN out_format = 'avif' THEN 63 WHEN out_format = 'jxl' THEN 77 ELSE 80 END AS BIGINT) AS out_quality"""
    ),
    "c11_fit_max_bytes": with_tables(
        "fit_renditions encodings",
        f"""{_TYPES},
walk(req_id, image_id, format, max_bytes, q, n, bytes) AS (
  SELECT r.req_id, r.image_id, r.format, r.max_bytes, CAST(start_quality AS BIGINT), CAST(1 AS BIGINT), e.bytes FROM fit_renditions r
    LEFT JOIN encodings e ON e.image_id = r.image_id AND e.format = r.format AND e.quality = r.start_quality
  UNION ALL
  SELECT w.req_id, w.image_id, w.format, w.max_bytes, w.nq, w.n + 1, e.bytes FROM (SELECT *, greatest(1, least(q - 1,
      CAST(round(CAST(q AS DOUBLE) * CASE WHEN CAST(bytes AS DOUBLE) / max_bytes > 3 THEN 0.25e0
        WHEN CAST(bytes AS DOUBLE) / max_bytes > 1.5e0 THEN 0.5e0 ELSE 0.75e0 END) AS BIGINT))) AS nq
    FROM walk WHERE max_bytes > 0 AND bytes > max_bytes AND q > 10) w
  JOIN encodings e ON e.image_id = w.image_id AND e.format = w.format AND e.quality = w.nq),
en AS (SELECT req_id, arg_max(q, n) AS final_quality, max(n) AS attempts, max(n) FILTER (WHERE bytes IS NOT NULL) AS got, arg_max(bytes, n) AS b, any_value(max_bytes) AS mb, any_value(format) AS f FROM walk GROUP BY req_id)
SELECT req_id, final_quality, attempts, CASE WHEN got = attempts THEN b END AS final_bytes,
  CASE WHEN coalesce(mb, 0) <= 0 OR f NOT IN (SELECT format FROM types WHERE quality) THEN 'not_asked' WHEN got IS NULL OR got < attempts THEN 'unmeasured' WHEN b <= mb THEN 'fits' ELSE 'over' END AS fit_status FROM en""",
    ),
    "c12_palette_depth": with_tables(
        "decisions",
        """p AS (SELECT req_id, quantize, quantize_colors AS qc, CASE WHEN palette THEN coalesce(palette_bits, 8) ELSE 0 END AS b FROM decisions)
SELECT req_id, CAST(CASE WHEN req_id % 3 = 0 THEN CASE WHEN b <= 0 OR b > 8 THEN 8 ELSE b END
  WHEN quantize THEN CASE WHEN qc > 16 THEN 8 WHEN qc > 4 THEN 4 WHEN qc > 2 THEN 2 ELSE 1 END
  WHEN b = 0 OR b > 8 THEN NULL WHEN b > 4 THEN 8 WHEN b > 2 THEN 4 ELSE b END AS BIGINT) AS bit_depth FROM p""",
    ),
    "c13_target_colourspace": _f(
        """CASE WHEN interpretation IN ('rgb', 'srgb', 'b-w') OR (interpretation IN ('rgb16', 'grey16') AND coalesce(hdr, false) AND preserve_hdr)
    THEN interpretation WHEN interpretation = 'grey16' THEN 'b-w' WHEN interpretation IN ('rgb16', 'cmyk') THEN 'srgb'
    WHEN coalesce(hdr, false) AND preserve_hdr THEN 'rgb16' ELSE 'srgb' END AS colourspace"""
    ),
    "c14_profile_policy": _f(
        """CASE (CASE WHEN NOT strip_color_profile AND coalesce(icc, false) THEN 2 ELSE 0 END)
    + (CASE WHEN has_profile AND interpretation IN ('cmyk', 'lab', 'xyz') THEN 1 ELSE 0 END)
  WHEN 3 THEN 'export' WHEN 2 THEN 'leave' WHEN 1 THEN 'remove' ELSE 'transform' END AS profile_action"""
    ),
    "c15_flatten_needed": _f(
        "background IS NOT NULL OR NOT coalesce(alpha, false) AS flatten, coalesce(background, 'ffffff') AS flatten_colour"
    ),
}
