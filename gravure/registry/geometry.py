"""Queries D: the geometry planner over every typed plan, with its SQL check."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.plans import geometry as g
from gravure.registry.fixtures import table, with_tables

_STEPS = (
    g.exif_angle_flip, g.source_size, g.crop_size, g.resize_scale, g.zoom_dpr_enlarge, g.min_size, g.final_scale,
    g.target_sizes, g.fill_down_crop, g.extend_ar_size, g.limit_result,
)


def _upto(df, last):
    for step in _STEPS:
        df = step(df)
        if step is last:
            return df
    raise ValueError(last)


def _planned(spark, sf):
    return g.plan_geometry(table(spark, sf, "geo"))


def _with_crop(df):
    return g.crop_gravity(g.crop_gravity_default(df))


def _step(last, *cols):
    return lambda spark, sf: _upto(table(spark, sf, "geo"), last).select("req_id", *cols)


def _guarded(spark, sf):
    return g.vector_guard(_planned(spark, sf), 100_000)


QUERIES = {
    "d01_exif_angle_flip": _step(g.exif_angle_flip, "angle", "flip"),
    "d02_source_size": _step(g.source_size, "src_w", "src_h"),
    "d03_crop_size": _step(g.crop_size, "crop_px_w", "crop_px_h", "base_w", "base_h"),
    "d04_resize_scale": _step(g.resize_scale, "w_shrink", "h_shrink"),
    "d05_zoom_dpr_enlarge": _step(g.zoom_dpr_enlarge, "w_shrink", "h_shrink", "dpr_scale"),
    "d06_min_size": _step(g.min_size, "w_shrink", "h_shrink"),
    "d07_final_scale": _step(g.final_scale, "w_scale", "h_scale"),
    "d08_target_sizes": _step(g.target_sizes, "target_w", "target_h", "scaled_w", "scaled_h"),
    "d09_fill_down_crop": _step(g.fill_down_crop, "result_crop_w", "result_crop_h"),
    "d10_extend_ar_size": _step(g.extend_ar_size, "ext_w", "ext_h"),
    "d11_limit_result": _step(
        g.limit_result, "w_scale", "h_scale", "dpr_scale", "scaled_w", "scaled_h", "result_crop_w", "result_crop_h",
        "ext_w", "ext_h",
    ),
    "d12_gravity_position": lambda spark, sf: table(spark, sf, "geo").select(
        "req_id",
        *[
            c.alias(f"{side}_{kind}")
            for kind, over in (("in", False), ("over", True))
            for side, c in zip(
                ("left", "top"),
                g.position(
                    F.col("img_w"), F.col("img_h"), F.col("img_w") - F.least(F.col("img_w") - 1, F.col("req_id") % 97),
                    F.col("img_h") - F.least(F.col("img_h") - 1, F.col("req_id") % 89), F.col("gravity_type"),
                    F.col("gravity_x"), F.col("gravity_y"), F.col("dpr"), over,
                ),
            )
        ],
    ),
    "d13_gravity_transpose": lambda spark, sf: g.transpose_gravity(
        table(spark, sf, "geo"), "gravity_type", "gravity_x", "gravity_y", F.col("rotate"), F.col("flip_h"),
        F.col("flip_v"),
    ).select("req_id", "gravity_type", "gravity_x", "gravity_y"),
    "d14_crop_gravity_default": lambda spark, sf: g.crop_gravity_default(table(spark, sf, "geo")).select(
        "req_id", "crop_type", "crop_x", "crop_y"
    ),
    "d15_crop_box": lambda spark, sf: g.crop_box(_with_crop(_planned(spark, sf))).select(
        "req_id", "crop_kind", "crop_left", "crop_top", "crop_box_w", "crop_box_h"
    ),
    "d16_result_crop_box": lambda spark, sf: g.result_crop_box(_planned(spark, sf)).select(
        "req_id", "box_kind", "box_left", "box_top", "box_w", "box_h"
    ),
    "d17_extend_box": lambda spark, sf: g.extend_ar_box(g.extend_box(g.result_crop_box(_planned(spark, sf)))).select(
        "req_id", "canvas_w", "canvas_h", "canvas_left", "canvas_top", "aspect_w", "aspect_h", "aspect_left",
        "aspect_top",
    ),
    "d18_padding_box": lambda spark, sf: g.result_size(_planned(spark, sf)).select(
        "req_id", "padded_w", "padded_h", "padded_left", "padded_top"
    ),
    "d19_format_size_limits": lambda spark, sf: table(spark, sf, "images")
    .select(
        "image_id",
        "format",
        g.limit_scale(F.col("format"), F.col("width") * 50, F.col("height") * 70).alias("limit_scale"),
    ),
    "d20_vector_guard": lambda spark, sf: g.vector_guard(table(spark, sf, "geo"), 100_000).select(
        "req_id", "base_shrink"
    ),
    "d20_guarded_result": lambda spark, sf: g.result_size(
        g.plan_geometry(g.guarded_size(table(spark, sf, "geo"), 100_000))
    ).select("req_id", "img_w", "img_h", "result_w", "result_h"),
    "d21_preshrink": lambda spark, sf: g.preshrink(_with_crop(_guarded(spark, sf))).select(
        "req_id", "preshrink", "level_w", "level_h", "rest_w_scale", "rest_h_scale", "level_crop_w", "level_crop_h",
        "level_crop_x", "level_crop_y",
    ),
    "d22_watermark_layout": lambda spark, sf: g.watermark_layout(g.result_size(_planned(spark, sf)), 60, 40).select(
        "req_id", "wm_left", "wm_top", "mark_w", "mark_h", "tile_w", "tile_h", "tile_left", "tile_top", "wm_visible",
        "mark_crop_top", "mark_crop_h",
    ),
    "d23_result_size": lambda spark, sf: g.result_size(_planned(spark, sf)).select("req_id", "result_w", "result_h"),
    "d24_frame_boxes": lambda spark, sf: g.frame_boxes(
        table(spark, sf, "images").selectExpr(
            "image_id",
            "height",
            "frames",
            "CASE WHEN image_id % 2 = 0 THEN transform(sequence(1, frames + 2), k -> 10 * k + image_id % 5) END AS delays",
            "CASE WHEN image_id % 3 = 0 THEN image_id % 4 END AS loop",
        )
    ),
}

# --- SQL check: the same planner as one chain of CTEs -----------------------------------
_D = "CAST({} AS DOUBLE)"


def _scale(a, s):
    return f"CAST(round(CAST({a} AS DOUBLE) * ({s})) AS BIGINT)"


def _even(a, s):
    return f"CAST(round_even(CAST({a} AS DOUBLE) * ({s}), 0) AS BIGINT)"


def _mnz(a, b):
    return f"(CASE WHEN {a} = 0 THEN {b} WHEN {b} = 0 THEN {a} ELSE least({a}, {b}) END)"


def _sizes_sql(src, out):
    return f"""
{out}_a AS (SELECT * EXCLUDE (target_w, target_h, scaled_w, scaled_h),
  {_scale("width", "dpr_scale * zoom_w")} AS target_w, {_scale("height", "dpr_scale * zoom_h")} AS target_h,
  {_scale("base_w", "w_scale")} AS scaled_w, {_scale("base_h", "h_scale")} AS scaled_h FROM {src}),
{out}_b AS (SELECT *, CAST(target_w AS DOUBLE) / scaled_w AS dw, CAST(target_h AS DOUBLE) / scaled_h AS dh,
  resizing_type = 'fill-down' AND NOT enlarge AS fd FROM {out}_a),
{out}_c AS (SELECT * EXCLUDE (result_crop_w, result_crop_h, dw, dh, fd),
  CASE WHEN fd AND dw > dh AND dw > 1 THEN scaled_w
       WHEN fd AND dh > dw AND dh > 1 THEN {_scale("scaled_h", "CAST(target_w AS DOUBLE) / target_h")}
       ELSE target_w END AS result_crop_w,
  CASE WHEN fd AND dw > dh AND dw > 1 THEN {_scale("scaled_w", "CAST(target_h AS DOUBLE) / target_w")}
       WHEN fd AND dh > dw AND dh > 1 THEN scaled_h ELSE target_h END AS result_crop_h FROM {out}_b),
{out}_d AS (SELECT *, {_mnz("scaled_w", "result_crop_w")} AS ow, {_mnz("scaled_h", "result_crop_h")} AS oh FROM {out}_c),
{out}_e AS (SELECT *, CAST(target_w AS DOUBLE) / ow AS dw, CAST(target_h AS DOUBLE) / oh AS dh FROM {out}_d),
{out} AS (SELECT * EXCLUDE (ext_w, ext_h, ow, oh, dw, dh),
  CASE WHEN NOT extend_ar OR target_w <= 0 OR target_h <= 0 OR dw = dh THEN ext_w
       WHEN dh > dw THEN ow ELSE {_scale("oh", "CAST(target_w AS DOUBLE) / target_h")} END AS ext_w,
  CASE WHEN NOT extend_ar OR target_w <= 0 OR target_h <= 0 OR dw = dh THEN ext_h
       WHEN dh > dw THEN {_scale("ow", "CAST(target_h AS DOUBLE) / target_w")} ELSE oh END AS ext_h FROM {out}_e)"""


def _crop_px(c, s):
    return f"""CAST(CASE WHEN {c} = 0 THEN 0 WHEN {c} >= 1 THEN CAST(floor({c}) AS BIGINT)
  ELSE greatest(1, {_scale(s, c)}) END AS BIGINT)"""


def _pick(own):
    return f"""CASE WHEN ws0 = 1 AND hs0 = 1 THEN 1.0e0
  WHEN width = 0 AND rt <> 'force' THEN hs0 WHEN height = 0 AND rt <> 'force' THEN ws0
  WHEN rt = 'fit' THEN greatest(ws0, hs0) WHEN rt IN ('fill', 'fill-down') THEN least(ws0, hs0) ELSE {own} END"""


_PLAN_HEAD = f"""
d01 AS (SELECT *, CAST(CASE WHEN NOT auto_rotate THEN 0 ELSE list_extract([0, 0, 180, 180, 90, 90, 270, 270], orientation)
    END AS BIGINT) AS angle, auto_rotate AND orientation IN (2, 4, 5, 7) AS flip FROM geo),
d02 AS (SELECT *, CASE WHEN (angle + rotate) % 180 = 0 THEN img_w ELSE img_h END AS src_w,
    CASE WHEN (angle + rotate) % 180 = 0 THEN img_h ELSE img_w END AS src_h FROM d01),
d03a AS (SELECT *, {_crop_px("crop_w", "src_w")} AS crop_px_w, {_crop_px("crop_h", "src_h")} AS crop_px_h FROM d02),
d03 AS (SELECT *, {_mnz("crop_px_w", "src_w")} AS base_w, {_mnz("crop_px_h", "src_h")} AS base_h FROM d03a),
d04a AS (SELECT *, CASE WHEN width = 0 THEN base_w ELSE width END AS dw0,
    CASE WHEN height = 0 THEN base_h ELSE height END AS dh0 FROM d03),
d04b AS (SELECT *, CAST(base_w AS DOUBLE) / dw0 AS ws0, CAST(base_h AS DOUBLE) / dh0 AS hs0,
    CASE WHEN resizing_type <> 'auto' THEN resizing_type
         WHEN (base_w - base_h >= 0 AND dw0 - dh0 >= 0) OR (base_w - base_h < 0 AND dw0 - dh0 < 0) THEN 'fill'
         ELSE 'fit' END AS rt FROM d04a),
d04 AS (SELECT *, {_pick("ws0")} AS w4, {_pick("hs0")} AS h4 FROM d04b),
d05a AS (SELECT *, w4 / zoom_w AS w5a, h4 / zoom_h AS h5a, NOT enlarge AND src_format <> 'svg' AS hold FROM d04),
d05b AS (SELECT *, least(w5a, h5a) AS m5 FROM d05a),
d05c AS (SELECT *, CASE WHEN hold AND m5 < 1 THEN w5a / m5 ELSE w5a END AS w5,
    CASE WHEN hold AND m5 < 1 THEN h5a / m5 ELSE h5a END AS h5,
    CASE WHEN hold AND m5 < 1 AND NOT extend THEN dpr / m5 ELSE dpr END AS dpr5 FROM d05b),
d05 AS (SELECT *, CASE WHEN hold THEN least(dpr5, least(w5, h5)) ELSE dpr5 END AS dpr_scale FROM d05c),
d06a AS (SELECT *, min_width > 0 AND CAST(base_w AS DOUBLE) / nullif(min_width, 0) < w5 AS bw FROM d05),
d06b AS (SELECT *, CASE WHEN bw THEN h5 / (w5 / (CAST(base_w AS DOUBLE) / min_width)) ELSE h5 END AS h6a,
    CASE WHEN bw THEN CAST(base_w AS DOUBLE) / min_width ELSE w5 END AS w6a FROM d06a),
d06c AS (SELECT *, min_height > 0 AND CAST(base_h AS DOUBLE) / nullif(min_height, 0) < h6a AS bh FROM d06b),
d06 AS (SELECT *, CASE WHEN bh THEN w6a / (h6a / (CAST(base_h AS DOUBLE) / min_height)) ELSE w6a END AS w6,
    CASE WHEN bh THEN CAST(base_h AS DOUBLE) / min_height ELSE h6a END AS h6 FROM d06c),
d07 AS (SELECT *, 1.0e0 / least(w6 / dpr_scale, CAST(base_w AS DOUBLE)) AS w_scale,
    1.0e0 / least(h6 / dpr_scale, CAST(base_h AS DOUBLE)) AS h_scale,
    0 AS target_w, 0 AS target_h, 0 AS scaled_w, 0 AS scaled_h, 0 AS result_crop_w, 0 AS result_crop_h,
    CAST(0 AS BIGINT) AS ext_w, CAST(0 AS BIGINT) AS ext_h FROM d06),
{_sizes_sql("d07", "d10")},
d11a AS (SELECT *,
    CASE WHEN extend THEN greatest({_mnz("scaled_w", "result_crop_w")}, target_w)
         WHEN extend_ar THEN greatest({_mnz("scaled_w", "result_crop_w")}, ext_w)
         ELSE {_mnz("scaled_w", "result_crop_w")} END
      + {_even("pad_left", "dpr_scale")} + {_even("pad_right", "dpr_scale")} AS fw,
    CASE WHEN extend THEN greatest({_mnz("scaled_h", "result_crop_h")}, target_h)
         WHEN extend_ar THEN greatest({_mnz("scaled_h", "result_crop_h")}, ext_h)
         ELSE {_mnz("scaled_h", "result_crop_h")} END
      + {_even("pad_top", "dpr_scale")} + {_even("pad_bottom", "dpr_scale")} AS fh FROM d10),
d11b AS (SELECT *, max_dim > 0 AND greatest(fw, fh) > max_dim AS lim,
    CAST(max_dim AS DOUBLE) / greatest(fw, fh) AS f FROM d11a),
d11c AS (SELECT * REPLACE (
    CASE WHEN lim THEN greatest(w_scale * f, 1.0e0 / base_w) ELSE w_scale END AS w_scale,
    CASE WHEN lim THEN greatest(h_scale * f, 1.0e0 / base_h) ELSE h_scale END AS h_scale,
    CASE WHEN lim THEN dpr_scale * f ELSE dpr_scale END AS dpr_scale) FROM d11b),
{_sizes_sql("d11c", "d11")}
"""


def _pos(size, inner, off, kind, dpr, low, high, over):
    shift = f"(CASE WHEN abs({off}) >= 1 THEN CAST(round_even({off} * {dpr}, 0) AS BIGINT) ELSE {_even(size, off)} END)"
    lo, hi = (f"1 - {inner}", f"{size} - 1") if over else ("0", f"{size} - {inner}")
    ins = lambda names: ", ".join(f"'{n}'" for n in names)
    return f"""CAST(greatest({lo}, least({hi}, CASE
      WHEN {kind} = 'fp' THEN {_even(size, off)} - {inner} // 2
      WHEN {kind} IN ({ins(low)}) THEN {shift}
      WHEN {kind} IN ({ins(high)}) THEN {size} - {inner} - {shift}
      ELSE CAST(round_even(CAST({size} - {inner} + 1 AS DOUBLE) / 2, 0) AS BIGINT) + {shift} END)) AS BIGINT)"""


def _left(size, inner, off, kind, dpr, over=False):
    return _pos(size, inner, off, kind, dpr, ("we", "nowe", "sowe"), ("ea", "noea", "soea"), over)


def _top(size, inner, off, kind, dpr, over=False):
    return _pos(size, inner, off, kind, dpr, ("no", "nowe", "noea"), ("so", "sowe", "soea"), over)


# Turned and mirrored names as a lookup: (kind, flip x, flip y, quarter turns clockwise).
_LOOKUP = {
    "fx": {"ea": "we", "we": "ea", "nowe": "noea", "noea": "nowe", "sowe": "soea", "soea": "sowe"},
    "fy": {"no": "so", "so": "no", "nowe": "sowe", "noea": "soea", "sowe": "nowe", "soea": "noea"},
    "r90": {"no": "we", "ea": "no", "so": "ea", "we": "so", "nowe": "sowe", "noea": "nowe", "sowe": "soea",
            "soea": "noea"},
}


def _case_map(col, mapping):
    return f"CASE {col} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items()) + f" ELSE {col} END"


def _transpose_sql(src, out, t, x, y, angle, fx, fy):
    r90 = _LOOKUP["r90"]
    r180 = {k: r90[r90[k]] for k in r90}
    r270 = {k: r90[r180[k]] for k in r90}
    return f"""
{out}_a AS (SELECT * REPLACE (CASE WHEN {fx} THEN {_case_map(t, _LOOKUP["fx"])} ELSE {t} END AS {t},
    CASE WHEN NOT {fx} THEN {x} WHEN {t} IN ('ce', 'no', 'so') THEN -{x} WHEN {t} = 'fp' THEN 1.0e0 - {x} ELSE {x} END AS {x})
  FROM {src}),
{out}_b AS (SELECT * REPLACE (CASE WHEN {fy} THEN {_case_map(t, _LOOKUP["fy"])} ELSE {t} END AS {t},
    CASE WHEN NOT {fy} THEN {y} WHEN {t} IN ('ce', 'ea', 'we') THEN -{y} WHEN {t} = 'fp' THEN 1.0e0 - {y} ELSE {y} END AS {y})
  FROM {out}_a),
{out}_c AS (SELECT * REPLACE (CASE {angle} % 360 WHEN 90 THEN {_case_map(t, r90)} WHEN 180 THEN {_case_map(t, r180)}
    WHEN 270 THEN {_case_map(t, r270)} ELSE {t} END AS {t}) FROM {out}_b),
{out} AS (SELECT * REPLACE (
    CASE {angle} % 360 WHEN 90 THEN {y}
      WHEN 180 THEN CASE WHEN {t} IN ('ce', 'no', 'so') THEN -{x} WHEN {t} = 'fp' THEN 1.0e0 - {x} ELSE {x} END
      WHEN 270 THEN CASE WHEN {t} IN ('ce', 'no', 'so') THEN -{y} WHEN {t} = 'fp' THEN 1.0e0 - {y} ELSE {y} END
      ELSE {x} END AS {x},
    CASE {angle} % 360 WHEN 90 THEN CASE WHEN {t} IN ('ce', 'ea', 'we') THEN -{x} WHEN {t} = 'fp' THEN 1.0e0 - {x} ELSE {x} END
      WHEN 180 THEN CASE WHEN {t} IN ('ce', 'ea', 'we') THEN -{y} WHEN {t} = 'fp' THEN 1.0e0 - {y} ELSE {y} END
      WHEN 270 THEN {x} ELSE {y} END AS {y}) FROM {out}_c)"""


_D14 = """d14 AS (SELECT * REPLACE (
    CASE WHEN crop_type IS NULL THEN gravity_x ELSE crop_x END AS crop_x,
    CASE WHEN crop_type IS NULL THEN gravity_y ELSE crop_y END AS crop_y,
    coalesce(crop_type, gravity_type) AS crop_type) FROM {src})"""

_CROPPED = (
    _D14.format(src="d11")
    + ","
    + _transpose_sql("d14", "d14u", "crop_type", "crop_x", "crop_y", "rotate", "flip_h", "flip_v")
    + ","
    + _transpose_sql("d14u", "d14e", "crop_type", "crop_x", "crop_y", "angle", "flip", "false")
)

_BOXES = f"""
d16a AS (SELECT *, {_mnz("result_crop_w", "scaled_w")} AS bw0, {_mnz("result_crop_h", "scaled_h")} AS bh0 FROM d11),
d16b AS (SELECT *, CASE WHEN (result_crop_w = 0 AND result_crop_h = 0) OR (bw0 >= scaled_w AND bh0 >= scaled_h) THEN 'none'
    WHEN gravity_type = 'sm' THEN 'smart' ELSE 'box' END AS box_kind FROM d16a),
d16 AS (SELECT *, CASE WHEN box_kind = 'none' THEN scaled_w ELSE bw0 END AS box_w,
    CASE WHEN box_kind = 'none' THEN scaled_h ELSE bh0 END AS box_h,
    CAST(CASE WHEN box_kind = 'box' THEN {_left("scaled_w", "bw0", "gravity_x", "gravity_type", "dpr_scale")} ELSE 0 END
      AS BIGINT) AS box_left,
    CAST(CASE WHEN box_kind = 'box' THEN {_top("scaled_h", "bh0", "gravity_y", "gravity_type", "dpr_scale")} ELSE 0 END
      AS BIGINT) AS box_top FROM d16b),
d17a AS (SELECT *, extend AND (target_w > box_w OR target_h > box_h) AS on1 FROM d16),
d17b AS (SELECT *, CASE WHEN on1 AND target_w > 0 THEN target_w ELSE box_w END AS canvas_w,
    CASE WHEN on1 AND target_h > 0 THEN target_h ELSE box_h END AS canvas_h FROM d17a),
d17c AS (SELECT *,
    CASE WHEN on1 THEN {_left("canvas_w", "box_w", "extend_x", "extend_type", "dpr_scale")} ELSE 0 END AS canvas_left,
    CASE WHEN on1 THEN {_top("canvas_h", "box_h", "extend_y", "extend_type", "dpr_scale")} ELSE 0 END AS canvas_top,
    extend_ar AND ext_w <> 0 AND ext_h <> 0 AND (ext_w > canvas_w OR ext_h > canvas_h) AS on2 FROM d17b),
d17d AS (SELECT *, CASE WHEN on2 AND ext_w > 0 THEN ext_w ELSE canvas_w END AS aspect_w,
    CASE WHEN on2 AND ext_h > 0 THEN ext_h ELSE canvas_h END AS aspect_h FROM d17c),
d17 AS (SELECT *,
    CASE WHEN on2 THEN {_left("aspect_w", "canvas_w", "extend_ar_x", "extend_ar_type", "dpr_scale")} ELSE 0 END AS aspect_left,
    CASE WHEN on2 THEN {_top("aspect_h", "canvas_h", "extend_ar_y", "extend_ar_type", "dpr_scale")} ELSE 0 END AS aspect_top
  FROM d17d),
d18 AS (SELECT *, aspect_w + {_even("pad_left", "dpr_scale")} + {_even("pad_right", "dpr_scale")} AS padded_w,
    aspect_h + {_even("pad_top", "dpr_scale")} + {_even("pad_bottom", "dpr_scale")} AS padded_h,
    {_even("pad_left", "dpr_scale")} AS padded_left, {_even("pad_top", "dpr_scale")} AS padded_top FROM d17)
"""


def _limit_sql(fmt, w, h):
    return f"""CASE WHEN {fmt} = 'webp' AND greatest({w}, {h}) / 16383.0e0 > 1 THEN 1.0e0 / (greatest({w}, {h}) / 16383.0e0)
  WHEN {fmt} IN ('avif', 'heic') AND greatest({w}, {h}) / 16384.0e0 > 1 THEN 1.0e0 / (greatest({w}, {h}) / 16384.0e0)
  WHEN {fmt} = 'ico' AND greatest({w}, {h}) / 256.0e0 > 1 THEN 1.0e0 / (greatest({w}, {h}) / 256.0e0)
  WHEN {fmt} = 'gif' AND greatest({w} * {h} / 2147483647.0e0, greatest({w}, {h}) / 65535.0e0) > 1
    THEN sqrt(1.0e0 / greatest({w} * {h} / 2147483647.0e0, greatest({w}, {h}) / 65535.0e0))
  ELSE 1.0e0 END"""


def _geo(body, *parts):
    return with_tables("geo", ",\n".join([p.strip().rstrip(",") for p in parts]) + "\n" + body)


def _plan(cols, frm):
    return _geo(f"SELECT req_id, {cols} FROM {frm}", _PLAN_HEAD)


RESULT_CTES = ",\n".join([_PLAN_HEAD.strip(), _BOXES.strip()])
RESULT_SQL = f"""SELECT req_id,
  CAST(CASE WHEN ls < 1 THEN greatest(1, {_scale("padded_w", "ls")}) ELSE padded_w END AS BIGINT) AS result_w,
  CAST(CASE WHEN ls < 1 THEN greatest(1, {_scale("padded_h", "ls")}) ELSE padded_h END AS BIGINT) AS result_h
FROM (SELECT *, {_limit_sql("format", "padded_w", "padded_h")} AS ls FROM d18)"""

_INNER_W = "(img_w - least(img_w - 1, req_id % 97))"
_INNER_H = "(img_h - least(img_h - 1, req_id % 89))"
_AREA = "CAST(img_w * img_h AS DOUBLE)"

ORACLES = {
    "d01_exif_angle_flip": _plan("angle, flip", "d01"),
    "d02_source_size": _plan("src_w, src_h", "d02"),
    "d03_crop_size": _plan("crop_px_w, crop_px_h, base_w, base_h", "d03"),
    "d04_resize_scale": _plan("w4 AS w_shrink, h4 AS h_shrink", "d04"),
    "d05_zoom_dpr_enlarge": _plan("w5 AS w_shrink, h5 AS h_shrink, dpr_scale", "d05"),
    "d06_min_size": _plan("w6 AS w_shrink, h6 AS h_shrink", "d06"),
    "d07_final_scale": _plan("w_scale, h_scale", "d07"),
    "d08_target_sizes": _plan("target_w, target_h, scaled_w, scaled_h", "d10"),
    "d09_fill_down_crop": _plan("result_crop_w, result_crop_h", "d10"),
    "d10_extend_ar_size": _plan("ext_w, ext_h", "d10"),
    "d11_limit_result": _plan(
        "w_scale, h_scale, dpr_scale, scaled_w, scaled_h, result_crop_w, result_crop_h, ext_w, ext_h", "d11"
    ),
    "d12_gravity_position": with_tables(
        "geo",
        f"""SELECT req_id,
  {_left("img_w", _INNER_W, "gravity_x", "gravity_type", "dpr")} AS left_in,
  {_top("img_h", _INNER_H, "gravity_y", "gravity_type", "dpr")} AS top_in,
  {_left("img_w", _INNER_W, "gravity_x", "gravity_type", "dpr", True)} AS left_over,
  {_top("img_h", _INNER_H, "gravity_y", "gravity_type", "dpr", True)} AS top_over FROM geo""",
    ),
    "d13_gravity_transpose": _geo(
        "SELECT req_id, gravity_type, gravity_x, gravity_y FROM t13",
        _transpose_sql("geo", "t13", "gravity_type", "gravity_x", "gravity_y", "rotate", "flip_h", "flip_v"),
    ),
    "d14_crop_gravity_default": _geo("SELECT req_id, crop_type, crop_x, crop_y FROM d14", _D14.format(src="geo")),
    "d15_crop_box": _geo(
        f"""SELECT req_id, crop_kind,
  CAST(CASE WHEN crop_kind = 'box' THEN {_left("img_w", "cw", "crop_x", "crop_type", "1.0e0")} ELSE 0 END AS BIGINT) AS crop_left,
  CAST(CASE WHEN crop_kind = 'box' THEN {_top("img_h", "ch", "crop_y", "crop_type", "1.0e0")} ELSE 0 END AS BIGINT) AS crop_top,
  CASE WHEN crop_kind = 'none' THEN img_w ELSE cw END AS crop_box_w,
  CASE WHEN crop_kind = 'none' THEN img_h ELSE ch END AS crop_box_h FROM d15b""",
        _PLAN_HEAD,
        _CROPPED,
        f"""d15s AS (SELECT *, CASE WHEN (angle + rotate) % 180 = 90 THEN crop_px_h ELSE crop_px_w END AS qw,
    CASE WHEN (angle + rotate) % 180 = 90 THEN crop_px_w ELSE crop_px_h END AS qh FROM d14e),
d15a AS (SELECT *, {_mnz("qw", "img_w")} AS cw, {_mnz("qh", "img_h")} AS ch FROM d15s),
d15b AS (SELECT *, CASE WHEN (qw = 0 AND qh = 0) OR (cw >= img_w AND ch >= img_h) THEN 'none'
    WHEN crop_type = 'sm' THEN 'smart' ELSE 'box' END AS crop_kind FROM d15a)""",
    ),
    "d16_result_crop_box": _geo(
        "SELECT req_id, box_kind, box_left, box_top, box_w, box_h FROM d16", _PLAN_HEAD, _BOXES
    ),
    "d17_extend_box": _geo(
        """SELECT req_id, canvas_w, canvas_h, CAST(canvas_left AS BIGINT) AS canvas_left, CAST(canvas_top AS BIGINT) AS canvas_top,
  aspect_w, aspect_h, CAST(aspect_left AS BIGINT) AS aspect_left, CAST(aspect_top AS BIGINT) AS aspect_top FROM d17""",
        _PLAN_HEAD,
        _BOXES,
    ),
    "d18_padding_box": _geo("SELECT req_id, padded_w, padded_h, padded_left, padded_top FROM d18", _PLAN_HEAD, _BOXES),
    "d19_format_size_limits": with_tables(
        "images",
        f"""SELECT image_id, format, {_limit_sql("format", "w", "h")} AS limit_scale
FROM (SELECT image_id, format, CAST(width * 50 AS DOUBLE) AS w, CAST(height * 70 AS DOUBLE) AS h FROM images)""",
    ),
    "d20_vector_guard": with_tables(
        "geo",
        f"""SELECT req_id, CASE WHEN src_format = 'svg' AND img_w * img_h > 100000 THEN sqrt({_AREA} / 100000.0e0)
  ELSE 1.0e0 END AS base_shrink FROM geo""",
    ),
    "d20_guarded_result": _geo(
        RESULT_SQL.replace("SELECT req_id,", "SELECT req_id, img_w, img_h,", 1),
        f"""geo_g AS (SELECT * REPLACE (
    CASE WHEN src_format = 'svg' AND img_w * img_h > 100000 THEN CAST(ceil(img_w / sqrt({_AREA} / 100000.0e0)) AS BIGINT) ELSE img_w END AS img_w,
    CASE WHEN src_format = 'svg' AND img_w * img_h > 100000 THEN CAST(ceil(img_h / sqrt({_AREA} / 100000.0e0)) AS BIGINT) ELSE img_h END AS img_h) FROM geo)""",
        RESULT_CTES.replace("FROM geo)", "FROM geo_g)"),
    ),
    "d21_preshrink": _geo(
        f"""SELECT req_id, pre AS preshrink, level_w, level_h,
  CASE WHEN pre = 1 THEN w_scale WHEN level_w = {_scale("level_w", "w_scale * gw")} THEN 1.0e0 ELSE w_scale * gw END AS rest_w_scale,
  CASE WHEN pre = 1 THEN h_scale WHEN level_h = {_scale("level_h", "h_scale * gh")} THEN 1.0e0 ELSE h_scale * gh END AS rest_h_scale,
  CASE WHEN pre <> 1 AND crop_px_w > 0 THEN greatest(1, CAST(round(CAST(crop_px_w AS DOUBLE) / gw) AS BIGINT)) ELSE crop_px_w END AS level_crop_w,
  CASE WHEN pre <> 1 AND crop_px_h > 0 THEN greatest(1, CAST(round(CAST(crop_px_h AS DOUBLE) / gh) AS BIGINT)) ELSE crop_px_h END AS level_crop_h,
  CASE WHEN pre <> 1 AND crop_type <> 'fp' AND abs(crop_x) >= 1 THEN round_even(crop_x / gw, 0) ELSE crop_x END AS level_crop_x,
  CASE WHEN pre <> 1 AND crop_type <> 'fp' AND abs(crop_y) >= 1 THEN round_even(crop_y / gh, 0) ELSE crop_y END AS level_crop_y
FROM d21d""",
        _PLAN_HEAD,
        _CROPPED,
        f"""d21a AS (SELECT *, least(CAST(src_w AS DOUBLE) / nullif({_scale("src_w", "w_scale")}, 0),
      CAST(src_h AS DOUBLE) / nullif({_scale("src_h", "h_scale")}, 0))
    * CASE WHEN src_format = 'svg' AND img_w * img_h > 100000 THEN sqrt({_AREA} / 100000.0e0) ELSE 1.0e0 END AS want FROM d14e),
d21b AS (SELECT *, CASE WHEN src_format = 'svg' THEN want WHEN want <= 1 THEN 1.0e0 WHEN src_format = 'webp' THEN want
    WHEN src_format <> 'jpeg' THEN 1.0e0 WHEN want >= 8 THEN 8.0e0 WHEN want >= 4 THEN 4.0e0 WHEN want >= 2 THEN 2.0e0
    ELSE 1.0e0 END AS pre FROM d21a),
d21c AS (SELECT *, CAST(ceil(src_w / pre) AS BIGINT) AS level_w, CAST(ceil(src_h / pre) AS BIGINT) AS level_h FROM d21b),
d21d AS (SELECT *, CAST(src_w AS DOUBLE) / level_w AS gw, CAST(src_h AS DOUBLE) / level_h AS gh FROM d21c)""",
    ),
    "d22_watermark_layout": _geo(
        """SELECT req_id, wm_left, wm_top, mark_w, mark_h, mark_w + gap_x AS tile_w, mark_h + gap_y AS tile_h,
  CAST(trunc(gap_x / 2) AS BIGINT) AS tile_left, CAST(trunc(gap_y / 2) AS BIGINT) AS tile_top,
  wm_opacity > 0 AND (rep OR (wm_left < padded_w AND wm_top < padded_h AND -wm_left < mark_w AND -wm_top < mark_h)) AS wm_visible,
  CAST(CASE WHEN frames > 1 AND NOT rep THEN greatest(0, -wm_top) ELSE 0 END AS BIGINT) AS mark_crop_top,
  CAST(CASE WHEN frames > 1 AND NOT rep THEN least(mark_h - greatest(0, -wm_top), padded_h - greatest(0, wm_top))
    ELSE mark_h END AS BIGINT) AS mark_crop_h FROM d22c""",
        _PLAN_HEAD,
        _BOXES,
        f"""d22a AS (SELECT *, wm_position = 're' AS rep, CASE WHEN wm_scale > 0 THEN
      greatest(60.0e0 / greatest(1, {_even("padded_w", "wm_scale")}), 40.0e0 / greatest(1, {_even("padded_h", "wm_scale")}))
      ELSE 1.0e0 END AS sh FROM d18),
d22b AS (SELECT *, {_scale("60", "1.0e0 / least(sh, 60.0e0)")} AS mark_w, {_scale("40", "1.0e0 / least(sh, 40.0e0)")} AS mark_h,
    CASE WHEN NOT rep THEN 0 WHEN abs(wm_x) >= 1 THEN CAST(round_even(wm_x * dpr_scale, 0) AS BIGINT)
      ELSE {_even("padded_w", "wm_x")} END AS gap_x,
    CASE WHEN NOT rep THEN 0 WHEN abs(wm_y) >= 1 THEN CAST(round_even(wm_y * dpr_scale, 0) AS BIGINT)
      ELSE {_even("padded_h", "wm_y")} END AS gap_y FROM d22a),
d22c AS (SELECT *, CASE WHEN rep THEN 0 ELSE {_left("padded_w", "mark_w", "wm_x", "wm_position", "dpr_scale", True)} END AS wm_left,
    CASE WHEN rep THEN 0 ELSE {_top("padded_h", "mark_h", "wm_y", "wm_position", "dpr_scale", True)} END AS wm_top FROM d22b)""",
    ),
    "d23_result_size": _geo(RESULT_SQL, RESULT_CTES),
    "d24_frame_boxes": with_tables(
        "images",
        """SELECT image_id, f AS frame, f * height AS top, height AS frame_h,
  CASE WHEN image_id % 2 = 0 THEN 10 * (f + 1) + image_id % 5 ELSE 40 END AS delay,
  CASE WHEN image_id % 3 = 0 THEN image_id % 4 ELSE 0 END AS loop, frames AS pages
FROM (SELECT *, unnest(range(0, frames)) AS f FROM images)""",
    ),
}
