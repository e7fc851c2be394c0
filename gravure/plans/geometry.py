"""Geometry of a rendition as columns: one row per request joined with its image facts.

Every function takes and returns a DataFrame and adds columns by projection alone, so
the whole planner is one narrow stage with no shuffle. Input columns are the plan
(width, height, resizing_type, dpr, ...) and the image facts (img_w, img_h,
orientation, frames, has_alpha, src_format).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravure.functions.rows import settle
from gravure.functions.numeric import dbl, half, min_non_zero, non_zero, scale, scale_even, shrink, shrink_even

# Longest side (or area) an encoder accepts.
WEBP_MAX_SIDE = 16383.0
HEIF_MAX_SIDE = 16384.0
GIF_MAX_SIDE = 65535.0
ICO_MAX_SIDE = 256.0
GIF_MAX_AREA = 2147483647.0


def _ratio(a, b) -> Column:
    """a / b as doubles; NULL for a zero divisor (only ever in a branch not taken)."""
    return dbl(a) / F.nullif(dbl(b), F.lit(0.0))


def exif_angle_flip(df: DataFrame) -> DataFrame:
    """Turn and mirror asked for by the stored orientation, when auto-rotation is on."""
    seen = F.col("orientation")
    angle = F.when(seen.isin(3, 4), 180).when(seen.isin(5, 6), 90).when(seen.isin(7, 8), 270).otherwise(0)
    return df.withColumns(
        {
            "angle": F.when(F.col("auto_rotate"), angle).otherwise(0).cast("bigint"),
            "flip": F.col("auto_rotate") & seen.isin(2, 4, 5, 7),
        }
    )


def source_size(df: DataFrame) -> DataFrame:
    """Size as seen after the stored and the requested rotation."""
    turned = (F.col("angle") + F.col("rotate")) % 180 != 0
    return df.withColumns(
        {
            "src_w": F.when(turned, F.col("img_h")).otherwise(F.col("img_w")),
            "src_h": F.when(turned, F.col("img_w")).otherwise(F.col("img_h")),
        }
    )


def crop_size(df: DataFrame) -> DataFrame:
    """Crop in pixels (fractions are of the source) and the size left to scale."""

    def pixels(crop: str, size: str) -> Column:
        c = F.col(crop)
        return (
            F.when(c == 0, F.lit(0))
            .when(c >= 1, c.cast("bigint"))
            .otherwise(F.greatest(F.lit(1), scale(size, c)))
            .cast("bigint")
        )

    sized = df.withColumns({"crop_px_w": pixels("crop_w", "src_w"), "crop_px_h": pixels("crop_h", "src_h")})
    return sized.withColumns(
        {
            "base_w": min_non_zero(F.col("crop_px_w"), F.col("src_w")),
            "base_h": min_non_zero(F.col("crop_px_h"), F.col("src_h")),
        }
    )


def resize_scale(df: DataFrame) -> DataFrame:
    """How much each axis shrinks to reach the requested size under the resizing type."""
    wanted = df.withColumns(
        {"dst_w": non_zero(F.col("width"), F.col("base_w")), "dst_h": non_zero(F.col("height"), F.col("base_h"))}
    ).withColumns({"axis_w": _ratio("base_w", "dst_w"), "axis_h": _ratio("base_h", "dst_h")})
    same_shape = (F.col("base_w") >= F.col("base_h")) == (F.col("dst_w") >= F.col("dst_h"))
    kind = F.when(
        F.col("resizing_type") == "auto", F.when(same_shape, F.lit("fill")).otherwise(F.lit("fit"))
    ).otherwise(F.col("resizing_type"))
    wanted = wanted.withColumn("resize_as", kind)
    w, h, kind = F.col("axis_w"), F.col("axis_h"), F.col("resize_as")
    free = kind != "force"

    def chosen(own: Column) -> Column:
        return (
            F.when((w == 1) & (h == 1), F.lit(1.0))
            .when((F.col("width") == 0) & free, h)
            .when((F.col("height") == 0) & free, w)
            .when(kind == "fit", F.greatest(w, h))
            .when(kind.isin("fill", "fill-down"), F.least(w, h))
            .otherwise(own)
        )

    return wanted.withColumns({"w_shrink": chosen(w), "h_shrink": chosen(h)}).drop(
        "dst_w", "dst_h", "axis_w", "axis_h", "resize_as"
    )


def zoom_dpr_enlarge(df: DataFrame) -> DataFrame:
    """Zoom, then hold back enlargement and the pixel ratio that would cause it."""
    zoomed = df.withColumns(
        {"w_shrink": F.col("w_shrink") / F.col("zoom_w"), "h_shrink": F.col("h_shrink") / F.col("zoom_h")}
    )
    held = zoomed.withColumns(
        {
            "held": ~F.col("enlarge") & (F.col("src_format") != "svg"),
            "least_shrink": F.least("w_shrink", "h_shrink"),
        }
    )
    too_small = F.col("held") & (F.col("least_shrink") < 1)
    by_least = lambda c: F.when(too_small, F.col(c) / F.col("least_shrink")).otherwise(F.col(c))
    held = held.withColumns(
        {
            "w_shrink": by_least("w_shrink"),
            "h_shrink": by_least("h_shrink"),
            "dpr_scale": F.when(too_small & ~F.col("extend"), F.col("dpr") / F.col("least_shrink")).otherwise(
                F.col("dpr")
            ),
        }
    )
    capped = F.least("dpr_scale", "w_shrink", "h_shrink")
    return held.withColumn("dpr_scale", F.when(F.col("held"), capped).otherwise(F.col("dpr_scale"))).drop(
        "held", "least_shrink"
    )


def min_size(df: DataFrame) -> DataFrame:
    """Lower bounds on the result: width first, then height, each dragging the other axis."""
    for minimum, base, own, other in (
        ("min_width", "base_w", "w_shrink", "h_shrink"),
        ("min_height", "base_h", "h_shrink", "w_shrink"),
    ):
        bound = _ratio(base, minimum)
        binds = (F.col(minimum) > 0) & (bound < F.col(own))
        df = df.withColumns(
            {
                other: F.when(binds, F.col(other) / (F.col(own) / bound)).otherwise(F.col(other)),
                own: F.when(binds, bound).otherwise(F.col(own)),
            }
        )
    return df


def final_scale(df: DataFrame) -> DataFrame:
    """Pixel ratio applied; never below one pixel per axis."""
    inverse = lambda c, base: F.lit(1.0) / F.least(F.col(c) / F.col("dpr_scale"), dbl(base))
    return df.withColumns({"w_scale": inverse("w_shrink", "base_w"), "h_scale": inverse("h_shrink", "base_h")})


def target_sizes(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "target_w": scale("width", F.col("dpr_scale") * F.col("zoom_w")),
            "target_h": scale("height", F.col("dpr_scale") * F.col("zoom_h")),
            "scaled_w": scale("base_w", "w_scale"),
            "scaled_h": scale("base_h", "h_scale"),
        }
    )


def fill_down_crop(df: DataFrame) -> DataFrame:
    """Crop of the scaled image; fill-down keeps the target ratio when the image is too small."""
    over_w, over_h = _ratio("target_w", "scaled_w"), _ratio("target_h", "scaled_h")
    down = (F.col("resizing_type") == "fill-down") & ~F.col("enlarge")
    wide = down & (over_w > over_h) & (over_w > 1)
    tall = down & (over_h > over_w) & (over_h > 1)
    return df.withColumns(
        {
            "result_crop_w": F.when(wide, F.col("scaled_w"))
            .when(tall, scale("scaled_h", _ratio("target_w", "target_h")))
            .otherwise(F.col("target_w")),
            "result_crop_h": F.when(wide, scale("scaled_w", _ratio("target_h", "target_w")))
            .when(tall, F.col("scaled_h"))
            .otherwise(F.col("target_h")),
        }
    )


def extend_ar_size(df: DataFrame) -> DataFrame:
    """Canvas with the target's ratio; a former value stays where the ratios already agree."""
    if "ext_w" not in df.columns:
        df = df.withColumns({"ext_w": F.lit(0).cast("bigint"), "ext_h": F.lit(0).cast("bigint")})
    df = df.withColumns(
        {
            "out_w": min_non_zero(F.col("scaled_w"), F.col("result_crop_w")),
            "out_h": min_non_zero(F.col("scaled_h"), F.col("result_crop_h")),
        }
    )
    on = F.col("extend_ar") & (F.col("target_w") > 0) & (F.col("target_h") > 0)
    lack_w, lack_h = _ratio("target_w", "out_w"), _ratio("target_h", "out_h")
    return df.withColumns(
        {
            "ext_w": F.when(on & (lack_h > lack_w), F.col("out_w"))
            .when(on & (lack_w > lack_h), scale("out_h", _ratio("target_w", "target_h")))
            .otherwise(F.col("ext_w")),
            "ext_h": F.when(on & (lack_h > lack_w), scale("out_w", _ratio("target_h", "target_w")))
            .when(on & (lack_w > lack_h), F.col("out_h"))
            .otherwise(F.col("ext_h")),
        }
    ).drop("out_w", "out_h")


def sizes(df: DataFrame) -> DataFrame:
    return extend_ar_size(fill_down_crop(target_sizes(df)))


def limit_result(df: DataFrame) -> DataFrame:
    """Scale down where the result, canvas and padding included, passes the size limit."""
    grown = lambda size, canvas, aspect: (
        F.when(F.col("extend"), F.greatest(size, F.col(canvas)))
        .when(F.col("extend_ar"), F.greatest(size, F.col(aspect)))
        .otherwise(size)
    )
    pad = lambda side: scale_even(side, "dpr_scale")
    df = df.withColumns(
        {
            "full_w": grown(min_non_zero(F.col("scaled_w"), F.col("result_crop_w")), "target_w", "ext_w")
            + pad("pad_left")
            + pad("pad_right"),
            "full_h": grown(min_non_zero(F.col("scaled_h"), F.col("result_crop_h")), "target_h", "ext_h")
            + pad("pad_top")
            + pad("pad_bottom"),
        }
    )
    longest = F.greatest("full_w", "full_h")
    df = df.withColumn(
        "limit_by",
        F.when((F.col("max_dim") > 0) & (longest > F.col("max_dim")), _ratio("max_dim", longest)).otherwise(
            F.lit(1.0)
        ),
    )
    lowered = lambda c, base: F.when(
        F.col("limit_by") < 1, F.greatest(F.col(c) * F.col("limit_by"), F.lit(1.0) / dbl(base))
    ).otherwise(F.col(c))
    df = df.withColumns(
        {
            "w_scale": lowered("w_scale", "base_w"),
            "h_scale": lowered("h_scale", "base_h"),
            "dpr_scale": F.col("dpr_scale") * F.col("limit_by"),
        }
    )
    return sizes(df).drop("full_w", "full_h", "limit_by")


def plan_geometry(df: DataFrame) -> DataFrame:
    """All sizes and scales of a request, from image facts to the limited result."""
    for step in (exif_angle_flip, source_size, crop_size, resize_scale, zoom_dpr_enlarge, min_size, final_scale):
        df = step(df)
    df = settle(df, "w_scale", "h_scale", "dpr_scale")
    df = limit_result(sizes(df))
    return settle(
        df, "w_scale", "h_scale", "dpr_scale", "target_w", "target_h", "scaled_w", "scaled_h", "result_crop_w",
        "result_crop_h", "ext_w", "ext_h",
    )


def position(
    width: Column, height: Column, inner_w: Column, inner_h: Column, kind: Column, x: Column, y: Column, dpr: Column,
    overflow: bool = False,
) -> tuple[Column, Column]:
    """Top-left corner of an inner box placed in an outer box by gravity and offsets."""

    def axis(size: Column, inner: Column, offset: Column, low: tuple[str, ...], high: tuple[str, ...]) -> Column:
        shift = F.when(F.abs(offset) >= 1, F.rint(offset * dpr).cast("bigint")).otherwise(scale_even(size, offset))
        placed = (
            F.when(kind == "fp", scale_even(size, offset) - half(inner))
            .when(kind.isin(*low), shift)
            .when(kind.isin(*high), size - inner - shift)
            .otherwise(shrink_even(size - inner + 1, 2) + shift)
        )
        first, last = (1 - inner, size - 1) if overflow else (F.lit(0).cast("bigint"), size - inner)
        return F.greatest(first, F.least(placed, last))

    return (
        axis(width, inner_w, x, ("we", "nowe", "sowe"), ("ea", "noea", "soea")),
        axis(height, inner_h, y, ("no", "nowe", "noea"), ("so", "sowe", "soea")),
    )


# Gravity as a compass vector: x grows to the east, y to the south.
_VECTORS = {
    "ce": (0, 0), "no": (0, -1), "ea": (1, 0), "so": (0, 1), "we": (-1, 0),
    "nowe": (-1, -1), "noea": (1, -1), "sowe": (-1, 1), "soea": (1, 1),
}


def _vector_part(kind: Column, part: int) -> Column:
    west = [k for k, v in _VECTORS.items() if v[part] < 0]
    east = [k for k, v in _VECTORS.items() if v[part] > 0]
    return F.when(kind.isin(*west), -1).when(kind.isin(*east), 1).otherwise(0)


def _vector_name(vx: Column, vy: Column) -> Column:
    names = {v: k for k, v in _VECTORS.items()}
    code = (vx + 1) * 3 + vy + 1
    return F.element_at(F.array(*[F.lit(names[(c // 3 - 1, c % 3 - 1)]) for c in range(9)]), code.cast("int") + 1)


def transpose_gravity(
    df: DataFrame, kind: str, x: str, y: str, angle: Column, flip_x: Column, flip_y: Column
) -> DataFrame:
    """Gravity re-expressed for the image before it is mirrored and turned.

    Mirroring negates a component of the compass vector, a quarter turn swaps them.
    """
    compass = F.col(kind).isin(*_VECTORS)
    turn = angle % 360
    df = df.withColumns(
        {
            "_vx": F.when(flip_x, -_vector_part(F.col(kind), 0)).otherwise(_vector_part(F.col(kind), 0)),
            "_vy": F.when(flip_y, -_vector_part(F.col(kind), 1)).otherwise(_vector_part(F.col(kind), 1)),
        }
    )
    point = F.col(kind) == "fp"
    mirrored = lambda c, v, on: (
        F.when(on & point, 1.0 - F.col(c)).when(on & compass & (F.col(v) == 0), -F.col(c)).otherwise(F.col(c))
    )
    df = df.withColumns({x: mirrored(x, "_vx", flip_x), y: mirrored(y, "_vy", flip_y)})
    vx, vy = F.col("_vx"), F.col("_vy")
    df = df.withColumns(
        {
            "_nx": F.when(turn == 90, vy).when(turn == 180, -vx).when(turn == 270, -vy).otherwise(vx),
            "_ny": F.when(turn == 90, -vx).when(turn == 180, -vy).when(turn == 270, vx).otherwise(vy),
        }
    )
    ox, oy, nx, ny = F.col(x), F.col(y), F.col("_nx"), F.col("_ny")
    return df.withColumns(
        {
            kind: F.when(compass, _vector_name(nx, ny)).otherwise(F.col(kind)),
            x: F.when(turn == 90, oy)
            .when(turn == 180, F.when(point, 1.0 - ox).when(compass & (nx == 0), -ox).otherwise(ox))
            .when(turn == 270, F.when(point, 1.0 - oy).when(compass & (nx == 0), -oy).otherwise(oy))
            .otherwise(ox),
            y: F.when(turn == 90, F.when(point, 1.0 - ox).when(compass & (ny == 0), -ox).otherwise(ox))
            .when(turn == 180, F.when(point, 1.0 - oy).when(compass & (ny == 0), -oy).otherwise(oy))
            .when(turn == 270, ox)
            .otherwise(oy),
        }
    ).drop("_vx", "_vy", "_nx", "_ny")


def crop_gravity_default(df: DataFrame) -> DataFrame:
    """Without a crop gravity of its own, a crop follows the general gravity."""
    own = F.col("crop_type").isNotNull()
    pick = lambda mine, general: F.when(own, F.col(mine)).otherwise(F.col(general))
    return df.withColumns(
        {
            "crop_x": pick("crop_x", "gravity_x"),
            "crop_y": pick("crop_y", "gravity_y"),
            "crop_type": F.coalesce("crop_type", "gravity_type"),
        }
    )


def crop_gravity(df: DataFrame) -> DataFrame:
    """Crop gravity on the stored image: undo the user's turn first, then the stored one."""
    place = ("crop_type", "crop_x", "crop_y")
    df = settle(transpose_gravity(df, *place, F.col("rotate"), F.col("flip_h"), F.col("flip_v")), *place)
    return settle(transpose_gravity(df, *place, F.col("angle"), F.col("flip"), F.lit(False)), *place)


def crop_box(df: DataFrame) -> DataFrame:
    """Crop on the stored image. crop_kind: none, smart or box."""
    turned = (F.col("angle") + F.col("rotate")) % 180 == 90
    w = F.when(turned, F.col("crop_px_h")).otherwise(F.col("crop_px_w"))
    h = F.when(turned, F.col("crop_px_w")).otherwise(F.col("crop_px_h"))
    df = df.withColumns(
        {
            "crop_asked": (w != 0) | (h != 0),
            "crop_box_w": min_non_zero(w, F.col("img_w")),
            "crop_box_h": min_non_zero(h, F.col("img_h")),
        }
    )
    whole = ~F.col("crop_asked") | (
        (F.col("crop_box_w") >= F.col("img_w")) & (F.col("crop_box_h") >= F.col("img_h"))
    )
    left, top = position(
        F.col("img_w"), F.col("img_h"), F.col("crop_box_w"), F.col("crop_box_h"), F.col("crop_type"),
        F.col("crop_x"), F.col("crop_y"), F.lit(1.0),
    )
    df = df.withColumn(
        "crop_kind", F.when(whole, "none").when(F.col("crop_type") == "sm", "smart").otherwise("box")
    )
    boxed = F.col("crop_kind") == "box"
    return df.withColumns(
        {
            "crop_left": F.when(boxed, left).otherwise(0).cast("bigint"),
            "crop_top": F.when(boxed, top).otherwise(0).cast("bigint"),
            "crop_box_w": F.when(F.col("crop_kind") == "none", F.col("img_w")).otherwise(F.col("crop_box_w")),
            "crop_box_h": F.when(F.col("crop_kind") == "none", F.col("img_h")).otherwise(F.col("crop_box_h")),
        }
    ).drop("crop_asked")


def result_crop_box(df: DataFrame) -> DataFrame:
    """Crop of the scaled and turned image to the result size, by the general gravity."""
    w, h = F.col("result_crop_w"), F.col("result_crop_h")
    df = df.withColumns(
        {"box_w": min_non_zero(w, F.col("scaled_w")), "box_h": min_non_zero(h, F.col("scaled_h"))}
    )
    none = ((w == 0) & (h == 0)) | ((F.col("box_w") >= F.col("scaled_w")) & (F.col("box_h") >= F.col("scaled_h")))
    left, top = position(
        F.col("scaled_w"), F.col("scaled_h"), F.col("box_w"), F.col("box_h"), F.col("gravity_type"),
        F.col("gravity_x"), F.col("gravity_y"), F.col("dpr_scale"),
    )
    kind = F.when(none, "none").when(F.col("gravity_type") == "sm", "smart").otherwise("box")
    df = df.withColumn("box_kind", kind)
    boxed = F.col("box_kind") == "box"
    return df.withColumns(
        {
            "box_left": F.when(boxed, left).otherwise(0).cast("bigint"),
            "box_top": F.when(boxed, top).otherwise(0).cast("bigint"),
            "box_w": F.when(F.col("box_kind") == "none", F.col("scaled_w")).otherwise(F.col("box_w")),
            "box_h": F.when(F.col("box_kind") == "none", F.col("scaled_h")).otherwise(F.col("box_h")),
        }
    )


def canvas_box(
    df: DataFrame, name: str, on: Column, want_w: Column, want_h: Column, size_w: str, size_h: str, gravity: str
) -> DataFrame:
    """A canvas larger than the image, with the image placed on it by gravity."""
    w, h = F.col(size_w), F.col(size_h)
    grows = on & ((want_w > w) | (want_h > h))
    df = df.withColumns(
        {
            f"{name}_w": F.when(grows & (want_w > 0), want_w).otherwise(w),
            f"{name}_h": F.when(grows & (want_h > 0), want_h).otherwise(h),
            f"{name}_on": grows,
        }
    )
    left, top = position(
        F.col(f"{name}_w"), F.col(f"{name}_h"), w, h, F.col(f"{gravity}_type"), F.col(f"{gravity}_x"),
        F.col(f"{gravity}_y"), F.col("dpr_scale"),
    )
    placed = F.col(f"{name}_on")
    return df.withColumns(
        {
            f"{name}_left": F.when(placed, left).otherwise(0).cast("bigint"),
            f"{name}_top": F.when(placed, top).otherwise(0).cast("bigint"),
        }
    ).drop(f"{name}_on")


def extend_box(df: DataFrame) -> DataFrame:
    """Canvas of the target size (after result_crop_box)."""
    return canvas_box(
        df, "canvas", F.col("extend"), F.col("target_w"), F.col("target_h"), "box_w", "box_h", "extend"
    )


def extend_ar_box(df: DataFrame) -> DataFrame:
    """Canvas of the target ratio (after extend_box)."""
    on = F.col("extend_ar") & (F.col("ext_w") != 0) & (F.col("ext_h") != 0)
    return canvas_box(df, "aspect", on, F.col("ext_w"), F.col("ext_h"), "canvas_w", "canvas_h", "extend_ar")


def padding_box(df: DataFrame) -> DataFrame:
    """Padded canvas (after extend_ar_box)."""
    pad = lambda side: scale_even(f"pad_{side}", "dpr_scale")
    return df.withColumns(
        {
            "padded_w": F.col("aspect_w") + pad("left") + pad("right"),
            "padded_h": F.col("aspect_h") + pad("top") + pad("bottom"),
            "padded_left": pad("left"),
            "padded_top": pad("top"),
        }
    )


def limit_scale(fmt: Column, w: Column, h: Column) -> Column:
    """Extra scale that brings a size within what the target encoder accepts."""
    side = dbl(F.greatest(w, h))
    gif = F.greatest(dbl(w) * dbl(h) / F.lit(GIF_MAX_AREA), side / F.lit(GIF_MAX_SIDE))
    inverse = lambda limit: F.when(side > limit, F.lit(1.0) / (side / F.lit(limit)))
    return F.coalesce(
        F.when(fmt == "webp", inverse(WEBP_MAX_SIDE))
        .when(fmt.isin("avif", "heic"), inverse(HEIF_MAX_SIDE))
        .when(fmt == "ico", inverse(ICO_MAX_SIDE))
        .when((fmt == "gif") & (gif > 1), F.sqrt(F.lit(1.0) / gif)),
        F.lit(1.0),
    )


def result_size(df: DataFrame) -> DataFrame:
    """Size of the finished rendition: planned geometry through boxes, padding and limits."""
    df = extend_ar_box(extend_box(result_crop_box(df)))
    df = settle(df, "box_w", "box_h", "aspect_w", "aspect_h")
    df = settle(padding_box(df), "padded_w", "padded_h")
    df = df.withColumn("limit_scale", limit_scale(F.col("format"), F.col("padded_w"), F.col("padded_h")))
    fitted = lambda c: F.when(F.col("limit_scale") < 1, F.greatest(F.lit(1), scale(c, "limit_scale"))).otherwise(
        F.col(c)
    )
    return df.withColumns(
        {"result_w": fitted("padded_w").cast("bigint"), "result_h": fitted("padded_h").cast("bigint")}
    )


def plan_rendition(df: DataFrame, mark_w: int | None = None, mark_h: int | None = None) -> DataFrame:
    """Every size and box from image facts to the finished rendition, and the watermark's place where its size is given."""
    df = crop_box(crop_gravity(crop_gravity_default(plan_geometry(df))))
    df = result_size(settle(df, "crop_kind", "crop_left", "crop_top", "crop_box_w", "crop_box_h"))
    return df if mark_w is None else watermark_layout(df, mark_w, mark_h)


def vector_guard(df: DataFrame, max_resolution: int) -> DataFrame:
    """Load shrink for vector sources with more pixels than allowed."""
    area = F.col("img_w") * F.col("img_h")
    over = (F.col("src_format") == "svg") & (area > max_resolution)
    return df.withColumn(
        "base_shrink", F.when(over, F.sqrt(dbl(area) / F.lit(float(max_resolution)))).otherwise(F.lit(1.0))
    )


def guarded_size(df: DataFrame, max_resolution: int) -> DataFrame:
    """Image facts as the guard leaves them: a vector source beyond the limit is loaded, and planned, at its shrunk size.

    Goes before the planner; base_shrink is kept for the level to read.
    """
    df = vector_guard(df, max_resolution)
    over = F.col("base_shrink") > 1
    shrunk = lambda c: F.when(over, F.ceil(dbl(c) / F.col("base_shrink")).cast("bigint")).otherwise(F.col(c))
    return settle(df.withColumns({"img_w": shrunk("img_w"), "img_h": shrunk("img_h")}), "img_w", "img_h")


def preshrink(df: DataFrame) -> DataFrame:
    """Pyramid level to read (JPEG 1/2/4/8, WebP any) and what is left for the scaler.

    A level holds ceil(size / preshrink) pixels per axis.
    """
    wanted = F.least(
        _ratio("src_w", scale("src_w", "w_scale")), _ratio("src_h", scale("src_h", "h_scale"))
    ) * F.when(F.col("src_format") == "svg", F.col("base_shrink")).otherwise(F.lit(1.0))
    df = df.withColumn("wanted_shrink", wanted)
    wanted = F.col("wanted_shrink")
    jpeg = F.when(wanted >= 8, 8.0).when(wanted >= 4, 4.0).when(wanted >= 2, 2.0).otherwise(1.0)
    level = (
        F.when(F.col("src_format") == "svg", wanted)
        .when(wanted <= 1, F.lit(1.0))
        .when(F.col("src_format") == "jpeg", jpeg)
        .when(F.col("src_format") == "webp", wanted)
        .otherwise(F.lit(1.0))
    )
    df = df.withColumn("preshrink", level)
    df = df.withColumns(
        {
            "level_w": F.ceil(dbl("src_w") / F.col("preshrink")).cast("bigint"),
            "level_h": F.ceil(dbl("src_h") / F.col("preshrink")).cast("bigint"),
        }
    )
    df = df.withColumns({"got_w": _ratio("src_w", "level_w"), "got_h": _ratio("src_h", "level_h")})
    used = F.col("preshrink") != 1

    def left_over(axis: str) -> Column:
        rest = F.col(f"{axis}_scale") * F.col(f"got_{axis}")
        exact = F.col(f"level_{axis}") == scale(f"level_{axis}", rest)
        return F.when(~used, F.col(f"{axis}_scale")).when(exact, F.lit(1.0)).otherwise(rest)

    def level_crop(axis: str) -> Column:
        size = F.col(f"crop_px_{axis}")
        return F.when(
            used & (size > 0), F.greatest(F.lit(1).cast("bigint"), shrink(size, f"got_{axis}"))
        ).otherwise(size)

    def level_offset(offset: str, axis: str) -> Column:
        absolute = used & (F.col("crop_type") != "fp") & (F.abs(F.col(offset)) >= 1)
        return F.when(absolute, F.rint(F.col(offset) / F.col(f"got_{axis}"))).otherwise(F.col(offset))

    return df.withColumns(
        {
            "rest_w_scale": left_over("w"),
            "rest_h_scale": left_over("h"),
            "level_crop_w": level_crop("w"),
            "level_crop_h": level_crop("h"),
            "level_crop_x": level_offset("crop_x", "w"),
            "level_crop_y": level_offset("crop_y", "h"),
        }
    ).drop("wanted_shrink", "got_w", "got_h")


def watermark_layout(df: DataFrame, mark_w: int, mark_h: int) -> DataFrame:
    """Size and place of the watermark on a result of padded_w x padded_h per frame."""
    width, height = F.col("padded_w"), F.col("padded_h")
    sized = F.col("wm_scale") > 0
    room = lambda size: F.greatest(scale_even(size, "wm_scale"), F.lit(1))
    factor = F.greatest(F.lit(float(mark_w)) / dbl(room(width)), F.lit(float(mark_h)) / dbl(room(height)))
    df = df.withColumn("mark_shrink", F.when(sized, factor).otherwise(F.lit(1.0)))
    fitted = lambda size: scale(size, F.lit(1.0) / F.least(F.col("mark_shrink"), F.lit(float(size))))
    gap = lambda offset, size: F.when(
        F.abs(F.col(offset)) >= 1, F.rint(F.col(offset) * F.col("dpr_scale")).cast("bigint")
    ).otherwise(scale_even(size, offset))
    tiled = F.col("wm_position") == "re"
    df = df.withColumns(
        {
            "gap_x": F.when(tiled, gap("wm_x", width)).otherwise(0).cast("bigint"),
            "gap_y": F.when(tiled, gap("wm_y", height)).otherwise(0).cast("bigint"),
            "mark_w": fitted(mark_w),
            "mark_h": fitted(mark_h),
        }
    )
    df = df.withColumns(
        {
            "tile_left": half(F.col("gap_x")),
            "tile_top": half(F.col("gap_y")),
            "tile_w": F.col("mark_w") + F.col("gap_x"),
            "tile_h": F.col("mark_h") + F.col("gap_y"),
        }
    )
    left, top = position(
        width, height, F.col("mark_w"), F.col("mark_h"), F.col("wm_position"), F.col("wm_x"), F.col("wm_y"),
        F.col("dpr_scale"), overflow=True,
    )
    df = df.withColumns(
        {
            "wm_left": F.when(tiled, 0).otherwise(left).cast("bigint"),
            "wm_top": F.when(tiled, 0).otherwise(top).cast("bigint"),
        }
    )
    left, top = F.col("wm_left"), F.col("wm_top")
    outside = (left >= width) | (top >= height) | (-left >= F.col("mark_w")) | (-top >= F.col("mark_h"))
    stacked = (F.col("frames") > 1) & ~tiled
    skipped = F.greatest(-top, F.lit(0))
    shown = F.least(F.col("mark_h") - skipped, height - F.greatest(top, F.lit(0)))
    return df.withColumns(
        {
            "wm_visible": (F.col("wm_opacity") > 0) & (tiled | ~outside),
            "mark_crop_top": F.when(stacked, skipped).otherwise(0).cast("bigint"),
            "mark_crop_h": F.when(stacked, shown).otherwise(F.col("mark_h")).cast("bigint"),
        }
    ).drop("mark_shrink", "gap_x", "gap_y")


def frame_boxes(images: DataFrame, default_delay: int = 40) -> DataFrame:
    """One row per loaded frame: its place in the stacked image and its delay."""
    kept = F.coalesce(F.slice("delays", 1, F.col("frames").cast("int")), F.array().cast("array<bigint>"))
    full = F.when(F.size(kept) == 0, F.array_repeat(F.lit(default_delay).cast("bigint"), F.col("frames").cast("int")))
    exploded = images.withColumns({"kept": F.coalesce(full, kept)}).withColumn(
        "frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames") - 1))
    )
    return exploded.select(
        "image_id",
        "frame",
        (F.col("frame") * F.col("height")).alias("top"),
        F.col("height").alias("frame_h"),
        F.get("kept", F.col("frame")).alias("delay"),
        F.coalesce("loop", F.lit(0)).cast("bigint").alias("loop"),
        F.col("frames").alias("pages"),
    )
