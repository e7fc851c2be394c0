"""Output decisions: plan x image facts -> format, quality, animation, colour policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravure.functions.numeric import scale
from gravure.plans import dims


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def check_load_save(df: DataFrame, source: str = "src_format", target: str = "format") -> DataFrame:
    """422 for a source without decoder or a target without encoder."""
    loads = _false(F.col(source).isin(*dims.TYPE_NAMES))
    saves = F.col(target).isNull() | F.col(target).isin(*dims.SAVEABLE)
    return df.withColumns(
        {"load_status": F.when(~loads, 422).cast("bigint"), "save_status": F.when(~saves, 422).cast("bigint")}
    )


def skip_processing(df: DataFrame, always_rasterize_svg: bool = False) -> DataFrame:
    """Whether the source is passed through as it is."""
    listed = F.coalesce(F.array_contains("skip_formats", F.col("src_format")), F.lit(False))
    unknown, out = F.col("format").isNull(), F.col("format")
    svg = _false(out == "svg") | (unknown & (listed if always_rasterize_svg else F.lit(True)))
    other = listed & (unknown | _false(out == F.col("src_format")))
    return df.withColumn("skip", F.when(F.col("src_format") == "svg", svg).otherwise(other))


def expect_alpha(df: DataFrame) -> DataFrame:
    padded = F.greatest("pad_top", "pad_right", "pad_bottom", "pad_left") != 0
    return df.withColumn(
        "expect_alpha", F.col("background").isNull() & (F.col("has_alpha") | padded | F.col("extend"))
    )


def may_animate(df: DataFrame) -> DataFrame:
    """Several frames allowed and present; the target is not known yet."""
    return df.withColumn("animated_in", (F.col("max_frames") > 1) & (F.col("frames") > 1))


def output_format(df: DataFrame, preferred: tuple[str, ...] = dims.PREFERRED_FORMATS) -> DataFrame:
    """out_format, and 422 in format_status where it cannot be saved (after expect_alpha, may_animate)."""
    still = ~F.col("animated_in")
    fits = F.coalesce(
        *[
            F.when(
                (still | dims.has_capability(F.lit(t), "anim_save"))
                & (~F.col("expect_alpha") | dims.has_capability(F.lit(t), "alpha")),
                F.lit(t),
            )
            for t in preferred
        ],
        F.lit(preferred[0]),
    )
    chosen = (
        F.when(F.col("prefer_jxl") & still, "jxl")
        .when(F.col("prefer_avif") & still, "avif")
        .when(F.col("prefer_webp"), "webp")
        .when(F.col("src_format").isin(*preferred), F.col("src_format"))
        .otherwise(fits)
    )
    forced = (
        F.when(F.col("enforce_jxl") & still, "jxl")
        .when(F.col("enforce_avif") & still, "avif")
        .when(F.col("enforce_webp"), "webp")
        .otherwise(F.col("format"))
    )
    refused = _false(F.col("format") == "svg")
    df = df.withColumn(
        "out_format", F.when(~refused, F.when(F.col("format").isNull(), chosen).otherwise(forced))
    )
    return df.withColumn(
        "format_status", F.when(~_false(F.col("out_format").isin(*dims.SAVEABLE)), 422).cast("bigint")
    )


def resolve_animation(df: DataFrame) -> DataFrame:
    """Frames to load once the target is known; trim is off for animations."""
    animated = F.col("animated_in") & dims.has_capability(F.col("out_format"), "anim_save")
    df = df.withColumn("animated", animated)
    return df.withColumns(
        {
            "load_frames": F.when(F.col("animated"), F.least("frames", "max_frames")).otherwise(1).cast("bigint"),
            "trim_on": F.col("trim_threshold").isNotNull() & ~F.col("animated"),
        }
    )


def check_dimensions(df: DataFrame, max_resolution: int = dims.MAX_SRC_RESOLUTION, max_frame_resolution: int = 0) -> DataFrame:
    """422 where a raster has more pixels than allowed; per frame where frames have their own limit."""
    frames = F.greatest("frames", F.lit(1))
    area = F.col("img_w") * F.col("img_h")
    own = F.coalesce(F.col("max_src_resolution"), F.lit(max_resolution))
    own_frame = F.coalesce(F.col("max_frame_resolution"), F.lit(max_frame_resolution))
    over = F.when((frames > 1) & (own_frame > 0), area > own_frame).otherwise(area * frames > own)
    return df.withColumn(
        "size_status", F.when((F.col("src_format") != "svg") & over, 422).cast("bigint")
    )


def oriented_size(df: DataFrame) -> DataFrame:
    """Size of one frame as displayed."""
    turned = F.col("orientation").isin(5, 6, 7, 8)
    return df.withColumns(
        {
            "shown_w": F.when(turned, F.col("img_h")).otherwise(F.col("img_w")),
            "shown_h": F.when(turned, F.col("img_w")).otherwise(F.col("img_h")),
        }
    )


def small_avif_fallback(df: DataFrame, fmt: str = "out_format", w: str = "result_w", h: str = "result_h") -> DataFrame:
    """AVIF needs 16 pixels per side; smaller results become PNG or JPEG."""
    small = (F.col(fmt) == "avif") & (F.least(w, h) < 16)
    return df.withColumn(
        "saved_format", F.when(small, F.when(F.col("has_alpha"), "png").otherwise("jpeg")).otherwise(F.col(fmt))
    )


def resolve_quality(df: DataFrame, fmt: str = "out_format") -> DataFrame:
    """Own quality, own quality for the format, configured for the format, configured."""
    configured = F.create_map(*[F.lit(x) for kv in dims.DEFAULT_FORMAT_QUALITY.items() for x in kv])
    positive = lambda c: F.when(c > 0, c)
    return df.withColumn(
        "out_quality",
        F.coalesce(
            positive(F.col("quality")),
            positive(F.try_element_at("format_quality", F.col(fmt))),
            F.try_element_at(configured, F.col(fmt)),
            F.lit(dims.DEFAULT_QUALITY),
        ).cast("bigint"),
    )


def next_quality(quality: Column, size: Column, target: Column) -> Column:
    """A lower quality for the next attempt, by how far the size is over the target."""
    over = size.cast("double") / target
    lowered = scale(quality, F.when(over > 3, 0.25).when(over > 1.5, 0.5).otherwise(0.75))
    return F.greatest(F.lit(1).cast("bigint"), F.least(quality - 1, lowered))


def fit_max_bytes(renditions: DataFrame, encodings: DataFrame, attempts: int = 15) -> DataFrame:
    """Quality that fits max_bytes, walked down the measured sizes of each (image, format).

    The sizes of one image and format are at most 100 numbers, so they are gathered into
    one map and the walk is a fold inside the row. Of several sizes of one quality the largest counts.
    fit_status says how the walk ended: not_asked, fits, over (none fits), unmeasured (the walk needs a
    quality that was never measured; final_bytes is null).
    """
    # Dealt by image and format once; both groupings are then made where the rows lie.
    dealt = encodings.repartition("image_id", "format").groupBy("image_id", "format", "quality").agg(F.max("bytes").alias("bytes"))
    sizes = dealt.groupBy("image_id", "format").agg(F.map_from_entries(F.collect_list(F.struct("quality", "bytes"))).alias("sizes"))
    df = renditions.join(sizes.hint("merge"), ["image_id", "format"], "left")
    gated = dims.has_capability(F.col("format"), "quality") & (F.col("max_bytes") > 0)
    size_at = lambda q: F.try_element_at("sizes", q)
    start = F.struct(
        F.col("start_quality").cast("bigint").alias("q"), F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("done")
    )

    def attempt(state: Column, _: Column) -> Column:
        q, size = state["q"], size_at(state["q"])
        stop = state["done"] | ~gated | F.coalesce(size <= F.col("max_bytes"), F.lit(True)) | (q <= 10)
        return F.struct(
            F.when(stop, q).otherwise(next_quality(q, size, F.col("max_bytes"))).alias("q"),
            F.when(stop, state["n"]).otherwise(state["n"] + 1).alias("n"),
            stop.alias("done"),
        )

    df = df.withColumn("_fit", F.aggregate(F.sequence(F.lit(1), F.lit(attempts)), start, attempt))
    return df.withColumns(
        {
            "final_quality": F.col("_fit.q"),
            "attempts": F.col("_fit.n"),
            "final_bytes": size_at(F.col("_fit.q")),
            "fit_status": F.when(~gated, "not_asked")
            .when(size_at(F.col("_fit.q")).isNull(), "unmeasured")
            .when(size_at(F.col("_fit.q")) <= F.col("max_bytes"), "fits")
            .otherwise("over"),
        }
    ).drop("_fit", "sizes")


def palette_depth(df: DataFrame, fmt: str = "out_format") -> DataFrame:
    """Bit depth of a palette PNG or a GIF; NULL where no palette is written."""
    bits = F.when(F.col("palette"), F.coalesce(F.col("palette_bits"), F.lit(8))).otherwise(F.lit(0))
    colours = F.col("quantize_colors")
    quantized = F.when(colours > 16, 8).when(colours > 4, 4).when(colours > 2, 2).otherwise(1)
    kept = F.when(bits.between(1, 8), F.when(bits > 4, 8).when(bits > 2, 4).otherwise(bits))
    depth = F.when(F.col(fmt) == "png", F.when(F.col("quantize"), quantized).otherwise(kept)).when(
        F.col(fmt) == "gif", F.when(bits.between(1, 8), bits).otherwise(8)
    )
    return df.withColumn("bit_depth", depth.cast("bigint"))


def target_colourspace(df: DataFrame, fmt: str = "out_format") -> DataFrame:
    """Working colour space: 8-bit unless the target keeps HDR."""
    deep = dims.has_capability(F.col(fmt), "hdr") & F.col("preserve_hdr")
    seen = F.col("interpretation")
    return df.withColumn(
        "colourspace",
        F.when(seen.isin("rgb", "srgb", "b-w"), seen)
        .when(seen == "rgb16", F.when(deep, seen).otherwise("srgb"))
        .when(seen == "grey16", F.when(deep, seen).otherwise("b-w"))
        .when(seen == "cmyk", "srgb")
        .otherwise(F.when(deep, "rgb16").otherwise("srgb")),
    )


def profile_policy(df: DataFrame, fmt: str = "out_format") -> DataFrame:
    """What happens to the ICC profile: export, leave, transform (to a standard one) or remove."""
    keep = ~F.col("strip_color_profile") & dims.has_capability(F.col(fmt), "icc")
    seen = F.col("interpretation")
    imported = F.col("has_profile") & ~seen.isin("rgb", "srgb", "rgb16", "scrgb", "grey16", "b-w")
    return df.withColumn(
        "profile_action",
        F.when(keep, F.when(imported, "export").otherwise("leave")).otherwise(
            F.when(imported, "remove").otherwise("transform")
        ),
    )


def flatten_needed(df: DataFrame, fmt: str = "out_format") -> DataFrame:
    """Whether alpha is blended away, and onto which colour."""
    needed = F.col("background").isNotNull() | ~dims.has_capability(F.col(fmt), "alpha")
    return df.withColumns({"flatten": needed, "flatten_colour": F.coalesce("background", F.lit("ffffff"))})


def decide(df: DataFrame) -> DataFrame:
    """Format, animation, quality and flattening of a planned request."""
    df = output_format(may_animate(expect_alpha(df)))
    return flatten_needed(resolve_quality(resolve_animation(df)))
