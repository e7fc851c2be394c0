"""Option list -> typed plan, inside the row.

A request's options stay an ordered array in its row, so parsing is one narrow
projection: no explode, no shuffle, whatever the number of requests. A field takes
the last option that writes it; an option may also clear a field.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravure.functions.numeric import megapixels
from gravure.functions.text import b64url_decode, hex_rgb, parse_bool, parse_float, parse_int
from gravure.plans import dims

CLEARED = "\u0000"

Writes = dict[str, Callable[[Column], Column]]


def arg(args: Column, i: int) -> Column:
    """The i-th argument, NULL beyond the last."""
    return F.get(args, F.lit(i))


def given(args: Column, i: int) -> Column:
    """The i-th argument, NULL where absent or empty."""
    return F.nullif(arg(args, i), F.lit(""))


def at(i: int) -> Callable[[Column], Column]:
    return lambda args: arg(args, i)


def opt(i: int) -> Callable[[Column], Column]:
    return lambda args: given(args, i)


def after(gate: int, i: int, empty: bool = False) -> Callable[[Column], Column]:
    """Argument i, taken only where argument `gate` is not empty."""
    return lambda args: F.when(given(args, gate).isNotNull(), arg(args, i) if empty else given(args, i))


def unless_smart(kind: int, i: int) -> Callable[[Column], Column]:
    """A gravity offset: smart gravity clears it, another keeps an older one."""
    return lambda args: F.when(arg(args, kind) == "sm", F.lit(CLEARED)).otherwise(given(args, i))


def or_clear(i: int) -> Callable[[Column], Column]:
    return lambda args: F.coalesce(given(args, i), F.lit(CLEARED))


def _background(args: Column) -> Column:
    channel = lambda i: F.lpad(F.lower(F.hex(parse_int(arg(args, i)))), 2, "0")
    return F.when(F.size(args) == 3, F.concat(channel(0), channel(1), channel(2))).otherwise(
        F.when(arg(args, 0) == "", F.lit(CLEARED)).otherwise(hex_rgb(arg(args, 0)))
    )


# Field -> the options that write it, and the argument each takes it from.
TEXT_FIELDS: dict[str, Writes] = {
    "resizing_type": {"resize": opt(0), "resizing_type": at(0)},
    "width": {"resize": opt(1), "size": opt(0), "width": at(0)},
    "height": {"resize": opt(2), "size": opt(1), "height": at(0)},
    "enlarge": {"resize": opt(3), "size": opt(2), "enlarge": at(0)},
    "extend": {"resize": opt(4), "size": opt(3), "extend": at(0)},
    "extend_type": {"resize": after(4, 5, True), "size": after(3, 4, True), "extend": at(1)},
    "extend_x": {"resize": after(4, 6), "size": after(3, 5), "extend": opt(2)},
    "extend_y": {"resize": after(4, 7), "size": after(3, 6), "extend": opt(3)},
    "extend_ar": {"extend_aspect_ratio": at(0)},
    "extend_ar_type": {"extend_aspect_ratio": at(1)},
    "extend_ar_x": {"extend_aspect_ratio": opt(2)},
    "extend_ar_y": {"extend_aspect_ratio": opt(3)},
    "min_width": {"min-width": at(0)},
    "min_height": {"min-height": at(0)},
    "zoom_w": {"zoom": at(0)},
    "zoom_h": {"zoom": lambda args: F.coalesce(arg(args, 1), arg(args, 0))},
    "dpr": {"dpr": at(0)},
    "gravity_type": {"gravity": at(0)},
    "gravity_x": {"gravity": unless_smart(0, 1)},
    "gravity_y": {"gravity": unless_smart(0, 2)},
    "crop_w": {"crop": at(0)},
    "crop_h": {"crop": at(1)},
    "crop_type": {"crop": at(2)},
    "crop_x": {"crop": unless_smart(2, 3)},
    "crop_y": {"crop": unless_smart(2, 4)},
    "trim_threshold": {"trim": or_clear(0)},
    "trim_color": {"trim": or_clear(1)},
    "trim_equal_h": {"trim": opt(2)},
    "trim_equal_v": {"trim": opt(3)},
    "auto_rotate": {"auto_rotate": at(0)},
    "rotate": {"rotate": at(0)},
    "flip_h": {"flip": opt(0)},
    "flip_v": {"flip": opt(1)},
    "background": {"background": _background},
    "blur": {"blur": at(0)},
    "sharpen": {"sharpen": at(0)},
    "pixelate": {"pixelate": at(0)},
    "wm_opacity": {"watermark": at(0)},
    "wm_position": {"watermark": opt(1)},
    "wm_x": {"watermark": opt(2)},
    "wm_y": {"watermark": opt(3)},
    "wm_scale": {"watermark": opt(4)},
    "strip_metadata": {"strip_metadata": at(0)},
    "keep_copyright": {"keep_copyright": at(0)},
    "strip_color_profile": {"strip_color_profile": at(0)},
    "preserve_hdr": {"preserve_hdr": at(0)},
    "enforce_thumbnail": {"enforce_thumbnail": at(0)},
    "quality": {"quality": at(0)},
    "max_bytes": {"max_bytes": at(0)},
    "format": {"format": lambda args: dims.type_name(arg(args, 0))},
    "raw": {"raw": at(0)},
    "cachebuster": {"cachebuster": or_clear(0)},
    "expires": {"expires": at(0)},
    "filename": {
        "filename": lambda args: F.when(
            parse_bool(F.coalesce(arg(args, 1), F.lit(""))),
            b64url_decode(F.rtrim(arg(args, 0), F.lit("="))).cast("string"),
        ).otherwise(arg(args, 0))
    },
    "return_attachment": {"return_attachment": at(0)},
    "max_src_resolution": {"max_src_resolution": at(0)},
    "max_src_file_size": {"max_src_file_size": at(0)},
    "max_frames": {"max_animation_frames": at(0)},
    "max_frame_resolution": {"max_animation_frame_resolution": at(0)},
    "max_dim": {"max_result_dimension": at(0)},
}
INT_FIELDS = {
    "width", "height", "min_width", "min_height", "rotate", "pixelate", "quality", "max_bytes", "expires",
    "max_src_file_size", "max_frames", "max_dim",
}
FLOAT_FIELDS = {
    "extend_x", "extend_y", "extend_ar_x", "extend_ar_y", "zoom_w", "zoom_h", "dpr", "gravity_x", "gravity_y",
    "crop_w", "crop_h", "crop_x", "crop_y", "trim_threshold", "blur", "sharpen", "wm_opacity", "wm_x", "wm_y",
    "wm_scale",
}
BOOL_FIELDS = {
    "enlarge", "extend", "extend_ar", "trim_equal_h", "trim_equal_v", "auto_rotate", "flip_h", "flip_v",
    "strip_metadata", "keep_copyright", "strip_color_profile", "preserve_hdr", "enforce_thumbnail", "raw",
    "return_attachment",
}
PIXEL_FIELDS = {"max_src_resolution", "max_frame_resolution"}
PADDING_FIELDS = ("pad_top", "pad_right", "pad_bottom", "pad_left")
PLAN_FIELDS = (*TEXT_FIELDS, *PADDING_FIELDS, "skip_formats", "format_quality", "used_presets")

# Values of the planner inputs where the request gives none.
GEOMETRY_DEFAULTS = {
    "width": 0, "height": 0, "min_width": 0, "min_height": 0, "resizing_type": "fit", "zoom_w": 1.0, "zoom_h": 1.0,
    "dpr": 1.0, "enlarge": False, "extend": False, "extend_type": "ce", "extend_x": 0.0, "extend_y": 0.0,
    "extend_ar": False, "extend_ar_type": "ce", "extend_ar_x": 0.0, "extend_ar_y": 0.0, "rotate": 0,
    "auto_rotate": True, "flip_h": False, "flip_v": False, "crop_w": 0.0, "crop_h": 0.0, "crop_x": 0.0, "crop_y": 0.0,
    "gravity_type": "ce", "gravity_x": 0.0, "gravity_y": 0.0, "pad_top": 0, "pad_right": 0, "pad_bottom": 0,
    "pad_left": 0, "max_dim": 0, "wm_opacity": 0.0, "wm_position": "ce", "wm_x": 0.0, "wm_y": 0.0, "wm_scale": 0.0,
    "blur": 0.0, "sharpen": 0.0, "pixelate": 1, "quality": 0, "max_bytes": 0, "max_frames": 1, "raw": False,
}


def _among(options: Column, *names: str) -> Column:
    """Whether an option of one of these names is given. Compiled, so that a field nobody writes costs no pass over the options."""
    return _or(*[F.array_contains(options["name"], name) for name in names])


def _last(options: Column, writes: Writes) -> Column:
    """The text the last writing option gives to a field."""

    def value(o: Column) -> Column:
        (first, take), *rest = writes.items()
        chain = F.when(o["name"] == first, take(o["args"]))
        for name, other in rest:
            chain = chain.when(o["name"] == name, other(o["args"]))
        return chain

    written = F.filter(F.transform(options, value), lambda v: v.isNotNull())
    return F.when(_among(options, *writes), F.nullif(F.try_element_at(written, F.lit(-1)), F.lit(CLEARED)))


def _padding(options: Column) -> Column:
    """Sides in order of the options; a side not given copies one already known."""
    start = F.struct(*[F.lit(None).cast("bigint").alias(f) for f in PADDING_FIELDS])

    def fold(known: Column, o: Column) -> Column:
        args = o["args"]
        side = lambda i: parse_int(given(args, i))
        top = F.coalesce(side(0), known["pad_top"])
        right = F.coalesce(side(1), top, known["pad_right"])
        return F.struct(
            top.alias("pad_top"),
            right.alias("pad_right"),
            F.coalesce(side(2), top, known["pad_bottom"]).alias("pad_bottom"),
            F.coalesce(side(3), right, known["pad_left"]).alias("pad_left"),
        )

    return F.aggregate(F.filter(options, lambda o: o["name"] == "padding"), start, fold)


def _format_quality(options: Column) -> Column:
    """format -> quality, the last pair of a format winning."""
    return F.flatten(
        F.transform(
            F.filter(options, lambda o: o["name"] == "format_quality"),
            lambda o: F.filter(
                F.transform(
                    o["args"],
                    lambda fmt, i: F.when(
                        i % 2 == 0,
                        F.struct(
                            dims.type_name(fmt).alias("key"), parse_int(F.get(o["args"], i + 1)).alias("value")
                        ),
                    ),
                ),
                lambda pair: pair.isNotNull(),
            ),
        )
    )


def _last_pairs(pairs: Column) -> Column:
    latest = F.filter(
        pairs,
        lambda p, i: p["key"].isNotNull()
        & ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == p["key"]),
    )
    return F.map_from_entries(latest)


def typed_plan(df: DataFrame, options: str = "options") -> DataFrame:
    """Plan columns from the ordered options (canonical names, presets inlined)."""
    o = F.col(options)

    def cast(field: str) -> Column:
        text = F.col(f"_{field}")
        if field in INT_FIELDS:
            return parse_int(text)
        if field in FLOAT_FIELDS:
            return parse_float(text)
        if field in BOOL_FIELDS:
            return parse_bool(text)
        if field in PIXEL_FIELDS:
            return megapixels(parse_float(text))
        if field == "trim_color":
            return hex_rgb(text)
        return text

    named = lambda name: F.filter(o, lambda x: x["name"] == name)
    raw = df.withColumns(
        {f"_{field}": _last(o, writes) for field, writes in TEXT_FIELDS.items()}
        | {
            "_pad": F.when(_among(o, "padding"), _padding(o)),
            "_fq": F.when(_among(o, "format_quality"), _format_quality(o)),
            "_skip": F.flatten(F.transform(named("skip_processing"), lambda x: x["args"])),
            "_presets": F.transform(named("#preset"), lambda x: arg(x["args"], 0)),
        }
    )
    return raw.select(
        *df.columns,
        *[cast(field).alias(field) for field in TEXT_FIELDS],
        *[F.col(f"_pad.{field}").alias(field) for field in PADDING_FIELDS],
        F.transform("_skip", dims.type_name).alias("skip_formats"),
        _last_pairs(F.col("_fq")).alias("format_quality"),
        F.col("_presets").alias("used_presets"),
    )


def with_defaults(df: DataFrame) -> DataFrame:
    """Planner inputs with the reference defaults where a request says nothing."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in GEOMETRY_DEFAULTS.items()})


# --- argument checks --------------------------------------------------------------------


def _or(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _bad(value: Column, low: int | None = 0, high: int | None = None) -> Column:
    """Not an integer in range. NULL text is not an error (argument not given)."""
    number = parse_int(value)
    bad = number.isNull()
    if low is not None:
        bad = bad | (number < low)
    if high is not None:
        bad = bad | (number > high)
    return F.coalesce(value.isNotNull() & bad, F.lit(False))


def _bad_float(value: Column, low: float | None = None, high: float | None = None, above: bool = False) -> Column:
    number = parse_float(value)
    bad = number.isNull()
    if low is not None:
        bad = bad | ((number <= low) if above else (number < low))
    if high is not None:
        bad = bad | (number > high)
    return F.coalesce(value.isNotNull() & bad, F.lit(False))


def _more_than(args: Column, n: int) -> Column:
    return F.size(args) > n


def _bad_gravity(args: Column, off: int, allowed: tuple[str, ...]) -> Column:
    """Gravity arguments from `off` on: type, x, y."""
    kind, n = arg(args, off), F.size(args) - off
    point = F.coalesce(kind == "fp", F.lit(False))
    inside = lambda i: F.when(point, _bad_float(given(args, i), 0.0, 1.0)).otherwise(_bad_float(given(args, i)))
    wrong = (
        ~F.coalesce(kind.isin(*allowed), F.lit(False))
        | (n > 3)
        | (F.coalesce(kind == "sm", F.lit(False)) & (n > 1))
        | (point & (n != 3))
        | inside(off + 1)
        | inside(off + 2)
    )
    return (n > 0) & wrong


def _bad_size(args: Column, off: int) -> Column:
    extend = given(args, off + 3).isNotNull() & _bad_gravity(args, off + 4, dims.EXTEND_GRAVITIES)
    return _bad(given(args, off)) | _bad(given(args, off + 1)) | extend


def _choice(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(~value.isin(*allowed), F.lit(False))


def _argument_checks(now_s: Column) -> dict[str, Callable[[Column], Column]]:
    """Canonical option -> condition under which its arguments are wrong."""
    one = lambda check: lambda a: _more_than(a, 1) | check(arg(a, 0))
    flag = lambda a: _more_than(a, 1)
    number = one(_bad)
    real = one(lambda v: _bad_float(v, 0.0))
    positive = one(lambda v: _bad_float(v, 0.0, above=True))
    checks: dict[str, Callable[[Column], Column]] = {
        "resize": lambda a: _more_than(a, 8) | _choice(given(a, 0), dims.RESIZE_TYPES) | _bad_size(a, 1),
        "size": lambda a: _more_than(a, 7) | _bad_size(a, 0),
        "resizing_type": one(lambda v: _choice(v, dims.RESIZE_TYPES)),
        "zoom": lambda a: _more_than(a, 2) | _or(*[_bad_float(arg(a, i), 0.0, above=True) for i in (0, 1)]),
        "dpr": positive,
        "extend": lambda a: _more_than(a, 4) | _bad_gravity(a, 1, dims.EXTEND_GRAVITIES),
        "extend_aspect_ratio": lambda a: _more_than(a, 4) | _bad_gravity(a, 1, dims.EXTEND_GRAVITIES),
        "gravity": lambda a: _bad_gravity(a, 0, dims.CROP_GRAVITIES),
        "crop": lambda a: _bad_float(arg(a, 0), 0.0)
        | _bad_float(arg(a, 1), 0.0)
        | _bad_gravity(a, 2, dims.CROP_GRAVITIES),
        "trim": lambda a: _more_than(a, 4)
        | _bad_float(given(a, 0))
        | (given(a, 1).isNotNull() & hex_rgb(arg(a, 1)).isNull()),
        "padding": lambda a: _more_than(a, 4) | _or(*[_bad(given(a, i)) for i in range(4)]),
        "rotate": one(lambda v: _bad(v, None) | F.coalesce(parse_int(v) % 90 != 0, F.lit(False))),
        "flip": lambda a: _more_than(a, 2),
        "background": lambda a: F.when(F.size(a) == 1, (arg(a, 0) != "") & hex_rgb(arg(a, 0)).isNull())
        .when(F.size(a) == 3, _or(*[~arg(a, i).rlike("^[0-9]+$") | _bad(arg(a, i), 0, 255) for i in range(3)]))
        .otherwise(F.lit(True)),
        "watermark": lambda a: _more_than(a, 7)
        | _bad_float(arg(a, 0), 0.0, 1.0)
        | _choice(given(a, 1), dims.WATERMARK_GRAVITIES)
        | _bad_float(given(a, 2))
        | _bad_float(given(a, 3))
        | _bad_float(given(a, 4), 0.0, above=True),
        "quality": one(lambda v: _bad(v, 0, 100)),
        "format_quality": lambda a: (F.size(a) % 2 != 0)
        | F.exists(
            F.transform(a, lambda v, i: F.when(i % 2 == 0, dims.type_name(v).isNull()).otherwise(_bad(v, 0, 100))),
            lambda bad: bad,
        ),
        "format": one(lambda v: dims.type_name(v).isNull()),
        "skip_processing": lambda a: F.exists(a, lambda v: dims.type_name(v).isNull()),
        "cachebuster": flag,
        "filename": lambda a: _more_than(a, 2)
        | (
            parse_bool(F.coalesce(arg(a, 1), F.lit("")))
            & b64url_decode(F.rtrim(arg(a, 0), F.lit("="))).isNull()
        ),
        "expires": one(lambda v: _bad(v, None)),
        "max_src_resolution": real,
        "max_src_file_size": one(lambda v: _bad(v, None)),
        "max_animation_frames": one(lambda v: _bad(v, 1)),
        "max_animation_frame_resolution": real,
        "max_result_dimension": one(lambda v: _bad(v, None)),
    }
    for name in ("width", "height", "min-width", "min-height", "pixelate", "max_bytes"):
        checks[name] = number
    for name in ("blur", "sharpen"):
        checks[name] = real
    for name in (
        "enlarge", "auto_rotate", "strip_metadata", "keep_copyright", "strip_color_profile", "preserve_hdr",
        "enforce_thumbnail", "raw", "return_attachment",
    ):
        checks[name] = flag
    return checks


def option_error(o: Column, allowed: list[str], security_options: bool, now_s: Column) -> Column:
    """Why an option is refused, or NULL. `o` has name (canonical), given_name, args, in_url."""
    forbidden = F.lit(False)
    if allowed:
        forbidden = o["in_url"] & ~o["given_name"].isin(*allowed)
    error = (
        F.when(o["name"] == "#preset", F.lit(None).cast("string"))
        .when(forbidden, F.lit("forbidden_option"))
        .when(o["name"].isNull(), F.lit("unknown_option"))
        .when(o["name"] == "preset", F.lit("unknown_preset"))
    )
    if not security_options:
        error = error.when(o["name"].isin(*dims.SECURITY_OPTIONS), F.lit("security_options"))
    wrong = None
    for name, check in _argument_checks(now_s).items():
        condition = check(o["args"])
        wrong = F.when(o["name"] == name, condition) if wrong is None else wrong.when(o["name"] == name, condition)
    stamp = parse_int(arg(o["args"], 0))
    return error.when(wrong, F.lit("option_argument")).when(
        (o["name"] == "expires") & (stamp > 0) & (stamp < now_s), F.lit("expired_url")
    )


def argument_errors(
    df: DataFrame, options: str = "options", allowed: list[str] | None = None, security_options: bool = False,
    now_us: str = "ts_us",
) -> DataFrame:
    """The first refused option decides: option_error and option_status (NULL when all pass)."""
    now_s = F.floor(F.col(now_us) / F.lit(1_000_000))
    errors = F.filter(
        F.transform(F.col(options), lambda o: option_error(o, allowed or [], security_options, now_s)),
        lambda e: e.isNotNull(),
    )
    return df.withColumn("option_error", F.get(errors, F.lit(0))).withColumn(
        "option_status",
        F.when(F.col("option_error") == "security_options", 403).when(F.col("option_error").isNotNull(), 404),
    )
