"""Pixel relations: pixels(image_id, frame, y, x, r, g, b, a), integers 0..255.

Per-image parameters come as a table keyed by image_id (size w x h included), so one
call serves any mix of requests. Coordinate changes are projections; filters are two
one-dimensional passes. Group keys always hold coordinates, so an image with a third of
all pixels still spreads over the cluster; joins on image_id leave the strategy (and
skew splitting) to the adaptive planner, but neither side is ever broadcast: both grow with
the input, and the planner takes exploded pixels for as small as the rows they come from.
A pixel is gathered as one number. At rest pixels are packed as scanlines.

`embed` and `trim` also take scanlines and give pieces(image_id, frame, y, x, rows, px, whole): `rows` lines of equal width, placed at (x, y);
`whole` tells that a piece is all there is of its image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravure.functions.numeric import dbl
from gravure.operators import rasters
from gravure.operators.blocks import BLOCK, meet, pieces_of

KEY = ("image_id", "frame", "y", "x")
BANDS = ("r", "g", "b", "a")
COLOUR = ("r", "g", "b")


def _int(c: Column) -> Column:
    return c.cast("bigint")


def _clamp(c: Column) -> Column:
    return _int(F.greatest(F.lit(0), F.least(F.lit(255), F.round(c))))


def _mean(total: Column, count: Column, digits: int) -> Column:
    """Quotient, with the last digits cut so that the order of a sum does not show."""
    return F.round(total / count, digits)


def _fixed(df: DataFrame) -> DataFrame:
    """Canonical columns in canonical types."""
    return df.select("image_id", *[_int(F.col(c)).alias(c) for c in (*KEY[1:], *BANDS)])


def with_params(pixels: DataFrame, params: DataFrame, *names: str) -> DataFrame:
    return pixels.join(params.select("image_id", *names).hint("shuffle_hash"), "image_id")


def line_text(pixels: DataFrame, separator: str | None = None, bands: tuple[str, ...] = BANDS, keys: tuple[str, ...] = KEY[:3]) -> DataFrame:
    """keys, line, n: a scanline's pixels by x as text, and their number.

    With a separator, a pixel is its bands with commas between, without one two hex digits a band. A pixel of bytes
    travels as one number; others (of more bits, or null) travel as text and are put in order with the rest.
    """
    rgba = F.lit(0).cast("bigint")
    for c in bands:
        rgba = rgba * 256 + _int(F.col(c))
    plain = F.col("x").between(-(1 << 31), (1 << 31) - 1)
    for c in bands:
        plain = plain & F.col(c).between(0, 255)
    text = F.concat_ws(",", *[_int(F.col(c)) for c in bands]) if separator else F.coalesce(F.concat(*[F.lpad(F.hex(_int(F.col(c))), 2, "0") for c in bands]), F.lit(""))
    odd = F.when(~F.coalesce(plain, F.lit(False)), F.struct(_int(F.col("x")).alias("x"), text.alias("p")))
    coded = pixels.select(*keys, F.when(plain, _int(F.col("x")) * (1 << 32) + rgba).alias("code"), odd.alias("odd"))
    lines = coded.groupBy(*keys).agg(F.collect_list("code").alias("codes"), F.collect_list("odd").alias("others"), F.count(F.lit(1)).alias("n"))
    places = range(8 * (len(bands) - 1), -1, -8)
    of = lambda c: F.concat_ws(",", *[F.shiftright(c, k).bitwiseAND(F.lit(255)) for k in places]) if separator else F.lpad(F.hex(c.bitwiseAND(F.lit((1 << 8 * len(bands)) - 1))), 2 * len(bands), "0")
    mixed = F.concat(F.transform("codes", lambda c: F.struct(F.shiftright(c, 32).alias("x"), of(c).alias("p"))), F.col("others"))
    parts = F.when(F.size("others") == 0, F.transform(F.sort_array("codes"), of)).otherwise(F.transform(F.array_sort(mixed), lambda c: c["p"]))
    return lines.select(*keys, F.array_join(parts, separator or "").alias("line"), "n")


def sizes_of(pixels: DataFrame) -> DataFrame:
    """Size per image where no facts table has it; partial maxima before the shuffle."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


# --- packing ----------------------------------------------------------------------------


def _raster_lines(batches):
    """The lines of each raster, all pixels of a raster turned to R, G, B, A at once; bytes beyond its size are left out."""
    for batch in batches:
        ids, ys, lines = [], [], []
        for image_id, width, height, bands, data in zip(*[batch.column(c).to_pylist() for c in ("image_id", "width", "height", "channels", "data")]):
            values = np.frombuffer(data, np.uint8)[: width * height * bands]
            values = values[: len(values) // bands * bands].reshape(-1, bands)
            rgba = np.full((len(values), 4), 255, np.uint8)
            rgba[:, :3] = values if bands == 1 else values[:, 2::-1]
            if bands == 4:
                rgba[:, 3] = values[:, 3]
            whole = rgba.tobytes()
            ids += [image_id] * height
            ys += range(height)
            lines += [whole[at : at + 4 * width] for at in range(0, 4 * width * height, 4 * width)]
        zeros = pa.array(np.zeros(len(ids), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), zeros, pa.array(ys, pa.int64()), pa.array(lines, pa.binary())], names=["image_id", "frame", "y", "px"])


def unpack_raster(rasters: DataFrame, lines: bool = False) -> DataFrame:
    """Decoded bytes (top-down, interleaved B, G, R[, A]) -> pixel rows, or scanlines(image_id, frame, y, px) of whole rasters."""
    if lines:
        rows = rasters.where((F.col("width") > 0) & (F.col("height") > 0)).select("image_id", "width", "height", "channels", "data")
        return rows.mapInArrow(_raster_lines, "image_id long, frame long, y long, px binary")
    bands = F.col("channels")
    at = F.col("i") * bands
    byte = lambda k: _int(F.conv(F.hex(F.substr("data", _int(at + k + 1).cast("int"), F.lit(1))), 16, 10))
    cells = rasters.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    grey = bands == 1
    return cells.select(
        "image_id",
        _int(F.lit(0)).alias("frame"),
        _int(F.floor(F.col("i") / F.col("width"))).alias("y"),
        _int(F.col("i") % F.col("width")).alias("x"),
        F.when(grey, byte(0)).otherwise(byte(2)).alias("r"),
        F.when(grey, byte(0)).otherwise(byte(1)).alias("g"),
        byte(0).alias("b"),
        F.when(bands == 4, byte(3)).otherwise(255).cast("bigint").alias("a"),
    )


def pack(pixels: DataFrame) -> DataFrame:
    """Pixel rows -> scanlines(image_id, frame, y, px); a group is one scanline."""
    code = _int(F.col("x")) * (1 << 32) + ((F.col("r") * 256 + F.col("g")) * 256 + F.col("b")) * 256 + F.col("a")
    plain = F.col("x").between(-(1 << 31), (1 << 31) - 1)
    for c in BANDS:
        plain = plain & F.col(c).between(0, 255)
    odd = F.when(~F.coalesce(plain, F.lit(False)), F.struct("x", F.struct(*BANDS).alias("p")))
    coded = pixels.select("image_id", "frame", "y", F.when(plain, _int(code)).alias("code"), odd.alias("odd"))
    lines = coded.groupBy("image_id", "frame", "y").agg(F.collect_list("code").alias("codes"), F.collect_list("odd").alias("others"))
    byte = lambda c, k, name: F.shiftright(c, k).bitwiseAND(F.lit(255).cast("bigint")).cast(pixels.schema[name].dataType).alias(name)
    of = lambda c: F.struct(*[byte(c, k, name) for k, name in zip((24, 16, 8, 0), BANDS)])
    mixed = F.concat(F.transform("codes", lambda c: F.struct(F.shiftright(c, 32).cast(pixels.schema["x"].dataType).alias("x"), of(c).alias("p"))), F.col("others"))
    px = F.when(F.size("others") == 0, F.transform(F.sort_array("codes"), of)).otherwise(F.transform(F.array_sort(mixed), lambda c: c["p"]))
    return lines.select("image_id", "frame", "y", px.alias("px"))


def unpack(scanlines: DataFrame) -> DataFrame:
    """Scanlines -> pixel rows, without a shuffle."""
    rows = scanlines.select("image_id", "frame", "y", F.posexplode("px").alias("x", "p"))
    return rows.select("image_id", "frame", "y", _int(F.col("x")).alias("x"), "p.*")


# --- coordinates ------------------------------------------------------------------------


def crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Keep the box (left, top, box_w, box_h) and move the origin."""
    if "rows" in pixels.columns:
        return _cropped_pieces(pixels, boxes)
    df = with_params(pixels, boxes, "left", "top", "box_w", "box_h")
    dx, dy = F.col("x") - F.col("left"), F.col("y") - F.col("top")
    inside = (dx >= 0) & (dx < F.col("box_w")) & (dy >= 0) & (dy < F.col("box_h"))
    return _fixed(df.filter(inside).withColumns({"x": dx, "y": dy}))


def _cropped_pieces(pieces: DataFrame, boxes: DataFrame, once: bool = False) -> DataFrame:
    """crop of pieces; `once`: no image has several boxes."""
    names = ("left", "top", "box_w", "box_h")
    met = pieces.join(boxes.select("image_id", *[_int(F.col(c)).alias(c) for c in names]).hint("merge"), "image_id")

    def run(batches):
        out = _Pieces()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("image_id", "frame", "y", "x", "rows", "px", "whole", *names)]
            for image_id, frame, y, x, rows, px, whole, left, top, box_w, box_h in zip(*columns):
                if None in (left, top, box_w, box_h):
                    continue
                a, b = max(0, top - y), max(0, left - x)
                values = np.frombuffer(px, np.uint8).reshape(rows, -1, 4)[a : max(a, top + box_h - y), b : max(b, left + box_w - x)]
                if values.size:
                    out.add(image_id, [(frame, y + a - top, x + b - left, values)], whole and once)
                if out.full():
                    yield out.take()
        yield out.take()

    return met.select("image_id", "frame", "y", "x", "rows", "px", "whole", *names).mapInArrow(run, _PIECES)


def rotate(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """Clockwise by angle (0, 90, 180, 270)."""
    df = with_params(pixels, params, "w", "h", "angle")
    x, y, a = F.col("x"), F.col("y"), F.col("angle")
    right, bottom = F.col("w") - 1 - x, F.col("h") - 1 - y
    return _fixed(
        df.withColumns(
            {
                "x": F.when(a == 90, bottom).when(a == 180, right).when(a == 270, y).otherwise(x),
                "y": F.when(a == 90, x).when(a == 180, bottom).when(a == 270, right).otherwise(y),
            }
        )
    )


def flip(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """Mirror by flip_h and flip_v."""
    df = with_params(pixels, params, "w", "h", "flip_h", "flip_v")
    return _fixed(
        df.withColumns(
            {
                "x": F.when(F.col("flip_h"), F.col("w") - 1 - F.col("x")).otherwise(F.col("x")),
                "y": F.when(F.col("flip_v"), F.col("h") - 1 - F.col("y")).otherwise(F.col("y")),
            }
        )
    )


_PIECES = "image_id long, frame long, y long, x long, rows int, px binary, whole boolean"
#: Pixels of an image that one piece holds, at most.
SMALL = 1 << 18


def _once(params: DataFrame) -> bool:
    """Whether no image has several rows."""
    return params.where("image_id IS NOT NULL").groupBy("image_id").count().where("count > 1").isEmpty()


class _Pieces:
    """Pieces of images of one batch, given out when there is enough of them."""

    def __init__(self):
        self.out, self.size = [], 0

    def add(self, image_id, pieces: list[tuple], alone: bool) -> None:
        """pieces: (frame, y, x, pixels [rows, columns, 4]), all of an image where `alone`; those of many lines are cut."""
        for frame, y, x, values in pieces:
            step = len(values) if values.size <= 4 * SMALL else BLOCK
            for start in range(0, len(values), max(1, step)):
                own = values[start : start + step]
                self.out.append((image_id, frame, y + start, x, len(own), own.tobytes(), alone and len(pieces) == 1 and step == len(values)))
                self.size += own.size

    def full(self) -> bool:
        return len(self.out) >= 4096 or self.size > 8 << 20

    def take(self) -> pa.RecordBatch:
        columns = [list(v) for v in zip(*self.out)] if self.out else [[] for _ in range(7)]
        self.out, self.size = [], 0
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=["image_id", "frame", "y", "x", "rows", "px", "whole"])


def _embedded_pieces(lines: DataFrame, params: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """embed of scanlines: the blocks of an image are moved, the first brings the border; an image of one block becomes one piece."""
    once = _once(params)
    frames = F.col("frames") if "frames" in params.columns else F.lit(1)
    wanted = params.select("image_id", *[_int(F.col(c)).alias(c) for c in names], _int(frames).alias("frames"))
    last = F.expr(f"greatest(0, canvas_h - 1 - off_y) div {BLOCK}")
    met = meet(lines, wanted.withColumn("last", last).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("last", F.lit(0))))), "left")

    def run(batches):
        out = _Pieces()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("image_id", "block", "last", "parts", "frames", *names)]
            for image_id, block, last, parts, frames, w, h, canvas_w, canvas_h, off_x, off_y in zip(*columns):
                if None in (canvas_w, canvas_h, off_x, off_y):
                    continue
                own, bare = [], set(range(frames)) if block == 0 and None not in (w, h, frames) else set()
                for frame, y, values in pieces_of(parts, -off_y, canvas_h - 1 - off_y):
                    left = max(0, -off_x)
                    values = values[:, left : max(left, canvas_w - off_x)]
                    fits = frame in bare and last == 0 and (len(values), values.shape[1]) == (h, w) and y == 0 and min(off_x, off_y) >= 0 and canvas_w * canvas_h <= SMALL
                    if fits and off_x + w <= canvas_w and off_y + h <= canvas_h:
                        canvas = np.zeros((canvas_h, canvas_w, 4), np.uint8)
                        canvas[off_y : off_y + h, off_x : off_x + w] = values
                        bare.discard(frame)
                        own.append((frame, 0, 0, canvas))
                    elif values.size:
                        own.append((frame, y + off_y, off_x + left, values))
                for frame in sorted(bare):
                    low, high = min(max(0, off_y), canvas_h), min(max(0, off_y + h), canvas_h)
                    if h <= 0:
                        low = high
                    for top, bottom, first, end in ((0, low, 0, canvas_w), (low, high, 0, off_x), (low, high, off_x + w, canvas_w), (high, canvas_h, 0, canvas_w)):
                        for start in range(top, bottom, BLOCK) if end > first else ():
                            own.append((frame, start, first, np.zeros((min(bottom, start + BLOCK) - start, end - first, 4), np.uint8)))
                out.add(image_id, own, once and last == 0)
                if out.full():
                    yield out.take()
        yield out.take()

    return met.select("image_id", "block", "last", "parts", "frames", *names).mapInArrow(run, _PIECES)


def embed(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """Place an image (w x h) at (off_x, off_y) on a transparent black canvas.

    Only the border is generated (for params' `frames` frames, 1 where the column is
    absent); it is added to the moved pixels, so no join is made between canvas and image. Scanlines give pieces.
    """
    names = ("w", "h", "canvas_w", "canvas_h", "off_x", "off_y")
    if "px" in pixels.columns:
        return _embedded_pieces(pixels, params, names)
    moved = with_params(pixels, params, *names[2:]).withColumns(
        {"x": F.col("x") + F.col("off_x"), "y": F.col("y") + F.col("off_y")}
    )
    within = F.col("x").between(0, F.col("canvas_w") - 1) & F.col("y").between(0, F.col("canvas_h") - 1)
    frames = F.col("frames").cast("int") if "frames" in params.columns else F.lit(1)
    grid = params.withColumn("frame", F.explode(F.sequence(F.lit(0), frames - 1))).select("image_id", "frame", *names)
    grid = grid.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("canvas_h").cast("int") - 1)))
    covered = F.col("y").between(F.col("off_y"), F.col("off_y") + F.col("h") - 1)
    start = F.col("off_x") + F.col("w")
    none = F.array().cast("array<int>")
    span = lambda first, last: F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(none)
    right = F.col("canvas_w").cast("int") - 1
    columns = F.when(
        covered, F.concat(span(F.lit(0), F.col("off_x").cast("int") - 1), span(start.cast("int"), right))
    ).otherwise(span(F.lit(0), right))
    border = grid.withColumn("x", F.explode(columns)).withColumns({c: F.lit(0) for c in BANDS})
    return _fixed(moved.filter(within)).unionByName(_fixed(border))


def replicate(tile: DataFrame, params: DataFrame, centred: bool = True) -> DataFrame:
    """Tile an image (w x h) over cover_w x cover_h; centred uses odd counts and a centred cut.

    Every tile pixel makes its own copies; nothing is joined to the covered grid. Scanlines (image_id, frame, y, px) of
    w pixels give scanlines: a line is repeated and cut as a whole.
    """
    df = with_params(tile, params, "w", "h", "cover_w", "cover_h")

    def times(size: str, cover: str) -> tuple[Column, Column]:
        n = F.ceil(dbl(cover) / dbl(size)).cast("int")
        if not centred:
            return n, F.lit(0).cast("bigint")
        n = n + F.when(n % 2 == 0, 1).otherwise(0)
        return n, F.floor((n * F.col(size) - F.col(cover)) / 2).cast("bigint")

    def copies(at: str, size: str, cover: str) -> Column:
        n, cut = times(size, cover)
        first = F.sequence(F.lit(0), n - 1)
        placed = F.transform(first, lambda i: F.col(at) + i * F.col(size) - cut)
        return F.filter(placed, lambda p: (p >= 0) & (p < F.col(cover)))

    df = df.withColumn("y", F.explode(copies("y", "h", "cover_h")))
    if "px" in tile.columns:
        n, cut = times("w", "cover_w")
        wide = F.unhex(F.substr(F.repeat(F.hex("px"), n), (8 * cut + 1).cast("int"), (8 * F.col("cover_w")).cast("int")))
        return df.select("image_id", _int(F.col("frame")).alias("frame"), _int(F.col("y")).alias("y"), wide.alias("px"))
    return _fixed(df.withColumn("x", F.explode(copies("x", "w", "cover_w"))))


# --- bands ------------------------------------------------------------------------------


def premultiply(pixels: DataFrame, where: Column | None = None) -> DataFrame:
    on = F.lit(True) if where is None else where
    return pixels.withColumns(
        {c: F.when(on, _int(F.round(dbl(c) * dbl("a") / 255.0))).otherwise(F.col(c)) for c in COLOUR}
    )


def unpremultiply(pixels: DataFrame, where: Column | None = None) -> DataFrame:
    on = F.lit(True) if where is None else where
    plain = lambda c: F.when(F.col("a") == 0, 0).otherwise(
        F.least(F.lit(255), F.round(dbl(c) * 255.0 / F.nullif(dbl("a"), F.lit(0.0))))
    )
    return pixels.withColumns({c: F.when(on, _int(plain(c))).otherwise(F.col(c)) for c in COLOUR})


def flatten(pixels: DataFrame, colour: tuple[int, int, int] | None = None, depth: int = 8) -> DataFrame:
    """Blend alpha onto a colour (a literal, or columns bg_r, bg_g, bg_b) and make it opaque."""
    factor = 257 if depth == 16 else 1
    top = 65535 if depth == 16 else 255
    backs = [F.lit(v) for v in colour] if colour else [F.col(f"bg_{c}") for c in COLOUR]
    blend = lambda c, back: _int(
        F.round((dbl(c) * dbl("a") + dbl(back * factor) * (float(top) - dbl("a"))) / float(top))
    )
    blended = pixels.withColumns({c: blend(c, back) for c, back in zip(COLOUR, backs)})
    return blended.withColumn("a", F.lit(top).cast("bigint"))


def to_grey(pixels: DataFrame) -> DataFrame:
    """Rec. 709 luma in all colour bands."""
    luma = _int(F.round(dbl("r") * 0.2126 + dbl("g") * 0.7152 + dbl("b") * 0.0722))
    return pixels.withColumn("_l", luma).withColumns({c: F.col("_l") for c in COLOUR}).drop("_l")


def is_grey(pixels: DataFrame) -> DataFrame:
    """Per image: whether every pixel has equal bands."""
    same = (F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))
    return pixels.groupBy("image_id").agg(F.bool_and(same).alias("grey"))


# --- filters ----------------------------------------------------------------------------


def _resample(
    df: DataFrame, at: str, size: str, out: str, keys: list[str], bands: tuple[str, ...], digits: int
) -> DataFrame:
    """One pass of a triangle filter widened by the shrink, along `at` from `size` to `out`."""
    ratio = dbl(out) / dbl(size)
    df = df.withColumns({"_s": ratio, "_reach": F.greatest(F.lit(1.0), 1.0 / ratio)})
    low = F.floor((F.col(at) - F.col("_reach") + 0.5) * F.col("_s") - 0.5) + 1
    high = F.ceil((F.col(at) + F.col("_reach") + 0.5) * F.col("_s") - 0.5) - 1
    df = df.withColumns(
        {"_lo": F.greatest(F.lit(0), low).cast("int"), "_hi": F.least(F.col(out) - 1, high).cast("int")}
    )
    df = df.filter(F.col("_lo") <= F.col("_hi")).withColumn("_to", F.explode(F.sequence("_lo", "_hi")))
    centre = (F.col("_to") + 0.5) / F.col("_s") - 0.5
    df = df.withColumn("_wt", 1.0 - F.abs(F.col(at) - centre) / F.col("_reach"))
    sums = df.groupBy(*keys, F.col("_to").alias(at)).agg(
        F.sum("_wt").alias("_wt"), *[F.sum(F.col("_wt") * F.col(c)).alias(c) for c in bands]
    )
    return sums.select(*keys, at, *[_mean(F.col(c), F.col("_wt"), digits).alias(c) for c in bands])


def resize(
    pixels: DataFrame, params: DataFrame, bands: tuple[str, ...] = BANDS, whole: bool = True, carry: tuple[str, ...] = (),
    digits: int = 6,
) -> DataFrame:
    """Scale w x h to round(w * w_scale) x round(h * h_scale); rows, then columns. For measures of small images, by pixels.

    One row of params per image: renditions of any number, and whole images, are renditions.scale_lines.

    A scale of 1 leaves every value as it is. `carry` names columns of pixels that are
    constant for an image.
    """
    target = params.select(
        "image_id",
        "w",
        "h",
        F.greatest(F.lit(1), _int(F.round(F.col("w") * F.col("w_scale")))).alias("out_w"),
        F.greatest(F.lit(1), _int(F.round(F.col("h") * F.col("h_scale")))).alias("out_h"),
    )
    df = pixels.join(target.hint("shuffle_hash"), "image_id")
    df = _resample(df, "x", "w", "out_w", ["image_id", "frame", "y", "h", "out_h", *carry], bands, digits)
    df = _resample(df, "y", "h", "out_h", ["image_id", "frame", "x", *carry], bands, digits)
    if not whole:
        return df
    return df.select(*KEY, *carry, *[_clamp(F.col(c)).alias(c) for c in bands])


def box_shrink(pixels: DataFrame, n: int) -> DataFrame:
    """Block means of n x n as a smaller image: a pyramid level."""
    return _fixed(
        pixels.groupBy(
            "image_id", "frame", F.floor(F.col("y") / n).alias("y"), F.floor(F.col("x") / n).alias("x")
        ).agg(*[F.round(F.sum(c) / F.count(F.lit(1))).alias(c) for c in BANDS])
    )


# --- content-aware ----------------------------------------------------------------------


def trim_boxes(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """Box of what differs from the background by more than threshold.

    params: image_id, w, h, threshold, colour_r, colour_g, colour_b (NULL: take the
    top-left pixel), equal_h, equal_v. Nothing different leaves the whole image.
    """
    if "rows" in pixels.columns:
        box = _seen_pieces(pixels, params)
        return _boxes(params, box)
    flat = flatten(pixels, (255, 0, 255))
    corner = flat.filter((F.col("x") == 0) & (F.col("y") == 0) & (F.col("frame") == 0))
    back = params.join(
        corner.select("image_id", *[F.col(c).alias(f"_c{c}") for c in COLOUR]).hint("merge"), "image_id", "left"
    ).select(
        "image_id", "threshold", *[F.coalesce(f"colour_{c}", f"_c{c}").alias(f"_b{c}") for c in COLOUR]
    )
    seen = flat.join(back.hint("shuffle_hash"), "image_id").filter(
        F.greatest(*[F.abs(F.col(c) - F.col(f"_b{c}")) for c in COLOUR]) > F.col("threshold")
    )
    box = seen.groupBy("image_id").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    return _boxes(params, box)


def _seen_pieces(pieces: DataFrame, params: DataFrame) -> DataFrame:
    """image_id, x0, x1, y0, y1 of what differs from the background, for pieces."""
    first = pieces.where("frame = 0 AND y <= 0 AND y + rows > 0 AND x <= 0").select("image_id", F.expr("substring(px, CAST(-y * (octet_length(px) div rows) - 4 * x + 1 AS INT), 4)").alias("corner"), F.expr("octet_length(px) div rows div 4 + x").alias("right"))
    corner = first.where("right > 0").select("image_id", "corner")
    back = params.join(corner.hint("merge"), "image_id", "left").select("image_id", "corner", F.col("threshold").cast("double").alias("threshold"), *[F.col(f"colour_{c}").cast("double").alias(c) for c in COLOUR])
    met = pieces.join(back.hint("merge"), "image_id")

    def run(batches):
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("image_id", "y", "x", "rows", "px", "corner", "threshold", *COLOUR)]
            for image_id, y, x, rows, px, corner, threshold, *colour in zip(*columns):
                if threshold is None or (corner is None and None in colour):
                    continue
                flat = rasters.flatten(np.frombuffer(px, np.uint8).reshape(rows, -1, 4).astype(float), (255, 0, 255))[..., :3]
                own = rasters.flatten(np.frombuffer(corner, np.uint8).reshape(1, 4).astype(float), (255, 0, 255))[0, :3] if corner is not None else colour
                back = np.array([f if c is None else c for c, f in zip(colour, own)], float)
                far = np.abs(flat - back).max(axis=-1) > threshold
                across, down = np.flatnonzero(far.any(axis=0)), np.flatnonzero(far.any(axis=1))
                if len(across):
                    found.append((image_id, x + int(across[0]), x + int(across[-1]), y + int(down[0]), y + int(down[-1])))
            columns = [list(v) for v in zip(*found)] if found else [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["image_id", "x0", "x1", "y0", "y1"])

    # All columns of a piece, though not all are read: so its exchange is that of _cropped_pieces.
    rows = met.select("image_id", "frame", "y", "x", "rows", "px", "whole", "corner", "threshold", *COLOUR).mapInArrow(run, "image_id long, x0 long, x1 long, y0 long, y1 long")
    return rows.groupBy("image_id").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def _boxes(params: DataFrame, box: DataFrame) -> DataFrame:
    """trim_boxes by the place of what differs."""
    df = params.join(box.hint("merge"), "image_id", "left")
    gap = lambda equal, near, far: F.when(equal, F.least(near, far)).otherwise(near)
    left, right = F.col("x0"), F.col("w") - 1 - F.col("x1")
    top, bottom = F.col("y0"), F.col("h") - 1 - F.col("y1")
    return df.select(
        "image_id",
        _int(F.coalesce(gap(F.col("equal_h"), left, right), F.lit(0))).alias("left"),
        _int(F.coalesce(gap(F.col("equal_v"), top, bottom), F.lit(0))).alias("top"),
        _int(
            F.coalesce(F.col("w") - gap(F.col("equal_h"), left, right) - gap(F.col("equal_h"), right, left), "w")
        ).alias("box_w"),
        _int(
            F.coalesce(F.col("h") - gap(F.col("equal_v"), top, bottom) - gap(F.col("equal_v"), bottom, top), "h")
        ).alias("box_h"),
    )


def trim(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """Pixels within trim_boxes. Scanlines and pieces (see `embed`) give pieces."""
    if "px" in pixels.columns and "rows" not in pixels.columns:
        pixels = pixels.select("image_id", _int(F.col("frame")).alias("frame"), _int(F.col("y")).alias("y"), _int(F.lit(0)).alias("x"), F.lit(1).alias("rows"), "px", F.lit(False).alias("whole")).where("octet_length(px) > 0")
    if "rows" in pixels.columns:
        return _cropped_pieces(pixels, trim_boxes(pixels, params), _once(params))
    return crop(pixels, trim_boxes(pixels, params))


def _marked_lines(lines: DataFrame, mark: DataFrame, layout: DataFrame) -> DataFrame:
    """watermark on scanlines. A line beside the mark has a join key of its own that meets nothing."""
    params = ("wm_left", "wm_top", "wm_opacity", "mark_w", "mark_h")
    codes = F.sort_array(F.collect_list(F.struct(_int(F.col("mx")).alias("mx"), *[_int(F.col(f"m{c}")).alias(f"m{c}") for c in BANDS])))
    marks = mark.groupBy(_int(F.col("my")).alias("my")).agg(codes.alias("cells"))
    marks = marks.select("my", *[F.col(f"cells.{c}").alias(c) for c in ("mx", *[f"m{c}" for c in BANDS])])
    df = with_params(lines, layout, *params)
    dy = F.col("y") - F.col("wm_top")
    df = df.withColumn("my", _int(F.when(dy.between(0, F.col("mark_h") - 1), dy).otherwise(-1 - F.col("y"))))
    df = df.join(marks, "my", "left").select("image_id", "frame", "y", "px", "my", "wm_left", "wm_opacity", "mark_w", "mx", *[f"m{c}" for c in BANDS])
    return df.mapInArrow(_blended, "image_id long, frame long, y long, px binary")


def _blended(batches):
    """Lines with the mark's line over them, many of any widths at once. A place that the mark's line lacks counts as clear."""
    for batch in batches:
        lines = batch.column("px").to_pylist()
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        size = np.fromiter(map(len, lines), np.int64, len(lines)) // 4
        starts = np.cumsum(size) - size
        pixels = np.frombuffer(b"".join(lines), np.uint8).reshape(-1, 4).astype(float)
        row = np.repeat(np.arange(len(lines)), size)
        place = np.arange(len(row)) - starts[row] - column("wm_left")[row]
        under = np.flatnonzero((column("my")[row] >= 0) & (place >= 0) & (place < column("mark_w")[row]))
        if len(under):
            cells = batch.column("mx")
            count = cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lambda c: batch.column(c).flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(float)
            width = int(place[under].max()) + 1
            at, own = np.repeat(np.arange(len(lines)), count), batch.column("mx").flatten().to_numpy(zero_copy_only=False)
            kept = np.flatnonzero((own >= 0) & (own < width))
            mark = np.zeros((len(lines), width, 4))
            mark[at[kept], own[kept].astype(np.int64)] = np.stack([flat(f"m{c}")[kept] for c in BANDS], axis=-1)
            pixels[under] = rasters.over(pixels[under], mark[row[under], place[under].astype(np.int64)], column("wm_opacity")[row[under]])
        data = pixels.astype(np.uint8).tobytes()
        px = [data[4 * a : 4 * (a + n)] for a, n in zip(starts.tolist(), size.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("frame").cast(pa.int64()), batch.column("y").cast(pa.int64()), pa.array(px, pa.binary())], names=["image_id", "frame", "y", "px"])


def watermark(pixels: DataFrame, mark: DataFrame, layout: DataFrame) -> DataFrame:
    """Blend mark(mx, my, mr, mg, mb, ma) over the image at (wm_left, wm_top) with wm_opacity.

    One pass with one join. Pixels outside the mark get join keys of their own that match
    nothing, so they spread over the cluster instead of gathering on a NULL key. Scanlines (image_id, frame, y, px)
    give scanlines: a line meets the mark's line, and is blended as a whole; the mark has each place once then.
    """
    if "px" in pixels.columns:
        return _marked_lines(pixels, mark, layout)
    df = with_params(pixels, layout, "wm_left", "wm_top", "wm_opacity", "mark_w", "mark_h")
    dx, dy = F.col("x") - F.col("wm_left"), F.col("y") - F.col("wm_top")
    under = dx.between(0, F.col("mark_w") - 1) & dy.between(0, F.col("mark_h") - 1)
    df = df.withColumns(
        {
            "mx": _int(F.when(under, dx).otherwise(-1 - F.col("x"))),
            "my": _int(F.when(under, dy).otherwise(-1 - F.col("y"))),
        }
    )
    df = df.join(mark, ["mx", "my"], "left")
    s = F.coalesce(dbl("ma"), F.lit(0.0)) / 255.0 * F.col("wm_opacity")
    df = df.withColumns({"_s": s, "_d": dbl("a") / 255.0})
    df = df.withColumn("_o", F.col("_s") + F.col("_d") * (1.0 - F.col("_s")))
    inside = F.col("mx") >= 0
    blend = lambda c: F.when(F.col("_o") == 0, F.lit(0)).otherwise(
        _clamp(
            F.round(
                (F.coalesce(dbl(f"m{c}"), F.lit(0.0)) * F.col("_s") + dbl(c) * F.col("_d") * (1.0 - F.col("_s")))
                / F.nullif(F.col("_o"), F.lit(0.0)),
                6,
            )
        )
    )
    blended = {**{c: blend(c) for c in COLOUR}, "a": _clamp(F.round(F.col("_o") * 255.0, 6))}
    return _fixed(df.withColumns({c: F.when(inside, v).otherwise(F.col(c)) for c, v in blended.items()}))
