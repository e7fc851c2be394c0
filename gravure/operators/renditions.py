"""Renditions from scanlines: lines(image_id, frame, y, px) with px four bytes (r, g, b, a) a pixel.

A plan has one row per rendition; an image fans out to as many renditions as ask for it. Work is dealt by
(rendition, frame, band of rows): a band brings the rows around it that its filters read, so that no task holds
an image and nothing is exchanged by the image alone. Rows are joined to plans by (image, block of rows), by merging: both
grow with the input, and the planner's guess of exploded rows would have them broadcast. What Spark deals out and joins here, `rasters` computes for one band.

Where all that a rendition reads lies in one block and its result is small, nothing is exchanged after it met its
lines (`split`, `in_blocks`): the lines of a block travel as one row, and the rendition's stages follow each other in the task
that has them. Lines that follow each other are then kept as strips(rendition, frame, y, rows, px, whole): `rows` lines from
y on; `whole` tells that a strip is all there is of its rendition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructType

from gravure.operators import rasters
from gravure.operators.blocks import BLOCK, frames_of, meet
from gravure.operators.pixels import line_text

#: Rows of a result band.
BAND = 64
#: Pixels of a rendition that a task keeps as a whole, at most.
SMALL = 1 << 18


# --- lines ------------------------------------------------------------------------------


def to_lines(pixels: DataFrame) -> DataFrame:
    """Pixel rows -> lines; a group is one scanline."""
    rows = line_text(pixels).withColumn("px", F.unhex("line"))
    return rows.select("image_id", F.col("frame").cast("int"), F.col("y").cast("int"), "px")


def to_pixels(lines: DataFrame, key: str = "image_id") -> DataFrame:
    """Lines -> pixel rows, without a shuffle."""
    cells = F.expr("transform(sequence(0, length(px) div 4 - 1), x -> struct(x, hex(substring(px, 4 * x + 1, 4)) AS h))")
    rows = lines.where(F.octet_length("px") > 0).select(key, F.col("frame").cast("long"), F.col("y").cast("long"), F.explode(cells).alias("c"))
    byte = lambda k: F.conv(F.substring("c.h", 2 * k + 1, 2), 16, 10).cast("long")
    return rows.select(key, "frame", "y", F.col("c.x").cast("long").alias("x"), *[byte(k).alias(n) for k, n in enumerate("rgba")])


def pixels_of(values: list[bytes]) -> np.ndarray:
    """Lines of equal length as [rows, columns, 4]."""
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1, 4)


def coded(values: np.ndarray) -> list[bytes]:
    data, width = np.ascontiguousarray(values.astype(np.uint8)).tobytes(), values.shape[1] * 4
    return [data[at : at + width] for at in range(0, len(data), width)] if width else [b""] * len(values)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict]]:
    """Runs of equal keys of sorted batches: each column as a list, `p` as the first row's value."""
    key, group = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "p"}
        values = list(zip(*(columns[k] for k in keys)))
        starts = [0] + [at for at in range(1, len(values)) if values[at] != values[at - 1]]
        firsts = batch.column("p").take(pa.array(starts)).to_pylist() if "p" in batch.schema.names else [None] * len(starts)
        for start, stop, first in zip(starts, [*starts[1:], len(values)], firsts):
            part = {c: v[start:stop] for c, v in columns.items()}
            if values[start] == key:
                for c, v in part.items():
                    group[c] += v
                continue
            if group:
                yield key, group
            key, group = values[start], {**part, "p": first}
    if group:
        yield key, group


def by_band(df: DataFrame, keys: list[str], order: list[str], work, schema: StructType) -> DataFrame:
    """`work` on each group of `keys`; groups are dealt by all of them, a task goes through its groups one by one."""

    def run(batches):
        kinds, names = [to_arrow_type(f.dataType) for f in schema.fields], schema.names
        out, size = [[] for _ in names], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

        for key, group in grouped(batches, keys):
            for rows in work(key, group):
                for column, values in zip(out, rows):
                    column.extend(values)
            size += sum(map(len, out[-1])) if isinstance(schema.fields[-1].dataType, BinaryType) and len(out[-1]) > 256 else 0
            if len(out[0]) >= 4096 or size > 16 << 20:
                yield batch()
                out, size = [[] for _ in names], 0
        if out[0]:
            yield batch()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def keyed(df: DataFrame, *more: tuple[str, object]) -> StructType:
    """Schema of lines of renditions, with further columns."""
    schema = StructType([df.schema["rendition"], *StructType().add("frame", IntegerType()).fields])
    for name, kind in more:
        schema = schema.add(name, kind)
    return schema


def line_rows(key: tuple, ys: range, values: list[bytes], *more: list[int]) -> list:
    return [[key[0]] * len(values), [key[1]] * len(values), *more, ys, values]


# --- renditions that read one block ---------------------------------------------------------


def split(plan: DataFrame, fits: Column | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """The renditions that read one block of rows, give a small result and are planned once, and the others; None where there are none.

    plan: as for `fan_out`, a stored table or one that is cheap to compute; `fits`: what else has to hold.
    """
    sizes = [F.col(c) for c in ("out_w", "out_h", "box_w", "box_h", "left", "top")]
    alone = F.col("rendition").isNotNull() & (F.least(*sizes[:4]) > 0) & (F.least(*sizes[4:]) >= 0) & (F.col("out_w").cast("double") * F.col("out_h") <= SMALL)
    for size in sizes:
        alone = alone & size.isNotNull()
    alone = alone & F.expr(f"top div {BLOCK} = (top + box_h - 1) div {BLOCK}") & (F.lit(True) if fits is None else fits)
    marked = plan.withColumn("alone", F.coalesce(alone, F.lit(False)))
    counted = marked.groupBy("rendition").agg(F.count(F.lit(1)).alias("n"), F.bool_and("alone").alias("alone"))
    local = F.col("alone") & (F.col("n") == 1)
    found = counted.agg(F.count_if(local).alias("local"), F.count_if(~local).alias("rest"), F.max("n").alias("most")).first()
    if not found["rest"]:
        return plan, None
    if not found["local"]:
        return None, plan
    if found["most"] == 1:
        return marked.where("alone").select(*plan.columns), marked.where(~F.col("alone")).select(*plan.columns)
    own = counted.where(local).select("rendition").hint("merge")
    return plan.join(own, "rendition", "left_semi"), plan.join(own, "rendition", "left_anti")


def in_blocks(lines: DataFrame, plan: DataFrame, params: Column, carried: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """(rendition, p, parts and what is carried): renditions of `split` with all lines of the block that they read."""
    wanted = plan.select("rendition", "image_id", F.expr(f"CAST(top div {BLOCK} AS BIGINT)").alias("block"), params.alias("p"), *carried)
    return meet(lines, wanted, how).select("rendition", "p", "parts", *carried)


def block_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, dict, list]]:
    """Place in the batch, p and [(frame, first y, lines of the box)] of each rendition of `in_blocks`."""
    for at, (p, parts) in enumerate(zip(batch.column("p").to_pylist(), batch.column("parts").to_pylist())):
        left, top = int(p["left"]), int(p["top"])
        boxed = lambda lines: lines[:, left : left + int(p["box_w"])] if isinstance(lines, np.ndarray) else pixels_of([line[4 * left : 4 * (left + int(p["box_w"]))] for line in lines])
        yield at, p, [(frame, int(ys[0]) - top, boxed(lines)) for frame, ys, lines in frames_of(parts, top, top + int(p["box_h"]) - 1)]


def strips_schema(rendition: DataFrame, *carried: object) -> StructType:
    schema = keyed(rendition, ("y", IntegerType()), ("rows", IntegerType()), ("px", BinaryType()), ("whole", BooleanType()))
    return StructType([*schema.fields, *carried])


class Strips:
    """Strips of renditions of one batch, given out when there is enough of them."""

    def __init__(self, batch: pa.RecordBatch, schema: StructType, carried: tuple[str, ...] = ()):
        self.batch, self.names, self.carried = batch, schema.names, carried
        self.out, self.size = [], 0

    def add(self, at: int, strips: list[tuple], whole: bool = True) -> None:
        """strips: (frame, y, lines as bytes [rows, width]) of the rendition at a place of the batch; `whole`: all of it."""
        for frame, y, values in strips:
            self.out.append((at, frame, y, len(values), np.ascontiguousarray(values).tobytes(), whole and len(strips) == 1))
            self.size += values.size

    def full(self) -> bool:
        return len(self.out) >= 4096 or self.size > 8 << 20

    def take(self) -> pa.RecordBatch:
        at, frame, y, rows, px, whole = (list(v) for v in zip(*self.out)) if self.out else [[] for _ in range(6)]
        self.out, self.size = [], 0
        places = pa.array(at, pa.int64())
        columns = [self.batch.column("rendition").take(places), pa.array(frame, pa.int32()), pa.array(y, pa.int32()), pa.array(rows, pa.int32()), pa.array(px, pa.binary()), pa.array(whole, pa.bool_())]
        return pa.RecordBatch.from_arrays([*columns, *[self.batch.column(c).take(places) for c in self.carried]], names=self.names)


def to_strips(lines: DataFrame, *carried: str) -> DataFrame:
    """Lines as strips of one line each."""
    return lines.select("rendition", F.col("frame").cast("int").alias("frame"), F.col("y").cast("int").alias("y"), F.lit(1).alias("rows"), "px", F.lit(False).alias("whole"), *carried)


def of_strips(strips: DataFrame) -> DataFrame:
    """lines(rendition, frame, y, px) of strips."""
    cut = "transform(sequence(0, rows - 1), k -> struct(y + k AS y, substring(px, k * (octet_length(px) div rows) + 1, octet_length(px) div rows) AS px))"
    return strips.where("rows > 0").select("rendition", "frame", F.explode(F.expr(cut)).alias("line")).select("rendition", "frame", "line.y", "line.px")


# --- crop and scale -----------------------------------------------------------------------


def fan_out(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """(rendition, frame, band, y, px, p): each plan's crop box, cut from its image's lines, by bands of result rows.

    plan: rendition, image_id, left, top, box_w, box_h, out_w, out_h. `p` is the plan's row without the image. y counts
    from the top of the box. A band gets the rows that its result rows read, under the widest reach of the filter.
    """
    ratio = F.col("out_h") / F.col("box_h")
    reach = F.greatest(F.lit(1.0), 1.0 / ratio)
    bands = plan.withColumn("band", F.explode(F.expr(f"sequence(0, CAST((out_h - 1) div {BAND} AS INT))")))
    first = F.floor((F.col("band") * BAND + 0.5) / ratio - 0.5 - reach)
    last = F.ceil((F.least(F.col("out_h"), (F.col("band") + 1) * BAND) - 0.5) / ratio - 0.5 + reach)
    bands = bands.withColumns({"from_y": (F.col("top") + F.greatest(F.lit(0), first)).cast("int"), "to_y": (F.col("top") + F.least(F.col("box_h") - 1, last)).cast("int")})
    bands = bands.withColumn("block", F.explode(F.expr(f"sequence(from_y div {BLOCK}, to_y div {BLOCK})")))
    params = F.struct(*[c for c in plan.columns if c not in ("rendition", "image_id")])
    wanted = bands.select("rendition", "image_id", "block", "band", "from_y", "to_y", params.alias("p"))
    placed = lines.select("image_id", "frame", "y", "px", F.expr(f"CAST(y div {BLOCK} AS BIGINT)").alias("block"))
    met = placed.join(wanted.hint("merge"), ["image_id", "block"]).where(F.col("y").between(F.col("from_y"), F.col("to_y")))
    cut = F.expr("substring(px, CAST(4 * p.left + 1 AS INT), CAST(4 * p.box_w AS INT))")
    return met.select("rendition", F.col("frame").cast("int"), "band", (F.col("y") - F.col("p.top")).cast("int").alias("y"), cut.alias("px"), "p")


def scaled_band(group: dict, band: int, light: bool = False) -> np.ndarray:
    """Result rows of one band, before any turn, from a group of lines."""
    return scaled_rows(group["p"], pixels_of(group["px"]), group["y"][0], band * BAND, min(int(group["p"]["out_h"]), (band + 1) * BAND), light)


def scaled_rows(p: dict, values: np.ndarray, first: int, start: int, stop: int, light: bool = False) -> np.ndarray:
    """Result rows from rows of the box from `first` on. A scale of 1 leaves every value as it is; others go through premultiplied alpha."""
    if (p["out_w"], p["out_h"]) == (p["box_w"], p["box_h"]) and not light:
        return values[start - first :][: stop - start]
    own = values.astype(float)
    if light:
        own = np.concatenate([rasters.LIGHT[values[..., :3]], own[..., 3:]], axis=-1)
    elif p.get("premultiplied"):
        own = rasters.premultiply(own)
    own = rasters.down(rasters.across(own, int(p["out_w"])), first, int(p["box_h"]), int(p["out_h"]), start, stop)
    if light:
        return np.concatenate([rasters.from_light(own[..., :3]), rasters.whole(own[..., 3:])], axis=-1)
    return rasters.unpremultiply(rasters.whole(own)) if p.get("premultiplied") else rasters.whole(own)


def scale_lines(lines: DataFrame, plan: DataFrame, light: bool = False) -> DataFrame:
    """lines(rendition, frame, y, px) of each plan's box, scaled to out_w x out_h; with `light`, in linear light."""
    schema = keyed(plan, ("y", IntegerType()), ("px", BinaryType()))

    def work(key, group):
        rows = scaled_band(group, key[2], light)
        yield line_rows(key, range(key[2] * BAND, key[2] * BAND + len(rows)), coded(rows))

    return by_band(fan_out(lines, plan), ["rendition", "frame", "band"], ["y"], work, schema)


def whole_image(facts: DataFrame, out_w: Column | str = "w", out_h: Column | str = "h") -> DataFrame:
    """A plan with one rendition per image (image_id, w, h) that crops nothing."""
    zero = F.lit(0).cast("long")
    sizes = [F.col(c) if isinstance(c, str) else c for c in (out_w, out_h)]
    return facts.select(F.col("image_id").alias("rendition"), "image_id", zero.alias("left"), zero.alias("top"), F.col("w").cast("long").alias("box_w"), F.col("h").cast("long").alias("box_h"), sizes[0].cast("long").alias("out_w"), sizes[1].cast("long").alias("out_h"))


# --- filters ------------------------------------------------------------------------------


def halo_of(p: dict) -> int:
    """Rows on each side of a band that the filters of a plan read."""
    blur, sharpen, n = p.get("blur") or 0.0, p.get("sharpen") or 0.0, int(p.get("pixelate") or 0)
    return rasters.radius(blur) + rasters.radius(sharpen) + rasters.pixelate_halo(n, int(p["height"]), int(p["width"]))


def filtered(values: np.ndarray, first: int, p: dict, start: int, stop: int) -> np.ndarray:
    """Rows start..stop after blur, sharpening and pixelating, in that order; alpha is premultiplied around the first two."""
    rows = rasters.Rows(values.astype(float), first, int(p["height"]))
    for name in ("blur", "sharpen"):
        sigma = p.get(name) or 0.0
        if sigma > 0:
            if p.get("premultiplied"):
                rows.values = rasters.premultiply(rows.values)
            rows = getattr(rows, name)(sigma)
            if p.get("premultiplied"):
                rows.values = rasters.unpremultiply(rows.values)
    n = int(p.get("pixelate") or 0)
    if n > 1:
        rows = rows.pixelate(n, start, stop)
    return rows.cut(start, stop)


def filter_lines(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """lines(rendition, frame, y, px) filtered as the plan has it: rendition, width, height, blur, sharpen, pixelate, premultiplied.

    Strengths are columns; the plan of the job does not grow with them. A line goes to the bands that read it.
    """
    params = F.struct(*[c for c in plan.columns if c != "rendition"])
    halo = F.ceil(3 * F.greatest(F.lit(0.0), "blur")) + F.ceil(3 * F.greatest(F.lit(0.0), "sharpen")) + F.when(F.col("pixelate") > 1, 2 * F.least(F.col("pixelate"), F.greatest("width", "height"))).otherwise(0)
    met = lines.join(plan.select("rendition", params.alias("p"), halo.cast("int").alias("halo")).hint("merge"), "rendition")
    bands = F.expr(f"sequence(greatest(0, y - halo) div {BAND}, least(CAST(p.height AS INT) - 1, y + halo) div {BAND})")
    schema = keyed(lines, ("y", IntegerType()), ("px", BinaryType()))

    def work(key, group):
        p = group["p"]
        start, stop = key[2] * BAND, min(int(p["height"]), (key[2] + 1) * BAND)
        yield line_rows(key, range(start, stop), coded(filtered(pixels_of(group["px"]), group["y"][0], p, start, stop)))

    return by_band(met.withColumn("band", F.explode(bands)).drop("halo"), ["rendition", "frame", "band"], ["y"], work, schema)


# --- content-aware crop ---------------------------------------------------------------------


def detail(values: np.ndarray, above: np.ndarray | None) -> np.ndarray:
    """Saturation and luma steps to the left and up of each pixel."""
    rgb = values[..., :3].astype(np.int64)
    luma = rgb @ np.array([299, 587, 114]) // 1000
    steps = np.zeros_like(luma)
    steps[:, 1:] = np.abs(np.diff(luma, axis=1))
    before = luma[:1] if above is None else (above[:, :3].astype(np.int64) @ np.array([299, 587, 114]) // 1000)[None]
    return rgb.max(axis=2) - rgb.min(axis=2) + steps + np.abs(np.diff(np.concatenate([before, luma]), axis=0))


def smart_boxes(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """(rendition, frame, left, top, score): the window want_w x want_h of each frame with the most detail; ties go top-left.

    plan: rendition, image_id, w, h, want_w, want_h, and left, top where only that part counts. A part of one block has its
    windows scored where its lines are; for others see _banded_boxes.
    """
    size = _window_plan(plan)
    local, rest = split(size, (F.col("want_w") > 0) & (F.col("want_h") > 0))
    found = []
    if local is not None:
        met = in_blocks(lines, local, F.struct(*[c for c in local.columns if c not in ("rendition", "image_id")]))
        schema = keyed(plan, ("left", LongType()), ("top", LongType()), ("score", LongType()))

        def run(batches):
            for batch in batches:
                at, out = [], []
                for place, p, frames in block_rows(batch):
                    for frame, _, values in (f for f in frames if f[2].size):
                        at.append(place)
                        out.append((frame, *best_window(values, int(p["want_w"]), int(p["want_h"]))))
                columns = [pa.array(list(v), f) for v, f in zip(zip(*out) if out else [[]] * 4, (pa.int32(), *[pa.int64()] * 3))]
                yield pa.RecordBatch.from_arrays([batch.column("rendition").take(pa.array(at, pa.int64())), *columns], names=schema.names)

        found.append(met.mapInArrow(run, schema))
    if rest is not None:
        found.append(_banded_boxes(lines, rest))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def best_window(values: np.ndarray, w: int, h: int) -> tuple[int, int, int]:
    """left, top and score of the window with the most detail, of whole rows of an image."""
    h, w = min(h, values.shape[0]), min(w, values.shape[1])
    sums = np.zeros((values.shape[0] + 1, values.shape[1] + 1), np.int64)
    sums[1:, 1:] = detail(values, None).cumsum(axis=0).cumsum(axis=1)
    scores = sums[h:, w:] - sums[:-h, w:] - sums[h:, :-w] + sums[:-h, :-w]
    at = int(scores.argmax())
    return at % scores.shape[1], at // scores.shape[1], int(scores.flat[at])


def _window_plan(plan: DataFrame) -> DataFrame:
    """A plan that scales nothing, with the windows asked for, within the image."""
    zero = F.lit(0).cast("long")
    origin = [F.col(c).cast("long").alias(c) if c in plan.columns else zero.alias(c) for c in ("left", "top")]
    return plan.select("rendition", "image_id", *origin, F.col("w").cast("long").alias("box_w"), F.col("h").cast("long").alias("box_h"), F.col("w").cast("long").alias("out_w"), F.col("h").cast("long").alias("out_h"), F.least("want_w", "w").cast("long").alias("want_w"), F.least("want_h", "h").cast("long").alias("want_h"))


def _banded_boxes(lines: DataFrame, size: DataFrame) -> DataFrame:
    """smart_boxes by bands, for images of any size.

    size: as of _window_plan. Row by row the sums of all windows of that width are added up, first in each band, then over bands; a window's
    score is the running sum at its last row less that above its first. Running sums are dealt by (rendition, frame, window's top), two rows each.
    """
    columns = (("band", IntegerType()), ("y", IntegerType()), ("rows", IntegerType()), ("sums", BinaryType()))

    def running(key, group):
        p, first = group["p"], group["y"][0]
        values = pixels_of(group["px"])
        start, stop = key[2] * BAND, min(int(p["box_h"]), (key[2] + 1) * BAND)
        own = detail(values[start - first : stop - first], values[start - 1 - first] if start else None)
        ends = np.concatenate([np.zeros((len(own), 1), np.int64), np.cumsum(own, axis=1)], axis=1)
        sums = np.cumsum(ends[:, int(p["want_w"]) :] - ends[:, : -int(p["want_w"])], axis=0)
        n = len(sums)
        yield [[key[0]] * n, [key[1]] * n, [key[2]] * n, range(start, stop), [int(p["want_h"])] * n, [r.tobytes() for r in sums]]

    cut = fan_out(lines, size)
    sums = by_band(cut, ["rendition", "frame", "band"], ["y"], running, keyed(size, *columns))
    last = sums.join(size.select("rendition", "box_h").hint("merge"), "rendition").where((F.col("y") % BAND == BAND - 1) | (F.col("y") == F.col("box_h") - 1))

    def before(key, group):
        total, out = 0, []
        for row in group["sums"]:
            now = np.frombuffer(row, np.int64)
            out.append((total + np.zeros_like(now)).tobytes())
            total = total + now
        yield [[key[0]] * len(out), [key[1]] * len(out), group["band"], out]

    offsets = by_band(last.select("rendition", "frame", "band", "sums"), ["rendition", "frame"], ["band"], before, keyed(size, ("band", IntegerType()), ("before", BinaryType())))
    ends = F.expr("array(struct(y - rows + 1 AS window, 1 AS sign), struct(y + 1 AS window, -1 AS sign))")
    roles = sums.join(offsets.hint("merge"), ["rendition", "frame", "band"]).withColumn("role", F.explode(ends))
    roles = roles.join(size.select("rendition", (F.col("box_h") - F.col("want_h")).alias("last")).hint("merge"), "rendition").where(F.col("role.window").between(0, F.col("last")))
    roles = roles.select("rendition", "frame", F.col("role.window").alias("window"), F.col("role.sign").alias("sign"), "sums", "before")

    def scores(key, group):
        total = 0
        for sign, own, offset in zip(group["sign"], group["sums"], group["before"]):
            total = total + sign * (np.frombuffer(own, np.int64) + np.frombuffer(offset, np.int64))
        at = int(total.argmax())
        yield [[key[0]], [key[1]], [key[2]], [at], [int(total[at])]]

    rows = by_band(roles, ["rendition", "frame", "window"], ["sign"], scores, keyed(size, ("window", IntegerType()), ("left", IntegerType()), ("score", LongType())))
    best = F.max(F.struct("score", (-F.col("window")).alias("up"), (-F.col("left")).alias("back"))).alias("best")
    found = rows.groupBy("rendition", "frame").agg(best)
    return found.select("rendition", "frame", (-F.col("best.back")).cast("long").alias("left"), (-F.col("best.up")).cast("long").alias("top"), F.col("best.score").alias("score"))


def crop_frames(lines: DataFrame, boxes: DataFrame, key: str = "rendition") -> DataFrame:
    """lines(rendition, frame, y, px) cut to boxes (rendition, frame, left, top, want_w, want_h), a box per frame."""
    met = lines.join(boxes.hint("merge"), [key, "frame"]).where((F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + F.col("want_h")))
    cut = F.expr("substring(px, CAST(4 * left + 1 AS INT), CAST(4 * want_w AS INT))")
    return met.select(key, "frame", (F.col("y") - F.col("top")).cast("int").alias("y"), cut.alias("px"))


def smart_crop(lines: DataFrame, plan: DataFrame, strips: bool = False) -> DataFrame:
    """Lines of the most detailed window of each frame, by the window of its plan row (see smart_boxes); with `strips`, strips."""
    local, rest = split(_window_plan(plan), (F.col("want_w") > 0) & (F.col("want_h") > 0))
    found = []
    if local is not None:
        met = in_blocks(lines, local, F.struct(*[c for c in local.columns if c not in ("rendition", "image_id")]))
        schema = strips_schema(met)

        def run(batches):
            for batch in batches:
                out = Strips(batch, schema)
                for at, p, frames in block_rows(batch):
                    cut = []
                    for frame, _, values in (f for f in frames if f[2].size):
                        left, top, _ = best_window(values, int(p["want_w"]), int(p["want_h"]))
                        own = values[top : top + int(p["want_h"]), left : left + int(p["want_w"])]
                        cut.append((frame, 0, own.reshape(len(own), -1)))
                    out.add(at, cut)
                    if out.full():
                        yield out.take()
                yield out.take()

        found.append(met.mapInArrow(run, schema))
    if rest is not None:
        found.append(to_strips(_banded_smart_crop(lines, plan if local is None else plan.join(rest.select("rendition").distinct().hint("merge"), "rendition", "left_semi"))))
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both if strips else of_strips(both)


def _banded_smart_crop(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """smart_crop by bands, for images of any size."""
    origin = [F.col(c).alias(f"{c}_0") if c in plan.columns else F.lit(0).alias(f"{c}_0") for c in ("left", "top")]
    sizes = plan.select("rendition", "image_id", *origin, F.least("want_w", "w").alias("want_w"), F.least("want_h", "h").alias("want_h"))
    boxes = _banded_boxes(lines, _window_plan(plan)).join(sizes.hint("merge"), "rendition").withColumns({"left": F.col("left") + F.col("left_0"), "top": F.col("top") + F.col("top_0")})
    met = lines.withColumn("frame", F.col("frame").cast("int")).join(boxes.hint("merge"), ["image_id", "frame"]).where((F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + F.col("want_h")))
    cut = F.expr("substring(px, CAST(4 * left + 1 AS INT), CAST(4 * want_w AS INT))")
    return met.select("rendition", "frame", (F.col("y") - F.col("top")).cast("int").alias("y"), cut.alias("px"))
