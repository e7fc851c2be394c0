"""The whole rendition pipeline: planned requests and scanlines -> result scanlines, a rendition per request.

Stages, each a no-op where the plan says so: trim (before planning), crop, scale, turn and mirror, cut to the
result, filters, canvas (extend, aspect ratio, padding), size limits of the format, background, watermark. Every
frame goes through them as a key of its own. A rendition that reads one block of rows goes through all stages in the
task where it met them (see `renditions.split`), the others are dealt by bands between the stages.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType

from gravure.functions.numeric import half
from gravure.operators import rasters
from gravure.operators.renditions import (
    BAND, SMALL, Strips, block_rows, by_band, coded, crop_frames, fan_out, filtered, in_blocks, keyed, line_rows, of_strips, scale_lines, scaled_band, scaled_rows, smart_boxes,
    smart_crop, split, strips_schema, to_strips,
)
from gravure.session import stored

#: What a plan without these columns means.
DEFAULTS = {
    "blur": 0.0, "sharpen": 0.0, "pixelate": 0, "opaque": False, "bg_r": 0, "bg_g": 0, "bg_b": 0, "wm_opacity": 0.0, "limit_scale": 1.0,
    "crop_kind": "none", "box_kind": "none", "has_alpha": True,
}
_TURNS = ("angle", "flip", "rotate", "flip_h", "flip_v")
#: Canvases by name, and what strips carry to be placed on them.
_CANVASES = ("canvas", "aspect", "padded")
_PLACES = ("box_w", "box_h", *[f"{name}_{c}" for name in _CANVASES for c in ("w", "h", "left", "top")])
#: All that the stages read of a plan.
_READ = {
    "rendition", "image_id", "frames", "img_w", "img_h", "trim_left", "trim_top", *[f"crop_{c}" for c in ("left", "top", "box_w", "box_h")], "scaled_w", "scaled_h", "box_left", "box_top",
    "result_w", "result_h", "wm_position", "wm_visible", "wm_left", "wm_top", *[f"{m}_{c}" for m in ("mark", "tile") for c in "wh"], "tile_left", "tile_top", *DEFAULTS, *_TURNS, *_PLACES,
}


def _long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def with_defaults(plan: DataFrame) -> DataFrame:
    return plan.withColumns({name: F.lit(value) for name, value in DEFAULTS.items() if name not in plan.columns})


def stored_plan(plan: DataFrame) -> DataFrame:
    """What the stages read of a plan, written once: every stage reads it."""
    plan = with_defaults(plan)
    return stored(plan.select(*[c for c in plan.columns if c in _READ]))


# --- trim -----------------------------------------------------------------------------------


def trim_boxes(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """(rendition, trim_left, trim_top, trim_w, trim_h): what differs from the background by more than the threshold.

    plan: rendition, image_id, img_w, img_h, trim_threshold, trim_r, trim_g, trim_b (null: the top left pixel), trim_equal_h,
    trim_equal_v; rows without a threshold and animated ones (frames > 1) are left out. Nothing different leaves the whole image.
    """
    asked = plan.where("trim_threshold IS NOT NULL AND coalesce(frames, 1) <= 1")
    corner = lines.where("frame = 0 AND y = 0").select("image_id", F.substring("px", 1, 4).alias("corner"))
    params = asked.join(corner.hint("merge"), "image_id", "left").select("rendition", "image_id", "corner", F.col("trim_threshold").cast("double").alias("threshold"), "trim_r", "trim_g", "trim_b")
    schema = keyed(plan, ("y", IntegerType()), ("x0", IntegerType()), ("x1", IntegerType()))

    def seen(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            columns = [batch.column(c).to_pylist() for c in ("rendition", "frame", "y", "px", "corner", "threshold", "trim_r", "trim_g", "trim_b")]
            for rendition, frame, y, px, corner, threshold, *colour in zip(*columns):
                flat = rasters.flatten(np.frombuffer(px, np.uint8).reshape(-1, 4).astype(float), (255, 0, 255))[:, :3]
                first = rasters.flatten(np.frombuffer(corner or px[:4], np.uint8).reshape(-1, 4).astype(float), (255, 0, 255))[0, :3]
                back = np.array([f if c is None else c for c, f in zip(colour, first)], float)
                at = np.flatnonzero(np.abs(flat - back).max(axis=1) > threshold)
                if len(at):
                    for column, value in zip(out, (rendition, frame, y, int(at[0]), int(at[-1]))):
                        column.append(value)
            kinds = [batch.schema.field("rendition").type, *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=schema.names)

    rows = lines.join(params.hint("merge"), "image_id").select("rendition", F.col("frame").cast("int").alias("frame"), F.col("y").cast("int").alias("y"), "px", "corner", "threshold", "trim_r", "trim_g", "trim_b").mapInArrow(seen, schema)
    box = rows.groupBy("rendition").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    df = asked.join(box.hint("merge"), "rendition", "left")
    sides = {"left": F.col("x0"), "right": F.col("img_w") - 1 - F.col("x1"), "top": F.col("y0"), "bottom": F.col("img_h") - 1 - F.col("y1")}

    def side(name: str, other: str, equal: str) -> Column:
        own = F.coalesce(sides[name], F.lit(0))
        return F.when(F.col(equal), F.least(own, F.coalesce(sides[other], F.lit(0)))).otherwise(own)

    left, right = side("left", "right", "trim_equal_h"), side("right", "left", "trim_equal_h")
    top, bottom = side("top", "bottom", "trim_equal_v"), side("bottom", "top", "trim_equal_v")
    return df.select("rendition", _long(left).alias("trim_left"), _long(top).alias("trim_top"), _long(F.col("img_w") - left - right).alias("trim_w"), _long(F.col("img_h") - top - bottom).alias("trim_h"))


def trimmed_facts(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """Requests with img_w and img_h of what is left after trimming, for the planner, and trim_left, trim_top for `render`."""
    boxes = trim_boxes(lines, requests)
    df = requests.join(boxes.hint("merge"), "rendition", "left")
    df = df.withColumns({"img_w": F.coalesce("trim_w", "img_w"), "img_h": F.coalesce("trim_h", "img_h")}).drop("trim_w", "trim_h")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("trim_left", "trim_top")})


# --- stages ---------------------------------------------------------------------------------


def _known_turn() -> Column:
    known = F.lit(True)
    for c in (*_TURNS, "cut_x", "cut_y", "cut_w", "cut_h"):
        known = known & F.col(c).isNotNull()
    return known


def scale_plan(plan: DataFrame, *more: Column) -> DataFrame:
    """What `fan_out` and the bands read of a planned request: its crop on the stored image, sizes before the turn, the cut after."""
    turned = (F.col("angle") + F.col("rotate")) % 180 != 0
    off = lambda name: _long(name) if name in plan.columns else F.lit(0).cast("long")
    keep = F.col("box_kind") == "smart"
    shift = lambda name: F.when(keep, F.lit(0)).otherwise(F.col(name)).cast("long")
    return plan.select(
        "rendition", "image_id", (_long("crop_left") + off("trim_left")).alias("left"), (_long("crop_top") + off("trim_top")).alias("top"),
        _long("crop_box_w").alias("box_w"), _long("crop_box_h").alias("box_h"),
        _long(F.when(turned, F.col("scaled_h")).otherwise(F.col("scaled_w"))).alias("out_w"),
        _long(F.when(turned, F.col("scaled_w")).otherwise(F.col("scaled_h"))).alias("out_h"),
        *[F.col(c) for c in _TURNS], F.col("has_alpha").alias("premultiplied"), shift("box_left").alias("cut_x"), shift("box_top").alias("cut_y"),
        _long(F.when(keep, F.col("scaled_w")).otherwise(F.col("box_w"))).alias("cut_w"), _long(F.when(keep, F.col("scaled_h")).otherwise(F.col("box_h"))).alias("cut_h"), *more,
    )


def _turned(p: dict, block: np.ndarray, start: int) -> tuple[int, int, np.ndarray]:
    """x, y and pixels of scaled rows (of the band that begins at `start`) in the result box, turned and mirrored."""
    turned, rows, columns = rasters.orientation(*(p[c] for c in _TURNS))
    at_rows = int(p["out_h"]) - start - len(block) if rows else start
    block = block[::-1] if rows else block
    block = block[:, ::-1] if columns else block
    first_y, first_x = (0, at_rows) if turned else (at_rows, 0)
    block = block.transpose(1, 0, 2) if turned else block
    left, top = int(p["cut_x"]), int(p["cut_y"])
    y0, y1 = max(first_y, top), max(first_y, top, min(first_y + len(block), int(p["cut_y"] + p["cut_h"])))
    x0, x1 = max(first_x, left), max(first_x, left, min(first_x + block.shape[1], int(p["cut_x"] + p["cut_w"])))
    return x0 - left, y0 - top, block[y0 - first_y : y1 - first_y, x0 - first_x : x1 - first_x]


def turned_segments(fanned: DataFrame, plan: DataFrame) -> DataFrame:
    """(rendition, frame, x, y, px): scaled bands, turned and mirrored, cut to the result box.

    A band of a turned image is a piece of every result line; `x` says where in the line a piece begins.
    """
    schema = keyed(plan, ("x", IntegerType()), ("y", IntegerType()), ("px", BinaryType()))

    def work(key, group):
        x, y, values = _turned(group["p"], scaled_band(group, key[2]).astype(np.uint8), key[2] * BAND)
        if values.size:
            yield line_rows(key, range(y, y + len(values)), coded(values), [x] * len(values))

    return by_band(fanned, ["rendition", "frame", "band"], ["y"], work, schema)


def joined_segments(segments: DataFrame) -> DataFrame:
    """Whole lines of renditions."""
    whole = F.expr("aggregate(array_sort(collect_list(struct(x, px))), X'', (line, s) -> concat(line, s.px))")
    return segments.groupBy("rendition", "frame", "y").agg(whole.alias("px"))


def _within(rows: np.ndarray, left: int, top: int, w: int, h: int) -> tuple[int, np.ndarray]:
    """y and lines of a transparent black canvas w x h under the rows of an image at (left, top); what hangs over is cut."""
    low, high = max(0, top), max(0, top, min(h, top + len(rows)))
    line = np.zeros((high - low, w, 4), np.uint8)
    first, end = max(0, left), max(0, left, min(w, left + rows.shape[1]))
    line[:, first:end] = rows[low - top : high - top, first - left : end - left]
    return low, line


def _pasted(rows: np.ndarray, left: int, top: int, w: int, h: int) -> np.ndarray:
    """The whole canvas of _within."""
    canvas = np.zeros((h, w, 4), np.uint8)
    y, line = _within(rows, left, top, w, h)
    canvas[y : y + len(line)] = line
    return canvas


def composed(segments: DataFrame, plan: DataFrame) -> DataFrame:
    """lines(rendition, frame, y, px) after filters, on the canvas: transparent black left and right of the image, and lines above and below."""
    place = _placing()
    placed = plan.select(
        "rendition", _long("box_w").alias("width"), _long("box_h").alias("height"), *[F.col(c).cast("double").alias(c) for c in ("blur", "sharpen")], _long("pixelate").alias("pixelate"),
        F.col("has_alpha").alias("premultiplied"), *[_long(c).alias(n) for n, c in place.items()],
    )
    params = F.struct(*[c for c in placed.columns if c != "rendition"])
    halo = F.ceil(3 * F.greatest(F.lit(0.0), "blur")) + F.ceil(3 * F.greatest(F.lit(0.0), "sharpen")) + F.when(F.col("pixelate") > 1, 2 * F.least(F.col("pixelate"), F.greatest("width", "height"))).otherwise(0)
    met = segments.join(placed.select("rendition", params.alias("p"), halo.cast("int").alias("halo")).hint("merge"), "rendition")
    bands = F.expr(f"sequence(greatest(0, y - halo) div {BAND}, least(CAST(p.height AS INT) - 1, y + halo) div {BAND})")
    schema = keyed(segments, ("y", IntegerType()), ("px", BinaryType()))

    def work(key, group):
        p = group["p"]
        height, width = int(p["height"]), int(p["width"])
        start, stop = key[2] * BAND, min(height, (key[2] + 1) * BAND)
        px = np.frombuffer(b"".join(group["px"]), np.uint8).reshape(-1, width, 4)  # pieces of a line follow each other
        rows = filtered(px, group["y"][0], p, start, stop)
        y, line = _within(rows, int(p["place_x"]), start + int(p["place_y"]), int(p["canvas_w"]), int(p["canvas_h"]))
        if len(line):
            yield line_rows(key, range(y, y + len(line)), coded(line))

    image = by_band(met.withColumn("band", F.explode(bands)).drop("halo"), ["rendition", "frame", "band"], ["y", "x"], work, schema)
    frames = F.coalesce(F.col("frames"), F.lit(1)) if "frames" in plan.columns else F.lit(1)
    own = placed.join(plan.select("rendition", frames.cast("int").alias("frames")).hint("merge"), "rendition")
    rows = own.where((F.col("canvas_h") > F.col("height")) | (F.col("place_y") != 0)).withColumn("frame", F.explode(F.expr("sequence(0, frames - 1)")))
    rows = rows.withColumn("y", F.explode(F.expr("sequence(0, CAST(canvas_h AS INT) - 1)"))).where("y < place_y OR y >= place_y + height")
    border = rows.select("rendition", "frame", "y", F.expr("unhex(repeat('00000000', CAST(canvas_w AS INT)))").alias("px"))
    return image.unionByName(border)


def _canvas_of_strips(strips: DataFrame, own: str, name: str) -> DataFrame:
    """_canvas for strips that carry the places of all plans of their rendition. A strip of all lines stays one, with the lines above and below."""
    schema = strips_schema(strips, strips.schema["places"])

    def run(batches):
        for batch in batches:
            out, places = Strips(batch, schema, ("places",)), batch.column("places")
            count = places.value_lengths().to_numpy()
            columns = [batch.column(c).to_pylist() for c in ("frame", "y", "rows", "px", "whole")]
            strip = list(zip(range(batch.num_rows), *columns))
            canvas = zip(*[places.flatten().field(c).to_pylist() for c in (f"{own}_w", f"{own}_h", f"{name}_w", f"{name}_h", f"{name}_left", f"{name}_top")])
            for which, (own_w, own_h, w, h, left, top) in zip(np.repeat(np.arange(len(count)), count).tolist(), canvas):
                at, frame, y, rows, px, whole = strip[which]
                if None in (px, y, own_w, own_h, w, h, left, top):
                    continue
                values = np.frombuffer(px, np.uint8).reshape(rows, -1, 4)
                if y == 0 and rows == own_h and top >= 0:
                    strips_ = [(frame, 0, _pasted(values, left, top, w, h).reshape(h, 4 * w))]
                else:
                    first, line = _within(values, left, y + top, w, h)
                    strips_ = [(frame, first, line.reshape(len(line), 4 * w))] if len(line) else []
                    if y <= 0 < y + rows and (h > own_h or top):
                        ends = ((0, min(h, max(0, top))), (max(0, top + own_h), h))
                        strips_ += [(frame, a, np.zeros((b - a, 4 * w), np.uint8)) for a, b in ends if b > a]
                out.add(at, strips_, whole)
                if out.full():
                    yield out.take()
            yield out.take()

    return strips.mapInArrow(run, schema)


def _canvas(lines: DataFrame, plan: DataFrame, own: str, name: str) -> DataFrame:
    """Lines of own_w x own_h placed at name_left, name_top of a transparent black canvas name_w x name_h, per frame; what hangs over is cut.

    Strips (see renditions.py) that carry their `places` give strips, without a join.
    """
    if "places" in lines.columns:
        return _canvas_of_strips(lines, own, name)
    sizes = plan.select("rendition", *[_long(f"{own}_{c}").alias(f"own_{c}") for c in "wh"], *[_long(f"{name}_{c}").alias(c) for c in ("w", "h", "left", "top")])
    blank = lambda n: F.expr(f"unhex(repeat('00000000', CAST({n} AS INT)))")
    met = lines.join(sizes.hint("merge"), "rendition").withColumns({"first": F.greatest(F.lit(0), F.least("left", "w")), "end": F.greatest(F.lit(0), F.least(F.col("w"), F.expr("left + octet_length(px) div 4")))})
    cut = F.expr("substring(px, CAST(4 * (first - left) + 1 AS INT), CAST(4 * greatest(0, end - first) AS INT))")
    placed = met.select("rendition", F.col("frame").cast("int"), (F.col("y") + F.col("top")).cast("int").alias("y"), "h", F.concat(blank("first"), cut, blank("w - greatest(first, end)")).alias("px"))
    moved = placed.where("y >= 0 AND y < h").drop("h")
    rows = met.where("y = 0 AND (h > own_h OR top <> 0)").select("rendition", F.col("frame").cast("int"), F.explode(F.expr("sequence(0, CAST(h AS INT) - 1)")).alias("y"), "top", "own_h", "w")
    return moved.unionByName(rows.where("y < top OR y >= top + own_h").select("rendition", "frame", "y", blank("w").alias("px")))


def extend(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Result boxes on canvases of the target size, as geometry.extend_box places them."""
    return _canvas(lines, plan, "box", "canvas")


def extend_ar(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Canvases widened to the target's ratio, as geometry.extend_ar_box places them."""
    return _canvas(lines, plan, "canvas", "aspect")


def pad(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Canvases with the padding of geometry.padding_box."""
    return _canvas(lines, plan, "aspect", "padded")


def result_boxes(lines: DataFrame, plan: DataFrame, strips: bool = False) -> DataFrame:
    """lines(rendition, frame, y, px) after crop, scale, turn and the cut to the result; no smart crops.

    With `strips`, strips that carry their places on the canvases.
    """
    plan = with_defaults(plan)
    if not strips:
        return joined_segments(turned_segments(fan_out(lines, scale_plan(plan)), plan))
    places = F.struct(*[_long(c).alias(c) for c in _PLACES])
    sizes, known = scale_plan(plan, F.array(places).alias("places")), F.lit(True)
    for c in _PLACES:
        known = known & F.col("places")[0][c].isNotNull()
    for name in _CANVASES:
        known = known & (F.col("places")[0][f"{name}_w"].cast("double") * F.col("places")[0][f"{name}_h"] <= SMALL)
    local, rest = split(sizes, known & _known_turn())
    found = []
    if local is not None:
        params = [c for c in sizes.columns if c not in ("rendition", "image_id", "places")]
        met = in_blocks(lines, local, F.struct(*params), ("places",))
        schema = strips_schema(met, met.schema["places"])

        def run(batches):
            for batch in batches:
                out = Strips(batch, schema, ("places",))
                for at, p, frames in block_rows(batch):
                    boxes = [(frame, *_turned(p, scaled_rows(p, values, first, 0, int(p["out_h"])).astype(np.uint8), 0)[1:]) for frame, first, values in frames]
                    out.add(at, [(frame, y, box.reshape(len(box), -1)) for frame, y, box in boxes if box.size])
                    if out.full():
                        yield out.take()
                yield out.take()

        found.append(met.mapInArrow(run, schema))
    if rest is not None:
        own = plan.join(rest.select("rendition").distinct().hint("merge"), "rendition", "left_semi") if local is not None else plan
        dealt = joined_segments(turned_segments(fan_out(lines, rest.drop("places")), own))
        found.append(to_strips(dealt.join(own.groupBy("rendition").agg(F.collect_list(places).alias("places")).hint("merge"), "rendition"), "places"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def limited(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Lines of renditions beyond their format's limits, scaled to result_w x result_h; others pass."""
    over = plan.where("limit_scale < 1")
    if over.isEmpty():
        return lines
    zero = F.lit(0).cast("long")
    sizes = over.select(
        "rendition", F.col("rendition").alias("image_id"), zero.alias("left"), zero.alias("top"), _long("padded_w").alias("box_w"), _long("padded_h").alias("box_h"),
        _long("result_w").alias("out_w"), _long("result_h").alias("out_h"), F.lit(True).alias("premultiplied"),
    )
    large = lines.join(sizes.select("rendition").hint("merge"), "rendition", "left_semi").withColumnRenamed("rendition", "image_id")
    return lines.join(sizes.select("rendition").hint("merge"), "rendition", "left_anti").unionByName(scale_lines(large, sizes))


def mark_lines(mark: DataFrame, layout: DataFrame) -> DataFrame:
    """(mark_w, mark_h, my, mark_px): the mark (lines of one image) in every size that the layouts ask for, each once.

    The mark is one configured image; it is scaled once per size, not per rendition.
    """
    size = mark.agg(F.max(F.octet_length("px") / 4).cast("long").alias("own_w"), (F.max("y") + 1).cast("long").alias("own_h"))
    zero = F.lit(0).cast("long")
    sizes = layout.select(_long("mark_w").alias("mark_w"), _long("mark_h").alias("mark_h")).distinct()
    plan = sizes.join(F.broadcast(size)).select(
        F.concat_ws("x", "mark_w", "mark_h").alias("rendition"), F.lit(0).cast("long").alias("image_id"), zero.alias("left"), zero.alias("top"),
        F.col("own_w").alias("box_w"), F.col("own_h").alias("box_h"), F.col("mark_w").alias("out_w"), F.col("mark_h").alias("out_h"), F.lit(True).alias("premultiplied"),
    )
    lines = scale_lines(mark.withColumn("image_id", F.lit(0).cast("long")), plan)
    at = F.split("rendition", "x")
    return lines.select(at[0].cast("long").alias("mark_w"), at[1].cast("long").alias("mark_h"), F.col("y").alias("my"), F.col("px").alias("mark_px"))


def finished(lines: DataFrame, plan: DataFrame, mark: DataFrame | None) -> DataFrame:
    """Lines with their background and the mark. A line outside the mark has a join key of its own that meets nothing."""
    plan, params = _finishing(plan, mark is not None)
    df = lines.join(plan.select("rendition", *params).hint("merge"), "rendition")
    if mark is None:
        df = df.withColumn("mark_px", F.lit(None).cast("binary"))
    else:
        inside = F.when(F.col("tiled"), (F.col("y") + F.col("skip_y")) % F.col("tile_h") - F.col("tile_top")).otherwise(F.col("y") - F.col("wm_top"))
        under = F.col("wm_visible") & (inside >= 0) & (inside < F.col("mark_h"))
        df = df.withColumn("my", F.when(under, inside).otherwise(-1 - F.col("y")).cast("int"))
        df = df.join(mark_lines(mark, plan.where("wm_visible")), ["mark_w", "mark_h", "my"], "left")
    schema = keyed(lines, ("y", IntegerType()), ("px", BinaryType()))
    names = ["rendition", "frame", "y", "px", "mark_px", *params]

    def run(batches):
        for batch in batches:
            p = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in params}
            out = rasters.finish(batch.column("px").to_pylist(), batch.column("mark_px").to_pylist(), p)
            yield pa.RecordBatch.from_arrays([batch.column("rendition"), batch.column("frame"), batch.column("y"), pa.array(out, pa.binary())], names=schema.names)

    return df.select(*names).mapInArrow(run, schema)


def _finishing(plan: DataFrame, mark: bool) -> tuple[DataFrame, list[str]]:
    """The plan with what `rasters.finish` reads of it, and the names of that."""
    params = ["opaque", "bg_r", "bg_g", "bg_b"]
    if mark:
        cover = F.col("wm_position") == "re"
        count = F.ceil(F.col("result_h") / F.col("tile_h"))
        count = count + F.when(count % 2 == 0, 1).otherwise(0)
        plan = plan.withColumns({"tiled": cover, "skip_y": F.when(cover, half(count * F.col("tile_h") - F.col("result_h"))).otherwise(0).cast("long")})
        params += ["tiled", "wm_visible", "wm_left", "wm_top", "wm_opacity", "mark_w", "mark_h", "tile_w", "tile_h", "tile_left", "tile_top", "skip_y"]
    return plan.withColumns({c: F.coalesce(F.col(c), F.lit(0 if c.startswith("bg") else False)) for c in ("opaque", "bg_r", "bg_g", "bg_b")}), params


def _mark_sizes(mark: np.ndarray):
    """The lines of the mark in any size, each scaled once a task as `mark_lines` scales them."""

    @functools.lru_cache(64)
    def lines(w: int, h: int) -> list[bytes]:
        p = {"box_w": mark.shape[1], "box_h": mark.shape[0], "out_w": w, "out_h": h, "premultiplied": True}
        return [line for start in range(0, h, BAND) for line in coded(scaled_rows(p, mark, 0, start, min(h, start + BAND)))]

    return lines


def _stages(plan: DataFrame, mark: bool) -> tuple[DataFrame, list[str], Column]:
    """`scale_plan` with all that the later stages read as `stages`, the names of what finishing reads, and whether one task can go through them."""
    canvases = {"p_frames": F.coalesce(F.col("frames"), F.lit(1)) if "frames" in plan.columns else F.lit(1), "height": F.col("box_h"), "width": F.col("box_w"), **_placing()}
    plan, finish = _finishing(plan, mark)
    filters = ["blur", "sharpen", "pixelate", "has_alpha"]
    sizes = scale_plan(plan, F.struct(*filters, "crop_kind", "box_kind", "limit_scale", *[_long(c).alias(n) for n, c in canvases.items()], *finish).alias("stages"))
    of = lambda c: F.col(f"stages.{c}")
    fits = _known_turn() & (of("crop_kind") != "smart") & (of("box_kind") != "smart") & (of("canvas_w").cast("double") * of("canvas_h") <= SMALL) & ~F.coalesce(of("limit_scale") < 1, F.lit(False))
    for c in (*filters, "p_frames", "place_x", "place_y"):
        fits = fits & of(c).isNotNull()
    if mark:
        known = of("wm_visible").isNotNull()
        for c in [c for c in finish if c not in ("wm_visible", "tiled")]:
            known = known & (~of("wm_visible") | of(c).isNotNull())
        fits = fits & known
    return sizes, finish, fits


def _whole_renditions(lines: DataFrame, sizes: DataFrame, finish: list[str], mark: np.ndarray | None) -> DataFrame:
    """Strips of the renditions that `_stages` lets through, all stages in one task."""
    met = in_blocks(lines, sizes, F.struct(*[c for c in sizes.columns if c not in ("rendition", "image_id")]), how="left")
    schema = strips_schema(met)

    def images(p, frames):
        """Strips of one rendition's frames on their canvas."""
        q = p["stages"]
        q["premultiplied"] = q["has_alpha"]
        width, height, left, top = q["width"], q["height"], q["place_x"], q["place_y"]
        found, bare = [], set(range(q["p_frames"])) if q["canvas_h"] > height or top else set()
        for frame, first, values in frames:
            _, y, box = _turned(p, scaled_rows(p, values, first, 0, int(p["out_h"])).astype(np.uint8), 0)
            if not box.size:
                continue
            rows = filtered(box.reshape(-1, width, 4), y, q, 0, height)
            y, line = (0, _pasted(rows, left, top, q["canvas_w"], q["canvas_h"])) if frame in bare else _within(rows, left, top, q["canvas_w"], q["canvas_h"])
            found.append((frame, y, line.reshape(len(line), 4 * q["canvas_w"])))
            bare.discard(frame)
        for frame in sorted(bare):
            ends = ((0, min(top, q["canvas_h"])), (max(0, top + height), q["canvas_h"]))
            found += [(frame, a, np.zeros((b - a, 4 * q["canvas_w"]), np.uint8)) for a, b in ends if b > a]
        return found

    def run(batches):
        marked = None if mark is None else _mark_sizes(mark)
        for batch in batches:
            out, asked = Strips(batch, schema), {}
            for at, p, frames in block_rows(batch):
                asked[at] = p["stages"]
                out.add(at, images(p, frames))
                # Fixed value: finishing takes some twenty times the room of the pixels.
                if out.full() or out.size > 2 << 20:
                    _finish_strips(out, asked, finish, marked)
                    asked = {}
                    yield out.take()
            _finish_strips(out, asked, finish, marked)
            yield out.take()

    return met.mapInArrow(run, schema)


def _placing() -> dict[str, Column]:
    """Where the planned canvases put a result box, and the size of the last of them."""
    return {
        "place_x": F.col("padded_left") + F.col("aspect_left") + F.col("canvas_left"), "place_y": F.col("padded_top") + F.col("aspect_top") + F.col("canvas_top"),
        "canvas_w": F.col("padded_w"), "canvas_h": F.col("padded_h"),
    }


def _finish_strips(strips: Strips, asked: dict[int, dict], names: list[str], marked) -> None:
    """The background and the mark's lines of the strips that ask for them."""
    own, lines, marks, counts = [], [], [], []
    for place, (at, _, y, rows, px, _) in enumerate(strips.out):
        q = asked[at]
        under = [None] * rows
        if marked is not None and q["wm_visible"]:
            of = marked(int(q["mark_w"]), int(q["mark_h"]))
            ys = np.arange(y, y + rows)
            inside = (ys + q["skip_y"]) % q["tile_h"] - q["tile_top"] if q["tiled"] else ys - q["wm_top"]
            under = [of[k] if 0 <= k < len(of) else None for k in inside.tolist()]
        if q["opaque"] or any(under):
            step = len(px) // rows
            own.append(place)
            counts.append(rows)
            lines += [px[k : k + step] for k in range(0, step * rows, step)] if step else [b""] * rows
            marks += under
    if not own:
        return
    values = {c: np.repeat([asked[strips.out[k][0]][c] or 0 for k in own], counts) for c in names}
    values |= {c: values[c].astype(bool) for c in ("opaque", "tiled") if c in values}
    done, start = rasters.finish(lines, marks, values), 0
    for place, rows in zip(own, counts):
        strips.out[place] = (*strips.out[place][:4], b"".join(done[start : start + rows]), strips.out[place][5])
        start += rows


def _one_mark(mark: DataFrame) -> np.ndarray | None:
    """The pixels of the configured mark; None where it is not one frame of whole lines."""
    rows = sorted((r["y"], r["frame"] or 0, bytes(r["px"])) for r in mark.select("y", "frame", "px").collect())
    even = rows and [r[:2] for r in rows] == [(y, 0) for y in range(len(rows))] and len({len(r[2]) for r in rows}) == 1 and rows[0][2]
    return np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1, 4) if even else None


def render(lines: DataFrame, plan: DataFrame, mark: DataFrame | None = None, strips: bool = False) -> DataFrame:
    """lines(rendition, frame, y, px) of every planned request over lines(image_id, frame, y, px); with `strips`, strips.

    plan: rendition, image_id, frames and the planner's columns up to result_size (crop box, scaled size, result box,
    canvas, padding, limits), turns and mirrors; optionally trim_left and trim_top, the columns of DEFAULTS, and,
    with a mark (lines of one image), those of watermark_layout. Any number of renditions of one image.
    The plan is read by every stage, so it is written once. Source rows are exchanged once, by image and block of rows, to meet
    the plans; renditions that read more than one block, with smart crops or beyond their format's limits by rendition, frame and band.
    """
    plan = stored_plan(plan)
    pixels = None if mark is None else _one_mark(mark)
    sizes, finish, fits = _stages(plan, mark is not None)
    local, rest = (None, plan) if mark is not None and pixels is None else split(sizes, fits)
    found = []
    if local is not None:
        found.append(_whole_renditions(lines, local, finish, pixels))
    if rest is not None:
        own = plan if local is None else plan.join(rest.select("rendition").distinct().hint("merge"), "rendition", "left_semi")
        found.append(to_strips(_banded(lines, own, mark)))
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both if strips else of_strips(both)


def _banded(lines: DataFrame, plan: DataFrame, mark: DataFrame | None) -> DataFrame:
    """`render` by bands, for renditions of any size."""
    sizes = scale_plan(plan)
    smart = F.col("crop_kind") == "smart"
    fanned = fan_out(lines, sizes.join(plan.where(~smart).select("rendition").hint("merge"), "rendition", "left_semi"))
    if not plan.where(smart).isEmpty():
        origin = [F.col(f"trim_{c}").alias(c) if f"trim_{c}" in plan.columns else F.lit(0).alias(c) for c in ("left", "top")]
        windows = plan.where(smart).select("rendition", "image_id", *origin, F.col("img_w").alias("w"), F.col("img_h").alias("h"), F.col("crop_box_w").alias("want_w"), F.col("crop_box_h").alias("want_h"))
        own = smart_crop(lines, windows).withColumnRenamed("rendition", "image_id")
        zero = F.lit(0).cast("long")
        cut = sizes.join(plan.where(smart).select("rendition").hint("merge"), "rendition", "left_semi").withColumns({"image_id": F.col("rendition"), "left": zero, "top": zero})
        fanned = fanned.unionByName(fan_out(own, cut))
    segments = turned_segments(fanned, plan)
    smart = F.col("box_kind") == "smart"
    if not plan.where(smart).isEmpty():
        chosen = plan.where(smart)
        scaled = joined_segments(segments.join(chosen.select("rendition").hint("merge"), "rendition", "left_semi"))
        windows = chosen.select("rendition", F.col("rendition").alias("image_id"), F.col("scaled_w").alias("w"), F.col("scaled_h").alias("h"), F.col("box_w").alias("want_w"), F.col("box_h").alias("want_h"))
        boxes = smart_boxes(scaled.withColumnRenamed("rendition", "image_id"), windows).join(windows.select("rendition", "want_w", "want_h").hint("merge"), "rendition")
        segments = segments.join(chosen.select("rendition").hint("merge"), "rendition", "left_anti").unionByName(crop_frames(scaled, boxes).withColumn("x", F.lit(0)))
    return finished(limited(composed(segments, plan), plan), plan, mark)


def frame_table(plan: DataFrame, frames: DataFrame) -> DataFrame:
    """(rendition, frame, top, frame_h, delay, loop, pages) of results, stacked; `frames` is geometry.frame_boxes of the sources."""
    own = frames.select("image_id", "frame", "delay", "loop", "pages")
    met = plan.select("rendition", "image_id", _long("result_h").alias("frame_h")).join(own.hint("merge"), "image_id")
    return met.select("rendition", "frame", (F.col("frame") * F.col("frame_h")).alias("top"), "frame_h", "delay", "loop", "pages")
