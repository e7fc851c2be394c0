"""Perceptual and exact hashes of pixel relations, distances, duplicates, goldens."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravure.functions.numeric import dbl
from gravure.operators import pixels as px
from gravure.operators import renditions as rn
from gravure.plans import dims

# Longest side hashed and frequencies kept per axis.
TARGET_SIDE = 64
FREQUENCIES = 8
CHANNELS = 3


def _lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Linear RGB (0..1) -> CIE Lab, D65 white."""
    x = (r * 0.4124 + g * 0.3576 + b * 0.1805) / 0.95047
    y = r * 0.2126 + g * 0.7152 + b * 0.0722
    z = (r * 0.0193 + g * 0.1192 + b * 0.9505) / 1.08883
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)
    return f(y) * 116.0 - 16.0, (f(x) - f(y)) * 500.0, (f(y) - f(z)) * 200.0


def lab_values(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """Lab of every pixel of images scaled to at most 64 x 64, alpha blended onto magenta.

    params(image_id, w, h, grey). Images that fit keep their values.
    """
    unit = lambda c: dbl(c) / 255.0
    linear = lambda c: F.when(unit(c) <= 0.04045, unit(c) / 12.92).otherwise(F.pow((unit(c) + 0.055) / 1.055, 2.4))
    light = pixels.select(*px.KEY, *[linear(c).alias(c) for c in px.COLOUR], dbl("a").alias("a"))
    fit = lambda c: F.least(F.lit(1.0), F.lit(float(TARGET_SIDE)) / F.col(c))
    scaled = params.select("image_id", "w", "h", fit("w").alias("w_scale"), fit("h").alias("h_scale"))
    sized = px.resize(light, scaled, whole=False, digits=12)
    cover = F.col("a") / 255.0
    over = {c: F.col(c) * cover + (1.0 - cover) * back for c, back in zip(px.COLOUR, (1.0, 0.0, 1.0))}
    flat = sized.withColumns(over)
    lightness, a, b = _lab(F.col("r"), F.col("g"), F.col("b"))
    side = lambda c: F.least(F.lit(TARGET_SIDE), F.col(c)).cast("bigint").alias(c)
    facts = params.select("image_id", side("w"), side("h"), "grey")
    return flat.select("image_id", "y", "x", lightness.alias("c0"), a.alias("c1"), b.alias("c2")).join(facts.hint("shuffle_hash"), "image_id")


#: sRGB bytes as linear light, with the digits that lab_values keeps.
LINEAR = np.round(np.array([v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4 for v in np.arange(256) / 255.0]), 12)
#: Scanlines that are transformed at a time.
LINES_AT_ONCE = 4096


def lab_of(light: np.ndarray) -> np.ndarray:
    """lab_values of pixels [..., (r, g, b in linear light, alpha 0..255)]: [..., (L, a, b)]."""
    cover = light[..., 3:] / 255.0
    r, g, b = np.moveaxis(light[..., :3] * cover + (1.0 - cover) * np.array([1.0, 0.0, 1.0]), -1, 0)
    t = np.stack([(r * 0.4124 + g * 0.3576 + b * 0.1805) / 0.95047, r * 0.2126 + g * 0.7152 + b * 0.0722, (r * 0.0193 + g * 0.1192 + b * 0.9505) / 1.08883])
    x, y, z = np.where(t > 0.008856, np.cbrt(t), t * 7.787 + 16.0 / 116.0)
    return np.stack([y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0], axis=-1)


def _placed(image: np.ndarray, frame: np.ndarray, y: np.ndarray, px_: pa.Array, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """image, y and Lab [line, column, 3] of lines that come image by image, by frame and y.

    Pixels beyond the width don't count, missing ones are zero, and a line that comes repeatedly counts as its mean.
    """
    size = pc.binary_length(px_).to_numpy(zero_copy_only=False) // 4
    if (size == w).all():
        starts = np.frombuffer(px_.buffers()[1], np.int32)[px_.offset : px_.offset + 2]
        values = np.frombuffer(px_.buffers()[2], np.uint8, len(size) * w * 4, starts[0]).reshape(-1, w, 4)
    else:
        values = np.frombuffer(b"".join(v[: 4 * w].ljust(4 * w, b"\0") for v in px_.to_pylist()), np.uint8).reshape(-1, w, 4)
    there = np.arange(w) < size[:, None]
    light = np.concatenate([LINEAR[values[..., :3]], values[..., 3:]], axis=-1)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(image) != 0) | (np.diff(frame) != 0) | (np.diff(y) != 0)]))
    if len(first) < len(light):
        count = np.add.reduceat(there.astype(int), first, axis=0)
        light = np.add.reduceat(light * there[..., None], first, axis=0) / np.maximum(count, 1)[..., None]
        image, y, there = image[first], y[first], count > 0
    return image, y, lab_of(light) * there[..., None]


def _transformed(batches):
    """Coefficients of whole images of at most TARGET_SIDE x TARGET_SIDE, from their lines."""
    k = np.arange(FREQUENCIES)
    waves = lambda at, size: np.cos((2.0 * at[:, None] + 1.0) * k * math.pi / (2.0 * size))
    norm = lambda size: np.sqrt(np.where(k == 0, 1.0, 2.0) / size)
    for batch in batches:
        sizes = np.stack([batch.column(c).to_numpy() for c in ("w", "h")], axis=1)
        found = np.empty((batch.num_rows, CHANNELS, FREQUENCIES, FREQUENCIES))
        for w, h in np.unique(sizes, axis=0).tolist():
            at = np.flatnonzero((sizes == (w, h)).all(axis=1))
            lists = batch.column("lines").take(pa.array(at))
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(counts)
            start = 0
            while start < len(at):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + LINES_AT_ONCE, side="right")))
                frame, y, px_ = lists.slice(start, stop - start).flatten().flatten()
                px_ = px_.fill_null(b"") if px_.null_count else px_
                image = np.repeat(np.arange(stop - start), counts[start:stop])
                y = y.to_numpy()
                inside = (y >= 0) & (y < h)
                sums = np.zeros((stop - start, CHANNELS, FREQUENCIES, FREQUENCIES))
                if inside.any():
                    px_ = px_ if inside.all() else px_.filter(pa.array(inside))
                    image, y, lab = _placed(image[inside], frame.to_numpy()[inside], y[inside], px_, w)
                    rows = np.swapaxes(lab, 1, 2) @ waves(np.arange(w), w)
                    cells = waves(y, h)[:, None, :, None] * rows[:, :, None, :]
                    first = np.flatnonzero(np.concatenate([[True], np.diff(image) != 0]))
                    sums[image[first]] = np.add.reduceat(cells, first, axis=0)
                found[at[start:stop]] = sums * norm(h)[:, None] * norm(w)
                start = stop
        found *= batch.column("n").to_numpy()[:, None, None, None]
        flat = pa.array(found.ravel())
        coefs = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * (CHANNELS * FREQUENCIES**2)), flat)
        yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("grey"), coefs], names=["image_id", "grey", "coefs"])


def _blocks(lines: DataFrame, params: DataFrame) -> DataFrame:
    """image_id, coefs: the numbers of dct_hash in (channel, v, u) order, for lines(image_id, frame, y, px).

    An image of at most 64 x 64 pixels is not scaled: its lines meet in one row, with what scanlines take of memory, and
    numpy transforms the images of a batch at once. Larger images go through the pixel relation, where they spread.
    """
    side = lambda c: F.col(c).cast("long").alias(c)
    sizes = params.groupBy("image_id", side("w"), side("h"), "grey").agg(F.count(F.lit(1)).alias("n"))
    small = (F.col("w") <= TARGET_SIDE) & (F.col("h") <= TARGET_SIDE)
    whole = lines.where("image_id IS NOT NULL").groupBy("image_id").agg(F.collect_list(F.struct(F.col("frame").cast("int").alias("frame"), F.col("y").cast("int").alias("y"), "px")).alias("lines"))
    met = whole.join(sizes.where(small).hint("shuffle_hash"), "image_id").select("image_id", "w", "h", "grey", "n", F.sort_array("lines").alias("lines"))
    done = met.mapInArrow(_transformed, f"image_id {params.schema['image_id'].dataType.simpleString()}, grey boolean, coefs array<double>")
    done = done.select("image_id", F.when(~F.col("grey"), F.col("coefs")).otherwise(F.slice("coefs", 1, FREQUENCIES**2)).alias("coefs"))
    large = params.where(~small)
    scaled = dct_hash(rn.to_pixels(lines.join(large.select("image_id").distinct().hint("merge"), "image_id", "left_semi")), large)
    cell = F.struct("ch", "v", "u", "coef")
    gathered = scaled.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["coef"]).alias("coefs"))
    return done.unionByName(gathered)


def dct_hash(pixels: DataFrame, params: DataFrame, long: bool = True) -> DataFrame:
    """8 x 8 low DCT-II frequencies per channel: image_id, ch, v, u, coef (grey images: lightness only).

    Of pixel rows or of scanlines; for scanlines, with `long` false, image_id and coefs, its numbers in (ch, v, u) order. For pixel rows it is separable: 24 sums per scanline, then 24 sums per (image, v); both passes aggregate
    before they shuffle and no pixel is copied per frequency.
    """
    if "px" in pixels.columns:
        blocks = _blocks(pixels, params)
        if not long:
            return blocks
        at = blocks.select("image_id", F.posexplode("coefs").alias("at", "coef"))
        place = lambda step, n: F.expr(f"CAST(at div {step} % {n} AS BIGINT)")
        return at.select("image_id", place(FREQUENCIES**2, CHANNELS).alias("ch"), place(FREQUENCIES, FREQUENCIES).alias("v"), place(1, FREQUENCIES).alias("u"), "coef")
    wave = lambda at, size, k: F.cos((2.0 * F.col(at) + 1.0) * float(k) * math.pi / (2.0 * F.col(size)))
    rows = lab_values(pixels, params).groupBy("image_id", "y", "w", "h", "grey").agg(
        *[F.sum(F.col(f"c{c}") * wave("x", "w", u)).alias(f"s{c}_{u}") for c in range(CHANNELS) for u in range(FREQUENCIES)]
    )
    spread = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(FREQUENCIES - 1))))
    turn = F.cos((2.0 * F.col("y") + 1.0) * F.col("v") * math.pi / (2.0 * F.col("h")))
    sums = spread.groupBy("image_id", "v", "w", "h", "grey").agg(
        *[F.sum(F.col(f"s{c}_{u}") * turn).alias(f"s{c}_{u}") for c in range(CHANNELS) for u in range(FREQUENCIES)]
    )
    norm = lambda k, size: F.sqrt(F.when(k == 0, F.lit(1.0)).otherwise(F.lit(2.0)) / dbl(size))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).cast("bigint").alias("ch"),
                F.lit(u).cast("bigint").alias("u"),
                (norm(F.lit(u), "w") * norm(F.col("v"), "h") * F.col(f"s{c}_{u}")).alias("coef"),
            )
            for c in range(CHANNELS)
            for u in range(FREQUENCIES)
        ]
    )
    long = sums.select("image_id", "grey", F.col("v").cast("bigint").alias("v"), F.inline(cells))
    return long.filter((F.col("ch") == 0) | ~F.col("grey")).select("image_id", "ch", "v", "u", "coef")


def pack_hash(coefs: DataFrame) -> DataFrame:
    """image_id, hash: 64 or 192 numbers in (channel, v, u) order, rounded so that equal images have equal hashes.

    coefs: rows of dct_hash, long or not.
    """
    if "coefs" in coefs.columns:
        return coefs.select("image_id", F.transform("coefs", lambda c: F.round(c, 6) + 0.0).alias("hash"))
    cell = F.struct("ch", "v", "u", (F.round("coef", 6) + 0.0).alias("coef"))
    return coefs.groupBy("image_id").agg(
        F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["coef"]).alias("hash")
    )


def pixel_hash(pixels: DataFrame) -> DataFrame:
    """SHA-256 over R, G, B, A bytes row by row; scanlines are joined first, so one image is a few rows.

    The bytes of one image stand together in a row, which the source size limit bounds.
    """
    lines = px.line_text(pixels).select("image_id", "frame", "y", F.unhex("line").alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("frame", "y", "line")))
    whole = F.aggregate(F.transform(ordered, lambda c: c["line"]), F.lit(bytearray()), lambda line, more: F.concat(line, more))
    return lines.groupBy("image_id").agg(F.sha2(whole, 256).alias("hash"))


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference; infinite where the lengths differ."""
    squares = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s)
    return F.when(F.size(a) == F.size(b), total / F.size(a)).otherwise(F.lit(float("inf")))


def hash_distance(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """distance of image pairs (a, b). Pairs and hashes are merged: a hash takes far more room than the planner takes it for."""
    side = lambda name: hashes.select(F.col("image_id").alias(name), F.col("hash").alias(f"_{name}")).hint("merge")
    return (
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", mse(F.col("_a"), F.col("_b")).alias("distance"))
    )


def exact_duplicates(hashes: DataFrame) -> DataFrame:
    """Groups of images with equal hashes: hash, n, first."""
    return (
        hashes.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("image_id").alias("first"))
        .filter(F.col("n") > 1)
    )


# Low frequencies of the three channels: positions in a hash that tell most pairs apart.
LEADING = (0, 1, 2, 8, 9, 10, 16, 17, 64, 65, 72, 73, 128, 129, 136, 137)


def near_duplicates(
    hashes: DataFrame, distance: float, cells: tuple[int, ...] = (0, 1, 8), leading: tuple[int, ...] = LEADING
) -> DataFrame:
    """Pairs of distinct hashes with distance at most `distance`: a < b, distance, copies_a, copies_b.

    Equal hashes are folded into one representative (the least image_id) with its number of
    copies, so a crowd of exact copies gives one row, not all its pairs. Distances add up
    squares, so no coefficient of a match differs by more than sqrt(n * distance): the
    coefficients `cells` are cut into cells of that width, a match lies in the same or a
    neighbouring cell of each, and one side visits its neighbours. Only the `leading`
    coefficients travel with the cells; their squares alone rule out most candidates, and the
    whole hashes are fetched for the rest. Nothing is missed and the distance is exact. The
    input is read several times, so pass a stored table or cut its lineage first.
    """
    distinct = hashes.groupBy("hash").agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("copies"))
    bound = F.size("hash") * F.lit(float(distance)) + 1e-6
    keyed = distinct.select(
        "image_id", "copies", F.size("hash").alias("n"),
        F.filter(F.array(*[F.get("hash", F.lit(i)) for i in leading]), lambda v: v.isNotNull()).alias("lead"), bound.alias("bound"),
        *[F.floor(F.get("hash", F.lit(i)) / F.sqrt(bound)).alias(f"k{i}") for i in cells],
    )
    keys = [f"k{i}" for i in cells]
    visit = keyed
    for k in keys:
        visit = visit.withColumn(k, F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
    side = lambda df, name: df.select(
        "n", *keys, "bound", F.col("image_id").alias(name), F.col("lead").alias(f"lead_{name}"), F.col("copies").alias(f"copies_{name}")
    )
    part = F.aggregate(
        F.zip_with("lead_a", "lead_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v
    )
    candidates = (
        side(keyed, "a")
        .join(side(visit, "b").drop("bound"), ["n", *keys])
        .filter((F.col("a") < F.col("b")) & (part <= F.col("bound")))
        .select("a", "b", "copies_a", "copies_b")
    )
    whole = lambda name: distinct.select(F.col("image_id").alias(name), F.col("hash").alias(f"_{name}"))
    return (
        candidates.join(whole("a"), "a")
        .join(whole("b"), "b")
        .withColumn("distance", mse(F.col("_a"), F.col("_b")))
        .filter(F.col("distance") <= distance)
        .select("a", "b", "distance", "copies_a", "copies_b")
    )


def golden_match(new: DataFrame, golden: DataFrame, limit: float, create: bool = False) -> DataFrame:
    """status per key(image_id): match, differ, missing (or created), stale."""
    df = new.select("image_id", F.col("hash").alias("_n")).join(
        golden.select("image_id", F.col("hash").alias("_g")), "image_id", "full_outer"
    )
    near = mse(F.col("_n"), F.col("_g")) <= limit
    return df.select(
        "image_id",
        F.when(F.col("_n").isNull(), "stale")
        .when(F.col("_g").isNull(), "created" if create else "missing")
        .when(near, "match")
        .otherwise("differ")
        .alias("status"),
    )


# Formats of the conversion matrix.
MATRIX = ("gif", "jpeg", "heic", "jxl", "svg", "tiff", "webp", "bmp", "ico")


def conversion_matrix(images: DataFrame) -> DataFrame:
    """Every source format present x target format, with a verdict and the images it concerns."""
    sources = images.filter(F.col("format").isin(*MATRIX)).groupBy("format").agg(F.count(F.lit(1)).alias("images"))
    pairs = sources.select(
        F.col("format").alias("source"), "images", F.explode(F.array(*[F.lit(t) for t in MATRIX])).alias("target")
    )
    vector = lambda c: dims.has_capability(F.col(c), "vector")
    return pairs.withColumn(
        "verdict",
        F.when(~vector("source") & vector("target"), "skip: raster to vector")
        .when(~F.col("source").isin(*dims.TYPE_NAMES), "skip: cannot load")
        .when(~F.col("target").isin(*dims.SAVEABLE), "skip: cannot save")
        .otherwise("run"),
    )
