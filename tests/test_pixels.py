"""Properties of the pixel operators, and brute-force checks on small images."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.operators import pixels as px
from gravure.operators import renditions as rn
from gravure.operators import similarity as sim
from gravure.registry.pixels import digest


def _image(spark, w=9, h=7, images=2):
    rows = [
        (i, 0, y, x, (x * 31 + y * 7 + i * 50) % 256, (x * 3 + y * 90) % 256, (x * y * 5) % 256, 255)
        for i in range(images)
        for y in range(h)
        for x in range(w)
    ]
    return spark.createDataFrame(rows, "image_id long, frame long, y long, x long, r long, g long, b long, a long")


def _params(spark, images=2, **columns):
    return spark.range(images).withColumnRenamed("id", "image_id").withColumns({c: F.lit(v) for c, v in columns.items()})


def _same(a, b):
    return sorted(map(tuple, digest(a).collect())) == sorted(map(tuple, digest(b).collect()))


def test_flip_twice_is_identity(spark):
    p = _image(spark)
    q = _params(spark, w=9, h=7, flip_h=True, flip_v=True)
    assert _same(px.flip(px.flip(p, q), q), p)


def test_four_quarter_turns_are_identity(spark):
    p = _image(spark)
    wide, tall = _params(spark, w=9, h=7, angle=90), _params(spark, w=7, h=9, angle=90)
    assert _same(px.rotate(px.rotate(px.rotate(px.rotate(p, wide), tall), wide), tall), p)


def test_pack_and_pad_then_trim_are_identity(spark):
    p = _image(spark)
    assert _same(px.unpack(px.pack(p)), p)
    border = _params(spark, w=9, h=7, canvas_w=15, canvas_h=12, off_x=3, off_y=2)
    none = F.lit(None).cast("long")
    q = _params(spark, w=15, h=12, threshold=0, equal_h=False, equal_v=False).withColumns(
        {"colour_r": none, "colour_g": none, "colour_b": none}
    )
    assert _same(px.trim(px.embed(p, border), q), p)


def test_constant_image_stays_constant(spark):
    p = _image(spark).withColumns({c: F.lit(77).cast("long") for c in px.BANDS})
    sized = px.resize(p, _params(spark, w=9, h=7, w_scale=1.7, h_scale=0.4))
    assert sized.agg(F.min("r"), F.max("a"), F.count("*")).collect()[0] == (77, 77, 2 * 15 * 3)
    plan = spark.createDataFrame([(i, 9, 7, 1.0, 0.5, 0, False) for i in range(2)], "rendition long, width int, height int, blur double, sharpen double, pixelate int, premultiplied boolean")
    soft = rn.to_pixels(rn.filter_lines(rn.to_lines(p).withColumnRenamed("image_id", "rendition"), plan), "rendition")
    assert soft.agg(F.min("g"), F.max("b"), F.count("*")).collect()[0] == (77, 77, 126)


def test_pixelate_blocks_larger_than_the_image(spark):
    p = _image(spark, w=5, h=3)
    plan = spark.createDataFrame([(i, 5, 3, 0.0, 0.0, 40, False) for i in range(2)], "rendition long, width int, height int, blur double, sharpen double, pixelate int, premultiplied boolean")
    once = rn.to_pixels(rn.filter_lines(rn.to_lines(p).withColumnRenamed("image_id", "rendition"), plan), "rendition")
    assert once.select("rendition", "r").distinct().count() == 2


def test_hash_of_a_large_image_is_resampled(spark):
    p = _image(spark, w=70, h=10, images=1)
    got = sim.pack_hash(sim.dct_hash(p, _params(spark, 1, w=70, h=10, grey=False))).collect()[0].hash
    assert len(got) == 192
    direct = px.resize(p, _params(spark, 1, w=70, h=10, w_scale=64 / 70, h_scale=1.0))
    assert direct.agg(F.max("x"), F.max("y")).collect()[0] == (63, 9)


def test_near_duplicates_match_brute_force(spark):
    """A third of the images are exact copies; the rest lie at every distance."""
    base = [[float((i * j) % 11) for j in range(64)] for i in range(20)]
    crowd = [[5.0] * 64 for _ in range(10)]
    rows = [(i, h) for i, h in enumerate(base + crowd)]
    limit = 20.0
    got = sim.near_duplicates(spark.createDataFrame(rows, "image_id long, hash array<double>"), limit)
    firsts = {}
    for i, h in rows:
        firsts.setdefault(tuple(h), i)
    distinct = sorted((i, h) for h, i in firsts.items())
    want = {
        (a, b)
        for a, p in distinct
        for b, q in distinct
        if a < b and sum((x - y) ** 2 for x, y in zip(p, q)) / 64 <= limit
    }
    assert {(r.a, r.b) for r in got.collect()} == want
    assert len(want) > 5


def test_lines_of_odd_pixels(spark):
    """Nulls, values beyond a byte and repeated pixels keep their place and text."""
    rows = [(0, 0, 0, 2, 1, 2, 3, 4), (0, 0, 0, 0, 300, 0, 0, 65535), (0, 0, 0, 1, None, 7, 8, 9), (0, 0, 0, 1, 0, 0, 0, 255), (0, 0, 0, 1, 0, 0, 0, 255)]
    p = spark.createDataFrame(rows, "image_id long, frame long, y long, x long, r long, g long, b long, a long")
    got = px.line_text(p, ";").collect()[0]
    assert (got.line, got.n) == ("300,0,0,65535;0,0,0,255;0,0,0,255;7,8,9;1,2,3,4", 5)
    assert px.line_text(p.where("x = 2"), bands=("b", "g", "r")).collect()[0].line == "030201"
    assert [tuple(c) for c in px.pack(p).collect()[0].px] == [(300, 0, 0, 65535), (None, 7, 8, 9), (0, 0, 0, 255), (0, 0, 0, 255), (1, 2, 3, 4)]


def test_no_pixels_or_plans_are_broadcast(spark, sf_dir):
    """Both sides of a join grow with the input; an exploded table passes for a small one."""
    from gravure.registry.pixels import QUERIES

    for name in ("e03_trim", "e04_crop", "e05_smart_crop", "e13_embed", "e14_extend", "e16_pad", "e18_replicate"):
        tree = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in tree or "ShuffledHashJoin" in tree, name
        assert name in ("e14_extend", "e16_pad") or "BroadcastHashJoin" not in tree, name


def test_hashes_are_not_broadcast(spark, sf_dir):
    """Hashes are many times as large as the keys that they are computed from, which is what the planner goes by."""
    from gravure.registry.similarity import QUERIES

    tree = QUERIES["k03_hash_distance"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in tree and "BroadcastHashJoin" not in tree


def test_hash_of_lines_is_that_of_pixels(spark):
    """Scanlines of small, grey, large and repeated images, some lines short or outside, hash like their pixels."""
    some = _image(spark, w=9, h=7, images=3).where("NOT (image_id = 1 AND y = 3 AND x > 5)")
    some = some.withColumn("a", F.col("x") * 20).unionByName(_image(spark, w=70, h=10, images=1).withColumn("image_id", F.lit(7).cast("long")))
    again = some.where("image_id = 0").withColumn("r", 255 - F.col("r"))
    p, lines = some.unionByName(again), rn.to_lines(some).unionByName(rn.to_lines(again))
    q = spark.createDataFrame([(0, 9, 7, False), (1, 9, 7, False), (2, 8, 6, True), (2, 8, 6, True), (7, 70, 10, False), (9, 9, 7, False)], "image_id long, w int, h int, grey boolean")
    want = {tuple(r)[:4]: r.coef for r in sim.dct_hash(p, q).collect()}
    got = {tuple(r)[:4]: r.coef for r in sim.dct_hash(lines, q).collect()}
    assert got.keys() == want.keys() and len(got) == 192 * 3 + 64
    assert max(abs(got[k] - want[k]) for k in got) < 1e-6
    packed = {r.image_id: r.hash for r in sim.pack_hash(sim.dct_hash(lines, q, long=False)).collect()}
    assert {i: len(h) for i, h in packed.items()} == {0: 192, 1: 192, 2: 64, 7: 192}
    assert all(abs(packed[i][64 * c + 8 * v + u] - x) < 2e-6 for (i, c, v, u), x in want.items())


def test_scanlines_are_the_pixels(spark, tmp_path):
    """The lines that queries start from hold the pixels of the relation; a part without a key has lines without pixels."""
    from gravure.registry.fixtures import table
    from gravure.registry.pixels import scanlines

    spark.createDataFrame([(1,), (5,), (30003,), (None,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    lines, sf = scanlines(spark, str(tmp_path)), str(tmp_path)
    want = rn.to_lines(table(spark, sf, "pixels").where("image_id IS NOT NULL"))
    assert sorted(map(tuple, lines.where("image_id IS NOT NULL").collect())) == sorted(map(tuple, want.collect()))
    assert [(r.y, bytes(r.px)) for r in lines.where("image_id IS NULL").orderBy("y").collect()] == [(y, b"") for y in range(16)]


def test_tiles_of_lines_are_those_of_pixels(spark):
    """Scanlines are tiled like pixel rows, images and parameters that come repeatedly too; nothing is unpacked."""
    p, q = _image(spark, w=9, h=7, images=3), spark.createDataFrame([(0, 9, 7, 31, 20), (1, 9, 7, 5, 4), (2, 9, 7, 9, 30), (2, 9, 7, 9, 30)], "image_id long, w int, h int, cover_w int, cover_h int")
    for centred in (True, False):
        lines = rn.to_lines(p).unionByName(rn.to_lines(p.where("image_id = 1").withColumn("g", 255 - F.col("g"))))
        pixels = p.unionByName(p.where("image_id = 1").withColumn("g", 255 - F.col("g")))
        tiled = px.replicate(lines, q, centred)
        assert "px" in tiled.columns
        assert _same(tiled, px.replicate(pixels, q, centred))


def test_watermark_of_lines_equals_pixels(spark):
    """Lines under a mark that lies across the left edge, has a gap and leaves some lines alone."""
    image = _image(spark)
    mark = spark.createDataFrame(
        [(x, y, x * 40, y * 60, 200, (x * 31 + y * 17) % 256) for x in range(4) for y in range(3) if (x, y) != (2, 1)],
        "mx long, my long, mr long, mg long, mb long, ma long",
    )
    layout = _params(spark, wm_left=-1, wm_top=2, wm_opacity=0.7, mark_w=4, mark_h=3)
    lines = px.watermark(rn.to_lines(image), mark, layout)
    assert lines.columns == ["image_id", "frame", "y", "px"]
    assert _same(lines, px.watermark(image, mark, layout))


def test_pieces_hold_the_pixels(spark):
    """Scanlines put on a canvas and trimmed give the pixels that pixel rows give: repeated lines and parameters, gaps, canvases that cut, tall images."""
    p = _image(spark, w=9, h=7, images=4).where("NOT (image_id = 1 AND y = 3) AND NOT (image_id = 2 AND y = 2 AND x > 5)")
    p = p.withColumn("a", F.col("x") * 20).unionByName(_image(spark, w=5, h=150, images=1).withColumn("image_id", F.lit(8).cast("long")))
    again = p.where("image_id = 3").withColumn("r", 255 - F.col("r"))
    pixels, lines = p.unionByName(again), rn.to_lines(p).unionByName(rn.to_lines(again)).repartition(3)
    rows = [(0, 9, 7, 15, 12, 3, 2), (1, 9, 7, 12, 9, 0, 2), (2, 9, 7, 10, 10, 0, 0), (3, 9, 7, 12, 9, 2, 1), (8, 5, 150, 9, 160, 2, 4), (9, 4, 3, 6, 5, 1, 1)]
    for more in ([], [(0, 9, 7, 11, 9, 1, 1), (2, 9, 7, 6, 5, -2, -1)]):
        q = spark.createDataFrame(rows + more, "image_id long, w int, h int, canvas_w int, canvas_h int, off_x int, off_y int")
        pieces = px.embed(lines, q)
        assert pieces.where("whole").count() == (0 if more else 1)
        assert _same(pieces, px.embed(pixels, q))
        t = q.select("image_id", F.col("canvas_w").alias("w"), F.col("canvas_h").alias("h"), F.lit(5).alias("threshold"), *[F.when(F.col("image_id") == 1, F.lit(0)).alias(f"colour_{c}") for c in px.COLOUR], (F.col("image_id") == 2).alias("equal_h"), (F.col("image_id") == 0).alias("equal_v"))
        assert _same(px.trim(pieces, t), px.trim(px.embed(pixels, q), t))
    same = _params(spark, 9, w=9, h=7, threshold=30, equal_h=False, equal_v=True).withColumns({f"colour_{c}": F.lit(None).cast("int") for c in px.COLOUR})
    assert _same(px.trim(lines, same), px.trim(pixels, same))


def test_borders_and_trims_are_not_exchanged_by_pixels(spark, sf_dir):
    from gravure.registry.pixels import QUERIES

    for name in ("e03_trim", "e13_embed"):
        tree = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in tree and "explode([0,1,2,3,4,5" not in tree, name
