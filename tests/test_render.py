"""Renditions against a plain whole-image renderer in numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gravure.operators import blocks
from gravure.operators import render as rd
from gravure.operators import renditions as rn
from gravure.plans import geometry as g
from gravure.session import cut_lineage

FACTS = {
    1: (70, 150, 1, 1, True), 2: (33, 20, 6, 1, False), 3: (24, 16, 1, 3, True), 4: (130, 40, 3, 1, True),
}
REQUEST = {
    "width": 0, "height": 0, "resizing_type": "fit", "min_width": 0, "min_height": 0, "zoom_w": 1.0, "zoom_h": 1.0, "dpr": 1.0, "enlarge": False,
    "extend": False, "extend_ar": False, "rotate": 0, "auto_rotate": True, "flip_h": False, "flip_v": False, "crop_w": 0.0, "crop_h": 0.0,
    "crop_type": "ce", "crop_x": 0.0, "crop_y": 0.0, "gravity_type": "ce", "gravity_x": 0.0, "gravity_y": 0.0, "extend_type": "ce", "extend_x": 0.0,
    "extend_y": 0.0, "extend_ar_type": "ce", "extend_ar_x": 0.0, "extend_ar_y": 0.0, "pad_top": 0, "pad_right": 0, "pad_bottom": 0, "pad_left": 0,
    "max_dim": 0, "format": "png", "wm_opacity": 0.0, "wm_position": "ce", "wm_x": 0.0, "wm_y": 0.0, "wm_scale": 0.0, "blur": 0.0, "sharpen": 0.0,
    "pixelate": 0, "opaque": False, "bg_r": 255, "bg_g": 170, "bg_b": 0, "trim_threshold": -1.0, "trim_equal_h": False, "trim_equal_v": False,
}
REQUESTS = [
    (1, {}),
    (1, {"width": 30, "height": 40, "resizing_type": "fill", "gravity_type": "no", "gravity_x": 3.0}),
    (1, {"width": 30, "height": 30, "rotate": 90, "flip_h": True, "blur": 1.2}),
    (1, {"crop_w": 40.0, "crop_h": 90.0, "crop_type": "sm", "width": 30, "sharpen": 0.7, "opaque": True}),
    (1, {"width": 50, "height": 60, "resizing_type": "fill", "gravity_type": "sm", "pixelate": 7, "rotate": 180}),
    (1, {"trim_threshold": 20.0, "width": 25, "trim_equal_h": True}),
    (1, {"trim_threshold": 20.0, "crop_w": 20.0, "crop_h": 25.0, "crop_type": "sm"}),
    (2, {"width": 60, "enlarge": True, "pad_top": 4, "pad_left": 3, "pad_right": 1, "wm_opacity": 0.5, "wm_position": "soea", "wm_x": 2.0, "wm_y": -5.0}),
    (2, {"width": 50, "height": 40, "extend": True, "extend_type": "nowe", "opaque": True, "wm_opacity": 0.8, "wm_position": "re", "wm_x": 3.0, "wm_scale": 0.3}),
    (2, {"width": 40, "height": 10, "extend_ar": True, "rotate": 270, "flip_v": True, "pixelate": 40}),
    (3, {"width": 10, "height": 10, "resizing_type": "fill", "flip_h": True, "wm_opacity": 1.0, "wm_position": "no", "wm_scale": 0.5}),
    (3, {"width": 300, "height": 280, "enlarge": True, "resizing_type": "force", "format": "ico"}),
    (3, {"gravity_type": "sm", "width": 9, "height": 16, "resizing_type": "fill"}),
    (4, {"width": 65, "height": 20, "resizing_type": "force", "dpr": 2.0, "blur": 0.5, "sharpen": 0.9, "pixelate": 3}),
    (4, {"width": 200, "height": 150, "extend": True, "rotate": 90, "opaque": True, "blur": 2.0}),
]


def picture(image: int, frame: int) -> np.ndarray:
    w, h, _, _, alpha = FACTS[image]
    rng = np.random.default_rng(image * 10 + frame)
    rgba = rng.integers(0, 256, (h, w, 4))
    if not alpha:
        rgba[..., 3] = 255
    if image == 1:
        rgba[:9], rgba[-20:], rgba[:, :5], rgba[:, -11:] = 7, 7, 7, 7
    return rgba


def mark_picture() -> np.ndarray:
    return np.random.default_rng(99).integers(0, 256, (12, 18, 4))


def rounded(v):
    return np.clip(np.floor(v + 0.5), 0, 255)


def pre(v):
    return np.concatenate([rounded(v[..., :3] * v[..., 3:] / 255), v[..., 3:]], axis=2)


def unpre(v):
    return np.concatenate([np.where(v[..., 3:] == 0, 0, rounded(v[..., :3] * 255 / np.maximum(v[..., 3:], 1))), v[..., 3:]], axis=2)


def matrix(size, out):
    m = np.zeros((out, size))
    reach = max(1.0, size / out)
    for t in range(out):
        centre = (t + 0.5) * size / out - 0.5
        for i in range(size):
            m[t, i] = max(0.0, 1 - abs(i - centre) / reach)
    return m / m.sum(axis=1, keepdims=True)


def scaled(v, w, h, alpha):
    if (w, h) == (v.shape[1], v.shape[0]):
        return v
    v = pre(v) if alpha else v
    v = np.round(np.einsum("tx,yxb->ytb", matrix(v.shape[1], w), v), 6)
    v = rounded(np.round(np.einsum("ty,yxb->txb", matrix(v.shape[0], h), v), 6))
    return unpre(v) if alpha else v


def soft(v, sigma):
    radius = math.ceil(3 * sigma)
    k = np.array([math.exp(-i * i / (2 * sigma * sigma)) for i in range(-radius, radius + 1)])
    k /= k.sum()
    for axis in (1, 0):
        padded = np.pad(v, [(radius, radius) if a == axis else (0, 0) for a in range(3)], mode="edge")
        v = np.round(sum(f * np.take(padded, np.arange(v.shape[axis]) + i, axis=axis) for i, f in enumerate(k)), 6)
    return v


def best_window(v, w, h):
    luma = (299 * v[..., 0] + 587 * v[..., 1] + 114 * v[..., 2]).astype(int) // 1000
    s = v[..., :3].max(axis=2) - v[..., :3].min(axis=2)
    s[:, 1:] += abs(np.diff(luma, axis=1))
    s[1:] += abs(np.diff(luma, axis=0))
    best = max((s[t : t + h, x : x + w].sum(), -t, -x) for t in range(v.shape[0] - h + 1) for x in range(v.shape[1] - w + 1))
    return -best[2], -best[1]


def trim_box(v, p):
    a = v[..., 3:]
    flat = np.floor((v[..., :3] * a + np.array([255, 0, 255]) * (255.0 - a)) / 255 + 0.5)
    far = abs(flat - flat[0, 0]).max(axis=2) > p["trim_threshold"]
    ys, xs = np.flatnonzero(far.any(axis=1)), np.flatnonzero(far.any(axis=0))
    left, right, top, bottom = xs[0], v.shape[1] - 1 - xs[-1], ys[0], v.shape[0] - 1 - ys[-1]
    if p["trim_equal_h"]:
        left = right = min(left, right)
    return left, top, v.shape[1] - left - right, v.shape[0] - top - bottom


def plain(p, image, frame, facts):
    """The rendition of one frame, stage by stage on the whole image."""
    v = picture(image, frame).astype(float)
    alpha = facts[4]
    if p["trim_threshold"] >= 0 and facts[3] == 1:
        x, y, w, h = trim_box(v, p)
        v = v[y : y + h, x : x + w]
    x, y = (p["crop_left"], p["crop_top"]) if p["crop_kind"] != "smart" else best_window(v, p["crop_box_w"], p["crop_box_h"])
    v = v[y : y + p["crop_box_h"], x : x + p["crop_box_w"]]
    turned = (p["angle"] + p["rotate"]) % 180 != 0
    v = scaled(v, *((p["scaled_h"], p["scaled_w"]) if turned else (p["scaled_w"], p["scaled_h"])), alpha)
    v = np.rot90(v, -(p["angle"] // 90))
    v = v[:, ::-1] if p["flip"] else v
    v = np.rot90(v, -(p["rotate"] // 90))
    v = v[:, ::-1] if p["flip_h"] else v
    v = v[::-1] if p["flip_v"] else v
    x, y = (p["box_left"], p["box_top"]) if p["box_kind"] != "smart" else best_window(v, p["box_w"], p["box_h"])
    v = v[y : y + p["box_h"], x : x + p["box_w"]]
    for name in ("blur", "sharpen"):
        if p[name] > 0:
            own = pre(v) if alpha else v
            out = rounded(soft(own, p[name])) if name == "blur" else np.concatenate([rounded(2 * own[..., :3] - soft(own, p[name])[..., :3]), own[..., 3:]], axis=2)
            v = unpre(out) if alpha else out
    if p["pixelate"] > 1:
        h, w = v.shape[:2]
        n = min(p["pixelate"], max(h, w))
        big = np.pad(v, ((0, -h % n), (0, -w % n), (0, 0)), mode="symmetric")
        for y in range(0, big.shape[0], n):
            for x in range(0, big.shape[1], n):
                big[y : y + n, x : x + n] = rounded(big[y : y + n, x : x + n].sum(axis=(0, 1)) / (n * n))
        v = big[:h, :w]
    for name in ("canvas", "aspect", "padded"):
        canvas = np.zeros((p[f"{name}_h"], p[f"{name}_w"], 4))
        canvas[p[f"{name}_top"] : p[f"{name}_top"] + v.shape[0], p[f"{name}_left"] : p[f"{name}_left"] + v.shape[1]] = v
        v = canvas
    if p["limit_scale"] < 1:
        v = scaled(v, p["result_w"], p["result_h"], True)
    if p["opaque"]:
        a = v[..., 3:]
        v = np.concatenate([np.floor((v[..., :3] * a + np.array([255, 170, 0]) * (255 - a)) / 255 + 0.5), np.full_like(a, 255)], axis=2)
    if p["wm_visible"]:
        m = scaled(mark_picture().astype(float), p["mark_w"], p["mark_h"], True)
        layer = np.zeros_like(v)
        h, w = v.shape[:2]
        if p["wm_position"] == "re":
            tile = np.zeros((p["tile_h"], p["tile_w"], 4))
            tile[p["tile_top"] : p["tile_top"] + m.shape[0], p["tile_left"] : p["tile_left"] + m.shape[1]] = m[: p["tile_h"], : p["tile_w"]]
            ny, nx = -(-h // p["tile_h"]), -(-w // p["tile_w"])
            ny, nx = ny + (ny % 2 == 0), nx + (nx % 2 == 0)
            whole = np.tile(tile, (ny, nx, 1))
            layer = whole[(whole.shape[0] - h) // 2 :][:h, (whole.shape[1] - w) // 2 :][:, :w]
        else:
            for y in range(m.shape[0]):
                for x in range(m.shape[1]):
                    if 0 <= y + p["wm_top"] < h and 0 <= x + p["wm_left"] < w:
                        layer[y + p["wm_top"], x + p["wm_left"]] = m[y, x]
        s, d = layer[..., 3:] / 255 * p["wm_opacity"], v[..., 3:] / 255
        o = s + d * (1 - s)
        mixed = (layer[..., :3] * s + v[..., :3] * d * (1 - s)) / np.where(o == 0, 1, o)
        out = np.concatenate([np.where(o == 0, 0, rounded(np.round(mixed, 6))), rounded(np.round(o * 255, 6))], axis=2)
        touched = np.zeros((h, w), bool)
        if p["wm_position"] == "re":
            touched[:] = True
        else:
            touched[max(0, p["wm_top"]) : max(0, p["wm_top"] + m.shape[0]), max(0, p["wm_left"]) : max(0, p["wm_left"] + m.shape[1])] = True
        v = np.where(touched[..., None], out, v)
    return v.astype(int)


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, f, y, bytearray(line.astype(np.uint8).tobytes())) for i, facts in FACTS.items() for f in range(facts[3]) for y, line in enumerate(picture(i, f))]
    return spark.createDataFrame(rows, "image_id long, frame int, y int, px binary")


@pytest.fixture(scope="module")
def planned(spark, lines):
    rows = []
    for n, (image, changes) in enumerate(REQUESTS):
        w, h, seen, frames, alpha = FACTS[image]
        rows.append({"rendition": f"r{n}", "image_id": image, **REQUEST, **changes, "img_w": w, "img_h": h, "orientation": seen, "frames": frames, "has_alpha": alpha, "src_format": "png"})
    df = spark.createDataFrame(rows)
    df = df.withColumns({"trim_threshold": F.when(F.col("trim_threshold") >= 0, F.col("trim_threshold")), **{f"trim_{c}": F.lit(None).cast("int") for c in "rgb"}})
    return cut_lineage(g.plan_rendition(cut_lineage(rd.trimmed_facts(df, lines)), 18, 12))


def images_of(lines, key="rendition"):
    out = {}
    for r in lines.collect():
        assert r["y"] not in out.setdefault((r[key], r["frame"]), {})
        out[r[key], r["frame"]][r["y"]] = np.frombuffer(r["px"], np.uint8).reshape(-1, 4)
    return {k: np.stack([v[y] for y in range(len(v))]) for k, v in out.items()}


def test_renditions_match_a_plain_renderer(spark, lines, planned):
    mark = spark.createDataFrame([(y, bytearray(line.astype(np.uint8).tobytes())) for y, line in enumerate(mark_picture())], "y int, px binary")
    mark = mark.withColumn("frame", F.lit(0))
    got = images_of(rd.render(lines, planned, mark))
    plans = {r["rendition"]: {**r.asDict(), "trim_threshold": -1 if r["trim_threshold"] is None else r["trim_threshold"]} for r in planned.collect()}
    assert {k for k, _ in got} == set(plans)
    for n, (image, _) in enumerate(REQUESTS):
        p = plans[f"r{n}"]
        for frame in range(FACTS[image][3]):
            want = plain(p, image, frame, FACTS[image])
            assert want.shape[:2] == (p["result_h"], p["result_w"])
            assert got[f"r{n}", frame].shape == want.shape, n
            assert (got[f"r{n}", frame] == want).all(), (n, frame, abs(got[f"r{n}", frame] - want).max())
    kinds = {(p["crop_kind"], p["box_kind"]) for p in plans.values()}
    assert {"smart"} <= {a for a, _ in kinds} and {"smart"} <= {b for _, b in kinds} and any(p["limit_scale"] < 1 for p in plans.values())


def test_trimmed_size_is_planned_anew(planned):
    trimmed = {r["rendition"]: (r["img_w"], r["img_h"], r["trim_left"], r["trim_top"]) for r in planned.collect()}
    assert trimmed["r5"] == (70 - 10, 150 - 29, 5, 9) and trimmed["r6"] == (70 - 16, 150 - 29, 5, 9) and trimmed["r0"] == (70, 150, 0, 0)


def test_one_image_gives_any_number_of_sizes(spark, lines):
    plan = spark.createDataFrame([(f"s{k}", 1, 0, 0, 70, 150, 10 * k, 200 - 40 * k) for k in range(1, 5)], "rendition string, image_id long, left long, top long, box_w long, box_h long, out_w long, out_h long")
    got = images_of(rn.scale_lines(lines, plan))
    assert {k: v.shape for k, v in got.items()} == {(f"s{k}", 0): (200 - 40 * k, 10 * k, 4) for k in range(1, 5)}
    for k in range(1, 5):
        assert (got[f"s{k}", 0] == scaled(picture(1, 0), 10 * k, 200 - 40 * k, False)).all()


def test_frames_of_results(spark, planned):
    images = spark.createDataFrame([(3, 16, 3, [10, 20, 30, 40], 2), (2, 20, 1, None, None)], "image_id long, height long, frames long, delays array<long>, loop long")
    got = rd.frame_table(planned, g.frame_boxes(images)).where("rendition = 'r10'").orderBy("frame").collect()
    assert [(r["frame"], r["top"], r["frame_h"], r["delay"], r["loop"], r["pages"]) for r in got] == [(0, 0, 10, 10, 2, 3), (1, 10, 10, 20, 2, 3), (2, 20, 10, 30, 2, 3)]


def test_awkward_tables(spark, lines, planned):
    assert rd.render(lines.limit(0), planned).where("frame >= 0 AND px IS NULL").count() == 0
    assert rd.render(lines, planned.limit(0)).count() == 0


def _small_plans(spark):
    """Canvases for renditions of image 3 (three frames, one block) and of image 1 (three blocks), turned and cut; s4 is planned twice."""
    none = {"trim_threshold": None, "trim_r": None, "trim_g": None, "trim_b": None}
    changes = [
        (3, {"width": 12, "height": 20, "extend": True, "rotate": 90}), (3, {"width": 10, "height": 10, "resizing_type": "fill", "pad_top": 2, "pad_left": 3}),
        (3, {"width": 30, "height": 9, "extend_ar": True, "enlarge": True, "flip_h": True}), (1, {"width": 30, "extend": True, "height": 50, "pad_right": 2}),
        (3, {"crop_w": 9.0, "crop_h": 7.0, "pad_bottom": 1}), (3, {"crop_w": 9.0, "crop_h": 7.0, "pad_bottom": 1}), (2, {"height": 11, "extend_ar": True, "width": 11, "opaque": True}), (5, {"width": 4, "pad_top": 3}),
    ]
    facts = {**FACTS, 5: (10, 10, 1, 1, False)}
    rows = []
    for n, (image, more) in enumerate(changes):
        w, h, seen, frames, alpha = facts[image]
        rows.append({"rendition": f"s{min(n, 4) if n < 6 else n}", "image_id": image, **REQUEST, **more, "img_w": w, "img_h": h, "orientation": seen, "frames": frames, "has_alpha": alpha, "src_format": "png"})
    kinds = {"trim_threshold": "double", "trim_r": "int", "trim_g": "int", "trim_b": "int"}
    df = spark.createDataFrame(rows).withColumns({c: F.lit(v).cast(kinds[c]) for c, v in none.items()})
    return cut_lineage(g.plan_rendition(df, 18, 12))


def _all(lines):
    return sorted((r["rendition"], r["frame"], r["y"], bytes(r["px"])) for r in lines.select("rendition", "frame", "y", "px").collect())


@pytest.mark.parametrize("crowd", (20_000, 2))
def test_strips_hold_the_lines(spark, lines, monkeypatch, crowd):
    """Renditions of one block go through canvases as strips; lines in any order, repeated renditions and crowds change nothing."""
    monkeypatch.setattr(blocks, "CROWD", crowd)
    plan, mixed = _small_plans(spark), lines.repartition(7).sortWithinPartitions(F.hash("y", "image_id"))
    strips, plain_lines = rd.result_boxes(mixed, plan, strips=True), rd.result_boxes(lines, plan)
    single = {r["rendition"] for r in strips.where("rows > 1").collect()}
    assert single == {"s0", "s1", "s2", "s6"}
    for place in (rd.extend, rd.extend_ar, rd.pad):
        strips, plain_lines = place(strips, plan), place(plain_lines, plan)
        assert _all(rn.of_strips(strips)) == _all(plain_lines)
    assert {r["rendition"] for r in strips.where("whole").collect()} == {"s6"}


def test_strips_and_lines_have_one_digest(spark, lines):
    from gravure.registry.pixels import digest_lines

    number = lambda df: df.withColumn("rendition", F.substring("rendition", 2, 9).cast("long"))
    plan = _small_plans(spark)
    strips = rd.render(lines, plan, strips=True)
    assert strips.where("whole").count() == 2
    got = digest_lines(number(strips), "req_id").collect()
    assert sorted(got) == sorted(digest_lines(number(rd.render(lines, plan)), "req_id").collect()) and len(got) == 7


def test_renditions_of_one_block_are_not_dealt_again(spark, sf_dir):
    """Lines meet plans in one join, of rows that hold the lines of a block; canvases, background and mark need no other."""
    from gravure.registry.pixels import QUERIES

    for name in ("e14_extend", "e15_extend_ar", "e16_pad", "e23_animate_map", "e24_render"):
        tree = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert tree.count("SortMergeJoin") == (3 if name == "e23_animate_map" else 1), name
        assert tree.count("Exchange") <= (10 if name == "e23_animate_map" else 4), name


def test_smart_windows_of_one_block_are_those_of_bands(spark, lines):
    """Parts of one block are scored where their lines are, others by bands; windows asked for twice too."""
    rows = [("a", 2, 0, 0, 33, 20, 9, 7), ("b", 3, 0, 0, 24, 16, 50, 50), ("c", 1, 8, 70, 60, 50, 11, 13), ("d", 1, 0, 0, 70, 150, 20, 30), ("e", 3, 2, 1, 20, 15, 3, 4)]
    for more in ([], [("f", 2, 0, 0, 33, 20, 5, 5)] * 2):
        plan = spark.createDataFrame(rows + more, "rendition string, image_id long, left long, top long, w long, h long, want_w long, want_h long")
        once = plan.where("rendition <> 'f'")
        boxes = {(r["rendition"], r["frame"]): (r["left"], r["top"], r["score"]) for r in rn.smart_boxes(lines, plan).collect() if r["rendition"] != "f"}
        assert boxes == {(r["rendition"], r["frame"]): (r["left"], r["top"], r["score"]) for r in rn._banded_boxes(lines, rn._window_plan(once)).collect()}
        assert len(boxes) == 9
        for name, image, left, top, w, h, want_w, want_h in rows:
            x, y = best_window(picture(image, 0)[top : top + h, left : left + w], min(want_w, w), min(want_h, h))
            assert boxes[name, 0][:2] == (x, y)
        strips = rn.smart_crop(lines, plan, strips=True)
        assert {r["rendition"] for r in strips.where("rows > 1").collect()} == {"a", "b", "c", "e"}
        assert [r for r in _all(rn.of_strips(strips)) if r[0] != "f"] == _all(rn._banded_smart_crop(lines, once))
        assert _all(rn.smart_crop(lines, plan)) == _all(rn.of_strips(strips))


@pytest.mark.parametrize("banded", (False, True))
def test_boxes_that_hang_over_their_canvas_are_cut(spark, lines, monkeypatch, banded):
    """A result box may be wider or higher than the canvas; the pixels within stay in their place."""
    if banded:
        monkeypatch.setattr(rd, "split", lambda plan, fits: (None, plan))
    sizes = {"s0": (24, 16, 10, 30, 4, 8), "s1": (24, 16, 40, 5, 9, 0), "s2": (24, 16, 6, 7, 0, 0), "s3": (24, 16, 30, 16, 20, 3)}
    plan = _small_plans(spark).where("rendition IN ('s0', 's1', 's2')").withColumn("rendition", F.explode(F.array(*map(F.lit, sizes)))).dropDuplicates(["rendition"])
    of = lambda k: F.coalesce(*[F.when(F.col("rendition") == n, F.lit(v[k])) for n, v in sizes.items()]).cast("long")
    zero, none = F.lit(0).cast("long"), {c: F.lit(False) for c in ("flip", "flip_h", "flip_v", "opaque")}
    plan = plan.withColumns({**none, **{c: zero for c in ("angle", "rotate", "crop_left", "crop_top", "box_left", "box_top", "aspect_left", "aspect_top", "padded_left", "padded_top")}})
    plan = plan.withColumns({"image_id": F.lit(3).cast("long"), "frames": F.lit(3).cast("long"), "crop_kind": F.lit("none"), "box_kind": F.lit("none"), "limit_scale": F.lit(1.0)})
    plan = plan.withColumns({f"{n}_w": of(0) for n in ("crop_box", "scaled", "box")} | {f"{n}_h": of(1) for n in ("crop_box", "scaled", "box")})
    plan = plan.withColumns({f"{n}_{c}": of(k) for n in ("canvas", "aspect", "padded", "result") for k, c in ((2, "w"), (3, "h"))} | {"canvas_left": of(4), "canvas_top": of(5)})
    plan = cut_lineage(plan)
    want = []
    for n, (_, _, w, h, left, top) in sizes.items():
        for frame in range(3):
            canvas = np.zeros((top + 16 + h, left + 24 + w, 4), np.uint8)
            canvas[top : top + 16, left : left + 24] = picture(3, frame)
            want += [(n, frame, y, canvas[y, :w].tobytes()) for y in range(h)]
    assert _all(rd.render(lines, plan)) == sorted(want)
    placed = rd.result_boxes(lines, plan, strips=True)
    for place in (rd.extend, rd.extend_ar, rd.pad):
        placed = place(placed, plan)
        assert _all(rn.of_strips(placed)) == sorted(want)
    assert _all(rd.extend(rd.result_boxes(lines, plan), plan)) == sorted(want)
