"""Embedding near-duplicates: int8 tile products with rigorous error bounds, exact cosines where needed."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravure.llm.common import stored
from gravure.llm.components import components

#: Vectors per pivot of the index, pivots at most (a 4096 x d matrix is what tasks get).
PER_PIVOT, MOST_PIVOTS = 1024, 4096
#: Rows of a cell that one task compares; larger cells are cut into tiles of two blocks.
BLOCK = 2048
#: Rows of the second block that are multiplied at once.
STRIP = 512


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and the exact length of what the codes leave out, per row."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each row of `a` with each of `b` (unit rows, double) reaches `threshold`.

    With x = x' + e, y = y' + f (x', y' quantised) the product is at most
    x'.y' + |e||y'| + |f||x'| + |e||f|. Pairs whose bound, with the largest e and f of the block and what float32 rounds
    off, stays below the threshold are done; the others are computed in double precision, those nearest to it one by one.
    """
    qa, sa, ea = quantise(a)
    qb, sb, eb = quantise(b)
    ea, eb = float(ea.max()), float(eb.max())
    slack = ea * (1 + eb) + (1 + ea) * eb + ea * eb + (a.shape[1] + 8) * 2.0**-22 * (1 + ea) * (1 + eb)
    near = (qa * sa[:, None]).astype(np.float32) @ (qb * sb[:, None]).astype(np.float32).T >= np.float32(threshold - slack)
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return near
    if np.count_nonzero(near[rows]) * 16 > len(rows) * len(b):
        cosine = a[rows] @ b.T
        near[rows] = cosine >= threshold
        i, j = np.nonzero(np.abs(cosine - threshold) < 1e-12)
        i = rows[i]
    else:
        i, j = np.nonzero(near[rows])
        i = rows[i]
    for start in range(0, len(i), 100_000):
        x, y = i[start : start + 100_000], j[start : start + 100_000]
        near[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
    return near


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a symmetric link matrix, breadth first."""
    links, rest = [], near.any(axis=1)
    while rest.any():
        seed = int(rest.argmax())
        rest[seed] = False
        frontier = np.array([seed])
        while len(frontier):
            reach = near[frontier] & rest
            hit = np.flatnonzero(reach.any(axis=0))
            links += zip(frontier[reach[:, hit].argmax(axis=0)].tolist(), hit.tolist()) if len(hit) else ()
            rest[hit] = False
            frontier = hit
    return links


def packed(vectors: np.ndarray) -> bytes:
    """Components in single precision where that loses nothing, else in double."""
    with np.errstate(over="ignore", under="ignore"):
        single = vectors.astype("<f4")
    return (single if (single == vectors).all() else vectors.astype("<f8")).tobytes()


def unpacked(values: list[bytes], d: int) -> np.ndarray:
    """Rows of `packed` vectors of `d` components each."""
    out = np.empty((len(values), d))
    for kind, size in (("<f4", 4 * d), ("<f8", 8 * d)):
        at = [k for k, v in enumerate(values) if len(v) == size]
        out[at] = np.frombuffer(b"".join(values[k] for k in at), kind).reshape(-1, d)
    return out


def usable(column: str = "embedding"):
    """Whether a vector has a direction: no null or non-finite component and a non-zero one."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def apart(unit: np.ndarray, cosine: float) -> np.ndarray:
    """Rows in turn that are no nearer to any row taken before than `cosine`."""
    taken = np.empty_like(unit)
    n = 0
    for row in unit:
        if not n or (taken[:n] @ row).max() < cosine:
            taken[n] = row
            n += 1
    return taken[:n].copy()


def visited(cosine: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The home (nearest pivot) of vectors with these cosines to the pivots, and whether each visits each pivot's cell.

    Of two linked vectors let y, of home q, be the one farther from its pivot. The other's home p is within that
    angle and the angle of `threshold` of y, and the other lies on p's side of the plane between p and q, so y is
    no farther from this plane than the angle of `threshold`. y visits all pivots that meet both: no link is missed.
    """
    home = cosine.argmax(axis=1)
    best = np.take_along_axis(cosine, home[:, None], 1)
    near, sine = np.clip(best, -1, 1), np.sqrt(max(0.0, 1 - threshold**2))
    least = np.where(near <= -threshold, -1.0, threshold * near - sine * np.sqrt(1 - near**2))
    goes = cosine >= least - 1e-9
    if threshold > 0:
        goes &= best - cosine <= sine * np.sqrt(np.maximum(0, 2 - 2 * pivots[home] @ pivots.T)) + 1e-9
    return home, goes


def near_embeddings(rows: DataFrame, threshold: float = 0.95, per_pivot: int = PER_PIVOT, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept per row of `rows` (vec_id, embedding).

    n_links is the number of other rows linked directly (cosine of at least `threshold` in double
    precision), component_id the smallest vec_id reachable, kept whether that is the row itself.

    Equal vectors are folded first. The index is a bounded sample of vectors as pivots (one per
    `per_pivot` distinct vectors, at most MOST_PIVOTS, chosen by hash), thinned so that no two are within twice the
    angle of `threshold`: a crowd of near-copies has one pivot, not many that its members rank at random. Each vector
    lives in the cell of its nearest pivot and visits all others that a linked vector nearer to its own may have as
    home (`visited`). Two vectors of different homes are compared once, where the one nearer to its pivot lives, so every
    link is found. Where vectors lie at random, in no groups, few cells can be ruled out and the products grow with the square. Cells with more than `block`
    residents or visitors are cut into tiles of two blocks, residents with residents and residents with visitors;
    a tile gives a count per vector and a spanning forest, never its pairs.

    Vectors that are null, zero or hold null or non-finite components link with nothing, and vectors of
    different lengths are never compared. Repeated rows are rows of their own that link with each other; null vec_ids
    take part, and the smallest id ignores them; an empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    given = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    marked = given.withColumn("node", F.when(usable(), F.xxhash64(F.transform("embedding", lambda x: x + F.lit(0.0)), F.size("embedding"))))
    folded = stored(marked.where("node IS NOT NULL").groupBy("node").agg(F.first("embedding").alias("v"), F.size(F.first("embedding")).alias("d"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first")))
    sizes = {row["d"]: row["count"] for row in folded.groupBy("d").count().collect()}
    pivots = {}
    for d, count in sizes.items():
        wanted = min(MOST_PIVOTS, math.ceil(count / per_pivot))
        share = min(1.0, 2 * (wanted + 10) / count)
        picked = folded.where((F.col("d") == d) & (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) <= share * (1 << 30)))
        sample = picked.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(wanted).select("v").toArrow().column("v").to_pylist()
        pivots[d] = apart(unit_rows(np.array(sample or [np.ones(d)])), 2 * max(0.0, threshold) ** 2 - 1)
    held = spark.sparkContext.broadcast(pivots)

    def visit(batches):
        for part in batches:
            of = part.column("d").to_numpy()
            cells: list[list[int]] = [[]] * part.num_rows
            data, best = [b""] * part.num_rows, np.zeros(part.num_rows)
            values = part.column("v")
            for d in np.unique(of):
                at = np.flatnonzero(of == d)
                own = values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                unit = unit_rows(own)
                for start in range(0, len(at), 1024):
                    cosine = unit[start : start + 1024] @ held.value[d].T
                    home, near = visited(cosine, held.value[d], threshold)
                    best[at[start : start + 1024]] = cosine.max(axis=1)
                    for k, first, row, vector in zip(at[start : start + 1024], home.tolist(), near, own[start : start + 1024]):
                        cells[k] = [first, *(c for c in np.flatnonzero(row).tolist() if c != first)]
                        data[k] = packed(vector)
            kept = {c: part.column(c) for c in ("node", "d", "weight")}
            yield pa.RecordBatch.from_pydict(kept | {"v": pa.array(data, pa.binary()), "best": pa.array(best), "cells": pa.array(cells, pa.list_(pa.int32()))})

    placed = stored(folded.select("node", "v", "d", "weight").mapInArrow(visit, "node long, d int, weight long, v binary, best double, cells array<int>"))
    exploded = placed.select("node", "v", "d", "weight", "best", F.col("cells")[0].alias("home"), F.explode("cells").alias("cell")).withColumn("lives", F.col("cell") == F.col("home"))
    # two rows for each pivot at most
    crowds = {f"{r['d']} {r['cell']} {r['lives']}": math.ceil(r["count"] / block) for r in exploded.groupBy("d", "cell", "lives").count().where(F.col("count") > block).collect()}
    many = F.create_map(*[F.lit(x) for pair in (crowds or {"": 1}).items() for x in pair])

    def blocks(lives: str):
        return F.coalesce(F.element_at(many, F.concat_ws(" ", "d", "cell", F.lit(lives))), F.lit(1))

    # Blocks of residents are numbered first, then those of visitors; two blocks of visitors never meet.
    exploded = exploded.withColumn("here", blocks("True")).withColumn("guests", blocks("False"))
    own = F.pmod(F.xxhash64("node", F.lit(9)), F.when(F.col("lives"), F.col("here")).otherwise(F.col("guests"))).cast("int")
    exploded = exploded.withColumn("own", F.when(F.col("lives"), own).otherwise(own + F.col("here")))
    meets = F.expr("transform(sequence(0, IF(lives, here + guests, here) - 1), o -> struct(least(own, o) AS i, greatest(own, o) AS j))")
    tiles = exploded.select("*", F.explode(meets).alias("tile"))
    tiles = tiles.select("node", "v", "d", "weight", "best", "lives", "own", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), F.xxhash64("d", "cell", "tile.i", "tile.j").alias("tile"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, weight, best = (table.column(c).to_numpy() for c in ("node", "weight", "best"))
        own, lives = table.column("own").to_numpy(), table.column("lives").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        order = np.lexsort((node, -best))
        left, right = order[own[order] == i], order[own[order] == j]
        n, links = np.zeros(len(node), np.int64), []
        if len(left) and len(right):
            unit = unit_rows(unpacked(table.column("v").to_pylist(), table.column("d")[0].as_py()))
            guests = not lives[right[0]]
            near = np.zeros((len(left), len(right)), bool)
            for start in range(0, len(right), STRIP):
                strip = right[start : start + STRIP]
                # A pair of different homes is met where the one nearer to its pivot lives.
                most = np.searchsorted(-best[left], -best[strip[-1]], side="right") if guests else len(left)
                if most:
                    near[:most, start : start + STRIP] = linked(unit[left[:most]], unit[strip], threshold)
            if i == j:
                np.fill_diagonal(near, False)
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            near, left, right = near[np.ix_(rows, columns)], left[rows], right[columns]
            if guests and len(left):
                x, y = best[left][:, None], best[right]
                near &= (x > y) | (x == y) & (node[left][:, None] < node[right])
            n[left] += near @ weight[right]
            if i != j:
                n[right] += weight[left] @ near
                both = np.zeros((len(left) + len(right),) * 2, bool)
                both[: len(left), len(left) :] = near
                near = both | both.T
                left = np.concatenate([left, right])
            links = [(left[x], left[y]) for x, y in forest(near)]
        some = np.flatnonzero(n)
        a = np.concatenate([node[some], node[[x for x, _ in links]]]) if links else node[some]
        b = pa.array([None] * len(some) + node[[y for _, y in links]].tolist() if links else [None] * len(some), pa.int64())
        return pa.Table.from_arrays([pa.array(a), b, pa.array(np.concatenate([n[some], np.zeros(len(links), np.int64)]))], names=["a", "b", "n"])

    found = stored(tiles.groupBy("tile").applyInArrow(compare, "a long, b long, n long"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    named = folded.select("node", "weight", "first").withColumnRenamed("node", "at").join(roots.withColumnRenamed("node", "placed"), F.col("at") == F.col("placed"), "left")
    named = stored(named.select("at", "weight", "first", F.coalesce("root", "at").alias("root")).join(links, F.col("at") == F.col("of"), "left").select("at", "weight", "first", "root", F.coalesce("n", F.lit(0)).alias("n")))
    smallest = stored(named.groupBy(F.col("root").alias("top")).agg(F.min("first").alias("component")))
    full = stored(named.join(smallest, F.col("root") == F.col("top")).select("at", "weight", "n", "component"))
    joined = marked.select("vec_id", "node").join(full, F.col("node") == F.col("at"), "left")
    component = F.when(F.col("at").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return joined.select("vec_id", F.coalesce(F.col("n") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
