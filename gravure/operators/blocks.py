"""Blocks of scanlines: the lines of some rows of an image as one row, to meet what reads them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

#: Rows of a block.
BLOCK = 64
#: An image that more than this ask for is read in several tasks, each with so many of them or so.
CROWD = 20_000


def _runs(batches):
    """Lines of a block that come together, as one row: `head` has frame, y and length of each. No frame is the least number."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        px = batch.column("px")
        px = px.fill_null(b"") if px.null_count else px
        ends = np.frombuffer(px.buffers()[1], np.int32)[px.offset : px.offset + n + 1]
        frame = batch.column("frame")
        head = np.stack([frame.fill_null(-(1 << 31)).to_numpy(), batch.column("y").to_numpy(), np.diff(ends)], axis=1).astype(np.int32)
        image, block = batch.column("image_id"), batch.column("block").to_numpy()
        other = pc.not_equal(image.slice(1), image.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool) | (np.diff(block) != 0)
        starts = np.concatenate([[0], np.flatnonzero(other) + 1])
        cuts = np.append(starts, n).astype(np.int32)
        heads = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((cuts * 12).astype(np.int32)), pa.py_buffer(head.tobytes())])
        data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.ascontiguousarray(ends[cuts])), px.buffers()[2]])
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays([image.take(at), batch.column("block").take(at), heads, data], names=["image_id", "block", "head", "px"])


def meet(lines: DataFrame, wanted: DataFrame, how: str = "inner") -> DataFrame:
    """wanted(image_id, block, ...) with `parts`, all lines(image_id, frame, y, px) of that block; those above the image are in its first.

    Lines are exchanged once. An image that many ask for has its blocks copied, so that they spread.
    """
    block = F.expr(f"CAST(greatest(0, y) div {BLOCK} AS BIGINT)").alias("block")
    rows = lines.where("image_id IS NOT NULL AND y IS NOT NULL").select("image_id", block, F.col("frame").cast("int").alias("frame"), F.col("y").cast("int").alias("y"), "px")
    schema = StructType([rows.schema["image_id"], *StructType().add("block", LongType()).add("head", BinaryType()).add("px", BinaryType()).fields])
    runs, keys = rows.mapInArrow(_runs, schema), ["image_id", "block"]
    shares = F.expr(f"CAST(ceil(count / {CROWD}) AS INT) AS shares")
    crowds = wanted.groupBy("image_id").count().where(F.col("count") > CROWD).select("image_id", shares).collect()
    if crowds:
        shares = F.broadcast(lines.sparkSession.createDataFrame(crowds, StructType([wanted.schema["image_id"], *StructType().add("shares", IntegerType()).fields])))
        own = F.hash(*[c for c in wanted.columns if c not in keys])
        wanted = wanted.withColumn("share", own).join(shares, "image_id", "left").withColumn("share", F.expr("CAST(pmod(share, coalesce(shares, 1)) AS INT)")).drop("shares")
        runs = runs.join(shares, "image_id", "left").withColumn("share", F.explode(F.expr("sequence(0, coalesce(shares, 1) - 1)"))).drop("shares")
        keys = [*keys, "share"]
    blocks = runs.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct("head", "px")).alias("parts"))
    return wanted.join(blocks.hint("merge"), keys, how)


def frames_of(parts: list[dict] | None, low: int, high: int) -> Iterator[tuple[int | None, np.ndarray, np.ndarray | list[bytes]]]:
    """frame, y of each line and the lines (an array where all lines of the block are equally long) of rows low..high, in order."""
    parts = parts or []
    head = np.frombuffer(b"".join(part["head"] for part in parts), np.int32).reshape(-1, 3)
    data = parts[0]["px"] if len(parts) == 1 else b"".join(part["px"] for part in parts)
    sizes = head[:, 2]
    if not len(head):
        return
    order = np.lexsort((head[:, 1], head[:, 0]))
    even = (sizes == sizes[0]).all()
    if even:
        values = np.frombuffer(data, np.uint8).reshape(len(head), -1, 4)
        if (np.diff(order) != 1).any():
            head, values = head[order], values[order]
    else:
        starts, head = (np.cumsum(sizes) - sizes)[order].tolist(), head[order]
    kept = np.flatnonzero((head[:, 1] >= low) & (head[:, 1] <= high))
    for group in np.split(kept, np.flatnonzero(np.diff(head[kept, 0])) + 1) if len(kept) else ():
        frame = int(head[group[0], 0])
        own = (values[group[0] : group[-1] + 1] if len(group) == group[-1] - group[0] + 1 else values[group]) if even else [data[starts[k] : starts[k] + int(head[k, 2])] for k in group]
        yield None if frame == -(1 << 31) else frame, head[group, 1], own


def pieces_of(parts: list[dict] | None, low: int, high: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """frame, y and pixels [rows, columns, 4] of lines that follow each other and are equally long; repeated lines stand alone."""
    for frame, ys, lines in frames_of(parts, low, high):
        width = lambda k: lines.shape[1] if isinstance(lines, np.ndarray) else len(lines[k]) // 4
        starts = [0] + [k for k in range(1, len(ys)) if ys[k] != ys[k - 1] + 1 or width(k) != width(k - 1)]
        for start, stop in zip(starts, [*starts[1:], len(ys)]):
            own = lines[start:stop] if isinstance(lines, np.ndarray) else np.frombuffer(b"".join(lines[start:stop]), np.uint8).reshape(stop - start, -1, 4) if width(start) else None
            if own is not None and own.size:
                yield frame, int(ys[start]), own
