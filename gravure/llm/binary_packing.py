"""Packing by powers of two: every sequence is one piece of one document, cut to a binary length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravure.llm import word_ids
from gravure.llm.common import freed, slices, texts

WINDOW = 4096


def binary_lengths(total: int, window: int = WINDOW) -> list[int]:
    """`total` as whole windows and then falling powers of two, one per set bit of the rest."""
    rest = total % window
    return [window] * (total // window) + [1 << bit for bit in range(window.bit_length() - 2, -1, -1) if rest >> bit & 1]


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = 2, path: str | None = None, ids: bool = True) -> DataFrame:
    """One row per piece of `docs` (doc_id, text), in document order.

    A document is its word-vocabulary ids (tokenizers, no special tokens added) and `end_id`. It is
    split into binary lengths, the largest first, so no sequence crosses documents and none needs
    padding: `length` is a power of two up to `window`, `sequence_id` has one piece at `offset` 0, and
    sequences of equal `length` make the buckets from which batches are drawn. `ids` (with ids=True)
    is the piece as little-endian unsigned 32-bit integers.

    Null and empty texts are the single id `end_id`; repeated rows and equal or null doc_ids are packed
    each on its own; very long texts only give more pieces; an empty table gives no rows; columns besides
    doc_id and text are ignored. Sequence ids are distinct and depend only on the input splits: nothing
    is shuffled, so a task run again after a lost executor makes the same rows.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    where = path or word_ids.default_path()
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if ids else "")
    names = [f.split()[0] for f in fields.split(", ")]

    def cut(batches):
        coder = word_ids.WordIds(where)
        for part in slices(batches, "text", 1 << 20):
            keys = part.column("doc_id").to_pylist()
            out = [[] for _ in names]
            for key, row in zip(keys, coder.with_end(texts(part), end_id)):
                data, start = memoryview(row.astype("<u4").tobytes()), 0
                for length in binary_lengths(len(row), window):
                    piece = data[4 * start : 4 * (start + length)]
                    values = (key, start, length, zlib.crc32(piece), len(row), bytes(piece) if ids else None)
                    for column, value in zip(out, values):
                        column.append(value)
                    start += length
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(cut), fields)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes sequences with their ids, one folder per length, from which batches of equal length are read."""
    packed.write.partitionBy("length").parquet(path)


def batches(packed: DataFrame, tokens: int) -> DataFrame:
    """Adds `batch`: sequences of one length, `tokens` ids (a power of two) each, without a global order.

    Number of a sequence among those of its length and input split, divided by the batch's size; the
    last batch of a length and split may be short.
    """
    from pyspark.sql import Window

    split = F.shiftright(F.col("sequence_id"), 33)
    order = Window.partitionBy("length", split).orderBy("sequence_id")
    number = F.floor((F.row_number().over(order) - 1) * F.col("length") / tokens)
    return packed.withColumn("batch", F.concat_ws("-", F.col("length"), split, number))


def decode(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")
