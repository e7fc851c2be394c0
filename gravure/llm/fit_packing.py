"""Best-fit-decreasing packing of token ids, with a segment tree over free room."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravure.llm import word_ids
from gravure.llm.common import freed, slices, texts

WINDOW = 4096
#: Bytes of text that are packed together; with about a thousand documents the bins are all but full.
SHARD_BYTES = 4 << 20


class RoomTree:
    """Open bins by free room; finds the least sufficient room in log(window) steps."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        at = room + self.size
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, bin) of the smallest room of at least `least`."""
        at = least + self.size
        while not self.some[at]:
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            if at <= 1:
                return None
            at += 1
        while at < self.size:
            at = 2 * at + (not self.some[2 * at])
        room = at - self.size
        number = self.bins[room].pop()
        if not self.bins[room]:
            while at and not (self.some[at] and at < self.size and (self.some[2 * at] or self.some[2 * at + 1])):
                self.some[at] = 0
                at >>= 1
        return room, number


def best_fit(lengths: list[int], window: int = WINDOW) -> list[int]:
    """Bin of each piece: longest first, each into the bin whose room it fits most tightly."""
    tree, count, bins = RoomTree(window), 0, [0] * len(lengths)
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[piece])
        room, number = found or (window, count)
        count += found is None
        bins[piece] = number
        if room > lengths[piece]:
            tree.add(room - lengths[piece], number)
    return bins


FIELDS = "shard long, row long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = 2, pad_id: int = 0, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of the packed id matrix of `docs` (doc_id, text).

    A document is its word-vocabulary ids and `end_id`. Longer ones are split losslessly into pieces of
    `window` and a rest. Documents are dealt to shards by hash; in each shard, pieces go by best fit
    decreasing into rows of `window` ids. A row (shard, row) holds input_ids (little-endian unsigned 16-bit
    where ids allow, see `matrix`), padded by pad_id beyond n_tokens; cu_seqlens (0, then each segment's
    end); position_resets (where positions start again at 0); doc_ids and starts (the ids of its document
    before it) of each segment.

    The shards' number follows from the bytes of text, so that a group of copies or one source, however
    large, is dealt over all of them; equal rows are told apart by a running number. Null and empty texts
    are the single id end_id; null doc_ids stay null; an empty table gives no rows; columns besides doc_id
    and text are ignored. One very long document is packed by one task. Ids beyond 65 535 raise an error.
    """
    where = path or word_ids.default_path()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text")) + F.count(F.lit(1))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)))

    names = [f.split()[0] for f in FIELDS.split(", ")]

    def packed(shard: int, pieces: list, owners: list, starts: list) -> pa.RecordBatch:
        bins = best_fit([len(p) for p in pieces], window)
        members: list[list[int]] = [[] for _ in range(max(bins, default=-1) + 1)]
        for piece, number in enumerate(bins):
            members[number].append(piece)
        out = [[] for _ in range(7)]
        for inside in members:
            ends = np.cumsum([len(pieces[i]) for i in inside]).tolist()
            line = np.full(window, pad_id, "<u2")
            line[: ends[-1]] = np.concatenate([pieces[i] for i in inside])
            values = (ends[-1], [owners[i] for i in inside], [starts[i] for i in inside], [0, *ends], [0, *ends[:-1]], line.tobytes())
            for column, value in zip(out[1:], values):
                column.append(value)
        n = len(members)
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        arrays = [pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int64())] + [pa.array(v, k) for v, k in zip(out[1:], kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def fill(batches):
        coder, shard, rows = word_ids.WordIds(where), None, ([], [], [])
        for batch in slices(batches, "text", 1 << 20):
            for number, owner, ids in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), coder.with_end(texts(batch), end_id)):
                if number != shard and rows[0]:
                    yield packed(shard, *rows)
                    rows = ([], [], [])
                shard = number
                if ids.max() > 65_535:
                    raise ValueError("ids of this vocabulary need more than 16 bits")
                for start in range(0, len(ids), window):
                    for column, value in zip(rows, (ids[start : start + window].astype("<u2"), owner, start)):
                        column.append(value)
        if rows[0]:
            yield packed(shard, *rows)

    return dealt.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(freed(fill), FIELDS)


def matrix(rows, window: int = WINDOW) -> np.ndarray:
    """input_ids of collected or read rows as a matrix of ids."""
    return np.stack([np.frombuffer(r["input_ids"], "<u2") for r in rows]).reshape(-1, window)


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrix as Parquet, one folder of rows; a job that is run again replaces it."""
    packed.write.mode("overwrite").parquet(path)
