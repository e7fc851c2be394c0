"""Importance resampling towards a target text collection, with hashed n-gram features counted by distinct lines."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravure.llm.common import freed, slices, stored, texts

#: Words in a feature at most; hash buckets; words that a drawn document has; percentage drawn; seed of the noise.
WIDTH, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of a slice of texts: what its vectors take is a small multiple.
SLICE = 2 << 20
#: Lower-casing of A-Z alone; which bytes stand in words: 0-9, a-z and all of characters beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True


class Words:
    """The words of some texts: distinct words, each word's number, and each text's bounds among them."""

    def __init__(self, column: pa.Array):
        column = pc.cast(column, pa.large_string())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        whole = column.buffers()[2] if len(column) else None
        data = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        data = LOWER[data]
        inside = INSIDE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts = np.flatnonzero(first)
        offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        coded = found.dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        self.index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.bounds = np.searchsorted(starts, bounds)
        self.row = np.repeat(np.arange(len(column)), np.diff(self.bounds))

    def features(self, width: int, buckets: int, group: np.ndarray | None = None):
        """(row, bucket) of every run of 1 to `width` consecutive words of a text, repeats included, one array pair per length.

        With `group` (a number per word), only runs that do not stand in one group.
        """
        for size in range(1, width + 1):
            at = np.arange(max(0, len(self.index) - size + 1))
            at = at[self.row[at] == self.row[at + size - 1]]
            if group is not None:
                at = at[group[at] != group[at + size - 1]]
            if not len(at):
                continue
            if size == 1:
                hashes = np.fromiter(map(zlib.crc32, self.names), np.int64, len(self.names))
                yield self.row[at], hashes[self.index[at]] % buckets
                continue
            runs = np.stack([self.index[at + k] for k in range(size)], axis=1)
            distinct, back = np.unique(runs, axis=0, return_inverse=True)
            hashes = np.fromiter((zlib.crc32(b" ".join([self.names[k] for k in run])) for run in distinct.tolist()), np.int64, len(distinct))
            yield self.row[at], hashes[back.reshape(-1)] % buckets


def of_lines(column: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of whole texts, and for each word the number of its line (cut at newlines) among all lines."""
    lists = pc.split_pattern(column, "\n")
    lines = lists.flatten()
    offsets = lists.offsets.to_numpy()
    inner = Words(lines)
    whole = Words(column)
    counts = np.diff(inner.bounds)
    return whole, np.repeat(np.arange(offsets[0], offsets[0] + len(lines)), counts)


def bucket_counts(rows: DataFrame, width: int, buckets: int, crossing: bool = False) -> DataFrame:
    """(bucket, n): features of `rows` (text, times), each row counted `times` times; with `crossing` only those over line ends."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, "text", SLICE):
            times = part.column("times").to_numpy(zero_copy_only=False)
            words, group = of_lines(texts(part)) if crossing else (Words(texts(part)), None)
            for row, bucket in words.features(width, buckets, group):
                if times.max() == 1:
                    total += np.bincount(bucket, minlength=buckets)
                else:
                    np.add.at(total, bucket, times[row])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    return rows.select("text", "times").mapInArrow(freed(run), "bucket long, n long")


def feature_counts(rows: DataFrame, width: int, buckets: int) -> np.ndarray:
    """How many features of all of `rows` (text) fall into each bucket.

    Texts are cut into lines, equal lines of all texts are counted (before the shuffle, too, so that a
    frequent line is no hot key) and the features of a line are computed once, whatever its occurrences;
    features over line ends come from the whole texts. What reaches the driver is one number a bucket.
    """
    lines = rows.select(F.explode(F.split("text", "\n")).alias("text")).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    counted = bucket_counts(lines, width, buckets)
    if width > 1:
        counted = counted.union(bucket_counts(rows.select("text", F.lit(1).cast("long").alias("times")), width, buckets, crossing=True))
    total = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's share of each bucket over the source's, one added to each bucket."""
    buckets, s, t = len(source), source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, width: int, seed: int) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of each row of `docs` (doc_id, text).

    In a slice of texts, equal lines are weighed once; runs over line ends are added for each text.
    """
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = held.value
        for part in slices(batches, "text", SLICE):
            column = texts(part)
            lists = pc.split_pattern(column, "\n")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            line = coded.indices.to_numpy(zero_copy_only=False)
            words = Words(coded.dictionary)
            sums = np.zeros((3, len(coded.dictionary)), np.int64)
            sums[0] = np.diff(words.bounds)
            for row, bucket in words.features(width, len(gain)):
                sums[1] += np.bincount(row, minlength=sums.shape[1])
                np.add.at(sums[2], row, gain[bucket])
            ends = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(sums[:, line], axis=1)], axis=1)
            found = ends[:, offsets[1:] - offsets[0]] - ends[:, offsets[:-1] - offsets[0]]
            if width > 1:
                whole, group = of_lines(column)
                for row, bucket in whole.features(width, len(gain), group):
                    found[1] += np.bincount(row, minlength=len(column))
                    np.add.at(found[2], row, gain[bucket])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    first = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((first + 0.5) / 4294967296.0))).cast("long")
    weighed = rows.mapInArrow(freed(run), "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, draw: int) -> DataFrame:
    """Adds `rank`: 1, 2, ... for the `draw` highest scores of `rows` (doc_id, score), else null. Ties: smaller doc_id, null last.

    Rows are ordered by ranges over all tasks and written; a row's rank is its number in its range plus
    the rows of the ranges before, of which the driver gets one count each. Equal rows may get either rank.
    """
    session = rows.sparkSession
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranges = int(session.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    sizes = {r["range"]: r["n"] for r in placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for number in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(number, 0)
    own = F.array(*[F.lit(n).cast("long") for n in before])[F.shiftright("place", 33).cast("int")] + F.expr("place % 8589934592") + 1
    return placed.withColumn("rank", F.when(own <= draw, own)).drop("place")


def resample(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank for each row of `docs` (doc_id, text), drawn to resemble `target` (text).

    A-Z are lower-cased; words are runs of 0-9, a-z and characters beyond ASCII; features are all runs of
    1 to `width` words, repeats included, hashed by crc32 into `buckets`. A document's weight is the sum of
    its features' gains (see gains), its score the weight and a Gumbel noise from sha256 of `<seed>:<doc_id>`.
    Of the documents with at least `least` words, `percent` in a hundred (rounded down) of the highest
    scores are drawn and ranked.

    Null and empty texts have no features and weight 0, and are not drawn; a null doc_id is written as
    nothing after the colon and ranks last among equal scores; repeated rows are documents of their own,
    with ranks of their own; very long texts and lines take memory in proportion to their length in one
    task; an empty table gives no rows, an empty target only lowers what is frequent; columns besides
    doc_id and text are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string"))
    gain = gains(feature_counts(rows, width, buckets), feature_counts(target.select(F.col("text").cast("string")), width, buckets))
    scored = stored(weigh(docs, gain, width, seed))
    able = F.col("n_words") >= least
    draw = scored.where(able).count() * percent // 100
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return ranked(scored.where(able), draw).select(*columns).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*columns))


#: Check SQL of the registered query. A crc32 is a fold over bytes with the byte table of its reflected polynomial.
SQL = f"""
WITH bits AS (
  SELECT b, list_reduce([b::BIGINT] || range(8), lambda v, k: CASE WHEN v % 2 = 1 THEN xor({0xEDB88320}, v // 2) ELSE v // 2 END) AS v FROM range(256) t(b)
), byte_table AS (SELECT list(v ORDER BY b) AS tab FROM bits),
found AS (
  SELECT 'source' AS side, rowid AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM (SELECT text, row_number() OVER () AS rowid FROM documents)
  UNION ALL SELECT 'target', 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark
), hashed AS (
  SELECT word, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(word))::BIGINT), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
    lambda v, b: xor(tab[1 + xor(v, b) % 256], v // 256))) % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM found), byte_table
), counted AS (
  SELECT bucket, count(*) FILTER (side = 'source') AS s, count(*) FILTER (side = 'target') AS t FROM found JOIN hashed USING (word) GROUP BY bucket
), whole AS (SELECT sum(s) AS s, sum(t) AS t FROM counted),
gains AS (
  SELECT bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (w.s + {BUCKETS})::DOUBLE / ((c.s + 1)::DOUBLE * (w.t + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM counted c, whole w
), weighed AS (
  SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM found JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'source' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM (SELECT doc_id, row_number() OVER () AS rowid FROM documents) LEFT JOIN weighed ON id = rowid
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= n * {PERCENT} // 100 THEN place END AS rank FROM placed
"""
