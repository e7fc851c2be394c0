"""Token counts through a digest cache: known texts are joined, only distinct unknown ones are encoded."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravure.llm.common import scratch, slices, stored, texts
from gravure.llm.words import WordTable, distinct_words, gather, split_words

PIECE_BPE = "piece_bpe_32k.model"
CACHE = "digest binary, version string, n_tokens long"


class PieceCounter:
    """Token counts of the piece vocabulary.

    None of its pieces has a space mark after another character (checked when loaded), so merges never
    cross from a word into the space before the next: a text of words parted by single spaces has the
    sum of its words' tokens. Every other text is encoded whole.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        self.by_word = not any("▁" in name.lstrip("▁") for name in names)
        self.words = WordTable(self._count)

    def _count(self, words: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(words), 4096):
            coded = self.model.encode(words[start : start + 4096], num_threads=1)
            out += [len(ids).to_bytes(4, "little") for ids in coded]
        return out

    def __call__(self, column: pa.Array) -> np.ndarray:
        odd = pc.match_substring_regex(column, "^ | $|  |▁").to_numpy(zero_copy_only=False)
        odd |= not self.by_word
        counts = np.zeros(len(column), np.int64)
        words, bounds = split_words(column.filter(pa.array(~odd)))
        names, index = distinct_words(words)
        flat, _ = gather(self.words.values(names), index, bounds, "<u4")
        sums = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
        counts[~odd] = np.diff(sums[bounds])
        for at in np.flatnonzero(odd):
            counts[at] = len(self.model.encode(column[at].as_py()))
        return counts


@functools.lru_cache(1)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def model_version(path: str) -> str:
    """Digest of the tokenizer's file: another vocabulary never meets the counts of this one."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def read_cache(spark, cache: str, version: str) -> DataFrame | None:
    """Counts stored for this tokenizer, one row per digest; None where nothing was stored yet."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    known = stored.where(F.col("version") == version)
    return known.groupBy(F.col("digest").alias("known")).agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) per row of `docs` (doc_id, text).

    `cache` is a folder that all executors share. Content is the whole text, null as empty; no other
    normalisation is applied, as any could change a count. Its SHA-256 and the SHA-256 of the
    tokenizer's file are joined to the stored counts; each distinct content that is missing is encoded
    once and appended. Appending twice (a retried job, two writers) is harmless: equal digests have equal
    counts. Equal texts are folded before the shuffle, so a crowd of copies costs one row per task.

    Repeated rows each give a row; null doc_ids stay; an empty table gives no rows (and stores none);
    columns besides doc_id and text are ignored. Begin, end or special tokens are not added.
    """
    spark = docs.sparkSession
    where = path or public_tokenizers.path(PIECE_BPE)
    version = model_version(where)
    content = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"), content.alias("text"))

    def encode(batches):
        for part in slices(batches, "text"):
            counts = counter(where)(texts(part))
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([version] * part.num_rows), pa.array(counts)], names=["digest", "version", "n_tokens"])

    missing = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    known = read_cache(spark, cache, version)
    if known is not None:
        missing = missing.join(known, F.col("digest") == F.col("known"), "left_anti")
    missing.select("digest", "text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    known = stored(read_cache(spark, cache, version))
    rows = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = rows.join(known, F.col("digest") == F.col("known"), "left")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def new_cache(spark) -> str:
    return scratch(spark)
