"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(1)
def local_folder() -> str:
    return tempfile.mkdtemp(prefix="gravure-llm-")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; a local folder only where unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = local_folder()
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id, divisor: int):
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each slice hold about `most` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def freed(run):
    """`run` for mapInArrow, giving what it held back to the system when a task ends: workers outlive their tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not glibc
            pass

    return wrapped


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A text column with empty texts for nulls."""
    return pc.fill_null(batch.column(column), "")
