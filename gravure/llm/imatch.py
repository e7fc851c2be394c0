"""I-Match document fingerprints over randomised subsets of a lexicon of middling terms."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravure.llm.common import slices, stored, texts

#: A term stays in the lexicon if ln(documents / documents with it) lies in this band. The upper end bounds
#: the lexicon: with L different terms in a document on average, at most L * exp(upper) terms are so frequent.
BAND = (0.35, math.log(1000))
#: Shares of the lexicon in the subsets, and how many subsets of each share a fingerprint hashes (64 in all).
#: Small subsets tell how much of a text was edited, as large ones change with any edit.
SHARES, EACH = (1 / 16, 1 / 64, 1 / 256, 1 / 1024), 16
#: Documents of neighbouring ids that one task edits and fingerprints.
GROUP = 2048


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs in order of text and term: text numbers, and terms' 64-bit hashes as their identity.

    A term is a run of letters or digits, lower-cased.
    """
    lists = pc.split_pattern_regex(pc.utf8_lower(column), r"[^\p{L}\p{N}]+")
    bounds = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(n) for n in names], np.uint64).view(np.int64) if names else np.zeros(0, np.int64)
    rank = np.empty(len(names), np.int64)
    order = np.argsort(hashes)
    rank[order] = np.arange(len(names))
    rows = np.repeat(np.arange(len(column)), np.diff(bounds))
    pairs = np.unique(rows * max(1, len(names)) + rank[index])
    row, term = pairs // max(1, len(names)), pairs % max(1, len(names))
    real = np.array([bool(n) for n in names], bool)[order]
    some = real[term] if len(term) else np.zeros(0, bool)
    return row[some], hashes[order][term[some]]


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): number of rows of `docs` (text) with the term, over all rows and whole texts."""

    def run(batches):
        for part in slices(batches, "text", 8 << 20):
            _, terms = terms_of(texts(part))
            found, n = np.unique(terms, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Sorted term hashes and, per term, a bit for each subset that holds it."""

    terms: np.ndarray
    subsets: np.ndarray


def subsets_of(terms: np.ndarray) -> np.ndarray:
    """Membership bits by hash alone, so that a subset doesn't change when other terms come or go."""
    bits = np.zeros(len(terms), np.uint64)
    for number in range(len(SHARES) * EACH):
        seed = np.uint64(0x9E3779B97F4A7C15 * (2 * number + 1) % 2**64)
        mixed = _mix(terms.view(np.uint64) ^ seed)
        inside = mixed < np.uint64(int(SHARES[number // EACH] * 2**64))
        bits |= inside.astype(np.uint64) << np.uint64(number)
    return bits


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> Lexicon:
    """Terms of the band over all rows of `docs` (text); the driver gets only these."""
    total = docs.count()
    low, high = total * math.exp(-band[1]), total * math.exp(-band[0])
    kept = term_counts(docs).where((F.col("n") >= low) & (F.col("n") <= high)).select("term").toArrow()
    terms = np.sort(kept.column("term").to_numpy()) if total else np.zeros(0, np.int64)
    return Lexicon(terms, subsets_of(terms))


def fingerprints(column: pa.Array, held: Lexicon) -> np.ndarray:
    """One row of 32-bit hashes per text, one for each lexicon subset; 0 where the text has no term of it.

    A text without any term of the lexicon uses all its terms instead; one without terms has zeros only.
    """
    row, terms = terms_of(column)
    at = np.minimum(np.searchsorted(held.terms, terms), max(0, len(held.terms) - 1))
    inside = held.terms[at] == terms if len(held.terms) else np.zeros(len(terms), bool)
    bits = held.subsets[at] if len(held.terms) else np.zeros(len(terms), np.uint64)
    fallback = np.bincount(row[inside], minlength=len(column)) == 0
    alone = fallback[row]
    bits = np.where(alone, subsets_of(terms), bits)
    use = inside | alone
    row, bits, mixed = row[use], bits[use], _mix(terms[use].view(np.uint64))
    out = np.zeros((len(column), len(SHARES) * EACH), np.uint32)
    power = np.uint64(0x9E3779B97F4A7C15)
    powers = np.cumprod(np.full(max(1, np.bincount(row, minlength=1).max()), power), dtype=np.uint64)
    for number in range(out.shape[1]):
        member = bits >> np.uint64(number) & np.uint64(1) > 0
        rows, hashes = row[member], mixed[member]
        if not len(rows):
            continue
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        nth = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        value = _mix(np.add.reduceat(hashes * powers[nth], first))
        out[rows[first], number] = np.maximum((value >> np.uint64(32)).astype(np.uint32), 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the subsets of which at least one of two texts has terms; both without: 1."""
    some = (a > 0) | (b > 0)
    total = some.sum(axis=1)
    return np.where(total > 0, ((a == b) & some).sum(axis=1) / np.maximum(total, 1), 1.0)


def shown(rows: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in rows.astype(">u4")]


def fingerprint_documents(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id and fingerprint (8 hex digits per lexicon subset) of each row of `docs` (doc_id, text).

    Null texts count as empty. Equal texts have equal fingerprints. Repeated rows give a row each, an empty
    table none; columns besides doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = docs.sparkSession.sparkContext.broadcast(lexicon(rows, band))

    def run(batches):
        for part in slices(batches, "text"):
            found = shown(fingerprints(texts(part), held.value))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def group_ends(ids: DataFrame, size: int) -> np.ndarray:
    """Sorted ids that end the groups: about every `size`-th of `ids` (id), the largest always.

    One long per `size` rows reaches the driver (4 MB for a thousand million documents). Any existing ids
    would do, so it doesn't matter where Spark's ranges begin.
    """

    def run(batches):
        number = last = -1
        for part in batches:
            column = part.column("id").to_numpy()
            picked = column[(np.arange(number + 1, number + 1 + len(column)) % size) == size - 1]
            number += len(column)
            last = int(column[-1]) if len(column) else last
            yield pa.RecordBatch.from_arrays([pa.array(picked)], names=["id"])
        if number >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([last])], names=["id"])

    sorted_ids = ids.repartitionByRange("id").sortWithinPartitions("id")
    return np.unique(sorted_ids.mapInArrow(run, "id long").toArrow().column("id").to_numpy())


def compare_edited(docs: DataFrame, band: tuple[float, float] = BAND, group: int = GROUP) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts, and likenesses (see `likeness`).

    The edited text of a document has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document's, in descending doc_id; the smallest id is followed by the largest.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, in groups of neighbouring ids; a group also gets the document after its last.
    Null texts count as empty; a null doc_id comes last; rows of one doc_id are in order of text, each
    followed by the next; a single row is followed by itself; an empty table gives no rows; columns besides
    doc_id and text are ignored.
    """
    spark = docs.sparkSession
    lowest = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("id", F.coalesce("doc_id", lowest))
    held = spark.sparkContext.broadcast(lexicon(rows, band))
    ends = spark.sparkContext.broadcast(group_ends(rows.select("id"), group))

    @F.pandas_udf("array<int>")
    def groups(ids):
        import pandas as pd

        own = np.searchsorted(ends.value, ids.to_numpy())
        follows = (own + 1) % len(ends.value)
        is_end = ends.value[np.minimum(own, len(ends.value) - 1)] == ids.to_numpy()
        return pd.Series([[a, b] if e else [a] for a, b, e in zip(own.tolist(), follows.tolist(), is_end)])

    placed = rows.select("doc_id", "id", "text", F.posexplode(groups("id")).alias("borrowed", "group"))
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in fields.split(", ")]

    def edit(table: pa.Table) -> pa.Table:
        own = table.filter(pc.equal(table.column("borrowed"), 0)).sort_by([("id", "descending"), ("text", "ascending")])
        other = table.filter(pc.equal(table.column("borrowed"), 1)).sort_by([("id", "descending"), ("text", "ascending")])
        whole = own.column("text").to_pylist()
        following = whole[1:] + other.column("text").to_pylist()[:1]
        out = []
        for start in range(0, len(whole), 512):
            text, after = whole[start : start + 512], following[start : start + 512]
            changed = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(text, after)]
            found, edited = fingerprints(pa.array(text, pa.string()), held.value), fingerprints(pa.array(changed, pa.string()), held.value)
            last = fingerprints(pa.array(after[-1:], pa.string()), held.value)
            out.append(
                pa.Table.from_arrays(
                    [
                        own.column("doc_id").slice(start, len(text)),
                        pa.array([len(t) for t in text], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                        pa.array(shown(found)),
                        pa.array(shown(edited)),
                        pa.array(likeness(found, edited)),
                        pa.array(likeness(found, np.concatenate([found[1:], last]))),
                    ],
                    names=names,
                )
            )
        return pa.concat_tables(out)

    return placed.groupBy("group").applyInArrow(edit, fields)
