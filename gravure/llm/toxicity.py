"""Toxicity by class-conditional Kneser-Ney models of the letters of words: length-normalised log-likelihood ratios.

N-grams stay inside words, between marks of their start and end. Let over word ends, as a trial of the same
evidence on held-out documents showed, the first words of pairs hide the second: the area under the curve of the
best word fell from 0.95 to 0.94, and with six bytes to 0.92.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravure.llm.common import freed, remainder, slices, stored, texts
from gravure.llm.words import WordTable, distinct_words, split_words

#: Bytes of an n-gram; absolute discount; start and end marks of a word.
ORDER, DISCOUNT, START, END = 5, 0.75, 2, 3
#: The final scale from likelihoods to a probability is fitted on at most about this many labelled documents.
CALIBRATION = 20_000
#: What a text's score rests on besides the prior, see `evidence`; all but the last are ratios and never count against a text.
EVIDENCE = ("whole", "first", "next", "more", "words")
#: Bytes that are added to a word's length when its ratio is normalised, so that two letters are no evidence.
PRIOR_LENGTH = 16
#: One in FOLDS of the learning documents is kept out of the counts until that fit is done.
FOLDS = 5


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of START word END (zeros before START), and each word's number of them."""
    rows = [w.encode() for w in words]
    lead = bytes(ORDER - 2) + bytes([START])
    data = np.frombuffer(b"".join(lead + r + bytes([END]) for r in rows), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
    codes = data.copy()
    for step in range(1, ORDER):
        codes[step:] |= data[:-step] << 8 * step
    keep = np.ones(len(codes), bool)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    for step in range(ORDER - 1):
        keep[starts + step] = False
    return codes[keep], sizes


def words_of(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of lower-cased texts without marks at their ends, the words' numbers, texts' bounds.

    Nothing between two spaces and marks alone are no words.
    """
    words, bounds = split_words(pc.replace_substring_regex(pc.utf8_lower(column), r"[\t-\r]", " "))
    names, index = distinct_words(words)
    trimmed = pc.utf8_trim(pa.array(names, pa.string()), ".,;:!?\"'()[]{}<>*_-")
    again, number = distinct_words(trimmed)
    if not len(number):
        return again, index, bounds
    real = np.array([bool(name) for name in again])[number[index]]
    return again, number[index][real], np.concatenate([[0], np.cumsum(real)])[bounds]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): in how many (document, different word) pairs of each class an n-gram stands."""

    def run(batches):
        for part in slices(batches, "text"):
            label = part.column("toxic").to_numpy(zero_copy_only=False)
            names, index, bounds = words_of(texts(part))
            rows = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            pairs = np.unique(rows * max(1, len(names)) + index)
            row, word = pairs // max(1, len(names)), pairs % max(1, len(names))
            codes, sizes = grams_of(names)
            found, at = np.unique(codes, return_inverse=True)
            sums = []
            for cls in (1, 0):
                per_word = np.bincount(word[label[row] == cls], minlength=len(names))
                sums.append(np.bincount(at, weights=np.repeat(per_word, sizes), minlength=len(found)).astype(np.int64))
            some = (sums[0] + sums[1]) > 0
            yield pa.RecordBatch.from_arrays([pa.array(found[some]), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["gram", "toxic", "ordinary"])

    summed = labelled.select("text", "toxic").mapInArrow(freed(run), "gram long, toxic long, ordinary long")
    return summed.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def low(gram: str | Column, size: int) -> Column:
    """The last `size` bytes of an n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * size) - 1))


def shared_backoff(grams: DataFrame) -> DataFrame:
    """(type, below): Kneser-Ney probability of the last byte of each n-gram of ORDER - 1 bytes after the others.

    Continuation counts are those of both classes together: in how many different longer contexts an
    n-gram stands. Interpolated down to equal shares of the 256 bytes.
    """
    levels = []
    types = grams.select(F.col("gram").alias("type"))
    for size in range(ORDER - 1, 0, -1):
        types = stored(types.groupBy(low("type", size).alias("type")).agg(F.count(F.lit(1)).alias("n")))
        levels.append((size, types))
    below = None
    for size, types in reversed(levels):
        whole = types.groupBy(F.shiftright("type", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        rows = types.withColumn("of", F.shiftright("type", 8)).join(whole, F.col("of") == F.col("context"))
        if below is None:
            rows = rows.withColumn("lower", F.lit(1 / 256))
        else:
            rows = rows.withColumn("shorter", low("type", size - 1)).join(below.toDF("at", "lower"), F.col("shorter") == F.col("at"))
        chance = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + DISCOUNT * F.col("kinds") / F.col("total") * F.col("lower")
        below = rows.select("type", chance.alias("below"))
    return stored(below)


@dataclass
class Model:
    """Log-likelihood ratios (toxic over ordinary) of seen n-grams and of unseen ones after seen contexts.

    After a context that neither class has seen, both back off to the same shared counts: ratio zero.
    """

    grams: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray
    weights: np.ndarray | None = None

    def word_ratios(self, words: list[str]) -> list[bytes]:
        """Sum over a word's n-grams, and their number, as two float32."""
        codes, sizes = grams_of(words)
        out = np.zeros(len(codes))
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.contexts, codes >> 8), len(self.contexts) - 1)
            out = np.where(self.contexts[at] == codes >> 8, self.backoff[at], 0.0)
            at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
            out = np.where(self.grams[at] == codes, self.ratio[at], out)
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0], np.cumsum(out)])
        pairs = np.stack([sums[ends] - sums[ends - sizes], sizes], axis=1).astype("<f4")
        return [row.tobytes() for row in pairs]


def build(grams: DataFrame) -> Model:
    """The model of counted n-grams (gram, toxic, ordinary), computed by joins on contexts and shorter n-grams.

    The finished ratios come to the driver, 12 bytes for each different n-gram and context.
    """
    names = ("toxic", "ordinary")
    sums = [F.sum(c).alias(f"{c}_total") for c in names] + [F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in names]
    rest = [F.when(F.col(f"{c}_total") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(F.lit(1.0)).alias(f"{c}_rest") for c in names]
    contexts = stored(grams.groupBy(F.shiftright("gram", 8).alias("context")).agg(*sums).select("context", *[f"{c}_total" for c in names], *rest))
    rows = grams.withColumn("of", F.shiftright("gram", 8)).join(contexts, F.col("of") == F.col("context"))
    rows = rows.withColumn("shorter", low("gram", ORDER - 1)).join(shared_backoff(grams), F.col("shorter") == F.col("type"))
    chance = [F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"{c}_total"), F.lit(1)) + F.col(f"{c}_rest") * F.col("below") for c in names]
    seen = rows.select("gram", (F.log(chance[0]) - F.log(chance[1])).cast("float").alias("ratio")).orderBy("gram").toArrow()
    after = contexts.select("context", (F.log("toxic_rest") - F.log("ordinary_rest")).cast("float").alias("backoff")).orderBy("context").toArrow()
    return Model(seen.column("gram").to_numpy(), seen.column("ratio").to_numpy(), after.column("context").to_numpy(), after.column("backoff").to_numpy())


def evidence(model: Model, table: WordTable, column: pa.Array) -> np.ndarray:
    """Per text: the length-normalised log-likelihood ratios (toxic over ordinary) of the text and of its words.

    Columns: 1; ratio per byte of the whole text; largest ratio of a word, over its bytes and PRIOR_LENGTH; mean of
    the second to fourth and of the fifth to eighth largest of its different words (zero where there are fewer, or
    less); logarithm of the number of different words, as the largest of many words are larger by chance.
    """
    names, index, bounds = words_of(column)
    out = np.zeros((len(column), 1 + len(EVIDENCE)))
    out[:, 0] = 1
    if not len(names):
        return out
    pairs = np.frombuffer(b"".join(table.values(names)), "<f4").reshape(-1, 2).astype(float)
    rows = np.repeat(np.arange(len(column)), np.diff(bounds))
    length = np.bincount(rows, weights=pairs[index, 1], minlength=len(column))
    out[:, 1] = np.bincount(rows, weights=pairs[index, 0], minlength=len(column)) / np.maximum(length, 1)
    different = np.unique(rows * len(names) + index)
    row, ratio = different // len(names), (np.maximum(pairs[:, 0], 0) / (pairs[:, 1] + PRIOR_LENGTH))[different % len(names)]
    number = np.bincount(row, minlength=len(column))
    order = np.lexsort((-ratio, row))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    top = np.zeros((len(column), 8))
    top[row[rank < 8], rank[rank < 8]] = ratio[order][rank < 8]
    out[:, 2], out[:, 3], out[:, 4], out[:, 5] = top[:, 0], top[:, 1:4].mean(axis=1), top[:, 4:].mean(axis=1), np.log1p(number)
    return out


def fit(features: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic weights by damped Newton steps with a small ridge, none below zero for a ratio; prior only where one class is missing."""
    weights = np.zeros(features.shape[1])
    share = (label.sum() + 0.5) / (len(label) + 1)
    weights[0] = np.log(share / (1 - share))
    if not 0 < label.sum() < len(label):
        return weights
    scale = np.maximum(features.std(axis=0), 1e-9)
    scale[0] = 1
    rows = features / scale
    use = features.std(axis=0) > 0
    use[0] = True

    def loss(w):
        return np.logaddexp(0, np.where(label == 1, -1, 1) * (rows @ w)).sum() + 0.05 * (w[1:] ** 2).sum()

    while True:
        own, ridge = rows[:, use], np.diag(0.1 * (np.flatnonzero(use) > 0))
        found = np.zeros(rows.shape[1])
        found[0] = weights[0]
        for _ in range(100):
            chance = 1 / (1 + np.exp(-np.clip(rows @ found, -35, 35)))
            slope = own.T @ (chance - label) + ridge @ found[use]
            step = np.zeros_like(found)
            step[use] = np.linalg.solve((own * (chance * (1 - chance))[:, None]).T @ own + ridge + 1e-9 * np.eye(own.shape[1]), slope)
            size = 1.0
            while size > 1e-6 and loss(found - size * step) > loss(found):
                size /= 2
            found -= size * step
            if np.abs(size * step).max() < 1e-8:
                break
        wrong = (found < 0) & use
        wrong[0] = wrong[-1] = False
        if not wrong.any():
            return found / scale
        use &= ~wrong


def _measure(held, rows: DataFrame) -> DataFrame:
    def run(batches):
        model = held.value
        table = WordTable(model.word_ratios)
        for part in slices(batches, "text"):
            found = evidence(model, table, texts(part))
            arrays = [part.column("toxic"), *(pa.array(found[:, i]) for i in range(1, found.shape[1]))]
            yield pa.RecordBatch.from_arrays(arrays, names=["toxic", *EVIDENCE])

    return rows.select("toxic", "text").mapInArrow(freed(run), ", ".join(["toxic int", *(f"{name} double" for name in EVIDENCE)]))


def train(docs: DataFrame, labels: DataFrame, sample: int = CALIBRATION) -> Model:
    """A model of the rows of `docs` (doc_id, text) that `labels` (doc_id, toxic) marks 0 or 1.

    The scale to a probability is fitted on one fold in FOLDS (by crc32 of the id), on at most about `sample`
    documents chosen by hash, with the counts of the others; then that whole fold is counted too. Several labels of one id:
    the largest. Null ids, labels and texts teach nothing. Every n-gram counted is in the model, at every size. Totals,
    continuation counts and ratios are computed by Spark; the finished ratios are broadcast, so what the driver and each
    task hold grows with the different n-grams of the labelled texts (12 bytes each). No labels: every score is one
    half's prior.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").alias("marked")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.hint("merge")  # labels grow with the corpus: they are shuffled at every size, never broadcast
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.floor(remainder(F.col("doc_id"), 4 * FOLDS) / 4) == 0
    pairs = stored(gram_counts(known.where(~fold).join(marks, F.col("doc_id") == F.col("marked"))))
    model = build(pairs)
    share = known.sparkSession
    count = marks.where(F.floor(remainder(F.col("marked"), 4 * FOLDS) / 4) == 0).count()
    part = min(1.0, sample / max(1, count))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000
    rows = known.where(fold & chosen).join(marks, F.col("doc_id") == F.col("marked"))
    measured = _measure(share.sparkContext.broadcast(model), rows).toArrow()
    features = np.stack([np.ones(len(measured)), *(measured.column(c).to_numpy() for c in EVIDENCE)], axis=1)
    held = gram_counts(known.where(fold).join(marks, F.col("doc_id") == F.col("marked")))
    whole = build(stored(pairs.union(held).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))))
    whole.weights = fit(features, measured.column("toxic").to_numpy().astype(float))
    return whole


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """The columns `keep`, score (0 to 1, higher: toxic likelier) and predicted (1 from `threshold` on).

    Each whole text is scored where it is, by its length-normalised log-likelihoods under the toxic and
    the ordinary model and those of its words. Null and empty texts have no evidence: their score is that of
    the prior. Repeated rows, empty tables and extra columns need no care; only `keep` is passed on.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    passed = [f"_{i}" for i in range(len(keep))]

    def run(batches):
        model = held.value
        table = WordTable(model.word_ratios)
        for part in slices(batches, "_text"):
            found = evidence(model, table, texts(part, "_text"))
            chance = 1 / (1 + np.exp(-np.clip(found @ model.weights, -35, 35)))
            arrays = [part.column(c) for c in passed] + [pa.array(chance), pa.array((chance >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    columns = [F.col(c).alias(p) for c, p in zip(keep, passed)]
    return docs.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(freed(run), schema)


def training_part(docs: DataFrame, divisor: int = 4, held_out: int = 2) -> DataFrame:
    """Rows whose crc32(doc_id) modulo `divisor` is known and is not `held_out`."""
    return docs.where(remainder(F.col("doc_id"), divisor) != held_out)
