"""Language identification by prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravure.llm.common import freed, remainder, slices, stored, texts

ORDER = 3
#: Byte n-grams that occur less often in a language are left out of its tree, at every size of the corpus.
LEAST = 2
#: Bytes of texts that are scored together.
SLICE = 2 << 20
UNKNOWN = "und"


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, ORDER zero bytes before each, and where each text starts and ends."""
    rows = [t.encode() for t in column.to_pylist()]
    pad = bytes(ORDER)
    data = np.frombuffer(b"".join(pad + r for r in rows), np.uint8)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    ends = np.cumsum(sizes + ORDER)
    return data, ends - sizes, ends


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of ORDER + 1 bytes in a row, over all bytes of all rows of `docs` (text, lang)."""

    def run(batches):
        for part in slices(batches, "text", 2 << 20):
            langs = part.column("lang").dictionary_encode()
            of = langs.indices.to_numpy(zero_copy_only=False)
            data, starts, ends = joined(texts(part))
            grams = data.astype(np.uint32)
            for step in range(1, ORDER + 1):
                grams[step:] |= data[:-step].astype(np.uint32) << np.uint32(8 * step)
            for number, name in enumerate(langs.dictionary.to_pylist()):
                own = [grams[a:b] for a, b, k in zip(starts, ends, of) if k == number]
                found, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(freed(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """One language's context tree, as sorted arrays: of each order the n-grams seen and the contexts seen.

    An n-gram is its bytes as a number, the symbol last; its context is that number without the symbol. In a
    context the symbols seen there share total / (total + distinct), the rest escapes with
    distinct / (total + distinct) to the context without its oldest byte, where the symbols already seen are
    excluded; at last to equal shares of the bytes never seen. What is seen in a longer context is seen in
    its shorter ones, too, so what is excluded depends on the longer context alone: `start` holds the bits of a
    context's own total and escape, `below` those of the next shorter one without this one's symbols.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.grams, self.counts, self.contexts, self.totals, self.kinds = [], [], [], [], []
        for order in range(ORDER + 1):
            found, row = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(row, weights=n, minlength=len(found))
            keys, of = np.unique(found >> 8, return_inverse=True)
            self.grams.append(found)
            self.counts.append(count)
            self.contexts.append(keys)
            self.totals.append(np.bincount(of, weights=count, minlength=len(keys)))
            self.kinds.append(np.bincount(of, minlength=len(keys)))
        self.start, self.below = [], []
        for order in range(ORDER + 1):
            total, kinds = self.totals[order], self.kinds[order]
            self.start.append(self.bits(total, kinds))
            if order:
                lower = self.counts[order - 1][np.searchsorted(self.grams[order - 1], self.grams[order] & ((1 << 8 * order) - 1))]
                of = np.searchsorted(self.contexts[order], self.grams[order] >> 8)
                excluded = np.bincount(of, weights=lower, minlength=len(total))
                at = np.searchsorted(self.contexts[order - 1], self.contexts[order] & ((1 << 8 * (order - 1)) - 1))
                self.below.append(self.bits(self.totals[order - 1][at] - excluded, self.kinds[order - 1][at] - kinds))
            else:
                unseen = np.log2(np.maximum(256 - kinds, 1))
                self.below.append((unseen, unseen))

    @staticmethod
    def bits(total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of total + kinds, and of an escape; no symbol left costs nothing."""
        whole = np.log2(np.maximum(total + kinds, 1))
        return whole, np.where(kinds > 0, whole - np.log2(np.maximum(kinds, 1)), 0.0)

    def code(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each n-gram of ORDER + 1 bytes after the ones before."""
        out, waiting = np.zeros(len(grams)), np.arange(len(grams))
        whole, escape = np.zeros(len(grams)), np.zeros(len(grams))
        begun = np.zeros(len(grams), bool)
        for order in range(ORDER, -1, -1):
            if not len(self.grams[order]):
                continue
            own = grams[waiting] & ((1 << 8 * (order + 1)) - 1)
            context = np.minimum(np.searchsorted(self.contexts[order], own >> 8), len(self.contexts[order]) - 1)
            known = self.contexts[order][context] == own >> 8
            first = known & ~begun[waiting]
            whole[waiting[first]], escape[waiting[first]] = self.start[order][0][context[first]], self.start[order][1][context[first]]
            begun[waiting[first]] = True
            at = np.minimum(np.searchsorted(self.grams[order], own), len(self.grams[order]) - 1)
            seen = self.grams[order][at] == own
            hit = waiting[seen]
            out[hit] += whole[hit] - np.log2(self.counts[order][at[seen]])
            missed, context = waiting[~seen & known], context[~seen & known]
            out[missed] += escape[missed]
            whole[missed], escape[missed] = self.below[order][0][context], self.below[order][1][context]
            waiting = waiting[~seen]
        left = waiting[begun[waiting]]
        out[left] += whole[left]
        out[waiting[~begun[waiting]]] += 8
        return out


@dataclass
class Model:
    """Trees of all languages, and the bits of each one's share of the documents."""

    langs: list[str]
    trees: list[Tree]
    prior: np.ndarray

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Exact code lengths in bits of each text under each language; different n-grams are coded once."""
        data, starts, ends = joined(column)
        grams = data.astype(np.uint32)
        for step in range(1, ORDER + 1):
            grams[step:] |= data[:-step].astype(np.uint32) << np.uint32(8 * step)
        coded = pa.array(grams).dictionary_encode()
        different, index = coded.dictionary.to_numpy().astype(np.int64), coded.indices.to_numpy()
        out = np.empty((len(column), len(self.trees)))
        for k, tree in enumerate(self.trees):
            sums = np.concatenate([[0.0], np.cumsum(tree.code(different)[index])])
            out[:, k] = sums[ends] - sums[starts]
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number, its share of the posterior and its bits a byte for each text."""
        lengths = self.lengths(column)
        total = lengths + self.prior
        best = total.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(total.min(axis=1, keepdims=True) - total, -1000)).sum(axis=1)
        size = np.maximum(pc.binary_length(column).to_numpy(zero_copy_only=False), 1)
        return best, share, lengths[np.arange(len(best)), best] / size


def build(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], documents: dict[str, int]) -> Model:
    share = np.array([documents[name] for name in langs], float)
    return Model(langs, [Tree(*counts[name]) for name in langs], -np.log2(share / share.sum()))


def train(docs: DataFrame) -> Model | None:
    """A model of all rows of `docs` (text, lang) that have both; None where there are none.

    Counts are summed by Spark over all bytes; what reaches the driver, and by broadcast the tasks, is one
    number per language and n-gram of ORDER + 1 bytes that occurs LEAST times or more: it grows with the
    corpus as its different n-grams do, about 60 bytes each. A language without any such n-gram codes
    every byte in 8 bits.
    """
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    documents = {row["lang"]: row["n"] for row in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not documents:
        return None
    grams = stored(gram_counts(docs))
    counts = {}
    for name in documents:
        own = grams.where((F.col("lang") == name) & (F.col("n") >= LEAST)).select("gram", "n").toArrow()
        counts[name] = own.column("gram").to_numpy(), own.column("n").to_numpy().astype(float)
    return build(sorted(documents), counts, documents)


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred, score and bits for each row of `docs` (text).

    lang_pred is the language that codes the whole text in the fewest bits (plus those of its share of
    the training documents), score its posterior share, bits its code length per byte. Null texts and texts without a letter are `und`
    with score 0 and bits null, as is every text where nothing was learned. Repeated rows, empty tables and extra columns
    need no care: rows are scored one by one where they are, and only `keep` is passed on. Very long texts
    take memory in proportion to their length.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("bits", "double")
    passed = [f"_{i}" for i in range(len(keep))]

    def run(batches):
        model = held.value
        for part in slices(batches, "_text", SLICE):
            column = texts(part, "_text")
            known = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
            names, scores, bits = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.full(part.num_rows, np.nan)
            if model and known.any():
                best, scores[known], bits[known] = model.score(column.filter(pa.array(known)))
                for at, k in zip(np.flatnonzero(known), best):
                    names[at] = model.langs[k]
            arrays = [part.column(c) for c in passed] + [pa.array(names, pa.string()), pa.array(scores), pa.array(bits, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    columns = [F.col(c).alias(p) for c, p in zip(keep, passed)]
    return docs.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(freed(run), schema)


def training_part(docs: DataFrame, divisor: int = 3, held_out: int = 1) -> DataFrame:
    """Rows whose crc32(doc_id) modulo `divisor` is known and is not `held_out`."""
    return docs.where(remainder(F.col("doc_id"), divisor) != held_out)


def usual_bits(docs: DataFrame, model: Model) -> dict[str, float]:
    """Mean code length per byte of each learned language over rows of `docs` (text, lang) that it was not learned from."""
    own = identify(docs.where("lang IS NOT NULL").select("lang", "text"), model, ("lang",)).where("bits IS NOT NULL AND lang = lang_pred")
    return {row["lang"]: row["bits"] for row in own.groupBy("lang").agg(F.avg("bits").alias("bits")).collect()}


def strange(usual: dict[str, float], factor: float = 3.0, slack: float = 256.0):
    """Whether a text (text, lang_pred, bits) needs over `factor` times its language's usual bits, and `slack` bits more.

    The slack keeps short texts of numbers and names; a language without a measure rejects nothing.
    """
    if not usual:
        return F.lit(False)
    own = F.element_at(F.create_map(*[F.lit(x) for pair in usual.items() for x in pair]), F.col("lang_pred"))
    size = F.octet_length(F.col("text").cast("string"))
    return F.coalesce(F.col("bits") * size > factor * own * size + slack, F.lit(False))
