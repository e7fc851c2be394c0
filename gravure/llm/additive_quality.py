"""Quality of texts by a generalised additive model: one lookup table a feature and one a pair of features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gravure.llm.common import freed, remainder, slices, stored, texts

#: Labelled documents that a model is fitted on at most, about, chosen by hash.
SAMPLE = 20_000
#: Bins of a feature; bins of each side of a pair; pairs; rounds of boosting at most; share of each tree that is added.
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 64, 16, 6, 400, 0.1
#: Ridge of a leaf (in units of curvature); rounds without gain on the held part that end the boosting.
RIDGE, PATIENCE = 1.0, 25
FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "capitals", "digits", "marks", "symbols", "spaces", "different_words", "commonest_word",
    "different_pairs", "repeated_lines", "line_words", "symbol_ends", "short_words", "long_words", "without_letters", "words_after_stop",
)
SPACE, LETTER, CAPITAL, DIGIT, MARK, SYMBOL, START = range(7)


def byte_classes() -> np.ndarray:
    """Which classes each byte has; all code points beyond ASCII count as letters, by their first byte."""
    held = np.zeros((7, 256), bool)
    held[SPACE, [9, 10, 11, 12, 13, 32]] = True
    held[LETTER, 65:91] = held[LETTER, 97:123] = held[LETTER, 192:] = True
    held[CAPITAL, 65:91] = True
    held[DIGIT, 48:58] = True
    held[MARK, list(b".,;:!?'\"()-")] = True
    held[START] = True
    held[START, 128:192] = False
    held[SYMBOL, :128] = ~(held[SPACE] | held[LETTER] | held[DIGIT] | held[MARK])[:128]
    return held


CLASSES = byte_classes()


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def repeats(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each row has, and how often its commonest one stands there."""
    span = int(value.max()) + 1 if len(value) else 1
    pairs, times = np.unique(row * span + value, return_counts=True)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, pairs // span, times)
    return np.bincount(pairs // span, minlength=rows), most


def measure(column: pa.Array) -> np.ndarray:
    """The FEATURES of some texts, one row each; texts without a word have zeros."""
    rows = len(column)
    column = pc.cast(column, pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1] if rows else np.zeros(1, np.int64)
    whole = column.buffers()[2] if rows else None
    data = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]

    def count(mask: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return ends[bounds[1:]] - ends[bounds[:-1]]

    n = [count(CLASSES[k][data]) for k in range(7)]
    inside = ~CLASSES[SPACE][data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(bounds, starts, side="right") - 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = np.bincount(row, minlength=rows)
    letters = np.concatenate([[0], np.cumsum(CLASSES[LETTER][data], dtype=np.int64)])
    points = np.concatenate([[0], np.cumsum(CLASSES[START][data], dtype=np.int64)])
    length, with_letters = points[ends] - points[starts], letters[ends] > letters[starts]

    def words_that(mask: np.ndarray) -> np.ndarray:
        return share(np.bincount(row[mask], minlength=rows), words)

    different, commonest = repeats(row, index, rows)
    follows = np.flatnonzero(row[1:] == row[:-1])
    pair_of = index[follows] * max(1, len(coded.dictionary)) + index[follows + 1]
    pairs, _ = repeats(row[follows], np.unique(pair_of, return_inverse=True)[1], rows)
    lists = pc.split_pattern(column, "\n")
    lines = lists.flatten().dictionary_encode()
    lines_row = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
    line_at = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(lines.dictionary), 0).to_numpy(zero_copy_only=False)[line_at] if len(line_at) else np.zeros(0, bool)
    line_count = np.bincount(lines_row[full], minlength=rows)
    different_lines, _ = repeats(lines_row[full], line_at[full], rows)
    ended = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)) if len(ends) else np.zeros(0, bool)
    stops = np.bincount(row[ended], minlength=rows)
    found = np.stack([
        np.log1p(n[START]), np.log1p(words), share(np.bincount(row, weights=length, minlength=rows), words),
        share(n[LETTER], n[START]), share(n[CAPITAL], n[LETTER]), share(n[DIGIT], n[START]), share(n[MARK], n[START]), share(n[SYMBOL], n[START]), share(n[SPACE], n[START]),
        share(different, words), share(commonest, words), share(pairs, words - 1), share(line_count - different_lines, line_count), np.log1p(share(words, line_count)),
        words_that(CLASSES[SYMBOL][data[ends - 1]] if len(ends) else ended), words_that(length <= 3), words_that(length > 12), words_that(~with_letters), np.log1p(share(words, stops)),
    ], axis=1)
    found[words == 0] = 0
    return found


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `features` (array of double, see FEATURES) of each row of `docs` (text)."""
    schema = docs.select(*keep).schema.add("features", ArrayType(DoubleType()))
    passed = [f"_{i}" for i in range(len(keep))]

    def run(batches):
        for part in slices(batches, "_text", 2 << 20):
            found = measure(texts(part, "_text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES)), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), lists], names=schema.names)

    columns = [F.col(c).alias(p) for c, p in zip(keep, passed)]
    return docs.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(freed(run), schema)


def newton(slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    return -slope / (bend + RIDGE)


def gain_of(slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    return slope**2 / (bend + RIDGE)


def best_cut(slope: np.ndarray, bend: np.ndarray) -> int:
    """Bins before the cut into two leaves of the largest gain; 0 where no cut gains."""
    s, b = np.cumsum(slope), np.cumsum(bend)
    gain = gain_of(s[:-1], b[:-1]) + gain_of(s[-1] - s[:-1], b[-1] - b[:-1]) - gain_of(s[-1], b[-1])
    return int(gain.argmax()) + 1 if len(gain) and gain.max() > 1e-9 else 0


def small_tree(slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """A tree of depth two over the bins of one feature: each bin's value."""
    out = np.zeros(len(slope))
    cut = best_cut(slope, bend)
    for a, b in ((0, cut), (cut, len(slope))) if cut else ((0, len(slope)),):
        inner = a + best_cut(slope[a:b], bend[a:b])
        for lo, hi in ((a, inner), (inner, b)):
            if hi > lo:
                out[lo:hi] = newton(slope[lo:hi].sum(), bend[lo:hi].sum())
    return out


def corners(grid: np.ndarray) -> np.ndarray:
    """Sums of the four parts of a grid for every pair of cuts: (part, rows before, columns before)."""
    s = grid.cumsum(axis=0).cumsum(axis=1)
    a, left, top = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1]
    return np.stack([a, left - a, top - a, s[-1, -1] - left - top + a])


def pair_tree(slope: np.ndarray, bend: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of one cut through each of two features over their grid: each cell's value, and its gain."""
    s, b = corners(slope), corners(bend)
    gain = gain_of(s, b).sum(axis=0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out, leaf = np.empty(slope.shape), newton(s[:, i, j], b[:, i, j])
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gain[i, j] - gain_of(slope.sum(), bend.sum()))


@dataclass
class Model:
    """Bin edges of each feature, its table, and the tables of pairs over coarser bins of the same edges."""

    edges: list[np.ndarray]
    base: float
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    grids: np.ndarray

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def coarse(self, bins: np.ndarray) -> np.ndarray:
        """Bins of pairs: those of the features, several in one where there are more than PAIR_BINS."""
        most = np.array([max(PAIR_BINS, len(e) + 1) for e in self.edges])
        return bins * PAIR_BINS // most

    def logit(self, bins: np.ndarray) -> np.ndarray:
        """Sums of table entries."""
        total = np.full(len(bins), self.base)
        for k, table in enumerate(self.tables):
            total += table[bins[:, k]]
        coarse = self.coarse(bins)
        for (a, b), grid in zip(self.pairs, self.grids):
            total += grid[coarse[:, a], coarse[:, b]]
        return total

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(values)), -35, 35)))


def edges_of(values: np.ndarray) -> np.ndarray:
    """Cuts between at most BINS bins of about equal numbers of rows."""
    return np.unique(np.quantile(values, np.arange(1, BINS) / BINS))


class Boosting:
    """One fit: cycles over the features, each time one shallow tree on that feature's gradient sums, then over pairs."""

    def __init__(self, model: Model, bins: np.ndarray, label: np.ndarray):
        self.model, self.bins, self.label = model, bins, label
        self.coarse = model.coarse(bins)
        self.total = model.logit(bins)

    def sums(self, cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        chance = 1 / (1 + np.exp(-np.clip(self.total, -35, 35)))
        return np.bincount(cells, weights=chance - self.label, minlength=size), np.bincount(cells, weights=chance * (1 - chance), minlength=size)

    def cycle(self) -> None:
        for k in range(self.bins.shape[1]):
            tree = RATE * small_tree(*self.sums(self.bins[:, k], BINS))
            self.model.tables[k] += tree
            self.total += tree[self.bins[:, k]]

    def grid(self, a: int, b: int) -> tuple[np.ndarray, float]:
        slope, bend = self.sums(self.coarse[:, a] * PAIR_BINS + self.coarse[:, b], PAIR_BINS**2)
        return pair_tree(slope.reshape(PAIR_BINS, -1), bend.reshape(PAIR_BINS, -1))

    def choose_pairs(self, most: int) -> list[tuple[int, int]]:
        """Pairs of features whose tree gains most on what the features alone leave."""
        k = self.bins.shape[1]
        gains = sorted(((-self.grid(a, b)[1], a, b) for a in range(k) for b in range(a + 1, k)))
        return [(a, b) for gain, a, b in gains[:most] if gain < 0]

    def pair_cycle(self) -> None:
        for at, (a, b) in enumerate(self.model.pairs):
            tree = RATE * self.grid(a, b)[0]
            self.model.grids[at] += tree
            self.total += tree[self.coarse[:, a], self.coarse[:, b]]


def blank(edges: list[np.ndarray], label: np.ndarray) -> Model:
    part = (label.sum() + 0.5) / (len(label) + 1)
    return Model(edges, float(np.log(part / (1 - part))), np.zeros((len(edges), BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))


def loss(model: Model, bins: np.ndarray, label: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(label == 1, -1, 1) * model.logit(bins)).mean())


def rounds_until(step, measure_loss) -> int:
    """Rounds up to the smallest loss, looking PATIENCE rounds further."""
    best, at = measure_loss(), 0
    for number in range(1, ROUNDS + 1):
        step()
        now = measure_loss()
        if now < best - 1e-6:
            best, at = now, number
        elif number - at >= PATIENCE:
            break
    return at


def fit(values: np.ndarray, label: np.ndarray, held: np.ndarray) -> Model:
    """A model of rows of features; the rows `held` only tell when to stop, then all rows are fitted for as many rounds."""
    if not len(values):
        return blank([np.zeros(0)] * len(FEATURES), label)
    edges = [edges_of(values[:, k]) for k in range(values.shape[1])]
    model = blank(edges, label)
    bins = model.bins(values)
    if label.min() == label.max():
        return model
    cycles = [20, 10]
    part = bins[~held], label[~held]
    if held.sum() >= 20 and len(set(label[held])) == 2 == len(set(part[1])):
        trial = blank(edges, part[1])
        boosting = Boosting(trial, *part)
        cycles[0] = rounds_until(boosting.cycle, lambda: loss(trial, bins[held], label[held]))
        trial = blank(edges, part[1])
        boosting = Boosting(trial, *part)
        for _ in range(cycles[0]):
            boosting.cycle()
        trial.pairs = boosting.choose_pairs(PAIRS)
        trial.grids = np.zeros((len(trial.pairs), PAIR_BINS, PAIR_BINS))
        cycles[1] = rounds_until(boosting.pair_cycle, lambda: loss(trial, bins[held], label[held]))
    boosting = Boosting(model, bins, label)
    for _ in range(cycles[0]):
        boosting.cycle()
    model.pairs = boosting.choose_pairs(PAIRS)
    model.grids = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(cycles[1]):
        boosting.pair_cycle()
    return model


def train(features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the rows of `features` (doc_id, features) that `labels` (doc_id, quality) marks 0 or 1.

    Fitted on all of them up to about `sample`, above it on a share of that many chosen by hash of the id;
    a fifth of those tells when to stop. Several labels of one id: the largest. Null ids and labels teach
    nothing; without labels every score is one half.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("marked")).agg(F.max("quality").cast("int").alias("quality"))
    part = min(1.0, sample / max(1, marks.count()))
    chosen = marks.where(F.pmod(F.xxhash64("marked"), F.lit(1 << 30)) <= part * (1 << 30)).hint("merge")
    rows = features.where("doc_id IS NOT NULL").join(chosen, F.col("doc_id") == F.col("marked"))
    found = rows.select("features", "quality", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("held")).orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").toArrow().combine_chunks()
    values = found.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if len(found) else np.zeros((0, len(FEATURES)))
    return fit(values, found.column("quality").to_numpy().astype(float), found.column("held").to_numpy(zero_copy_only=False).astype(bool) if len(found) else np.zeros(0, bool))


def score(features: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """The columns `keep`, score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on) of each row."""
    held = features.sparkSession.sparkContext.broadcast(model)
    schema = features.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for part in batches:
            values = part.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            found = held.value.score(values)
            arrays = [*(part.column(c) for c in keep), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return features.select(*dict.fromkeys((*keep, "features"))).mapInArrow(freed(run), schema)


def rate_quality(docs: DataFrame, labels: DataFrame, learn=None, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, features, score and predicted of each row of `docs` (doc_id, text), learned where `learn` (a condition on doc_id) holds.

    Every whole text is measured once, and its measures are written; the model is fitted on those of labelled
    documents and scores all of them by adding up table entries. Null and empty texts have zero features;
    repeated rows are scored alike; an empty table gives no rows; very long texts take memory in
    proportion to their length in one task; columns besides doc_id and text are ignored.
    """
    features = stored(measured(docs.select(F.col("doc_id").cast("long"), "text")))
    model = train(features if learn is None else features.where(learn), labels, sample)
    return score(features, model, ("doc_id", "features"), threshold)


def learning_ids(divisor: int = 4, held_out: int = 2):
    """Ids whose crc32 modulo `divisor` is known and is not `held_out`."""
    return remainder(F.col("doc_id"), divisor) != held_out
