"""Spelling variants: the vocabulary's minimised acceptor composed with a one-edit transducer and the acceptor again."""

from __future__ import annotations

import functools
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravure.llm.common import freed, slices, stored, texts

#: One occurrence in RATE loses a code point; code points and occurrences that make a word.
RATE, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: A form is at least so many times as frequent as its variant.
FACTOR = 2
#: Initial states with more words than this are split by the arc at which the edit happens.
HOT = 20_000
#: Reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


@functools.lru_cache(None)
def zero_bytes(n: int) -> np.ndarray:
    """What n zero bytes make of each byte of a CRC-32: four tables of 256."""
    if n:
        before = zero_bytes(n - 1)
        return zero_table()[before & 255] ^ (before >> np.uint32(8))
    return np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)


@functools.lru_cache(1)
def zero_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(POLYNOMIAL) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


def joined_crcs(heads: np.ndarray, tails: np.ndarray, sizes: np.ndarray, words: list[bytes], index: np.ndarray) -> np.ndarray:
    """crc32 of head + word from the crc32 of both; words (by `index`) of over 64 bytes are read again."""
    out = np.empty(len(heads), np.uint32)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if size <= 64:
            shift, h = zero_bytes(int(size)), heads[at]
            out[at] = shift[0][h & 255] ^ shift[1][h >> 8 & 255] ^ shift[2][h >> 16 & 255] ^ shift[3][h >> 24] ^ tails[at]
        else:
            out[at] = [zlib.crc32(words[index[k]], int(heads[k])) for k in at]
    return out


def runs(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of A-Z, a-z and U+00C0-U+00FF with A-Z lower-cased, and the number of each one's text.

    In UTF-8 those runs are ASCII letters and pairs of a byte C3 and the byte after it.
    """
    if not len(column):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    lower = pc.cast(pc.ascii_lower(column), pa.large_string())
    bounds = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    whole = lower.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[: bounds[-1]] if whole is not None else np.zeros(0, np.uint8)
    data, bounds = data[bounds[0] :], bounds - bounds[0]
    inside = (data >= 97) & (data <= 122) | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, sizes = np.flatnonzero(first), np.flatnonzero(last) + 1 - np.flatnonzero(first)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, np.searchsorted(bounds, starts, side="right") - 1


def slice_counts(ids: list, column: pa.Array, rate: int, least: int) -> tuple[list[bytes], list[int]]:
    """Words of at least `least` code points of some texts after the deletions, with their occurrences."""
    words, row = runs(column)
    coded = words.dictionary_encode()
    names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.fromiter((len(w) - w.count(b"\xc3") for w in names), np.int64, len(names))
    pairs, times = np.unique(row * max(1, len(names)) + index, return_counts=True)
    row, index = pairs // max(1, len(names)), pairs % max(1, len(names))
    heads = np.fromiter((zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids), np.uint32, len(ids))
    tails = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
    sizes = np.fromiter(map(len, names), np.int64, len(names))
    crcs = joined_crcs(heads[row], tails[index], sizes[index], names, index)
    cut = crcs % rate == 0
    left = np.bincount(index[~cut], weights=times[~cut], minlength=len(names)).astype(np.int64)
    counts = {names[k]: int(left[k]) for k in np.flatnonzero((left > 0) & (points >= least))}
    for k in np.flatnonzero(cut & (points[index] > least)):
        text = names[index[k]].decode()
        at = int(crcs[k]) % len(text)
        shorter = (text[:at] + text[at + 1 :]).encode()
        counts[shorter] = counts.get(shorter, 0) + int(times[k])
    return list(counts), list(counts.values())


def vocabulary(docs: DataFrame, rate: int = RATE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of all texts of `docs` (doc_id, text) after the deletions, counted before the shuffle."""

    def run(batches):
        for part in slices(batches, "text", 8 << 20):
            names, counts = slice_counts(part.column("doc_id").to_pylist(), texts(part), rate, least_length)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(freed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Acceptors:
    """Minimal acyclic acceptors of words of one length each, with shared states; state 0 accepts the empty word.

    A state is the tuple of its arcs (label, next state, words accepted by the arcs before). A word's
    number in its acceptor is the sum of those counts on its path, so pairs of words are pairs of numbers.
    """

    def __init__(self):
        self.arcs, self.size, self.known = [()], [1], {(): 0}
        self.both, self.changed, self.longer = {}, {}, {}

    def state(self, arcs: tuple) -> int:
        at = self.known.get(arcs)
        if at is None:
            at = self.known[arcs] = len(self.arcs)
            shown, total = [], 0
            for label, to in zip(arcs[::2], arcs[1::2]):
                shown.append((label, to, total))
                total += self.size[to]
            self.arcs.append(tuple(shown))
            self.size.append(total)
        return at

    def accept(self, words: list[bytes]) -> int:
        """The initial state for different words of one length, in order."""
        length = len(words[0])
        open_arcs = [[] for _ in range(length)]
        last = words[0]
        for word in [*words[1:], None]:
            keep = 0
            if word is not None:
                while last[keep] == word[keep]:
                    keep += 1
            to = 0
            for depth in range(length - 1, keep - 1, -1):
                open_arcs[depth] += (last[depth], to)
                if depth > keep or word is None:
                    to = self.state(tuple(open_arcs[depth]))
                    open_arcs[depth] = []
            last = word
        return to

    def common(self, x: int, y: int) -> list[tuple[int, int]]:
        """Numbers in x and in y of the words that both accept."""
        if x == y:
            return [(i, i) for i in range(self.size[x])]
        found = self.both.get((x, y))
        if found is None:
            found = self.both[x, y] = self.matched(self.arcs[x], self.arcs[y])
        return found

    def matched(self, ours, theirs) -> list[tuple[int, int]]:
        found = []
        if len(ours) == 1 and len(theirs) == 1 and ours[0][0] != theirs[0][0]:
            return found
        there = {label: (to, before) for label, to, before in theirs}
        for label, to, before in ours:
            if label in there:
                other, skipped = there[label]
                found += [(before + i, skipped + j) for i, j in self.common(to, other)]
        return found

    def replaced(self, x: int) -> list[tuple[int, int]]:
        """Pairs accepted by x, the transducer of one replacement, and x; each once, the smaller word first."""
        found = self.changed.get(x)
        if found is None:
            found = []
            arcs = self.arcs[x]
            for k, (_, to, before) in enumerate(arcs):
                found += [(before + i, before + j) for i, j in self.replaced(to)]
                for _, other, skipped in arcs[k + 1 :]:
                    found += [(before + i, skipped + j) for i, j in self.common(to, other)]
            self.changed[x] = found
        return found

    def inserted(self, x: int, y: int, end: bool) -> list[tuple[int, int]]:
        """Pairs accepted by x, the transducer of one insertion, and y, where words of y are one longer.

        The insertion stands where the two words first differ, so that each pair has one path; at the
        end of the shorter word only with `end`.
        """
        found = self.longer.get((x, y, end))
        if found is None:
            found = []
            ours, theirs = self.arcs[x], self.arcs[y]
            there = {label: (to, before) for label, to, before in theirs}
            for label, to, before in ours:
                if label in there:
                    other, skipped = there[label]
                    found += [(before + i, skipped + j) for i, j in self.inserted(to, other, end)]
            for label, to, skipped in theirs:
                if x:
                    rest = tuple(arc for arc in ours if arc[0] != label)
                    found += [(i, skipped + j) for i, j in self.matched(rest, self.arcs[to])]
                elif end:
                    found.append((0, skipped))
            self.longer[x, y, end] = found
        return found


def group_pairs(short: list[bytes], long: list[bytes], end: bool = True) -> tuple[list, list]:
    """Pairs of numbers one replacement apart within `short`, and one insertion apart from `short` to `long`."""
    machine = Acceptors()
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * max(map(len, (short[0], *long[:1]))) + 1000))
    x = machine.accept(short)
    swapped = machine.replaced(x) if len(short) > 1 else []
    return swapped, machine.inserted(x, machine.accept(long), end) if long else []


def initial_states(words: DataFrame, hot: int) -> DataFrame:
    """(m, kind, state, rest, word, n): `words` (word, n) by the initial states from which pairs are enumerated.

    Two words of m and m or m + 1 code points, one edit apart, share their first m div 2 code points
    (kind 0: the state of the acceptor after them) or else their last m - m div 2 (kind 1: the state of the
    reversed acceptor). `rest` is what the composition reads. States of more than `hot` words are split into
    pairs of states around the edit: all before and after it (kind 2 a replacement, 3 an insertion).
    """
    length = F.char_length("word")
    spots = words.withColumn("size", length).select("word", "n", "size", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("m"), F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"))
    half = F.expr("m div 2")
    front = F.expr("substring(word, 1, m div 2)")
    back = F.expr("substring(word, 1 + size - (m - m div 2))")
    rest = F.when(F.col("kind") == 0, F.expr("substring(word, 1 + m div 2)")).otherwise(F.expr("substring(word, 1, size - (m - m div 2))"))
    placed = stored(spots.select("m", "kind", F.when(F.col("kind") == 0, front).otherwise(back).alias("state"), rest.alias("rest"), "word", "n"))
    sizes = placed.groupBy("m", "kind", "state").count()
    large = stored(sizes.where(F.col("count") > hot).select(F.col("m").alias("m_"), F.col("kind").alias("kind_"), F.col("state").alias("state_")))
    same = (F.col("m") == F.col("m_")) & (F.col("kind") == F.col("kind_")) & (F.col("state") == F.col("state_"))
    if large.isEmpty():
        return placed
    few = placed.join(large, same, "left_anti")
    split = placed.join(large, same, "left_semi").withColumn("size", length).withColumn("half", half)
    edits = """flatten(transform(IF(kind = 0, sequence(half, m), sequence(0, half - 1)), i -> filter(array(
        IF(size = m AND i < m, struct(2 AS kind, i AS i, i + 1 AS go_on), NULL),
        IF(size = m, struct(3 AS kind, i AS i, i AS go_on), struct(3 AS kind, i AS i, i + 1 AS go_on))), e -> e IS NOT NULL)))"""
    around = split.withColumn("edit", F.explode(F.expr(edits))).selectExpr(
        "m", "edit.kind AS kind", "concat_ws('|', edit.i, substring(word, 1, edit.i), substring(word, 1 + edit.go_on)) AS state",
        "substring(word, 1 + edit.i, edit.go_on - edit.i) AS rest", "word", "n",
    )
    return few.unionByName(around)


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n_near, form_n, form) for each of `words` (word, n) that has near words.

    Each initial state's words are composed by one task; what leaves it is, for each word, how many
    near words were accepted there and the best of them, not the pairs.
    """
    columns = ["m", "kind", "state", "rest", "word", "n"]

    def run(batches):
        seen: dict[str, list] = {}

        def note(word, other, n):
            mark = seen.get(word)
            if mark is None:
                seen[word] = [1, n, other]
            else:
                mark[0] += 1
                if n > mark[1] or n == mark[1] and other < mark[2]:
                    mark[1], mark[2] = n, other

        def close(key, rows):
            m, kind, state = key
            rows.sort()
            short = [r for r in rows if r[0] == m]
            long = [r for r in rows if r[0] != m]
            if len(rows) < 2 or not short:
                return
            swapped, added = group_pairs([r[1] for r in short], [r[1] for r in long] if kind != 2 else [], end=kind != 1)
            for i, j in swapped:
                note(short[i][2], short[j][2], short[j][3])
                note(short[j][2], short[i][2], short[i][3])
            for i, j in added:
                if kind == 3 and not first_difference(short[i][2], long[j][2], int(state.split("|", 1)[0])):
                    continue
                note(short[i][2], long[j][2], long[j][3])
                note(long[j][2], short[i][2], short[i][3])

        def out():
            arrays = [pa.array(seen), *(pa.array([v[k] for v in seen.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
            batch = pa.RecordBatch.from_arrays([arrays[0].cast(pa.string()), *arrays[1:]], names=["word", "near", "form_n", "form"])
            seen.clear()
            return batch

        key, rows = None, []
        for part in batches:
            for m, kind, state, rest, word, n in zip(*(part.column(c).to_pylist() for c in columns)):
                if key != (m, kind, state):
                    if len(rows) > 1:
                        close(key, rows)
                    key, rows = (m, kind, state), []
                    if len(seen) > 100_000:
                        yield out()
                rows.append((len(word), rest.encode("latin-1"), word, n))
        if len(rows) > 1:
            close(key, rows)
        if seen:
            yield out()

    dealt = initial_states(words, hot).select(*columns).repartition("m", "kind", "state").sortWithinPartitions("m", "kind", "state")
    found = dealt.mapInArrow(freed(run), "word string, near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def first_difference(short: str, long: str, at: int) -> bool:
    """Whether the words, equal before `at`, differ there."""
    return at == len(short) or short[at] != long[at]


def group_variants(docs: DataFrame, rate: int = RATE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, hot: int = HOT) -> DataFrame:
    """word, n, n_near, form, form_n and root for each word of `docs` (doc_id, text).

    Words are runs of A-Z, a-z and U+00C0-U+00FF with A-Z lower-cased; where `rate` divides the crc32 of
    `<doc_id>:<run>`, the run's occurrences in that document lose one code point. Kept are those of
    `least_length` code points and `least_count` occurrences. Near words differ by one inserted, deleted or
    replaced code point; a word's form is its most frequent near word (ties: smallest) if that is `factor`
    times as frequent; its root is where its forms lead. Counts at least double from form to form, so
    chains end, after at most log2 of the largest count.

    Null and empty texts have no words; a null doc_id is written as nothing before the colon; repeated rows
    count each; very long texts and runs take memory in proportion to their length in one task; an empty
    table gives no rows; columns besides doc_id and text are ignored.
    """
    words = stored(vocabulary(docs, rate, least_length, least_count))
    near = near_words(words, hot).withColumnRenamed("word", "of")
    ranked = F.col("form_n") >= factor * F.col("n")
    joined = words.join(near, F.col("word") == F.col("of"), "left")
    table = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ranked, F.col("form")).alias("form"), F.when(ranked, F.col("form_n")).alias("form_n")))
    roots = stored(follow(table.where("form IS NOT NULL").select("word", F.col("form").alias("up"))))
    return table.join(roots.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")


def follow(steps: DataFrame) -> DataFrame:
    """(word, up) with `up` followed to its end; each round doubles the steps, until no word moves."""
    while True:
        above = steps.select(F.col("word").alias("at"), F.col("up").alias("over"))
        new = stored(steps.join(above, F.col("up") == F.col("at"), "left").select("word", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")))
        steps = new.select("word", "up")
        if new.where("moved").isEmpty():
            return steps


#: Check SQL. A crc32 is a fold over bytes with the byte table of its reflected polynomial; near words share the word without one code point.
SQL = f"""
WITH RECURSIVE bits AS (
  SELECT b, list_reduce([b::BIGINT] || range(8), lambda v, k: CASE WHEN v % 2 = 1 THEN xor({POLYNOMIAL}, v // 2) ELSE v // 2 END) AS v FROM range(256) t(b)
), byte_table AS (SELECT list(v ORDER BY b) AS tab FROM bits),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS k, coalesce(doc_id::VARCHAR, '') || ':' || run AS named FROM found GROUP BY doc_id, run),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(named))::BIGINT), lambda i: ('0x' || substr(hex(encode(named)), 2 * i + 1, 2))::BIGINT),
    lambda v, b: xor(tab[1 + xor(v, b) % 256], v // 256))) AS h FROM counted, byte_table
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {RATE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
  ) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}
), gaps AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM gaps),
pairs AS (
  SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, w.n, l.word, l.n FROM words w JOIN less l ON w.word = l.rest
  UNION SELECT l.word, l.n, w.word, w.n FROM words w JOIN less l ON w.word = l.rest
), best AS (
  SELECT a, count(*) AS n_near, arg_min(b, (-bn, b)) AS form, max(bn) AS form_n FROM pairs GROUP BY a
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {FACTOR} * n THEN form END AS form, CASE WHEN form_n >= {FACTOR} * n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON word = a
), chain AS (
  SELECT word, form AS at FROM formed WHERE form IS NOT NULL
  UNION SELECT c.word, f.form FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NOT NULL
), ends AS (SELECT c.word, c.at FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN ends e ON f.word = e.word
"""
