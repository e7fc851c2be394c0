"""SimHash near-duplicates: bit planes, carry-save counters, components of linked fingerprints."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravure.llm.common import freed, slices, stored, texts
from gravure.llm.components import components

BITS = 64
FULL = np.uint64(2**64 - 1)
#: For whole-text similarity: 64-bit words of a SimHash; keys of a text, and least hashes in a key.
WORDS, BANDS, ROWS = 32, 14, 3
#: Largest bucket that one task compares whole; larger ones are cut into tiles of two blocks of this size.
BLOCK = 4096
#: Bytes of shingle hashes of a block.
BLOCK_BYTES = 32 << 20
#: Buckets up to this size are compared side by side, one bucket in each 64-bit word.
SMALL = 16


def fingerprint(text: str, width: int) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 (seed 42); no words: zero."""
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id and its fingerprint as a long (two's complement), one row per row of `docs`."""

    def run(batches):
        for part in slices(batches, "text"):
            found = np.array([fingerprint(t, width) for t in texts(part).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run), "doc_id long, fp long")


def planes(values: np.ndarray, lanes: int) -> np.ndarray:
    """Vertical form of fingerprints (rows of 64-bit words): word w of plane p holds bit p of rows 64w..64w+63."""
    padded = np.zeros((lanes, values.shape[1]), "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(lanes, -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def flips(queries: np.ndarray, plane: int) -> np.ndarray:
    """All bits set for each query that has bit `plane`."""
    return np.where(queries[:, plane // 64] >> np.uint64(plane % 64) & np.uint64(1), FULL, np.uint64(0))


class Distances:
    """Carry-save counters of differing bits per lane, biased so that their overflow means `radius` is exceeded."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        digits = max(3, radius.bit_length())
        bias = (1 << digits) - 1 - radius
        self.digits = [np.full(shape, FULL if bias >> d & 1 else 0, "<u8") for d in range(digits)]
        self.over = np.zeros(shape, "<u8")

    def add(self, eight: list[np.ndarray]) -> None:
        """Eight planes at once: seven carry-save adders, then one carry into the digit of eights."""
        level = eight
        for d in range(3):
            out = []
            for x, y in zip(level[::2], level[1::2]):
                half = self.digits[d] ^ x
                out.append(self.digits[d] & x | half & y)
                self.digits[d] = half ^ y
            level = out
        carry = level[0]
        for d in range(3, len(self.digits)):
            self.digits[d], carry = self.digits[d] ^ carry, self.digits[d] & carry
        self.over |= carry

    def keep(self, rows: np.ndarray) -> None:
        self.digits, self.over = [d[rows] for d in self.digits], self.over[rows]


def beyond(vertical: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Bit set per (query, lane) whose distance exceeds `radius`; lanes as 64-bit words.

    Every eight planes, queries all of whose lanes have overflown are abandoned.
    """
    result, alive = np.full((len(queries), vertical.shape[1]), FULL, "<u8"), np.arange(len(queries))
    state = Distances(result.shape, radius)
    for start in range(0, len(vertical), 8):
        state.add([vertical[p] ^ flips(queries[alive], p)[:, None] for p in range(start, start + 8)])
        near = (state.over != FULL).any(axis=1)
        if not near.all():
            alive = alive[near]
            state.keep(near)
            if not len(alive):
                return result
    result[alive] = state.over
    return result


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets (different hashes in order) is at least `similarity`."""
    few, many = (a, b) if len(a) < len(b) else (b, a)
    if len(few) < similarity * len(many) - 1e-9:
        return False
    if not len(few):
        return True
    common = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def spanning_links(values: np.ndarray, radius: int, chunk: int = 128, confirm=None, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) of a spanning forest of the rows of `values` linked within `radius`.

    Breadth first: reached rows are compared with those not reached yet, so each is a query once and
    at most len(values) - 1 links come out, however many pairs are near. Where `confirm` is given, near rows
    i and j are linked only if confirm(i, j). Rows of equal `labels` count as reached together: they are not compared.
    """
    links, rest, queue = [], np.arange(len(values)), []
    labels = rest if labels is None else labels
    while len(rest):
        if not queue:
            same = labels[rest] == labels[rest[0]]
            queue, rest = rest[same].tolist(), rest[~same]
            if not len(rest):
                break
        take, queue = np.array(queue[:chunk]), queue[chunk:]
        near = ~beyond(planes(values[rest], -(-len(rest) // 64) * 64), values[take], radius)
        any_near = np.bitwise_or.reduce(near, axis=0)
        hit = np.flatnonzero(np.unpackbits(any_near.view(np.uint8), bitorder="little")[: len(rest)])
        if len(hit):
            linked = near[:, hit // 64] >> (hit % 64).astype("<u8") & np.uint64(1)
            if confirm:
                first = [next((q for q in np.flatnonzero(column) if confirm(take[q], row)), -1) for column, row in zip(linked.T, rest[hit])]
                by = np.array(first)
                hit, by = hit[by >= 0], by[by >= 0]
            else:
                by = linked.argmax(axis=0)
            found, first = np.unique(labels[rest[hit]], return_index=True)
            links += zip(take[by[first]].tolist(), rest[hit[first]].tolist())
            reached = np.isin(labels[rest], found)
            queue += rest[reached].tolist()
            rest = rest[~reached]
    return links


def small_links(groups: list[np.ndarray], radius: int, confirm=None, labels: list | None = None) -> list[tuple[int, int, int]]:
    """(group, i, j) links of spanning forests of many groups of at most 64 rows, one group per lane word; see spanning_links."""
    if not groups:
        return []
    words = groups[0].shape[1]
    lanes = np.zeros((len(groups), 64, words), "<u8")
    for row, values in zip(lanes, groups):
        row[: len(values)] = values
    vertical = planes(lanes.reshape(-1, words), lanes.shape[0] * 64)
    sizes, links = np.array([len(g) for g in groups]), []
    root = [[own.index(x) for x in own] for own in labels] if labels else [list(range(n)) for n in sizes]

    def top(parent, i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for q in range(int(sizes.max()) - 1):
        live = np.flatnonzero(sizes > q + 1)
        state, own = Distances(live.shape, radius), lanes[live, q]
        for start in range(0, len(vertical), 8):
            state.add([vertical[p][live] ^ flips(own, p) for p in range(start, start + 8)])
            if (state.over == FULL).all():
                break
        near = ~state.over >> np.uint64(q + 1)
        for at in np.flatnonzero(near):
            g, bits = int(live[at]), int(near[at])
            while bits:
                low = bits & -bits
                j, bits = q + low.bit_length(), bits ^ low
                if j < sizes[g] and (a := top(root[g], q)) != (b := top(root[g], j)) and (not confirm or confirm(g, q, j)):
                    root[g][b] = a
                    links.append((g, q, j))
    return links


def tile_links(tiles: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """(a, b) links that join the nodes of each tile of `tiles` (tile, node) within `radius` bits.

    The bits compared are those of `value` (binary) where there is one, else of the node itself. With a `similarity`
    each pair must also have that Jaccard similarity of its `shingles` (binary: different hashes in order). Nodes of
    one `label`, where there is one, are joined already and are not compared.
    """
    wide, marked = "value" in tiles.columns, "label" in tiles.columns

    def compare(batches):
        key, nodes, values, sets, marks, waiting, out = None, [], [], [], [], [], []

        def judge(of):
            return (lambda i, j: alike(of[i], of[j], similarity)) if similarity else None

        def close():
            if len(nodes) > 1 and not (marked and len(set(marks)) == 1):
                rows = np.frombuffer(b"".join(values), "<u8") if wide else np.array(nodes, "<i8").view("<u8")
                rows = rows.reshape(len(nodes), -1)
                if len(nodes) > SMALL:
                    out.extend((nodes[i], nodes[j]) for i, j in spanning_links(rows, radius, confirm=judge(sets), labels=np.array(marks) if marked else None))
                else:
                    waiting.append((nodes, rows, sets, marks))
            if len(waiting) >= 256:
                flush()

        def flush():
            confirm = (lambda g, i, j: alike(waiting[g][2][i], waiting[g][2][j], similarity)) if similarity else None
            out.extend((waiting[g][0][i], waiting[g][0][j]) for g, i, j in small_links([w[1] for w in waiting], radius, confirm, [w[3] for w in waiting] if marked else None))
            waiting.clear()

        def batch():
            ends = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for part in batches:
            columns = ("tile", "node", "value" if wide else "node", "shingles" if similarity else "node", "label" if marked else "node")
            for tile, node, value, shingles, label in zip(*(part.column(c).to_pylist() for c in columns)):
                if tile != key:
                    close()
                    key, nodes, values, sets, marks = tile, [], [], [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    values.append(value)
                    marks.append(label)
                    if similarity:
                        sets.append(np.frombuffer(shingles, "<u8"))
            if len(out) > 50_000:
                yield batch()
        close()
        flush()
        yield batch()

    dealt = tiles.repartition("tile").sortWithinPartitions("tile", "node")
    return dealt.mapInArrow(freed(compare), "a long, b long")


def in_tiles(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tile, node) of `keyed` (key, node) for keys with more than one node.

    Keys with more than `block` nodes, or more than BLOCK_BYTES of them where `keyed` has `bytes`, are cut into blocks by hash
    (keys whose nodes all have one `label`, where `keyed` has it, are left out), and each pair of blocks is a tile of its
    own, so that any two nodes of a key meet in one tile and no task holds a hot key.
    """
    weight = F.sum("bytes" if "bytes" in keyed.columns else F.lit(0)).alias("weight")
    unlike = [F.min("label").alias("least"), F.max("label").alias("most")] if "label" in keyed.columns else []
    sizes = keyed.groupBy(F.col("key").alias("at")).agg(F.count(F.lit(1)).alias("count"), weight, *unlike)
    sizes = stored(sizes.where("count > 1 AND least <> most" if unlike else "count > 1").select("at", "count", "weight"))
    blocks = F.greatest(F.ceil(F.col("count") / block), F.ceil(F.col("weight") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")
    pairs = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(own, o) AS i, greatest(own, o) AS j))")
    met = keyed.join(sizes, F.col("key") == F.col("at")).select("node", "key", blocks.alias("blocks"), own.alias("own"))
    return met.select("node", "key", F.explode(pairs).alias("tile")).select(F.xxhash64("key", "tile.i", "tile.j").alias("tile"), "node")


def band_keys(fp: Column, blocks: int, radius: int) -> list[Column]:
    """One key for each choice of blocks - radius blocks of bits: values within `radius` share at least one."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(edges)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(masks, blocks - radius)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return keys


def links(distinct: DataFrame, radius: int = 3, blocks: int = 5, block: int = BLOCK) -> DataFrame:
    """(a, b) links that join all of `distinct` (fp) within `radius` bits; nothing near is lost.

    Candidates share one of C(blocks, radius) keys; within a tile the comparison is bit-sliced and gives
    a spanning forest, not all pairs.
    """
    keyed = distinct.select(F.col("fp").alias("node"), F.explode(F.array(*band_keys(F.col("fp"), blocks, radius))).alias("key"))
    return tile_links(in_tiles(keyed, block), radius)


def smallest_ids(marked: DataFrame, links: DataFrame) -> DataFrame:
    """component_id for each node of `marked` (doc_id, node): the smallest doc_id reachable by `links`."""
    members = stored(marked.groupBy("node").agg(F.min("doc_id").alias("first")).withColumnRenamed("node", "value"))
    roots = components(links)
    placed = stored(members.join(roots, F.col("value") == F.col("node"), "left").select("value", "first", F.coalesce("root", "value").alias("root")))
    smallest = stored(placed.groupBy(F.col("root").alias("top")).agg(F.min("first").alias("component_id")))
    return stored(placed.join(smallest, F.col("root") == F.col("top")).select("value", "component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 3, blocks: int = 5) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id per row of `docs` (doc_id, text).

    A-Z are lower-cased, words are runs of other than ASCII white space, shingles are `width` words joined
    by spaces, repeats included (fewer words: the whole sequence). Fingerprints with at most `radius`
    differing bits are linked; component_id is the smallest doc_id reachable, itself included.

    Equal fingerprints are folded first, with partial minima, so a crowd of copies is one value. Null and
    empty texts have fingerprint zero and are linked like any other. Repeated rows give equal rows; rows
    with a null doc_id take part, and their group's smallest id ignores them (null if no other);
    an empty table gives no rows; columns besides doc_id and text are ignored.
    """
    marked = stored(fingerprints(docs, width))
    distinct = stored(marked.select("fp").distinct())
    named = smallest_ids(marked.withColumnRenamed("fp", "node"), links(distinct, radius, blocks))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, F.col("fp") == F.col("value")).select("doc_id", shown.alias("fingerprint"), "component_id")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the rows (64-bit words) have each bit, counted by carry-save adders over whole rows."""
    level, totals = hashes, []
    while len(level):
        carries = []
        while len(level) > 1:
            third = len(level) // 3 if len(level) > 2 else 0
            if third:
                a, b, c, rest = level[:third], level[third : 2 * third], level[2 * third : 3 * third], level[3 * third :]
                half = a ^ b
                carries.append(a & b | half & c)
                level = np.concatenate([half ^ c, rest])
            else:
                carries.append(level[:1] & level[1:])
                level = level[:1] ^ level[1:]
        totals.append(level[0])
        level = np.concatenate(carries) if carries else level[:0]
    bits = np.unpackbits(np.array(totals, "<u8").view(np.uint8).reshape(len(totals), -1), axis=1, bitorder="little")
    return (bits.astype(np.int64) << np.arange(len(totals))[:, None]).sum(axis=0)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """The hashes of a text's distinct shingles in order, keys of which similar texts share some, and a wide SimHash."""

    def __init__(self, width: int):
        self.width = width
        self.seeds = _mixed(np.arange(1, WORDS + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15))
        self.factors = _mixed(np.arange(100, 100 + BANDS * ROWS, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, "<u8")
        shingles = set(map(b" ".join, zip(*(words[i:] for i in range(self.width))))) or {b" ".join(words)}
        return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], "<u8"))

    def keys(self, hashes: np.ndarray) -> list[int]:
        if not len(hashes):
            return [0]
        least = np.full(BANDS * ROWS, FULL, "<u8")
        for start in range(0, len(hashes), 4096):
            least = np.minimum(least, (hashes[start : start + 4096, None] * self.factors).min(axis=0))
        keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
        return np.array(keys, "<u8").view("<i8").tolist()

    def value(self, hashes: np.ndarray) -> bytes:
        count = np.zeros(64 * WORDS, np.int64)
        for start in range(0, len(hashes), 4096):
            count += bit_counts(_mixed(hashes[start : start + 4096, None] ^ self.seeds))
        return np.packbits(count * 2 > len(hashes), bitorder="little").tobytes()


def reach(similarity: float) -> int:
    """Differing bits of 64 * WORDS within which texts of a Jaccard similarity of at least `similarity` fall.

    Sets of that similarity have a cosine of 2s / (1 + s) and differ in acos / pi of the bits on average;
    five deviations more are allowed: the bits are a filter that loses nothing, not the decision.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(64 * WORDS * share + 5 * np.sqrt(64 * WORDS * share * (1 - share)))


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id per row of `docs` (doc_id, text): texts of that similarity are linked.

    Similarity is that of the sets of `width`-word shingles (words and case as in near_duplicates), as
    64-bit hashes. Pairs whose SimHashes of 64 * WORDS bits are within reach(similarity) are compared exactly. A radius of that many bits is beyond
    pigeonhole keys, so candidates share one of BANDS keys of ROWS least shingle hashes each
    (1 - (1 - s^ROWS)^BANDS: over 0.9999 at 0.8); every candidate pair's distance is then bit-sliced, and
    those left are linked if the sets' Jaccard similarity is high enough.
    Nulls, repeats, empty and very long texts as in near_duplicates: texts without words are alike.

    Shingle hashes take over twice the room of the texts and don't compress. They are kept only of texts that share a key
    with another, one text of each set; `docs` is read again for these and must give the same rows.
    """

    def sketched(batches):
        sketch = Sketcher(width)
        for part in slices(batches, "text"):
            found = [(len(h), xxhash.xxh64_intdigest(h.tobytes(), 42), sketch.keys(h)) for h in map(sketch.hashes, texts(part).to_pylist())]
            sizes, nodes, keys = zip(*found)
            arrays = [part.column("doc_id"), part.column("digest"), pa.array(np.array(nodes, "<u8").view("<i8")), pa.array(np.array(sizes, np.int64) * 8), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "digest", "node", "bytes", "keys"])

    def spelt(batches):
        sketch = Sketcher(width)
        for part in slices(batches, "text"):
            sets = [sketch.hashes(t) for t in texts(part).to_pylist()]
            arrays = [part.column("of"), pa.array([sketch.value(h) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["of", "value", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    marked = stored(rows.mapInArrow(freed(sketched), "doc_id long, digest long, node long, bytes long, keys array<long>"))
    distinct = stored(marked.groupBy("node").agg(F.first("keys").alias("keys"), F.first("bytes").alias("bytes"), F.min(F.struct("digest", "doc_id")).alias("row")))

    keyed = distinct.select("node", "bytes", F.posexplode("keys").alias("band", "key"))
    shared = stored(keyed.groupBy(F.col("key").alias("at")).count().where("count > 1").select("at"))
    together = stored(keyed.join(shared, F.col("key") == F.col("at"), "left_semi"))
    # Two texts mostly share several keys, often with no other text: of keys with the same texts the first one does.
    marks = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"mark{seed}") for seed in (1, 2)]
    sets = together.groupBy("key").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("count"), *marks)
    once = stored(sets.groupBy("count", "mark1", "mark2").agg(F.min(F.struct("band", "key")).alias("kept")).select(F.col("kept.key").alias("at")))
    keyed = stored(together.join(once, F.col("key") == F.col("at"), "left_semi"))
    meeting = keyed.select(F.col("node").alias("of")).distinct()
    picked = stored(distinct.join(meeting, F.col("node") == F.col("of")).select("of", F.col("row.digest").alias("its"), F.col("row.doc_id").alias("by")))
    chosen = rows.join(picked, (F.col("digest") == F.col("its")) & F.col("doc_id").eqNullSafe(F.col("by")))
    met = stored(chosen.groupBy("of").agg(F.first("text").alias("text")).mapInArrow(freed(spelt), "of long, value binary, shingles binary"))

    def compared(keyed: DataFrame) -> DataFrame:
        tiles = stored(in_tiles(keyed))
        valued = tiles.join(met, F.col("node") == F.col("of")).select("tile", "node", "value", "shingles")
        if "label" in keyed.columns:
            labels = keyed.select(F.col("node").alias("named"), "label").distinct()
            valued = valued.join(labels, F.col("node") == F.col("named")).drop("named")
        return stored(tile_links(valued, reach(similarity), similarity))

    # Crowds of near copies share nearly all keys: what the first key has joined is not compared again under the others.
    first = compared(keyed.where("band = 0").select("node", "bytes", "key"))
    joined = components(first).withColumnRenamed("node", "at")
    others = keyed.where("band > 0").join(joined, F.col("node") == F.col("at"), "left").select("node", "bytes", F.coalesce("root", "node").alias("label"), "key")
    links = first.union(compared(stored(others)))
    named = smallest_ids(marked.select("doc_id", "node"), links)
    return marked.select("doc_id", "node").join(named.withColumnRenamed("value", "at"), F.col("node") == F.col("at")).select("doc_id", "component_id")
