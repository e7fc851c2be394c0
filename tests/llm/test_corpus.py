"""The corpus operators against brute force, round trips and held-out labels, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from gravure.llm import additive_quality, binary_packing, common, components, fit_packing, imatch, line_dedup, piece_bpe, ppm_language, resampling, simhash, spelling, tile_embeddings, token_counts, toxicity, word_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `group` int, n_tokens string"
WORDS = "the quick brown fox jumps over a lazy dog and then some other words follow in this line of text".split()


def prose(seed: int, n: int = 60) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[k]}{m}" for k, m in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 9, n)))


ODD = [None, "", " ", "\n\n", "a", "1 2 3", "x  y \n z\t", "é" * 300, "ab " * 3000, "z" * 20_000, prose(1), prose(1), "<|endoftext|> it's ▁   漢字 😀"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 0, 0.5, 1, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[0], rows[10]], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.table(spark, sf_dir, "documents")


def pairs_roots(ids, linked):
    root = dict(zip(range(len(ids)), range(len(ids))))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = sorted((top(i), top(j)), key=lambda k: ids[k])
        root[b] = a
    return [ids[top(i)] for i in range(len(ids))]


def test_word_ids_equal_the_library():
    path = word_ids.default_path()
    whole = Tokenizer.from_file(path)
    texts = [t or "" for t in ODD] + ["LL's İ \x1c \x85 ²½", "á ­"]
    texts += ["A'B it's 'tis", "x<|y <|startoftext|>", "ÀÉÞß×÷ªº²¼µ", "a\u00a0b \u00adc", "A\u030a I\u0307 \x7f", "\U0001f600Ab,c-D..9,10", "end", "", "Start"]
    for kept in (word_ids.KEPT, 20):  # a table that is full again and again gives the same ids
        coder = word_ids.WordIds(path, kept)
        for part in (texts, texts[::-1], texts[3:9]):
            flat, bounds = coder.document_ids(pa.array(part))
            for text, a, b in zip(part, bounds[:-1], bounds[1:]):
                assert flat[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_fingerprints_of_edited_texts(odd, nothing, docs):
    rows = sorted(imatch.compare_edited(docs, group=16).collect(), key=lambda r: -r["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row, after in zip(rows, rows[1:] + rows[:1]):
        text, other = texts[row["doc_id"]], texts[after["doc_id"]]
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    assert np.mean([r["near_edited"] for r in rows]) > 5 * np.mean([r["near_next"] for r in rows])
    found = imatch.compare_edited(odd, group=3).collect()
    assert len(found) == len(ODD) + 2 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    plain = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint_documents(odd).collect()}
    assert plain[10] == plain[11] and plain[0] == plain[1] and plain[9] != plain[10]
    assert imatch.compare_edited(nothing).count() == 0


def test_boilerplate_lines(spark, odd, nothing):
    rows = [(i, f"own {i}\nboiler plate \nwide", f"s{i % 12}") for i in range(40)] + [(99, "two sites", "s1"), (98, "two sites", "s2"), (97, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in line_dedup.drop_boilerplate(df, 12).collect()}
    assert got[0] == ("own 0\nboiler plate \nwide", 0) and got[1] == ("own 1", 2)
    assert got[99] == ("two sites", 0) and got[97] == (None, 0) and len(got) == 43
    kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(df, 13).collect()}
    assert kept[1] == rows[1][1]
    assert line_dedup.drop_boilerplate(odd, 2).count() == len(ODD) + 2
    assert line_dedup.drop_boilerplate(nothing).count() == 0


def test_token_counts_and_cache(spark, odd, nothing):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.PIECE_BPE))
    cache = token_counts.new_cache(spark)
    for _ in range(2):
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(odd, cache).collect()}
        for i, text in enumerate(t or "" for t in ODD):
            n = len(model.encode(text))
            assert got[i if i != 4 else None] == (len(text.encode()), n, n > 4096)
        assert spark.read.parquet(cache).count() == len({t or "" for t in ODD})
    assert token_counts.count_tokens(nothing, token_counts.new_cache(spark)).count() == 0


def test_byte_bpe_equals_tiktoken(odd, nothing):
    ranks = piece_bpe.read_ranks(public_tokenizers.path(piece_bpe.BYTE_BPE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = piece_bpe.encode_documents(odd)
    got = {r["doc_id"]: r for r in coded.collect()}
    for i, text in enumerate(t or "" for t in ODD):
        row = got[i if i != 4 else None]
        assert row["ids"] == library.encode_ordinary(text) and row["n_tokens"] == len(row["ids"])
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, row["ids"])).encode()).hexdigest()
    back = {r["doc_id"]: bytes(r["content"]) for r in piece_bpe.decode_documents(coded).collect()}
    assert back[8] == ODD[8].encode() and piece_bpe.encode_documents(nothing).count() == 0


def test_binary_packing(odd, nothing):
    whole = Tokenizer.from_file(word_ids.default_path())
    packed = binary_packing.pack(odd).collect()
    assert len({r["sequence_id"] for r in packed}) == len(packed)
    by_doc = {}
    for row in packed:
        assert row["length"] & (row["length"] - 1) == 0 and row["length"] <= 4096 and row["offset"] == 0
        assert row["ids_crc32"] == zlib.crc32(row["ids"])
        by_doc.setdefault(row["doc_id"], {})[row["start"]] = binary_packing.decode(row["ids"])
    for i, text in enumerate(t or "" for t in ODD):
        pieces = by_doc[i if i != 4 else None]
        assert np.concatenate([pieces[k] for k in sorted(pieces)]).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]
    assert binary_packing.pack(nothing).count() == 0


def test_best_fit_packing(docs, odd, nothing):
    assert fit_packing.best_fit([5, 7, 3, 1, 8], 8) == [2, 1, 2, 1, 0]
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 500).tolist()
    room = []
    for i in sorted(range(500), key=lambda i: -lengths[i]):  # the plain search gives as many bins
        fits = [b for b, r in enumerate(room) if r >= lengths[i]]
        best = min(fits, key=lambda b: room[b], default=len(room))
        room += [64] if best == len(room) else []
        room[best] -= lengths[i]
    assert max(fit_packing.best_fit(lengths, 64)) + 1 == len(room)
    whole = Tokenizer.from_file(word_ids.default_path())
    rows = fit_packing.pack(docs, shard_bytes=100_000).collect()
    pieces = {}
    for row in rows:
        ids, ends = np.frombuffer(row["input_ids"], "<u2"), row["cu_seqlens"]
        assert len(ids) == 4096 and ends[-1] == row["n_tokens"] and row["position_resets"] == ends[:-1]
        for owner, start, a, b in zip(row["doc_ids"], row["starts"], ends, ends[1:]):
            pieces.setdefault(owner, {})[start] = ids[a:b].tolist()
    for row in docs.collect():
        own = pieces[row["doc_id"]]
        assert sum((own[k] for k in sorted(own)), []) == [*whole.encode(row["text"], add_special_tokens=False).ids, 2]
    odd_rows = fit_packing.pack(odd).collect()
    assert sum(len(r["doc_ids"]) for r in odd_rows) >= len(ODD) + 2 and fit_packing.pack(nothing).count() == 0


def test_language_on_held_out_documents(spark, docs, odd, nothing):
    model = ppm_language.train(ppm_language.training_part(docs))
    held = docs.where(common.remainder(docs["doc_id"], 3) == 1)
    got = ppm_language.identify(held, model, ("doc_id", "lang")).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    found = {r["doc_id"]: r for r in ppm_language.identify(odd, model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (0, 1, 2, 3, 5))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert ppm_language.train(nothing) is None and ppm_language.identify(nothing, None).count() == 0
    assert {r["lang_pred"] for r in ppm_language.identify(odd, None).collect()} == {"und"}
    assert all((r["bits"] is None) == (r["lang_pred"] == "und") for r in found.values())


def plain_bits(counts, text):
    """Code length of `text` by escapes with exclusion, from {gram of four bytes: n}, one byte after the other."""
    tables = [{} for _ in range(4)]
    for gram, n in counts.items():
        for order in range(4):
            own = tables[order].setdefault(gram[3 - order : 3], {})
            own[gram[3:]] = own.get(gram[3:], 0) + n
    data, bits = bytes(3) + text.encode(), 0.0
    for at in range(3, len(data)):
        symbol, used = data[at : at + 1], set()
        for order in (3, 2, 1, 0):
            near = {s: n for s, n in tables[order].get(data[at - order : at], {}).items() if s not in used}
            if not near:
                continue
            whole = sum(near.values()) + len(near)
            if symbol in near:
                bits -= np.log2(near[symbol] / whole)
                break
            bits -= np.log2(len(near) / whole)
            used |= set(near)
        else:
            bits += np.log2(256 - len(used))
    return bits


def test_code_lengths_equal_plain_dictionaries(spark):
    rows = [(prose(i, 30), "en") for i in range(20)] + [("größe über straße " + "aüß"[i % 3] * 3, "de") for i in range(20)] + [("x", "xx")]
    model = ppm_language.train(spark.createDataFrame(rows, "text string, lang string"))
    texts = ["the fox", "größe", "", "qqq 漢字", "a" * 50, prose(3, 8)]
    got = model.lengths(pa.array(texts))
    for k, lang in enumerate(model.langs):
        counts = {}
        for text, own in rows:
            data = bytes(3) + text.encode() if own == lang else b""
            for at in range(len(data) - 3):
                counts[data[at : at + 4]] = counts.get(data[at : at + 4], 0) + 1
        counts = {g: n for g, n in counts.items() if n >= ppm_language.LEAST}
        assert np.allclose(got[:, k], [plain_bits(counts, t) for t in texts])


def test_toxicity_on_held_out_documents(spark, odd, nothing):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    labels = common.table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train(toxicity.training_part(docs), labels)
    held = docs.where(common.remainder(docs["doc_id"], 4) == 2).join(labels, "doc_id")
    got = toxicity.score(held, model, ("doc_id", "toxic")).collect()
    positive, negative = ([r["score"] for r in got if r["toxic"] == k] for k in (1, 0))
    assert np.mean([p > n for p in positive for n in negative]) > 0.9
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(ODD) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)
    blank = toxicity.train(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(odd, blank).count() == len(ODD) + 2 and toxicity.score(nothing, blank).count() == 0


def test_simhash_components(docs, odd, nothing):
    for df in (docs, odd.where("doc_id IS NOT NULL")):
        rows = sorted(simhash.near_duplicates(df, width=3).collect(), key=lambda r: r["doc_id"])
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        ids = [r["doc_id"] for r in rows]
        prints = np.array([simhash.fingerprint(texts[i], 3) for i in ids], "<u8")
        assert [r["fingerprint"] for r in rows] == [f"{p:016x}" for p in prints]
        near = np.bitwise_count(prints[:, None] ^ prints) <= 3
        assert [r["component_id"] for r in rows] == pairs_roots(ids, zip(*np.nonzero(np.triu(near, 1))))
    assert simhash.near_duplicates(odd).count() == len(ODD) + 2 and simhash.near_duplicates(nothing).count() == 0


def test_hot_tiles_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3, dtype=np.int64)
    flips = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (150, 2))]
    values = sorted(set(flips) | set(map(int, base)))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(df, block=40)).collect()}
    bits = np.array(values, np.int64).view("<u8")
    near = np.bitwise_count(bits[:, None] ^ bits) <= 3
    want = pairs_roots(values, zip(*np.nonzero(np.triu(near, 1))))
    assert [roots.get(v, v) for v in values] == want


def test_similar_documents(spark, odd, nothing):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(40):
        words = prose(100 + i, 300).split()
        rows.append((3 * i, " ".join(words)))
        words[int(rng.integers(0, 300))] = "changed"
        rows += [(3 * i + 1, " ".join(words)), (3 * i + 2, prose(900 + i, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert all(got[3 * i + 1] == 3 * i == got[3 * i] and got[3 * i + 2] == 3 * i + 2 for i in range(40))
    assert simhash.similar_documents(odd).count() == len(ODD) + 2 and simhash.similar_documents(nothing).count() == 0


@pytest.mark.parametrize("crowd", (3, 30))
def test_similar_documents_just_above_and_below(spark, crowd):
    """Groups of copies with a few changed words, most pairs from a similarity of 0.7 to 0.9, against exact Jaccard."""
    rng = np.random.default_rng(crowd)
    rows = []
    for i in range(240 // crowd):
        base = [f"w{i}_{k}" for k in range(300)]
        for changes in rng.integers(0, 11, crowd):
            words = list(base)
            for at in rng.integers(0, 300, changes):
                words[at] = f"c{rng.integers(0, 1 << 40)}"
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for _, t in rows]
    near = [(i, j) for j in range(len(rows)) for i in range(j - j % crowd, j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert [got[i] for i in range(len(rows))] == pairs_roots(list(range(len(rows))), near)


def test_shingles_are_stored_only_of_texts_that_meet(spark, monkeypatch):
    """Two pairs of near copies among 40 other texts, rows without an id and repeated rows among them; a pair meets once."""
    near = {i: " ".join(["changed", *prose(i, 300).split()[1:]]) for i in (500, 501)}
    rows = [(i, prose(500 + i, 300)) for i in range(42)]
    rows += [(None, near[500]), (None, near[500]), (99, near[501]), (99, near[501]), (3, rows[3][1]), (77, rows[3][1])]
    made = []
    stored = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df: made.append(stored(df)) or made[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in simhash.similar_documents(df).collect())
    plain = [(False, i, i) for i in range(42)] + [(False, 3, 3), (False, 77, 3), (False, 99, 1), (False, 99, 1), (True, 0, 0), (True, 0, 0)]
    assert got == sorted(plain)
    assert sum(t.count() for t in made if "shingles" in t.columns) == 4
    assert sum(t.count() for t in made if t.columns == ["tile", "node"]) == 4


def test_near_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    some = [*base, *(base[:100] + 0.05 * rng.normal(size=(100, 16))), *[base[0]] * 50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(some)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, []), (1005, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    unit = np.array(some) / np.linalg.norm(some, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = pairs_roots(list(range(len(some))), zip(*np.nonzero(np.triu(near, 1))))
    got = {r["vec_id"]: r for r in tile_embeddings.near_embeddings(df, per_pivot=60, block=50).collect()}
    links = sum(got[i]["n_links"] for i in range(len(some)))
    assert 0.9 * near.sum() <= links <= near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(len(some)))
    assert np.mean([got[i]["component_id"] == w for i, w in enumerate(want)]) > 0.95
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _ in bad)
    whole = {r["vec_id"]: r for r in tile_embeddings.near_embeddings(df).collect()}  # one cell: exact
    assert [whole[i]["n_links"] for i in range(len(some))] == near.sum(axis=1).tolist() and [whole[i]["component_id"] for i in range(len(some))] == want
    assert tile_embeddings.near_embeddings(df.limit(0)).count() == 0


def test_crowd_of_noisy_near_copies(spark):
    """A third of the rows around one centre, with far more pivots drawn from it than a vector visits."""
    rng = np.random.default_rng(4)
    centre, noise = rng.normal(size=64), rng.normal(size=(1500, 64))
    centre /= np.linalg.norm(centre)
    noise -= (noise @ centre)[:, None] * centre
    crowd = 0.96 * centre + 0.28 * noise / np.linalg.norm(noise, axis=1)[:, None]
    some = np.concatenate([crowd, rng.normal(size=(3000, 64))])
    unit = some / np.linalg.norm(some, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(some)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in tile_embeddings.near_embeddings(df, per_pivot=20, block=400).collect()}
    assert all(got[i] <= n for i, n in enumerate(near.sum(axis=1)))
    assert sum(got.values()) >= 0.9 * near.sum() > 1000


def test_links_between_far_cells(spark):
    """Vectors of 64 numbers that lie in six directions only: what is off a vector's way to its pivot is not spread over all."""
    rng = np.random.default_rng(7)
    unit = rng.normal(size=(1500, 6))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, [*v.tolist(), *[0.0] * 58]) for i, v in enumerate(unit)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in tile_embeddings.near_embeddings(df, per_pivot=2, block=400).collect()}
    assert near.sum() > 1000 and [got[i] for i in range(len(unit))] == near.sum(axis=1).tolist()


def test_tile_products_are_exact_in_one_narrow_pass():
    """Few and many near pairs, some on the threshold; a tile without links holds five bytes a pair, not matrices of doubles."""
    rng = np.random.default_rng(11)
    for crowd in (5, 400):
        base = rng.normal(size=(1, 24)) * np.exp(rng.normal(size=24))
        some = np.concatenate([rng.normal(size=(600, 24)), base + 0.12 * np.linalg.norm(base) / 24**0.5 * rng.normal(size=(crowd, 24)) * rng.uniform(0.5, 3, (crowd, 1))])
        unit = tile_embeddings.unit_rows(some)
        for threshold in (0.95, float(unit[600] @ unit[601])):
            want = np.array([np.einsum("ij,ij->i", np.broadcast_to(x, unit.shape), unit) for x in unit]) >= threshold
            assert (tile_embeddings.linked(unit, unit, threshold) == want).all() and want.sum() > len(unit)
    unit = tile_embeddings.unit_rows(rng.normal(size=(2000, 64)))
    tracemalloc.start()
    assert not tile_embeddings.linked(unit[:1000], unit[1000:], 0.95).any()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 1000 * 1000


def test_packed_vectors_lose_nothing():
    rows = np.array([[1.0, -0.5, 0.0], [0.1, 2.0, 3.0], [1e300, 1.0, 1e-310], [1e-46, 1.0, 2.0]])
    packed = [tile_embeddings.packed(v) for v in rows]
    assert [len(v) for v in packed] == [12, 24, 24, 24] and (tile_embeddings.unpacked(packed, 3) == rows).all()


def test_pipeline_stages(spark, sf_dir, odd):
    import corpus_pipeline

    docs = common.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.stored(stage(spark, docs, sf_dir))
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = kept
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd.select(*corpus_pipeline.COLUMNS), sf_dir).count()
        stage(spark, odd.select(*corpus_pipeline.COLUMNS).limit(0), sf_dir).count()


def test_toxicity_stage_by_labels(spark):
    """At 4000 labels, of which 65 mark toxic German, 72 French and 33 Spanish documents."""
    import corpus_pipeline

    large = "/root/testdata/sf0.1"
    docs = common.table(spark, large, "documents")
    labels = {r["doc_id"]: (r["toxic"], r["lang"]) for r in common.table(spark, large, "labels").join(docs, "doc_id").select("doc_id", "toxic", "lang").collect()}
    left = [labels.get(r["doc_id"], (None, None)) for r in corpus_pipeline.toxic(spark, docs, large).select("doc_id").collect()]
    known = list(labels.values())
    for lang in ("en", "de", "fr", "es"):
        assert left.count((1, lang)) <= 0.15 * known.count((1, lang))
    assert sum(t == 0 for t, _ in left) >= 0.995 * sum(t == 0 for t, _ in known)


def plain_ratios(counts):
    """Kneser-Ney log-likelihood ratio of each n-gram (bytes) from {gram: (toxic, ordinary)}, and of unseen ones by context."""
    def below(types, gram):
        if not gram:
            return 1 / 256
        level = {}
        for t in types:
            level.setdefault(t[-len(gram) :], set()).add(t[-len(gram) - 1 :])
        near = {t: len(v) for t, v in level.items() if t[:-1] == gram[:-1]}
        total = sum(near.values())
        return max(near[gram] - 0.75, 0) / total + 0.75 * len(near) / total * below(types, gram[1:])

    ratio, backoff = {}, {}
    for gram in counts:
        logs = []
        for k in (0, 1):
            own = {g: c[k] for g, c in counts.items() if g[:-1] == gram[:-1]}
            total = sum(own.values())
            rest = 0.75 * sum(c > 0 for c in own.values()) / total if total else 1.0
            logs.append((np.log((max(own[gram] - 0.75, 0) / total if total else 0) + rest * below(counts, gram[1:])), np.log(rest)))
        ratio[gram] = logs[0][0] - logs[1][0]
        backoff[gram[:-1]] = logs[0][1] - logs[1][1]
    return ratio, backoff


def test_ratios_equal_plain_kneser_ney(spark):
    rng = np.random.default_rng(11)
    grams = {bytes(rng.integers(97, 100, 5).tolist()): tuple(map(int, rng.integers(0, 4, 2))) for _ in range(60)}
    grams = {g: c for g, c in grams.items() if sum(c)}
    rows = [(int.from_bytes(g, "big"), *c) for g, c in grams.items()]
    model = toxicity.build(spark.createDataFrame(rows, "gram long, toxic long, ordinary long"))
    ratio, backoff = plain_ratios(grams)
    assert model.grams.tolist() == sorted(int.from_bytes(g, "big") for g in grams)
    assert np.allclose(model.ratio, [ratio[g.to_bytes(5, "big")] for g in model.grams.tolist()], atol=1e-4)
    assert np.allclose(model.backoff, [backoff[c.to_bytes(4, "big")] for c in model.contexts.tolist()], atol=1e-4)


def test_evidence_is_length_normalised(spark):
    docs = spark.createDataFrame([(i, f"plain words here {i} " + ("vile" if i % 10 == 0 else "kind")) for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 10 = 0 AS INT) AS toxic")
    model = toxicity.train(docs, labels)
    table = toxicity.WordTable(model.word_ratios)
    texts = ["", "vile plain", "plain plain vile vile words", "kind"]
    got = toxicity.evidence(model, table, pa.array(texts))
    for row, text in zip(got, texts):
        words = text.split()
        value = {w: np.frombuffer(model.word_ratios([w])[0], "<f4") for w in words}
        best = sorted((max(0.0, float(v[0])) / (float(v[1]) + 16) for v in value.values()), reverse=True) + [0.0] * 8
        whole = sum(value[w][0] for w in words) / max(1, sum(value[w][1] for w in words))
        assert np.allclose(row, [1, whole, best[0], np.mean(best[1:4]), np.mean(best[4:8]), np.log1p(len(value))], atol=1e-4)
    assert got[1, 2] > got[3, 2] and (model.weights[1:-1] >= 0).all()
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(scored[i] == (i % 10 == 0) for i in range(400))


def test_rare_toxic_grams_stay_in_the_model(spark):
    """An n-gram of one document counts, however many n-grams the others of its class have."""
    long = " ".join(f"{a}{b}{c}{d}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" for c in "abcdefghijklmnop" for d in "abcdefgh")
    counted = next(i for i in range(2, 400, 2) if zlib.crc32(str(i).encode()) % 20 >= 4)
    rows = [(i, long + (" zyqx" if i == counted else ""), int(i % 2 == 0)) for i in range(1, 301)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(8)
    model = toxicity.train(docs, docs.select("doc_id", "toxic"), sample=10)
    assert np.isin(toxicity.grams_of(["zyqx"])[0], model.grams).all()


def test_language_stage_without_any_label_keeps_texts_with_letters(spark):
    import corpus_pipeline

    rows = [(1, "clean text", None, "s", 10), (2, "12 34", None, "s", 5), (3, None, None, "s", 0), (4, "Größe", None, "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, df, None).collect()) == [1, 4]


def test_language_stage_names_and_rejects(spark):
    import corpus_pipeline

    rows = [(i, prose(i, 40), "en" if i % 7 else None, "s", 10) for i in range(60)]
    rows += [(100, "漢字仮名交じり文は日本語の文章です" * 20, None, "s", 5), (101, "ok 12", None, "s", 5), (102, None, "en", "s", 0), (None, prose(5, 40), None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, df, None).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [*range(60), 101] and len(kept) == 62
    assert {r["lang"] for r in kept} == {"en"}


def test_near_duplicate_stage_with_rows_without_id(spark):
    import corpus_pipeline

    a, b, c = prose(1, 300), prose(2, 300), prose(3, 300)
    near = " ".join([*b.split()[:-1], "changed"])
    rows = [(7, a, None, "s", 1), (None, a, None, "s", 1), (None, b, "en", "s", 1), (None, near, "en", "s", 1), (None, b, "en", "s", 1), (9, c, None, None, None), (3, None, None, None, None), (4, "", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, None).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [3, 7, 9]
    assert len(kept) == 4 and next(r["text"] for r in kept if r["doc_id"] is None) in (b, near)


def test_documents_of_the_fit_are_counted(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 20 < 4]
    rows = [(i, f"plain words {'zyqx' if i in held else 'kind'}", i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"), sample=10)
    assert np.isin(toxicity.grams_of(["zyqx"])[0], model.grams).all()


def test_resampling_features_over_lines(spark, odd, nothing):
    """Runs of one to three words with crossing line ends, against a plain count, and ranks over several ranges."""
    def runs(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return [zlib.crc32(" ".join(words[i : i + k]).encode()) % 500 for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)

    rows = [(i, f"Same line\n{prose(i, 25)}\n\nÉté {i}\nsame LINE again\n") for i in range(90)] + [(90, None), (91, ""), (92, "short"), (None, prose(7, 30)), (5, prose(8, 30))]
    target = [(i, prose(i + 40, 30)) for i in range(20)]
    docs, texts = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(target, "item long, text string")
    s, t = np.zeros(500), np.zeros(500)
    for total, table in ((s, rows), (t, target)):
        for _, text in table:
            np.add.at(total, runs(text)[0], 1)
    assert resampling.feature_counts(docs, 3, 500).tolist() == s.tolist()
    gain = np.floor(1000 * np.log((t + 1) * (s.sum() + 500) / ((s + 1) * (t.sum() + 500))))
    want = []
    for doc_id, text in rows:
        found, n = runs(text)
        h = int(hashlib.sha256(f"9:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = int(sum(gain[b] for b in found))
        want.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], w[0] is None, w[0]))
    rank = {id(w): k + 1 for k, w in enumerate(drawn[: len(drawn) * 30 // 100])}
    got = resampling.resample(docs, texts, width=3, buckets=500, percent=30, seed=9).collect()
    key = lambda row: str(row)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((*w[:4], rank.get(id(w))) for w in want), key=key)
    assert resampling.resample(odd, texts).count() == len(ODD) + 2 and resampling.resample(nothing, texts).count() == 0
    assert resampling.resample(docs, nothing).count() == len(rows)


def test_additive_quality(spark, odd, nothing):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    labels = common.table(spark, "/root/testdata/sf0.1", "labels")
    got = additive_quality.rate_quality(docs, labels, additive_quality.learning_ids())
    held = got.where(common.remainder(got["doc_id"], 4) == 2).join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.99
    for table in (odd, odd.where("doc_id = 5")):
        scored = additive_quality.rate_quality(table, labels.where("doc_id < 300")).collect()
        assert len(scored) == table.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    assert additive_quality.rate_quality(nothing, labels).count() == 0
    assert {r["score"] for r in additive_quality.rate_quality(odd, labels.where("doc_id < 0")).collect()} == {0.5}


def test_additive_model_learns_an_interaction():
    """Exclusive or of two features has no main effect; the pair's table finds it, and a score is the sum of table entries."""
    rng = np.random.default_rng(1)
    values = rng.normal(size=(3000, len(additive_quality.FEATURES)))
    label = ((values[:, 3] > 0) != (values[:, 8] > 0)).astype(float)
    model = additive_quality.fit(values, label, np.arange(3000) % 5 == 0)
    assert (3, 8) in model.pairs
    fresh = rng.normal(size=(1000, values.shape[1]))
    assert np.mean((model.score(fresh) > 0.5) == ((fresh[:, 3] > 0) != (fresh[:, 8] > 0))) > 0.95
    bins = model.bins(fresh[:1])[0]
    coarse = model.coarse(bins[None])[0]
    total = model.base + sum(t[b] for t, b in zip(model.tables, bins)) + sum(g[coarse[a], coarse[b]] for (a, b), g in zip(model.pairs, model.grids))
    assert np.isclose(model.score(fresh[:1])[0], 1 / (1 + np.exp(-total)))


def test_measures_of_texts():
    found = additive_quality.measure(pa.array(["Ab cd! ab 12 Ab cd!", "", "x\nx\ny", "ÄÖ###"]))
    first = dict(zip(additive_quality.FEATURES, found[0]))
    assert np.isclose(first["different_words"], 4 / 6) and np.isclose(first["commonest_word"], 2 / 6) and np.isclose(first["without_letters"], 1 / 6)
    assert np.isclose(first["capitals"], 2 / 10) and np.isclose(first["different_pairs"], 4 / 5) and not found[1].any()
    assert np.isclose(dict(zip(additive_quality.FEATURES, found[2]))["repeated_lines"], 1 / 3)
    assert np.isclose(dict(zip(additive_quality.FEATURES, found[3]))["symbol_ends"], 1)


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("hot", (spelling.HOT, 2))
def test_spelling_variants(spark, odd, nothing, hot):
    """Against all pairs of words, also with every initial state split around the edit."""
    rng = np.random.default_rng(6)
    stems = ["lantern", "lanternes", "größer", "abcde", "bbbbbb"]
    words = set(stems)
    for stem in stems * 12:
        at, c = int(rng.integers(0, len(stem) + 1)), "abné"[int(rng.integers(0, 4))]
        words |= {stem[:at] + c + stem[at:], stem[:at] + stem[at + 1 :], stem[:at] + c + stem[at + 1 :]}
    rows, counts = [], {}
    for i in range(40):
        text = " ".join(w.upper() if rng.random() < 0.1 else w for w in words for _ in range(int(rng.integers(0, 1 + len(w) % 4 + (w in stems) * 9))))
        rows.append((i, text))
    rows += [(None, "lantern" + " lantern" * 5), (3, None), (4, ""), (5, "q" * 3000 + " " + "q" * 3000 + " " + "q" * 2999 + "w q" * 3)]
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            counts[run] = counts.get(run, 0) + 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 2}
    others = {w: sorted((v for v in kept if near(v, w)), key=lambda v: (-kept[v], v)) for w in kept}
    form = {w: o[0] if o and kept[o[0]] >= 2 * kept[w] else None for w, o in others.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(df, least_count=2, hot=hot).collect()}
    assert got == {w: (form[w], root(w), n, len(others[w]), kept.get(form[w])) for w, n in kept.items()}
    assert sum(f is not None for f in form.values()) > 20
    spelling.group_variants(odd, hot=hot).collect()
    assert spelling.group_variants(nothing).count() == 0


@pytest.mark.parametrize("name", ("op2_line_dedup", "op11_resampling", "op13_spelling"))
def test_corpus_queries_match_check(spark, sf_dir, name):
    from check import compare

    from gravure.llm import queries

    assert compare(spark, sf_dir, name, queries.QUERIES[name], queries.ORACLES[name]).startswith("ok")
