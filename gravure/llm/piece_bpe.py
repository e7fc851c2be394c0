"""Byte-level BPE through a sentencepiece model that is written from the ranks themselves."""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravure.llm.common import slices, texts
from gravure.llm.words import WordTable, distinct_words, gather, in_order, split_words

BYTE_BPE = "byte_bpe_50k.tiktoken"
#: A space between another white space and more white space (or the end) can join either token.
UNSURE = r"[\s\v\x1c-\x1f\x{85}\x{a0}\p{Z}] ([\s\v\x1c-\x1f\x{85}\x{a0}\p{Z}]|\z)"


def byte_letters() -> list[str]:
    """One printable character for each byte: its own where printable in Latin-1, else the next from U+0100."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return [chr(b) if ok else chr(256 + shown[:b].count(False)) for b, ok in enumerate(shown)]


def _varint(number: int) -> bytes:
    out = bytearray()
    while number > 127:
        out.append(number & 127 | 128)
        number >>= 7
    return bytes(out + bytes([number]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: an integer, a 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece i is the token of rank i in byte letters with score -i.

    Identity normalisation: no character map, no added, removed or escaped spaces. One unknown piece,
    which no byte letters can spell, follows the last rank.
    """
    letters = byte_letters()
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    pieces = [_field(1, "".join(letters[b] for b in t).encode()) + _field(2, -float(i)) for i, t in enumerate(order)]
    unknown = _field(1, "⁇unk".encode()) + _field(2, 0.0) + _field(3, 2)
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(40, len(order)) + _field(41, -1 & (1 << 64) - 1) + _field(42, -1 & (1 << 64) - 1) + _field(43, -1 & (1 << 64) - 1) + _field(45, "⁇unk".encode())
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in [*pieces, unknown]) + _field(2, trainer) + _field(3, normal)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class ByteBpe:
    """Encodes by ranks, each match of `pattern` on its own; decodes by the inverse mapping."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.letters = dict(enumerate(byte_letters()))
        self.split = regex.compile(pattern).findall
        back = {ord(letter): byte for byte, letter in self.letters.items()}
        names = (self.model.id_to_piece(i) for i in range(len(ranks)))
        self.bytes_of = [name.translate(back).encode("latin-1") for name in names]
        self.text_of = [str(i) for i in range(len(ranks))]
        self.pieces = WordTable(self._pieces)
        self.words = WordTable(self._words)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        mapped = [p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        out = []
        for start in range(0, len(mapped), 4096):
            out += [np.array(ids, "<u4").tobytes() for ids in self.model.encode(mapped[start : start + 4096], num_threads=1)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        split = [self.split(w) for w in words]
        known = iter(self.pieces.values([p for pieces in split for p in pieces]))
        return [b"".join([next(known) for _ in pieces]) for pieces in split]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids per text. Words keep the space before them, so a text is the sequence of its words' matches;
        where white space meets a space the pattern may join them, and such texts are split whole."""
        unsure = pc.match_substring_regex(column, UNSURE).to_numpy(zero_copy_only=False)
        words, bounds = split_words(column.filter(pa.array(~unsure)))
        names, index = distinct_words(words)
        first = bounds[:-1]
        opening, opened = distinct_words(words.take(pa.array(first)))
        index = index.astype(np.int64)
        index[first] = opened + len(names)
        values = self.words.values([" " + n for n in names] + opening)
        flat, at = gather(values, index, bounds, "<u4")
        others = [np.frombuffer(self._words([column[k].as_py()])[0], "<u4") for k in np.flatnonzero(unsure)]
        return in_order(~unsure, flat, at, others)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(1)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ids=True, ids.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the bytes that the ids decode
    to. Null and empty texts have no ids (digests of nothing). Repeated rows and null doc_ids give a row
    each; an empty table gives none; other columns are ignored. Nothing is shuffled. Very long texts and
    runs without a space are encoded whole: the merges cost n log n in a run's length.
    """
    where = path or public_tokenizers.path(BYTE_BPE)
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        bpe = codec(where)
        for part in slices(batches, "text"):
            coded = [row.tolist() for row in bpe.encode(texts(part))]
            arrays = [
                part.column("doc_id"),
                pa.array([len(row) for row in coded], pa.int64()),
                pa.array([hashlib.sha256(" ".join(map(bpe.text_of.__getitem__, row)).encode()).hexdigest() for row in coded], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(row)).hexdigest() for row in coded], pa.string()),
                *([pa.array(coded, pa.list_(pa.int32()))] if ids else []),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, fields)


def decode_documents(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes that `ids` stand for; null ids give null."""
    where = path or public_tokenizers.path(BYTE_BPE)

    def run(batches):
        bpe = codec(where)
        for part in batches:
            rows = [None if row is None else bpe.decode(row) for row in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "content"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")
