"""Token ids of the lower-casing word vocabulary, piece by piece, equal to the tokenizers library's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
#: Pieces that a worker keeps at most, about.
KEPT = 400_000
#: Printable Latin-1 without the soft hyphen and the apostrophe: characters that are already in composed form.
PLAIN = regex.compile(r"[\x21-\x26\x28-\x7e\xa1-\xac\xae-\xff]*")
GAP, LETTER, NUMBER, OTHER = range(4)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte alone, of the one after C2 and of the one after C3, as the vocabulary's own pattern has them."""
    alone, c2, c3 = (np.full(256, OTHER, np.uint8) for _ in range(3))
    alone[[10, 32]] = GAP
    alone[65:91] = alone[97:123] = LETTER
    alone[48:58] = NUMBER
    c2[[0xAA, 0xB5, 0xBA]] = LETTER
    c2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
    c3[0x80:0xC0] = LETTER
    c3[[0x97, 0xB7]] = OTHER
    return alone, c2, c3


ALONE, AFTER_C2, AFTER_C3 = _classes()
ODD = np.zeros(256, bool)
ODD[:33] = ODD[39] = ODD[127] = ODD[196:] = True
ODD[[10, 32]] = False


def pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters, single numbers and runs of other characters of all texts, and each text's bounds among them.

    That is how the vocabulary's file splits a text. Words (between spaces and line ends) with anything
    but printable Latin-1, an apostrophe or what could be a special token stay whole and as they are.
    """
    column = pc.cast(column, pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(whole, np.uint8)[ends[0] : ends[-1]] if whole is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    n = len(raw)
    second2, second3 = np.zeros(n, bool), np.zeros(n, bool)
    second2[1:], second3[1:] = raw[:-1] == 0xC2, raw[:-1] == 0xC3
    kind = ALONE[raw]
    kind[second2], kind[second3] = AFTER_C2[raw[second2]], AFTER_C3[raw[second3]]
    second = second2 | second3
    lead = np.flatnonzero(second) - 1
    kind[lead] = kind[lead + 1]
    data = raw.copy()
    data[(raw >= 65) & (raw <= 90)] += 32
    data[second3 & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 32
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    first = edge[:-1].copy()
    first[1:] |= kind[1:] != kind[:-1]
    first |= kind == NUMBER
    first &= (kind != GAP) & ~second
    odd = ODD[raw] | second2 & ((raw <= 0xA0) | (raw == 0xAD))
    odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
    if odd.any():
        gap = kind == GAP
        word = edge[:-1].copy()
        word[1:] |= gap[:-1]
        number = np.cumsum(word | gap)
        strange = np.zeros(int(number[-1]) + 1, bool)
        strange[number[odd]] = True
        inside = strange[number] & ~gap
        first[inside] = word[inside]
        data[inside] = raw[inside]
    starts = np.flatnonzero(first)
    kept = kind != GAP
    offsets = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[np.append(starts, n)]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
    return found, np.searchsorted(starts, ends)


class Store:
    """Ids of pieces in one array."""

    def __init__(self):
        self.slots: dict[bytes, int] = {}
        self.ids, self.used, self.starts, self.sizes = np.zeros(1024, np.uint32), 0, np.zeros(1024, np.uint32), np.zeros(1024, np.uint32)

    def add(self, names: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.slots)
        self.slots.update(zip(names, range(at, at + len(names))))
        while len(self.starts) < at + len(names):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        ends = np.cumsum(sizes)
        self.starts[at : at + len(names)] = self.used + ends - sizes
        self.sizes[at : at + len(names)] = sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def find(self, names: list[bytes]) -> np.ndarray:
        get = self.slots.get
        return np.fromiter((get(name, -1) for name in names), np.int64, len(names))

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in the slots, in a row, and each one's number of them."""
        sizes = self.sizes[slots].astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[slots] - (ends - sizes), sizes)
        return self.ids[at], sizes


class WordIds:
    """Ids of texts by the word vocabulary at `path`, with a bounded table of pieces for as long as the object lives.

    The table has two generations: a piece met again moves to the new one, what was not is dropped when
    the new one is half full and becomes the old.
    """

    def __init__(self, path: str, kept: int = KEPT):
        self.whole = Tokenizer.from_file(path)
        self.merges, self.half = self.whole.model, kept // 2
        self.new, self.old = Store(), Store()
        table, extra = {}, 256
        for byte in range(256):
            shown = 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174
            table[byte] = byte if shown else extra
            extra += not shown
        self.letters = table

    def encode(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Plain pieces by the library's own merges, any other word by the library whole."""
        found: list = [None] * len(names)
        others = []
        for k, name in enumerate(names):
            word = name.decode()
            if PLAIN.fullmatch(word) and "<|" not in word:
                shown = word if word.isascii() else name.decode("latin-1").translate(self.letters)
                found[k] = [t.id for t in self.merges.tokenize(shown)]
            else:
                others.append((k, word))
        for (k, _), coded in zip(others, self.whole.encode_batch([w for _, w in others], add_special_tokens=False)):
            found[k] = coded.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes

    def lookup(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces in a row, and each one's number of them."""
        slots = self.new.find(names)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            wanted = [names[k] for k in missing]
            before = self.old.find(wanted)
            again, fresh = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
            at = len(self.new.slots)
            self.new.add([wanted[k] for k in again], *self.old.gather(before[again]))
            unknown = [wanted[k] for k in fresh]
            self.new.add(unknown, *self.encode(unknown))
            slots[missing[again]] = np.arange(at, at + len(again))
            slots[missing[fresh]] = np.arange(at + len(again), at + len(missing))
        found = self.new.gather(slots)
        if len(self.new.slots) > self.half:
            self.old, self.new = self.new, Store()
        return found

    def document_ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's bounds."""
        found, bounds = pieces(column)
        coded = found.dictionary_encode()
        ids, sizes = self.lookup(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy(zero_copy_only=False)
        starts, per_piece = np.cumsum(sizes) - sizes, sizes[index]
        ends = np.concatenate([[0], np.cumsum(per_piece)])
        at = np.arange(ends[-1]) + np.repeat(starts[index] - ends[:-1], per_piece)
        return ids[at], ends[bounds]

    def with_end(self, column: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """Each text's ids followed by `end_id`."""
        flat, bounds = self.document_ids(column)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.append(flat[a:b], np.uint32(end_id))


def default_path() -> str:
    return public_tokenizers.path(WORD_BPE)
