"""Whole texts as sequences of distinct words: every different word of a slice is encoded once.

A tokenizer whose pieces never cross a space gives the same ids for a text and for its words in
turn, so a worker keeps a bounded table of words it has seen and gathers whole texts from it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class WordTable:
    """Word -> fixed-width values as bytes, for at most about `limit` words.

    Two generations: a word met again moves to the new one; what was not met again is dropped when the
    new one is half full and becomes the old (only speed changes).
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[bytes]], limit: int = 400_000):
        self.encode, self.half, self.new, self.old = encode, limit // 2, {}, {}

    def values(self, words: list[str]) -> list[bytes]:
        new, old = self.new, self.old
        missing = [w for w in words if w not in new]
        new.update((w, old[w]) for w in missing if w in old)
        unknown = [w for w in missing if w not in old]
        if unknown:
            new.update(zip(unknown, self.encode(unknown)))
        found = [new[w] for w in words]
        if len(new) > self.half:
            self.new, self.old = {}, new
        return found


def split_words(texts: pa.Array, separator: str = " ") -> tuple[pa.Array, np.ndarray]:
    """All words in order and each text's bounds among them."""
    lists = pc.split_pattern(texts, separator)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), bounds - bounds[0]


def distinct_words(words: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = words.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def gather(values: list[bytes], index: np.ndarray, bounds: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of words index[0], index[1], ... in a row, and each text's bounds among them."""
    pool = np.frombuffer(b"".join(values), dtype=dtype)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(dtype).itemsize
    starts = np.cumsum(sizes) - sizes
    per_word = sizes[index]
    ends = np.concatenate([[0], np.cumsum(per_word)])
    at = np.arange(ends[-1]) + np.repeat(starts[index] - ends[:-1], per_word)
    return pool[at], ends[bounds]


def in_order(regular: np.ndarray, flat: np.ndarray, bounds: np.ndarray, others: list[np.ndarray]) -> list[np.ndarray]:
    """One array per text: the next gathered one where `regular`, else the next of `others`."""
    gathered = (flat[a:b] for a, b in zip(bounds[:-1], bounds[1:]))
    rest = iter(others)
    return [next(gathered) if ok else next(rest) for ok in regular]
