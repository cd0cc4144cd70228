"""A bounded memory of what words encode to, which a worker process keeps over tasks."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def little(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    out = array("i", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


LONGEST = 64  # characters of a word that is kept


class Generation(dict):
    """word -> bytes; a word that is missing is looked up in the generation before, or made."""

    def __init__(self, make: Callable[[str], bytes], before: dict[str, bytes]):
        super().__init__()
        self.make, self.before = make, before

    def __missing__(self, word: str) -> bytes:
        value = self.before.get(word)
        value = self.make(word) if value is None else value
        if len(word) <= LONGEST:
            self[word] = value
        return value


class WordCache:
    """word -> bytes, in two generations: words met again move to the young one, and when that is full the old one goes.

    A generation has `most` words (some 200 bytes each) and what the texts between two calls of
    table() add.
    """

    def __init__(self, make: Callable[[str], bytes], most: int = 600_000):
        self.make, self.most = make, most
        self.young = Generation(make, {})

    def table(self) -> Generation:
        """A table that has the value of any word, good until the next call."""
        if len(self.young) > self.most:
            self.young.before = {}
            self.young = Generation(self.make, self.young)
        return self.young

    def spread(self, data: np.ndarray, at: np.ndarray, off: np.ndarray, trim: str = "") -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words that the bounds at cut data into, in a row, and how many each text (bounds off) has.

        Each different word is looked up once; trim: characters that words lose in front.
        """
        words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        which = words.indices.to_numpy()
        names = pc.ascii_ltrim(words.dictionary, trim) if trim else words.dictionary
        known = list(map(self.table().__getitem__, names.to_pylist()))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, start = np.frombuffer(b"".join(known), "<i4"), np.cumsum(size) - size
        sizes = size[which]
        ends = np.cumsum(sizes)
        ids = flat[np.arange(int(sizes.sum())) + np.repeat(start[which] - (ends - sizes), sizes)]
        before = np.concatenate([[0], ends])
        return ids, np.diff(before[np.searchsorted(at, off)])
