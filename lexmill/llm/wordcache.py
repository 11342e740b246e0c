"""Per-worker memory of what distinct words turn into; work is done once a word, texts only gather."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array


class WordCache:
    """Exact map from words to runs of integers.

    A word is found by its 64-bit hash and then compared as a string, so equal hashes never mix words. At
    ``most`` words the memory starts anew; that changes speed only.
    """

    def __init__(self, compute: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], dtype=np.uint32, most: int = 1_200_000):
        self.compute, self.dtype, self.most = compute, dtype, most
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.order = np.empty(0, np.int64)
        self.words = pa.array([], pa.large_string())
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.values = np.empty(0, self.dtype)

    def runs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, start, size): word i stands for values[start[i] : start[i] + size[i]]. ``words`` are distinct."""
        words = words.cast(pa.large_string())
        if len(self.words) + len(words) > self.most:
            self._clear()
        h = hash_array(words.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)
        at = np.searchsorted(self.hashes, h)
        found = np.zeros(len(h), bool)
        place = np.zeros(len(h), np.int64)
        inside = at < len(self.hashes)
        same = np.flatnonzero(inside)
        same = same[self.hashes[at[same]] == h[same]]
        if len(same):
            rows = self.order[at[same]]
            equal = pc.equal(pc.take(self.words, pa.array(rows)), pc.take(words, pa.array(same)))
            equal = equal.to_numpy(zero_copy_only=False).astype(bool)
            found[same[equal]], place[same[equal]] = True, rows[equal]
        start, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int32)
        start[found], size[found] = self.start[place[found]], self.size[place[found]]
        new = np.flatnonzero(~found)
        if len(new):
            fresh = pc.take(words, pa.array(new))
            sizes, values = self.compute(fresh)
            starts = len(self.values) + np.cumsum(sizes) - sizes
            start[new], size[new] = starts, sizes
            rows = len(self.words) + np.arange(len(new))
            by = np.argsort(h[new], kind="stable")
            into = np.searchsorted(self.hashes, h[new][by], side="right")
            self.hashes, self.order = np.insert(self.hashes, into, h[new][by]), np.insert(self.order, into, rows[by])
            self.words = pa.concat_arrays([self.words, fresh])
            self.start, self.size = np.concatenate((self.start, starts)), np.concatenate((self.size, sizes.astype(np.int32)))
            self.values = np.concatenate((self.values, values.astype(self.dtype)))
        return self.values, start, size


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + size[i]] for all i, one after the other."""
    size = size.astype(np.int64)
    total = int(size.sum())
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return values[np.arange(total) + shift]
