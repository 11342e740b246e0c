"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary's pieces form a byte trie. Where a node has no child for the next byte, the longest pieces
matched so far are given up: a failure link leads to the node that holds what is left of the text read,
and ``popped`` is the number of pieces that go. A word thus takes at most two steps a byte, however the
pieces overlap, and no piece is built. Distinct words of a batch are walked together, one step of all
words at a time, words over ``LONG`` bytes one after the other in a plain loop, which takes no longer a
byte; each word is counted once and texts only sum.

Words are runs without ASCII white space; each is read with a leading space, as the vocabulary's
word-initial pieces are. A word that the pieces cannot spell counts as one unknown piece.

Defined cases: a null or blank text has no words and no pieces; repeated rows and nulls in other columns
do not matter; a word of any length is walked in the same way; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import slices, split_words
from .wordcache import WordCache

LONG = 256
_COUNTERS: dict = {}


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a file with a base64 piece and a rank on each line."""
    import base64

    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """Trie, failure links and popped counts of a list of byte pieces."""

    def __init__(self, pieces: list[bytes]):
        import numpy as np

        children: list[dict[int, int]] = [{}]
        whole = [False]
        for p in pieces:
            at = 0
            for b in p:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = children[at][b] = len(children)
                    children.append({})
                    whole.append(False)
                at = nxt
            whole[at] = at > 0
        n = len(children)
        fail, popped, rest = [-1] * n, [0] * n, [-1] * n  # rest: pieces in what a node has read, -1 if they cannot spell it
        rest[0] = 0
        queue = [0]
        for at in queue:
            for b, child in children[at].items():
                queue.append(child)
                if whole[child]:
                    fail[child], popped[child] = 0, 1
                else:
                    back, gone = fail[at], popped[at]
                    while back >= 0 and b not in children[back]:
                        gone += popped[back]
                        back = fail[back]
                    fail[child], popped[child] = (children[back][b], gone) if back >= 0 else (-1, 0)
                if fail[child] >= 0 and rest[fail[child]] >= 0:
                    rest[child] = popped[child] + rest[fail[child]]
        keys = np.array([at << 8 | b for at, c in enumerate(children) for b in c], np.int64)
        goal = np.array([x for c in children for x in c.values()], np.int64)
        by = np.argsort(keys)
        self.keys, self.goal = keys[by], goal[by]
        self.steps = None  # the same edges as a dictionary, made for the first long word
        self.fail, self.popped, self.rest = np.array(fail), np.array(popped), np.array(rest)

    def counts(self, data, start, size):
        """Pieces of the byte runs data[start[i] : start[i] + size[i]]; 1 for runs that cannot be spelled."""
        import numpy as np

        out = np.zeros(len(start), np.int64)
        long = np.flatnonzero(size > LONG)
        for i in long.tolist():
            out[i] = self.walked(data[start[i] : start[i] + size[i]].tobytes())
        short = np.flatnonzero(size <= LONG)
        out[short] = self._together(data, start[short], size[short])
        return out

    def walked(self, word: bytes) -> int:
        """Pieces of one word, step by step."""
        if self.steps is None:
            self.steps = dict(zip(self.keys.tolist(), self.goal.tolist()))
            self.plain = (self.fail.tolist(), self.popped.tolist())
        (fail, popped), at, total = self.plain, 0, 0
        for b in word:
            to = self.steps.get(at << 8 | b)
            while to is None:
                total += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
                to = self.steps.get(at << 8 | b)
            at = to
        left = int(self.rest[at])
        return total + left if left >= 0 else 1

    def _together(self, data, start, size):
        import numpy as np

        n = len(start)
        total, state, at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(size > 0)
        while len(live):
            s = state[live]
            key = s << 8 | data[start[live] + at[live]]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[edge] == key
            ahead, stay = live[goes], live[~goes]
            state[ahead], at[ahead] = self.goal[edge[goes]], at[ahead] + 1
            total[stay] += self.popped[state[stay]]
            lost = self.fail[state[stay]] < 0
            state[stay] = self.fail[state[stay]]
            total[stay[lost]], at[stay[lost]] = -1, size[stay[lost]]
            live = live[at[live] < size[live]]
        spelled = (total >= 0) & (size > 0)
        left = self.rest[np.maximum(state, 0)]
        out = np.where(spelled & (left >= 0), total + left, 1)
        return np.where(size > 0, out, 0)


class WordCounts:
    def __init__(self, pieces: list[bytes]):
        import numpy as np

        self.match = LongestMatch(pieces)
        self.words = WordCache(self._count, np.uint32)

    def _count(self, words: pa.Array):
        import numpy as np
        import pyarrow.compute as pc

        led = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar(" ", pa.large_string()))
        data = np.frombuffer(b"".join(led.cast(pa.large_binary()).to_pylist()), np.uint8)
        size = np.asarray(pc.binary_length(led), dtype=np.int64)
        found = self.match.counts(data, np.cumsum(size) - size, size)
        return np.ones(len(words), np.int64), found

    def per_text(self, text: pa.Array):
        """(words, pieces) of each text."""
        import numpy as np

        flat, offsets = split_words(text)
        n = np.diff(offsets)
        if not len(flat):
            return n, np.zeros(len(n), np.int64)
        coded = flat.dictionary_encode()
        values, start, _ = self.words.runs(coded.dictionary)
        each = values[start][coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(each)))
        return n, upto[offsets[1:]] - upto[offsets[:-1]]


def counter(path: str) -> WordCounts:
    """One counter for each worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounts(read_ranks(path))
    return _COUNTERS[path]


def piece_counts(path: str):
    """A column function: text to struct(n_words, n_pieces)."""

    @F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_pieces", T.LongType())]))
    def count(text: pa.Array) -> pa.Array:
        import numpy as np

        one = pa.RecordBatch.from_arrays([text], names=["text"])
        parts = [counter(path).per_text(b.column("text")) for b in slices(one, "text")]
        n, pieces = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in (0, 1))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(pieces, pa.int64())], ["n_words", "n_pieces"])

    return count


def token_counts(docs: DataFrame, path: str, text: Column | None = None) -> DataFrame:
    """doc_id, n_words and n_pieces for every row of ``docs``."""
    found = piece_counts(path)((F.col("text") if text is None else text).cast("string"))
    return docs.select("doc_id", found.alias("c")).select("doc_id", "c.n_words", "c.n_pieces")
