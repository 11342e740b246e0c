"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi.

Encoding takes the segmentation of the whole text with the greatest sum of the model file's piece scores.
The automaton reads the bytes once; at each position its output links give every piece that ends there,
longest first, and each relaxes the best score; a later piece must be strictly better. Characters that
are no piece become their byte pieces, scored ten below the lowest score. User-defined pieces (runs of
spaces here) are scored as the library's unigram encoder scores them, above all others. The scores are
those of a merge-ranked model, the only one at hand: the library's own merges may cut a word otherwise,
but pieces, ids, byte fallback, the leading space mark and decoding are the same, and decoding gives back
the text exactly (but for a literal space mark, which is read as a space).

No piece holds a space mark after another character, so texts are cut before each run of spaces, and
each distinct segment is worked out once; the distinct segments of a batch are read side by side, those
over ``LONG`` bytes one after the other in a plain loop, whose time is linear in their length.

Defined cases: a null text is encoded as null, an empty text as no ids; NUL and control characters go
through byte pieces; invalid ids decode to nothing; texts and segments of any length are read whole;
an empty table gives an empty result; other columns are carried along by ``encoded`` and ``decoded``, and
one that has the new column's name keeps it: the new one is then named with _2, _3 and so on.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import slices
from .wordcache import WordCache, gather

MARK = "▁"
LONG = 512
RUN = 1 << 18
_MODELS: dict = {}


class Viterbi:
    """The automaton of a list of (piece bytes, score, id), with a byte piece for each byte."""

    def __init__(self, pieces: list[tuple[bytes, float, int]], byte_ids: list[int], unknown: float):
        import numpy as np

        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, (p, _, _) in enumerate(pieces):
            at = 0
            for b in p:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = children[at][b] = len(children)
                    children.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = k
        n = len(children)
        fail, out = [0] * n, [-1] * n  # out: the nearest suffix, itself included, that is a piece
        queue = list(children[0].values())
        for at in queue:
            out[at] = at if ends[at] >= 0 else out[fail[at]]
            for b, child in children[at].items():
                back = fail[at]
                while back and b not in children[back]:
                    back = fail[back]
                fail[child] = children[back].get(b, 0)
                queue.append(child)
        keys = np.array([at << 8 | b for at, c in enumerate(children) for b in c], np.int64)
        goal = np.array([x for c in children for x in c.values()], np.int64)
        by = np.argsort(keys)
        self.keys, self.goal = keys[by], goal[by]
        self.fail, self.out = np.array(fail), np.array(out)
        self.ends = np.array(ends)
        self.length = np.array([len(p) for p, _, _ in pieces], np.int64)
        self.score = np.array([s for _, s, _ in pieces])
        self.id = np.array([i for _, _, i in pieces], np.int64)
        self.bytes, self.unknown = np.array(byte_ids, np.int64), unknown
        chars = [p for p, _, _ in pieces if len(p.decode("utf-8", "replace")) == 1]
        self.chars, self.plain = set(chars), None  # plain: the automaton in dictionaries and lists, made for the first long run
        self.single = {len_: np.array(sorted(int.from_bytes(p, "big") for p in chars if len(p) == len_), np.int64) for len_ in (1, 2, 3, 4)}

    def _goto(self, state, byte):
        import numpy as np

        todo, new = np.arange(len(state)), np.zeros(len(state), np.int64)
        at = state.copy()
        while len(todo):
            key = at[todo] << 8 | byte[todo]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            new[todo[hit]] = self.goal[edge[hit]]
            todo = todo[~hit]
            todo = todo[at[todo] > 0]
            at[todo] = self.fail[at[todo]]
        return new

    def encode(self, data, start, size):
        """(counts, ids) of the byte runs, each worked out on its own; runs of like length share a grid."""
        import numpy as np

        order, n = np.argsort(size, kind="stable"), int((size <= LONG).sum())
        counts, a = np.zeros(len(start), np.int64), 0
        pieces: list = []
        for i in order[n:]:
            ids = np.array(self.walked(data[start[i] : start[i] + size[i]].tobytes()), np.int64)
            counts[i] = len(ids)
            pieces.append((np.array([i]), counts[i : i + 1].copy(), ids))
        while a < n:
            many = max(1, (1 << 21) // (2 * int(size[order[a]]) + 2))  # cells of a grid if lengths no more than double
            b = min(n, a + many, a + int(np.searchsorted(size[order[a:]], 2 * size[order[a]] + 1, side="right")))
            rows = order[a:b]
            c, ids = self._grid(data, start[rows], size[rows])
            counts[rows] = c
            pieces.append((rows, c, ids))
            a = b
        at = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        for rows, c, ids in pieces:
            flat[gather(np.arange(len(flat)), at[rows], c)] = ids
        return counts, flat

    def walked(self, data: bytes) -> list[int]:
        """ids of one run, byte by byte."""
        from array import array

        if self.plain is None:
            self.plain = (dict(zip(self.keys.tolist(), self.goal.tolist())), *[x.tolist() for x in (self.fail, self.out, self.ends, self.length, self.score)])
        go, fail, out, ends, length, score = self.plain
        n, state, since = len(data), 0, 0
        best, took = array("d", [0.0]) * (n + 1), array("l", [-1]) * (n + 1)
        for i, b in enumerate(data):
            if b & 0xC0 != 0x80:
                since = i
            to = go.get(state << 8 | b)
            while to is None and state:
                state = fail[state]
                to = go.get(state << 8 | b)
            state = to or 0
            top, piece, node = float("-inf"), -1, out[state]
            while node >= 0:
                k = ends[node]
                value = best[i + 1 - length[k]] + score[k]
                if value > top:
                    top, piece = value, k
                node = out[fail[node]]
            if (i + 1 == n or data[i + 1] & 0xC0 != 0x80) and data[since : i + 1] not in self.chars and best[since] + self.unknown > top:
                top, piece = best[since] + self.unknown, -2 - (i + 1 - since)
            best[i + 1], took[i + 1] = top, piece
        found: list[int] = []
        while n:
            k = took[n]
            if k >= 0:
                found.append(int(self.id[k]))
                n -= length[k]
            else:
                found += [int(self.bytes[x]) for x in reversed(data[n + 2 + k : n])]
                n += 2 + k
        return found[::-1]

    def _grid(self, data, start, size):
        import numpy as np

        n, width = len(start), int(size.max(initial=0))
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        took = np.full((width + 1, n), -1, np.int32)  # the piece that ends here; -2 - k: an unknown character of k bytes
        state = np.zeros(n, np.int64)
        since = np.zeros(n, np.int64)  # where the character being read began
        for i in range(width):
            live = np.flatnonzero(size > i)
            byte = data[start[live] + i].astype(np.int64)
            since[live[byte & 0xC0 != 0x80]] = i
            state[live] = self._goto(state[live], byte)
            rows, node = live, self.out[state[live]]
            while True:
                on = node >= 0
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                piece = self.ends[node]
                value = best[i + 1 - self.length[piece], rows] + self.score[piece]
                better = value > best[i + 1, rows]
                best[i + 1, rows[better]], took[i + 1, rows[better]] = value[better], piece[better]
                node = self.out[self.fail[node]]
            # a character that ends here and is no piece: its bytes
            done = live[(size[live] == i + 1) | ((data[np.minimum(start[live] + i + 1, len(data) - 1)] & 0xC0) != 0x80)]
            if len(done):
                length = i + 1 - since[done]
                code = np.zeros(len(done), np.int64)
                for k in range(int(length.max())):
                    inside = length > k
                    code[inside] = code[inside] << 8 | data[start[done[inside]] + since[done[inside]] + k]
                known = np.zeros(len(done), bool)
                for k, table in self.single.items():
                    at = np.minimum(np.searchsorted(table, code), max(len(table) - 1, 0))
                    known |= (length == k) & ((table[at] == code) if len(table) else False)
                odd, length = done[~known], length[~known]
                value = best[i + 1 - length, odd] + self.unknown
                better = value > best[i + 1, odd]
                best[i + 1, odd[better]], took[i + 1, odd[better]] = value[better], (-2 - length[better]).astype(np.int32)
        # walk back from the ends
        where, parts = size.astype(np.int64).copy(), []
        live = np.flatnonzero(where > 0)
        while len(live):
            piece = took[where[live], live].astype(np.int64)
            known = piece >= 0
            parts.append((live[known], where[live[known]], self.id[piece[known]]))
            for k in range(1, int((-2 - piece[~known]).max(initial=0)) + 1):
                some = live[~known][-2 - piece[~known] >= k]
                parts.append((some, where[some] - k + 1, self.bytes[data[start[some] + where[some] - k]]))
            where[live] -= np.where(known, self.length[np.maximum(piece, 0)], -2 - piece)
            live = live[where[live] > 0]
        if not parts:
            return np.zeros(n, np.int64), np.empty(0, np.int64)
        row, end, ids = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(row * np.int64(width + 2) + end, kind="stable")
        return np.bincount(row, minlength=n), ids[by]


class Model:
    """Pieces of a SentencePiece model file; merging, training and normalising are not used."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids, plain, run = [0] * 256, [], []
        self.data: list[bytes] = [b""] * n
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.data[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                (run if p == MARK * len(p) and len(p) > 1 else plain).append((p.encode(), sp.get_score(i), i))
                self.data[i] = p.replace(MARK, " ").encode()
        # for decoding: every piece, one without bytes, and the same again less a leading space
        self.pieces = pa.array([*self.data, b"", *[p.removeprefix(b" ") for p in self.data], b""], pa.large_binary())
        self.held = np.array([*map(len, self.data), 0])
        top, low = max(s for _, s, _ in plain), min(s for _, s, _ in plain)
        run = [(p, len(p.decode()) * top - 0.1, i) for p, _, i in run]
        self.viterbi = Viterbi(plain + run, self.byte_ids, low - 10)
        self.segments = WordCache(self._encode, np.uint16 if n < 1 << 16 else np.uint32, most=400_000)

    def _encode(self, segments: pa.Array):
        import numpy as np
        import pyarrow.compute as pc

        marked = pc.replace_substring(segments, " ", MARK)
        data = np.frombuffer(b"".join(marked.cast(pa.large_binary()).to_pylist()), np.uint8)
        size = np.asarray(pc.binary_length(marked), dtype=np.int64)
        return self.viterbi.encode(data, np.cumsum(size) - size, size)

    def encode(self, text: pa.Array):
        """(ids, offsets) of all texts; nulls count as empty."""
        import numpy as np
        import pyarrow.compute as pc

        text = pc.replace_substring(pc.fill_null(text.cast(pa.large_string()), ""), MARK, " ")
        lists = pc.split_pattern(text, " ")
        words, at = lists.values, np.asarray(lists.offsets, dtype=np.int64)
        at = at - at[0]
        blank = np.asarray(pc.binary_length(words)) == 0
        empty = np.flatnonzero(np.asarray(pc.binary_length(text)) == 0)
        first, last = np.zeros(len(words), bool), np.zeros(len(words), bool)
        first[at[:-1]], last[at[1:] - 1] = True, True
        # a blank stands for one more space before the next word of its text, or for one that ends the text
        led = np.flatnonzero(blank & ~last)
        segments = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar(" ", pa.large_string()))
        drop = np.zeros(len(words), bool)
        if len(led):
            run = np.zeros(len(words), np.int64)
            for i in led:  # in order, so runs add up
                run[i + 1], drop[i] = run[i] + 1, True
            rows = np.flatnonzero((run > 0) & ~drop)
            longer = pa.array([" " * (run[i] + 1) + words[i].as_py() for i in rows], pa.large_string())
            segments = pc.replace_with_mask(segments, pa.array((run > 0) & ~drop), longer)
        drop[at[empty]] = True
        keep = ~drop
        kept = np.concatenate(([0], np.cumsum(keep)))[at]
        segments = segments.filter(pa.array(keep))
        if not len(segments):
            return np.empty(0, np.uint16), np.zeros(len(text) + 1, np.int64)
        coded = segments.dictionary_encode()
        values, start, size = self.segments.runs(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        upto = np.concatenate(([0], np.cumsum(size[codes].astype(np.int64))))
        return gather(values, start[codes], size[codes]), upto[kept]

    def decode(self, ids, offsets) -> pa.Array:
        """Texts of runs of ids: pieces and bytes joined, without the leading space that encoding adds."""
        import numpy as np

        n = len(self.data)
        rows = np.where((ids >= 0) & (ids < n), ids, n).astype(np.int32)  # row n has no bytes
        upto = np.concatenate(([0], np.cumsum(self.held[rows], dtype=np.int64)))
        full = offsets[:-1][upto[offsets[1:]] > upto[offsets[:-1]]]
        rows[np.searchsorted(upto, upto[full], side="right") - 1] += n + 1  # the first id with bytes, less a leading space
        joined = self.pieces.take(pa.array(rows))
        ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :][offsets]
        texts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends), joined.buffers()[2]])
        try:
            return texts.cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no characters
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.large_string())


def model(path: str) -> Model:
    """One model for each worker process and file."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encoder(path: str):
    """A column function: text to array of ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(text: pa.Array) -> pa.Array:
        import numpy as np

        one = pa.RecordBatch.from_arrays([text], names=["text"])
        done, upto, total = [np.empty(0, np.int32)], [np.zeros(1, np.int64)], 0
        for b in slices(one, "text", 1 << 20):
            ids, offsets = model(path).encode(b.column("text"))
            done.append(ids.astype(np.int32))
            upto.append(offsets[1:] + total)
            total += len(ids)
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate(upto).astype(np.int32)), pa.array(np.concatenate(done)))
        return pa.compute.if_else(text.is_valid(), flat, pa.scalar(None, flat.type)) if text.null_count else flat

    return encode


def decoder(path: str):
    """A column function: array of ids to text."""

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        import numpy as np

        flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False) if len(ids) else np.empty(0, np.int32)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        cuts = np.flatnonzero(np.diff(upto[:-1] // RUN)) + 1  # runs of texts with about RUN ids
        done = [pa.array([], pa.string())]
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            done.append(model(path).decode(flat[upto[a] : upto[b]], upto[a : b + 1] - upto[a]).cast(pa.string()))
        texts = pa.concat_arrays(done)
        return pa.compute.if_else(ids.is_valid(), texts, pa.scalar(None, texts.type)) if ids.null_count else texts

    return decode


def round_trip(path: str):
    """A column function: text to a struct of its ``ids`` and the ``text`` they decode to.

    Where a query keeps both, ``decoder`` over a column of ``encoder`` would encode twice: Spark hands a worker each column's
    functions as a chain from the text on.
    """
    encode, decode = encoder(path).func, decoder(path).func

    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())]))
    def both(text: pa.Array) -> pa.Array:
        ids = encode(text)
        return pa.StructArray.from_arrays([ids, decode(ids)], names=["ids", "text"])

    return both


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, or the first of name_2, name_3, ... that no column of ``rows`` has."""
    taken, k, out = {c.lower() for c in rows.columns}, 2, name
    while out.lower() in taken:
        out, k = f"{name}_{k}", k + 1
    return out


def encoded(docs: DataFrame, path: str, name: str = "ids") -> DataFrame:
    """``docs`` with the ids of the text as column ``name`` in place of the text."""
    return docs.withColumn(free_name(docs, name), encoder(path)(F.col("text").cast("string"))).drop("text")


def decoded(rows: DataFrame, path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """``rows`` with the texts of column ``ids`` as column ``name`` in place of the ids."""
    return rows.withColumn(free_name(rows, name), decoder(path)(F.col(ids))).drop(ids)
