"""Word vectors trained on the texts: co-occurrence counts, positive pointwise mutual information, and its leading eigenvectors.

Texts are dealt into chunks. A chunk's distinct words are joined to the numbered vocabulary, and the chunk's pairs of
numbers, a shift for each distance in the window, are summed before they are shuffled; so the work is the number of words times the
window, and neither a pair of rare words nor a spelling leaves its chunk. Pairs are kept in blocks, a row each: the numbers of
words are cut into ranges, and a block holds the pairs of two ranges, each pair once. What a pair needs of its words (sums, names,
vectors) meets it as the rows of its two ranges.

The eigenvectors come from subspace iteration: each block is multiplied with the vectors of its two ranges, and sums run over
the blocks of a range; between the steps the vectors are made orthonormal by a ``dimension`` by ``dimension`` matrix, the only thing
that reaches the driver. Starting vectors are hashes of the words, so a run repeats but for the last digits of sums.

Words that come later are folded in through their neighbours, and words without any known neighbour through the
parts of their spelling, without training again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import trigrams
from ..plans.staging import bounded, settled, shuffled

CHUNK = 1 << 20  # words of a chunk of texts
BLOCK = 1 << 21  # pairs of a block, about and before those of several chunks are summed
SENT = 1 << 18  # words whose rows may be sent to all tasks
INT, LONG, DOUBLE = "<i4", "<i8", "<f8"
PAIRS, VALUES = "a int, b int, at binary, to binary, n binary", "a int, b int, at binary, to binary, value binary"


@dataclass(frozen=True)
class Blocks:
    """``pairs`` (a, b, at, to, n), a row for two ranges of numbers, each pair once; ``ids`` (word, id); numbers in a range, and of words."""

    pairs: DataFrame
    ids: DataFrame
    width: int
    words: int

    @property
    def tasks(self) -> int:
        """A task for each block: stated, so that Spark does not merge them; a file then holds few blocks, as Spark reads many rows of a file at a time."""
        ranges = -(-self.words // self.width)
        return 1 + ranges * (ranges + 1) // 2

    def met(self, rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """The pairs with the ``rows`` (range, ...) of their two ranges, whose columns end in _a and _b."""
        pairs = self.pairs if pairs is None else pairs
        one, two = (rows.select(F.col("range").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in rows.columns if c != "range"]) for end in "ab")
        if self.words <= SENT:
            return pairs.join(F.broadcast(one), "a").join(F.broadcast(two), "b")
        # the rows of ranges go to the blocks, so that these are shuffled once
        both = pairs.select("a", "b").join(shuffled(one), "a").join(shuffled(two), "b")
        return pairs.repartition(self.tasks, "a", "b").join(shuffled(both.repartition(self.tasks, "a", "b")), ["a", "b"])

    def ranged(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` (id, columns) as one row for each range: a list for each column, in the order of the numbers, with nulls where one is missing."""
        width, kinds = self.width, dict(rows.dtypes)

        def run(own: pa.Table) -> pa.Table:
            import numpy as np

            ids = own.column("id").to_numpy()
            spot = np.full(width, -1)
            spot[ids % width] = np.arange(len(ids))
            take = pa.array(spot, mask=spot < 0)
            lists = [pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), own.column(c).combine_chunks().take(take)) for c in columns]
            return pa.Table.from_arrays([pa.array([ids[0] // width], pa.int32()), *lists], names=["range", *columns])

        rows = rows.select("id", *columns, F.floor(F.col("id") / width).cast("int").alias("range"))
        return rows.groupBy("range").applyInArrow(run, ", ".join(["range int", *[f"{c} array<{kinds[c]}>" for c in columns]]))


def _packed(numbers, kind: str) -> pa.Array:
    """One cell of many numbers, as their bytes: lists of millions of numbers take several times their size when Spark reads them."""
    import numpy as np

    return pa.array([np.ascontiguousarray(numbers, kind).tobytes()], pa.binary())


def _numbers(rows: pa.Table | pa.RecordBatch, column: str, kind: str):
    """The numbers of the cells of ``column``, one cell after the other."""
    import numpy as np

    return np.concatenate([np.empty(0, kind), *[np.frombuffer(cell.as_buffer(), kind) for cell in rows.column(column)]])


def _numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """(word, id) of the distinct ``words`` (word), numbered from 0 without gaps, and how many there are; the driver gets a number for each partition."""
    rows = settled(words.select("word", F.monotonically_increasing_id().alias("spot")))
    before, upto = {}, 0
    for part, n in sorted(tuple(r) for r in rows.groupBy(F.shiftright("spot", 33).alias("part")).count().collect()):
        before[part], upto = upto, upto + n
    starts = F.lit([before.get(k, 0) for k in range(max(before, default=0) + 1)]).cast("array<long>")
    return settled(rows.select("word", (F.get(starts, F.shiftright("spot", 33).cast("int")) + F.col("spot").bitwiseAND((1 << 33) - 1)).alias("id"))), upto


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of texts, a row each: the distinct words, how often each occurs, the texts as places of their words, and the texts' sizes."""
    import numpy as np
    from pyspark import TaskContext

    nth = TaskContext.get().partitionId() << 32
    for batch in batches:
        lists = batch.column("w")
        sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, int)
        run = (np.cumsum(sizes) - sizes) // CHUNK
        cuts = np.flatnonzero(np.diff(run)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(sizes)]):
            coded = lists.slice(int(i), int(j - i)).flatten().dictionary_encode()
            if len(coded):
                codes = coded.indices.to_numpy()
                row = [pa.array([nth]), *[pa.ListArray.from_arrays([0, len(x)], x) for x in (coded.dictionary.cast(pa.string()), pa.array(np.bincount(codes)))]]
                yield pa.RecordBatch.from_arrays([*row, _packed(codes, INT), _packed(sizes[i:j], INT)], names=["chunk", "words", "times", "codes", "sizes"])
                nth += 1


def _block(a: int, b: int, at, to, **values) -> pa.RecordBatch:
    """A block as a row; ``values`` are n or value."""
    cells = [_packed(at, INT), _packed(to, INT), *[_packed(x, {"n": LONG, "value": DOUBLE}[c]) for c, x in values.items()]]
    return pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), *cells], names=["a", "b", "at", "to", *values])


NONE = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("at", pa.binary()), ("to", pa.binary()), ("n", pa.binary())]).empty_table()


def _near(shares: list[int], words: int, width: int):
    """A chunk's pairs by blocks: the sums of the shares of the distances at which words of a text stand."""

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        import numpy as np

        if not own.num_rows or not known.num_rows:
            return NONE
        number = np.full(own.column("n_words")[0].as_py(), -1, np.int64)
        number[known.column("place").to_numpy()] = known.column("id").to_numpy()
        sizes = _numbers(own, "sizes", INT)
        at, text = number[_numbers(own, "codes", INT)], np.repeat(np.arange(len(sizes)), sizes)
        keys = []
        for k in range(1, len(shares) + 1):
            one, two = at[:-k], at[k:]
            fits = (text[k:] == text[:-k]) & (one >= 0) & (two >= 0)
            one, two = one[fits], two[fits]
            keys.append((np.minimum(one, two) * words + np.maximum(one, two)) * len(shares) + k - 1)
        keys = np.sort(np.concatenate(keys))
        if not len(keys):
            return NONE
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        share = np.diff(np.append(first, len(keys))) * np.array(shares)[keys[first] % len(shares)]
        keys = keys[first] // len(shares)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n, one, two = np.add.reduceat(share, first), keys[first] // words, keys[first] % words
        ranges = -(-words // width)
        block = (one // width) * ranges + two // width
        order = np.argsort(block, kind="stable")
        block, one, two, n = block[order], (one[order] % width).astype(np.int32), (two[order] % width).astype(np.int32), n[order]
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
        return pa.Table.from_batches([_block(block[i] // ranges, block[i] % ranges, one[i:j], two[i:j], n=n[i:j]) for i, j in zip(cuts, cuts[1:])])

    return run


def _summed(width: int):
    """The blocks of all chunks as one: places in order, each pair once."""

    def run(found: pa.Table) -> pa.Table:
        import numpy as np

        one, two, n = (_numbers(found, c, kind) for c, kind in (("at", INT), ("to", INT), ("n", LONG)))
        keys = one.astype(np.int64) * width + two
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys = keys[first]
        return pa.Table.from_batches([_block(found.column("a")[0].as_py(), found.column("b")[0].as_py(), keys // width, keys % width, n=np.add.reduceat(n[order], first))])

    return run


def _unit(window: int) -> int:
    return math.lcm(*range(1, window + 1))


def counted(docs: DataFrame, window: int = 4, least: int = 5, block: int = BLOCK) -> Blocks:
    """The pairs of ``cooccurrences`` in blocks, counts in whole numbers of 1 / ``_unit(window)``."""
    words = docs.select(F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 3).alias("w"))
    chunks = settled(words.mapInArrow(_coded, "chunk long, words array<string>, times array<long>, codes binary, sizes binary"))
    seen = chunks.select(F.explode(F.arrays_zip("words", "times")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.times").alias("times"))
    ids, n = _numbered(seen.where(F.col("times") >= least))
    size = chunks.agg(F.sum(F.octet_length("codes") / 4)).first()[0] or 0
    width = max(1, -(-n // max(1, math.ceil(math.sqrt(2 * window * size / block)))))  # of ranges r, there are about r * r / 2 blocks
    places = chunks.select("chunk", F.posexplode("words").alias("place", "word")).join(shuffled(ids), "word").select("chunk", "place", "id")
    rows = chunks.select(F.col("chunk").alias("own"), F.size("words").alias("n_words"), "codes", "sizes").groupBy("own").cogroup(places.groupBy("chunk"))
    found = Blocks(rows.applyInArrow(_near([_unit(window) // k for k in range(1, window + 1)], n, width), PAIRS), ids, width, n)
    summed = found.pairs.repartition(found.tasks, "a", "b").groupBy("a", "b").applyInArrow(_summed(width), PAIRS)
    return replace(found, pairs=settled(summed))


def _named(counts: Blocks, rows: DataFrame, of, column: str) -> DataFrame:
    """(word, other, ``column``) in both orders: what ``of`` makes of each block of ``rows``, with the names of its two ranges; NaN leaves a pair out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.slice(r, 1)
                one, two = (_numbers(block, c, INT) for c in ("at", "to"))
                value = of(block, one, two)
                names = [block.column(f"words_{end}").flatten() for end in "ab"]
                twins = (block.column("a")[0].as_py() == block.column("b")[0].as_py()) & (one == two)
                for i in range(0, len(value), 1 << 16):
                    some = np.flatnonzero(~np.isnan(value[i : i + (1 << 16)])) + i
                    a, b, v = names[0].take(pa.array(one[some])), names[1].take(pa.array(two[some])), pa.array(value[some])
                    yield pa.RecordBatch.from_arrays([a, b, v], names=["word", "other", column])
                    both = pa.array(~twins[some])  # a word beside itself is one row
                    yield pa.RecordBatch.from_arrays([b.filter(both), a.filter(both), v.filter(both)], names=["word", "other", column])

    return rows.mapInArrow(run, f"word string, other string, {column} double")


def cooccurrences(docs: DataFrame, window: int = 4, least: int = 5, block: int = BLOCK) -> DataFrame:
    """(word, other, n): how often words of the texts (doc_id, text) stand within ``window`` words of each other, nearer ones counting more.

    Words have three letters and more, and occur ``least`` times; others keep their place but count nowhere. Both orders
    of a pair are rows. A distance k counts 1/k. A null text has no words.
    """
    counts, unit = counted(docs, window, least, block), _unit(window)
    names = settled(counts.ranged(counts.ids.withColumnRenamed("word", "words"), "words"))
    return _named(counts, counts.met(names), lambda row, one, two: _share(row, unit), "n")


def _share(row: pa.RecordBatch, unit: int):
    import numpy as np

    return np.round(_numbers(row, "n", LONG) / unit, 6)


def _informed(counts: Blocks, unit: int, smooth: float) -> tuple[DataFrame, object]:
    """The sums (range, words, own) of all words in a row for each range, and what gives a block's values from them, NaN where they are not positive."""

    width = counts.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                one, two, n, (a, b) = _numbers(row, "at", INT), _numbers(row, "to", INT), _share(row, unit), (row.column(c)[0].as_py() for c in "ab")
                twins = (one == two) if a == b else np.zeros(len(one), bool)
                for at, of, weight in ((one, a, n), (two, b, np.where(twins, 0.0, n))):
                    own = np.bincount(at, weight)
                    some = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays([pa.array(some + of * width, pa.int64()), pa.array(own[some])], names=["id", "own"])

    sums = settled(counts.pairs.mapInArrow(run, "id long, own double").groupBy("id").agg(F.sum("own").alias("own")))
    context = sums.agg(F.sum(F.pow("own", F.lit(smooth)))).first()[0] or 0.0
    rows = settled(counts.ranged(counts.ids.join(shuffled(sums), "id", "left").withColumnRenamed("word", "words"), "words", "own"))

    def of(row: pa.RecordBatch, one, two):
        import numpy as np

        n, x, y = _share(row, unit), *[row.column(f"own_{end}").flatten().to_numpy(zero_copy_only=False)[at] for end, at in (("a", one), ("b", two))]
        info = lambda a, b: np.maximum(np.log(n / a / (b**smooth / context)), 0.0)
        value = (info(x, y) + info(y, x)) / 2
        return np.where(value > 0, value, np.nan)

    return rows, of


def information(docs: DataFrame, window: int = 4, least: int = 5, smooth: float = 0.75, block: int = BLOCK) -> DataFrame:
    """(word, other, value): ``ppmi`` of the ``cooccurrences`` of the texts (doc_id, text), block by block."""
    counts = counted(docs, window, least, block)
    rows, of = _informed(counts, _unit(window), smooth)
    return _named(counts, counts.met(rows), of, "value")


def ppmi(pairs: DataFrame, smooth: float = 0.75) -> DataFrame:
    """(word, other, value): log(p(word, other) / (p(word) p(other))) of ``pairs`` where it is positive.

    Contexts count to the power ``smooth``, which keeps rare ones from the highest values; value and other way round are
    averaged, so the matrix is symmetric.
    """
    sums = settled(pairs.groupBy("word").agg(F.sum("n").alias("own")))
    total = sums.agg(F.sum("own").alias("total"), F.sum(F.pow("own", F.lit(smooth))).alias("context"))
    one, two = sums.select("word", F.col("own").alias("x")), sums.select(F.col("word").alias("other"), F.col("own").alias("y"))
    rows = pairs.join(bounded(one), "word").join(bounded(two), "other").join(F.broadcast(total))  # one row
    info = lambda a, b: F.log(F.col("n") / a / (F.pow(b, F.lit(smooth)) / F.col("context")))
    value = (F.greatest(info(F.col("x"), F.col("y")), F.lit(0.0)) + F.greatest(info(F.col("y"), F.col("x")), F.lit(0.0))) / 2
    return rows.select("word", "other", value.alias("value")).where("value > 0")


def _each(dimension: int, of) -> Column:
    return F.array(*[of(k) for k in range(dimension)])


def _matrix(row: pa.RecordBatch, column: str, dimension: int):
    """The vectors of a range as a matrix."""
    return _numbers(row, column, DOUBLE).reshape(-1, dimension)


def _vectors(number: int, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), _packed(rows, DOUBLE)], names=["range", "x"])


def times(matrix: Blocks, vectors: DataFrame, dimension: int) -> DataFrame:
    """(range, x): ``matrix`` times the ``vectors`` (range, x), those of a range one after the other."""
    width = matrix.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                at, to, value = (_numbers(row, c, kind) for c, kind in (("at", INT), ("to", INT), ("value", DOUBLE)))
                a, b = (row.column(c)[0].as_py() for c in "ab")
                for one, two, of, end in ((at, to, a, "x_b"), (to, at, b, "x_a")):
                    own = np.where(one == two, 0.0, value) if a == b and end == "x_a" else value  # a word beside itself counts once
                    by = np.ascontiguousarray(_matrix(row, end, dimension).T)
                    out = np.stack([np.bincount(one, own * x[two], width) for x in by], axis=1)
                    yield _vectors(of, out)

    def add(own: pa.Table) -> pa.Table:
        total = sum(_matrix(part, "x", dimension) for batch in own.to_batches() for part in (batch.slice(r, 1) for r in range(batch.num_rows)))
        return pa.Table.from_batches([_vectors(own.column("range")[0].as_py(), total)])

    return matrix.met(vectors).mapInArrow(run, "range int, x binary").groupBy("range").applyInArrow(add, "range int, x binary")


def _turned(vectors: DataFrame, by, dimension: int) -> DataFrame:
    """Each vector times the small matrix ``by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                yield _vectors(row.column("range")[0].as_py(), _matrix(row, "x", dimension) @ by)

    return vectors.select("range", "x").mapInArrow(run, "range int, x binary")


def _summed_up(rows: DataFrame, of, size: int):
    """The sums of the ``size`` numbers that ``of`` gives for each row of ``rows``; each task adds up its own, a number for each cell reaches the driver."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for r in range(batch.num_rows):
                total += of(batch.slice(r, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["cell", "value"])

    out = np.zeros(size)
    for cell, value in rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[cell] = value
    return out


def _products(left: DataFrame, right: DataFrame | None, dimension: int):
    """The ``dimension`` by ``dimension`` matrix of all products of coordinates, summed over the words of both tables (of one with itself)."""
    rows = left.select("range", "x")
    rows = rows.withColumn("y", F.col("x")) if right is None else rows.join(shuffled(right.select("range", F.col("x").alias("y"))), "range")
    return _summed_up(rows.select("x", "y"), lambda r: (_matrix(r, "x", dimension).T @ _matrix(r, "y", dimension)).ravel(), dimension * dimension).reshape(dimension, dimension)


def trained(matrix: DataFrame, dimension: int = 16, rounds: int = 6, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """(word, vector): ``dimension`` coordinates for each word of the symmetric ``matrix`` (word, other, value).

    Coordinates are leading eigenvectors times the root of their eigenvalue, the greatest first, each with its greatest sum
    of cubes positive. Fewer words than coordinates leave the rest at zero. An empty matrix gives no vectors.
    """
    rows = settled(matrix.repartition("word"))  # laid out by its rows
    ids, n = _numbered(rows.select("word").distinct())
    width = max(1, -(-n // max(1, math.ceil(math.sqrt(rows.count() / block)))))

    def run(own: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_block(*[own.column(c)[0].as_py() for c in "ab"], own.column("at").to_numpy(), own.column("to").to_numpy(), value=own.column("value").to_numpy())])

    pairs = rows.join(shuffled(ids), "word").join(shuffled(ids.select(F.col("word").alias("other"), F.col("id").alias("to"))), "other").where("id <= to")
    at = lambda c: (F.floor(F.col(c) / width).cast("int"), (F.col(c) % width).cast("int"))
    (a, one), (b, two) = at("id"), at("to")
    pairs = pairs.select(a.alias("a"), b.alias("b"), one.alias("at"), two.alias("to"), F.col("value").cast("double").alias("value"))
    found = Blocks(pairs, ids, width, n)
    pairs = settled(pairs.repartition(found.tasks, "a", "b").groupBy("a", "b").applyInArrow(run, VALUES))
    return _leading(replace(found, pairs=pairs), dimension, rounds, seed)


def trained_on(docs: DataFrame, dimension: int = 16, rounds: int = 6, seed: int = 1, window: int = 4, least: int = 5, smooth: float = 0.75, block: int = BLOCK) -> DataFrame:
    """``trained`` by the ``information`` of the texts (doc_id, text); values stay in their blocks, words without any get no vector."""
    counts = counted(docs, window, least, block)
    sums, of = _informed(counts, _unit(window), smooth)
    width = counts.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                one, two = (_numbers(row, c, INT) for c in ("at", "to"))
                value = of(row, one, two)
                some = ~np.isnan(value)
                yield _block(*[row.column(c)[0].as_py() for c in "ab"], one[some], two[some], value=value[some])

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in range(batch.num_rows):
                for c, end in (("at", "a"), ("to", "b")):
                    own = np.unique(_numbers(batch.slice(r, 1), c, INT))
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64) + batch.column(end)[r].as_py() * width)], names=["id"])

    values = settled(counts.met(sums).mapInArrow(run, VALUES))
    ids = settled(counts.ids.join(shuffled(values.mapInArrow(used, "id long").distinct()), "id", "left_semi"))
    return _leading(Blocks(values, ids, width, counts.words), dimension, rounds, seed)


def _leading(matrix: Blocks, dimension: int, rounds: int, seed: int) -> DataFrame:
    """(word, vector) of ``trained``."""
    import numpy as np

    start = _each(dimension, lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("word")), F.lit(1 << 30)) / float(1 << 29) - 1)
    ranges = settled(matrix.ranged(matrix.ids.select("id", F.col("word").alias("words"), start.alias("x")), "words", "x"))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.slice(r, 1).column("x").flatten()
                rows = np.zeros((len(own), dimension))
                rows[own.is_valid().to_numpy(zero_copy_only=False)] = own.flatten().to_numpy().reshape(-1, dimension)
                yield _vectors(batch.column("range")[r].as_py(), rows)

    vectors = settled(ranges.select("range", "x").mapInArrow(flat, "range int, x binary"))
    if not vectors.limit(1).count():
        return matrix.ids.select("word", F.array().cast("array<double>").alias("vector"))

    def orthonormal(rows: DataFrame) -> DataFrame:
        values, turn = np.linalg.eigh(_products(rows, None, dimension))
        sound = values > 1e-12 * max(values.max(), 1e-300)
        return settled(_turned(rows, turn * np.where(sound, 1 / np.sqrt(np.where(sound, values, 1)), 0.0), dimension))

    vectors = orthonormal(vectors)
    for _ in range(rounds):
        vectors = orthonormal(settled(times(matrix, vectors, dimension)))
    small = _products(vectors, times(matrix, vectors, dimension), dimension)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)
    out = settled(_turned(vectors, turn[:, order] * np.sqrt(np.maximum(values[order], 0.0)), dimension))
    cubes = _summed_up(out.select("x"), lambda r: (_matrix(r, "x", dimension) ** 3).sum(axis=0), dimension)
    signs = np.where(cubes < 0, -1.0, 1.0)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                words, rows = row.column("words").flatten(), _matrix(row, "x", dimension) * signs
                known = words.is_valid()
                rows = rows[known.to_numpy(zero_copy_only=False)]
                for i, some in ((i, words.filter(known).slice(i, 1 << 14)) for i in range(0, len(rows), 1 << 14)):
                    part = rows[i : i + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([some, pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dimension, pa.int32()), pa.array(part.ravel()))], names=["word", "vector"])

    rows = out.join(shuffled(ranges.select("range", "words")), "range").select("words", "x").mapInArrow(named, "word string, vector array<double>")
    return rows.select("word", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def spelled(words: DataFrame, vectors: DataFrame, dimension: int = 16) -> DataFrame:
    """(word, vector) of ``words`` (word) by their trigrams: a trigram's vector is the mean of those of the words that hold it."""
    gram = lambda df: df.select("*", F.explode(trigrams(F.col("word"))).alias("gram"))
    mean = lambda column: _each(dimension, lambda k: F.round(F.avg(F.get(column, F.lit(k))), 6))
    grams = gram(vectors).groupBy("gram").agg(mean("vector").alias("g"))
    return gram(words.select("word").distinct()).join(grams, "gram").groupBy("word").agg(mean("g").alias("vector"))


def filled(words: DataFrame, vectors: DataFrame, pairs: DataFrame, dimension: int = 16) -> DataFrame:
    """(word, vector, source) of the ``words`` (word) that ``vectors`` lacks, and of no others: by their neighbours in ``pairs`` (word, other, n), else by their spelling.

    A neighbour's share is its count; words whose neighbours and trigrams are all unknown get no row.
    """
    missing = settled(words.select("word").where("word is not null").distinct().join(vectors.select("word"), "word", "left_anti"))
    near = pairs.join(missing, "word", "left_semi").join(vectors.select(F.col("word").alias("other"), "vector"), "other")
    total = F.sum("n")
    folded = settled(near.groupBy("word").agg(_each(dimension, lambda k: F.round(F.sum(F.col("n") * F.get("vector", F.lit(k))) / total, 6)).alias("vector")))
    rest = spelled(missing.join(folded, "word", "left_anti"), vectors, dimension)
    return folded.withColumn("source", F.lit("neighbours")).unionByName(rest.withColumn("source", F.lit("spelling")))


def nearest_words(vectors: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """(query, word, distance, nth): the ``k`` words nearest in angle to each word of ``asked`` (word), a stated set, compared in blocks."""
    from .vectors import compared

    named = settled(vectors.select(F.xxhash64("word").alias("id"), F.lit(0).alias("label"), "word", "vector"))
    queries = named.join(asked.select("word").distinct(), "word", "left_semi")
    found = compared(named.drop("word"), queries.drop("word"), k)
    names = named.select("id", "word")
    out = found.join(names, "id").join(names.select(F.col("id").alias("query_id"), F.col("word").alias("query")), "query_id")
    nth = F.row_number().over(Window.partitionBy("query").orderBy("distance", "word"))
    return out.select("query", "word", "distance", nth.alias("nth"))
