"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Vectors are dealt into blocks by a hash. A block is indexed by ``projections`` random lines: for each
line the block's projections in sorted order, with the row of each. A query looks at a window centred on
its own projection on every line. Virtual rehashing widens all windows by ``grow`` at a time, and only
the part of a window that is new is counted. A vector that lies in the windows of at least ``share`` of
the lines is verified: its distance is computed in double precision on the original vectors. A block is
done with a query when k verified vectors lie within the distance that the windows cover by then
(``reach`` window halves), or when its windows cover the block.

The windows' first width is the ``start`` quantile of distances between projections of the block, so no
scale is assumed: windows start narrow and stop growing where the neighbours are. On vectors of no
structure, the worst case, counting and verifying take about four fifths of the operations of a
scan, and find 19 of 20 neighbours. Each block returns its best k + 1; a row_number window keeps the best of
all blocks.

The queries go to the blocks in groups of about ``group_bytes``, each a broadcast of bounded size; every
group reads the index once, and every candidate row is in exactly one block.

Defined cases: vectors that are null, empty, all zero, of another length than the commonest, or hold null or
non-finite components take no part (neither as queries nor as candidates); a query's own row is no
candidate, but other rows that repeat its vec_id or vector are; query rows that repeat a vec_id each
return their list; with fewer than k candidates all are returned; ties go to the smaller vec_id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import staged

INDEX_DDL = "vec_ids binary, vectors binary, lines binary, rows binary"
INDEX = pa.schema([(n, pa.binary()) for n in ("vec_ids", "vectors", "lines", "rows")])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where((F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))


def indexed(vectors: DataFrame, dimension: int, projections: int, block: int, seed: int) -> DataFrame:
    """A row for each block of at most ``block`` vectors of a task: ids, vectors, sorted projections and their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lines = np.random.default_rng(seed).normal(size=(dimension, projections))
        ids, parts, n = [], [], 0

        def packed() -> pa.RecordBatch:
            x, names = np.concatenate(parts), np.concatenate(ids)
            p = x @ lines
            rows = np.argsort(p, axis=0, kind="stable")
            data = (names, x, np.take_along_axis(p, rows, axis=0).T.copy(), rows.T.astype(np.int32).copy())
            return pa.RecordBatch.from_arrays([pa.array([d.tobytes()], pa.binary()) for d in data], schema=INDEX)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, block - n)
                ids.append(some.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64))
                parts.append(some.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension))
                n, at = n + some.num_rows, at + some.num_rows
                if n == block:
                    yield packed()
                    ids, parts, n = [], [], 0
        if n:
            yield packed()

    dealt = vectors.repartition(F.xxhash64("vec_id", "vector"))  # mixes any order of the input
    return dealt.mapInArrow(run, INDEX_DDL)


def _search(block, queries, k: int, share: float, start: float, grow: float, reach: float, work: list | None = None):
    """(query row, candidate rows, distances) of the best k + 1 verified candidates of each query in one block.

    The window ends of all queries of a batch are looked up together, line by line. ``work`` collects the
    numbers of counted entries and of verified vectors.
    """
    import numpy as np

    names, x, lines, rows, where = block
    n, m = len(names), len(lines)
    need = max(1, int(np.ceil(share * m)))
    first = float(np.quantile(np.abs(lines[:, None, :: max(1, n // 64)] - lines[:, :: max(1, n // 64), None]), start)) if n > 1 else 1.0
    first = first or 1e-12
    for begin in range(0, len(queries), 128):
        batch = np.arange(begin, min(begin + 128, len(queries)))
        seen, checked = np.zeros((len(batch), n), np.int16), np.zeros((len(batch), n), bool)
        low = np.stack([np.searchsorted(lines[j], where[batch, j]) for j in range(m)], axis=1)
        high, half, live = low.copy(), first, np.arange(len(batch))
        best = [(np.empty(0, np.int64), np.empty(0)) for _ in batch]
        while len(live):
            spots = where[batch[live]]
            left = np.minimum(low[live], np.stack([np.searchsorted(lines[j], spots[:, j] - half, side="left") for j in range(m)], axis=1))
            right = np.maximum(high[live], np.stack([np.searchsorted(lines[j], spots[:, j] + half, side="right") for j in range(m)], axis=1))
            open_ = np.ones(len(live), bool)
            for i, q in enumerate(live):
                fresh = [rows[j, a:b] for j, (a, b) in enumerate(zip(left[i].tolist(), low[q].tolist())) if a < b]
                fresh += [rows[j, a:b] for j, (a, b) in enumerate(zip(high[q].tolist(), right[i].tolist())) if a < b]
                if work is not None:
                    work.append((sum(map(len, fresh)), 0))
                if fresh:
                    seen[q] += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int16)
                new = np.flatnonzero((seen[q] >= need) & ~checked[q])
                found, far = best[q]
                if len(new):
                    checked[q, new] = True
                    if work is not None:
                        work.append((0, len(new)))
                    d = np.sqrt(((x[new] - queries[batch[q]]) ** 2).sum(axis=1))
                    found, far = np.concatenate((found, new)), np.concatenate((far, d))
                    top = np.lexsort((names[found], far))[: k + 1]
                    best[q] = found, far = found[top], far[top]
                open_[i] = not (len(found) > k and far[k] <= reach * half) and (right[i] - left[i]).min() < n
            low[live], high[live] = left, right
            live, half = live[open_], half * grow
        for i, q in enumerate(batch):
            yield int(q), *best[i]


def nearest(vectors: DataFrame, queries_where: str = "vec_id % 100 = 0", k: int = 10, projections: int = 32, share: float = 0.53, start: float = 0.1, grow: float = 1.07, reach: float = 1.1, block: int = 16_384, group_bytes: int = 32 << 20, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest candidates."""
    spark: SparkSession = vectors.sparkSession
    good = usable(vectors)
    one = good.select(F.size("vector").alias("d")).agg(F.mode("d", deterministic=True).alias("m")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if one is None or one.m is None:
        return empty
    dimension = int(one.m)
    good = good.where(F.size("vector") == dimension)
    index = staged(indexed(good, dimension, projections, block, seed), "vector_index")
    asked = staged(good.where(queries_where).withColumn("order", F.xxhash64("vec_id", "vector")), "vector_queries")
    groups = max(1, -(-asked.count() * 8 * (dimension + 2) // group_bytes))
    bounds = [-(1 << 63) + (1 << 64) * g // groups for g in range(1, groups)]
    out = None
    for g in range(groups):
        some = asked
        if g:
            some = some.where(F.col("order") >= F.lit(bounds[g - 1]))
        if g < groups - 1:
            some = some.where(F.col("order") < F.lit(bounds[g]))
        rows = some.orderBy("order", "vec_id").toArrow()  # about ``group_bytes``
        if not rows.num_rows:
            continue
        part = staged(_asked(index, rows, dimension, projections, seed, k, (share, start, grow, reach)), f"vector_found_{g}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return empty
    own = Window.partitionBy("query", "query_id").orderBy("score", "vec_id", F.desc("own"))
    best = out.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k + 1)
    # the query's own row, where it came so far, is taken out once
    mine = F.row_number().over(Window.partitionBy("query", "query_id").orderBy(F.desc("own"), "nth"))
    best = best.withColumn("drop", F.col("own") & (mine == 1))
    rank = F.row_number().over(Window.partitionBy("query", "query_id").orderBy("drop", "nth"))
    return best.withColumn("rank", rank.cast("int")).where((F.col("rank") <= k) & ~F.col("drop")).select("query_id", "rank", "vec_id", "score")


def _asked(index: DataFrame, asked: pa.Table, dimension: int, projections: int, seed: int, k: int, how: tuple) -> DataFrame:
    import numpy as np

    ids = asked["vec_id"].to_numpy()
    keys = asked["order"].to_numpy() * 31 + np.arange(len(ids))
    given = index.sparkSession.sparkContext.broadcast((ids, keys, asked["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dimension)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_q, keys_q, x_q = given.value
        lines = np.random.default_rng(seed).normal(size=(dimension, projections))
        spots = x_q @ lines
        for batch in batches:
            for names, x, p, rows in zip(*(batch.column(c).to_pylist() for c in ("vec_ids", "vectors", "lines", "rows"))):
                names = np.frombuffer(names, np.int64)
                x, p = np.frombuffer(x).reshape(-1, dimension), np.frombuffer(p).reshape(projections, -1)
                rows = np.frombuffer(rows, np.int32).reshape(projections, -1)
                got: list[tuple] = []
                for q, found, far in _search((names, x, p, rows, spots), x_q, k, *how):
                    own = (names[found] == names_q[q]) & (x[found] == x_q[q]).all(axis=1)
                    got += [(int(keys_q[q]), int(names_q[q]), int(names[i]), float(d), bool(o)) for i, d, o in zip(found, far, own)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [[]] * 5, kinds)], names=["query", "query_id", "vec_id", "score", "own"])

    return index.mapInArrow(run, "query long, query_id long, vec_id long, score double, own boolean")
