"""Exact vector search: nearest rows, distance bands and two rings, of single seeds or of whole tables of queries; offsets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import cosine_distance
from ..plans.staging import bounded, settled


def distances(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(id, label, distance) of every vector to the one row (vector) of ``query``."""
    one = query.select(F.col("vector").alias("__q")).limit(1)
    return vectors.join(F.broadcast(one)).select("id", "label", F.round(cosine_distance(F.col("vector"), F.col("__q")), 6).alias("distance"))


def nearest(vectors: DataFrame, seed: int, k: int = 10, label: int | None = None) -> DataFrame:
    """The ``k`` vectors nearest to ``seed`` (of one label if given), the seed left out."""
    out = distances(vectors, vectors.where(F.col("id") == seed)).where(F.col("id") != seed)
    return (out if label is None else out.where(F.col("label") == label)).orderBy("distance", "id").limit(k)


def band(vectors: DataFrame, seed: int, low: float, high: float) -> DataFrame:
    """Vectors whose distance to ``seed`` lies within a band: related, but no near synonym."""
    return distances(vectors, vectors.where(F.col("id") == seed)).where((F.col("id") != seed) & F.col("distance").between(low, high))


def offset(vectors: DataFrame, a: int, b: int, c: int, k: int = 10) -> DataFrame:
    """The vectors nearest to b - a + c, without the three."""
    v = lambda i, name: vectors.where(F.col("id") == i).select(F.col("vector").alias(name))
    point = v(a, "va").join(v(b, "vb")).join(v(c, "vc")).select(F.zip_with(F.zip_with("vb", "va", lambda x, y: x - y), "vc", lambda x, y: x + y).alias("vector"))
    return distances(vectors, point).where(~F.col("id").isin(a, b, c)).orderBy("distance", "id").limit(k)


def two_rings(vectors: DataFrame, seed: int, k: int = 8, second: int = 3) -> DataFrame:
    """(source, id, ring, distance): the seed's ``k`` nearest, and the ``second`` nearest of each of those.

    The second ring compares all vectors with k seeds, a stated number, by one broadcast of k rows.
    """
    from .relate import best

    first = nearest(vectors, seed, k)
    seeds = vectors.join(F.broadcast(first.select("id")), "id", "left_semi").select(F.col("id").alias("a"), F.col("vector").alias("va"))
    pairs = vectors.where(F.col("id") != seed).join(F.broadcast(seeds), F.col("id") != F.col("a"))
    scored = pairs.select("a", F.col("id").alias("b"), F.round(cosine_distance(F.col("vector"), F.col("va")), 6).alias("distance")).withColumn("score", -F.col("distance"))
    outer = best(scored, "a", second).select(F.col("a").alias("source"), F.col("b").alias("id"), F.lit(2).alias("ring"), "distance")
    return first.select(F.lit(seed).cast("long").alias("source"), "id", F.lit(1).alias("ring"), "distance").unionByName(outer)


SLICE, SLACK = 256, 1e-5  # queries compared at a time; what single precision and six digits may differ by


def _rows(column: pa.ChunkedArray):
    """Vectors as a matrix, a null component as nan."""
    import numpy as np

    flat = column.combine_chunks()
    if not flat.flatten().null_count:
        return np.asarray(flat.flatten().to_numpy(), float).reshape(len(flat), -1)
    return np.array(flat.to_pylist(), float)


def compared(vectors: DataFrame, queries: DataFrame, k: int | None = None, same_label: bool = False, low: float = -1.0, high: float = 3.0, block: int = 2048, within: bool = False) -> DataFrame:
    """(query_id, id, label, distance) of every row of ``queries`` to all other ``vectors`` (both id, label, vector), within a band; only the ``k`` nearest if given.

    Blocks of queries meet blocks of vectors; each pair of blocks keeps the best ``k`` of each query, so a
    task holds two blocks, and what meets again is k rows a query and block. Distances in single precision choose what may be
    among the nearest, those are measured in double precision. Null vectors are left out. With
    ``within`` a vector counts only if its ``value`` lies between the query's ``low`` and ``high``. With ``same_label``
    blocks hold one label each, so that other labels never meet.
    """
    extra = {"vb": ["value"], "qb": ["low", "high"]} if within else {"vb": [], "qb": []}

    def dealt(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        rows = rows.where("vector is not null").select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", "label", "vector", *extra[name])])  # new names: both sides may come from one table
        n = rows.count()
        n = max(1, -(-n // max(block, min(8 * block, n // 64))))  # larger blocks of large tables, which meet fewer others
        return rows.withColumn(name, F.pmod(F.xxhash64(f"{name}_id"), F.lit(n)).cast("int")), n

    def labelled(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """``rows`` with a block of their label, and the number of blocks of each label."""
        rows = rows.where("vector is not null and label is not null").select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", "label", "vector", *extra[name])])
        blocks = rows.groupBy(F.col(f"{name}_label").alias("of")).agg(F.ceil(F.count("*") / block).cast("int").alias(f"{name}_blocks"))
        rows = rows.join(bounded(settled(blocks)), F.col(f"{name}_label") == F.col("of"))
        return rows.withColumn(name, F.pmod(F.xxhash64(f"{name}_id"), F.col(f"{name}_blocks")).cast("int")).drop("of", f"{name}_blocks"), blocks

    def run(v: pa.Table, q: pa.Table) -> pa.Table:
        import numpy as np

        found = []
        if v.num_rows and q.num_rows:
            ids, labels, own = v["vb_id"].to_numpy(), v["vb_label"].to_numpy(), _rows(v["vb_vector"])
            asked, wanted, point = q["qb_id"].to_numpy(), q["qb_label"].to_numpy(), _rows(q["qb_vector"])
            size, length = (own * own).sum(axis=1), (point * point).sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                near, seen = (np.asarray(x / np.sqrt(n)[:, None], np.float32) for x, n in ((own, size), (point, length)))
            for at in range(0, len(asked), SLICE):
                some = slice(at, at + SLICE)
                with np.errstate(invalid="ignore"):
                    rough = 1 - seen[some] @ near.T  # to within SLACK; nan, which fits nothing, where a vector is zero
                    fits = (rough >= low - SLACK) & (rough <= high + SLACK) & (ids != asked[some, None])
                if same_label:
                    fits &= labels == wanted[some, None]
                if within:
                    value = v["vb_value"].to_numpy()
                    fits &= (value >= q["qb_low"].to_numpy()[some, None]) & (value <= q["qb_high"].to_numpy()[some, None])
                if k is not None and k < len(ids):
                    # no nearer k than those that lie surely within the band
                    sure = np.where(fits & (rough >= low + SLACK) & (rough <= high - SLACK), rough, np.inf)
                    fits &= rough <= np.partition(sure, k - 1, axis=1)[:, k - 1 : k] + 2 * SLACK
                one, two = np.nonzero(fits)
                one += at
                d = np.round(1 - np.clip((own[two] * point[one]).sum(axis=1) / np.sqrt(size[two] * length[one]), -1, 1), 6)
                kept = np.flatnonzero((d >= low) & (d <= high))
                one, two, d = one[kept], two[kept], d[kept]
                if k is not None:
                    order = np.lexsort((ids[two], d, one))
                    begin = np.searchsorted(one[order], one[order])  # where the rows of its query begin
                    order = order[np.arange(len(order)) - begin < k]
                    one, two, d = one[order], two[order], d[order]
                found.append((asked[one], ids[two], labels[two], d))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0)] * 4
        kinds = (pa.int64(), pa.int64(), label_type, pa.float64())
        return pa.Table.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds)], names=["query_id", "id", "label", "distance"])

    label_type = to_arrow_type(vectors.schema["label"].dataType)
    if same_label:
        (v, nv), (q, nq) = labelled(vectors, "vb"), labelled(queries, "qb")
        v = v.join(bounded(settled(nq)), F.col("vb_label") == F.col("of")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qb_blocks") - 1))).drop("of", "qb_blocks")
        q = q.join(bounded(settled(nv)), F.col("qb_label") == F.col("of")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vb_blocks") - 1))).drop("of", "vb_blocks")
        v, q = v.groupBy("vb_label", "qb", "vb"), q.groupBy("qb_label", "qb", "vb")
    else:
        (v, nv), (q, nq) = dealt(vectors, "vb"), dealt(queries, "qb")
        v = v.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).groupBy("qb", "vb")
        q = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))).groupBy("qb", "vb")
    out = v.cogroup(q).applyInArrow(run, f"query_id long, id long, label {dict(vectors.dtypes)['label']}, distance double")
    if k is None:
        return out
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def all_two_rings(vectors: DataFrame, queries: DataFrame, k: int = 8, second: int = 3) -> DataFrame:
    """(query_id, source, id, ring, distance): ``two_rings`` of every row of ``queries``."""
    first = settled(compared(vectors, queries, k).select("query_id", "id", "distance"))  # read three times
    members = vectors.join(first.select("id").distinct(), "id", "left_semi")
    near = compared(vectors, members, second + 1).select(F.col("query_id").alias("source"), "id", "distance")  # one more, as the query is left out
    outer = first.select("query_id", F.col("id").alias("source")).join(near, "source").where(F.col("id") != F.col("query_id"))
    nth = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("distance", "id"))
    outer = outer.withColumn("nth", nth).where(F.col("nth") <= second)
    return first.select("query_id", F.col("query_id").alias("source"), "id", F.lit(1).alias("ring"), "distance").unionByName(outer.select("query_id", "source", "id", F.lit(2).alias("ring"), "distance"))
