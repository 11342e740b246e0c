"""What the operators of this package share: the shared folder, staged tables and word splitting."""

from __future__ import annotations

import contextlib
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one of our own in a local session; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")

        base = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/lexmill-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


_MADE: list[list[str]] = []


@contextlib.contextmanager
def scratch():
    """The folders that ``shared_dir`` gives out inside, for ``discard`` once what reads them has been written."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE[:] = [x for x in _MADE if x is not made]


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Delete ``folders``; ones that were never written are passed over."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most_bytes: int) -> bool:
    """Whether the rows of ``df`` take at most ``most_bytes``: 16 for each value and row, and what strings, binaries and arrays hold."""
    size = F.lit(16 * (1 + len(df.columns)))
    for c, t in df.dtypes:
        if t in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f"`{c}`"), F.lit(0))
        elif t.startswith("array"):
            size = size + 16 * F.greatest(F.coalesce(F.size(f"`{c}`"), F.lit(0)), F.lit(0))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most_bytes


def bounded_broadcast(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """The written table ``df`` marked for broadcast if its rows take at most ``most_bytes``; else Spark shuffles both sides."""
    return F.broadcast(df) if small(df, most_bytes) else df


def split_words(text: pa.Array, lower: bool = False) -> tuple[pa.Array, "object"]:
    """Words of each text (runs without ASCII white space) and each text's offsets into them.

    Returns the flat words and an int64 numpy array of len(text) + 1 offsets; a null text has no words.
    """
    import numpy as np

    text = pc.fill_null(text.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(text)
    flat, offsets = lists.values, np.asarray(lists.offsets, dtype=np.int64)
    full = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate(([0], np.cumsum(full)))
    if not full.all():
        flat = flat.filter(pa.array(full))
    if lower:  # only now: on a slice of an array ascii_lower gives broken strings
        flat = pc.ascii_lower(flat)
    return flat, before[offsets] - before[offsets[0]]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """``batch`` in runs of rows whose ``column`` holds about ``most`` bytes (a longer text makes a run of its own).

    After the last run Arrow's free memory goes back to the system: workers stay alive between tasks, and what they keep counts.
    """
    import numpy as np

    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    run = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()


def mix64(x):
    """splitmix64 finaliser over a numpy uint64 array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: pa.Array, width: int):
    """Yields, for each text, the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A-Z are lower-cased. A text with fewer words gives its whole sequence as one shingle, a text without
    words none.
    """
    import numpy as np
    from pandas.util import hash_array

    flat, offsets = split_words(text, lower=True)
    coded = flat.dictionary_encode() if len(flat) else None
    if coded is None:
        for _ in range(len(text)):
            yield np.empty(0, dtype=np.uint64)
        return
    own = hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)
    w = mix64(own)[coded.indices.to_numpy(zero_copy_only=False)]
    prime = np.uint64(0x9E3779B97F4A7C15)
    rolled = w.copy()
    for j in range(1, min(width, len(w))):
        rolled[: len(w) - j] = rolled[: len(w) - j] * prime + w[j:]
    rolled = mix64(rolled + np.uint64(width))
    for a, b in zip(offsets[:-1], offsets[1:]):
        n = b - a
        if n == 0:
            yield np.empty(0, dtype=np.uint64)
        elif n < width:
            acc = np.zeros(1, dtype=np.uint64)
            for v in w[a:b]:
                acc = acc * prime + v
            yield mix64(acc + np.uint64(n))
        else:
            h = np.sort(rolled[a : b - width + 1])
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]
