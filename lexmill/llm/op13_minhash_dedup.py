"""MinHash near-duplicate removal with fast similarity sketches.

A sketch has ``COORDINATES`` coordinates. In round i every member of a set is hashed to a bin and a value i + v,
v in [0, 1), and bins keep their least value; rounds go on until all bins are full. Round COORDINATES + k sends all
members to bin k, so every coordinate fills for certain, after a number of values that does not grow with
the coordinates times the set: about n + COORDINATES * log(COORDINATES). A later round cannot displace an earlier
one, so two sets agree in a coordinate with the probability of their Jaccard similarity, and the number of agreeing
coordinates is concentrated about it as if they were independent.

Bands of ``ROWS`` coordinates are keys. Linked documents share none of the 40 bands with probability at most
(1 - 0.8^4)^40 = 7e-10 at similarity 0.8, and less above it. Pairs that share a key are decided on their full sets of
64-bit shingle hashes. Before these are fetched, the parity bits of ``op4_jaccard_join`` leave out pairs that certainly
differ by too much: their Hamming distance is a lower bound, so no linked pair is lost there.

No group is expanded into rows of pairs. Equal sets collapse to one representative. In the group of a key every
document is compared with the group's smallest, and those links are joined into components. Groups that hold
several components are dealt in blocks, as ``op4_jaccard_join.open_pairs`` says, and two blocks meet in a task,
which compares their parity bits and gives out the pairs of different components that may be linked.

Defined cases: a null or blank text has no shingles, n_shingles 0, and is linked with nothing; a text with fewer
words than the shingle has one shingle; rows with a null doc_id get their n_shingles and a null component_id and
kept; rows that repeat a doc_id share that id's smallest component; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .op4_jaccard_join import Join, close, open_pairs, verified
from .shared import bounded_broadcast, mix64, shingle_hashes, slices, staged

COORDINATES, ROWS = 160, 4
ROUND_SHIFT = 55  # a value is the round above, 55 bits of a hash below


def fast_sketch(h):
    """The uint64 coordinates of the non-empty set of distinct uint64 hashes ``h``."""
    import numpy as np

    t = COORDINATES
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full(t, full)

    def hashed(rounds):
        x = mix64(h[None, :] + rounds[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        value = (mix64(x ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - ROUND_SHIFT)) | (rounds[:, None] << np.uint64(ROUND_SHIFT))
        return ((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32), value

    done, step = 0, min(t, max(1, round(1.3 * t * np.log(t) / len(h))))
    while done < t and (sketch == full).any():
        bins, value = hashed(np.arange(done, min(t, done + step), dtype=np.uint64))
        np.minimum.at(sketch, bins.ravel().astype(np.int64), value.ravel())
        done, step = done + step, max(1, step // 2)
    empty = np.flatnonzero(sketch == full)
    if len(empty):
        sketch[empty] = hashed(np.uint64(t) + empty.astype(np.uint64))[1].min(axis=1)
    return sketch


def band_keys(sketch):
    """An int64 key for each band, apart for each band."""
    import numpy as np

    rows = sketch.reshape(-1, ROWS)
    keys = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return keys.view(np.int64)


def parity_bits(z) -> bytes:
    """Parities of the uint64 hashes ``z``, four bits or more for each, as ``op4_jaccard_join.close`` compares them."""
    import numpy as np

    size = 1 << max(6, (4 * len(z) - 1).bit_length())
    return np.packbits(np.bincount((z & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary())])


def sketches(docs: DataFrame, join: Join) -> DataFrame:
    """Per document: set size, 128-bit set fingerprint, band keys, and parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for whole in batches:
            for batch in slices(whole, "text"):
                cols: list[list] = [[] for _ in SKETCH]
                for doc, h in zip(batch.column("doc_id").to_pylist(), shingle_hashes(batch.column("text"), join.width)):
                    n, keys, bits, f1, f2 = len(h), None, b"", 0, 0
                    if n:
                        z = mix64(h + np.uint64(0x51ED270B))
                        f1, f2 = int(z.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix64(z)).view(np.int64))
                    if n and join.allowed(n):  # else only an equal set can be linked
                        keys, bits = band_keys(fast_sketch(h)), parity_bits(z)
                    for c, v in zip(cols, (doc, n, f1, f2, keys, bits)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, SKETCH)], schema=SKETCH)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, f1 long, f2 long, keys array<long>, bits binary")


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``; links at Jaccard >= num / den."""
    join = Join(num, den, width)
    sketch = staged(sketches(docs, join), "fast_sketches")
    named = sketch.where("n > 0 and doc_id is not null")
    classes = staged(named.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "fast_firsts")  # written, so that the join's hot classes can be split
    member = staged(named.select("doc_id", "f1", "f2", "n").join(classes, ["f1", "f2", "n"]), "fast_classes")
    copies = bounded_broadcast(member.where("doc_id <> rep").select("doc_id", "f1", "f2", "n"), broadcast_bytes)
    firsts = named.where("keys is not null").join(copies, ["doc_id", "f1", "f2", "n"], "left_anti")

    emitted = firsts.select("doc_id", F.explode("keys").alias("key"))
    heads = emitted.groupBy(F.col("key").alias("k")).agg(F.min("doc_id").alias("a"), F.count("*").alias("times")).where("times > 1")
    heads = staged(heads.select("k", "a"), "fast_heads")
    group = staged(emitted.join(heads, F.col("key") == F.col("k")).select("key", "a", "doc_id"), "fast_groups")
    first = staged(group.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "fast_first")
    links = verified(staged(close(first, sketch, join), "fast_near"), docs, join, "fast_star", broadcast_bytes)
    roots = staged(components(links), "fast_roots")

    rest = open_pairs(group.select("key", "doc_id").distinct(), roots, sketch, join).join(first, ["a", "b"], "left_anti")
    more = verified(staged(rest, "fast_rest"), docs, join, "fast_open", broadcast_bytes)
    roots = staged(components(links.unionByName(more)), "fast_all_roots")

    own = member.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    own = own.groupBy(F.col("doc_id").alias("id")).agg(F.min("root").alias("root"))
    out = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(own, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
