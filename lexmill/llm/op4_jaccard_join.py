"""Jaccard self-join of documents' word shingles with parity sketches.

A set's sketch cuts the hash space into parts and keeps, for each part, the XOR of its members' 64-bit
hashes; adding or removing a member flips one part only, so the number of parts in which two sketches
differ is a lower bound of the size of the symmetric difference. At threshold t = num / den, linked sets
of sizes a <= b differ in at most d = (a + b)(den - num) / (den + num) members. With more than d parts
some part must agree (pigeonhole), and documents are joined on (size band, part, XOR word).

Parts with few members would agree by chance, so a document emits only its parts with at least k
members, for the largest k that leaves more than d of them. Two linked documents then share a part that
both emit: the one with the larger k has more than d such parts, one of them is untouched, and the other
document emits that part too, as its own k is not larger. Where all spare parts of a document number s
(more than d are needed, at the top k), its s most frequent keys are left out: linked documents share at
least s + 1 keys, so in one global order of keys by falling frequency a shared key remains. That takes
common passages out of the join without losing a link.

Sizes fall into geometric bands with a number of parts each; a document whose larger partners may lie in
the next band emits keys there too. Candidates first pass a dense parity bit sketch (Hamming distance at
most d), then the exact sets of 64-bit shingle hashes are compared.

No group is expanded into rows of pairs. Equal sets collapse to one representative first. In the group of
a key every document is compared with the group's smallest, and those links are joined into components.
Groups that still hold several components (each set of documents once, however many keys it shares) are
dealt in blocks of about ``BLOCK`` documents: a component of that size or more has blocks of its own, which
never meet each other, the rest are pooled, and blocks hold one class of set sizes, so that only blocks of
the same or the next class meet. A task compares the bit sketches of two blocks at a time and
gives out only the pairs of different components that may be linked, which the exact comparison then
decides. Documents in one component need no further comparison, so components are exact.

Defined cases: a null or blank text has no shingles, n_shingles 0, and is linked with nothing; a text
with fewer words than the shingle has one shingle; rows with a null doc_id get their n_shingles and a
null component; rows that repeat a doc_id share that id's smallest component; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from .components import components
from .shared import mix64, bounded_broadcast, shingle_hashes, slices, staged

BAND, BLOCK = 1.6, 1024


@dataclass(frozen=True)
class Join:
    """Threshold num / den on shingles of ``width`` words."""

    num: int
    den: int
    width: int

    def most(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of sizes a and b."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def partner(self, a: int) -> int:
        return a * self.den // self.num

    def allowed(self, a: int) -> int:
        return self.most(a, self.partner(a))

    def members(self) -> tuple[int, float]:
        """The top k and the mean members a part, from the share of Poisson parts with k members or more."""
        need = 1.06 * (1 - self.num / self.den) / (1 + self.num / self.den) * (1 + self.den / self.num)
        best = (1, 1.0)
        for k in range(1, 6):
            at = max((x / 20 for x in range(4, 200)), key=lambda lam: self._full(k, lam) / lam)
            if self._full(k, at) / at >= need:
                best = (k, at)
        return best

    @staticmethod
    def _full(k: int, lam: float) -> float:
        return 1 - sum(math.exp(-lam) * lam**i / math.factorial(i) for i in range(k))

    def band(self, n: int) -> int:
        return int(math.log(n) / math.log(BAND) + 1e-9)

    def parts(self, band: int) -> int:
        low, high = math.ceil(BAND**band), max(math.ceil(BAND**band), math.ceil(BAND ** (band + 1)) - 1)
        return max(math.ceil(math.sqrt(low * high) / self.members()[1]), self.allowed(high) + 1)


def _keys(join: Join, top: int, parts: dict, h, band: int):
    """Join keys of the sorted hashes ``h`` in ``band``, and how many of the most frequent may go."""
    import numpy as np

    if band not in parts:
        parts[band] = join.parts(band)
    m = parts[band]
    part = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    starts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
    count = np.diff(np.concatenate((starts, [len(h)])))
    words, at = np.bitwise_xor.reduceat(mix64(h), starts), part[starts]
    d = join.allowed(len(h))
    k = top
    while k > 1 and (count >= k).sum() <= d:
        k -= 1
    good = count >= k
    if good.sum() <= d:  # so few parts are filled that the empty ones count too
        full = np.zeros(m, dtype=np.uint64)
        full[at] = words
        words, at, good = full, np.arange(m, dtype=np.uint64), np.ones(m, dtype=bool)
        k = 0
    spare = int(good.sum()) - d - 1 if k == top else 0
    keys = mix64(words[good] ^ mix64(at[good] + np.uint64(band) * np.uint64(1 << 32) + np.uint64(1)))
    return keys.view(np.int64), spare


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("own", pa.list_(pa.int64())), ("own_spare", pa.int32()), ("up", pa.list_(pa.int64())), ("up_spare", pa.int32()), ("bits", pa.binary())])
SKETCH_DDL = "doc_id long, n long, f1 long, f2 long, own array<long>, own_spare int, up array<long>, up_spare int, bits binary"


def sketches(docs: DataFrame, join: Join) -> DataFrame:
    """Per document: set size, 128-bit set fingerprint, keys of its own and the next band, dense parity bits."""
    top = join.members()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        parts: dict[int, int] = {}
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                cols: list[list] = [[] for _ in SKETCH]
                for doc, h in zip(batch.column("doc_id").to_pylist(), shingle_hashes(batch.column("text"), join.width)):
                    n = len(h)
                    own, own_spare, up, up_spare, bits = None, 0, None, 0, b""
                    z = mix64(h + np.uint64(0x51ED270B))
                    if n and join.allowed(n):
                        band = join.band(n)
                        own, own_spare = _keys(join, top, parts, h, band)
                        if join.band(join.partner(n)) > band:
                            up, up_spare = _keys(join, top, parts, h, band + 1)
                        size = 1 << max(6, (4 * n - 1).bit_length())
                        bits = np.packbits(np.bincount((z & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()
                    row = (doc, n, int(z.sum(dtype=np.uint64).view(np.int64)) if n else 0, int(np.bitwise_xor.reduce(mix64(z)).view(np.int64)) if n else 0, own, own_spare, up, up_spare, bits)
                    for c, v in zip(cols, row):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, SKETCH)], schema=SKETCH)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH_DDL)


def _hamming_ok(join: Join):
    @F.pandas_udf("boolean")
    def ok(x, y, a, b):
        import numpy as np
        import pandas as pd

        out = []
        for p, q, m, n in zip(x, y, a, b):
            p, q = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
            size = min(len(p), len(q))  # both are powers of two: folding halves keeps parity
            p, q = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (p, q))
            out.append(int(np.bitwise_count(p ^ q).sum()) <= join.most(int(m), int(n)))
        return pd.Series(out, dtype=bool)

    return ok


def _linked(join: Join):
    @F.pandas_udf("boolean")
    def ok(x, y):
        import numpy as np
        import pandas as pd

        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
            out.append(join.den * both >= join.num * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    return ok


def sets(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, hashes): the sorted shingle hashes as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                found = [h.tobytes() for h in shingle_hashes(batch.column("text"), join.width)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "hashes"])

    return docs.mapInArrow(run, "doc_id long, hashes binary")


def close(pairs: DataFrame, sketch: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose dense sketches allow a link."""
    bits = sketch.select(F.col("doc_id").alias("id"), "n", "bits")
    x = pairs.join(bits.withColumnsRenamed({"n": "na", "bits": "xa"}), F.col("a") == F.col("id")).drop("id")
    x = x.join(bits.withColumnsRenamed({"n": "nb", "bits": "xb"}), F.col("b") == F.col("id")).drop("id")
    return x.where(_hamming_ok(join)("xa", "xb", "na", "nb")).select("a", "b")


def verified(near: DataFrame, docs: DataFrame, join: Join, name: str, broadcast_bytes: int) -> DataFrame:
    """The pairs (a, b) of the table ``near`` that are linked, by their exact sets.

    Texts of candidates are picked by a broadcast of their ids while those are at most ``broadcast_bytes``,
    beyond that by a shuffle.
    """
    ids = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(bounded_broadcast(staged(ids, f"{name}_ids"), broadcast_bytes), "doc_id", "left_semi")
    whole = sets(texts, join)
    y = near.join(whole.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb")), "b")
    y = y.join(whole.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a")
    return staged(y.where(_linked(join)("ha", "hb")).select("a", "b").distinct(), f"{name}_links")


def _parity_near(join: Join):
    """For ``open_pairs``: rows of a block whose dense parity bits allow a link."""

    def prepared(bits: list[bytes], n):
        import numpy as np

        size = min(map(len, bits))  # powers of two: folding keeps parity
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, size), axis=0) for b in bits]).view(np.uint64)

        def near(i: int, rest):
            most = (n[rest] + n[i]) * (join.den - join.num) // (join.den + join.num)
            return np.bitwise_count(folded[rest] ^ folded[i]).sum(axis=1, dtype=np.int64) <= most

        return near

    return prepared


def open_pairs(group: DataFrame, roots: DataFrame, sketch: DataFrame, join: Join, prepared=None) -> DataFrame:
    """Pairs (a, b) of different components that share a key and whose sketches allow a link.

    ``prepared(bits, n)`` takes the sketches and set sizes of a block and gives near(i, rest), which says of the rows
    ``rest`` whether they may be linked with row i; the dense parity bits' Hamming distance if it is not given.
    """
    prepared = prepared or _parity_near(join)
    held = group.join(roots, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    one, two = F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit(1))
    tally = held.groupBy("key", "root").agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"))
    mixed = tally.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("members"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("roots > 1")
    mixed = mixed.groupBy("members", "x", "y").agg(F.min("key").alias("k"))
    held = held.join(mixed.select("k"), F.col("key") == F.col("k")).drop("k")
    held = held.join(sketch.select(F.col("doc_id").alias("id"), "n"), F.col("doc_id") == F.col("id")).drop("id")
    step = math.log(join.den / join.num) + 1e-9  # sizes of linked sets are at most one class apart
    big = tally.where(F.col("n") >= BLOCK).select(F.col("key").alias("k"), F.col("root").alias("r"), F.lit(True).alias("big"))
    held = held.join(big, (F.col("key") == F.col("k")) & (F.col("root") == F.col("r")), "left").drop("k", "r")
    held = staged(held.withColumn("class", F.floor(F.log("n") / step).cast("int")).withColumn("own_root", F.when(F.col("big"), F.col("root"))).drop("big"), "open_members")
    cells = held.groupBy("key", "own_root", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    of = Window.partitionBy("key").orderBy("class", F.col("own_root").asc_nulls_first())  # a row for each block at most
    cells = cells.withColumn("begin", (F.sum("blocks").over(of.rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks")).cast("int"))
    whole = cells.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("own_root", "class", "blocks", "begin")).alias("cells"))
    held = held.join(whole, F.col("key") == F.col("k")).drop("k")
    same = lambda c: c["own_root"].eqNullSafe(F.col("own_root")) & (c["class"] == F.col("class"))
    mine = F.get(F.filter("cells", same), F.lit(0))
    meets = F.filter("cells", lambda c: (F.abs(c["class"] - F.col("class")) <= 1) & (c["own_root"].isNull() | F.col("own_root").isNull() | (c["own_root"] != F.col("own_root"))))
    others = F.flatten(F.transform(meets, lambda c: F.sequence(c["begin"], c["begin"] + c["blocks"] - 1)))
    held = held.withColumn("own", (mine["begin"] + F.pmod(F.xxhash64("doc_id", F.lit(2)), mine["blocks"])).cast("int")).withColumn("other", F.explode(others))
    held = held.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "doc_id", "root", "n")
    held = held.join(sketch.select(F.col("doc_id").alias("id"), "bits"), F.col("doc_id") == F.col("id")).drop("id")

    def compared(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        import numpy as np

        n, root = np.array([r[6] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64)
        near = prepared([r[7] for r in rows], n)
        side = np.array([r[3] for r in rows])
        for i in range(len(rows)):
            rest = np.arange(i + 1, len(rows))
            rest = rest[(root[rest] != root[i]) & ((side[rest] != side[i]) | (rows[i][1] == rows[i][2]))]
            for j in rest[near(i, rest)]:
                a, b = sorted((rows[i][4], rows[j][4]))
                if a != b:
                    yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:3] != rows[0][:3]:
                    out += compared(rows)
                    rows = []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out = list(compared(rows)) if rows else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return held.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``; links at Jaccard >= num / den."""
    join = Join(num, den, width)
    sketch = staged(sketches(docs, join), "sketches")
    named = sketch.where("n > 0 and doc_id is not null")
    classes = staged(named.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "firsts")  # staged, so that the join's hot classes can be split
    member = named.select("doc_id", "f1", "f2", "n").join(classes, ["f1", "f2", "n"])
    member = staged(member, "classes")
    copies = bounded_broadcast(member.where("doc_id <> rep").drop("rep"), broadcast_bytes)
    firsts = named.join(copies, ["doc_id", "f1", "f2", "n"], "left_anti")

    def rows(keys: str, up: bool) -> DataFrame:
        return firsts.select("doc_id", F.col(f"{keys}_spare").alias("spare"), F.lit(up).alias("up"), F.explode(keys).alias("key"))

    emitted = rows("own", False).unionByName(rows("up", True))
    shared = emitted.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("times")).where("times > 1")
    found = emitted.join(shared, F.col("key") == F.col("k"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "up").orderBy(F.desc("times"), "key"))
    group = staged(found.withColumn("nth", nth).where("nth > spare").select("key", "doc_id").distinct(), "groups")

    star = group.groupBy(F.col("key").alias("k")).agg(F.min("doc_id").alias("a"), F.count("*").alias("times")).where("times > 1")
    first = group.join(star, F.col("key") == F.col("k")).where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    first = staged(first, "star_pairs")
    links = verified(staged(close(first, sketch, join), "star_near"), docs, join, "star", broadcast_bytes)
    roots = staged(components(links), "star_roots")
    rest = open_pairs(group, roots, sketch, join).join(first, ["a", "b"], "left_anti")
    more = verified(staged(rest, "open_near"), docs, join, "open", broadcast_bytes)
    roots = staged(components(links.unionByName(more)), "roots")

    own = member.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    own = own.groupBy(F.col("doc_id").alias("id")).agg(F.min("root").alias("root"))
    out = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(own, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _named_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``__id``: the doc_id, or, where rows with different texts share one, a number of its own for each text.

    Rows that agree in doc_id and text become one, the smallest as JSON. Null doc_ids stay null.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.where("doc_id is not null")
    again = staged(named.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "repeated_ids")
    if not again.limit(1).count():
        return docs.withColumn("__id", F.col("doc_id").cast("long"))
    again = bounded_broadcast(again)
    on = F.col("doc_id") == F.col("__again")
    once = docs.join(again, on, "left_anti").select(*columns, F.col("doc_id").cast("long").alias("__id"))
    rows = named.join(again, on, "left_semi").groupBy("doc_id", F.sha2(F.col("text"), 256).alias("__sha"))
    rows = staged(rows.agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias("__row")).select("__sha", "__row.*"), "repeated_rows")
    for seed in range(100):
        apart = rows.select(*columns, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("__sha")).alias("__id"))
        out = once.unionByName(apart)
        ids = out.where("__id is not null").select("__id")
        if ids.groupBy("__id").count().where("count > 1").limit(1).count() == 0:
            return out
    raise ValueError("no numbers apart were found")


def keep_one(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with one document of each component; the one with the smallest doc_id where ids do not repeat.

    Rows that agree in doc_id and text become one. Rows that share a doc_id but not the text are documents
    of their own: they stay unless they are linked. Rows without a doc_id stay, and so do those without words.
    """
    rows = _named_apart(docs)
    found = near_duplicates(rows.select(F.col("__id").alias("doc_id"), "text"), num, den, width, broadcast_bytes)
    gone = bounded_broadcast(staged(found.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")), "gone"), broadcast_bytes)
    return rows.join(gone, F.col("__id") == F.col("__gone"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
