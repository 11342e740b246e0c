"""Token ids in a content-addressed store, and back.

Each document's ids (with the end id) are cut where a rolling hash of the last 16 ids matches, so equal
passages give equal chunks wherever they stand. A chunk's address is the BLAKE2b hash of its ids; the
store keeps each address once. A document's recipe lists its chunks' addresses and sizes and the Merkle
root over them; recipes lie in ascending doc_id order with the global position of the first id. Each
range of recipes has a manifest row with the Merkle root over its documents, and one row for the whole
store holds the width of an id, the totals and the root over the manifest.

Texts are not shuffled. One shuffle by address deals chunks to their files and drops repeats; each task
has already dropped the ones it saw itself, so a chunk that many documents share stays small. Reading
back first works out the manifest and its root from the recipes, so a lost or changed file of either
raises; it checks every chunk against its address and every recipe against its root, and takes each document's
checksum from the chunks' checksums (CRC-32 of a sequence is a linear function of those of its parts), so
ids are not moved again; ``documents_of`` puts the ids themselves together.

Words are encoded by the tokenizers library once each: its pre-tokenizer never joins across ASCII white
space, nor a run of letters with punctuation that follows. That split is made for ASCII letters and the
Latin letters up to U+017E only, whose normal form and lower case are one letter; of these U+0130 is left
out, as its lower case ends in a combining mark. Any other word goes to the library whole.

Defined cases: a null text is an empty one and has the end id only; null doc_ids come first; rows that
repeat a doc_id are documents of their own, ordered by their roots; an empty table gives an empty store;
other columns are not read.

Tables under ``path``: objects (kind 1: address, data), recipes (doc_id, start, n_tokens, root,
addresses, sizes, part), manifest (part, n_docs, n_tokens, start, root), store (width, n_docs, n_tokens,
root). data is zstandard-compressed 16-bit
little-endian ids (32-bit for vocabularies over 65,536).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .shared import shared_dir, slices, split_words, staged
from .wordcache import WordCache, gather

WINDOW, LEAST, MOST, MASK = 16, 64, 8192, 511
LETTERS = "[A-Za-zÀ-ÖØ-öø-įı-ž]"
PUNCTUATION = r"[!-&(-/:;=?@\[-`{-~]"
_ENCODERS: dict = {}


def width_of(vocab: dict[str, int]) -> int:
    """Bytes of an id of ``vocab`` in the store."""
    return 2 if max(vocab.values()) < 1 << 16 else 4


class WordEncoder:
    """ids of whole texts, by a tokenizer file whose pieces end words with </w>."""

    def __init__(self, path: str):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.width = width_of(vocab)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        self.parts = WordCache(self._encode, np.uint32)

    def _each(self, words: list[str]) -> tuple:
        import numpy as np

        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.array([i for x in ids for i in x], np.uint32)

    def _encode(self, words: pa.Array) -> tuple:
        """Runs of letters are single pre-tokens: they are encoded many at once and cut at the word ends."""
        import numpy as np
        import pyarrow.compute as pc

        plain = np.asarray(pc.match_substring_regex(words, rf"^{LETTERS}+$"))
        sizes, values = np.zeros(len(words), np.int64), [None, None]
        for side in (True, False):
            rows = np.flatnonzero(plain == side)
            some = words.take(pa.array(rows)).to_pylist()
            if side and some:
                texts = [" ".join(some[i : i + 500]) for i in range(0, len(some), 500)]
                ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint32)
                last = np.flatnonzero(self.ends[ids])
                if len(last) == len(some):  # each word has an end at least, so each has exactly one
                    sizes[rows], values[0] = np.diff(np.concatenate(([-1], last))), ids
                    continue
            sizes[rows], values[0 if side else 1] = self._each(some)
        flat = np.concatenate([np.empty(0, np.uint32) if v is None else v for v in values])
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        at = np.zeros(len(words), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return sizes, gather(flat, at, sizes)

    def encode(self, text: pa.Array, end: int | None = None) -> tuple:
        """(ids, offsets) of all texts; ``end`` is appended to each."""
        import numpy as np
        import pyarrow.compute as pc

        flat, offsets = split_words(text)
        n_docs = len(offsets) - 1
        if len(flat):
            coded = flat.dictionary_encode()
            words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            words, codes = pa.array([], pa.large_string()), np.empty(0, np.int64)
        # a word is a run of letters, letters with punctuation after them, or else itself
        two = np.asarray(pc.match_substring_regex(words, rf"^{LETTERS}+{PUNCTUATION}+$"))
        one = np.asarray(pc.match_substring_regex(words, rf"^{LETTERS}+$"))
        pairs, letters = words.filter(pa.array(two)), words.filter(pa.array(one))
        heads = pc.ascii_lower(pc.replace_substring_regex(pairs, rf"{PUNCTUATION}+$", ""))
        tails = pc.replace_substring_regex(pairs, f"^{LETTERS}+", "")
        rest = words.filter(pa.array(~two & ~one))
        parts = pa.concat_arrays([x.cast(pa.large_string()) for x in (heads, pc.ascii_lower(letters), rest, tails)]).dictionary_encode()
        values, start, size = self.parts.runs(parts.dictionary)
        index = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n2, n1 = len(pairs), len(letters)
        first, second = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        first[two], first[one], first[~two & ~one] = index[:n2], index[n2 : n2 + n1], index[n2 + n1 : len(words)]
        second[two] = index[len(words) :]
        # a flat list of parts, two for each word; the end id is one more word of each document
        values = np.concatenate((values, np.array([0 if end is None else end], np.uint32)))
        start, size = np.concatenate((start, [0, len(values) - 1])), np.concatenate((size, [0, 0 if end is None else 1]))
        codes = np.insert(codes, offsets[1:], len(words))
        first, second = np.concatenate((first, [len(size) - 1])), np.concatenate((second, [-1]))
        second[second < 0] = len(size) - 2
        both = np.stack((first[codes], second[codes]), axis=1).ravel()
        ids = gather(values, start[both], size[both])
        per = np.add.reduceat(size[both].astype(np.int64), 2 * (offsets[:-1] + np.arange(n_docs))) if n_docs else np.empty(0, np.int64)
        return ids, np.concatenate(([0], np.cumsum(per)))


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cuts(ids, offsets) -> list[list[int]]:
    """For each document the ends of its chunks, relative to ``ids``.

    A chunk ends after an id at which the hash of the last WINDOW ids has its low bits zero, if it has
    LEAST ids by then; at MOST ids it ends anyway.
    """
    import numpy as np

    from .shared import mix64

    h = mix64(ids.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    reach, factor = 1, np.uint64(0x9E3779B97F4A7C15)
    while reach < WINDOW:  # doubling: the hash of 2r ids from two of r ids
        h[reach:] = h[reach:] + h[:-reach] * factor
        factor, reach = factor * factor, reach * 2
    marks = np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, last = [], a
        for m in marks[np.searchsorted(marks, a + LEAST) : np.searchsorted(marks, b)].tolist():
            while m - last > MOST:
                last += MOST
                ends.append(last)
            if m - last >= LEAST:
                ends.append(m)
                last = m
        while b - last > MOST:
            last += MOST
            ends.append(last)
        if b > last:
            ends.append(b)
        out.append(ends)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root over ``leaves``; an odd node at the end of a level moves up alone."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [address(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


OBJECT_DDL = "key binary, kind int, doc_id long, n_tokens long, root binary, addresses binary, sizes array<int>, data binary"
OBJECT = pa.schema([("key", pa.binary()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("addresses", pa.binary()), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])


def objects(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """A row for each document (kind 0) and for each chunk that a task has not met before (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        own, pack, seen, row = encoder(tokenizer), zstandard.ZstdCompressor(level=1), set(), 0
        task = TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = own.encode(batch.column("text"), end)
                raw, width = memoryview(ids.astype(f"<u{own.width}").tobytes()), own.width
                out: list[tuple] = []
                for doc, a, ends in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), cuts(ids, offsets)):
                    begins, names = [a, *ends[:-1]], []
                    for x, y in zip(begins, ends):
                        chunk = bytes(raw[x * width : y * width])
                        names.append(address(chunk))
                        if names[-1] not in seen:
                            seen.add(names[-1])
                            out.append((names[-1], 1, None, None, None, None, None, pack.compress(chunk)))
                    sizes = [y - x for x, y in zip(begins, ends)]
                    out.append((task.to_bytes(8, "big") + row.to_bytes(8, "big"), 0, doc, sum(sizes), merkle(names), b"".join(names), sizes, None))
                    row += 1
                if len(seen) > 500_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OBJECT)] if out else [pa.array([], f.type) for f in OBJECT], schema=OBJECT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OBJECT_DDL)


RECIPE_DDL = "doc_id long, start long, n_tokens long, root binary, addresses binary, sizes array<int>, part int"
MANIFEST_DDL = "part int, n_docs long, n_tokens long, root binary, start long"
STORE_DDL = "width int, n_docs long, n_tokens long, root binary"


def in_order() -> list:
    return [F.col("doc_id").asc_nulls_first(), F.col("root")]


def part_roots(rows: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, root): the Merkle root over each part's documents, in order."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, tokens, stack = None, 0, 0, []  # stack: (height, node) of the finished subtrees

        def done() -> pa.RecordBatch:
            top = b""
            for _, node in reversed(stack):
                top = address(b"\1" + node + top) if top else node
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [n], "n_tokens": [tokens], "root": [top]})

        for batch in batches:
            for p, count, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "root"))):
                if p != part:
                    if part is not None:
                        yield done()
                    part, n, tokens, stack = p, 0, 0, []
                n, tokens, node = n + 1, tokens + count, (0, root)
                while stack and stack[-1][0] == node[0]:
                    node = (node[0] + 1, address(b"\1" + stack.pop()[1] + node[1]))
                stack.append(node)
        if part is not None:
            yield done()

    parts = rows.select("part", "doc_id", "n_tokens", "root").repartition("part").sortWithinPartitions("part", *in_order())
    return parts.mapInArrow(roots, "part int, n_docs long, n_tokens long, root binary")


def manifest_root(parts: DataFrame) -> tuple[int, int, bytes]:
    """Documents, tokens and the Merkle root of a manifest: a row for each task of a range shuffle."""
    rows = parts.select("part", "n_docs", "n_tokens", "root").orderBy("part").collect()
    return sum(r.n_docs for r in rows), sum(r.n_tokens for r in rows), merkle([bytes(r.root) for r in rows])


def checked_width(spark: SparkSession, path: str) -> int:
    """Bytes of an id in the store at ``path``, after its recipes were held against the manifest and that against the store's row."""
    whole = spark.read.schema(STORE_DDL).parquet(f"{path}/store").collect()
    recipes = spark.read.schema(RECIPE_DDL).parquet(f"{path}/recipes")
    if len(whole) != 1 or (whole[0].n_docs, whole[0].n_tokens, bytes(whole[0].root)) != manifest_root(part_roots(recipes)):
        raise ValueError("the recipes do not match the store's root")
    if (whole[0].n_docs, whole[0].n_tokens, bytes(whole[0].root)) != manifest_root(spark.read.schema(MANIFEST_DDL).parquet(f"{path}/manifest")):
        raise ValueError("the manifest does not match the store's root")
    return whole[0].width


def write_store(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Encode ``docs`` into a store at ``path`` (a folder all executors share)."""
    spark = docs.sparkSession
    dealt = objects(docs, tokenizer, end).repartition("key").groupBy("key", "kind")
    names = ["doc_id", "n_tokens", "root", "addresses", "sizes", "data"]
    dealt.agg(*[F.first(c).alias(c) for c in names]).write.parquet(f"{path}/objects")
    made = spark.read.schema(OBJECT_DDL).parquet(f"{path}/objects").where("kind = 0").select("doc_id", "n_tokens", "root", "addresses", "sizes")
    ranged = made.repartitionByRange(F.col("doc_id").asc_nulls_first(), "root").withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "ranged", f"{path}/work")

    parts = staged(part_roots(ranged), "parts", f"{path}/work")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # a row for each task of the range shuffle
    parts.withColumn("start", F.sum("n_tokens").over(upto) - F.col("n_tokens")).write.parquet(f"{path}/manifest")
    begin = spark.read.parquet(f"{path}/manifest").select(F.col("part").alias("p"), F.col("start").alias("begin"))
    inside = Window.partitionBy("part").orderBy(*in_order()).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(begin, F.col("part") == F.col("p")).withColumn("start", F.col("begin") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    placed = placed.select("doc_id", "start", "n_tokens", "root", "addresses", "sizes", "part")
    placed.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    from tokenizers import Tokenizer

    top = manifest_root(spark.read.parquet(f"{path}/manifest"))
    spark.createDataFrame([(width_of(Tokenizer.from_file(tokenizer).get_vocab()), *top)], STORE_DDL).write.parquet(f"{path}/store")


def _unpacked(data: bytes, address_of: bytes, unpack) -> bytes:
    raw = unpack.decompress(data)
    if address(raw) != address_of:
        raise ValueError("a chunk does not match its address")
    return raw


def chunk_digests(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(address, n, crc) of every stored chunk, read from its bytes and checked against its address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            names, n, crc = batch.column("key").to_pylist(), [], []
            for name, data in zip(names, batch.column("data").to_pylist()):
                ids = np.frombuffer(_unpacked(data, name, unpack), f"<u{width}")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], names=["address", "n", "crc"])

    return spark.read.schema(OBJECT_DDL).parquet(f"{path}/objects").where("kind = 1").select("key", "data").mapInArrow(run, "address binary, n int, crc long")


def recipe_rows(spark: SparkSession, path: str) -> DataFrame:
    """(start, doc_id, n_tokens, at, address, size) for every chunk of every recipe, checked against its root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for start, doc, n, root, names, sizes in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_id", "n_tokens", "root", "addresses", "sizes"))):
                leaves = [names[i : i + 16] for i in range(0, len(names), 16)]
                if merkle(leaves) != root or sum(sizes) != n:
                    raise ValueError("a recipe does not match its root")
                at = 0
                for leaf, size in zip(leaves, sizes):
                    out.append((start, doc, n, at, leaf, size))
                    at += size
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["start", "doc_id", "n_tokens", "at", "address", "size"])

    return spark.read.schema(RECIPE_DDL).parquet(f"{path}/recipes").mapInArrow(run, "start long, doc_id long, n_tokens long, at long, address binary, size int")


def _crc_tables() -> list:
    """For each k, tables that carry a CRC-32 over 2**k zero bytes, by bytes of the CRC."""
    import numpy as np

    def times(rows, v):  # a linear map, given by the images of the 32 bits
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where((v >> np.uint32(i)) & np.uint32(1), rows[i], np.uint32(0))
        return out

    one = np.array([0xEDB88320] + [1 << i for i in range(31)], np.uint32)  # over one zero bit
    for _ in range(3):
        one = times(one, one)
    out = []
    for _ in range(40):
        out.append([times(one, np.arange(256, dtype=np.uint32) << np.uint32(8 * j)) for j in range(4)])
        one = times(one, one)
    return out


@F.pandas_udf(T.LongType())
def _carried(crc, after):
    """CRC-32 values carried over ``after`` bytes that follow."""
    import numpy as np
    import pandas as pd

    v, n = crc.to_numpy().astype(np.uint32), after.to_numpy().astype(np.int64)
    for k, t in enumerate(_crc_tables()[: int(n.max(initial=0)).bit_length()]):
        moved = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
        v = np.where((n >> k) & 1, moved, v)
    return pd.Series(v.astype(np.int64))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the store's files."""
    width = checked_width(spark, path)
    rows = recipe_rows(spark, path)
    read = chunk_digests(spark, path, width).withColumnsRenamed({"address": "have", "n": "have_n"})
    joined = rows.join(read, F.col("address") == F.col("have"), "left")
    sound = F.when(F.coalesce(F.col("have_n") == F.col("size"), F.lit(False)), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing or has another size")).cast("long"))
    joined = joined.select("start", "doc_id", "n_tokens", _carried(sound, 4 * (F.col("n_tokens") - F.col("at") - F.col("size"))).alias("crc"))
    return joined.groupBy("start", "doc_id", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32")).select("doc_id", "start", "n_tokens", "ids_crc32")


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document's ids, put together from its chunks."""
    width = checked_width(spark, path)

    @F.pandas_udf("array<long>")
    def ids(chunks):
        import numpy as np
        import pandas as pd
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        return pd.Series([np.concatenate([np.frombuffer(_unpacked(c["data"], c["address"], unpack), f"<u{width}") for c in x]).astype(np.int64) for x in chunks])

    data = spark.read.schema(OBJECT_DDL).parquet(f"{path}/objects").where("kind = 1").select(F.col("key").alias("have"), "data")
    rows = recipe_rows(spark, path).join(data, F.col("address") == F.col("have"))
    whole = rows.groupBy("start", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "address", "data"))).alias("chunks"))
    return whole.select("doc_id", "start", ids("chunks").alias("ids"))


def stored(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and return the digests read back from it."""
    path = shared_dir(docs.sparkSession)
    write_store(docs, path, tokenizer, end)
    return digests(docs.sparkSession, path)
