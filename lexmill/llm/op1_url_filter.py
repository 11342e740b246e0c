"""URL filter: rules, and for the rest a character language-model ratio.

Every url that a rule decides is an example of its verdict. Two smoothed variable-order Markov models are
counted from all of them, one for accepted and one for rejected urls: every n-gram of up to ``order`` + 1
characters counts, however rare (Witten-Bell weights, down to a uniform guess). A url's score is the
difference of the two log-likelihoods over its length; it is accepted at or above the cut that best
separates a held-out fold of the examples, scored by the counts of the others (the fold's scores are
gathered as counts over a fixed grid, and the cut is read from those). The scores given are by the counts
of all examples.

The counts are a table and never leave it: urls are dealt into chunks of bounded size, the distinct
n-grams of each chunk are joined to the counts, and a chunk is scored beside what it found.

The url is read in ASCII (any other byte is one symbol), from after ``://``, lower-cased.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, and scores 0
if it is null or empty; while either class has no example every score and the cut are 0, so such urls are
allowed; where a class has examples only inside or only outside of the fold the cut is 0; repeated rows
are judged alike and count as often as they occur; long urls are read whole, a megabyte of urls (or one
longer url) at a time; an empty table gives an empty result; columns other
than page_id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .shared import slices, staged

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SYMBOLS = 97  # printable ASCII, everything else, and the end
LEAST, GRID = -8.0, 1024
COUNTS = ("allow_most", "block_most", "allow_all", "block_all")  # outside of the fold, and of all examples


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: empty without ``://``; ASCII letters of the host in lower case."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host and the hosts below it."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, under = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + under)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def symbols(url: pa.Array):
    """(symbols, offsets): each url from after ``://``, and an end symbol."""
    import numpy as np

    raw = [(u or "").rpartition("://")[2] if (u or "").count("://") == 1 else (u or "").partition("://")[2] or (u or "") for u in url.to_pylist()]
    data = [u.lower().encode() for u in raw]
    size = np.array([len(d) + 1 if d else 0 for d in data], np.int64)
    flat = np.frombuffer(b"".join(d + b"\0" for d in data if d), np.uint8).astype(np.int64)
    codes = np.where((flat >= 32) & (flat < 127), flat - 32, 95)
    offsets = np.concatenate(([0], np.cumsum(size)))
    codes[offsets[1:][size > 0] - 1] = 96
    return codes, offsets


def grams(codes, offsets, width: int):
    """Base-SYMBOLS codes of the n-gram of ``width`` symbols ending at each position; -1 where the url is shorter."""
    import numpy as np

    inside = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.zeros(len(codes), np.int64)
    for k in range(width - 1, -1, -1):
        moved = np.roll(codes, k)
        out = out * SYMBOLS + moved
    out[inside < width - 1] = -1
    return out


class Markov:
    """What a chunk found in the counts: for each width the sorted n-grams and contexts with one class's counts."""

    def __init__(self, found: pa.Table, name: str, order: int):
        import numpy as np

        slot, gram, n, kinds = (found.column(c).to_numpy() for c in ("slot", "gram", name, f"{name}_kinds"))
        self.order, self.grams, self.contexts = order, [], []
        by = np.argsort(gram, kind="stable")
        for width in range(1, order + 2):
            own, heads = by[(slot[by] == 2 * width) & (n[by] > 0)], by[(slot[by] == 2 * width + 1) & (n[by] > 0)]
            self.grams.append((gram[own], n[own]))
            self.contexts.append((gram[heads], n[heads], kinds[heads]))
        self.known = len(self.contexts[0][0]) > 0  # whether the class has an example at all

    def log_likelihood(self, codes, offsets):
        """Sum of log probabilities of each url."""
        import numpy as np

        p = np.full(len(codes), 1.0 / SYMBOLS)
        for width in range(1, self.order + 2):
            gram, (heads, total, kinds), (own, n) = grams(codes, offsets, width), self.contexts[width - 1], self.grams[width - 1]
            if not len(heads):
                break
            head = gram // SYMBOLS
            at = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
            known = (heads[at] == head) & (gram >= 0)
            to = np.minimum(np.searchsorted(own, gram), max(len(own) - 1, 0))
            count = np.where(own[to] == gram, n[to], 0) if len(own) else 0
            p = np.where(known, (count + kinds[at] * p) / (total[at] + kinds[at]), p)
        out, full = np.zeros(len(offsets) - 1), np.diff(offsets) > 0
        if full.any():
            out[full] = np.add.reduceat(np.log(p), offsets[:-1][full])  # each url by itself, whatever its chunk
        return out


def chunked(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with a chunk number; a chunk holds about ``most`` bytes of urls, a short url counting 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column("url")), 0), dtype=np.int64) + 64
            upto = before + np.cumsum(size)
            chunk = (part << 40) + (upto - size) // most
            before = int(upto[-1]) if len(upto) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk, pa.int64())], names=[*batch.schema.names, "chunk"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, chunk long")


def counted(rows: DataFrame, order: int) -> DataFrame:
    """slot, gram, COUNTS and their kinds: all n-grams (slot 2 * width) and contexts (the next slot) of the examples in ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in (part for whole in batches for part in slices(whole, "url", 1 << 20)):
            kind = 2 * np.asarray(pc.equal(batch.column("given"), "block"), dtype=np.int64) + np.asarray(batch.column("fold"), dtype=np.int64)
            for k in range(4):
                codes, offsets = symbols(batch.column("url").filter(pa.array(kind == k)))
                for width in range(1, order + 2):
                    g = grams(codes, offsets, width) if len(codes) else np.empty(0, np.int64)
                    kinds, n = np.unique(g[g >= 0], return_counts=True)
                    made = [pa.array([k] * len(kinds), pa.int32()), pa.array([width] * len(kinds), pa.int32()), pa.array(kinds, pa.int64()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(made, names=["kind", "width", "gram", "n"])

    found = rows.where("given is not null").select("given", "fold", "url").mapInArrow(run, "kind int, width int, gram long, n long")
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    counts = found.groupBy("width", "gram").agg(*[of(*kinds).alias(c) for c, kinds in zip(COUNTS, ((0,), (2,), (0, 1), (2, 3)))])
    counts = staged(counts, "url_counts")
    own = counts.select((2 * F.col("width")).alias("slot"), "gram", *COUNTS, *[F.lit(0).cast("long").alias(f"{c}_kinds") for c in COUNTS])
    head = F.floor(F.col("gram") / SYMBOLS).cast("long")  # exact: grams are far below 2 ** 53
    heads = counts.groupBy((2 * F.col("width") + 1).alias("slot"), head.alias("gram"))
    return own.unionByName(heads.agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds") for c in COUNTS]))


def sought(rows: DataFrame, order: int) -> DataFrame:
    """chunk, slot and gram: the distinct n-grams and contexts of each chunk (again for each batch that a chunk spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in (part for whole in batches for part in slices(whole, "url", 1 << 20)):
            chunk = batch.column("chunk").to_numpy()
            cuts = np.flatnonzero(np.diff(chunk)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(chunk)]):
                codes, offsets = symbols(batch.column("url").slice(int(a), int(b - a)))
                for width in range(1, order + 2) if len(codes) else ():
                    g = grams(codes, offsets, width)
                    own = np.unique(g[g >= 0])
                    heads = np.unique(own // SYMBOLS)
                    slot = np.repeat((2 * width, 2 * width + 1), (len(own), len(heads)))
                    made = [pa.array(np.full(len(slot), chunk[a]), pa.int64()), pa.array(slot, pa.int32()), pa.array(np.concatenate((own, heads)), pa.int64())]
                    yield pa.RecordBatch.from_arrays(made, names=["chunk", "slot", "gram"])

    return rows.select("chunk", "url").mapInArrow(run, "chunk long, slot int, gram long")


def scored(rows: DataFrame, order: int) -> DataFrame:
    """``rows`` with score, by all examples, and held, by those outside of the fold (null while a class has none)."""

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        import numpy as np

        codes, offsets = symbols(own.column("url"))
        size = np.diff(offsets)
        for name, which in (("score", "all"), ("held", "most")):
            allow, block = (Markov(found, f"{verdict}_{which}", order) for verdict in ("allow", "block"))
            if len(codes) and allow.known and block.known:
                diff = allow.log_likelihood(codes, offsets) - block.log_likelihood(codes, offsets)
                value = pa.array(np.where(size > 0, diff / np.maximum(size, 1), 0.0))
            else:
                value = pa.array([0.0 if name == "score" else None] * len(size), pa.float64())
            own = own.append_column(name, value)
        return own.drop_columns(["url", "chunk"])

    # both sides shuffled: by the few bytes of a compressed side Spark sends it whole through the driver, where its rows take many times that
    found = sought(rows, order).join(counted(rows, order).hint("merge"), ["slot", "gram"]).groupBy("chunk")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c not in ("url", "chunk"))
    return rows.groupBy("chunk").cogroup(found).applyInArrow(run, f"{schema}, score double, held double")


def url_filter(pages: DataFrame, rules=RULES, order: int = 5, chunk_bytes: int = 256 << 10) -> DataFrame:
    """page_id, host, path, rule, verdict, score and the calibrated cut for every row of ``pages``."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("given", verdict).withColumn("fold", F.coalesce(F.crc32("url") % 5 == 0, F.lit(False)))
    judged = staged(scored(staged(chunked(rows, chunk_bytes), "url_rows"), order), "url_scores")
    step = -2 * LEAST / GRID
    cell = F.least(F.greatest(F.floor((F.col("held") - LEAST) / step), F.lit(0)), F.lit(GRID - 1)).cast("int")
    held = judged.where("given is not null and fold and held is not null").groupBy(F.col("given").alias("verdict"), cell.alias("cell")).count().collect()  # 2 * GRID rows at most
    tally = {v: [0] * GRID for v in ("allow", "block")}
    for r in held:
        tally[r.verdict][r.cell] += r["count"]
    cut = 0.0
    if all(map(sum, tally.values())):
        # urls in cells below the cut are blocked; the share of both classes judged rightly is greatest, nearest to 0 on ties
        good, lost, best = sum(tally["allow"]), 0, None
        for k in range(GRID + 1):
            rightly = (good - sum(tally["allow"][:k])) / good + lost / sum(tally["block"])
            rank = (round(rightly, 12), -abs(LEAST + k * step))
            if best is None or rank > best[0]:
                best = (rank, LEAST + k * step)
            lost += tally["block"][k] if k < GRID else 0
        cut = best[1]
    judged = judged.withColumn("cut", F.lit(cut))
    own = F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "score", "cut")
