"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone (labels, language, source and ids are no inputs). Trees are fitted on
the driver to a sample of at most ``most_rows`` labelled rows (those with the smallest hashes of their
doc_id), so what is fitted and sent is bounded; every document is scored. A tree is a complete binary
tree in two flat arrays, feature and threshold, walked level by level for a whole batch at once.

Defined cases: a null text is scored as an empty one, whose statistics are zero; rows with null quality
or doc_id are no training rows; repeated label rows, and labelled rows of documents that repeat a doc_id,
count as often as they occur up to ``most_rows`` in all; with no training rows
every score is 1.0, so nothing is rejected; an empty table gives an empty result; other columns are
carried along by ``keep_good`` and never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import shingle_hashes, slices, split_words

FEATURES = (
    "log_words", "log_bytes", "word_length", "word_length_sd", "longest_word", "short_words", "upper", "digits", "punctuation",
    "symbols", "exclamations", "bars", "lines", "distinct_words", "distinct_triples", "distinct_lines", "top_word", "non_ascii", "entropy",
)


def statistics(text: pa.Array):
    """A float64 row of FEATURES for each text."""
    import numpy as np
    import pyarrow.compute as pc

    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    size = np.asarray(pc.binary_length(text), dtype=np.int64)
    raw = np.frombuffer(b"".join(x for x in text.cast(pa.large_binary()).to_pylist()), np.uint8)
    seen = np.bincount(np.repeat(np.arange(n), size) * 256 + raw, minlength=n * 256).reshape(n, 256).astype(float) if n else np.zeros((0, 256))
    of = lambda chars: seen[:, [ord(c) for c in chars]].sum(axis=1)
    flat, offsets = split_words(text)
    words = np.diff(offsets)
    doc = np.repeat(np.arange(n), words)
    length = np.asarray(pc.utf8_length(flat), dtype=float)
    per = lambda v: np.bincount(doc, weights=v, minlength=n)
    safe = np.maximum(words, 1)
    mean = per(length) / safe
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    distinct, top = np.zeros(n), np.zeros(n)
    if len(flat):
        coded = flat.dictionary_encode()
        pairs, times = np.unique(doc * np.int64(len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        owner = pairs // len(coded.dictionary)
        distinct = np.bincount(owner, minlength=n).astype(float)
        np.maximum.at(top, owner, times)
    lines = pc.split_pattern(text, "\n")
    n_lines = np.diff(np.asarray(lines.offsets, dtype=np.int64))
    kinds = lines.values.dictionary_encode()
    own = np.repeat(np.arange(n), n_lines) * np.int64(max(1, len(kinds.dictionary))) + kinds.indices.to_numpy(zero_copy_only=False)
    kept_lines = np.bincount(np.unique(own) // max(1, len(kinds.dictionary)), minlength=n)
    triples = np.array([len(h) for h in shingle_hashes(text, 3)], dtype=float)
    share = seen / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1)
    letters = [chr(c) for c in range(97, 123)]
    upper = of([c.upper() for c in letters])
    marks = of([chr(c) for c in range(33, 127) if not chr(c).isalnum()])
    columns = {
        "log_words": np.log1p(words), "log_bytes": np.log1p(size), "word_length": mean,
        "word_length_sd": np.sqrt(np.maximum(per(length * length) / safe - mean * mean, 0)), "longest_word": np.log1p(longest),
        "short_words": per(length <= 3) / safe, "upper": upper / np.maximum(upper + of(letters), 1), "digits": of("0123456789") / np.maximum(size, 1),
        "punctuation": marks / safe, "symbols": of("#*$%&|<>") / safe, "exclamations": of("!") / safe, "bars": of("|") / safe, "lines": n_lines / safe,
        "distinct_words": distinct / safe, "distinct_triples": triples / np.maximum(words - 2, 1), "distinct_lines": kept_lines / np.maximum(n_lines, 1),
        "top_word": top / safe, "non_ascii": seen[:, 128:].sum(axis=1) / np.maximum(size, 1), "entropy": entropy,
    }
    out = np.stack([columns[f] for f in FEATURES], axis=1) if n else np.zeros((0, len(FEATURES)))
    out[words == 0] = 0
    return out


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold`` have a row of 2**depth - 1 nodes for each tree, ``value`` one of 2**depth leaves."""

    base: float
    feature: object
    threshold: object
    value: object

    def score(self, x):
        import numpy as np

        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x, y, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 3.0) -> Trees:
    """Boosted trees for labels y (0 or 1); ``least`` is the smallest sum of second derivatives of a child."""
    import numpy as np

    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    if not n:
        return Trees(30.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            gain, where = np.full(many, 1e-6), np.full((many, 2), -1)
            for j in range(width):
                slot = local * bins + binned[:, j]
                gs = np.bincount(slot, g, many * bins).reshape(many, bins)
                hs = np.bincount(slot, h, many * bins).reshape(many, bins)
                gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                won = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                won[(hl < least) | (ht - hl < least)] = -1
                won = won[:, : len(edges[j])]
                if not won.size:
                    continue
                at = won.argmax(axis=1)
                best = won[np.arange(many), at]
                better = best > gain
                gain[better], where[better, 0], where[better, 1] = best[better], j, at[better]
            for k in np.flatnonzero(where[:, 0] >= 0):
                feature[first + k], threshold[first + k] = where[k, 0], edges[where[k, 0]][where[k, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return Trees(base, np.array(out_f), np.array(out_t), np.array(out_v))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, most_rows: int = 30_000) -> Trees:
    """Trees fitted to at most ``most_rows`` labelled rows outside the held-out fold."""
    import numpy as np

    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id", "y").limit(most_rows)  # bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("id"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                x = statistics(batch.column("text"))
                kept = [batch.column("id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(kept, names=["id", "y", "x"])

    got = rows.select("id", "y", "text").mapInArrow(run, "id long, y double, x array<double>")
    got = got.orderBy(F.xxhash64("id"), "id", "y", "x").limit(most_rows).toPandas()  # in an order that does not depend on the tasks
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["y"].to_numpy(dtype=float))


def scorer(trees: Trees):
    """A column function: text to score."""

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        import numpy as np

        one = pa.RecordBatch.from_arrays([text], names=["text"])
        found = [trees.score(statistics(part.column("text"))) for part in slices(one, "text", 1 << 20)]
        return pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())

    return score


def scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7, most_rows: int = 30_000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    score = scorer(trained(docs, labels, most_rows))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.7, most_rows: int = 30_000) -> DataFrame:
    """The rows of ``docs`` with a score of ``cut`` or more, with all their columns."""
    score = scorer(trained(docs, labels, most_rows))
    return docs.where(score(F.col("text").cast("string")) >= cut)
