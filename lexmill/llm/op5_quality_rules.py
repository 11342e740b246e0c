"""Quality rules with thresholds read from the data, in DataFrame functions only.

Every document gets the fixed base statistics. Documents that pass the base rules feed one quantile
sketch per (language, source) and statistic. A sketch is a table of counts over integer buckets with
seven significant bits (relative error below 1/64), so sketches merge by adding counts, in any order,
with the same result. A group with fewer than ``min_docs`` documents uses the merged sketch of its
language, and a small language that of the corpus. The fence of a statistic lies ``reach``
inter-quartile ranges beyond the quartile, plus a fixed slack; documents beyond a fence are rejected.

Defined cases: a null or blank text has no words and fails the base rules; null languages and sources
are groups of their own; repeated rows are judged alike; an empty table gives an empty result; columns
other than the ones read are carried along by ``keep_good`` and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import GAP, bounded_broadcast, staged

#: statistic -> (per-mille slack added to the fences, whether there is a lower fence too)
SLACK = {"word_length": (1000, True), "symbols": (100, False), "dup_lines": (300, False), "repeats": (200, False)}
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""
    windows = F.when(F.size(words) >= 3, F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )).otherwise(F.array().cast("array<bigint>"))
    equal = lambda ordered, x, i: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
    again = lambda ordered: F.sort_array(F.transform(F.filter(ordered, lambda x, i: equal(ordered, x, i - 1) | equal(ordered, x, i + 1)), lambda x: x["i"]))
    covered = lambda at: F.aggregate(F.transform(at, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - v, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    ordered = lambda w: F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _let(ordered(w), lambda o: _let(again(o), covered))).otherwise(F.lit(0)))


def with_stats(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with the base statistics as long columns, named with ``prefix``, and base_failed.

    A three-word window counts as repeated when its hash (64 bits over the three words) occurs twice in
    the text; hashes are sorted within the row, so a text of n words costs n log n and no shuffle. The
    statistics of a row are generated as one struct: filters on them stay above, and nothing is evaluated
    again for each place that names it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def stats(words: Column, kept: Column) -> Column:
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", "")),
            "n_lines": F.size(kept),
            "n_dup_lines": F.size(kept) - F.size(F.array_distinct(kept)),
            "n_repeat_words": _repeated(words),
        }
        return F.struct(*[v.cast("long").alias(prefix + k) for k, v in values.items()])

    both = _let(F.array_remove(F.split(text, GAP), ""), lambda words: _let(lines, lambda kept: stats(words, kept)))
    out = docs.select("*", F.inline(F.array(both)))
    n, rep = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return out.withColumn(f"{prefix}base_failed", (n < 50) | (100 * rep > 50 * n))


def _ratios(prefix: str = "") -> dict[str, Column]:
    """Per-mille statistics that are fenced, as whole numbers."""
    c = lambda name: F.col(prefix + name)
    per = lambda a, b: F.floor(1000 * c(a) / F.greatest(c(b), F.lit(1))).cast("long")
    return {"word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}


def sketches(stats: DataFrame, prefix: str = "") -> DataFrame:
    """(lang, source, stat, bucket, n): the quantile sketches of documents that pass the base rules."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), v.alias("v")) for k, v in _ratios(prefix).items()]))
    rows = stats.where(~F.col(f"{prefix}base_failed")).select("lang", "source", values.alias("x")).select("lang", "source", "x.stat", "x.v")
    bucket = F.expr("v - v % shiftleft(1L, greatest(length(bin(v)) - 7, 0))")
    return rows.withColumn("bucket", bucket).groupBy("lang", "source", "stat", "bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketch.groupBy(*keys, "stat", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "stat")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("bucket")))
    return ranked.groupBy(*keys, "stat").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("all").alias("n"))


def fences(sketch: DataFrame, min_docs: int = 100, reach: int = 3) -> DataFrame:
    """One row per (lang, source) with a lower and upper fence for each statistic, from the merged sketches."""
    levels = [["lang", "source"], ["lang"], []]
    rows = None
    groups = sketch.select("lang", "source").distinct()
    for k, keys in enumerate(levels):
        q = _quartiles(sketch, keys).select(*[F.col(x).alias(f"k_{x}") for x in keys], "stat", "q1", "q3", "n")
        on = F.lit(True)
        for x in keys:
            on = on & groups[x].eqNullSafe(F.col(f"k_{x}"))
        part = (groups.join(q, on) if keys else groups.join(F.broadcast(q))).select("lang", "source", "stat", F.lit(k).alias("level"), "q1", "q3", "n")
        rows = part if rows is None else rows.unionByName(part)
    good = rows.where((F.col("n") >= min_docs) | (F.col("level") == 2))
    best = good.groupBy("lang", "source", "stat").agg(F.min_by(F.struct("q1", "q3"), "level").alias("q"))
    out = []
    for name, (slack, low) in SLACK.items():
        q = F.max(F.when(F.col("stat") == name, F.col("q")))
        out.append((q["q3"] + reach * (q["q3"] - q["q1"]) + slack).alias(f"{name}_high"))
        if low:
            out.append((q["q1"] - reach * (q["q3"] - q["q1"]) - slack).alias(f"{name}_low"))
    return best.groupBy("lang", "source").agg(*out)


def judged(stats: DataFrame, limits: DataFrame, prefix: str = "") -> DataFrame:
    """``stats`` with kept: inside every fence of its language and source, and not failed by the base rules."""
    names = [c for c in limits.columns if c not in ("lang", "source")]
    lim = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in names])
    ok = F.lit(True)
    for name, v in _ratios(prefix).items():
        ok = ok & F.coalesce(v <= F.col(f"__{name}_high"), F.lit(True))
        if SLACK[name][1]:
            ok = ok & F.coalesce(v >= F.col(f"__{name}_low"), F.lit(True))
    on = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    joined = stats.join(lim, on, "left")
    return joined.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & ok).drop("__lang", "__source", *[f"__{c}" for c in names])


def quality_rules(docs: DataFrame, min_docs: int = 100, reach: int = 3) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed and kept for every row of ``docs``."""
    stats = staged(with_stats(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality_stats")
    limits = fences(sketches(stats), min_docs, reach)
    return judged(stats, limits)


def keep_good(docs: DataFrame, min_docs: int = 100, reach: int = 3, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; the text is never shuffled.

    Rows are written once with their statistics, which the sketches and then the verdict read. The fences
    are broadcast when they take at most ``broadcast_bytes``, else joined by shuffle.
    """
    rows = staged(with_stats(docs, "__q_"), "quality_rows")
    limits = bounded_broadcast(staged(fences(sketches(rows, "__q_"), min_docs, reach), "quality_fences"), broadcast_bytes)
    return judged(rows, limits, "__q_").where("__q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
