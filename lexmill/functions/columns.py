"""Scalar column functions: ranks, bands, eras, scores, string and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.staging import bounded, settled

BUCKET_LABELS = ("0", "1", "2", "3-5", "6-10", "11-25", "26-50", "51-100", "101+")
BUCKET_TOPS = (0, 1, 2, 5, 10, 25, 50, 100)


def percent_ranks(df: DataFrame, columns: dict[str, str], pieces: int = 128) -> DataFrame:
    """``df`` with the percent_rank of each column under its new name, null where the column is.

    ``df`` is written once. Only the distinct values of a column and their counts are ranked: they are cut into ``pieces``
    ranges at approximate quantiles, sums run within a range and start at the number of smaller ranges' rows. So no
    task sorts the rows, and neither a value that most rows have nor their nulls meet in one task. Only the cuts and the ranges'
    counts, ``pieces`` numbers a column, reach the driver. The result is exact.
    """
    rows = settled(df)
    spots = [i / pieces for i in range(1, pieces)]
    for c, out in columns.items():
        values = settled(rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__value")).agg(F.count("*").alias("__n")))
        ends = sorted(set(values.agg(F.percentile_approx("__value", spots, 10 * pieces).alias("ends")).first().ends or []))
        piece = F.size(F.filter(F.lit(ends).cast("array<double>"), lambda x: x < F.col("__value")))  # noqa: B023
        values = values.withColumn("__piece", piece)
        n, before, upto = {r[0]: r[1] for r in values.groupBy("__piece").agg(F.sum("__n")).collect()}, [], 0
        for k in range(len(ends) + 1):
            before.append(upto)
            upto += n.get(k, 0)
        smaller = F.sum("__n").over(Window.partitionBy("__piece").orderBy("__value")) - F.col("__n")
        rank = (F.get(F.lit(before).cast("array<long>"), F.col("__piece")) + smaller) / max(upto - 1, 1)
        ranks = settled(values.select(F.col("__value"), rank.alias(out), F.lit(True).alias("__known")))
        # a null has no rank; it is dealt by the whole row, so that nulls do not meet in one task either
        key = F.coalesce(F.col(c).cast("double"), F.xxhash64(*rows.columns).cast("double"))
        rows = rows.withColumns({"__key": key, "__filled": F.col(c).isNotNull()}).join(bounded(ranks), (F.col("__key") == F.col("__value")) & (F.col("__filled") == F.col("__known")), "left").drop("__key", "__filled", "__value", "__known")
    return rows


def percent_rank(df: DataFrame, column: str, out: str, pieces: int = 128) -> DataFrame:
    return percent_ranks(df, {column: out}, pieces)


def unique_bucket(n: Column) -> Column:
    """Label of a unique-word count."""
    out = F.lit(BUCKET_LABELS[-1])
    for label, top in reversed(list(zip(BUCKET_LABELS, BUCKET_TOPS))):
        out = F.when(n <= top, label).otherwise(out)
    return out


def band(value: Column, width: int) -> Column:
    """Index of the difficulty band of ``width``; the last one is closed at 100."""
    return F.when(value.isNotNull(), F.least(F.floor(value / width), F.lit(-(-100 // width) - 1))).cast("int")


def subtree(code: Column, root: str) -> Column:
    """Whether ``code`` is ``root`` or below it; a single letter is a whole field, dots bound other levels."""
    return code.startswith(root) if len(root) == 1 else (code == root) | code.startswith(root + ".")


def sort_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"^(the|a|an)\s+", "")


def era(year: Column) -> Column:
    """early, mid or late Nth century."""
    position, century = (year - 1) % 100 + 1, (F.floor((year - 1) / 100) + 1).cast("int")
    suffix = F.when((century % 100).between(11, 13), "th").when(century % 10 == 1, "st").when(century % 10 == 2, "nd").when(century % 10 == 3, "rd").otherwise("th")
    part = F.when(position <= 33, "early").when(position <= 66, "mid").otherwise("late")
    return F.when(year.isNotNull(), F.concat(part, F.lit(" "), century.cast("string"), suffix, F.lit(" century")))


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def difficulty(zipf: Column, peak: Column, archaic: Column, confidence: Column, in_field: Column, transparent: Column) -> Column:
    """0 to 100: rarity on the web and in print, an archaic share, a field bonus, less for transparent words."""
    web = _clamp((4 - zipf) / 4)
    printed = F.when(F.coalesce(peak, F.lit(0.0)) <= 0, 1.0).otherwise(_clamp((-F.log10(peak) - 5) / 6))
    base = F.when(archaic == "obsolete", 0.25).when(archaic == "archaic", 0.18).when(archaic == "dated", 0.06).otherwise(0.0)
    total = 0.65 * web + 0.35 * printed + base * confidence + F.when(in_field, 0.06).otherwise(0.0) - F.when(transparent, 0.10).otherwise(0.0)
    return F.bround(100 * _clamp(total), 0)


def archaic_tier(definition: Column, dictionary: Column, peak: Column, ratio: Column) -> Column:
    """struct(tier, confidence) of the strongest signal, a little surer when two agree."""
    text = F.lower(F.coalesce(definition, F.lit("")))
    label = F.when(text.contains("obsolete"), F.struct(F.lit(3).alias("t"), F.lit(0.95).alias("c"))).when(text.contains("archaic"), F.struct(F.lit(2).alias("t"), F.lit(0.9).alias("c"))).when(text.contains("dated"), F.struct(F.lit(1).alias("t"), F.lit(0.85).alias("c")))
    flag = F.when(dictionary == "obsolete", F.struct(F.lit(3).alias("t"), F.lit(0.9).alias("c"))).when(dictionary == "archaic", F.struct(F.lit(2).alias("t"), F.lit(0.85).alias("c")))
    faded = F.when((peak >= 1e-6) & (ratio < 0.15), F.struct(F.lit(2).alias("t"), F.lit(0.5).alias("c")))
    signals = F.filter(F.array(label, flag, faded), lambda s: s.isNotNull())
    best = F.array_max(signals)
    same = F.size(F.filter(signals, lambda s: s["t"] == best["t"]))
    names = F.array(*map(F.lit, ("dated", "archaic", "obsolete")))
    sure = F.round(F.when(same > 1, F.least(best["c"] + 0.05, F.lit(0.98))).otherwise(best["c"]), 2)
    return F.struct(F.coalesce(F.get(names, best["t"] - 1), F.lit("current")).alias("tier"), F.coalesce(sure, F.lit(0.9)).alias("confidence"))


def trigrams(text: Column) -> Column:
    """Distinct three-character runs of the words, each padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    runs = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(runs)


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(F.size(F.array_union(x, y)) > 0, both / F.size(F.array_union(x, y))).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - _clamp(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), -1.0, 1.0)


def keep_filled(new: Column, old: Column) -> Column:
    """The new value unless it is blank."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def roman(text: Column) -> Column:
    """Value of a roman numeral."""
    digits = F.create_map(*[F.lit(x) for pair in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000)) for x in pair])
    values = F.transform(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), lambda c: digits[c])
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.aggregate(signed, F.lit(0), lambda s, v: s + v)
