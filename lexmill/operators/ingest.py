"""From texts to judged vocabulary: cleaning, candidates, rules, verdict cache, upserts, volume merging."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import keep_filled
from ..plans.staging import bounded, settled, shuffled


def clean_text(text: Column) -> Column:
    """NFKC, plain quotes and dashes, words rejoined over line-end hyphens, single spaces."""
    return _clean()(text)


def _clean():
    @F.arrow_udf(T.StringType())
    def clean(text: pa.Array) -> pa.Array:
        import re
        import unicodedata

        plain = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "­": None})

        def one(t: str) -> str:
            t = re.sub(r"(?<=[^\W\d_])-[ \t]*\n[ \t]*(?=[^\W\d_])", "", unicodedata.normalize("NFKC", t.translate(plain)))
            return re.sub(r"\s+", " ", t).strip()

        return pa.array([None if t is None else one(t) for t in text.to_pylist()], pa.string())

    return clean


def word_stats(docs: DataFrame, stop: tuple[str, ...]) -> DataFrame:
    """(doc_id, word_count, distinct_words): runs of ASCII letters, and distinct lower-case ones that are no stop word."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    lower = F.array_distinct(F.transform(words, F.lower))
    return docs.select("doc_id", F.size(words).cast("long").alias("word_count"), F.size(F.array_except(lower, F.array(*map(F.lit, stop)))).cast("long").alias("distinct_words"))


def occurrences(docs: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, position, surface, lemma): every run of at least ``least`` ASCII letters, in reading order."""
    found = F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)))
    return docs.select("doc_id", found.alias("position", "surface")).where(F.length("surface") >= least).withColumn("lemma", F.lower("surface"))


def candidates(docs: DataFrame, least: int = 3, surfaces: bool = False) -> DataFrame:
    """(doc_id, lemma, n_tokens, count_capped, capitalised, first_at): one row a document and word.

    ALL-CAPS words do not count for the share of capitals; count_capped stops at 12. With ``surfaces`` also ``surface``, the
    first one where it is not the lemma itself.
    """
    s = F.col("surface")
    caps = F.length(s) > 1
    shouted = caps & (s == F.upper(s))
    first = F.substring(s, 1, 1)
    upper = first != F.lower(first)
    n = F.count("*")
    judged = F.count(F.when(~shouted, 1))
    ratio = F.when(judged > 0, F.count(F.when(~shouted & upper, 1)) / judged).otherwise(0.0)
    shown = [F.nullif(F.min_by("surface", "position"), F.col("lemma")).alias("surface")] * surfaces
    return occurrences(docs, least).groupBy("doc_id", "lemma").agg(n.alias("n_tokens"), F.least(n, F.lit(12)).alias("count_capped"), F.round(ratio, 6).alias("capitalised"), F.min("position").cast("long").alias("first_at"), *shown)


def zipf(tokens: DataFrame) -> DataFrame:
    """(lemma, n, zipf): log10 of occurrences in a thousand million tokens of the corpus itself."""
    n = tokens.groupBy("lemma").agg(F.sum("n_tokens").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("lemma", "n", F.round(F.log10(F.col("n") / F.col("total") * 1e9), 4).alias("zipf"))


def verdicts(found: DataFrame, scale: DataFrame, floor: float = 3.5, capitals: float = 0.85) -> DataFrame:
    """(doc_id, lemma, verdict, reason): frequency floor, then the proper-noun rule, else keep."""
    rows = found.join(scale.select("lemma", "zipf"), "lemma")
    reason = F.when(F.col("zipf") >= floor, "too_frequent").when(F.col("capitalised") >= capitals, "proper_noun")
    return rows.select("doc_id", "lemma", F.when(reason.isNull(), "keep").otherwise("drop").alias("verdict"), reason.alias("reason"), "n_tokens", "zipf")


def rejected_index(rejected: DataFrame) -> DataFrame:
    """One row a lemma: how many documents, how often, the smallest zipf, and the reasons."""
    return rejected.groupBy("lemma").agg(
        F.countDistinct("doc_id").alias("book_count"), F.sum("n_tokens").alias("total_count"), F.min("zipf").alias("zipf"), F.array_join(F.sort_array(F.collect_set("reason")), "|").alias("reasons"),
    )


def known_verdicts(rejected: DataFrame, kept: DataFrame) -> DataFrame:
    """(lemma, verdict): what is known of a lemma; a kept word outweighs rejections, reasons in alphabetical order."""
    rows = rejected.select("lemma", F.lit(1).alias("rank"), F.col("reason").alias("verdict")).unionByName(kept.select("lemma", F.lit(0).alias("rank"), F.lit("keep").alias("verdict")))
    return rows.groupBy("lemma").agg(F.min(F.struct("rank", "verdict")).alias("v")).select("lemma", "v.verdict")


def english_fraction(docs: DataFrame, scale: DataFrame, least: float = 3.0) -> DataFrame:
    """(doc_id, fraction): the share of a document's words with a zipf of at least ``least``."""
    words = candidates(docs, 2).join(scale.select("lemma", "zipf"), "lemma")
    hit = F.sum(F.when(F.col("zipf") >= least, F.col("n_tokens")).otherwise(0))
    return words.groupBy("doc_id").agg(F.round(hit / F.sum("n_tokens"), 6).alias("fraction"))


def osa(a: Column, b: Column) -> Column:
    """Edit distance in which swapping neighbours counts one."""
    return _osa()(a, b)


def _osa():
    @F.arrow_udf(T.IntegerType())
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        def one(x: str, y: str) -> int:
            older, old = [], list(range(len(y) + 1))
            for i, p in enumerate(x, 1):
                new = [i]
                for j, q in enumerate(y, 1):
                    cost = min(old[j] + 1, new[-1] + 1, old[j - 1] + (p != q))
                    if i > 1 and j > 1 and p == y[j - 2] and x[i - 2] == q:
                        cost = min(cost, older[j - 2] + 1)
                    new.append(cost)
                older, old = old, new
            return old[-1]

        return pa.array([None if x is None or y is None else one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return distance


def neighbours(words: DataFrame, transpositions: bool = False, gap: float = 2.0, edits: int = 1) -> DataFrame:
    """(lemma, neighbour, gap): the commonest word at most ``edits`` away that is at least ``gap`` zipf more frequent.

    Both sides are blocked by what is left after up to ``edits`` deletions: words within that distance, a
    swap of neighbours counting as one edit or as two, share such a key. Then they are verified.
    """
    text = F.col("lemma")
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    keys = F.array(text)
    for _ in range(edits):
        keys = F.array_distinct(F.concat(keys, F.flatten(F.transform(keys, without))))
    keyed = words.where(F.length(text) >= 4).select("lemma", "zipf", F.explode(keys).alias("key"))
    x, y = keyed.alias("x"), keyed.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("y.zipf") >= F.col("x.zipf") + gap))
    pairs = pairs.select(F.col("x.lemma").alias("lemma"), F.col("x.zipf").alias("z"), F.col("y.lemma").alias("neighbour"), F.col("y.zipf").alias("nz")).distinct()
    near = osa(F.col("lemma"), F.col("neighbour")) if transpositions else F.levenshtein("lemma", "neighbour")
    pairs = pairs.where(near <= edits)
    nth = F.row_number().over(Window.partitionBy("lemma").orderBy(F.desc("nz"), "neighbour"))
    return pairs.withColumn("nth", nth).where("nth = 1").select("lemma", "neighbour", F.round(F.col("nz") - F.col("z"), 4).alias("gap"))


def upsert(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """``old`` and ``new`` merged on ``key``; a column's rule is ``fill`` (never blank a filled value), ``replace``, ``first``, ``least`` or ``sticky``."""
    n = new.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in rules], F.lit(True).alias("__new"))
    out = old.withColumn("__old", F.lit(True)).join(n, key, "full_outer")
    make = {
        "fill": lambda o, v: keep_filled(v, o), "replace": lambda o, v: F.when(F.col("__new"), v).otherwise(o), "first": lambda o, v: F.when(F.col("__old"), o).otherwise(v),
        "least": lambda o, v: F.least(o, v), "sticky": lambda o, v: F.coalesce(o, F.lit(False)) | F.coalesce(v, F.lit(False)),
    }
    return out.select(key, *[make[rule](F.col(c), F.col(f"__{c}")).alias(c) for c, rule in rules.items()])


def part_gaps(parts: DataFrame) -> DataFrame:
    """(title_base, parts, low, high, missing, skip_reason) of volumes numbered by ``first`` to ``last`` (null: one)."""
    n = parts.select("title_base", F.explode(F.sequence("first", F.coalesce("last", "first"))).alias("n"))
    found = n.groupBy("title_base", "n").agg(F.count("*").alias("times"))
    out = found.groupBy("title_base").agg(F.sum("times").alias("parts"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("times").alias("most"), F.count("*").alias("present"))
    missing = F.col("high") - F.least(F.col("low"), F.lit(1)) + 1 - F.col("present")
    reason = F.when(F.col("parts") == 1, "lone_match").when(F.col("most") > 1, "duplicate_number").when(missing > 0, "gap")
    return out.select("title_base", "parts", "low", "high", missing.alias("missing"), reason.alias("skip_reason"))


def repoint(links: DataFrame, survivor: int, others: tuple[int, ...]) -> DataFrame:
    """Links of merged books moved to the survivor, once each; running it again changes nothing."""
    book = F.when(F.col("book_id").isin(*others), F.lit(survivor).cast("long")).otherwise(F.col("book_id"))
    return links.withColumn("book_id", book).distinct()


def out_of_order(entries: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, order) of entries outside a longest non-decreasing subsequence of ``value`` in each group.

    The choice depends on the whole order of a group (a volume, bounded by its pages), so a group becomes
    one array; groups pass to Python many at a time. Entries with a null value are left out.
    """
    @F.pandas_udf("array<int>")
    def outside(values: pd.Series) -> pd.Series:
        import bisect

        def of(xs) -> list[int]:
            tops, ends, back = [], [], []  # the least last value of a run of each length, where it stands, and what came before each
            for i, v in enumerate(xs):
                k = bisect.bisect_right(tops, v)
                back.append(ends[k - 1] if k else -1)
                tops[k : k + 1], ends[k : k + 1] = [v], [i]
            kept, i = set(), ends[-1] if ends else -1
            while i >= 0:
                kept.add(i)
                i = back[i]
            return [i for i in range(len(xs)) if i not in kept]

        return values.map(of)

    pairs = entries.where(F.col(value).isNotNull()).select(F.col(group), F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("e"))
    held = pairs.groupBy(group).agg(F.sort_array(F.collect_list("e")).alias("e"))
    found = held.select(group, "e", F.explode(outside(F.col("e.v"))).alias("i"))
    return found.select(group, F.get("e", F.col("i"))["o"].alias(order))


def mentions(found: DataFrame, words: DataFrame) -> DataFrame:
    """(source, target, surface): words of ``words`` (id, lemma) met in a document of another id, by the rows of ``candidates`` with surfaces.

    A text's occurrences are one row a word before the join, so a word that every text holds is as many
    rows as there are texts and no more.
    """
    rows = found.select(F.col("doc_id").alias("source"), "lemma", "surface")
    out = rows.join(shuffled(words.select(F.col("id").alias("target"), F.lower("lemma").alias("lemma"))), "lemma").where(F.col("source") != F.col("target"))
    return out.select("source", "target", F.coalesce("surface", "lemma").alias("surface"))


def first_mentions(docs: DataFrame, floor: float = 3.5, capitals: float = 0.85) -> DataFrame:
    """``mentions`` of every word that ``verdicts`` keeps, its id being the first document that keeps it.

    Texts are shuffled once, by document, so that their words are counted where they lie; the words found are written
    once. Words at the floor or above are few, 10 ** (9 - floor) at most, and go before the words are shuffled.
    """
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small ones: the words of a text take many times its bytes
    found = settled(candidates(docs.select("doc_id", "text").repartition(tasks, "doc_id"), surfaces=True).select("doc_id", "lemma", "n_tokens", "capitalised", "surface"))
    frequent = settled(zipf(found).where(F.col("zipf") >= floor).select("lemma"))
    rest = found.join(bounded(frequent), "lemma", "left_anti")
    return mentions(rest, rest.where(F.col("capitalised") < capitals).groupBy("lemma").agg(F.min("doc_id").alias("id")))


def resolved(lemmas: DataFrame, tiers: list[tuple[str, DataFrame]], most_tier: int | None = None) -> DataFrame:
    """(lemma, value, tier): the first tier (name, table of lemma and value) that has a filled value."""
    out = lemmas.select("lemma").distinct()
    names = tiers[: most_tier or len(tiers)]
    for i, (_, t) in enumerate(names):
        t = t.where("value is not null and value <> ''").groupBy("lemma").agg(F.min("value").alias(f"v{i}"))
        out = out.join(t, "lemma", "left")
    tier = F.coalesce(*[F.when(F.col(f"v{i}").isNotNull(), F.lit(n)) for i, (n, _) in enumerate(names)])
    return out.select("lemma", F.coalesce(*[F.col(f"v{i}") for i in range(len(names))]).alias("value"), tier.alias("tier"))
