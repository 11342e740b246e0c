"""Filters and selections of whole listings: entity filters, samples, eligibility, targets, taxonomy and matches.

A sample is an order by a seeded hash of the key, so it is the same on every run and every cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import band, trigram_similarity, unique_bucket
from ..plans.star import Corpus

NO_DATA = "Not enough data"


@dataclass(frozen=True)
class EntityFilter:
    """Filters of a listing of books or authors, applied to its columns after aggregation."""

    bucket: str | None = None  # of unique_word_count; books without one count as 0
    overall: str | None = None  # a band of overall_difficulty, or NO_DATA
    fame: tuple[int | None, int | None] = (None, None)
    unfamed: bool = False
    letter: str = ""

    def apply(self, listing: DataFrame, name: str = "title", width: int = 20) -> DataFrame:
        out = listing
        if self.bucket is not None:
            out = out.where(unique_bucket(F.coalesce("unique_word_count", F.lit(0))) == self.bucket)
        if self.overall == NO_DATA:
            out = out.where("overall_difficulty is null")
        elif self.overall is not None:
            out = out.where(band(F.col("overall_difficulty"), width) == int(self.overall.split("-")[0]) // width)
        low, high = self.fame
        if low is not None:
            out = out.where(F.col("fame_score") >= low)
        if high is not None:
            out = out.where(F.col("fame_score") <= high)
        if self.unfamed:
            out = out.where("fame_score is null")
        if self.letter:
            out = out.where(F.lower(F.left(name, F.lit(1))) == self.letter.lower())
        return out


def by_relevance(rows: DataFrame, text: str, asked: str, least: float = 0.1) -> DataFrame:
    """``rows`` with their trigram ``similarity`` to ``asked``, those above ``least``: while one searches, relevance is the order."""
    return rows.withColumn("similarity", F.round(trigram_similarity(F.col(text), F.lit(asked)), 6)).where(F.col("similarity") > least)


def hashed(key: Column, seed: int) -> Column:
    """A hash of ``key`` for orders that look random and repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(rows: DataFrame, key: str, n: int, seed: int = 1, first: Column | None = None) -> DataFrame:
    """``n`` rows in the order of a seeded hash; rows for which ``first`` holds come before the others."""
    order = [hashed(F.col(key), seed), F.col(key)]
    return rows.orderBy(*([F.coalesce(first, F.lit(False)).desc()] if first is not None else []), *order).limit(n)


def due(rows: DataFrame, checked: str, now: Column, days: int, missing: Column) -> DataFrame:
    """Rows that lack something and were never checked, or last at least ``days`` before ``now``."""
    return rows.where(missing & (F.col(checked).isNull() | (F.col(checked) < now - F.make_dt_interval(F.lit(days)))))


def quiz_targets(c: Corpus, personal: DataFrame, authors: tuple[str, ...], books: tuple[int, ...], genres: tuple[str, ...], low: float, high: float) -> DataFrame:
    """(id, difficulty) of quizzable words in any of the authors' or the named books and in all ``genres``.

    The difficulty is the user's own (personal: word_id, personal_difficulty) where there is one.
    """
    key = F.col("word_id").alias("id")
    pool = c.links.join(c.books.select(F.col("id").alias("book_id"), "author"), "book_id").where(F.col("author").isin(*authors) | F.col("book_id").isin(*books))
    out = c.words.where("quizzable").join(pool.select(key).distinct(), "id", "left_semi")
    for g in genres:
        out = out.join(c.links.join(c.genres.where(F.col("genre") == g), "book_id").select(key).distinct(), "id", "left_semi")
    own = personal.select(F.col("word_id").alias("id"), "personal_difficulty")
    out = out.join(own, "id", "left").select("id", F.coalesce("personal_difficulty", "difficulty").alias("difficulty"))
    return out.where(F.col("difficulty").between(low, high))


def taxonomy(codes: DataFrame) -> DataFrame:
    """(code, parent, level) of the distinct codes and their fields; the parent is the nearest ancestor that is a code itself."""
    nodes = codes.select("code").unionByName(codes.select(F.left("code", F.lit(1)).alias("code"))).distinct()
    pieces = F.split("code", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "."))
    ranked = nodes.select("code", F.explode_outer(F.filter(F.concat(F.array(F.left("code", F.lit(1))), above), lambda a: a != F.col("code"))).alias("up"))
    known = nodes.select(F.col("code").alias("k"))
    found = ranked.join(known, F.col("up") == F.col("k"), "left").groupBy("code").agg(F.max_by("k", F.length("k")).alias("parent"))
    level = F.when(F.length("code") == 1, 0).otherwise(F.size(F.split("code", r"\.")))
    return found.select("code", "parent", level.cast("int").alias("level"))


def repaired(codes: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """(id, code, rank) of each id's proposed codes (id, position, code), each cut back to its nearest known ancestor.

    Codes without any are dropped, repeats after the first as well, and the first ``most`` stay.
    """
    pieces = F.split("code", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "."))
    tried = codes.select("id", "position", F.explode(F.array_distinct(F.concat(above, F.array(F.left("code", F.lit(1)))))).alias("code"))
    best = tried.join(known.select("code").distinct(), "code", "left_semi").groupBy("id", "position").agg(F.max_by("code", F.length("code")).alias("code"))
    once = best.groupBy("id", "code").agg(F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("position"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "code", "rank")


def ranked_categories(codes: DataFrame) -> DataFrame:
    """(id, code, confidence, is_primary) of (id, codes) in falling order of trust."""
    rows = codes.select("id", F.posexplode("codes").alias("rank", "code"))
    return rows.select("id", "code", F.round(F.greatest(F.lit(0.4), 1 - 0.25 * F.col("rank")), 2).alias("confidence"), (F.col("rank") == 0).alias("is_primary"))


def matched(entries: DataFrame, words: DataFrame, rejected: DataFrame) -> DataFrame:
    """(lemma, match): accepted or pruned by ``words`` (lemma, active), else rejected, else unique."""
    w = words.groupBy(F.lower("lemma").alias("lemma")).agg(F.bool_or("active").alias("active"))
    r = rejected.select(F.lower("lemma").alias("lemma")).distinct().withColumn("out", F.lit(True))
    out = entries.select(F.lower("lemma").alias("lemma")).distinct().join(w, "lemma", "left").join(r, "lemma", "left")
    return out.select("lemma", F.when(F.col("active"), "accepted").when(~F.col("active"), "pruned").when(F.col("out"), "rejected").otherwise("unique").alias("match"))


def flagged(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, archaic, obsolete): whether any entry of the word's lower-case form in ``dictionary`` (term, archaic, obsolete) says so."""
    d = dictionary.groupBy(F.lower("term").alias("t")).agg(F.bool_or("archaic").alias("archaic"), F.bool_or("obsolete").alias("obsolete"))
    return words.select("id", "lemma").join(d, F.lower("lemma") == F.col("t"), "left").select("id", F.coalesce("archaic", F.lit(False)).alias("archaic"), F.coalesce("obsolete", F.lit(False)).alias("obsolete"))


def ordered_verdicts(rows: DataFrame) -> DataFrame:
    """(doc_id, lemma, verdict, position): kept words by rising zipf, rejected ones by reason, each list in order of its words."""
    order = [F.when(F.col("verdict") == "keep", F.col("zipf")).asc_nulls_last(), F.col("reason").asc_nulls_last(), F.col("lemma")]
    return rows.select("doc_id", "lemma", "verdict", F.row_number().over(Window.partitionBy("doc_id", "verdict").orderBy(*order)).alias("position"))


def rejected_listing(rejected: DataFrame, docs: DataFrame | None = None, reasons: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """One row a rejected lemma, of those met in ``docs`` (doc_id), with one of ``reasons`` and a prefix."""
    rows = rejected.groupBy("lemma").agg(F.countDistinct("doc_id").alias("book_count"), F.sum("n_tokens").alias("total_count"), F.sort_array(F.collect_set("reason")).alias("reasons"))
    if docs is not None:
        rows = rows.join(rejected.join(docs, "doc_id", "left_semi").select("lemma").distinct(), "lemma", "left_semi")
    if reasons:
        rows = rows.where(F.arrays_overlap("reasons", F.array(*map(F.lit, reasons))))
    return rows.where(F.col("lemma").startswith(prefix.lower())).withColumn("reasons", F.array_join("reasons", "|"))


def tops(c: Corpus) -> DataFrame:
    """One row: the hardest word and the most acclaimed book, the smaller id on ties."""
    w = c.words.where("difficulty is not null").agg(F.max_by("id", F.struct("difficulty", -F.col("id"))).alias("hardest_word"))
    b = c.books.join(c.fame, F.col("id") == F.col("book_id")).agg(F.max_by("id", F.struct("fame_score", -F.col("id"))).alias("most_acclaimed"))
    return w.join(F.broadcast(b))


def facet_values(c: Corpus) -> DataFrame:
    """(facet, value, n) of what the listings can be filtered by."""
    of = lambda df, col, name: df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n")
    return of(c.words, "part_of_speech", "pos").unionByName(of(c.genres, "genre", "genre")).unionByName(of(c.words, "archaic", "archaic"))


def job_statistics(words: DataFrame) -> DataFrame:
    """(archaic, words, scored, mean, median) of a scoring run."""
    d = F.col("difficulty")
    return words.groupBy("archaic").agg(F.count("*").alias("words"), F.count(d).alias("scored"), F.round(F.sum(d.cast("decimal(18,4)")).cast("double") / F.count(d), 6).alias("mean"), F.round(F.median(d), 6).alias("median"))
