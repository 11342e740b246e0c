"""Faceted listings and histograms over a Corpus: words, books, authors, bands, growth, overlap, lift.

Filtering goes through a junction by semi-join, aggregation by join and distinct count. Every sort names
its null order and ends in a unique key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import BUCKET_LABELS, band, percent_ranks, sort_title, subtree, unique_bucket
from ..plans.star import BUCKETS, LETTERS, Corpus


@dataclass(frozen=True)
class WordFilter:
    """Facets of the word listing; lists are OR-ed unless named ``all_``."""

    books: tuple[int, ...] = ()
    shelf: DataFrame | None = None  # (id) of books, where they are too many to name
    author: str | None = None
    exclusive: bool = False
    buckets: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    all_codes: tuple[str, ...] = ()
    all_buckets: tuple[str, ...] = ()
    all_genres: tuple[str, ...] = ()
    archaic: tuple[str, ...] = ()
    difficulty: tuple[float | None, float | None] = (None, None)
    part_of_speech: tuple[str, ...] = ()
    quizzable: bool = False
    uncategorised: bool = False
    unscored: bool = False
    prefix: str = ""
    like: str = ""
    contains: str = ""
    strict: bool = field(default=False)

    def apply(self, c: Corpus) -> DataFrame:
        words, key = c.words, F.col("word_id")
        letters = lambda name: list(BUCKETS.get(name, ""))

        def within(rows: DataFrame, how: str = "left_semi") -> None:
            nonlocal words
            words = words.join(rows.select(key.alias("id")).distinct(), "id", how)

        by_author = c.links.join(c.books.select(F.col("id").alias("book_id"), "author"), "book_id")
        if self.books:
            within(c.links.where(F.col("book_id").isin(*self.books)))
            if self.exclusive:
                within(c.links.where(~F.col("book_id").isin(*self.books)), "left_anti")
        if self.shelf is not None:
            inside = self.shelf.select(F.col("id").alias("book_id"))
            within(c.links.join(inside, "book_id", "left_semi"))
            if self.exclusive:
                within(c.links.join(inside, "book_id", "left_anti"), "left_anti")
        if self.author is not None:
            within(by_author.where(F.col("author") == self.author))
            if self.exclusive:
                within(by_author.where(~F.col("author").eqNullSafe(self.author)), "left_anti")
        known = [b for b in self.buckets if b in BUCKETS]
        if known or (self.buckets and self.strict):
            within(c.codes.where(F.left("code", F.lit(1)).isin([x for b in known for x in letters(b)])))
        if self.codes:
            within(c.codes.where(_any(subtree(F.col("code"), x) for x in self.codes)))
        for x in self.all_codes:
            within(c.codes.where(subtree(F.col("code"), x)))
        for b in self.all_buckets:
            within(c.codes.where(F.left("code", F.lit(1)).isin(letters(b))))
        for g in self.all_genres:
            within(c.links.join(c.genres.where(F.col("genre") == g), "book_id"))
        if self.uncategorised:
            within(c.codes, "left_anti")
        low, high = self.difficulty
        conditions = [
            F.col("archaic").isin(*self.archaic) if self.archaic else None,
            F.col("difficulty") >= low if low is not None else None, F.col("difficulty") <= high if high is not None else None,
            F.col("part_of_speech").isin(*self.part_of_speech) if self.part_of_speech else None,
            F.col("quizzable") == F.lit(True) if self.quizzable else None, F.col("difficulty").isNull() if self.unscored else None,
            F.lower("lemma").startswith(self.prefix.lower()) if self.prefix else None,
            F.lower("lemma").like(self.like.lower()) if self.like else None, F.col("lemma").ilike(f"%{self.contains}%") if self.contains else None,
        ]
        for condition in conditions:
            if condition is not None:
                words = words.where(condition)
        return words


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def page(df: DataFrame, sort: str, tie: str, descending: bool = False, number: int = 1, size: int = 50) -> DataFrame:
    """One page of a listing, nulls last either way."""
    col = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return df.orderBy(col, tie).offset((number - 1) * size).limit(size)


def words(c: Corpus, f: WordFilter = WordFilter()) -> DataFrame:
    counts = c.links.groupBy(F.col("word_id").alias("id")).agg(F.count("*").alias("book_count"))
    out = f.apply(c).join(counts, "id", "left")
    return out.select("id", "lemma", "part_of_speech", F.round("difficulty", 6).alias("difficulty"), "archaic", "quizzable", F.coalesce("book_count", F.lit(0)).alias("book_count"))


def exclusive_by_book(c: Corpus) -> DataFrame:
    """(book_id, unique_word_count): active words linked to that book only."""
    alone = c.active_links.groupBy("word_id").agg(F.count("*").alias("n"), F.min("book_id").alias("book_id")).where("n = 1")
    return alone.groupBy("book_id").agg(F.count("*").alias("unique_word_count"))


def exclusive_by_author(c: Corpus) -> DataFrame:
    alone = c.author_links.groupBy("word_id").agg(F.count("*").alias("n"), F.min("author").alias("author")).where("n = 1")
    return alone.groupBy("author").agg(F.count("*").alias("unique_word_count"))


def exclusive_words(c: Corpus) -> DataFrame:
    """(id, author) of words that one named author alone has; a book without an author counts as another's."""
    rows = c.active_links.join(c.books.select(F.col("id").alias("book_id"), "author"), "book_id")
    held = rows.groupBy(F.col("word_id").alias("id")).agg(F.min("author").alias("author"), F.max("author").alias("last"), F.count(F.when(F.col("author").isNull(), 1)).alias("nameless"))
    return held.where("author = last and nameless = 0").select("id", "author")


def _scored(c: Corpus, links: DataFrame, key: str) -> DataFrame:
    score = c.words.select(F.col("id").alias("word_id"), F.col("difficulty").cast("decimal(18,4)").alias("difficulty"))
    d = F.col("difficulty")
    return links.join(score, "word_id").groupBy(key).agg(
        F.countDistinct("word_id").alias("word_count"), F.count(d).alias("scored_word_count"),
        F.round(F.sum(d).cast("double") / F.count(d), 6).alias("mean_difficulty"), F.round(F.stddev_samp(d.cast("double")), 4).alias("stddev_difficulty"),
    )


def _overall(df: DataFrame) -> DataFrame:
    out = percent_ranks(df, {"mean_difficulty": "__m", "density": "__d"})
    return out.withColumn("overall_difficulty", F.round(F.round(100 * (F.col("__m") + F.col("__d")) / 2, 6), 1)).drop("__m", "__d")


def _density(words: Column, known: Column) -> Column:
    return F.when(known > 0, F.round(words / known, 6))


def books(c: Corpus) -> DataFrame:
    """Listing of books that hold an active word."""
    stats = _scored(c, c.active_links, "book_id")
    genres = c.genres.groupBy("book_id").agg(F.array_join(F.sort_array(F.collect_set("genre")), "|").alias("genres"))
    out = stats.join(c.books.withColumnRenamed("id", "book_id"), "book_id").join(c.fame, "book_id", "left").join(exclusive_by_book(c), "book_id", "left").join(genres, "book_id", "left")
    out = _overall(out.withColumn("density", _density(F.col("word_count"), F.col("distinct_words"))))
    return out.select(
        F.col("book_id").alias("id"), "title", "author", "word_count", "scored_word_count", "mean_difficulty", "stddev_difficulty", "density", "overall_difficulty",
        "fame_score", F.coalesce("unique_word_count", F.lit(0)).alias("unique_word_count"), "genres",
    )


def authors(c: Corpus) -> DataFrame:
    """Listing of named authors; a word in several of their books counts once, densities are averaged over books."""
    stats = _scored(c, c.author_links, "author")
    counts = c.active_links.groupBy("book_id").agg(F.countDistinct("word_id").alias("word_count"))
    per_book = c.books.where("author is not null").join(counts, F.col("id") == F.col("book_id")).select("author", _density(F.col("word_count"), F.col("distinct_words")).alias("density"))
    density = per_book.groupBy("author").agg(F.count("*").alias("book_count"), F.sum((F.col("density") * 1000000).cast("decimal(18,0)")).cast("long").alias("micro"), F.count("density").alias("known"))
    half_up = F.expr("(2 * micro + known) div nullif(2 * known, 0) / 1e6d")  # in whole numbers, so that a mean halfway between two has one result
    density = density.select("author", "book_count", half_up.alias("density"))
    out = _overall(stats.join(density, "author").join(exclusive_by_author(c), "author", "left"))
    return out.select("author", "book_count", "word_count", "scored_word_count", "mean_difficulty", "stddev_difficulty", "density", "overall_difficulty", F.coalesce("unique_word_count", F.lit(0)).alias("unique_word_count"))


def _labelled(df: DataFrame, labels: tuple[str, ...], counts: DataFrame) -> DataFrame:
    """All ``labels`` with the counts found, zero where there are none."""
    all_labels = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], "position int, label string")
    return all_labels.join(counts, "label", "left").select("position", "label", F.coalesce("count", F.lit(0)).alias("count"))


def unique_word_histogram(c: Corpus, scope: str = "book") -> DataFrame:
    """Books (or named authors) by number of words only they have, every label present."""
    if scope == "book":
        entities, mine, key = c.active_links.select("book_id").distinct(), exclusive_by_book(c), "book_id"
    else:
        entities, mine, key = c.author_links.select("author").distinct(), exclusive_by_author(c), "author"
    n = entities.join(mine, key, "left").select(unique_bucket(F.coalesce("unique_word_count", F.lit(0))).alias("label"))
    return _labelled(n, BUCKET_LABELS, n.groupBy("label").count())


def fame_histogram(c: Corpus) -> DataFrame:
    n = c.books.join(c.fame, c.books["id"] == c.fame["book_id"], "left").select(F.coalesce(F.col("fame_score").cast("string"), F.lit("unscored")).alias("label"))
    return _labelled(n, (*map(str, range(1, 11)), "unscored"), n.groupBy("label").count())


def difficulty_bands(c: Corpus, f: WordFilter = WordFilter(), width: int = 20) -> DataFrame:
    """Words by difficulty band; words without a score are a band of their own."""
    tops = [f"{a}-{min(a + width, 100)}" for a in range(0, 100, width)]
    at = F.get(F.array(*map(F.lit, tops)), band(F.col("difficulty"), width))
    n = f.apply(c).select(F.coalesce(at, F.lit("Not yet scored")).alias("label"))
    return _labelled(n, (*tops, "Not yet scored"), n.groupBy("label").count())


def overall_difficulty_histogram(c: Corpus) -> DataFrame:
    tops = [f"{a}-{a + 20}" for a in range(0, 100, 20)]
    at = F.get(F.array(*map(F.lit, tops)), band(F.col("overall_difficulty"), 20))
    n = books(c).select(F.coalesce(at, F.lit("Not enough data")).alias("label"))
    return _labelled(n, (*tops, "Not enough data"), n.groupBy("label").count())


def _bucket_of(code: Column) -> Column:
    pairs = [F.lit(x) for bucket, letters in BUCKETS.items() for letter in letters for x in (letter, bucket)]
    return F.create_map(*pairs)[F.left(code, F.lit(1))]


def word_buckets(c: Corpus) -> DataFrame:
    """(word_id, bucket), once each: buckets overlap, as words have several codes."""
    return c.codes.select("word_id", _bucket_of(F.col("code")).alias("bucket")).where("bucket is not null").distinct()


def domain_buckets(c: Corpus, f: WordFilter = WordFilter()) -> DataFrame:
    n = word_buckets(c).join(f.apply(c).select(F.col("id").alias("word_id")), "word_id", "left_semi").select(F.col("bucket").alias("label"))
    return _labelled(n, tuple(BUCKETS), n.groupBy("label").count())


def growth(c: Corpus, metric: str = "books") -> DataFrame:
    """(date, count) for every day from the first to the last, zero where nothing is new."""
    days = c.books.select(F.col("id").alias("book_id"), "author", "created_on")
    if metric == "authors":
        days = days.where("author is not null").groupBy("author").agg(F.min("created_on").alias("created_on"))
    elif metric == "words":
        days = c.active_links.join(days, "book_id").groupBy("word_id").agg(F.min("created_on").alias("created_on"))
    found = days.groupBy(F.col("created_on").alias("date")).agg(F.count("*").alias("n"))
    span = found.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("date"))
    return span.join(found, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("count"))


def category_counts(c: Corpus) -> DataFrame:
    """(letter, words, children): active words of each top-level field, and its number of distinct codes below."""
    live = c.codes.join(c.words.select(F.col("id").alias("word_id")), "word_id", "left_semi")
    return live.groupBy(F.left("code", F.lit(1)).alias("letter")).agg(F.countDistinct("word_id").alias("words"), F.countDistinct(F.when(F.length("code") > 1, F.col("code"))).alias("children"))


def overlap(pairs: DataFrame, member: str, group: str) -> DataFrame:
    """(code_a, code_b, shared_words, ratio) of groups that share a member, a < b; sizes are counted once."""
    pairs = pairs.select(member, group).distinct()
    sizes = pairs.groupBy(group).agg(F.count("*").alias("n"))
    held = pairs.groupBy(member).agg(F.sort_array(F.collect_set(group)).alias("g")).where(F.size("g") > 1)  # groups are few by nature: fields or genres
    cells = held.select(F.explode(F.flatten(F.transform("g", lambda a, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    cells = cells.groupBy("p.a", "p.b").agg(F.count("*").alias("shared_words"))
    x, y = sizes.select(F.col(group).alias("a"), F.col("n").alias("na")), sizes.select(F.col(group).alias("b"), F.col("n").alias("nb"))
    shared = F.col("shared_words")
    return cells.join(F.broadcast(x), "a").join(F.broadcast(y), "b").select(F.col("a").alias("code_a"), F.col("b").alias("code_b"), "shared_words", F.round(shared / (F.col("na") + F.col("nb") - shared), 4).alias("ratio"))


def category_overlap(c: Corpus) -> DataFrame:
    live = c.codes.join(c.words.select(F.col("id").alias("word_id")), "word_id", "left_semi")
    return overlap(live.select("word_id", F.left("code", F.lit(1)).alias("code")), "word_id", "code")


def genre_overlap(c: Corpus) -> DataFrame:
    return overlap(c.active_links.join(c.genres, "book_id"), "word_id", "genre")


def category_leaders(c: Corpus, root: str, least: int = 3) -> DataFrame:
    """Books by lift: their share of words under ``root`` over the mean share of all books with ``least`` words."""
    inside = c.codes.where(subtree(F.col("code"), root)).select("word_id").distinct().withColumn("hit", F.lit(1))
    n = c.active_links.join(inside, "word_id", "left").groupBy("book_id").agg(F.count("*").alias("total_word_count"), F.count("hit").alias("category_word_count")).where(F.col("total_word_count") >= least)
    n = n.withColumn("share", F.round(F.col("category_word_count") / F.col("total_word_count"), 6))
    mean = n.agg((F.sum(F.col("share").cast("decimal(18,6)")).cast("double") / F.count("share")).alias("mean"))
    out = n.join(F.broadcast(mean))
    return out.select(F.col("book_id").alias("id"), "total_word_count", "category_word_count", F.round("share", 4).alias("share"), F.round(F.round(F.col("share") / F.greatest("mean", F.lit(1e-9)), 8), 3).alias("lift"))


def domain_vectors(c: Corpus, least: int = 3) -> DataFrame:
    """(book_id, letter, fraction): the distribution of a book's words over the top-level fields."""
    rows = c.active_links.join(c.codes.select("word_id", F.left("code", F.lit(1)).alias("letter")).distinct(), "word_id")
    n = rows.groupBy("book_id", "letter").agg(F.count("*").alias("n"))
    total = n.groupBy("book_id").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    return n.join(total, "book_id").select("book_id", "letter", F.round(F.col("n") / F.col("total"), 6).alias("fraction"))


def domain_map(c: Corpus, least: int = 3) -> DataFrame:
    """(book_id, x, y): two principal axes of the books' unit field vectors.

    Only the 21 by 21 moments go to the driver; books are projected by column arithmetic.
    """
    import numpy as np

    v = domain_vectors(c, least).groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("letter", "fraction"))).alias("m"))
    arr = F.array(*[F.coalesce(F.col("m")[x], F.lit(0.0)) for x in LETTERS])
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    v = v.select("book_id", arr.alias("raw")).select("book_id", *[(F.get("raw", i) / norm).alias(f"f{i}") for i in range(len(LETTERS))])
    names = [f"f{i}" for i in range(len(LETTERS))]
    moments = v.agg(F.count("*").alias("n"), *[F.sum(a).alias(a) for a in names], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]).first()
    if not moments.n:
        return v.select("book_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    mean = np.array([moments[a] for a in names]) / moments.n
    cov = np.zeros((len(names), len(names)))
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], i):
            cov[i, j] = cov[j, i] = moments[f"{a}_{b}"] / moments.n - mean[i] * mean[j]
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :2].T
    x, y = (sum((F.lit(float(w)) * (F.col(a) - float(m)) for w, a, m in zip(axis, names, mean)), F.lit(0.0)) for axis in axes)
    out = v.select("book_id", x.alias("x"), y.alias("y"))
    far = out.agg(F.max_by("x", F.abs("x")).alias("x"), F.max_by("y", F.abs("y")).alias("y")).first()
    return out.select("book_id", *[F.round(F.col(k) * (-1.0 if far[k] < 0 else 1.0), 6).alias(k) for k in ("x", "y")])


def title_order(c: Corpus) -> DataFrame:
    """(id, sort_key, letter): titles without their article."""
    key = sort_title(F.col("title"))
    return c.books.select("id", key.alias("sort_key"), F.left(key, F.lit(1)).alias("letter"))


def headline(c: Corpus) -> DataFrame:
    """One row of corpus counters."""
    a = c.words.agg(F.count("*").alias("words"), F.count("difficulty").alias("scored_words"), F.countDistinct("part_of_speech").alias("parts_of_speech"), F.count(F.when(F.col("quizzable"), 1)).alias("quizzable_words"))
    b = c.books.agg(F.count("*").alias("books"), F.countDistinct("author").alias("authors"), F.sum("token_count").alias("tokens"))
    return a.join(F.broadcast(b))
