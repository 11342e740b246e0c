"""Changes of tables as functions from old rows to new ones; ``sources.sinks.replace_table`` writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def ensure_schema(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; missing ones are null, types are cast."""
    fields = T.StructType.fromDDL(schema).fields
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f"`{f.name}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def edited(words: DataFrame, edits: DataFrame) -> DataFrame:
    """``words`` (id, definition, previous, quiz_definition) after ``edits`` (id, definition): one step of history, and what depended on a changed text is null."""
    new = edits.groupBy("id").agg(F.max("definition").alias("__new"))
    changed = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("definition"))
    return words.join(new, "id", "left").select(
        "id", F.when(changed, F.col("__new")).otherwise(F.col("definition")).alias("definition"), F.when(changed, F.col("definition")).otherwise(F.col("previous")).alias("previous"),
        F.when(~changed, F.col("quiz_definition")).alias("quiz_definition"),
    )


def invalidated(dependents: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """``dependents`` without the rows of the ``changed`` keys."""
    return dependents.join(changed.select(key).distinct(), key, "left_anti")


def promoted(master: DataFrame, approved: DataFrame) -> DataFrame:
    """``master`` (word, books) after ``approved`` (word, book): a known word's ``; `` list gains the books it lacks, a new word is added."""
    new = approved.groupBy(F.lower("word").alias("__k")).agg(F.min("word").alias("__word"), F.sort_array(F.collect_set("book")).alias("__books"))
    have = F.filter(F.split(F.coalesce("books", F.lit("")), r"\s*;\s*"), lambda b: b != "")
    out = master.join(new, F.lower("word") == F.col("__k"), "full_outer")
    books = F.concat(have, F.array_except(F.coalesce("__books", F.array().cast("array<string>")), have))
    return out.select(F.coalesce("word", "__word").alias("word"), F.array_join(books, "; ").alias("books"))


def rescued(words: DataFrame, rejected: DataFrame, ids: DataFrame, junk: Column) -> tuple[DataFrame, DataFrame]:
    """Words and rejected rows (id, lemma, reason, pos) after the rows ``ids`` (id) were accepted; junk parts of speech stay rejected.

    The reason it was once rejected for stays with the word.
    """
    taken = rejected.join(ids.select("id").distinct(), "id", "left_semi").where(~F.coalesce(junk, F.lit(False)))
    new = taken.groupBy(F.lower("lemma").alias("lemma")).agg(F.min("reason").alias("rescued_reason"))
    kept = words.select(F.lower("lemma").alias("lemma"), F.lit(None).cast("string").alias("rescued_reason")).distinct().join(new.select("lemma"), "lemma", "left_anti")
    return kept.unionByName(new), rejected.join(taken.select("id"), "id", "left_anti")


def added_items(items: DataFrame, wanted: DataFrame, words: DataFrame) -> DataFrame:
    """``items`` (set_id, word_id, mastered) with the ``wanted`` pairs that are active words and not there yet."""
    fresh = wanted.select("set_id", "word_id").distinct().join(words.select(F.col("id").alias("word_id")), "word_id", "left_semi").join(items.select("set_id", "word_id"), ["set_id", "word_id"], "left_anti")
    return items.unionByName(fresh.select("set_id", "word_id", F.lit(False).alias("mastered")))


def manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Groups (title_base, author, parts, skip_reason, compiled_at, merged_at) after a new detection; times of finished steps are kept."""
    n = new.select("title_base", "author", F.col("parts").alias("__parts"), F.col("skip_reason").alias("__skip"), F.lit(True).alias("__new"))
    out = old.join(n, ["title_base", "author"], "full_outer")
    pick = lambda name, other: F.when(F.col("__new"), F.col(other)).otherwise(F.col(name)).alias(name)
    return out.select("title_base", "author", pick("parts", "__parts"), pick("skip_reason", "__skip"), "compiled_at", "merged_at")


def published(books: DataFrame, facts: DataFrame) -> DataFrame:
    """``books`` (id, year, era, ...) with ``facts`` (id, year, era) where they have none."""
    f = facts.groupBy("id").agg(F.min("year").alias("__year"), F.min("era").alias("__era"))
    return books.join(f, "id", "left").withColumn("year", F.coalesce("year", "__year")).withColumn("era", F.coalesce("era", "__era")).drop("__year", "__era")


def compiled(parts: DataFrame) -> DataFrame:
    """(title_base, text): header of the first part, all bodies in order with a blank line between, footer of the last.

    ``parts`` has title_base, first, header, body and footer; a work has a bounded number of parts.
    """
    piece = F.struct("first", F.col("body"))
    out = parts.groupBy("title_base").agg(F.min_by("header", "first").alias("h"), F.sort_array(F.collect_list(piece)).alias("p"), F.max_by("footer", "first").alias("f"))
    return out.select("title_base", F.concat("h", F.array_join(F.transform("p", lambda x: x["body"]), "\n\n"), "f").alias("text"))


def gazetteer(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names (name, kind) after loading ``new``: its kinds are replaced, other kinds stay."""
    return old.join(new.select("kind").distinct(), "kind", "left_anti").select("name", "kind").unionByName(new.select(F.lower("name").alias("name"), "kind").distinct())


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the whole ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
