"""Derived words and what they come from: adverbs in -ly go back to their adjective, words in un- to the word without it, or both in a row.

A dictionary (word, adjective, listed) decides: a root in the place of an adjective must be one there, a root without un-
must be listed and have four letters. Candidates are joined with the dictionary, a step of derivation a join, so neither
side is held whole anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Endings of adverbs and what stands for them in the adjective, the first that fits an adjective counts.
ENDINGS = (("ically", "ic"), ("ibly", "ible"), ("ably", "able"), ("ily", "y"), ("ly", ""))


def without_un(word: Column) -> Column:
    """The word without un-, if four letters or more are left; else null."""
    return F.when(word.startswith("un") & (F.length(word) >= 6), F.substr(word, F.lit(3)))


def adjectives(surfaces: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(surface, adjective) of the adverbs among ``surfaces`` (surface) whose adjective is in ``dictionary``."""
    s = F.col("surface")
    tries = F.array(*[F.when(s.endswith(end) & (F.length(s) - len(end) >= 2), F.concat(F.substr(s, F.lit(1), F.length(s) - len(end)), F.lit(put))) for end, put in ENDINGS])
    rows = surfaces.where("surface is not null").distinct().select("surface", F.posexplode(tries).alias("nth", "adjective")).where("adjective is not null")
    known = dictionary.where("adjective").select(F.lower(F.trim("word")).alias("adjective")).distinct()
    return rows.join(known, "adjective", "left_semi").groupBy("surface").agg(F.min_by("adjective", "nth").alias("adjective"))


def derived_roots(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(lemma, pos, root, root_pos) of the words (lemma, pos) that have a root.

    For an adverb: its adjective, without un- if that is listed; or, if it has no adjective, that of the word without un-.
    For other words: the word without un- if listed, and its adjective if that in turn is an adverb. Nulls have no root.
    """
    w = words.select(F.lower(F.trim("lemma")).alias("lemma"), "pos").where("lemma is not null").distinct().withColumn("bare", without_un(F.col("lemma")))
    adj = adjectives(w.select(F.col("lemma").alias("surface")).unionByName(w.select(F.col("bare").alias("surface"))), dictionary)
    listed = dictionary.where("listed").select(F.lower(F.trim("word")).alias("__listed")).distinct()

    def look(df: DataFrame, key: str, out: str) -> DataFrame:
        return df.join(adj.select(F.col("surface").alias("__s"), F.col("adjective").alias(out)), F.col(key) == F.col("__s"), "left").drop("__s")

    def found(df: DataFrame, key: Column, out: str) -> DataFrame:
        return df.withColumn("__k", key).join(listed, F.col("__k") == F.col("__listed"), "left").withColumnRenamed("__listed", out).drop("__k")

    adverb = F.coalesce(F.col("pos") == "ADV", F.lit(False))
    adverbs = found(look(look(w.where(adverb), "lemma", "one"), "bare", "two"), without_un(F.col("one")), "deeper")
    adverbs = adverbs.select("lemma", "pos", F.coalesce("deeper", "one", "two").alias("root"), F.lit("ADJ").alias("root_pos"))
    others = look(found(w.where(~adverb), F.col("bare"), "plain"), "plain", "adjective")
    others = others.select("lemma", "pos", F.coalesce("adjective", "plain").alias("root"), F.when(F.col("adjective").isNotNull(), "ADJ").otherwise(F.col("pos")).alias("root_pos"))
    return adverbs.unionByName(others).where("root is not null")
