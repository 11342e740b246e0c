"""Definitions that give their word away: which tokens do, and the definition without them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .lexicon import HEADS as PREFIXES


def _ratio():
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)

    return ratio


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    at = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    return F.aggregate(at, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)) & (F.length(a) >= i) & (F.length(b) >= i), i).otherwise(n))


def light_stem(word: Column) -> Column:
    """A word of lower-case letters without the ending of a plural, a tense, a degree or an adverb, if three letters or more are left."""
    bare = F.regexp_replace(word, r"(?<=[a-z]{3})(?:ingly|edly|iness|ness|ing|ies|ied|ily|ed|es|er|est|ly|s|y|e)$", "")
    return F.regexp_replace(bare, r"([b-df-hj-kmnp-rtvwxz])\1$", "$1")


def leaking_tokens(rows: DataFrame, near: float | None = 0.85, stem=None) -> DataFrame:
    """(id, token) of the definition's words of three letters and more that give away the word; ``rows`` has id, word, definition.

    A token leaks when it is the word, has the word's stem (``stem``: a column function, if given), shares a
    prefix of four letters and of 55 % of the shorter, is the word with a known prefix or the other way
    round, or, both having five letters, is spelled alike by ``near``. That last test runs in Python, once for
    each distinct pair that no other rule has decided.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("definition", F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    t = rows.select("id", F.lower(F.trim("word")).alias("word"), F.explode(F.filter(words, lambda x: F.length(x) >= 3)).alias("token"))
    a, b = F.col("word"), F.col("token")
    short = F.least(F.length(a), F.length(b))
    n = common_prefix(a, b)
    glued = F.lit(False)
    for p in PREFIXES:
        glued = glued | ((a == F.concat(F.lit(p), b)) & (F.length(b) >= 4)) | ((b == F.concat(F.lit(p), a)) & (F.length(a) >= 4))
    sure = (a == b) | ((n >= 4) & (n >= 0.55 * short)) | glued
    if stem is not None:
        sure = sure | (stem(a) == stem(b))
    t = t.withColumn("sure", sure)
    if near is None:
        return t.where("sure").select("id", "token")
    pairs = t.where(~F.col("sure") & (short >= 5)).select("word", "token").distinct()
    alike = pairs.where(_ratio()("word", "token") >= near).withColumn("alike", F.lit(True))
    return t.join(alike, ["word", "token"], "left").where(F.col("sure") | F.col("alike")).select("id", "token")


def redacted(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, quiz_definition, source): the definition with leaking tokens as dashes (redacted), or as it is (clean)."""
    found = tokens.groupBy("id").agg(F.sort_array(F.collect_set("token")).alias("__t"))
    pieces = F.regexp_extract_all("definition", F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    blank = F.array_join(F.transform(pieces, lambda p: F.when(F.array_contains("__t", F.lower(p)), F.lit("—")).otherwise(p)), "")
    leaks = F.col("__t").isNotNull()
    return rows.join(found, "id", "left").select("id", F.when(leaks, blank).otherwise(F.col("definition")).alias("quiz_definition"), F.when(leaks, "redacted").otherwise("clean").alias("source"))
