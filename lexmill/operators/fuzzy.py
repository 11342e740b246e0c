"""Fuzzy search of many short queries in all texts: an index of trigrams finds the texts that may hold a like stretch, and only those are compared.

A stretch W of a text is as like a query A as their trigrams: |A and W| / |A or W|. For that to be above ``least``, more
than least * |A| of the query's trigrams must occur in the text. So a text that fits holds one of all but that many of the
query's trigrams; the rarest of them are looked up. A text found must then hold enough trigrams in all, and the best
stretch is sought in what is left. No text that fits is lost, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import trigrams
from ..plans.staging import settled
from .lexicon import window_similarity


@dataclass(frozen=True)
class GramIndex:
    """``texts`` (id, text, grams), ``postings`` (gram, id) and ``sizes`` (gram, n), all written once."""

    texts: DataFrame
    postings: DataFrame
    sizes: DataFrame


def gram_index(texts: DataFrame) -> GramIndex:
    """The index of ``texts`` (id, text); null texts hold nothing, ids are taken to be distinct."""
    rows = settled(texts.where("text is not null").select("id", "text", trigrams(F.col("text")).alias("grams")))
    postings = settled(rows.select(F.explode("grams").alias("gram"), "id"))
    return GramIndex(rows, postings, settled(postings.groupBy("gram").agg(F.count("*").alias("n"))))


def candidates(index: GramIndex, queries: DataFrame, least: float) -> DataFrame:
    """(query_id, id): texts that hold more than least * n of the n trigrams of a query."""
    asked = queries.select("query_id", trigrams(F.coalesce("asked", F.lit(""))).alias("own")).where("size(own) > 0")
    grams = asked.select("query_id", F.explode("own").alias("gram")).join(index.sizes, "gram", "left")
    ordered = grams.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
    enough = F.floor(F.lit(least) * F.size("g") + 1e-9).cast("int") + 1
    rare = ordered.select("query_id", F.explode(F.slice("g", F.lit(1), F.size("g") - enough + 1)).alias("g"))
    found = rare.select("query_id", F.col("g.gram").alias("gram")).join(index.postings, "gram").select("query_id", "id").distinct()
    held = found.join(asked, "query_id").join(index.texts.select("id", "grams"), "id")
    return held.where(F.size(F.array_intersect("own", "grams")) > F.lit(least) * F.size("own") - 1e-9).select("query_id", "id")


def search(index: GramIndex, queries: DataFrame, least: float = 0.3) -> DataFrame:
    """(query_id, id, similarity) of every text with a stretch more like than ``least`` to a query of ``queries`` (query_id, asked)."""
    if not 0 <= least < 1:
        raise ValueError("least must lie in [0, 1)")
    found = candidates(index, queries, least).join(queries, "query_id")
    # few bytes and long work: a stated number of tasks, which Spark does not merge; rows of a text come one after the other
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = found.repartition(tasks, "id").sortWithinPartitions("id").join(index.texts.select("id", "text"), "id")
    out = pairs.select("query_id", "id", F.round(window_similarity(F.col("asked"), F.col("text"), least), 6).alias("similarity"))
    return out.where(F.col("similarity") > least)
