"""Relations between terms: siblings, verification and traps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Terms too general to mislead anyone.
GENERIC = ("entity", "abstraction", "abstract entity", "physical entity", "thing")


def siblings(edges: DataFrame, child: str, parent: str, terms: DataFrame) -> DataFrame:
    """(term, sibling) of the stated ``terms`` (term): other children of their parents."""
    asked = edges.select(F.col(child).alias("term"), F.col(parent).alias("__up")).join(terms, "term", "left_semi")
    others = edges.select(F.col(child).alias("sibling"), F.col(parent).alias("__up2"))
    return asked.join(others, (F.col("__up") == F.col("__up2")) & (F.col("term") != F.col("sibling"))).select("term", "sibling").distinct()


def verified(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``edges`` (a, b, ...) with ``status``: what ``verdicts`` (a, b, verdict) say; without a verdict an edge is rejected."""
    v = verdicts.groupBy(F.col("a").alias("__a"), F.col("b").alias("__b")).agg(F.max("verdict").alias("status"))
    out = edges.join(v, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left").drop("__a", "__b")
    return out.withColumn("status", F.coalesce("status", F.lit("rejected")))


def traps(fanout: DataFrame, excluded: DataFrame) -> DataFrame:
    """(term, n, traps) of the terms' related lemmas (term, lemma), without those ``excluded`` (term, lemma) and the generic ones."""
    rows = fanout.where(~F.col("lemma").isin(*GENERIC)).join(excluded, ["term", "lemma"], "left_anti").distinct()
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("lemma")), "|").alias("traps"))
