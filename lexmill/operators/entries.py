"""Entries of dictionary volumes, filtered, sorted and paged, with each entry's first definition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .facets import page

SORTS = ("headword", "page_number", "created_at")
UNCHECKED = "unchecked"


@dataclass(frozen=True)
class EntryFilter:
    """Filters on entries; those left at their default let everything pass.

    ``contains`` is met anywhere in the headword, % and _ in it standing for any run and any character. ``match`` is how an
    entry was matched with the vocabulary; ``unchecked`` asks for lemmas that were not matched yet.
    """

    contains: str = ""
    volume: int | None = None
    letter: str = ""
    needs_review: bool | None = None
    match: str | None = None

    def apply(self, entries: DataFrame) -> DataFrame:
        word = F.lower("headword")
        if self.contains:
            entries = entries.where(word.like(f"%{self.contains.lower()}%"))
        if self.volume is not None:
            entries = entries.where(F.col("volume_id") == self.volume)
        if self.letter:
            entries = entries.where(F.left(word, F.lit(1)) == self.letter.lower())
        if self.needs_review is not None:
            entries = entries.where(F.col("needs_review") == self.needs_review)
        if self.match == UNCHECKED:
            entries = entries.where(F.col("lemma") & F.col("match").isNull())
        elif self.match is not None:
            entries = entries.where(F.col("match") == self.match)
        return entries


def first_definitions(entries: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, first_definition) of the ``entries`` (id) by the order of ``definitions`` (entry_id, nth, text)."""
    rows = definitions.join(entries.select(F.col("id").alias("entry_id")).distinct(), "entry_id", "left_semi")
    return rows.groupBy(F.col("entry_id").alias("id")).agg(F.min_by("text", F.struct("nth", "text")).alias("first_definition"))


def entry_page(entries: DataFrame, definitions: DataFrame, only: EntryFilter = EntryFilter(), sort: str = "headword", descending: bool = False, number: int = 1, size: int = 50) -> DataFrame:
    """The ``number``-th page of the entries that pass, with ``first_definition`` and the ``total`` of those that do.

    Definitions are looked up for the entries of the page only, which are ``size`` at most. Headwords sort in lower case.
    """
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    rows = only.apply(entries).withColumn("__by", F.lower("headword") if sort == "headword" else F.col(sort))
    total = rows.agg(F.count("*").alias("total"))
    shown = page(rows, "__by", "id", descending, number, size).drop("__by")
    out = shown.join(first_definitions(F.broadcast(shown.select("id")), definitions), "id", "left")
    return out.join(F.broadcast(total))  # one row
