"""Draws from a circle: what follows an asker's own place, for many askers at once and without pairing all with all.

Every item has a place on a circle, a hash of its id. Items are kept in buckets of about ``BUCKET`` along the circle, for
each value of the keys; askers look into as many buckets as should hold what they need, and those that stay short look
further in the next round, until their whole circle is seen. So a key that most items have is no hot key, and the
draw is exact: the first items in the order of the circle that fit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.staging import bounded, settled, shuffled
from .listing import hashed

BITS, BUCKET = 32, 16  # bits of a place, items of a bucket


def place(key: Column, seed: int) -> Column:
    """Where ``key`` lies on the circle."""
    return F.conv(F.left(hashed(key, seed), F.lit(BITS // 4)), 16, 10).cast("long")


def after(item: Column, asker: Column, seed: int) -> Column:
    """How far an item lies behind an asker on the circle."""
    return F.pmod(place(item, seed) - place(asker, seed), F.lit(1 << BITS))


def first(pairs: DataFrame, by: str, need: int, *order: Column | str) -> DataFrame:
    """The first ``need`` rows of each ``by``, with their number ``nth``."""
    return pairs.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= need)


def counted(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` of ``first`` with how many there are of each ``by``, as ``n``."""
    return rows.withColumn("n", F.max("nth").over(Window.partitionBy(by)))


def follow(items: DataFrame, askers: DataFrame, keys: list[str], need: int, seed: int, fits: Column | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(asker, item, nth): the first ``need`` items behind each asker on the circle that have one of its keys.

    ``items`` has item, the keys and what ``fits`` reads; ``askers`` has asker, the keys and what ``fits`` reads, in
    several rows if it draws from several keys. ``keep`` takes found pairs (asker, item, behind, span) and drops those that may not be.
    """
    whole = 1 << BITS
    items = settled(items.withColumn("place", place(F.col("item"), seed)))
    sizes = items.groupBy(*keys).agg(F.count("*").alias("n"))
    sizes = settled(sizes.withColumn("bits", F.least(F.greatest(F.ceil(F.log2(F.col("n") / BUCKET)), F.lit(0)), F.lit(BITS)).cast("int")))
    items = settled(items.join(bounded(sizes.drop("n")), keys).withColumn("bucket", F.expr(f"shiftright(place, {BITS} - bits)")).drop("bits"))
    looks = askers.withColumn("start", place(F.col("asker"), seed)).join(bounded(sizes), keys)
    spans = looks.groupBy("asker").agg(F.least(F.ceil(4.0 * whole * need / F.sum("n")), F.lit(whole)).cast("long").alias("span"))
    looks = settled(looks.drop("n").join(shuffled(spans), "asker"))
    done = None
    while True:
        buckets = F.least(F.expr("shiftleft(1L, bits)"), F.expr(f"shiftright(span, {BITS} - bits)") + 2)
        at = looks.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)))
        at = at.withColumn("bucket", F.pmod(F.expr(f"shiftright(start, {BITS} - bits)") + F.col("bucket"), F.expr("shiftleft(1L, bits)")))
        found = at.join(shuffled(items), [*keys, "bucket"])
        found = found if fits is None else found.where(fits)
        found = found.withColumn("behind", F.pmod(F.col("place") - F.col("start"), F.lit(whole))).where("behind < span").groupBy("asker", "item").agg(F.min("behind").alias("behind"), F.max("span").alias("span"))
        found = settled(counted(first(keep(found) if keep else found, "asker", need, "behind", "item"), "asker").select("asker", "item", "nth", "n", "span"))
        full = found.where(F.col("n") >= need).select("asker").distinct()
        held = found.where((F.col("n") >= need) | (F.col("span") >= whole)).select("asker", "item", "nth")
        done = held if done is None else done.unionByName(held)
        looks = settled(looks.where(F.col("span") < whole).join(shuffled(full), "asker", "left_anti").withColumn("span", F.least(F.col("span") * 16, F.lit(whole))))
        if not looks.limit(1).count():
            return done
