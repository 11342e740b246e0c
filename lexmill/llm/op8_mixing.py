"""Mixing sources to target weights, in DataFrame functions only.

A source's documents fall into ``blocks`` hash blocks (so a hot source is spread over all of them) and
the blocks are permuted. The mix takes every block once per whole epoch of the source's target, and for
the rest each of the permuted blocks that still fits, also past those that do not. What is left then is
less than any block not drawn; if it brings the taken words closer to the target, the smallest of these is
drawn as well and drawn blocks that fit into the excess are given back, the last first.

The drawn blocks' counts per source are then divided among the output shards by a
multivariate-hypergeometric splitting tree. A node stands for a run of shards and holds a count for each
source; its left half's total is fixed, so that all shards get equally many units within one, and each
source's part of it is drawn in turn, hypergeometric in what sources and total have left. Sources are
drawn in groups of at most ``GROUP``, groups in groups of groups, so no array is longer. A draw inverts the
distribution over twelve deviations around its mode, by the hash of seed, node and source. Each shard
draws its quota as the next positions of the source's permutation, so shards share no unit, and
``mixed`` orders rows within a shard by a hash.

Only tables of at most ``blocks`` rows a source pass through windows and arrays (sources are ranked in one
window, a row each); documents are only hashed, pre-aggregated and joined on (source, block). Every draw is a hash of the seed, so reruns agree.

Defined cases: null or blank texts have size 0 and are taken with their block, twice at most, and once where their source has no words; a null source is a source
of its own and comes last; repeated rows share a block and are all taken alike; an empty table gives an
empty result; other columns are carried along by ``mixed`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import WORD, bounded_broadcast, staged

WEIGHTS = (3, 1, 2)
GROUP = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _block(doc_id: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(blocks))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, stop: float = 2.0) -> DataFrame:
    """source, source_size, target and rank of every source; the windows run over one row a source.

    With ratio r = stop * size / weight, the sources that stop are those whose r lies under the level that
    the remaining words and weights give when sources are taken in ascending r.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("rank", rank)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", stop * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    left = F.sum("source_size").over(Window.partitionBy()) * share - (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    by = by.withColumn("level", left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(Window.partitionBy())
    by = by.withColumn("first", first)
    by = by.withColumn("water", F.min(F.when(F.col("ratio") == F.col("first"), F.col("level"))).over(Window.partitionBy()))
    target = F.when(F.col("water").isNull() | (F.col("ratio") < F.col("first")), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return by.select("source", "source_size", target.cast("double").alias("target"), "rank")


def _hypergeometric(all_: Column, own: Column, draws: Column, chance: Column) -> Column:
    """How many of ``own`` are among ``draws`` out of ``all_`` units; ``chance`` lies in [0, 1)."""
    n, k, d = all_.cast("double"), own.cast("double"), draws.cast("double")
    mode = F.floor((d + 1) * (k + 1) / (n + 2))
    reach = F.ceil(12 * F.sqrt(d * (k / n) * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0)))) + 8
    low = F.greatest(F.lit(0), draws - (all_ - own), (mode - reach).cast("long"))
    high = F.least(own, draws, (mode + reach).cast("long"))

    def drawn(low: Column, high: Column) -> Column:
        steps = F.slice(F.sequence(low, high), F.lit(2), (high - low).cast("int"))
        next_ = lambda w, x: w * (k - x + 1) * (d - x + 1) / (x * (n - k - d + x))
        total = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("t")), lambda a, x: F.struct(next_(a["w"], x).alias("w"), (a["t"] + next_(a["w"], x)).alias("t")), lambda a: a["t"])
        first = lambda t: F.struct(F.lit(1.0).alias("w"), (chance * t - 1).alias("left"), low.alias("x"))
        on = lambda a, x: F.when(a["left"] < 0, a).otherwise(F.struct(next_(a["w"], x).alias("w"), (a["left"] - next_(a["w"], x)).alias("left"), x.alias("x")))
        return F.get(F.transform(F.array(total), lambda t: F.aggregate(steps, first(t), on, lambda a: a["x"])), F.lit(0))

    bounds = F.array(F.struct(low.cast("long").alias("low"), high.cast("long").alias("high")))
    return F.when((n > 0) & (k > 0) & (d > 0), F.get(F.transform(bounds, lambda b: drawn(b["low"], b["high"])), F.lit(0))).otherwise(F.lit(0).cast("long"))


def _chance(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / float(1 << 52)


def _children(parents: DataFrame, seed: int) -> DataFrame:
    """first, many, child, own, left: of each parent's ``draws``, how many fall to each of its children (child, own)."""
    def one(a, x):
        got = _hypergeometric(a["all"], x["own"], a["draws"], _chance(F.lit(seed), F.col("first"), F.col("many"), x["child"]))
        step = lambda g: F.struct((a["all"] - x["own"]).alias("all"), (a["draws"] - g).alias("draws"), F.array_append(a["out"], F.struct(x["child"].alias("child"), x["own"].alias("own"), g.alias("left"))).alias("out"))
        return F.get(F.transform(F.array(got), step), F.lit(0))

    none = F.array().cast("array<struct<child:bigint,own:bigint,left:bigint>>")
    total = F.aggregate("kids", F.lit(0).cast("long"), lambda a, x: a + x["own"])
    out = F.aggregate("kids", F.struct(total.alias("all"), F.col("draws").alias("draws"), none.alias("out")), one, lambda a: a["out"])
    return parents.select("first", "many", F.inline(out))


def splitting_tree(counts: DataFrame, shards: int, seed: int, sources: int) -> DataFrame:
    """rank, shard and quota of the ``counts`` (rank, own) divided among ``shards`` by drawing; ``sources`` bounds the ranks."""
    total = counts.agg(F.sum("own")).first()[0] or 0
    upto = lambda shard: F.floor(shard * F.lit(total) / shards).cast("long")
    levels, digits = (shards - 1).bit_length(), 1
    while GROUP**digits <= sources:
        digits += 1
    tree = counts.select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("many"), "rank", "own")
    for level in range(levels):
        half = F.ceil(F.col("many") / 2).cast("long")
        drawn = None  # a node of one shard passes all it holds to its left
        for digit in reversed(range(digits)):
            width = GROUP**digit
            kids = tree.groupBy("first", "many", F.floor(F.col("rank") / width).cast("long").alias("child")).agg(F.sum("own").alias("own"))
            parents = kids.groupBy("first", "many", F.floor(F.col("child") / GROUP).cast("long").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("child", "own"))).alias("kids"))
            if drawn is None:
                parents = parents.withColumn("draws", upto(F.col("first") + half) - upto(F.col("first")))
            else:
                parents = parents.join(drawn.select("first", "many", F.col("child").alias("parent"), F.col("left").alias("draws")), ["first", "many", "parent"])
            drawn = _children(parents, seed + 10 + level * digits + digit)
        sides = F.inline(F.array(F.struct(F.col("first"), half.alias("many"), F.col("left").alias("own")), F.struct((F.col("first") + half).alias("first"), (F.col("many") - half).alias("many"), (F.col("own") - F.col("left")).alias("own"))))
        tree = drawn.withColumnRenamed("child", "rank").select("rank", sides).where("own > 0")
        if digits > 1:
            tree = staged(tree, f"mix_tree_{level}")  # several joins read it
    return tree.select("rank", F.col("first").cast("int").alias("shard"), F.col("own").alias("quota"))


def _drawn(blocks: DataFrame) -> DataFrame:
    """ds and dt: source and turn of the blocks drawn for the part epoch; ``blocks`` has source, turn, words and rest."""
    none = F.array().cast("array<struct<turn:int,words:bigint>>")

    def fit(left, x):
        own = F.struct((left["left"] - x["words"]).alias("left"), F.array_append(left["took"], x).alias("took"))
        return F.when(x["words"] <= left["left"], own).otherwise(left)

    def filled(rows: Column, left: Column) -> Column:
        """What is left after each of ``rows``, in their order, that fits into it, and those."""
        return F.aggregate(rows, F.struct(left.cast("double").alias("left"), none.alias("took")), fit)

    by = blocks.where("words > 0").groupBy("source").agg(F.first("rest").alias("rest"), F.sort_array(F.collect_list(F.struct("turn", "words"))).alias("all"))
    by = by.withColumn("fill", filled(F.col("all"), F.col("rest"))).withColumn("took", F.col("fill.took"))
    missing = F.transform(F.array_except("all", "took"), lambda x: F.struct(x["words"].alias("words"), x["turn"].alias("turn")))
    by = by.withColumn("next", F.array_min(missing))
    by = by.withColumn("back", filled(F.reverse("took"), F.col("next.words") - F.col("fill.left")))
    swapped = F.array_append(F.array_except("took", "back.took"), F.struct(F.col("next.turn").alias("turn"), F.col("next.words").alias("words")))
    nearer = F.col("next").isNotNull() & (F.col("back.left") < F.col("fill.left"))
    out = by.select(F.col("source").alias("ds"), F.explode(F.when(nearer, swapped).otherwise(F.col("took"))).alias("x"))
    return out.select("ds", F.col("x.turn").alias("dt"))


def block_plan(sizes: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """source, block, source_size, target, copies and the output shards of each copy."""
    goal = targets(sizes)
    sums = sizes.groupBy("source", "block").agg(F.sum("size").alias("words")).withColumnRenamed("source", "s")
    b = sums.join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    b = b.withColumn("epochs", whole.cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    of = Window.partitionBy("source")
    b = b.withColumn("turn", F.row_number().over(of.orderBy(F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("block")), "block")))
    b = b.withColumn("upto", F.sum("words").over(of.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
    b = staged(b, "mix_blocks")
    fit = _drawn(b)
    b = b.join(fit, F.col("source").eqNullSafe(F.col("ds")) & (F.col("turn") == F.col("dt")), "left")
    # blocks without words go by their turn; where no part epoch is left, as at twice the source, none is drawn
    blank = (F.col("words") == 0) & ((F.col("source_size") == 0) | ((F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))))
    b = b.withColumn("drawn", F.col("dt").isNotNull() | blank)
    b = staged(b.withColumn("copies", F.col("epochs") + F.col("drawn").cast("int")).select("source", "block", "source_size", "target", "rank", "copies"), "mix_drawn")

    units = b.where("copies > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    place = F.row_number().over(of.orderBy(F.xxhash64(F.lit(seed + 2), F.col("block"), F.col("copy")), "block", "copy"))
    units = units.withColumn("place", place)
    counts = staged(b.groupBy("source", "rank").agg(F.sum(F.col("copies").cast("long")).alias("own")), "mix_counts")
    quota = splitting_tree(counts.where("own > 0").select(F.col("rank").cast("long").alias("rank"), "own"), shards, seed, counts.count())
    quota = quota.join(bounded_broadcast(counts.select("rank", F.col("source").alias("qs"))), "rank")
    quota = quota.withColumn("last", F.sum("quota").over(Window.partitionBy("qs").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)))
    places = quota.select("qs", "shard", F.explode(F.sequence(F.col("last") - F.col("quota") + 1, F.col("last"))).alias("at"))
    dealt = units.join(places, units["source"].eqNullSafe(places["qs"]) & (units["place"] == places["at"]))
    dealt = dealt.groupBy(F.col("source").alias("ds"), F.col("block").alias("db")).agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    plan = b.drop("rank").join(dealt, F.col("source").eqNullSafe(F.col("ds")) & (F.col("block") == F.col("db")), "left").drop("ds", "db")
    return plan.withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))


def sized(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    return staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _block(F.col("doc_id"), blocks, seed).alias("block")), "mix_sizes")


def _joined(rows: DataFrame, plan: DataFrame, broadcast_bytes: int) -> DataFrame:
    plan = bounded_broadcast(staged(plan, "mix_plan"), broadcast_bytes)
    plan = plan.select(F.col("source").alias("__s"), F.col("block").alias("__b"), *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "copies", "shards")])
    return rows.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")), "left")


def taken(docs: DataFrame, blocks: int = 1024, shards: int = 16, seed: int = 7, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, size, source_size, target, taken and the shards of the copies, for every row of ``docs``."""
    sizes = sized(docs, blocks, seed)
    out = _joined(sizes.withColumnRenamed("block", "__block"), block_plan(sizes, shards, seed), broadcast_bytes)
    return out.select("doc_id", "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).cast("long").alias("taken"), F.col("__shards").alias("shards"))


def mixed(docs: DataFrame, blocks: int = 1024, shards: int = 16, seed: int = 7, broadcast_bytes: int = 64 << 20, shard_column: str | None = None) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, in shard order, shuffled within each shard.

    Sorting runs by ranges of (shard, hash), so a shard of any size spreads over several tasks.
    """
    sizes = sized(docs, blocks, seed)
    rows = docs.withColumn("__block", _block(F.col("doc_id"), blocks, seed))
    out = _joined(rows, block_plan(sizes, shards, seed), broadcast_bytes)
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.posexplode("__shards").alias("__copy", "__shard"))
    out = out.withColumn("__order", F.xxhash64(F.lit(seed + 3), F.col("doc_id"), F.col("__copy")))
    out = out.repartitionByRange("__shard", "__order").sortWithinPartitions("__shard", "__order")
    out = out.withColumnRenamed("__shard", shard_column) if shard_column else out.drop("__shard")
    return out.drop("__copy", "__order")
