"""Wrong answers for quiz words: several strategies with weighted shares, for a stated set of target words against all words.

Each strategy ranks candidates for each target; the shares are filled in the order of the weights, and what one
strategy cannot supply goes to the next and at last to chance. Part of speech and band of difficulty hold for all of
them. No strategy compares every target with every word: lookalikes meet through their rarer trigrams, words of a
field and chance ones are drawn from a circle (``ring``), and meanings are compared in blocks of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import cosine_distance, trigrams
from ..plans.staging import settled, shuffled
from .ring import after, counted, first, follow
from .vectors import compared

CELL = 10.0  # width of a cell of difficulty
FLOORS = (0.75, 0.5)  # of similarity, tried before the rule's
PAIR = "array<struct<word:bigint,s:int>>"


@dataclass(frozen=True)
class Rule:
    """How many wrong answers, from where, and what no answer may be.

    ``share`` of the answers comes from the ``weights``' strategies, the rest from chance. Words within ``reach`` of the
    target's difficulty count; for targets that stay short it is widened by ``widen``. Words nearer in meaning than
    ``floor`` are too right to be wrong, whoever proposes them; words without a vector pass.
    """

    count: int = 3
    share: float = 0.7
    weights: tuple[tuple[str, float], ...] = (("orthographic", 1 / 3), ("semantic", 1 / 3), ("domain", 1 / 3))
    reach: float = 15.0
    widen: float = 15.0
    floor: float = 0.20
    near: tuple[float, float] = (0.15, 0.45)
    alike: float = 0.3
    defined: bool = False
    seed: int = 1

    def quotas(self) -> list[tuple[str, int]]:
        """The strategies in order and how many answers there may be up to and with each.

        The smart share is allotted by largest remainders, ties to the greater weight, then to the first named.
        """
        smart, active = round(self.count * self.share), [(n, w) for n, w in self.weights if w > 0]
        active.sort(key=lambda x: -x[1])
        exact = [smart * w / sum(w for _, w in active) for _, w in active]
        given = [int(x + 1e-9) for x in exact]
        for i in sorted(range(len(exact)), key=lambda i: (-round(exact[i] - given[i], 9), i))[: max(0, smart - sum(given)) if active else 0]:
            given[i] += 1
        upto = [(n, sum(given[: i + 1])) for i, (n, _) in enumerate(active)]
        return [*upto, ("random", self.count)]


class Draw:
    """One batch: words and targets (both id, lemma, part_of_speech, difficulty, fields, vector), and forbidden pairs.

    ``defined`` is read too where the rule asks for words with a definition. ``banned`` are tables (target, word):
    synonyms, words already used.
    """

    def __init__(self, words: DataFrame, targets: DataFrame, rule: Rule, banned: list[DataFrame] | None = None):
        self.rule = rule
        own = words.where("difficulty is not null" + (" and defined" if rule.defined else ""))
        self.pool = own.select(F.col("id").cast("long").alias("word"), "lemma", F.col("part_of_speech").alias("pos"), "difficulty", "fields")
        asked = targets.where("difficulty is not null").select(F.col("id").cast("long").alias("target"), "lemma", F.col("part_of_speech").alias("pos"), F.col("difficulty").alias("td"), "fields")
        self.asked = settled(asked.dropDuplicates(["target"]))
        self.vectors = words.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
        self.meant = targets.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector").dropDuplicates(["id"])
        self.banned = [settled(b.select(F.col("target").cast("long").alias("target"), F.col("word").cast("long").alias("word")).distinct()) for b in banned or []]

    def banded(self, widen: float = 0.0) -> DataFrame:
        reach = self.rule.reach + widen
        return self.asked.select("*", (F.col("td") - reach).alias("low"), (F.col("td") + reach).alias("high"))

    def allowed(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (target, word, ...) that are not banned and not too near in meaning."""
        for b in self.banned:
            pairs = pairs.join(shuffled(b), ["target", "word"], "left_anti")
        one = self.vectors.select(F.col("id").alias("word"), F.col("vector").alias("__w"))
        two = self.meant.select(F.col("id").alias("target"), F.col("vector").alias("__t"))
        out = pairs.join(one, "word", "left").join(two, "target", "left")
        close = F.round(cosine_distance(F.col("__w"), F.col("__t")), 6) < self.rule.floor
        return out.where(~F.coalesce(close, F.lit(False))).drop("__w", "__t")

    def lookalikes(self, asked: DataFrame, need: int) -> DataFrame:
        """Words whose trigrams' similarity is above the rule's, the most alike first.

        They are sought above high floors first, which look up few and rare trigrams: a target with ``need`` allowed words above
        a floor has its first ones, and only the others go on to the next floor, at last to the rule's.
        """
        words = self.pool.select("word", "pos", "difficulty", F.floor(F.col("difficulty") / CELL).cast("int").alias("cell"), trigrams(F.col("lemma")).alias("grams"))
        words = settled(words)
        times = settled(words.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")))
        left, done = asked, None
        for floor in [x for x in FLOORS if x > self.rule.alike]:
            found = settled(counted(self.alike(left, words, times, need, floor), "target"))
            held = found.where(F.col("n") >= need).drop("n")
            done = held if done is None else done.unionByName(held)
            left = settled(left.join(shuffled(held.select("target").distinct()), "target", "left_anti"))
            if not left.limit(1).count():
                return done
        rest = self.alike(left, words, times, need, self.rule.alike)
        return rest if done is None else done.unionByName(rest)

    def alike(self, asked: DataFrame, words: DataFrame, times: DataFrame, need: int, floor: float) -> DataFrame:
        """(target, word, nth): the first ``need`` words whose similarity is above ``floor``: such two share one of their rarer trigrams.

        Of n trigrams all but ceil(floor * n) - 1 are looked up, the rarest first.
        """
        rule = self.rule
        cells = F.explode(F.sequence(F.floor(F.col("low") / CELL).cast("int"), F.floor(F.col("high") / CELL).cast("int")))

        def looked_up(rows: DataFrame, key: str) -> DataFrame:
            held = rows.select(key, F.explode("grams").alias("g")).distinct().join(times, "g", "left").select(key, F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g").alias("x"))
            grams = held.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("xs"))
            most = F.size("xs") - F.ceil(F.lit(floor) * F.size("xs") - 1e-9).cast("int") + 1
            return grams.select(key, F.explode(F.slice("xs", F.lit(1), most)).alias("x")).select(key, F.col("x.g").alias("g"))

        left = asked.select("target", "pos", "low", "high", cells.alias("cell"), trigrams(F.col("lemma")).alias("tgrams"))
        left = left.join(shuffled(looked_up(asked.select("target", trigrams(F.col("lemma")).alias("grams")), "target")), "target")
        right = words.join(shuffled(looked_up(words, "word")), "word")
        keys = ["pos", "cell", "g"]  # few bytes make many pairs: a stated number of tasks, which Spark does not merge by their bytes
        tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = left.repartition(tasks, *keys).join(shuffled(right.repartition(tasks, *keys)), keys).where((F.col("word") != F.col("target")) & F.col("difficulty").between(F.col("low"), F.col("high")))
        alike = F.round(F.size(F.array_intersect("grams", "tgrams")) / F.size(F.array_union("grams", "tgrams")), 6)
        pairs = pairs.select("target", "word", alike.alias("alike")).where(F.col("alike") > floor).distinct()
        return first(self.allowed(pairs), "target", need, F.desc("alike"), after(F.col("word"), F.col("target"), rule.seed), "word").select("target", "word", "nth")

    def related(self, asked: DataFrame, need: int) -> DataFrame:
        """Words whose distance in meaning lies in the rule's band, the nearest first."""
        low, high = self.rule.near
        spare = max([b.groupBy("target").count().agg(F.max("count")).first()[0] or 0 for b in self.banned], default=0)
        known = self.vectors.join(shuffled(self.pool), F.col("id") == F.col("word")).select("id", F.col("pos").alias("label"), "vector", F.col("difficulty").alias("value"))
        seeds = self.meant.join(shuffled(asked), F.col("id") == F.col("target")).select("id", F.col("pos").alias("label"), "vector", "low", "high")
        near = compared(known, seeds, need + spare, same_label=True, low=max(low, self.rule.floor), high=high, within=True)
        pairs = near.select(F.col("query_id").alias("target"), F.col("id").alias("word"), "distance")
        for b in self.banned:
            pairs = pairs.join(shuffled(b), ["target", "word"], "left_anti")
        return first(pairs, "target", need, "distance", "word").select("target", "word", "nth")

    def ring(self, asked: DataFrame, need: int, by_field: bool = False) -> DataFrame:
        """The first ``need`` words behind each target on the circle; only words of a common field if ``by_field``."""
        keys = ["pos", *["field"] * by_field, "cell"]
        spread = (lambda d: d.withColumn("field", F.explode(F.array_distinct("fields")))) if by_field else (lambda d: d)
        words = spread(self.pool).withColumn("cell", F.floor(F.col("difficulty") / CELL).cast("int")).select(F.col("word").alias("item"), *keys, "difficulty")
        cells = F.explode(F.sequence(F.floor(F.col("low") / CELL).cast("int"), F.floor(F.col("high") / CELL).cast("int")))
        looks = spread(asked).withColumn("cell", cells).select(F.col("target").alias("asker"), *keys, "low", "high")
        fits = (F.col("item") != F.col("asker")) & F.col("difficulty").between(F.col("low"), F.col("high"))
        keep = lambda d: self.allowed(d.withColumnsRenamed({"asker": "target", "item": "word"})).withColumnsRenamed({"target": "asker", "word": "item"})
        found = follow(words.where("pos is not null").dropDuplicates(["item", *keys]), looks, keys, need, self.rule.seed, fits, keep)
        return found.select(F.col("asker").alias("target"), F.col("item").alias("word"), "nth")

    def ranked(self, need: int) -> DataFrame:
        """(target, word, s, nth): the first ``need`` candidates of each of the rule's strategies, s being its place in ``quotas``."""
        asked, out = self.banded(), None
        ways = {"orthographic": lambda: self.lookalikes(asked, need), "semantic": lambda: self.related(asked, need), "domain": lambda: self.ring(asked, need, True), "random": lambda: self.ring(asked, need)}
        for s, (name, _) in enumerate(self.rule.quotas()):
            rows = ways[name]().withColumn("s", F.lit(s))
            out = rows if out is None else out.unionByName(rows)
        return out

    def picked(self) -> DataFrame:
        """(target, word, strategy, place, degraded) of every target that gets an answer; ``degraded`` if its band was too poor."""
        rule, quotas = self.rule, self.rule.quotas()
        need = 2 * rule.count  # a list may hold all words that others took before

        def filled(rows: DataFrame, begun: DataFrame) -> DataFrame:
            lists = rows.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("s", "nth", "word"))).alias("list"))
            upto = F.array(*[F.lit(n) for _, n in quotas])
            put = lambda acc, e: F.when((F.size(acc) < F.get(upto, e["s"])) & ~F.exists(acc, lambda x: x["word"] == e["word"]), F.array_append(acc, F.struct(e["word"].alias("word"), e["s"].alias("s")))).otherwise(acc)
            return begun.join(shuffled(lists), "target", "left").select("target", F.when(F.col("list").isNull(), F.col("got")).otherwise(F.aggregate("list", F.col("got"), put)).alias("got"))

        none = F.array().cast(PAIR)
        taken = settled(filled(self.ranked(need), self.asked.select("target", none.alias("got"))))
        short = settled(taken.where(F.size("got") < rule.count).select("target", F.col("got").alias("had")))
        wide = self.ring(self.banded(rule.widen).join(shuffled(short.select("target")), "target", "left_semi"), need)
        more = filled(wide.withColumn("s", F.lit(len(quotas) - 1)), short.select("target", F.col("had").alias("got")))
        rows = taken.where(F.size("got") >= rule.count).select("target", "got", F.lit(False).alias("degraded")).unionByName(more.withColumn("degraded", F.lit(True)))
        rows = rows.select("target", "degraded", F.posexplode("got").alias("pos", "x"))
        return rows.select("target", "x.word", F.get(F.array(*[F.lit(n) for n, _ in quotas]), F.col("x.s")).alias("strategy"), (F.col("pos") + 1).alias("place"), "degraded")


def distractors(words: DataFrame, targets: DataFrame, rule: Rule = Rule(), banned: list[DataFrame] | None = None) -> DataFrame:
    """(target, word, strategy, place, degraded) for each word of ``targets``, as ``Draw`` says."""
    return Draw(words, targets, rule, banned).picked()
