"""Quiz sessions: questions in a row in which no word occurs twice, whether asked for or shown as a wrong answer.

A session draws a pool of words from the circle (``ring``). For each of these all strategies of ``distractors`` rank more
candidates than a session can use up, so that the questions of a session can be filled one after the other from
its own bounded rows: a word that an earlier question used is passed over, and the shares are filled from what is left.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..plans.staging import settled, shuffled
from .distractors import Draw, Rule
from .listing import hashed
from .ring import follow

KINDS = ("choice", "truth", "matching")


@dataclass(frozen=True)
class Plan:
    """What a session is made of: ``length`` questions of ``kinds``, ``choices`` options, ``pairs`` to match."""

    length: int = 10
    kinds: tuple[str, ...] = KINDS
    choices: int = 4
    pairs: int = 4
    seed: int = 1

    @property
    def pool(self) -> int:
        return self.length * (self.pairs + 2) + 20

    @property
    def most_used(self) -> int:
        return self.length * max(self.choices, self.pairs)


def filled(pool: list[tuple[int, str, bool, list[int], list[int]]], plan: Plan, rule: Rule) -> list[tuple[int, str, int, list[int], bool, bool]]:
    """The questions (seq, kind, target, others, is_true, degraded) of one session.

    ``pool`` holds (word, kind, is_true, places, candidates) in order; the candidates are sorted by their strategy's place,
    the widened band coming last.
    """
    shares = {n: [q for _, q in replace(rule, count=n).quotas()] for n in {plan.choices - 1, plan.pairs - 1, 1}}
    used: set[int] = set()
    out = []
    for word, kind, is_true, places, candidates in pool:
        if len(out) == plan.length:
            break
        if word in used:
            continue
        n = {"choice": plan.choices - 1, "matching": plan.pairs - 1}.get(kind, 0 if is_true else 1)
        others: list[int] = []
        within = 0  # of them from the rule's own band
        if n:
            upto = [*shares[n], n]
            for s, other in zip(places, candidates):
                if len(others) < upto[s] and other not in used and other not in others:
                    others.append(other)
                    within += s < len(upto) - 1
            if not others:
                continue
        out.append((len(out) + 1, kind, word, others, is_true, within < n))
        used.update([word, *others])
    return out


def sessions(asked: DataFrame, words: DataFrame, plan: Plan = Plan(), rule: Rule = Rule(), banned: list[DataFrame] | None = None) -> DataFrame:
    """(session, seq, kind, target, others, is_true, degraded): the questions of each session of ``asked`` (session).

    ``words`` are as in ``distractors.Draw``. ``others`` are the wrong answers in the order they were picked; ``is_true`` is
    set for truth questions only. A word without any wrong answer left makes no question. Rows of ``asked`` that repeat
    a session are one; null sessions have no questions.
    """
    words = settled(words)
    items = words.where("difficulty is not null" + (" and defined" if rule.defined else "")).select(F.col("id").cast("long").alias("item"), F.lit(0).alias("all"))
    askers = asked.where("session is not null").select(F.col("session").alias("asker"), F.lit(0).alias("all")).distinct()
    pool = settled(follow(items, askers, ["all"], plan.pool, plan.seed))
    targets = words.join(shuffled(pool.select(F.col("item").alias("id")).distinct()), "id", "left_semi")
    draw = Draw(words, targets, rule, banned)
    need = max(plan.choices, plan.pairs) + plan.most_used
    ranks = draw.ranked(need).unionByName(draw.ring(draw.banded(rule.widen), need).withColumn("s", F.lit(len(rule.quotas()))))
    lists = settled(ranks.groupBy(F.col("target").alias("item")).agg(F.sort_array(F.collect_list(F.struct("s", "nth", "word"))).alias("list")))
    turn = hashed(F.concat_ws(":", "asker", "item"), plan.seed)
    kind = F.element_at(F.array(*map(F.lit, plan.kinds)), (F.conv(F.left(turn, F.lit(8)), 16, 10).cast("long") % len(plan.kinds) + 1).cast("int"))
    rows = pool.join(shuffled(lists), "item", "left").select(
        F.col("asker").alias("session"), "nth", F.col("item").alias("word"), kind.alias("kind"), (F.substring(turn, 9, 1) < "8").alias("is_true"),
        F.coalesce(F.col("list.s"), F.array().cast("array<int>")).alias("places"), F.coalesce(F.col("list.word"), F.array().cast("array<long>")).alias("candidates"))

    def assemble(pdf):
        import pandas as pd

        pdf = pdf.sort_values("nth")
        made = filled(list(zip(pdf["word"], pdf["kind"], pdf["is_true"], pdf["places"], pdf["candidates"])), plan, rule)
        return pd.DataFrame([(pdf["session"].iloc[0], *m) for m in made], columns=["session", "seq", "kind", "target", "others", "is_true", "degraded"])

    kind_of = dict(rows.dtypes)["session"]
    out = rows.groupBy("session").applyInPandas(assemble, f"session {kind_of}, seq int, kind string, target long, others array<long>, is_true boolean, degraded boolean")
    return out.withColumn("is_true", F.when(F.col("kind") == "truth", F.col("is_true")))
