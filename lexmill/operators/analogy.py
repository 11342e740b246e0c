"""Analogies a : b :: c : ?, their right answers and their wrong ones, for a stated set of words at once.

Terms are words of the vocabulary or ordinary ones. An edge (a, b) states a relation of a family; only verified ones are
tested or serve as anchors. A word c is tested with one of its edges (c, d): d is a word too (vocab_only) or an ordinary
term (one_hard_term), and the anchor (a, b) is another edge of the family between terms of the same kind as d, which
shares no term with it. Anchors are drawn from a circle (``ring``), so an edge gets one if there is any.

What else would be right is no wrong answer: all that stands in the relation to c, d and its synonyms. What stands in the
relation to a or b is the best wrong answer, a trap, unless it is true of nearly everything. After the traps come, for
vocab_only, the words nearest to b - a + c, for one_hard_term the other children of d's parents, and at last any
word, or ordinary term, of d's part of speech. None may be nearer in meaning to d than ``floor``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import cosine_distance
from ..plans.staging import settled
from . import relate
from .edges import GENERIC, siblings
from .listing import hashed
from .ring import after, first, follow
from .vectors import compared

STYLES = ("vocab_only", "one_hard_term")


def fanout(edges: DataFrame, transitive: tuple[str, ...]) -> DataFrame:
    """(term, relation, other): all that stands in a relation to a term, through any number of steps for ``transitive`` ones."""
    direct = edges.where(~F.col("relation").isin(*transitive)).select(F.col("a").alias("term"), "relation", F.col("b").alias("other"))
    out = direct
    for name in transitive:
        up = relate.closure(edges.where(F.col("relation") == name).select("a", "b"), "a", "b")
        out = out.unionByName(up.select(F.col("node").alias("term"), F.lit(name).alias("relation"), F.col("ancestor").alias("other")))
    return out.where("term <> other").distinct()


def styled(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """``edges`` (id, a, b, relation, family) with ``va`` and ``vb``: whether their ends are words of the vocabulary."""
    known = terms.select(F.col("term").alias("__t"), F.col("vocab").alias("__v"))
    for end in "ab":
        edges = edges.join(known, F.col(end) == F.col("__t")).withColumn(f"v{end}", F.col("__v")).drop("__t", "__v")
    return edges


def anchored(edges: DataFrame, terms: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """(edge, style, relation, a, b, c, d): every verified edge (c, d) of a word of ``targets`` (term) with an anchor (a, b).

    ``terms`` has term and vocab; ``edges`` are the verified ones. An edge without any anchor is left out.
    """
    marked = settled(styled(edges, terms))
    style = F.when(F.col("vb"), STYLES[0]).otherwise(STYLES[1])
    pool = marked.where("va = vb").select(F.col("id").alias("item"), "family", style.alias("style"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    tested = marked.where("va").join(targets.select(F.col("term").alias("a")).distinct(), "a", "left_semi")
    asked = tested.select(F.col("id").alias("asker"), "family", style.alias("style"), F.col("a").alias("c"), F.col("b").alias("d"))
    apart = ~F.col("pa").isin(F.col("c"), F.col("d")) & ~F.col("pb").isin(F.col("c"), F.col("d"))
    found = follow(pool, asked, ["family", "style"], 1, seed, apart)
    anchor = marked.select(F.col("id").alias("item"), "a", "b")
    out = found.join(anchor, "item").select(F.col("asker").alias("edge"), "a", "b")
    return out.join(tested.select(F.col("id").alias("edge"), style.alias("style"), "relation", F.col("a").alias("c"), F.col("b").alias("d")), "edge").select("edge", "style", "relation", "a", "b", "c", "d")


def items(anchored: DataFrame, seed: int = 1) -> DataFrame:
    """One question for each c of ``anchored``: the style that a hash of c prefers if it can be had, then the first edge by hash."""
    prefers = F.when(F.substring(hashed(F.col("c"), seed), 1, 1) < "8", STYLES[0]).otherwise(STYLES[1])
    order = F.struct((F.col("style") != prefers).alias("other"), hashed(F.col("edge"), seed).alias("h"), "edge")
    return anchored.groupBy("c").agg(F.min_by(F.struct("edge", "style", "relation", "a", "b", "d"), order).alias("q")).select("c", "q.*")


def answers(questions: DataFrame, known: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(c, term): all right answers of each question. ``known`` is a fanout; where c has none, that of d stands in. ``synonyms``: (term, other)."""
    q = questions.select("c", "d", "relation")
    fan = known.select(F.col("term").alias("of"), F.col("relation").alias("how"), "other")
    own = q.join(fan, (F.col("c") == F.col("of")) & (F.col("relation") == F.col("how"))).select("c", F.col("other").alias("answer"))
    bare = q.join(own.select("c").distinct(), "c", "left_anti")
    other = bare.join(fan, (F.col("d") == F.col("of")) & (F.col("relation") == F.col("how"))).select("c", F.col("other").alias("answer"))
    same = q.join(synonyms, F.col("d") == F.col("term")).select("c", F.col("other").alias("answer"))
    return own.unionByName(other).unionByName(same).unionByName(q.select("c", F.col("d").alias("answer"))).distinct().select("c", F.col("answer").alias("term"))


def options(questions: DataFrame, terms: DataFrame, edges: DataFrame, known: DataFrame, synonyms: DataFrame, vectors: DataFrame, parent: str, count: int = 3, floor: float = 0.20, seed: int = 1) -> DataFrame:
    """(c, term, strategy, place, degraded): ``count`` wrong answers of each question, as the module says.

    ``terms`` has term, lemma, pos and vocab; ``vectors`` id and vector of words; ``parent`` names the relation whose
    children are siblings. ``questions`` has one row for each c.
    """
    questions = settled(questions)
    pos = terms.select(F.col("term").alias("d"), F.col("pos").alias("dpos"))
    q = settled(questions.join(pos, "d"))
    right = settled(answers(questions, known, synonyms))
    slots = q.select("c", F.explode(F.array("a", "b", "c", "d")).alias("term"))
    meaning = vectors.select(F.col("id").alias("__i"), "vector")

    def fair(rows: DataFrame) -> DataFrame:
        """Rows (c, term) of the right part of speech that are neither right, nor in the question, nor too near to d."""
        rows = rows.join(right, ["c", "term"], "left_anti").join(slots, ["c", "term"], "left_anti")
        rows = rows.join(q.select("c", "d", "dpos"), "c").join(terms.select("term", F.col("pos").alias("tpos")), "term").where("tpos = dpos")
        rows = rows.join(meaning.withColumnsRenamed({"__i": "d", "vector": "dv"}), "d", "left").join(meaning.withColumnsRenamed({"__i": "term", "vector": "tv"}), "term", "left")
        close = F.round(cosine_distance(F.col("dv"), F.col("tv")), 6) < floor
        return rows.where(~F.coalesce(close, F.lit(False))).drop("d", "dpos", "tpos", "dv", "tv")

    ends = q.select("c", "relation", F.explode(F.array("a", "b")).alias("end"))
    fan = known.select(F.col("term").alias("of"), F.col("relation").alias("how"), "other")
    traps = ends.join(fan, (F.col("end") == F.col("of")) & (F.col("relation") == F.col("how"))).select("c", F.col("other").alias("term")).distinct()
    dull = terms.where(F.lower("lemma").isin(*GENERIC)).select("term")
    traps = fair(traps.join(dull, "term", "left_anti")).join(terms.select("term", "lemma"), "term")
    traps = first(traps, "c", count, "lemma", "term").select("c", "term", "nth", F.lit("analogy_trap").alias("strategy"), F.lit(0).alias("tier"))

    need = 2 * count
    v = lambda end: meaning.withColumnsRenamed({"__i": end, "vector": f"v{end}"})
    ask = q.where(F.col("style") == STYLES[0]).join(v("a"), "a").join(v("b"), "b").join(v("c"), "c")
    point = F.zip_with(F.zip_with("vb", "va", lambda x, y: x - y), "vc", lambda x, y: x + y)
    spare = 4 + (right.groupBy("c").count().agg(F.max("count")).first()[0] or 0)
    words = terms.where("vocab").join(meaning, F.col("term") == F.col("__i")).select(F.col("term").alias("id"), F.col("pos").alias("label"), "vector")
    close = meaning.join(q.select(F.col("d").alias("__d"), "dpos").distinct(), F.col("__i") == F.col("__d")).select(F.col("__i").alias("id"), F.col("dpos").alias("label"), "vector")
    near_d = compared(words, close, same_label=True, high=floor).groupBy("query_id").count().agg(F.max("count")).first()[0] or 0 if floor > 0 else 0
    near = compared(words, ask.select(F.col("c").alias("id"), F.col("dpos").alias("label"), point.alias("vector")), need + spare + near_d, same_label=True)
    near = fair(near.select(F.col("query_id").alias("c"), F.col("id").alias("term"), "distance"))
    near = first(near, "c", need, "distance", "term").select("c", "term", "nth", F.lit("embedding_offset").alias("strategy"), F.lit(1).alias("tier"))

    hard = q.where(F.col("style") == STYLES[1])
    kin = siblings(edges.where(F.col("relation") == parent), "a", "b", hard.select(F.col("d").alias("term")).distinct())
    kin = fair(hard.select("c", "d").join(kin, F.col("d") == F.col("term")).select("c", F.col("sibling").alias("term")))
    kin = first(kin, "c", need, after(F.col("term"), F.col("c"), seed), "term").select("c", "term", "nth", F.lit("sibling_fanout").alias("strategy"), F.lit(1).alias("tier"))

    keep = lambda d: fair(d.withColumnsRenamed({"asker": "c", "item": "term"})).withColumnsRenamed({"c": "asker", "term": "item"})
    pool = terms.select(F.col("term").alias("item"), "pos", "vocab")
    asked = q.select(F.col("c").alias("asker"), F.col("dpos").alias("pos"), (F.col("style") == STYLES[0]).alias("vocab"))
    chance = follow(pool, asked, ["pos", "vocab"], 3 * count, seed, F.col("item") != F.col("asker"), keep)
    chance = chance.join(asked.select("asker", "vocab"), "asker").select(F.col("asker").alias("c"), F.col("item").alias("term"), "nth", F.when(F.col("vocab"), "random").otherwise("random_ordinary").alias("strategy"), F.lit(2).alias("tier"))

    rows = traps.unionByName(near).unionByName(kin).unionByName(chance)
    rows = rows.groupBy("c", "term").agg(F.min(F.struct("tier", "nth", "strategy")).alias("s"))
    rows = first(rows.select("c", "term", "s.*"), "c", count, "tier", "nth").withColumnRenamed("nth", "place")
    size = rows.groupBy("c").agg(F.count("*").alias("n"))
    return rows.join(size, "c").select("c", "term", "strategy", "place", (F.col("n") < count).alias("degraded"))
