"""Roots, dictionary senses, pronunciations and short labels: joins of words with reference tables, and text rules beside them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Affixes that one step takes off.
HEADS = ("un", "re", "over", "under", "dis", "mis", "out", "be", "en", "im", "in", "pre", "ir", "il", "non", "post", "sub", "super", "inter", "anti", "fore")
TAILS = ("edly", "ing", "ed", "es", "s", "er", "est", "ness", "less", "ly", "ure", "ment", "ish", "y", "d")
#: Genres that are one of the two kinds already.
KINDS = {"Fiction": ("Novel", "Fantasy", "Mystery"), "Nonfiction": ("History", "Biography", "Science")}


def roots(words: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """(lemma, root, root_zipf): the best known word (lemma, zipf) that one affix less, or a tail less with an e put back, gives.

    The commonest root wins, then the shorter, then the first in order.
    """
    w = F.col("lemma")
    tries = [F.when(w.startswith(h), F.substr(w, F.lit(len(h) + 1))) for h in HEADS]
    for t in TAILS:
        stem = F.when(w.endswith(t), F.substr(w, F.lit(1), F.length(w) - len(t)))
        tries += [stem, F.concat(stem, F.lit("e"))]
    found = F.filter(F.array_distinct(F.array(*tries)), lambda r: r.isNotNull() & (F.length(r) >= least))
    cand = words.select("lemma", F.explode(found).alias("root"))
    rows = cand.join(known.select(F.col("lemma").alias("root"), F.col("zipf").alias("root_zipf")), "root")
    best = rows.groupBy("lemma").agg(F.min(F.struct((-F.col("root_zipf")).alias("z"), F.length("root").alias("n"), "root")).alias("b"))
    return best.select("lemma", "b.root", (-F.col("b.z")).alias("root_zipf"))


def adjective_of(adverb: Column, known: Column) -> Column:
    """The first of the adjectives an adverb in -ly may come from that is in the array ``known``: whole, -y, -le, -ic; else null."""
    stem = F.when(adverb.endswith("ly"), F.substr(adverb, F.lit(1), F.length(adverb) - 2))
    tries = F.array(stem, F.when(adverb.endswith("ily"), F.concat(F.substr(adverb, F.lit(1), F.length(adverb) - 3), F.lit("y"))), F.concat(stem, F.lit("le")), F.when(adverb.endswith("ically"), F.substr(adverb, F.lit(1), F.length(adverb) - 4)))
    return F.get(F.filter(tries, lambda t: t.isNotNull() & F.array_contains(known, t)), F.lit(0))


def senses(lemmas: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(lemma, senses): all senses of each lemma in the dictionary (term, nth, definition), in its order."""
    d = dictionary.select(F.lower("term").alias("lemma"), F.struct("nth", "definition").alias("s"))
    rows = d.join(lemmas.select("lemma").distinct(), "lemma", "left_semi")
    return rows.groupBy("lemma").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["definition"]), " | ").alias("senses"))


def closed(ipa: Column) -> Column:
    """``ipa`` with the bracket it lacks at the end."""
    count = lambda c: F.length(ipa) - F.length(F.replace(ipa, F.lit(c), F.lit("")))
    return F.when(count("(") == count(")") + 1, F.concat(ipa, F.lit(")"))).otherwise(ipa)


def pronunciations(entries: DataFrame) -> DataFrame:
    """(headword, n, ipa) of entries (headword, ipa): the one pronunciation they agree on, or null where they differ."""
    rows = entries.where("ipa is not null and ipa <> ''").select(F.lower("headword").alias("headword"), closed(F.col("ipa")).alias("ipa"))
    return rows.groupBy("headword").agg(F.countDistinct("ipa").cast("int").alias("n"), F.when(F.countDistinct("ipa") == 1, F.min("ipa")).alias("ipa"))


def normal_ipa(ipa: Column) -> Column:
    """Without slashes, brackets, dots and ties; optional sounds in round brackets are dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(ipa, F.lit("")), r"\([^)]*\)", ""), r"[/\[\].͡ ]", ""))


def definition_text(definition: Column, synonyms: Column, sentence: Column) -> Column:
    """struct(text, source): the definition, else the synonyms, else the sentence."""
    joined = F.array_join(F.coalesce(synonyms, F.array().cast("array<string>")), ", ")
    filled = lambda x: F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit(""))
    text = F.coalesce(filled(definition), filled(joined), filled(sentence))
    source = F.when(filled(definition).isNotNull(), "definition").when(filled(joined).isNotNull(), "synonyms").when(filled(sentence).isNotNull(), "sentence")
    return F.struct(text.alias("text"), source.alias("source"))


def plain_markup(text: Column) -> Column:
    """Dictionary markup taken off: {it}x{/it} becomes x, {sx|x||} and {a_link|x} become x, {bc} a colon."""
    out = F.replace(text, F.lit("{bc}"), F.lit(": "))
    out = F.regexp_replace(out, r"\{[a-z_]+\|([^|}]*)[^}]*\}", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\{/?[a-z_]+\}", ""), r" +", " "))


def genres(raw: Column, known: tuple[str, ...]) -> Column:
    """The known genres of a raw list under their own spelling, once each; Fiction and Nonfiction go where a narrower genre says so."""
    table = F.create_map(*[F.lit(x) for g in known for x in (g.lower(), g)])
    named = F.array_distinct(F.filter(F.transform(raw, lambda g: table[F.lower(F.trim(g))]), lambda g: g.isNotNull()))
    for kind, narrower in KINDS.items():
        named = F.when(F.arrays_overlap(named, F.array(*map(F.lit, narrower))), F.array_remove(named, kind)).otherwise(named)
    return named


def subjects(rdf: Column) -> Column:
    """Subjects of a catalog record, once each, without class marks of one or two capitals."""
    found = F.regexp_extract_all(F.coalesce(rdf, F.lit("")), F.lit(r"<rdf:value>([^<]+)</rdf:value>"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda s: ~s.rlike("^[A-Z]{1,2}$")))


def prior(lemmas: DataFrame, domains: DataFrame, fields: DataFrame) -> DataFrame:
    """(lemma, field, n): how many of a lemma's domains (lemma, domain) point to each field (domain, field)."""
    return lemmas.select("lemma").distinct().join(domains.distinct(), "lemma").join(fields.distinct(), "domain").groupBy("lemma", "field").agg(F.count("*").alias("n"))


def without_possessives(words: DataFrame) -> DataFrame:
    """(id, lemma, root): words that are another word's possessive, and that word, as the difference a repair would make."""
    bare = F.regexp_replace(F.lower("lemma"), "['’]s?$", "")
    own = words.select(F.lower("lemma").alias("root")).distinct()
    return words.where(bare != F.lower("lemma")).select("id", "lemma", bare.alias("root")).join(own, "root").select("id", "lemma", "root")


def paragraphs(text: Column, most: int = 90_000) -> Column:
    """The text in chunks of whole paragraphs of at most ``most`` characters together; a longer paragraph is a chunk of its own."""
    none = F.array().cast("array<string>")
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\n+"), lambda p: p != "")

    def put(done, p):
        last = F.element_at(done, -1)
        joined = F.concat(last, F.lit("\n\n"), p)
        return F.when((F.size(done) > 0) & (F.length(last) + 2 + F.length(p) <= most), F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), joined)).otherwise(F.array_append(done, p))

    return F.aggregate(parts, none, put)


MANY = 64  # queries of a text from which bounds are worth their time


@F.pandas_udf(T.DoubleType())
def _best_window(asked: pd.Series, text: pd.Series, least: pd.Series) -> pd.Series:
    import re

    import numpy as np

    def grams(t: str) -> list[str]:
        return [f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", t.lower()) for i in range(len(w) + 1)]

    def one(a: set, b: list, spots: list, starts: list, least: float) -> float:
        """The greatest similarity of ``a`` with any stretch of ``b`` that begins at one of ``starts`` of the ``spots``, the places of ``a``, and ends at a spot; 0 if it is not above ``least``."""
        start = best = max(0.0, least - 1e-6)
        for nth in starts:
            i, last = spots[nth], nth + int(best * len(a) - 1e-9)  # with fewer spots a stretch holds too few of ``a``
            if last >= len(spots):
                break
            if len(a) < best * len(set(b[i : spots[last] + 1])):
                continue
            hit, all_ = set(), set()
            for j in range(i, spots[-1] + 1):
                if j > i and b[j] == b[i]:  # the stretch from the next such place on holds the same
                    break
                all_.add(b[j])
                if len(a) < best * len(all_):  # longer stretches can do no better
                    break
                if b[j] in a:
                    hit.add(b[j])
                    best = max(best, len(hit) / (len(a) + len(all_) - len(hit)))
        return best if best > start else 0.0

    def ends(b: list, most: int):
        """For each place, the first one that a stretch from there with at most ``most`` distinct trigrams does not reach."""
        held, out, end = {}, np.empty(len(b), np.int64), 0
        for i, x in enumerate(b):
            while end < len(b) and (len(held) < most or b[end] in held):
                held[b[end]] = held.get(b[end], 0) + 1
                end += 1
            out[i] = end
            held[x] -= 1
            if not held[x]:
                del held[x]
        return out

    def compared(rows: list[int], b: list, out) -> None:
        """The similarities of ``rows`` whose text has the trigrams ``b``.

        A stretch above a floor holds more than floor * |a| trigrams of ``a``. With n of them it has less than
        n * (1 + 1 / floor) - |a| in all, so that the best n of stretches of that size bounds the size again.
        """
        place = {x: i for i, x in enumerate(dict.fromkeys(b))}
        cut, reach = np.array([place[x] for x in b]), {}
        for i in range(0, len(rows), step := max(1, (1 << 22) // len(b))):
            some = rows[i : i + step]
            own = [sets[questions[r]] for r in some]
            known = [(n, place[x]) for n, a in enumerate(own) for x in a if x in place]
            held = np.zeros((len(some), len(place)), np.float32)
            if known:
                held[tuple(np.array(known).T)] = 1
            floor, size = np.array([max(0.0, floors[r] - 1e-6) for r in some]), np.array([len(a) for a in own])
            fits, most = held[:, cut] > 0, np.full(len(some), len(b))
            n = size
            for _ in range(2 if (floor > 0).any() and len(some) >= MANY else 0):
                with np.errstate(divide="ignore", over="ignore"):
                    most = np.minimum(most, np.ceil(n * (1 + 1 / np.maximum(floor, 1e-9)) - size + 1e-6))
                n = np.zeros(len(some))
                for d in np.unique(most[fits.any(axis=1)]):
                    which, d = np.flatnonzero((most == d) & fits.any(axis=1)), max(8, -(-int(d) // 8) * 8)  # few different ones
                    if d not in reach:
                        reach[d] = ends(b, d)
                    for at in range(0, len(b), part := max(1, (1 << 22) // len(place))):  # for each place, the trigrams of the stretch from there
                        upto = reach[d][at : at + part]
                        seen = np.zeros((upto[-1] - at + 1, len(place)), np.int32)
                        seen[np.arange(1, len(seen)), cut[at : upto[-1]]] = 1
                        np.cumsum(seen, axis=0, out=seen)
                        within = held[which] @ (seen[upto - at] > seen[: len(upto)]).T.astype(np.float32)
                        fits[which, at : at + part] &= within > (floor * size)[which, None] - 1e-6
                        n[which] = np.maximum(n[which], np.where(fits[which, at : at + part], within, 0).max(axis=1))
            for n in np.flatnonzero(fits.any(axis=1)):
                spots = np.flatnonzero(held[n, cut] > 0)
                out[some[n]] = one(own[n], b, spots.tolist(), np.flatnonzero(fits[n, spots]).tolist(), floors[some[n]])

    questions, texts, floors = [x or "" for x in asked], [x or "" for x in text], least.tolist()
    sets = {x: set(grams(x)) for x in set(questions)}
    out, begin = np.zeros(len(texts)), 0
    for end in range(1, len(texts) + 1):
        if end == len(texts) or texts[end] != texts[begin]:  # the rows of a text
            b = grams(texts[begin])
            if b:
                compared(list(range(begin, end)), b, out)
            begin = end
    return pd.Series(out, dtype=float)


def window_similarity(asked: Column, text: Column, least: float = 0.0) -> Column:
    """Trigram similarity of ``asked`` with the stretch of ``text`` that is most like it, 0 where that is not above ``least``; nulls count as empty."""
    return _best_window(asked, text, F.lit(float(least)))
