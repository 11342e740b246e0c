"""Relations that definitions state: token patterns over words and parts of speech, taken to the head of their phrase.

Tokens are written as ``<word|lemma|POS>`` one after the other, so that a pattern is a regular expression over tokens; all
patterns run over a definition where it stands, without Python. Parts of speech come from a lexicon, then from the
endings of the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The words of each place of a pattern; ADJ*, ADV*, NOUN+ and VERB+ stand for runs of a part of speech, a ? for a word that may lack.
PATTERNS = (
    ("is_a", "a|an", "kind|type|sort", "of", "ADJ*", "NOUN+"),
    ("agentive", "one|person|someone", "who", "ADV*", "VERB+"),
    ("part_of", "part", "of", "a|an|the?", "ADJ*", "NOUN+"),
    ("purpose", "used", "for|to", "VERB+"),
    ("relates_to", "of?", "or?", "relate|relates|related|relating|pertain|pertains|pertained|pertaining", "to", "a|an|the?", "ADJ*", "NOUN+"),
    ("resembling", "resemble|resembles|resembled|resembling", "a|an|the?", "ADJ*", "NOUN+"),
    ("resembling", "like", "a|an", "ADJ*", "NOUN+"),
    ("attribute", "have|has|had|having", "a|an|the?", "ADJ*", "NOUN+"),
    ("attribute", "characterize|characterizes|characterized|characterizing", "by", "a|an|the?", "ADJ*", "NOUN+"),
)
#: Words of closed classes.
CLOSED = {
    "DET": ("a", "an", "the", "this", "that", "these", "those", "some", "any", "each"), "ADP": ("of", "for", "to", "by", "like", "in", "on", "at", "from", "with", "into", "upon"),
    "PRON": ("one", "who", "someone", "something", "which", "it", "that"), "CCONJ": ("or", "and", "but"), "AUX": ("is", "are", "was", "were", "be", "been", "being"),
}
WORD = r"[a-z]+(?:['-][a-z]+)*+|[^\sa-z]"  # or a sign, which no pattern steps over


def _place(spec: str) -> str:
    token = lambda words, pos: rf"<(?:{words})\|[^>|]*\|(?:{pos})>"
    if spec.endswith(("*", "+")):
        pos = {"NOUN": "NOUN|PROPN"}.get(spec[:-1], spec[:-1])
        return f"(?:{token('[^>|]*', pos)}){spec[-1]}+"  # possessive: long runs take no stack
    return f"(?:{token(spec.rstrip('?'), '[A-Z]+')})" + ("?" if spec.endswith("?") else "")


def pattern(places: tuple[str, ...]) -> str:
    return "".join(map(_place, places))


#: The lemma of the last noun or verb of what a pattern found.
HEAD = r"(?s)^.*<[^>|]*\|([^>|]*)\|(?:NOUN|PROPN|VERB)>"


def tagged(definitions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, tokens): the words of each definition (id, definition) as one string of tokens.

    ``lexicon`` (word, lemma, pos) is taken first, the least row where a word has several; then the closed classes; then -ly
    makes an adverb, and all else is a noun. Without words the string is empty.
    """
    words = F.posexplode(F.regexp_extract_all(F.lower(F.coalesce("definition", F.lit(""))), F.lit(WORD), F.lit(0))).alias("at", "word")
    closed = F.lit(None).cast("string")
    for pos, members in CLOSED.items():
        closed = F.when(F.col("word").isin(*members), pos).otherwise(closed)
    rows = definitions.select("id", words).withColumn("closed", F.when(F.col("word").rlike("^[a-z]"), closed).otherwise("PUNCT"))
    rows = rows.withColumn("word", F.when(F.col("closed") == "PUNCT", ".").otherwise(F.col("word")))
    known = lexicon.groupBy(F.lower("word").alias("known")).agg(F.min(F.struct("lemma", "pos")).alias("l"))
    rows = rows.join(known, F.when(F.col("closed").isNull(), F.col("word")) == F.col("known"), "left")  # words of closed classes, the commonest, need no look
    guess = F.when(F.col("word").endswith("ly"), "ADV").otherwise("NOUN")
    token = F.concat(F.lit("<"), "word", F.lit("|"), F.coalesce(F.lower("l.lemma"), "word"), F.lit("|"), F.coalesce("closed", "l.pos", guess), F.lit(">"))
    found = rows.select("id", F.struct("at", token.alias("t")).alias("x")).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "").alias("tokens"))
    return definitions.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("tokens", F.lit("")).alias("tokens"))


def stated(tokens: Column) -> Column:
    """array of struct(relation, head) of all that the patterns find, once each."""
    def of(relation: str, places: tuple[str, ...]) -> Column:
        spans = F.regexp_extract_all(tokens, F.lit(pattern(places)), F.lit(0))
        return F.transform(spans, lambda s: F.struct(F.lit(relation).alias("relation"), F.regexp_extract(s, HEAD, 1).alias("head")))

    return F.array_distinct(F.flatten(F.array(*[of(r, places) for r, *places in PATTERNS])))


def definition_edges(definitions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, relation, target) of what each definition (id, lemma, definition) states, without edges of a word to itself."""
    rows = tagged(definitions, lexicon).select("id", F.explode(stated(F.col("tokens"))).alias("e"))
    own = definitions.select("id", F.lower("lemma").alias("own")).distinct()
    return rows.join(own, "id").where(~F.col("e.head").eqNullSafe(F.col("own")) & (F.col("e.head") != "")).select("id", "e.relation", F.col("e.head").alias("target")).distinct()
