"""Dictionary volumes: entries cut into parts of speech, etymology, senses and quotations; pronunciations in three notations; model replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import settled

#: Abbreviations of parts of speech that may follow a headword; their dots may lack.
LABELS = ("a", "adj", "adv", "n", "v", "vb", "v.i", "v.t", "sb", "ppl. a", "pa. pple", "pa. t", "prep", "conj", "int", "pron", "comb. form")
LABEL = "(?:" + "|".join(x.replace(". ", r"\.?\s*").replace(".i", r"\.i").replace(".t", r"\.t") for x in sorted(LABELS, key=lambda x: (-len(x), x))) + ")"
#: The years that a quotation may bear.
YEARS = (1000, 2029)
#: The phones of American English and their signs.
ARPA_CONSONANTS = {
    "B": "b", "CH": "tʃ", "D": "d", "DH": "ð", "F": "f", "G": "ɡ", "HH": "h", "JH": "dʒ", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ŋ", "P": "p",
    "R": "ɹ", "S": "s", "SH": "ʃ", "T": "t", "TH": "θ", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
#: Vowels likewise.
ARPA_VOWELS = {
    "AA": "ɑ", "AE": "æ", "AH": "ʌ", "AO": "ɔ", "AW": "aʊ", "AY": "aɪ", "EH": "ɛ", "ER": "ɝ", "EY": "eɪ", "IH": "ɪ", "IY": "i", "OW": "oʊ",
    "OY": "ɔɪ", "UH": "ʊ", "UW": "u",
}
#: Respelling signs of vowels, the longer before the shorter.
SPELLED_VOWELS = {
    "âr": "ɛər", "îr": "ɪər", "ôr": "ɔːr", "ûr": "ɜːr", "oo͝": "ʊ", "oo͞": "uː", "ər": "ər", "oi": "ɔɪ", "ou": "aʊ", "ā": "eɪ", "ä": "ɑː", "ē": "iː",
    "ī": "aɪ", "ō": "oʊ", "ô": "ɔː", "ă": "æ", "ĕ": "ɛ", "ĭ": "ɪ", "ŏ": "ɒ", "ŭ": "ʌ", "ə": "ə",
}
#: Respelling signs of consonants.
SPELLED_CONSONANTS = {
    "ᴛʜ": "ð", "ch": "tʃ", "hw": "hw", "ng": "ŋ", "sh": "ʃ", "th": "θ", "zh": "ʒ", "b": "b", "d": "d", "f": "f", "g": "ɡ", "h": "h", "j": "dʒ",
    "k": "k", "l": "l", "m": "m", "n": "n", "p": "p", "r": "ɹ", "s": "s", "t": "t", "v": "v", "w": "w", "y": "j", "z": "z",
}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def entry(headword: Column, raw: Column) -> Column:
    """struct(pos, etymology, senses); a sense has a label, its text and quotations (year, approx, author, text).

    The labels after the headword are its parts of speech, the first square bracket its etymology. Senses
    begin at a number or small letter with a dot before a capital or bracket, quotations at a year, which
    ``a`` or ``c`` makes approximate; up to five capitalised words after it are the author.
    """
    run = rf"(?i)^((?:{LABEL}\b\.?[ ,.;:]*(?:(?:and|or)\s+(?={LABEL}\b))?)+)"
    ends: dict[int, str] = {}  # the third digits that follow two first ones: few branches to try at each place
    for x in range(YEARS[0] // 10, YEARS[1] // 10 + 1):
        ends[x // 10] = ends.get(x // 10, "") + str(x % 10)
    decades = "|".join(f"{two}[{third}]" for two, third in ends.items())
    label = "[a-z]|[0-9][0-9]?"
    mark, year = rf"(?:{label})\.\s+(?=\(|[A-Z])", rf"\b[ac]?(?:{decades})[0-9]\b"

    def body(text: Column) -> Column:
        own = F.when(F.lower(text).startswith(F.lower(F.trim(headword))), F.substr(text, F.length(F.trim(headword)) + 1)).otherwise(text)
        return F.regexp_replace(F.regexp_replace(F.trim(own), r"^\s*\([^)]{0,40}\)", ""), r"^[ ,.;:]+", "")

    def quoted(piece: Column, said: Column) -> Column:
        put = lambda author: F.struct(
            F.regexp_extract(piece, r"^[ac]?(\d{4})", 1).try_cast("int").alias("year"), piece.rlike("^[ac]").alias("approx"),
            F.nullif(author, F.lit("")).alias("author"), F.when(author != "", F.trim(F.substr(said, F.length(author) + 1))).otherwise(said).alias("text"),
        )
        return _once(F.regexp_extract(said, r"(?s)^([A-Z][\w.]*(?:\s+[A-Z][\w.]*){0,4})\s+(.*)$", 1), put)

    def quotations(own: Column) -> Column:
        dated = F.filter(F.split(own, f"(?={year})"), lambda q: q.rlike(f"^{year}"))
        said = F.transform(dated, lambda q: F.struct(q.alias("piece"), F.trim(F.regexp_replace(q, f"^{year}", "")).alias("said")))
        return F.transform(F.filter(said, lambda q: q["said"] != ""), lambda q: quoted(q["piece"], q["said"]))

    def sense(piece: Column) -> Column:
        own_label = F.regexp_extract(piece, rf"^({label})\.\s+(?=\(|[A-Z])", 1)
        put = lambda own: F.struct(F.nullif(own_label, F.lit("")).alias("label"), own.alias("text"), quotations(own).alias("quotations"))
        return _once(F.trim(F.regexp_replace(piece, f"^{mark}", "")), put)

    def parsed(body: Column) -> Column:
        return _once(F.regexp_extract(body, run, 1), lambda labels: _once(F.substr(body, F.length(labels) + 1), lambda rest: whole(labels, rest)))

    def whole(labels: Column, rest: Column) -> Column:
        pos = F.array_join(F.regexp_extract_all(labels, F.lit(rf"(?i)\b({LABEL})\b"), F.lit(1)), " ")
        etymology = F.trim(F.regexp_extract(rest, r"(?s)\[(.+?)\]", 1))
        rest = F.regexp_replace(rest, r"(?s)^([^\[]*)\[.+?\]", "$1")
        pieces = F.filter(F.transform(F.split(rest, rf"(?:(?<=\s)|^)(?={mark})"), lambda p: F.trim(p)), lambda p: F.trim(F.regexp_replace(p, f"^{mark}", "")) != "")
        return F.struct(F.nullif(pos, F.lit("")).alias("pos"), F.nullif(etymology, F.lit("")).alias("etymology"), F.transform(pieces, sense).alias("senses"))

    return _once(F.trim(F.coalesce(raw, F.lit(""))), lambda text: _once(body(text), parsed))


def relations(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries (id, pos, etymology), senses (id, nth, label, text) and quotations (id, nth, n, year, approx, author, text) of ``entries`` (id, headword, raw).

    The parsed entries are written once: a step that unfolds a list also asks for its size, and would parse each entry again.
    Entries are dealt anew before that: a volume is a small file, which one task would read, and long work.
    """
    spark = entries.sparkSession
    dealt = entries.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    parsed = settled(dealt.select("id", entry(F.col("headword"), F.col("raw")).alias("e")))
    senses = parsed.select("id", F.posexplode("e.senses").alias("nth", "s"))
    return parsed.select("id", "e.pos", "e.etymology"), senses.select("id", "nth", "s.label", "s.text"), senses.select("id", "nth", F.posexplode("s.quotations").alias("n", "q")).select("id", "nth", "n", "q.*")


def entry_details(entries: DataFrame) -> DataFrame:
    """(id, detail): each entry with its senses and their quotations, nested, as JSON."""
    return entries.select("id", F.to_json(entry(F.col("headword"), F.col("raw"))).alias("detail"))


def agreed_reading(one: Column, two: Column, printed: Column) -> Column:
    """struct(ipa, needs_review): what two readings agree on, unless the print shows a sound before the first stress that they lack."""
    norm = lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\(+|\)+$", ""))
    a, b = norm(one), norm(two)
    valid = a.rlike(r"^[a-zɐ-ʯæðøŋœθːˈˌ̃.() ]+$") & (a != "")
    bracket = F.regexp_extract(F.coalesce(printed, F.lit("")), r"\(([^)]*)\)", 1)
    lost = (F.locate("'", bracket) > 1) & a.rlike("^[ˈˌ]")
    sound = F.coalesce((a == b) & valid & ~lost, F.lit(False))
    return F.struct(F.when(sound, a).alias("ipa"), (~sound).alias("needs_review"))


def arpabet_ipa(phones: Column) -> Column:
    """IPA of ARPAbet phones; the stress stands before the consonants that lead to its vowel. Null if a phone is unknown."""
    consonant, vowel = "|".join(ARPA_CONSONANTS), "|".join(ARPA_VOWELS)
    spaced = F.concat(F.regexp_replace(F.trim(phones), r"\s+", " "), F.lit(" "))
    for digit, sign in (("1", "ˈ"), ("2", "ˌ")):
        spaced = F.regexp_replace(spaced, rf"(?<![A-Z])((?:(?:{consonant}) )*)({vowel}){digit} ", f"{sign} $1$2 ")
    plain = F.regexp_replace(spaced, rf"(?<![A-Z])({vowel})0 ", "$1 ")
    table = _map({**ARPA_CONSONANTS, **ARPA_VOWELS, "ˈ": "ˈ", "ˌ": "ˌ"})
    signs = F.transform(F.filter(F.split(plain, " "), lambda p: p != ""), lambda p: table[p])
    return F.when((F.size(signs) > 0) & ~F.exists(signs, lambda s: s.isNull()), F.array_join(signs, ""))


def respelling_ipa(text: Column) -> Column:
    """IPA of a dictionary respelling, whose stress marks follow the syllable. Null if a sign is unknown; of several variants the first counts."""
    first = F.trim(F.get(F.split(F.regexp_replace(F.trim(text), "<[^>]+>", ""), "[,;]"), F.lit(0)))
    table = {**SPELLED_VOWELS, **SPELLED_CONSONANTS, "-": "-", "′": "′", "″": "″"}
    ordered = "|".join(sorted(table, key=lambda s: (-len(s), s)))
    found = F.regexp_extract_all(first, F.lit(f"({ordered})"), F.lit(1))
    kind = _map({**{s: f"v{x}" for s, x in SPELLED_VOWELS.items()}, **{s: f"c{x}" for s, x in SPELLED_CONSONANTS.items()}, "-": "-", "′": "′", "″": "″"})
    coded = F.concat(F.array_join(F.transform(found, lambda s: kind[s]), " "), F.lit(" "))
    for mark, sign in (("′", "ˈ"), ("″", "ˌ")):
        coded = F.regexp_replace(coded, rf"((?:c\S+ )*v\S+ (?:c\S+ )*){mark} ", f"{sign} $1")
    plain = F.regexp_replace(F.regexp_replace(coded, r"- ", ""), r"(?:^|(?<= ))[cv](?=\S)", "")
    return F.when((F.array_join(found, "") == first) & (first != ""), F.replace(plain, F.lit(" "), F.lit("")))


def verdicts(reply: Column) -> Column:
    """array of struct(word, keep) of a model's JSON reply: fences and what follows the JSON are passed over; a verdict without ``k`` or ``keep`` keeps. Null if nothing parses."""
    bare = F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), r"^```[a-z]*\s*|```\s*$", "")
    body = F.regexp_extract(bare, r"(?s)([\[{].*)$", 1)
    ends = F.filter(F.reverse(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1)))), lambda i: F.substring(body, i, F.lit(1)).isin("]", "}"))
    whole = F.get(F.filter(F.transform(ends, lambda i: F.substring(body, F.lit(1), i)), lambda s: F.try_parse_json(s).isNotNull()), F.lit(0))
    one = "array<struct<w:string,word:string,k:boolean,keep:boolean>>"
    of = lambda path: F.from_json(F.get_json_object(whole, path), one)
    rows = F.when(whole.startswith("["), F.from_json(whole, one)).otherwise(F.coalesce(of("$.words"), of("$.results")))
    return F.transform(rows, lambda v: F.struct(F.lower(F.trim(F.coalesce(v["w"], v["word"], F.lit("")))).alias("word"), F.coalesce(v["k"], v["keep"], F.lit(True)).alias("keep")))


def preferred(entries: DataFrame, tag: str = "US") -> DataFrame:
    """(word, ipa): of each word's pronunciations (word, nth, ipa, tags) the first with ``tag``, else the first."""
    rank = F.struct((~F.array_contains("tags", tag)).cast("int"), "nth", "ipa")
    return entries.where("ipa is not null").groupBy("word").agg(F.min_by("ipa", rank).alias("ipa"))


def hashed_vectors(texts: DataFrame, dimension: int = 64) -> DataFrame:
    """(id, place, value): unit vectors of the words' counts, each word at the place its hash names; a stand-in where no model is given."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: w != "")
    place = F.conv(F.left(F.md5("w"), F.lit(6)), 16, 10).cast("long") % dimension
    n = texts.select("id", F.explode(words).alias("w")).groupBy("id", place.cast("int").alias("place")).agg(F.count("*").alias("n"))
    norm = n.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return n.join(norm, "id").select("id", "place", F.round(F.col("n") / F.col("norm"), 6).alias("value"))
