"""Rules that SQL cannot state, against plain versions on small tables."""

import json
import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import ingest, leaks, lexicon, listing, relate, rules, writes
from lexmill.plans import steps


def plain_leaks(word, definition):
    out = set()
    for t in set("".join(c if c.isascii() and c.isalpha() else " " for c in definition.lower()).split()):
        n = next((i for i, (x, y) in enumerate(zip(word, t)) if x != y), min(len(word), len(t)))
        glued = any(p + a == b and len(a) >= 4 for p in leaks.PREFIXES for a, b in ((word, t), (t, word)))
        alike = min(len(word), len(t)) >= 5 and SequenceMatcher(None, word, t).ratio() >= 0.85
        if len(t) >= 3 and (t == word or (n >= 4 and n >= 0.55 * min(len(word), len(t))) or glued or alike):
            out.add(t)
    return out


def test_leaks_and_redaction(spark):
    rows = [(1, "codpiece", "Fitted with a codpieced thing."), (2, "santer", "To saunter about"), (3, "meditate", "to premeditate; an idle act"), (4, "ring", "RING of iron"), (5, "plain", None), (6, "eat", "a seat")]
    df = spark.createDataFrame(rows, "id long, word string, definition string")
    got = {}
    for r in leaks.leaking_tokens(df).collect():
        got.setdefault(r.id, set()).add(r.token)
    assert got == {i: x for i, w, d in rows if (x := plain_leaks(w, d or ""))}
    red = {r.id: (r.quiz_definition, r.source) for r in leaks.redacted(df, leaks.leaking_tokens(df)).collect()}
    assert red[4] == ("— of iron", "redacted") and red[6] == ("a seat", "clean") and red[5] == (None, "clean")
    stemmed = leaks.leaking_tokens(spark.createDataFrame([(1, "cities", "a city")], "id long, word string, definition string"), stem=lambda w: F.left(w, F.lit(3)))
    assert [r.token for r in stemmed.collect()] == ["city"]


def test_light_stems(spark):
    pairs = [("cities", "city"), ("running", "runs"), ("gladly", "glad"), ("happiness", "happily"), ("stopped", "stop"), ("makes", "making")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(leaks.light_stem(F.col("a")).alias("a"), leaks.light_stem(F.col("b")).alias("b")).collect()
    assert all(r.a == r.b for r in rows), rows
    words = spark.createDataFrame([("as",), ("red",), ("ring",), ("",)], "w string").select(leaks.light_stem(F.col("w")).alias("s"))
    assert [r.s for r in words.collect()] == ["as", "red", "ring", ""]


def test_titles_taken_apart(spark):
    cases = {
        "The Old Days, In Three Volumes, Vol. 2 (of 3)": ("The Old Days", "vol.", 2, None, 3, False), "Tales. Vols. I-III.": ("Tales", "vols.", 1, 3, None, False), "Life, Volume the Last": ("Life", "volume", None, None, None, True),
        "Life, Chapters 2 to the last": ("Life", "chapters", 2, None, None, True), "A Book 3": ("A", "book", 3, None, None, False), "Vol. 3": None, "Scrapbook 3": None, "Something Part": None, "": None, "Essays Vol. 1, No. 3": None,
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string").select("t", rules.title_suffix(F.col("t")).alias("s"))
    for r in frame.collect():
        want = cases[r.t]
        assert tuple(r.s) == (want or (None, None, None, None, None, False)), (r.t, r.s)


def test_references_and_variants(spark):
    rows = [("Plural of ox.", "plural", "ox", None), ("plural of ox: the beasts.", "plural", "ox", "the beasts"), ('synonym of cow ("a beast").', "synonym", "cow", "a beast"), ("synonym of cow", "synonym", "cow", None), ("a plural of ox", None, None, None), ("plural of ", None, None, None), (None, None, None, None)]
    got = spark.createDataFrame(rows, "d string, k string, t string, g string").select("d", "k", "t", "g", rules.cross_reference(F.col("d")).alias("r")).collect()
    assert all(tuple(r.r) == (r.k, r.t, r.g) for r in got), got
    said = [("Obsolete form of x", True), ("third-person singular, present", True), ("alternative spelling of y", True), ("a form", False), ("reform of law", False), ("plurals of", False), (None, False)]
    rows = spark.createDataFrame(said, "d string, v boolean").select("d", "v", rules.variant(F.col("d")).alias("is")).collect()
    assert all(r.v == r["is"] for r in rows), rows


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_two_edits_with_swaps(spark):
    r = random.Random(2)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(4, 6))) for _ in range(60)})
    zipf = {w: round(r.uniform(0, 6), 3) for w in words}
    got = {x.lemma: x.neighbour for x in ingest.neighbours(spark.createDataFrame(list(zipf.items()), "lemma string, zipf double"), True, 2.0, 2).collect()}
    want = {}
    for w in words:
        near = [(-zipf[v], v) for v in words if v != w and zipf[v] >= zipf[w] + 2.0 and osa(w, v) <= 2]
        if near:
            want[w] = min(near)[1]
    assert got == want


def test_boilerplate(spark):
    s, e = "*** START OF THE BOOK X ***", "*** END OF THE BOOK X ***"
    texts = [f"h\n{s}\nh2\n{s}\nbody\n{e}\nmore\n{e}\nfoot", f"h\n{s}\nbody", f"body\n{e}\nfoot", "plain", None]
    got = [tuple(r.b) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(rules.boilerplate(F.col("t")).alias("b")).collect()]
    assert got[0] == (f"h\n{s}\nh2\n{s}\n", f"body\n{e}\nmore\n", f"{e}\nfoot")
    assert got[1] == (f"h\n{s}\n", "body", "") and got[2] == ("", f"body\n{e}\nfoot", "") and got[3:] == [("", "plain", ""), ("", "", "")]


def test_chunks(spark):
    text = "aa\n\nbbb\n\n\n" + "c" * 20 + "\n\nd"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(lexicon.paragraphs(F.col("t"), 7).alias("c")).collect()
    assert row[0].c == ["aa\n\nbbb", "c" * 20, "d"] and row[1].c == []


def grams(text):
    return [f"  {w} "[i : i + 3] for w in "".join(c if c.isalnum() and c.isascii() else " " for c in text.lower()).split() for i in range(len(w) + 1)]


def test_window_similarity(spark):
    asked = "small ring"
    texts = ["a small ringlet of gold", "ring", "", "the smell of rings and small things", "SMALL RING", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", lexicon.window_similarity(F.lit(asked), F.col("t")).alias("s")).orderBy("i").collect()
    a = set(grams(asked))
    for r, t in zip(got, texts):
        b = grams(t or "")
        want = max((len(a & set(b[i:j])) / len(a | set(b[i:j])) for i in range(len(b)) for j in range(i + 1, len(b) + 1)), default=0.0)
        assert abs(r.s - want) < 1e-12, t


def test_tree_of_clusters():
    d = np.array([[0 if i == j else (0.1 if (i < 2) == (j < 2) else 5.0) for j in range(4)] for i in range(4)])
    tree = json.loads(relate.dendrogram(d, list("abcd")))
    assert tree["size"] == 4 and [{x["name"] for x in c["children"]} for c in tree["children"]] == [{"a", "b"}, {"c", "d"}]
    assert relate.dendrogram(d[:1, :1], ["a"]) == '{"name": "a"}'


def test_steps_resume_and_skip(spark, tmp_path):
    ran = []

    def step(name):
        def run(tables):
            ran.append(name)
            return {name: tables["in"].withColumn(name, F.lit(1))}

        return name, run

    for resume in (False, True):
        out = steps.run(spark, str(tmp_path), [step("a"), step("b"), step("c")], {"in": spark.range(3)}, frozenset({"b"}), resume)
        assert set(out) == {"in", "a", "c"} and out["c"].count() == 3
    assert ran == ["a", "c"]


def test_changes_of_tables(spark):
    df = spark.createDataFrame([(1, "x")], "id int, old string")
    assert writes.ensure_schema(df, "id long, name string").first().asDict() == {"id": 1, "name": None}
    words = spark.createDataFrame([("a",)], "lemma string")
    rejected = spark.createDataFrame([(1, "B", "rare", "noun"), (2, "c", "rare", "symbol"), (3, "d", "name", "noun")], "id long, lemma string, reason string, pos string")
    kept, left = writes.rescued(words, rejected, spark.createDataFrame([(1,), (2,)], "id long"), F.col("pos") == "symbol")
    assert sorted(map(tuple, kept.collect())) == [("a", None), ("b", "rare")] and sorted(r.id for r in left.collect()) == [2, 3]


def test_samples(spark):
    df = spark.range(100).withColumn("due", F.col("id") < 5)
    one = [r.id for r in listing.sample(df, "id", 10, 4, F.col("due")).collect()]
    assert one == [r.id for r in listing.sample(df.repartition(7), "id", 10, 4, F.col("due")).collect()] and set(one[:5]) == set(range(5))
