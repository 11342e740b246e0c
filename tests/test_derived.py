from lexmill.operators.derived import derived_roots

ADJECTIVES = "jaunty culpable quick happy unhappy froward basic gentle fit wise".split()
LISTED = "happy safe wise froward fit der cle ion til quick iform".split()
CASES = {
    ("jauntily", "ADV"): ("jaunty", "ADJ"), ("culpably", "ADV"): ("culpable", "ADJ"), ("quickly", "ADV"): ("quick", "ADJ"), ("basically", "ADV"): ("basic", "ADJ"),
    ("inobtrusively", "ADV"): None, ("deathfully", "ADV"): None, ("unhappy", "ADJ"): ("happy", "ADJ"), ("unsafe", "ADJ"): ("safe", "ADJ"), ("unwise", "NOUN"): ("wise", "NOUN"),
    ("under", "ADP"): None, ("uncle", "NOUN"): None, ("union", "NOUN"): None, ("until", "ADP"): None, ("unicorn", "NOUN"): None, ("unfit", "ADJ"): None,
    ("unhappily", "ADV"): ("happy", "ADJ"), ("unfrowardly", "ADV"): ("froward", "ADJ"), ("book", "NOUN"): None, ("quickly", "NOUN"): None, (" Quickly ", "ADV"): ("quick", "ADJ"),
    ("unquickly", "NOUN"): None, ("ly", "ADV"): None, ("", "ADV"): None, ("unhappy", None): ("happy", None),
}


def test_roots_one_step_and_in_a_row(spark):
    words = spark.createDataFrame([*CASES, (None, "ADV")], "lemma string, pos string")
    rows = [(w, w in ADJECTIVES, w in LISTED) for w in sorted({*ADJECTIVES, *LISTED})] + [("Quickly", None, False), ("happy", False, False), (None, True, True)]
    dictionary = spark.createDataFrame(rows, "word string, adjective boolean, listed boolean")
    got = {(r.lemma, r.pos): (r.root, r.root_pos) for r in derived_roots(words, dictionary).collect()}
    assert got == {(w.strip().lower(), p): root for (w, p), root in CASES.items() if root}


def test_an_adverb_under_un_that_is_listed(spark):
    dictionary = spark.createDataFrame([("gently", False, True), ("gentle", True, True), ("gent", True, True)], "word string, adjective boolean, listed boolean")
    rows = derived_roots(spark.createDataFrame([("ungently", "NOUN")], "lemma string, pos string"), dictionary).collect()
    assert [tuple(r) for r in rows] == [("ungently", "NOUN", "gent", "ADJ")]
    assert derived_roots(spark.createDataFrame([], "lemma string, pos string"), dictionary.limit(0)).count() == 0
