import pytest

from lexmill.operators.phrases import definition_edges, tagged

LEXICON = [
    (w, w, pos) for pos, words in {
        "ADJ": "large wild ancient greek small human bushy rapid heavy wooden", "NOUN": "cat pottery grave lie part engine wood business heart bear sword tail growth collar prisoner kind type",
    }.items() for w in words.split()
] + [("steals", "steal", "VERB"), ("tells", "tell", "VERB"), ("cutting", "cut", "VERB"), ("used", "use", "VERB"), ("cats", "cat", "NOUN"), ("worn", "wear", "VERB"), ("prisoners", "prisoner", "NOUN"), ("relating", "relate", "VERB")]

CASES = [
    ("a kind of large wild cat", {("is_a", "cat")}), ("a type of ancient Greek pottery", {("is_a", "pottery")}),
    ("one who steals from a grave", {("agentive", "steal")}), ("one who habitually tells lies", {("agentive", "tell")}),
    ("a small part of the engine", {("part_of", "engine")}), ("used for cutting wood", {("purpose", "cut")}),
    ("of or relating to business", {("relates_to", "business")}), ("relating to the human heart", {("relates_to", "heart")}),
    ("resembling a small bear", {("resembling", "bear")}), ("like a sword", {("resembling", "sword")}),
    ("having a bushy tail", {("attribute", "tail")}), ("characterized by rapid growth", {("attribute", "growth")}),
    ("a heavy wooden collar worn by prisoners", set()), ("A kind of small wild wood cats, used to cutting", {("is_a", "cat"), ("purpose", "cut")}),
    ("", set()), (None, set()), ("a kind of", set()), ("the kind of cat", set()), ("like the sword", set()), ("a sort of cat; part of cat", {("is_a", "cat"), ("part_of", "cat")}),
]


def test_phrases_are_taken_to_their_head(spark):
    rows = [(i, "own", text) for i, (text, _) in enumerate(CASES)] + [(99, "Cat", "a kind of cat")]
    frame = spark.createDataFrame(rows, "id long, lemma string, definition string")
    lexicon = spark.createDataFrame(LEXICON, "word string, lemma string, pos string")
    found = definition_edges(frame, lexicon).collect()
    for i, (text, want) in enumerate(CASES):
        assert {(r.relation, r.target) for r in found if r.id == i} == want, text
    assert not [r for r in found if r.id == 99] and len(found) == len({tuple(r) for r in found})


def test_tokens(spark):
    frame = spark.createDataFrame([(1, "x", "The Well-known cats' QUICKLY <b>| lie")], "id long, lemma string, definition string")
    lexicon = spark.createDataFrame([("LIE", "lie", "VERB"), ("lie", "lie", "NOUN")], "word string, lemma string, pos string")
    assert tagged(frame, lexicon).first().tokens == "<the|the|DET><well-known|well-known|NOUN><cats|cats|NOUN><.|.|PUNCT><quickly|quickly|ADV><.|.|PUNCT><b|b|NOUN><.|.|PUNCT><.|.|PUNCT><lie|lie|NOUN>"
    assert tagged(frame.limit(0), lexicon).count() == 0


@pytest.mark.parametrize("text", ["used for " * 3000 + "cutting wood", "a kind of " + "large " * 4000 + "cat"])
def test_long_definitions(spark, text):
    frame = spark.createDataFrame([(1, "x", text)], "id long, lemma string, definition string")
    assert definition_edges(frame, spark.createDataFrame(LEXICON, "word string, lemma string, pos string")).count() == 1
