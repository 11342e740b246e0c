from lexmill.operators import analogy

TERMS = "term long, lemma string, pos string, vocab boolean"
EDGES = "id long, a long, b long, relation string, family string"


def tables(spark, floor_pair=False):
    terms = [(i, f"t{i:03d}", "noun", True) for i in range(1, 30)] + [(i, f"o{i}", "noun", False) for i in range(100, 130)] + [(90, "Thing", "noun", True), (91, "verbish", "verb", True)]
    up = [(1, 10), (2, 20), (20, 90), (20, 21), (10, 11), (3, 10), (4, 20), (5, 10)]
    edges = [(k, a, b, "is_a", "kind") for k, (a, b) in enumerate(up)]
    vectors = [(10, [1.0, 0.0, 0.0]), (21, [0.99, 0.14, 0.0] if floor_pair else [0.0, 1.0, 0.0]), (20, [0.0, 0.0, 1.0]), (1, [0.5, 0.5, 0.0]), (2, [0.0, 0.5, 0.5])]
    return spark.createDataFrame(terms, TERMS), spark.createDataFrame(edges, EDGES), spark.createDataFrame(vectors, "id long, vector array<double>")


def question(spark):
    return spark.createDataFrame([(1, 0, "vocab_only", "is_a", 2, 20, 10)], "c long, edge long, style string, relation string, a long, b long, d long")


def got(spark, floor_pair=False, synonyms=((10, 28),), count=3):
    terms, edges, vectors = tables(spark, floor_pair)
    known = analogy.fanout(edges, ("is_a",))
    rows = analogy.options(question(spark), terms, edges, known, spark.createDataFrame(list(synonyms), "term long, other long"), vectors, "is_a", count)
    return sorted(rows.collect(), key=lambda r: r.place)


def test_traps_come_first_and_right_or_dull_answers_never(spark):
    rows = got(spark, count=6)
    assert (rows[0].term, rows[0].strategy) == (21, "analogy_trap") and len(rows) == 6 and not rows[0].degraded
    shown = {r.term for r in rows}
    assert not shown & {1, 2, 20, 10, 11, 28, 91} and len(shown) == 6
    assert "analogy_trap" not in {r.strategy for r in rows if r.term == 90}


def test_a_trap_that_means_the_same_is_left_out(spark):
    assert 21 not in {r.term for r in got(spark, floor_pair=True)}


def test_other_right_answers_come_from_d_where_c_has_none(spark):
    terms, edges, _ = tables(spark)
    known = analogy.fanout(edges, ("is_a",))
    q = spark.createDataFrame([(29, 0, "vocab_only", "is_a", 2, 20, 10)], "c long, edge long, style string, relation string, a long, b long, d long")
    right = analogy.answers(q, known, spark.createDataFrame([], "term long, other long"))
    assert {r.term for r in right.collect()} == {10, 11}


def test_hard_questions_take_siblings_and_ordinary_terms(spark):
    terms = spark.createDataFrame([(1, "c", "noun", True), (2, "a", "noun", False), (3, "b", "noun", False), *[(i, f"o{i}", "noun", False) for i in range(10, 20)], (30, "w", "noun", True)], TERMS)
    edges = spark.createDataFrame([(0, 10, 11, "is_a", "kind"), (1, 12, 11, "is_a", "kind"), (2, 13, 11, "is_a", "kind"), (3, 1, 10, "is_a", "kind"), (4, 2, 3, "is_a", "kind")], EDGES)
    q = spark.createDataFrame([(1, 3, "one_hard_term", "is_a", 2, 3, 10)], "c long, edge long, style string, relation string, a long, b long, d long")
    none = spark.createDataFrame([], "term long, other long")
    rows = analogy.options(q, terms, edges, analogy.fanout(edges, ("is_a",)), none, spark.createDataFrame([], "id long, vector array<double>"), "is_a", 3).collect()
    assert {r.strategy for r in rows} == {"sibling_fanout", "random_ordinary"} and {r.term for r in rows if r.strategy == "sibling_fanout"} == {12, 13}
    assert 30 not in {r.term for r in rows} and 11 not in {r.term for r in rows}


def test_an_anchor_beyond_all_that_share_a_term(spark):
    """Sixty edges of the family share the hub with the tested one; the only other one is found."""
    terms = spark.createDataFrame([(i, f"t{i}", "noun", True) for i in range(1, 70)], TERMS)
    rows = [(k, k, 65, "is_a", "kind") for k in range(1, 61)] + [(100, 66, 67, "is_a", "kind")]
    found = analogy.anchored(spark.createDataFrame(rows, EDGES), terms, terms).collect()
    assert len(found) == 61
    assert all((r.a, r.b) == (66, 67) for r in found if r.c <= 60) and all(r.b == 65 for r in found if r.c == 66)
