"""Rules of the data model on tables of a few rows."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import columns as fn
from lexmill.operators import facets, ingest, progress, relate
from lexmill.operators.facets import WordFilter
from lexmill.plans.star import Corpus
from lexmill.sources import readers, sinks
from lexmill.streaming import answers as stream


@pytest.fixture(scope="module")
def corpus(spark):
    make = spark.createDataFrame
    words = make([(i, f"word{i}", "NOUN", i != 6, d, "current", i % 2 == 0) for i, d in enumerate((10.0, 30.0, 50.0, 70.0, 100.0, None, 90.0))], "id long, lemma string, part_of_speech string, active boolean, difficulty double, archaic string, quizzable boolean")
    books = make([(1, "The One", "Ann", 10), (2, "A Two", "Ann", 0), (3, "Three", None, 10), (4, "Four", "Unknown", 10)], "id long, title string, author string, distinct_words long")
    books = books.withColumns({"created_on": F.to_date(F.lit("2024-01-01")), "publication_year": F.lit(1900), "token_count": F.lit(5)})
    links = make([(0, 1), (0, 2), (1, 1), (2, 2), (3, 3), (4, 4), (1, 3), (6, 1)], "word_id long, book_id long")
    codes = make([(0, "A1"), (1, "A10"), (2, "A1.2"), (3, "B1"), (0, "E1")], "word_id long, code string")
    return Corpus(words, books, links, codes, make([(1, "x"), (2, "y")], "book_id long, genre string"), make([(1, 7)], "book_id long, fame_score int"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_subtree_ends_at_a_dot(corpus):
    assert ids(facets.words(corpus, WordFilter(codes=("A1",)))) == [0, 2]
    assert ids(facets.words(corpus, WordFilter(codes=("A",)))) == [0, 1, 2]


def test_exclusive_to_a_book_and_to_an_author(corpus):
    assert ids(facets.words(corpus, WordFilter(books=(1,), exclusive=True))) == []
    assert ids(facets.words(corpus, WordFilter(books=(1, 2), exclusive=True))) == [0, 2]
    assert ids(facets.words(corpus, WordFilter(author="Ann", exclusive=True))) == [0, 2]  # a book without author counts against


def test_unknown_bucket_is_ignored_unless_strict(corpus):
    assert len(ids(facets.words(corpus, WordFilter(buckets=("none",))))) == 6
    assert ids(facets.words(corpus, WordFilter(buckets=("none",), strict=True))) == []


def test_pruned_words_are_gone_and_unscored_ones_are_not(corpus):
    assert 6 not in ids(facets.words(corpus)) and ids(facets.words(corpus, WordFilter(unscored=True))) == [5]
    bands = {r.label: r["count"] for r in facets.difficulty_bands(corpus).collect()}
    assert bands == {"0-20": 1, "20-40": 1, "40-60": 1, "60-80": 1, "80-100": 1, "Not yet scored": 1}


def test_listings(corpus):
    rows = {r.id: r for r in facets.books(corpus).collect()}
    assert rows[2].density is None and rows[2].overall_difficulty is None
    assert rows[1].word_count == 2 and rows[4].stddev_difficulty is None and rows[4].unique_word_count == 1
    a = facets.authors(corpus).collect()
    assert [(r.author, r.word_count, r.book_count) for r in a] == [("Ann", 3, 2)]


@pytest.mark.parametrize("pieces", [2, 256])
def test_percent_rank_equals_the_window(spark, pieces):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else float(i * 37 % 23)) for i in range(200)], "id int, x double")
    got = {r.id: r.p for r in fn.percent_rank(df, "x", "p", pieces).collect()}
    values = sorted(r.x for r in df.collect() if r.x is not None)
    for r in df.collect():
        assert got[r.id] is None if r.x is None else abs(got[r.id] - values.index(r.x) / (len(values) - 1)) < 1e-12
    assert fn.percent_rank(df.limit(0), "x", "p").count() == 0


def test_idf_cosine(spark):
    pairs = spark.createDataFrame([(e, m) for e, ms in {"a": "pqrz", "b": "pqrz", "c": "xyz", "d": "xwv", "e": "uts", "f": "uts"}.items() for m in ms], "e string, m string")
    got = {(r.a, r.b): (r.score, r.shared) for r in relate.similar(pairs, "e", "m", 0.4, 3).collect()}
    assert got == {("a", "b"): (1.0, 3), ("b", "a"): (1.0, 3), ("e", "f"): (1.0, 3), ("f", "e"): (1.0, 3)}
    assert relate.similar(pairs.where("e = 'a'"), "e", "m").count() == 0


def test_closure_ends_on_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "c int, p int")
    assert relate.closure(df, "c", "p").count() == 9


def test_two_clear_clusters():
    import numpy as np

    d = np.array([[0 if i == j else (0.1 if (i < 3) == (j < 3) else 5.0) for j in range(6)] for i in range(6)])
    assert relate.ward(d, 2).tolist() == [1, 1, 1, 2, 2, 2]


def test_upsert_rules_and_idempotence(spark):
    rules = {"name": "fill", "since": "least", "flag": "sticky", "first": "first"}
    old = spark.createDataFrame([(1, "one", 5, True, "o"), (2, "", None, None, "o")], "id int, name string, since int, flag boolean, first string")
    new = spark.createDataFrame([(1, "", 3, False, "n"), (2, "two", 4, None, "n"), (3, "x", None, True, "n")], old.schema)
    once = ingest.upsert(old, new, "id", rules)
    want = [(1, "one", 3, True, "o"), (2, "two", 4, False, "o"), (3, "x", None, True, "n")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, ingest.upsert(once, new, "id", rules).collect())) == want


def test_text_rules(spark):
    df = spark.createDataFrame([(1, "The ﬁne sus-\npect’s  “word” WORD Word I"), (2, None)], "doc_id long, text string")
    got = df.select("doc_id", ingest.clean_text(F.col("text")).alias("t")).orderBy("doc_id").collect()
    assert got[0].t == "The fine suspect's \"word\" WORD Word I" and got[1].t is None
    c = {r.lemma: r for r in ingest.candidates(df).collect()}
    assert c["word"].n_tokens == 3 and c["word"].capitalised == 0.5
    pair = spark.createDataFrame([("form", "from"), ("abc", "abd"), ("a", None)], "a string, b string")
    assert [r.d for r in pair.select(ingest.osa(F.col("a"), F.col("b")).alias("d")).collect()] == [1, 1, None]
    assert [r.v for r in spark.createDataFrame([("XIV",), ("mcmxc",)], "r string").select(fn.roman(F.col("r")).alias("v")).collect()] == [14, 1990]


def test_out_of_order(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabzbcd")], "g int, n int, v string")
    assert [tuple(r) for r in ingest.out_of_order(df, "g", "n", "v").collect()] == [(1, 3)]


def test_part_gaps(spark):
    rows = [("a", 1, None), ("a", 2, 3), ("b", 1, None), ("b", 3, None), ("c", 1, None), ("c", 1, None), ("d", 2, None)]
    got = {r.title_base: r.skip_reason for r in ingest.part_gaps(spark.createDataFrame(rows, "title_base string, first int, last int")).collect()}
    assert got == {"a": None, "b": "gap", "c": "duplicate_number", "d": "lone_match"}


def answer_rows():
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d, 12)
    return [(1, 9, "s", 5, "k", True, day(1), 0.0), (2, 9, "s", 5, "k", False, day(2), 0.0), (3, 9, "t", 5, "k", True, day(3), 0.0), (4, 9, "t", 5, "k", True, day(5), 0.0)]


ANSWER = "question long, user_id long, session string, word_id long, kind string, correct boolean, answered_at timestamp, floor double"


def test_schedule_and_streaks(spark):
    a = spark.createDataFrame(answer_rows(), ANSWER)
    r = progress.review_schedule(a).first()
    assert (r.streak, r.correct, r.wrong) == (2, 3, 1) and r.next_at - int(answer_rows()[-1][6].timestamp()) in (4 * 86400, 4 * 86400 + 0)
    runs = sorted(r.days for r in progress.practice_streaks(a).collect())
    assert runs == [1, 3]
    assert progress.current_streak(a, F.to_date(F.lit("2024-01-06"))).first().days == 1
    assert progress.current_streak(a, F.to_date(F.lit("2024-01-09"))).first().days == 0


def test_stream_equals_batch(spark, tmp_path):
    a = spark.createDataFrame(answer_rows(), ANSWER)
    for i, part in enumerate((a.where("question <= 2"), a.where("question > 2"))):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.keep_schedule(stream.read_files(spark, str(tmp_path / "in"), ANSWER), str(tmp_path / "log"), str(tmp_path / "plan"), str(tmp_path / "check"))
        q.awaitTermination(120)
    assert sorted(map(tuple, sinks.read_table(spark, str(tmp_path / "plan")).collect())) == sorted(map(tuple, progress.review_schedule(a).collect()))


def test_readers(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/My Book -- Jo Doe.txt").write_text("hello\nworld")
    (tmp_path / "b/Other.pdf").write_text("x")
    got = {r.title: r for r in readers.texts(spark, str(tmp_path / "b")).collect()}
    assert got["My Book"].author == "Jo Doe" and got["My Book"].text == "hello\nworld" and got["Other"].error
    (tmp_path / "s.csv").write_text("name,rank\nSMITH,1\nALL OTHER NAMES,0\nDE LA,3\nsmith,4\n")
    assert [r.name for r in readers.surnames(spark, str(tmp_path / "s.csv")).collect()] == ["smith"]
    assert readers.optional(spark, str(tmp_path / "none"), "a int").count() == 0
    pages = spark.createDataFrame([(1, "<p>a</p><h1>T</h1>b<script>x</script><h2></h2>c"), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in readers.html_sections(pages).collect()] == [(1, 1, "Section 1", "a"), (1, 2, "T", "b"), (1, 3, "Section 3", "c")]
    sinks.replace_table(spark.range(3), str(tmp_path / "t"))
    sinks.replace_table(sinks.read_table(spark, str(tmp_path / "t")).where("id > 0"), str(tmp_path / "t"))
    assert sinks.read_table(spark, str(tmp_path / "t")).count() == 2


def test_out_of_order_leaves_a_longest_run(spark):
    import random

    from lexmill.operators.ingest import out_of_order

    r = random.Random(5)
    rows = [(g, n, r.randrange(9)) for g in range(40) for n in range(r.randrange(0, 14))] + [(0, 99, None)]
    gone = {(x.g, x.n) for x in out_of_order(spark.createDataFrame(rows, "g int, n int, v int"), "g", "n", "v").collect()}
    for g in range(40):
        v = [x[2] for x in rows if x[0] == g and x[2] is not None]
        most = []
        for i, x in enumerate(v):
            most.append(1 + max((most[k] for k in range(i) if v[k] <= x), default=0))
        left = [x[2] for x in rows if x[0] == g and x[2] is not None and x[:2] not in gone]
        assert left == sorted(left) and len(left) == max(most, default=0)


def test_every_query_is_compared_whatever_the_blocks(spark):
    import numpy as np

    from lexmill.operators import vectors

    r = np.random.default_rng(1)
    x = r.normal(size=(90, 4))
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, label int, vector array<double>")
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    want = {(q, i) for q in range(0, 90, 20) for i in sorted(set(range(90)) - {q}, key=lambda i: 1 - unit[q] @ unit[i])[:4]}
    for block in (2048, 7):
        assert {(y.query_id, y.id) for y in vectors.compared(df, df.where("id % 20 = 0"), 4, block=block).collect()} == want


def test_cluster_map_takes_the_200_authors_with_most_books(spark):
    from lexmill.catalog_more import cluster_map
    from lexmill.plans.star import load

    c = load(spark, "/root/testdata/sf0.001")
    named = {r.author for r in c.author_links.select("author").distinct().collect()}
    count = {r.author: r["count"] for r in c.books.groupBy("author").count().collect() if r.author in named}
    got = cluster_map(c).collect()
    assert len(count) > 40 and {r.node for r in got} == set(sorted(count, key=lambda a: (-count[a], a))[:200])
    assert {r.cluster for r in got} == set(range(1, 13))


def test_a_stopped_replacement_keeps_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.read_table(spark, path) is None
    sinks.replace_table(spark.range(3), path)
    (tmp_path / "t/v-000000000002").mkdir()  # a write that stopped before its _SUCCESS
    assert sinks.read_table(spark, path).count() == 3
    sinks.replace_table(spark.range(5), path)
    assert sinks.read_table(spark, path).count() == 5


def test_broken_rows_are_kept(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name,rank\nSMITH,1\nJONES,x\nLEE,2\n")
    rows = readers.csv_table(spark, str(tmp_path / "s.csv"), "name string, rank int").collect()
    assert len(rows) == 3 and [r.broken for r in rows] == [None, "JONES,x", None]
    (tmp_path / "d.jsonl").write_text('{"word": "a", "lang_code": "en", "pos": "n", "sounds": [{"ipa": "x"}]}\n{broken\n')
    lemmas = spark.createDataFrame([("a",)], "lemma string")
    assert [tuple(r) for r in readers.lexicon(spark, str(tmp_path / "d.jsonl"), lemmas).collect()] == [("a", "n", ["x"])]
    assert [r.line for r in readers.broken_lines(spark, str(tmp_path / "d.jsonl")).collect()] == ["{broken"]


def test_closure_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)], "c int, p int")
    assert relate.closure(df, "c", "p").count() == 60 * 61 // 2


def test_hot_words_in_blocks_give_the_same(spark):
    pairs = spark.createDataFrame([(e, m) for e in range(30) for m in range(40) if (e * 7 + m * 3) % 5 < 2], "e long, m long")
    one = sorted(map(tuple, relate.similar(pairs, "e", "m").collect()))
    assert one and one == sorted(map(tuple, relate.similar(pairs, "e", "m", block=3).collect()))
