"""Steps whose largest task, or whose shuffle, must not grow faster than the input."""

import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lexmill.functions.columns import percent_ranks
from lexmill.registry import QUERIES
from lexmill.operators import dictionary, distractors, embed, ingest, lexicon, relate, ring, sessions, vectors
from lexmill.operators.distractors import Draw, Rule

from .test_distractors import WORDS
from .test_sessions import RULE, corpus


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_a_hot_value_and_nulls_sort_no_rows(spark):
    """No window holds the rows of a value or the nulls; results are those of the plain rank."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 != 0, F.when(F.col("id") % 5 != 0, F.lit(7.0)).otherwise(F.col("id") * 1.0)).alias("x"))
    out = percent_ranks(rows, {"x": "r"})
    assert "Window" not in plan(out)
    values = sorted(r.x for r in rows.collect() if r.x is not None)
    first = {x: values.index(x) / (len(values) - 1) for x in set(values)}
    assert {r.id: (r.x, r.r) for r in out.collect()} == {r.id: (r.x, None if r.x is None else first[r.x]) for r in rows.collect()}


def test_pairs_of_entities_are_not_shuffled(spark, monkeypatch):
    """Pairs are summed in the task of their first entity: the only exchange by entity has no pair in it, and each pair is made once."""
    pairs = spark.range(4000).select(F.concat(F.lit("n"), (F.col("id") % 97).cast("string")).alias("e"), (F.col("id") * 7919 % 211).alias("m"))
    plans, written = [], relate.settled
    monkeypatch.setattr(relate, "settled", lambda df: (plans.append(plan(df)), written(df))[1])
    got = relate.similar(pairs, "e", "m", 0.5, 3, 200, block=4)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in relate.similar(pairs, "e", "m", 0.5, 3, 200).collect()}
    assert got.where("a = b").count() == 0 and got.count() == got.select("a", "b").distinct().count() > 0
    assert not re.search(r"hashpartitioning\(a#\d+L?, b#", "".join([*plans, plan(got)]))


def test_small_file_of_entries_is_parsed_by_all_tasks(spark):
    n = 50
    rows = spark.range(n).coalesce(1).select("id", F.lit("word").alias("headword"), F.lit("word, n. 1. A thing. 1601 Smith of old.").alias("raw"))
    quotations = dictionary.relations(rows)[2]
    assert len(quotations.inputFiles()) > 1
    assert {(r.year, r.author, r.text) for r in quotations.collect()} == {(1601, "Smith", "of old.")} and quotations.count() == n


def test_pairs_of_words_are_shuffled_once(spark, monkeypatch):
    """One exchange of pairs whatever the window, and the matrix is laid out by its rows before it is multiplied."""
    plans, written = [], embed.settled
    monkeypatch.setattr(embed, "settled", lambda df: (plans.append(plan(df)), written(df))[1])
    docs = spark.createDataFrame([(i, "one two three four five six") for i in range(6)] + [(9, None), (10, "")], "doc_id long, text string")
    pairs = embed.cooccurrences(docs)
    assert {(r.word, r.other): r.n for r in pairs.collect()}["one", "four"] == 2.0
    assert len(re.findall(r"hashpartitioning\(a#\d+, b#", "".join(plans))) == 1
    embed.trained(embed.ppmi(pairs), 2, 1)
    assert re.search(r"hashpartitioning\(word#\d+, \d+\), REPARTITION", "".join(plans))


def test_no_row_of_a_pair_is_joined_or_shuffled(spark, tmp_path, monkeypatch):
    """Pairs of words travel in blocks: what is shuffled or joined by word is a vocabulary's row, never a pair's."""
    spark.createDataFrame([(i, "one two three four five six") for i in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, written = [], embed.settled
    monkeypatch.setattr(embed, "settled", lambda df: (plans.append(plan(df)), written(df))[1])
    for name in ("word_information", "trained_vectors"):
        plans.append(plan(QUERIES[name](spark, str(tmp_path))))
    assert plans and not re.search(r"(hashpartitioning|HashJoin|MergeJoin).*\bother#", "\n".join(plans))


def test_stretches_below_the_floor_are_not_followed(spark):
    """Above the floor as without it, below it 0; pairs are dealt to a stated number of tasks."""
    rows = spark.createDataFrame([("small ring", "a smell rang small rings"), ("small ring", "nothing like"), ("abc", None), ("", "abc")], "asked string, text string")
    low, high = (rows.select(lexicon.window_similarity(F.col("asked"), F.col("text"), x).alias("s")).collect() for x in (0.0, 0.5))
    assert [r.s for r in high] == [r.s if r.s > 0.5 else 0.0 for r in low] and high[0].s > 0.5


def test_targets_with_enough_lookalikes_stop_at_a_high_floor(spark, monkeypatch):
    """A target whose first words lie above a high floor is not sought above the rule's; the others are."""
    rows = [(i, f"wordy thing {i % 3}", "noun", 50.0, [], None, True) for i in range(12)] + [(90, "wordy thin", "noun", 50.0, [], None, True), (91, "zq", "noun", 50.0, [], None, True)]
    words = spark.createDataFrame(rows, WORDS)
    draw = Draw(words, words, Rule())
    asked, whole = draw.banded(), draw.alike
    seen = []
    monkeypatch.setattr(draw, "alike", lambda left, w, t, need, floor: (seen.append((floor, {r.target for r in left.collect()})), whole(left, w, t, need, floor))[1])
    got = {tuple(r) for r in draw.lookalikes(asked, 2).select("target", "word", "nth").collect()}
    assert [f for f, _ in seen] == [0.75, 0.5, 0.3] and 0 not in seen[1][1] and {91} == seen[-1][1]
    monkeypatch.setattr(distractors, "FLOORS", ())
    assert got == {tuple(r) for r in draw.lookalikes(asked, 2).select("target", "word", "nth").collect()} and got


def test_sessions_send_no_rows_of_words_or_askers_to_all(spark, monkeypatch):
    """However small the files are, only tables of keys and vectors are broadcast."""
    plans, written = [], ring.settled
    for module in (ring, distractors, sessions):
        monkeypatch.setattr(module, "settled", lambda df: (plans.append(plan(df)), written(df))[1])
    words, asked = spark.createDataFrame(corpus(), WORDS), spark.range(2).select(F.col("id").alias("session"))
    banned = spark.createDataFrame([(0, 10), (20, 30)], "target long, word long")
    plans.append(plan(sessions.sessions(asked, words, sessions.Plan(length=4), RULE, [banned])))
    sent = re.findall(r"BroadcastHashJoin \[(.*?)\], \[.*?\], (\w+)", "".join(plans))
    assert sent and not [(keys, kind) for keys, kind in sent if re.search(r"(asker|item|target|word|id|bucket)#", keys) and not (kind == "LeftOuter" and "," not in keys)]


def test_words_of_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Texts go to their documents' tasks, words to their lemma's; the links are those of a plain loop."""
    texts = {1: "the Old rose, the old ROSE", 2: "the Rose the rose garden the the", 3: "The OLD the Garden Xenon it", 4: None, 5: "", 6: "the the Xenon xenon ox garden"}
    docs = spark.createDataFrame([*texts.items(), (2, "Old the"), (None, "the rose")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plans, written = [], getattr(ingest, "settled", lambda df: df)
    monkeypatch.setattr(ingest, "settled", lambda df: (plans.append(plan(df)), written(df))[1], raising=False)
    plans.append(plan(QUERIES["mention_links"](spark, str(tmp_path))))
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", "".join(plans))
    assert exchanges and not [keys for keys in exchanges if "doc_id" in keys and "lemma" in keys] and sum("doc_id" in keys for keys in exchanges) == 1

    shown, kept = {}, {}
    for i, text in [*texts.items(), (2, "Old the"), (None, "the rose")]:
        for w in re.findall("[A-Za-z]{3,}", text or ""):
            shown.setdefault((i, w.lower()), []).append(w)
    for (i, w), forms in shown.items():
        judged = [f for f in forms if not f.isupper()]
        if w != "the" and i is not None and sum(f[0].isupper() for f in judged) < 0.85 * max(len(judged), 1):
            kept[w] = min(i, kept.get(w, i))
    want = {(i, kept[w], forms[0]) for (i, w), forms in shown.items() if w in kept and i not in (None, kept[w])}
    monkeypatch.undo()
    got = [tuple(r) for r in ingest.first_mentions(docs, 8.4).collect()]
    assert len(got) == len(want) and set(got) == want and want


def test_first_ring_is_compared_once_and_few_distances_are_measured(spark):
    """Blocks meet once for each ring; ties, zero vectors and unknown components as in a plain loop over all pairs."""
    r = random.Random(3)
    rows = [(i, i % 3, [r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for i in range(400)] + [(900, 0, [0.0] * 4), (901, 1, None), (920, 0, [1.0, None, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    asked = df.where("id % 20 = 0")
    assert plan(vectors.all_two_rings(df, asked)).count("FlatMapCoGroupsInArrow") == 1
    whole = [(i, c, np.array(v)) for i, c, v in rows if v is not None and None not in v and any(v)]
    for low, high, same, k in ((-1.0, 3.0, False, 5), (0.3, 0.8, True, 7), (0.3, 0.8, False, None)):
        want = set()
        for i, c, v in whole:
            found = sorted((round(1 - min(max(float(v @ w) / math.sqrt(v @ v * (w @ w)), -1), 1), 6), j) for j, d, w in whole if i % 20 == 0 and j != i and (c == d or not same))
            want |= {(i, j, x) for x, j in [f for f in found if low <= f[0] <= high][:k]}
        got = [(x.query_id, x.id, x.distance) for x in vectors.compared(df, asked, k, same, low, high, block=90).collect()]
        assert len(got) == len(want) and set(got) == want and want


def test_stretches_of_many_queries_are_bounded_first(monkeypatch):
    """With bounds over all queries of a text as without them: long and empty texts, repeated words, unknown trigrams."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.choice([1, 2, 4, 7])))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 5, 60, 300)] + ["", None, "ab " * 500]
    asked = [" ".join(word() for _ in range(r.choice([1, 3, 5]))) for _ in range(60)] + ["", None, "zzz", "ab ab"]
    rows = [(a, t) for t in texts for a in asked]
    for least in (0.3, 0.5, 0.8):
        found = []
        for many in (1, 1 << 30):
            monkeypatch.setattr(lexicon, "MANY", many)
            found.append(lexicon._best_window.func(*[pd.Series(x) for x in zip(*[(a, t, least) for a, t in rows])]).tolist())
        assert found[0] == found[1] and any(found[0])
