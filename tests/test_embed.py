import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexmill.operators import embed

DOCS = "doc_id long, text string"


def corpus(n=120, seed=5):
    r = random.Random(seed)
    topics = [[f"{t}{c}{d}" for c in "abcde" for d in "xy"] for t in ("ka", "mo", "zu")]
    return [(i, " ".join(r.choice(topics[i % 3]) for _ in range(30))) for i in range(n)] + [(900, None), (901, ""), (902, "it is")]


def plain_counts(rows, window, least):
    words = [[w for w in re.findall("[a-z]+", (t or "").lower()) if len(w) >= 3] for _, t in rows]
    seen = Counter(w for ws in words for w in ws)
    n = Counter()
    for ws in words:
        for i, a in enumerate(ws):
            for k in range(1, window + 1):
                if i + k < len(ws) and seen[a] >= least and seen[ws[i + k]] >= least:
                    for pair in {(a, ws[i + k]), (ws[i + k], a)}:
                        n[pair] += 1 / k
    return n


@pytest.fixture(scope="module")
def made(spark):
    frame = spark.createDataFrame(corpus(), DOCS).repartition(3)
    pairs = embed.settled(embed.cooccurrences(frame, 4, 5))
    matrix = embed.settled(embed.ppmi(pairs))
    return pairs, matrix, embed.settled(embed.trained(matrix, 6, 12))


def test_counts_and_information(made):
    want = plain_counts(corpus(), 4, 5)
    got = {(r.word, r.other): r.n for r in made[0].collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], abs_tol=1e-4) for p in want)
    own, context = Counter(), 0.0
    for (a, _), n in got.items():
        own[a] += n
    context = sum(x**0.75 for x in own.values())
    info = lambda a, b: max(0.0, math.log(got[a, b] / own[a] / (own[b] ** 0.75 / context)))
    values = {(r.word, r.other): r.value for r in made[1].collect()}
    full = {p: (info(*p) + info(p[1], p[0])) / 2 for p in got}
    assert values.keys() == {p for p, v in full.items() if v > 0} and all(math.isclose(values[p], full[p], rel_tol=1e-9) for p in values)


def test_same_as_eigenvectors_of_the_whole_matrix(made):
    values = {(r.word, r.other): r.value for r in made[1].collect()}
    names = sorted({a for a, _ in values})
    dense = np.array([[values.get((a, b), 0.0) for b in names] for a in names])
    found = {r.word: r.vector for r in made[2].collect()}
    assert sorted(found) == names
    rows = np.array([found[n] for n in names])
    eigen, turn = np.linalg.eigh(dense)
    for k in range(3):  # a gap follows the three topics
        want = turn[:, -1 - k] * math.sqrt(eigen[-1 - k])
        assert math.isclose(np.linalg.norm(rows[:, k]), np.linalg.norm(want), rel_tol=1e-3)
    top = turn[:, -3:] * eigen[-3:] @ turn[:, -3:].T
    assert np.abs(rows[:, :3] @ rows[:, :3].T - top).max() < 0.02 * np.abs(top).max()


def test_words_of_a_topic_are_nearest_and_runs_repeat(spark, made):
    asked = spark.createDataFrame([("kaax",), ("moby",), ("unknown",)], "word string")
    near = embed.nearest_words(made[2], asked, 5).collect()
    assert len(near) == 10 and all(r.word[:2] == r.query[:2] and r.word != r.query for r in near)
    again = {r.word: r.vector for r in embed.trained(made[1].repartition(5), 6, 12).collect()}
    assert all(np.allclose(again[r.word][:3], r.vector[:3], atol=1e-4) for r in made[2].collect())


def test_only_missing_words_are_filled(spark, made):
    known = made[2].where("word not in ('kaax', 'mocy')")
    words = made[2].select("word").union(spark.createDataFrame([("kaaxes",), ("qqq",), (None,)], "word string"))
    pairs = made[0].where("word <> 'mocy'")
    rows = {r.word: r for r in embed.filled(words, known, pairs, 6).collect()}
    assert {w: r.source for w, r in rows.items()} == {"kaax": "neighbours", "mocy": "spelling", "kaaxes": "spelling"}
    whole = {r.word: np.array(r.vector) for r in made[2].collect()}
    cosine = lambda a, b: a @ b / math.sqrt(a @ a * (b @ b))
    assert cosine(np.array(rows["kaax"].vector)[:3], whole["kaax"][:3]) > 0.9
    assert cosine(np.array(rows["mocy"].vector)[:3], whole["mocx"][:3]) > cosine(np.array(rows["mocy"].vector)[:3], whole["zuax"][:3])


def test_no_words(spark):
    none = spark.createDataFrame([(1, None)], DOCS)
    matrix = embed.ppmi(embed.cooccurrences(none))
    assert embed.trained(matrix, 4).count() == 0


@pytest.mark.parametrize("sent", [embed.SENT, 0])
def test_blocks_of_ranges(spark, monkeypatch, sent):
    """Many small blocks, whose ranges are sent to all tasks or shuffled: values as those of the table of pairs, vectors as those of the table of values."""
    monkeypatch.setattr(embed, "SENT", sent)
    docs = spark.createDataFrame(corpus() + [(903, "kaax kaax kaax once"), (904, "kaax " * 9)], DOCS).repartition(3)
    rows = embed.settled(embed.cooccurrences(docs))
    assert embed.counted(docs, block=2000).pairs.count() > 3
    want = {(r.word, r.other): r.value for r in embed.ppmi(rows).collect()}
    got = {(r.word, r.other): r.value for r in embed.information(docs, block=2000).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], rel_tol=1e-9) for p in want) and ("kaax", "kaax") in rows.select("word", "other").collect()
    one, two = ({r.word: r.vector for r in df.collect()} for df in (embed.trained_on(docs, 6, 12, block=2000), embed.trained(embed.ppmi(rows), 6, 12)))
    assert one.keys() == two.keys() and all(np.allclose(one[w][:3], two[w][:3], atol=1e-4) for w in one)
