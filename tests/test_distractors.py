import hashlib
import math
import random
import re

import pytest

from lexmill.operators import ring
from lexmill.operators.distractors import Rule, distractors

WORDS = "id long, lemma string, part_of_speech string, difficulty double, fields array<string>, vector array<double>, defined boolean"


def vec(*pairs):
    out = [0.0] * 4
    for i, x in pairs:
        out[i] = x
    return out


NAMES = {"target": 1, "targetsyn": 2, "lookalike": 3, "nearmiss": 4, "toosclose": 5, "toofar": 6, "samedomain": 7, "otherdomain": 8, "verbword": 9}


def seeded():
    rows = [
        (1, "target", "noun", 50.0, ["A"], vec((0, 1.0)), True), (2, "plum", "noun", 50.0, [], vec((0, 0.75), (1, 0.66)), True),
        (3, "targets", "noun", 50.0, [], None, True), (4, "quince", "noun", 50.0, [], vec((0, 0.72), (1, 0.694)), True),
        (5, "fig", "noun", 50.0, ["A"], vec((0, 0.99), (1, 0.141)), True), (6, "olive", "noun", 50.0, [], vec((2, 1.0)), True),
        (7, "bread", "noun", 50.0, ["A", "B"], None, True), (8, "glass", "noun", 50.0, ["C"], None, True), (9, "targeted", "verb", 50.0, ["A"], vec((0, 0.7), (1, 0.714)), True),
    ]
    return rows + [(100 + i, f"filler{chr(97 + i)}", "noun", 60.0 + i, [], None, True) for i in range(8)]


def run(spark, rule, banned=(), rows=None):
    words = spark.createDataFrame(rows or seeded(), WORDS)
    forbid = spark.createDataFrame([(1, b) for b in banned] or [(0, 0)], "target long, word long")
    return sorted(distractors(words, words.where("id = 1"), rule, [forbid]).collect(), key=lambda r: r.place)


def only(name, **more):
    return Rule(share=1.0, weights=tuple((n, 1.0 if n == name else 0.0) for n in ("orthographic", "semantic", "domain")), **more)


def test_part_of_speech_and_synonyms_hold_for_all_strategies(spark):
    got = {r.word for r in run(spark, Rule(count=8), banned=[2])}
    assert 9 not in got and 2 not in got and len(got) == 8


def test_each_strategy(spark):
    assert [r.word for r in run(spark, only("semantic", count=1), banned=[2])] == [4]
    assert [r.word for r in run(spark, only("orthographic", count=1))] == [3]
    others = [n for k, n in NAMES.items() if k not in ("target", "samedomain", "otherdomain")] + list(range(100, 108))
    assert [(r.word, r.strategy) for r in run(spark, only("domain", count=1), banned=others)] == [(7, "domain")]


def test_floor_holds_for_every_strategy_and_chance_fills_up(spark):
    rows = run(spark, only("domain", count=1), banned=[2, 4, 7])
    assert [r.strategy for r in rows] == ["random"] and rows[0].word != 5


def test_shortfall_goes_to_the_next_strategy_and_then_to_chance(spark):
    rows = run(spark, only("semantic", count=6), banned=[2])
    assert [r.strategy for r in rows] == ["semantic"] + ["random"] * 5 and not any(r.degraded for r in rows)
    rows = run(spark, Rule(count=4, share=1.0, weights=(("orthographic", 0.5), ("domain", 0.5))))
    assert [(r.strategy, r.word) for r in rows][:2] == [("orthographic", 3), ("domain", 7)] and [r.strategy for r in rows][2:] == ["random", "random"]
    rows = run(spark, Rule(count=4, share=1.0, weights=(("semantic", 0.75), ("domain", 0.25))), banned=[2])
    assert [(r.strategy, r.word) for r in rows][:2] == [("semantic", 4), ("domain", 7)]


def test_band_widens_last_and_says_so(spark):
    rows = run(spark, Rule(count=9, reach=0.0001, widen=15.0), banned=[2])
    assert len(rows) == 9 and all(r.degraded for r in rows) and {r.word for r in rows} >= {3, 4, 6, 7, 8}
    assert {r.strategy for r in rows if r.word >= 100} == {"random"}
    rows = run(spark, Rule(count=30, reach=0.0001, widen=1.0))
    assert len(rows) < 30 and all(r.degraded for r in rows)


def test_words_without_a_definition_can_be_left_out(spark):
    rows = [(*r[:6], r[0] != 4) for r in seeded()]
    assert 4 not in {r.word for r in run(spark, only("semantic", count=1, defined=True), banned=[2], rows=rows)}


@pytest.mark.parametrize("count, share, weights, want", [
    (10, 0.7, (("orthographic", 1 / 3), ("semantic", 1 / 3), ("domain", 1 / 3)), [3, 5, 7]),
    (10, 0.5, (("orthographic", 0.0), ("semantic", 0.2), ("domain", 0.8)), [4, 5]),
    (3, 0.7, (("orthographic", 1 / 3), ("semantic", 1 / 3), ("domain", 1 / 3)), [1, 2, 2]),
    (4, 0.0, (("semantic", 1.0),), [0]), (3, 1.0, (("antonym", 0.0),), []), (7, 1.0, (("a", 0.5), ("b", 0.3), ("c", 0.2)), [4, 6, 7]),
])
def test_shares_by_largest_remainder(count, share, weights, want):
    quotas = Rule(count=count, share=share, weights=weights).quotas()
    assert [n for _, n in quotas[:-1]] == want and quotas[-1] == ("random", count)


def plain(rows, rule, banned):
    """The whole rule, pair by pair."""
    place = lambda i: int(hashlib.md5(f"{rule.seed}:{i}".encode()).hexdigest()[:8], 16)
    grams = lambda t: {f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", t.lower()) for i in range(len(w) + 1)}

    def dist(a, b):
        if a is None or b is None:
            return None
        return round(1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)

    out = []
    for t in rows:
        if t[0] % 10:
            continue
        d = lambda w: ((place(w[0]) - place(t[0])) % 2**32, w[0])
        fit = [w for w in rows if w[0] != t[0] and w[2] == t[2] and (t[0], w[0]) not in banned and not ((dist(w[5], t[5]) or 9) < rule.floor)]
        inside = [w for w in fit if t[3] - rule.reach <= w[3] <= t[3] + rule.reach]
        alike = lambda w: round(len(grams(w[1]) & grams(t[1])) / len(grams(w[1]) | grams(t[1])), 6)
        lists = {
            "orthographic": sorted([w for w in inside if alike(w) > rule.alike], key=lambda w: (-alike(w), *d(w))),
            "semantic": sorted([w for w in inside if dist(w[5], t[5]) is not None and max(rule.near[0], rule.floor) <= dist(w[5], t[5]) <= rule.near[1]], key=lambda w: (dist(w[5], t[5]), w[0])),
            "domain": sorted([w for w in inside if set(w[4]) & set(t[4])], key=d), "random": sorted(inside, key=d),
        }
        got = []
        for name, upto in rule.quotas():
            for w in lists[name]:
                if len(got) < upto and w[0] not in [x for x, _ in got]:
                    got.append((w[0], name))
        degraded = len(got) < rule.count
        for w in sorted([w for w in fit if abs(w[3] - t[3]) <= rule.reach + rule.widen], key=d):
            if degraded and len(got) < rule.count and w[0] not in [x for x, _ in got]:
                got.append((w[0], "random"))
        out += [(t[0], w, s, i, degraded) for i, (w, s) in enumerate(got, 1)]
    return set(out)


def test_same_as_the_plain_rule_in_small_buckets(spark, monkeypatch):
    """Most words share one part of speech; buckets are small, so targets look further in rounds."""
    monkeypatch.setattr(ring, "BUCKET", 2)
    r = random.Random(11)
    rows = [(i, "".join(r.choice("abe") for _ in range(r.choice([3, 5, 8]))), "noun" if r.random() < 0.8 else r.choice(["verb", "adj"]), float(r.randrange(0, 1000)) / 10, r.sample("ABCD", r.choice([0, 1, 2])), [r.random() + 0.05 for _ in range(4)] if r.random() < 0.6 else None, True) for i in range(300)]
    banned = {(t, r.randrange(300)) for t in range(0, 300, 10) for _ in range(12)}
    rule = Rule(count=6, share=0.5, weights=(("semantic", 0.2), ("domain", 0.3), ("orthographic", 0.5)), reach=4.0, widen=6.0, floor=0.02, near=(0.01, 0.3), alike=0.25)
    words = spark.createDataFrame(rows, WORDS)
    got = distractors(words, words.where("id % 10 = 0"), rule, [spark.createDataFrame(sorted(banned), "target long, word long")]).collect()
    assert {tuple(x) for x in got} == plain(rows, rule, banned)


def test_nothing_to_draw_from(spark):
    words = spark.createDataFrame([(1, "a", None, None, [], None, True)], WORDS)
    assert distractors(words, words).count() == 0 and distractors(words.limit(0), words.limit(0)).count() == 0
