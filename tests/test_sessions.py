import hashlib
import random

from lexmill.operators.distractors import Rule
from lexmill.operators.sessions import Plan, sessions

from .test_distractors import WORDS, plain

RULE = Rule(share=0.5, weights=(("domain", 0.5), ("orthographic", 0.5)), reach=10.0, widen=20.0)


def corpus(n=160, seed=3):
    r = random.Random(seed)
    return [(10 * i, "".join(r.choice("abe") for _ in range(5)), "noun" if r.random() < 0.8 else "verb", float(r.randrange(0, 1000)) / 10, r.sample("ABCD", 1), None, True) for i in range(n)]


def by_hand(rows, names, plan, rule, banned):
    """One session after the other: every question looks through all words."""
    from dataclasses import replace

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    place = lambda i: int(md5(f"{plan.seed}:{i}")[:8], 16)
    out = set()
    for name in names:
        pool = sorted(rows, key=lambda w: ((place(w[0]) - place(name)) % 2**32, w[0]))[: plan.pool]
        used, seq = set(), 0
        for word in pool:
            h = md5(f"{plan.seed}:{name}:{word[0]}")
            kind, true = plan.kinds[int(h[:8], 16) % len(plan.kinds)], h[8] < "8"
            n = {"choice": plan.choices - 1, "matching": plan.pairs - 1}.get(kind, 0 if true else 1)
            if seq == plan.length or word[0] in used:
                continue
            got = []
            if n:
                left = [w for w in rows if w[0] == word[0] or w[0] not in used]
                only = replace(rule, count=n)
                got = sorted((i, w, d) for t, w, s, i, d in plain(left, only, banned | {(t[0], u) for t in rows for u in used}) if t == word[0])
                if not got:
                    continue
            seq += 1
            out.add((name, seq, kind, word[0], tuple(w for _, w, _ in got), true if kind == "truth" else None, bool(n) and (not got or got[0][2])))
            used |= {word[0], *[w for _, w, _ in got]}
    return out


def test_no_word_twice_and_same_as_by_hand(spark):
    rows, names, plan = corpus(), ["ann", "bob"], Plan(length=6, pairs=3)
    banned = {(rows[i][0], rows[i + 1][0]) for i in range(40)}
    words = spark.createDataFrame(rows, WORDS)
    asked = spark.createDataFrame([(n,) for n in [*names, "bob", None]], "session string")
    got = sessions(asked, words, plan, RULE, [spark.createDataFrame(sorted(banned), "target long, word long")]).collect()
    for name in names:
        own = sorted((r for r in got if r.session == name), key=lambda r: r.seq)
        shown = [w for r in own for w in [r.target, *r.others]]
        assert len(own) == 6 and [r.seq for r in own] == list(range(1, 7)) and len(shown) == len(set(shown))
    assert {(r.session, r.seq, r.kind, r.target, tuple(r.others), r.is_true, r.degraded) for r in got} == by_hand(rows, names, plan, RULE, banned)


def test_poor_corpus_gives_fewer_questions(spark):
    words = spark.createDataFrame(corpus(7), WORDS)
    rows = sessions(spark.createDataFrame([(1,)], "session int"), words, Plan(kinds=("matching",)), RULE).collect()
    shown = [w for r in rows for w in [r.target, *r.others]]
    assert 0 < len(rows) < 10 and len(shown) == len(set(shown))
    assert sessions(spark.createDataFrame([(1,)], "session int"), words.limit(0)).count() == 0
