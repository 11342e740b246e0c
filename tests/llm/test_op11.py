import random
import re
from itertools import permutations

from lexmill.llm.op11_filter_audit import ORDERS, filter_audit, first_failures

DOCS = "doc_id long, text string, lang string, part string, mask int, step string"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    good = {d for d, q, _, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, _ in labels if t == 1 and d is not None}
    rows = []
    for doc, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = any(doc is not None and d is not None and d < doc and (x or "") == t for d, x, *_ in docs)
        rows.append((lang or "", {f for f in fails if fails[f]}, doc in good, doc in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        own, total, got = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                hit = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(hit)
                got.append((part, order, step, len(left), len(hit), sum(f in r[1] for r in own) - len(hit), sum(r[1] == {f} for r in own), sum(r[2] for r in hit), sum(r[3] for r in hit)))
        out |= {(*g, total[g[1][g[2] - 1]]) for g in got}
    return out


def made(n=80, seed=5):
    r = random.Random(seed)
    texts = ["", " \n", None, "é" * 50, "A" * 9 + "é" * 81, "A" * 8 + " " * 72, "a$b", " ".join(f"W{i}" for i in range(120)), " ".join(f"w{i % 50}" for i in range(130)), "x " * 100, " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(99)), "a b c", "w " * 30000 + "end|"]
    docs = [(i, r.choice(texts), r.choice(["en", "de", "", None]), "z", 3, "s") for i in range(n)]
    docs += [(3, docs[3][1], "en", "z", 3, "s"), (None, "x " * 100, "en", "z", 3, "s"), (None, "only here", "fr", "z", 3, "s"), (-4, "a$b", "de", "z", 3, "s")]
    labels = [(r.randrange(n + 9), r.choice([0, 1, None]), r.choice([0, 1, None]), "q") for _ in range(90)] + [(None, 1, 1, "q")]
    return docs, labels


def test_same_as_plain_filters(spark):
    docs, labels = made()
    got = filter_audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    assert {tuple(r) for r in got} == brute(docs, labels) and len(got) == 600 * 4


def test_one_hot_text_and_empty_tables(spark):
    docs = [(i, "same text", "en", "z", 3, "s") for i in range(500)]
    labels = [(i, 1, 0, "q") for i in range(0, 500, 7)]
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert {tuple(r) for r in filter_audit(frame, marks).collect()} == brute(docs, labels)
    assert {tuple(r) for r in filter_audit(frame, marks.limit(0)).collect()} == brute(docs, [])
    assert filter_audit(frame.limit(0), marks).count() == 0


def test_table_holds_the_first_failure():
    table = first_failures()
    assert table.shape == (32, 120) and len(set(ORDERS)) == 120 and (table[0] == 5).all() and (table[31] == 0).all()
    assert table[0b00100, ORDERS.index("ABCDE")] == 2 and table[0b10010, ORDERS.index("CEDBA")] == 1
