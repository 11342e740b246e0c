import random
import re
from collections import defaultdict

from pyspark.sql import types as T

from lexmill.llm.op4_jaccard_join import Join, keep_one, near_duplicates

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def brute(rows, num, den, width):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, holders = sorted(sets), defaultdict(list)
    for i in ids:
        near = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                near[j] += 1
            holders[s].append(i)
        for j, both in near.items():
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3, n=220):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.5 or i < 5:
            w = [r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 200, 600]))]
            if r.random() < 0.4:
                w = shared + w
        else:
            w = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.3:
                w = w + [r.choice(words)]
        rows.append((i, " ".join(w)))
    return rows


def test_same_components_as_brute_force(spark):
    for num, den, width in ((85, 100, 4), (80, 100, 5)):
        rows = corpus()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, DOCS), num, den, width).collect()}
        assert got == brute(rows, num, den, width)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, long), (7, long), (None, long), (8, long + " end"), (8, long + " end")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, component_id string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == [(-1, 4996, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 4996, 6), (7, 4996, 6), (8, 4997, 6), (8, 4997, 6)]
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6]
    assert near_duplicates(df.limit(0)).count() == 0


def test_parts_always_outnumber_the_allowed_difference():
    for num, den in ((85, 100), (80, 100), (1, 2)):
        j = Join(num, den, 4)
        for n in (*range(1, 400), 5000, 20000):
            band = j.band(n)
            assert j.parts(band) > j.allowed(n) and j.band(j.partner(n)) <= band + max(1, round(j.partner(n) / n))


def test_hot_groups_in_many_blocks(spark, monkeypatch):
    """Components larger than a block, and many small ones, that share keys."""
    from lexmill.llm import op4_jaccard_join as op4

    monkeypatch.setattr(op4, "BLOCK", 4)
    r = random.Random(9)
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for i in range(120):
        w = shared + [f"c{i % 3}_{j}" for j in range(10)] if i < 60 else shared + [f"u{i}_{j}" for j in range(r.randint(3, 30))]
        w[r.randrange(len(w))] = "odd"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(spark.createDataFrame(rows, DOCS), 80, 100, 5).collect()}
    assert got == brute(rows, 80, 100, 5)


def test_keep_one_loses_no_text(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(1, texts[0], "x"), (1, texts[1], "x"), (1, texts[1], "y"), (2, texts[1] + " end", "x"), (3, texts[2], "x"), (3, texts[2], "x"), (None, texts[2], "x")]
    kept = [tuple(x) for x in keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert sorted(t for _, t, _ in kept if t[0] != "b") == [texts[0], texts[2], texts[2]]
    assert len([t for _, t, _ in kept if t[0] == "b"]) == 1 and (None, texts[2], "x") in kept
