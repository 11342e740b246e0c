import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from lexmill.llm.op12_conversation_trie import rebuilt, trie

ROWS = "conv_id long, turn long, role string, text string, parent string, group string, top int"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            key = sha256((str(len((role or "").encode())) + ":" + (role or "") + (text or "")).encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, key, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = set()
    for v, cs in members.items():
        below = [w for w in members if w[: len(v)] == v]
        kids = [w for w in below if len(w) == len(v) + 1]
        inner = {w[:-1] for w in below if len(w) > len(v)}
        saved = sum((len(members[w]) - 1) * len(w[-1][1].encode()) for w in below if w)
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(v))
        out.add((min(cs), len(v), min(members[v[:-1]]) if v else None, len(cs), len(kids), len([w for w in below if w not in inner]), saved, sha256(ends.encode()).hexdigest()))
    return out


def made(seed, n=90):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        c = c if c % 7 else c + 500
        words = ["hi", "é", "", "longer text", None]
        start = [("system", "hot"), ("user", "same"), ("assistant", "same")] if r.random() < 0.4 else []
        turns = start + [(r.choice(["user", "assistant", None]), r.choice(words)) for _ in range(r.choice([0, 1, 2, 3, 9, 14]))]
        rows += [(c, i if i else r.choice([None, -1, 0]), role, text, "p", "g", 1) for i, (role, text) in enumerate(turns)]
        if r.random() < 0.1:
            rows += rows[-1:]
    return rows + [(None, 1, "user", "x", "p", "g", 1), (-7, 0, "user", "hi", "p", "g", 1), (-5, 0, "user", "hi", "p", "g", 1)]


@pytest.mark.parametrize("most, seed", [(1 << 15, 1), (40, 2), (5, 3)])
def test_same_as_plain_nodes(spark, most, seed):
    """Whole subtries, and ones cut again and again."""
    rows = made(seed)
    got = trie(rebuilt(spark.createDataFrame(rows, ROWS).repartition(6)), most, 30).collect()
    assert {tuple(x) for x in got} == brute(rows) and len(got) == len(brute(rows))


def test_a_hot_conversation_and_long_chains(spark):
    hot = [(c, i, "user", "x" * i, "p", "g", 1) for c in range(0, 400) for i in range(3)]
    long = [(1000 + 5 * c, i, "user", str(i), "p", "g", 1) for c in range(3) for i in range(300 + c)]
    got = trie(rebuilt(spark.createDataFrame(hot + long, ROWS)), 100, 50).collect()
    assert {tuple(x) for x in got} == brute(hot + long)


def test_nothing_and_no_turns_left(spark):
    frame = spark.createDataFrame([(6, 0, "user", "x", "p", "g", 1)], ROWS)
    assert zlib.crc32(b"6") % 9 > 0
    got = [tuple(x) for x in trie(rebuilt(frame)).collect()]
    assert got == [(6, 0, None, 1, 0, 1, 0, sha256(b"6").hexdigest())]
    assert trie(rebuilt(frame.limit(0))).count() == 0
