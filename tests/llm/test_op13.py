import random

import numpy as np

from lexmill.llm.op13_minhash_dedup import COORDINATES, ROUND_SHIFT, ROWS, band_keys, fast_sketch, near_duplicates

from .test_op4 import DOCS, brute, corpus


def same_as_brute(spark, rows, num, den, width):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, DOCS), num, den, width).collect()}
    assert got == brute(rows, num, den, width)


def test_same_components_as_brute_force(spark):
    for num, den, width in ((80, 100, 4), (80, 100, 5)):
        same_as_brute(spark, corpus(seed=4), num, den, width)


def test_hot_groups_in_many_blocks(spark, monkeypatch):
    from lexmill.llm import op4_jaccard_join as op4

    monkeypatch.setattr(op4, "BLOCK", 4)
    r = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = shared + [f"c{i % 3}_{j}" for j in range(20)] if i < 60 else shared + [f"u{i}_{j}" for j in range(r.randint(3, 30))]
        w[r.randrange(len(w))] = "odd"
        rows.append((i, " ".join(w)))
    same_as_brute(spark, rows, 80, 100, 5)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, long), (7, long), (None, long), (8, long + " end"), (8, long + " end")]
    df = spark.createDataFrame([(*r, 1, "z", True) for r in rows], "doc_id long, text string, n int, component_id string, kept boolean")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()))
    assert got == [(-1, 4996, None, None), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 4996, 6, True), (7, 4996, 6, False), (8, 4997, 6, False), (8, 4997, 6, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def plain_sketch(h):
    """Round by round, member by member, without an end before the last round."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    best = {}
    for i in range(2 * COORDINATES):
        for x in h:
            y = mix((x + i * 0x9E3779B97F4A7C15 + 1) & mask)
            at = ((y >> 32) * COORDINATES) >> 32 if i < COORDINATES else i - COORDINATES
            value = i << ROUND_SHIFT | mix(y ^ 0x2545F4914F6CDD1D) >> (64 - ROUND_SHIFT)
            best[at] = min(best.get(at, mask), value)
    return [best[k] for k in range(COORDINATES)]


def test_every_coordinate_fills_as_in_the_plain_rounds():
    r = random.Random(1)
    for n in (1, 2, 3, 7, 40, 160, 900):
        h = sorted(r.getrandbits(64) for _ in range(n))
        assert fast_sketch(np.array(h, np.uint64)).tolist() == plain_sketch(h)


def test_agreement_is_concentrated_about_the_similarity():
    rng = np.random.default_rng(2)
    for n, both in ((5, 4), (20, 16), (100, 80), (1000, 800), (1000, 300)):
        agree, banded = [], []
        for _ in range(200):
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = fast_sketch(x[:n]), fast_sketch(x[n - both :])
            agree.append((a == b).mean())
            banded.append(bool((band_keys(a) == band_keys(b)).any()))
        j = both / (2 * n - both)
        assert abs(np.mean(agree) - j) < 0.02 and np.std(agree) < 1.15 * np.sqrt(j * (1 - j) / COORDINATES)
        assert j < 0.6 or np.mean(banded) > 0.98
    assert COORDINATES % ROWS == 0 and (1 - 0.8**ROWS) ** (COORDINATES // ROWS) < 1e-9
