"""What a Python worker takes for a batch, and what it keeps of it, does not follow from the size of the batch's text."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from lexmill.llm.op6_quality_classifier import fit, scorer, statistics
from lexmill.llm.op10_sentencepiece import Model, encoder, model
from lexmill.llm.shared import slices

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def texts(n, seed=1):
    r = random.Random(seed)
    return pa.array([" ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(600)) for _ in range(n)])


def peak_mb(function, *args):
    tracemalloc.start()
    try:
        out = function(*args)
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_scores_of_a_large_batch():
    batch = texts(1300)  # about 5 MB
    x = statistics(batch.slice(0, 200))
    trees = fit(x, (np.arange(200) % 2).astype(float), trees=2)
    got, mb = peak_mb(scorer(trees).func, batch)
    assert mb < 40
    assert got.to_pylist()[:200] == trees.score(x).tolist()


def test_ids_of_a_large_batch():
    batch = texts(1300, 2)
    model(PIECES).encode(batch.slice(0, 10))
    got, mb = peak_mb(encoder(PIECES).func, batch)
    assert mb < 80
    fresh = Model(PIECES)
    assert fresh.segments.most <= 400_000
    fresh.segments.most = 2000  # starts anew again and again
    for at in range(0, 40, 2):
        ids, upto = fresh.encode(batch.slice(at, 2))
        assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])] == got.slice(at, 2).to_pylist()


def test_free_memory_goes_back_after_a_batch(monkeypatch):
    calls = []
    pool = pa.default_memory_pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: calls.append(pool.bytes_allocated())})())
    one = pa.RecordBatch.from_arrays([texts(4)], names=["text"])
    assert sum(b.num_rows for b in slices(one, "text", 5000)) == 4 and len(calls) == 1


@pytest.mark.parametrize("n", [1, 5])
def test_words_found_again(n):
    from lexmill.llm.wordcache import WordCache

    cache = WordCache(lambda words: (np.array([len(w) for w in words.to_pylist()]), np.array([ord(c) for w in words.to_pylist() for c in w], np.int64)))
    r = random.Random(n)
    for _ in range(60):
        words = sorted({"".join(r.choices("abc", k=r.randint(1, n))) for _ in range(20)}, key=lambda _: r.random())
        values, start, size = cache.runs(pa.array(words))
        assert ["".join(map(chr, values[a : a + k])) for a, k in zip(start, size)] == words
        assert (np.diff(cache.hashes.astype(object)) > 0).all() and len(cache.words) == len(set(cache.words.to_pylist()))
