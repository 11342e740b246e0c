import collections
import math
import re

import numpy as np
import pyarrow as pa

from lexmill.llm.op6_quality_classifier import FEATURES, fit, keep_good, scores, statistics

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() >= 0.95
    again = scores(docs, labels).toPandas().set_index("doc_id").score
    assert (got.set_index("doc_id").score == again[got.doc_id]).all()


def plain_features(text):
    """The statistics of one text, in plain Python."""
    text = text or ""
    words, raw, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.encode(), text.split("\n")
    if not words:
        return [0.0] * len(FEATURES)
    n, size, long = len(words), len(raw), [len(w) for w in words]
    mean = sum(long) / n
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    triples = {tuple(low[i : i + 3]) for i in range(n - 2)} or {tuple(low)}
    count = lambda chars: sum(text.count(c) for c in chars)
    upper, lower = (sum(a <= c <= z for c in text) for a, z in ("AZ", "az"))
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
    share = [k / size for k in collections.Counter(raw).values()]
    found = {
        "log_words": math.log1p(n), "log_bytes": math.log1p(size), "word_length": mean, "word_length_sd": math.sqrt(max(sum(x * x for x in long) / n - mean * mean, 0)),
        "longest_word": math.log1p(max(long)), "short_words": sum(x <= 3 for x in long) / n, "upper": upper / max(upper + lower, 1), "digits": count("0123456789") / size,
        "punctuation": marks / n, "symbols": count("#*$%&|<>") / n, "exclamations": count("!") / n, "bars": count("|") / n, "lines": len(lines) / n,
        "distinct_words": len(set(words)) / n, "distinct_triples": len(triples) / max(n - 2, 1), "distinct_lines": len(set(lines)) / len(lines),
        "top_word": max(collections.Counter(words).values()) / n, "non_ascii": sum(b >= 128 for b in raw) / size, "entropy": -sum(p * math.log(p) for p in share),
    }
    return [found[f] for f in FEATURES]


def walk(t, row):
    total = t.base
    for f, h, v in zip(t.feature, t.threshold, t.value):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if row[f[node]] > h[node] else 1)
        total += v[node - len(f)]
    return 1 / (1 + math.exp(-min(max(total, -30), 30)))


def test_statistics_equal_plain_ones(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts += [None, "", " \n", "one", "Two words", "A a A\nA a A\n\n", "#*|! é日𝄞 12%", "x" * 5000]
    assert np.allclose(statistics(pa.array(texts)), [plain_features(t) for t in texts], atol=1e-7)


def test_split_is_the_best_of_all():
    r = np.random.default_rng(4)
    x = r.integers(0, 9, size=(300, 3)).astype(float)
    y = (x[:, 1] + r.normal(size=300) > 4).astype(float)
    t = fit(x, y, trees=1, depth=1, bins=64)
    share = (y.sum() + 0.5) / 301
    g, h = share - y, np.full(300, share * (1 - share))
    best = max(
        ((g[x[:, j] <= c].sum() ** 2 / (h[x[:, j] <= c].sum() + 1) + g[x[:, j] > c].sum() ** 2 / (h[x[:, j] > c].sum() + 1), -j, -c) for j in range(3) for c in range(8) if min(h[x[:, j] <= c].sum(), h[x[:, j] > c].sum()) >= 3),
    )
    assert (t.feature[0, 0], np.floor(t.threshold[0, 0])) == (-best[1], -best[2])


def test_trees_equal_a_plain_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = fit(x, y, trees=10, depth=3)

    assert np.allclose(t.score(x), [walk(t, row) for row in x])
    assert ((t.score(x) > 0.5) == y).mean() > 0.9


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "  ", "c"), (None, "word " * 100, "d"), (5, "x" * 200_000, "e"), (5, "x" * 200_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in scores(docs, none).collect()] == [1 / (1 + np.exp(-30.0))] * 6
    some = spark.createDataFrame([(5, 0, 0), (5, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in scores(docs, some).collect())
    assert keep_good(docs, none).columns == docs.columns and keep_good(docs, none).count() == 6
    assert scores(docs.limit(0), some).count() == 0
    from lexmill.llm.op6_quality_classifier import trained

    many = docs.unionByName(docs).unionByName(docs)  # a labelled document met more often than the bound
    assert (trained(many, some, most_rows=4).value == trained(many.repartition(5), some, most_rows=4).value).all()
