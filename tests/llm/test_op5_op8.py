import collections
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from lexmill.llm import sql
from lexmill.llm.op5_quality_rules import keep_good, quality_rules
from lexmill.llm.op8_mixing import _hypergeometric, block_plan, mixed, sized, splitting_tree, taken, targets

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_rules_same_as_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from read_parquet('{SF}/documents.parquet')")
    for low in (100, 20):
        got = quality_rules(docs(spark), min_docs=low).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql.quality_rules(min_docs=low)).fetchall())


def test_rules_keep_clean_and_drop_junk(spark):
    got = {r.doc_id: r.kept for r in quality_rules(docs(spark)).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    long = {r.doc_id for r in docs(spark).collect() if len(WORD.findall(r.text or "")) >= 50}
    good = [got[r.doc_id] for r in labels if r.quality == 1 and r.doc_id in long]
    bad = [got[r.doc_id] for r in labels if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and not any(bad)


def test_rules_odd_rows(spark):
    fine = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "\n \t\n", "en", None), (4, fine, None, "a"), (4, fine, None, "a"), (5, "a b c " * 40_000, "en", "a"), (None, fine + "\n" + fine, "en", "a")]
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, lang string, source string, n_words int, kept string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_repeat_words, r.n_dup_lines, r.base_failed, r.kept) for r in quality_rules(df).collect())
    assert got == [(0, 120, 120, 1, True, False), (1, 0, 0, 0, True, False), (2, 0, 0, 0, True, False), (3, 0, 0, 0, True, False), (4, 60, 0, 0, False, True), (4, 60, 0, 0, False, True), (5, 120_000, 120_000, 0, True, False)]
    kept = keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [4, 4] and kept.first().kept == "k"
    assert quality_rules(df.limit(0)).count() == 0


def filled(sizes, weights, share=1.5, stop=2.0):
    """Targets by repeated sharing."""
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > stop * sizes[i]]
        for i in over or open_:
            out[i] = stop * sizes[i] if over else unit * weights[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in over] if over else []
    return out


def test_mix_meets_its_targets(spark):
    rows = taken(docs(spark)).collect()
    text = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in docs(spark).collect()}
    assert all(r["size"] == text[r.doc_id][1] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[text[r.doc_id][0]].append(r)
    names = sorted(by)
    want = filled([sum(r["size"] for r in by[s]) for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want):
        assert abs(by[s][0].target - t) < 1e-6 * t and by[s][0].source_size == sum(r["size"] for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= 0.02 * t
    assert all(r.taken <= 2 * r["size"] and r.taken == r["size"] * len(r.shards) for r in rows if r["size"])
    assert sorted(map(str, rows)) == sorted(map(str, taken(docs(spark).repartition(5)).collect()))


def test_tree_deals_equal_shards_and_disjoint_units(spark):
    plan = block_plan(sized(docs(spark), 64, 7), shards=8).collect()
    load = collections.Counter(s for r in plan for s in r.shards)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 3
    assert all(len(r.shards) == r.copies for r in plan)
    out = mixed(docs(spark), blocks=64, shards=8, shard_column="shard").select("doc_id", "shard").collect()
    copies = {(r.doc_id, len(r.shards)) for r in taken(docs(spark), blocks=64, shards=8).collect()}
    count = collections.Counter(r.doc_id for r in out)
    assert all(count[d] == n for d, n in copies)


def test_any_number_of_shards(spark):
    for shards in (1, 3, 10):
        load = collections.Counter(s for r in block_plan(sized(docs(spark), 64, 7), shards=shards).collect() for s in r.shards)
        assert set(load) == set(range(shards)) and max(load.values()) - min(load.values()) <= 1


def test_draws_follow_the_hypergeometric_law(spark):
    import math

    def law(n, k, d):
        return [math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d) if x <= d else 0.0 for x in range(k + 1)]

    cases = [(10, 4, 5), (50, 50, 20), (40, 3, 39), (7, 5, 0), (1000, 300, 400)]
    chances = [(i + 0.5) / 400 for i in range(400)]
    df = spark.createDataFrame([(*c, u) for c in cases for u in chances], "n long, k long, d long, u double")
    got = collections.Counter((r.n, r.k, r.d, r.x) for r in df.withColumn("x", _hypergeometric(F.col("n"), F.col("k"), F.col("d"), F.col("u"))).collect())
    for n, k, d in cases:
        for x, p in enumerate(law(n, k, d) if d else [1.0] + [0.0] * k):
            assert abs(got[n, k, d, x] / 400 - p) <= 1.01 / 400


def test_tree_with_many_sources_keeps_all_counts(spark):
    own = {i: 1 + i * 7 % 11 for i in range(1, 701)}  # three groups of sources
    rows = splitting_tree(spark.createDataFrame(list(own.items()), "rank long, own long"), 6, 3, 700).collect()
    by, load = collections.Counter(), collections.Counter()
    for r in rows:
        by[r["rank"]] += r.quota
        load[r.shard] += r.quota
    assert by == own and set(load) == set(range(6)) and max(load.values()) - min(load.values()) <= 1


def test_mix_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (None, "x y", None), (4, "", "t"), (5, "w " * 50_000, "é"), (6, "one", "Z")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, block int")
    got = taken(df).collect()
    assert len(got) == 7 and all(r.taken <= 2 * r["size"] for r in got)
    order = {r.source: r.target for r in targets(df.selectExpr("source", "cast(size(split(text, ' ')) as long) as size")).collect()}
    assert set(order) == {"s", "t", "é", "Z", None}
    assert mixed(df).columns == df.columns
    assert taken(df.limit(0)).count() == 0 and mixed(df.limit(0)).count() == 0


def test_mix_is_near_with_one_dominant_document(spark):
    rows = [(f"{k}-{i}", f"s{k:02}", 6000 if i == 0 else 40 + i % 21) for k in range(60) for i in range(400)]  # 23 % of its source, or else 50 words
    sizes = spark.createDataFrame([(d, s, n, zlib.crc32(d.encode()) % 1024) for d, s, n in rows], "doc_id string, source string, size long, block long")
    for seed in (7, 8):
        got = collections.defaultdict(list)
        for r in block_plan(sizes, seed=seed).collect():
            got[r.source].append(r)
        words = collections.Counter()
        for _, s, n in rows:
            words[s] += n
        own = collections.Counter()
        for d, s, n in rows:
            own[s, zlib.crc32(d.encode()) % 1024] += n
        assert len(got) == 60
        for s, plan in got.items():
            assert {r.copies - min(x.copies for x in plan) for r in plan} <= {0, 1}
            assert abs(sum(r.copies * own[s, r.block] for r in plan) - plan[0].target) <= 100, s


def test_blank_documents_of_a_capped_source_come_twice_at_most(spark):
    from lexmill.llm.op8_mixing import mixed

    small = [(i, None, "a") for i in range(200)] + [(200, "one two three", "a")]
    large = [(1000 + i, "w " * 50, "b") for i in range(60)]
    empty = [(2000 + i, " ", "c") for i in range(5)]
    frame = spark.createDataFrame(small + large + empty, "doc_id long, text string, source string")
    times = {r.doc_id: r["count"] for r in mixed(frame, blocks=64, shards=4).groupBy("doc_id").count().collect()}
    assert {times.get(i, 0) for i in range(201)} == {2}
    assert max(times.values()) <= 2 and all(times.get(2000 + i) == 1 for i in range(5))
