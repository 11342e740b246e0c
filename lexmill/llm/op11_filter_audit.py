"""Filter interaction audit: what each of five filters removes in every order of applying them.

Each document becomes five bits, the filters it fails. A table of 32 masks by 120 orders holds the step at which
a mask is first caught; tasks look their documents up in it and count, with ``np.bincount``, documents by part,
order and step, once for all and once for each label. These partial arrays are summed in Spark, and kept,
redundant and shapley follow from the sums.

Filters, on words (maximal runs without ASCII white space, case-sensitive): A: under 100 words; B: under 80 %
of the words are distinct; C: over 10 % of the code points are A-Z; D: any of # $ % & * |; E: the text equals
that of a smaller doc_id. Texts count as equal if their SHA-256 are.

Defined cases: a null text is an empty one; it fails A, and E beside a smaller doc_id with an empty text. A null
lang is part '', as an empty one is. A row without doc_id fails no E, causes none and has no labels. Rows that
repeat a doc_id are documents of their own, and one is no copy of the other. A document is good, or toxic, if any
of its label rows says so; rows of labels for absent documents count nowhere. An empty table has no parts. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window

from .shared import bounded_broadcast, slices, split_words, staged

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)


def first_failures():
    """int8 (32, 120): the 0-based step at which a mask is removed under an order, STEPS if never."""
    import numpy as np

    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int8)
    for mask in range(1 << STEPS):
        for k, order in enumerate(ORDERS):
            table[mask, k] = next((s for s, f in enumerate(order) if mask >> FILTERS.index(f) & 1), STEPS)
    return table


def masks(text: pa.Array):
    """The bits of filters A to D for each text of a batch."""
    import numpy as np

    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    flat, offsets = split_words(text)
    words = np.diff(offsets)
    distinct = np.zeros(n, np.int64)
    if len(flat):
        coded = flat.dictionary_encode()
        pairs = np.repeat(np.arange(n), words) * np.int64(len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        distinct = np.bincount(np.unique(pairs) // len(coded.dictionary), minlength=n)
    sizes = np.asarray(pc.binary_length(text), dtype=np.int64)
    raw = np.frombuffer(b"".join(text.cast(pa.large_binary()).to_pylist()), np.uint8)
    ends = np.cumsum(sizes)

    def held(hits):
        upto = np.concatenate(([0], np.cumsum(hits, dtype=np.int64)))
        return upto[ends] - upto[ends - sizes]

    symbols = np.zeros(256, bool)
    symbols[list(b"#$%&*|")] = True
    points = np.asarray(pc.utf8_length(text), dtype=np.int64)
    fails = (words < 100, 100 * distinct < 80 * words, 100 * held((raw >= 65) & (raw <= 90)) > 10 * points, held(symbols[raw]) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def own_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask of A to D, digest of the text), a row for each of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for whole in batches:
            for batch in slices(whole, "text"):
                text = batch.column("text")
                digests = [sha256(t or b"").digest() for t in text.cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("part"), pa.array(masks(text), pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def counted(failures: DataFrame) -> DataFrame:
    """Sums by (part, place), place being order * 5 + step: removed, good_lost, toxic_lost, failing (its filter) and alone (only it), with the part's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table, cells = first_failures().astype(np.int64), len(ORDERS) * (STEPS + 1)
        letters = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
        counts: dict[str, np.ndarray] = {}  # by part: documents by (class of labels, mask)
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            code = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            label = batch.column("good").to_numpy(zero_copy_only=False).astype(np.int64) + 2 * batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            found = np.bincount((code * 4 + label) * 32 + batch.column("mask").to_numpy(zero_copy_only=False), minlength=len(parts.dictionary) * 128).reshape(-1, 4, 32)
            for part, own in zip(parts.dictionary.to_pylist(), found):
                counts[part] = counts[part] + own if part in counts else own
        where = table + np.arange(len(ORDERS)) * (STEPS + 1)  # the cell of a mask in each order

        def by_step(of_mask):
            sums = np.bincount(where.ravel(), weights=np.repeat(of_mask, len(ORDERS)), minlength=cells)
            return sums.astype(np.int64).reshape(len(ORDERS), STEPS + 1)[:, :STEPS].ravel()

        bits = np.arange(32)
        for part, own in counts.items():
            every = own.sum(axis=0)
            failing = np.array([every[bits >> f & 1 == 1].sum() for f in range(STEPS)])
            alone = every[1 << np.arange(STEPS)]
            columns = [by_step(every), by_step(own[1] + own[3]), by_step(own[2] + own[3]), failing[letters].ravel(), alone[letters].ravel()]
            size = len(ORDERS) * STEPS
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * size), pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, every.sum())), *map(pa.array, columns)],
                names=["part", "place", "docs", "removed", "good_lost", "toxic_lost", "failing", "alone"])

    partial = failures.select("part", "mask", "good", "toxic").mapInArrow(run, "part string, place int, docs long, removed long, good_lost long, toxic_lost long, failing long, alone long")
    sums = ("docs", "removed", "good_lost", "toxic_lost", "failing", "alone")
    return partial.groupBy("part", "place").agg(*[F.sum(c).alias(c) for c in sums])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    rows = staged(own_failures(docs), "failures")
    # written, so that the joins' hot texts can be split
    firsts = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1").select(F.col("digest").alias("same"), "first"), "firsts")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(bounded_broadcast(firsts, 32 << 20), F.col("digest") == F.col("same"), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    rows = rows.select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))
    rows = rows.join(marks, F.col("doc_id") == F.col("labelled"), "left")
    sums = counted(rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}))

    step = F.col("place") % STEPS
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.floor(F.col("place") / STEPS).cast("int") + 1)
    sums = sums.select("*", order.alias("filter_order"), (step + 1).cast("int").alias("step"))
    sums = sums.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    upto = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # five rows
    every = Window.partitionBy("part", "letter")  # 120 rows
    return sums.select(
        "part", "filter_order", "step", (F.col("docs") - F.sum("removed").over(upto)).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        F.col("alone").alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(every).alias("shapley"))


SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), firsts as (select text, min(doc_id) as f from d group by 1
), marks as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels where doc_id is not null group by 1
), m as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {
    'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * (length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g'))) > 10 * length(d.text),
    'D': regexp_matches(d.text, '[#$%&*|]'), 'E': coalesce(d.doc_id > f, false)} as fails
  from d join firsts on d.text = firsts.text left join marks on marks.doc_id = d.doc_id
), l as (select unnest(['A', 'B', 'C', 'D', 'E']) as c
), o as (
  select a.c || b.c || c.c || d.c || e.c as filter_order from l a, l b, l c, l d, l e
  where a.c not in (b.c, c.c, d.c, e.c) and b.c not in (c.c, d.c, e.c) and c.c not in (d.c, e.c) and d.c <> e.c
), t as (
  select part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: case x when 'A' then fails.A when 'B' then fails.B when 'C' then fails.C when 'D' then fails.D else fails.E end) as failed, count(*) as n from m group by all
), s as (
  select part, filter_order, step, substr(filter_order, step, 1) as letter, n, good, toxic, failed, coalesce(list_min(list_transform(failed, lambda x: instr(filter_order, x))), 6) as hit
  from t, o, (select unnest(generate_series(1, 5)) as step)
), g as (
  select part, filter_order, cast(step as int) as step, letter, sum(case when hit > step then n else 0 end) as kept, sum(case when hit = step then n else 0 end) as removed,
    sum(case when list_contains(failed, letter) and hit < step then n else 0 end) as redundant, sum(case when failed = [letter] then n else 0 end) as unique_fails,
    sum(case when hit = step and good then n else 0 end) as good_lost, sum(case when hit = step and toxic then n else 0 end) as toxic_lost
  from s group by all
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from g
"""
