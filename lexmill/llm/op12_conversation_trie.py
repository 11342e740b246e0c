"""Conversation prefix trie: every shared beginning of conversations once, with what sharing it saves.

Conversations become paths of turn keys (128 bits of a turn's SHA-256) with their texts' sizes; equal paths collapse
to the smallest conversation with a count. A path belongs to the subtrie of its first turn. Subtries are dealt to
buckets by a hash of that turn, and a task builds its buckets' tries with pointer dictionaries and sums leaves and
savings in one iterative postorder.

A subtrie of more than ``most_turns`` turns is cut instead: its common beginning, found from the smallest and the
largest of its paths, is a chain of nodes, after which the paths are dealt anew by their next turn, again and again
while a part is too large. The chains' sums come from their parts' tops, deepest first, by Spark aggregation, as do
those of the root. So no task holds a hot first turn, nor all conversations.

The hash of the ids that end at a node takes these in order: ids are sorted over all partitions and joined into
chunks, and a task hashes a node's chunks as a stream.

Defined cases: a null role or text is empty; rows without conv_id are no conversation; rows of one conversation and
turn stand in the order of their keys; a row that repeats another is a turn of its own; a conversation of which no
turn is left ends at the root; the remainder of a negative conv_id is that of SQL (-7 % 5 = -2). An empty table has
no nodes. Other columns are not read. One path is one row: 32 characters and a size for each of its turns must fit in
a task, the texts need not.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import bounded_broadcast, staged

KEY = 32  # characters of a turn's key
NOBODY = sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """(conv_id, n_turns, keys, bytes): each conversation c as a path that begins with the first h turns of c - c % every.

    h is crc32(decimal c) % (most + 1); c's own turns follow from its h-th on. keys are those of all turns, joined.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(KEY))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    own = staged(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")), "turns")
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    own = own.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    own = own.withColumn("path", F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), rest)))
    return own.select("conv_id", F.size("path").alias("n_turns"), F.array_join(F.col("path.key"), "").alias("keys"), F.col("path.bytes").alias("bytes"))


def id_digests(ids: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ascending, comma-joined conv_ids of each key of ``ids`` (key, conv_id)."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, rows in groupby(zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()), lambda r: r[0]):
                own = [r[1] for r in rows]
                out.append((key, own[0], ",".join(map(str, own))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["key", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            out = []
            for key, ids_ in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == now:
                    running.update(b"," + ids_.encode())
                    continue
                if running:
                    out.append((now, running.hexdigest()))
                now, running = key, sha256(ids_.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], names=["key", "ends"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], names=["key", "ends"])

    parts = ids.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(chunks, "key string, first long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key string, ends string")


def distinct_paths(built: DataFrame) -> DataFrame:
    """The distinct paths of ``built``: conv_id (the smallest with it), n, ends, n_turns, keys, bytes."""
    built = staged(built.withColumn("key", F.sha2("keys", 256)), "built")
    kinds = staged(built.groupBy("key").agg(F.min("conv_id").alias("first"), F.count("*").alias("n")), "kinds")
    again = kinds.where("n > 1").select(F.col("key").alias("same"))
    ends = id_digests(built.join(again, F.col("key") == F.col("same")).select("key", "conv_id"))
    kinds = kinds.join(ends.withColumnRenamed("key", "same"), F.col("key") == F.col("same"), "left").select("first", "n", "ends")
    rows = built.join(kinds, F.col("conv_id") == F.col("first"))
    return rows.select("conv_id", "n", F.coalesce("ends", F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends"), "n_turns", "keys", "bytes")


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent string"


def grown(pdf):
    """The nodes of a bucket's subtries. ``parent`` names the part above a subtrie's top and is null for the nodes below."""
    import pandas as pd

    tops: dict[str, int] = {}
    kids: list[dict[str, int]] = []
    conv, depth, above, n, size, ends, parent = [], [], [], [], [], [], []

    def node(at: int, under: int, bytes_: int, over) -> int:
        kids.append({})
        for column, value in ((conv, None), (depth, at), (above, under), (n, 0), (size, int(bytes_)), (ends, NOBODY), (parent, over)):
            column.append(value)
        return len(kids) - 1

    for row in pdf.itertuples(index=False):
        at = tops.get(row.group)
        if at is None:
            at = tops[row.group] = node(row.top, -1, row.bytes[row.top - 1], row.parent)
        for d in range(row.top, row.n_turns + 1):
            n[at] += row.n
            conv[at] = row.conv_id if conv[at] is None else min(conv[at], row.conv_id)
            if d < row.n_turns:
                key = row.keys[KEY * d : KEY * d + KEY]
                child = kids[at].get(key)
                if child is None:
                    child = kids[at][key] = node(d + 1, at, row.bytes[d], None)
                at = child
        ends[at] = row.ends
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for i in reversed(range(len(kids))):  # parents were numbered first, so this is a postorder
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * size[i]
        if above[i] >= 0:
            leaves[above[i]] += leaves[i]
            saved[above[i]] += saved[i]
    return pd.DataFrame({
        "conv_id": conv, "depth": depth, "parent_conv_id": pd.array([conv[a] if a >= 0 else None for a in above], dtype="Int64"), "n_convs": n,
        "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "parent": parent})


def _group(depth: str):
    return F.expr(f"sha2(left(keys, {KEY} * ({depth})), 256)")


def trie(built: DataFrame, most_turns: int = 1 << 15, bucket_turns: int = 1 << 14) -> DataFrame:
    """The nodes of the paths ``built`` (conv_id, n_turns, keys, bytes), a row each.

    Subtries of over ``most_turns`` turns are dealt anew by their next turn; a bucket holds about ``bucket_turns``.
    """
    paths = staged(distinct_paths(built), "paths")
    now = paths.where("n_turns > 0").select("*", F.lit(1).alias("top"), F.lit("").alias("parent"), _group("1").alias("group"))
    whole, cuts = [], []
    while True:
        large = now.groupBy("group").agg(F.count("*").alias("m"), F.sum(F.col("n_turns") - F.col("top") + 1).alias("turns"))
        large = staged(large.where((F.col("m") > 1) & (F.col("turns") > most_turns)).select(F.col("group").alias("big")), f"large{len(cuts)}")
        if not large.limit(1).count():
            whole.append(now)
            break
        large = bounded_broadcast(large)
        whole.append(now.join(large, F.col("group") == F.col("big"), "left_anti"))
        held = now.join(large, F.col("group") == F.col("big")).drop("big")
        spans = held.groupBy("group").agg(F.min("keys").alias("lo"), F.max("keys").alias("hi"), F.min_by("bytes", "keys").alias("bytes"), F.min("top").alias("top"), F.min("parent").alias("parent"))
        # what the smallest and the largest path share, all paths between them share
        upto = F.floor(F.least(F.length("lo"), F.length("hi")) / KEY).cast("int")
        same = F.transform(F.sequence(F.lit(1), upto), lambda i: F.substring("lo", KEY * (i - 1) + 1, F.lit(KEY)) == F.substring("hi", KEY * (i - 1) + 1, F.lit(KEY)))
        differ = F.array_position(same, False)
        spans = spans.withColumn("last", F.when(differ == 0, upto).otherwise(differ - 1).cast("int"))
        spans = staged(spans.select("group", "parent", "top", "last", F.expr("slice(bytes, top, last - top + 1)").alias("bytes")), f"spans{len(cuts)}")
        inner = held.join(bounded_broadcast(spans.select(F.col("group").alias("of"), "last")), F.col("group") == F.col("of"))
        inner = staged(inner.drop("of"), f"inner{len(cuts)}")
        cuts.append((spans, inner.where("n_turns = last").select(F.col("group").alias("parent"), "conv_id", "n", "ends")))
        deeper = inner.where("n_turns > last").withColumns({"top": F.col("last") + 1, "parent": F.col("group"), "group": _group("last + 1")})
        now = deeper.drop("last")

    rows = whole[0]
    for more in whole[1:]:
        rows = rows.unionByName(more)
    buckets = max(1, -(-(rows.agg(F.sum("n_turns")).first()[0] or 0) // bucket_turns))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    nodes = staged(rows.groupBy("bucket").applyInPandas(grown, NODE), "nodes")

    tops = nodes.where("parent is not null")
    solved = []
    spark = paths.sparkSession
    root = spark.createDataFrame([("", None, 0, 0, [0])], "group string, parent string, top int, last int, bytes array<long>")
    for k, (spans, ended) in reversed(list(enumerate([(root, paths.where("n_turns = 0").select(F.lit("").alias("parent"), "conv_id", "n", "ends")), *cuts]))):
        below = tops.select("parent", "conv_id", F.col("n_convs").alias("n"), "n_leaves", F.col("saved_tokens").alias("saved"), F.lit(1).alias("child"), F.lit(None).cast("string").alias("ends"))
        ended = ended.select("parent", "conv_id", "n", F.lit(0).alias("n_leaves"), F.lit(0).alias("saved"), F.lit(0).alias("child"), "ends")
        sums = below.unionByName(ended).join(bounded_broadcast(spans.select(F.col("group").alias("of"))), F.col("parent") == F.col("of")).groupBy("of").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved").alias("saved"), F.sum("child").alias("kids"), F.max("ends").alias("ends"))
        own = spans.join(sums, F.col("group") == F.col("of"))
        # bytes from a node of the chain to its end: all of them less those before it
        own = own.withColumn("all", F.aggregate("bytes", F.lit(0).cast("long"), lambda a, x: a + x)).select("*", F.posexplode("bytes").alias("pos", "b"))
        before = F.expr("sum(b) over (partition by group order by pos rows between unbounded preceding and 1 preceding)")
        own = own.withColumn("rest", F.col("all") - F.coalesce(before, F.lit(0)))
        end = F.col("pos") == F.col("last") - F.col("top")
        own = staged(own.select(
            "group", "conv_id", (F.col("top") + F.col("pos")).cast("long").alias("depth"), F.when(F.col("pos") > 0, F.col("conv_id")).alias("parent_conv_id"), "n_convs",
            F.when(end, F.col("kids")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved") + (F.col("n_convs") - 1) * F.col("rest")).alias("saved_tokens"),
            F.coalesce(F.when(end, F.col("ends")), F.lit(NOBODY)).alias("ends_sha256"), F.when(F.col("pos") == 0, F.col("parent")).alias("parent")), f"solved{k}")
        solved.append(own)
        tops = tops.unionByName(own.where("parent is not null").drop("group"))

    chains = solved[0]
    for more in solved[1:]:
        chains = chains.unionByName(more)
    owners = staged(chains.groupBy(F.col("group").alias("of")).agg(F.min("conv_id").alias("owner")), "owners")
    out = nodes.unionByName(chains.drop("group")).join(bounded_broadcast(owners), F.col("parent") == F.col("of"), "left")
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", "owner").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = r"""
with t as (
  select conv_id, turn, strlen(coalesce(text, '')) as b, substr(sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) as k from conversations where conv_id is not null
), o as (select *, row_number() over (partition by conv_id order by turn nulls first, k) as pos from t
), ids as (
  select c, c - c % 5 as base, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda crc, ch: list_reduce(list_prepend(xor(crc, ch), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::bigint))), 4294967295::bigint) % 9 as h
  from (select distinct conv_id as c from t)
), p as (
  select c, 0 as own, pos, k, b from ids join o on o.conv_id = base and pos <= h union all select c, 1, pos, k, b from ids join o on o.conv_id = c and pos > h
), q as (select *, row_number() over (partition by c order by own, pos) as depth from p
), m as (
  select c, depth, string_agg(k, '') over (partition by c order by depth rows unbounded preceding) as pk, b from q union all select c, 0, '', 0 from ids
), n as (select depth, pk, min(c) as conv_id, count(*) as n_convs, any_value(b) as b from m group by 1, 2
), f as (select c, max(depth) as depth from m group by 1
), e as (select pk, sha256(string_agg(c::varchar, ',' order by c)) as ends from m join f using (c, depth) group by 1
), kids as (select left(pk, 32 * (depth - 1)::int) as pk, count(*) as n from n where depth > 0 group by 1
), x as (select n.*, coalesce(kids.n, 0) as n_children, coalesce(ends, sha256('')) as ends_sha256 from n left join kids on kids.pk = n.pk left join e on e.pk = n.pk
), s as (
  select m.pk, sum(case when x.n_children = 0 then 1 else 0 end) as n_leaves, sum((x.n_convs - 1) * x.b) as saved from x join m on m.c = x.conv_id and m.depth <= x.depth group by 1
)
select x.conv_id, x.depth::bigint as depth, up.conv_id as parent_conv_id, x.n_convs, x.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, x.ends_sha256
from x join s on s.pk = x.pk left join n up on x.depth > 0 and up.pk = left(x.pk, 32 * (x.depth - 1)::int)
"""
