"""Resolution of not-modified revisits: an as-of join by canonical URL.

A revisit record (a 304 answer) takes the content of the latest full response that was captured strictly
earlier under the same canonical URL, if its validators agree with it: entity tags by weak comparison
where the revisit has one, else Last-Modified. The response's headers are kept and updated by those of
the revisit, except the ones a 304 may not change (``FIXED``).

The join is a scan over records sorted by (URL, date): they are dealt by ranges of both, so a URL with any
number of captures spreads over as many tasks as it needs; a window finds the latest response within each
range, and what reaches into a range from the ranges before it comes from a table of two rows a range.
Payloads stay where they are: ``source_id`` names the record whose payload holds.

Defined cases: a record without URL or date resolves to nothing (status ``no_url``, ``no_date``) and
serves no other; responses of one instant are ordered by record_id, and do not serve revisits of that
instant; a revisit without validators is ``no_validator``; repeated rows resolve alike; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import staged

#: Header fields of the stored response that a 304 answer leaves as they are (RFC 9110, RFC 9111).
FIXED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical(url: Column) -> Column:
    """Without scheme, fragment, www prefix, default port, utm parameters and final slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^/?]*(.*)$", 1), r"[?&]utm_[A-Za-z]+=[^&]*", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"^([^?&]*)&", "$1?"), r"/$", "")
    return F.concat(host, rest)


def merged(stored: Column, fresh: Column) -> Column:
    """Headers of a stored response after a 304 answer; names are in lower case."""
    may = F.map_filter(fresh, lambda k, v: ~k.isin(*FIXED))
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(may, k))
    return F.map_concat(kept, may)


def resolve(records: DataFrame) -> DataFrame:
    """record_id, canonical_url, status, source_id and headers of every record.

    ``records`` has record_id (long), kind (``response`` or ``revisit``), url, at (anything ordered) and
    headers (map of strings, names in lower case). status is ``full`` for responses, and for revisits
    ``resolved``, ``no_earlier``, ``no_validator``, ``mismatch``, ``no_url`` or ``no_date``.
    """
    rows = records.select("record_id", "kind", "at", canonical(F.col("url")).alias("curl"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    whole = rows.where("curl is not null and at is not null").withColumn("full", F.col("kind") == "response")
    order = ["curl", "at", "full", "record_id"]  # at one instant revisits come first, so they see earlier responses only
    dealt = staged(whole.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "revisit_ranges")
    own = F.when(F.col("full"), F.struct(F.col("record_id").alias("id"), F.col("headers").alias("h")))
    before = Window.partitionBy("part", "curl").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumn("found", F.last(own, ignorenulls=True).over(before))

    last = F.max_by(own, F.when(F.col("full"), F.struct("at", "record_id")))
    ends = dealt.groupBy("part").agg(F.min("curl").alias("a"), F.max("curl").alias("b")).select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("curl"))
    edge = dealt.join(F.broadcast(ends), ["part", "curl"]).groupBy("part", "curl").agg(last.alias("last"))  # two rows a range
    upto = Window.partitionBy("curl").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select(F.col("part").alias("p"), F.col("curl").alias("c"), F.last("last", ignorenulls=True).over(upto).alias("carry")).where("carry is not null")
    seen = seen.join(F.broadcast(carry), (F.col("part") == F.col("p")) & (F.col("curl") == F.col("c")), "left")
    seen = seen.withColumn("source", F.coalesce("found", "carry"))

    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    mine, theirs = F.col("headers"), F.col("source.h")
    same = F.when(mine["etag"].isNotNull(), tag(mine) == tag(theirs)).otherwise(mine["last-modified"] == theirs["last-modified"])
    status = (
        F.when(F.col("full"), "full").when(F.col("source").isNull(), "no_earlier")
        .when(mine["etag"].isNull() & mine["last-modified"].isNull(), "no_validator")
        .when(F.coalesce(same, F.lit(False)), "resolved").otherwise("mismatch")
    )
    out = seen.withColumn("status", status)
    good = F.col("status") == "resolved"
    out = out.select(
        "record_id", F.col("curl").alias("canonical_url"), "status", F.when(F.col("full"), F.col("record_id")).when(good, F.col("source.id")).alias("source_id"),
        F.when(good, merged(theirs, mine)).otherwise(mine).alias("headers"),
    )
    full = F.col("kind") == "response"
    rest = rows.where("curl is null or at is null").select(
        "record_id", F.col("curl").alias("canonical_url"), F.when(full, "full").when(F.col("curl").isNull(), "no_url").otherwise("no_date").alias("status"),
        F.when(full, F.col("record_id")).alias("source_id"), "headers",
    )
    return out.unionByName(rest)


def records_of(pages: DataFrame) -> DataFrame:
    """Two captures of each page as records: the response, and a later revisit with validators.

    Every fifth response has no entity tag, and every seventh revisit reports another one, so all outcomes
    occur; pages that share a canonical URL supersede each other.
    """
    p, html = F.col("page_id").cast("long"), F.coalesce(F.col("html"), F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    when = p + 7919
    first = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length(html).cast("string"), F.lit("etag"), F.when(p % 5 != 0, tag),
        F.lit("last-modified"), F.floor(p / 1000).cast("string"), F.lit("date"), p.cast("string"),
    )
    again = F.create_map(
        F.lit("etag"), F.when(p % 5 == 0, None).when(p % 7 == 3, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag)),
        F.lit("last-modified"), F.floor(p / 1000).cast("string"), F.lit("date"), when.cast("string"), F.lit("content-length"), F.lit("0"), F.lit("connection"), F.lit("close"),
    )
    there = lambda h: F.map_filter(h, lambda k, v: v.isNotNull())
    pair = F.array(
        F.struct((2 * p).alias("record_id"), F.lit("response").alias("kind"), p.alias("at"), there(first).alias("headers")),
        F.struct((2 * p + 1).alias("record_id"), F.lit("revisit").alias("kind"), when.alias("at"), there(again).alias("headers")),
    )
    return pages.select("url", F.inline(pair))


def revisits(pages: DataFrame) -> DataFrame:
    """record_id, canonical_url, status, source_id, content_length, date and n_headers of both captures of every page."""
    out = resolve(records_of(pages))
    h = F.col("headers")
    return out.select("record_id", "canonical_url", "status", "source_id", h["content-length"].alias("content_length"), h["date"].alias("date"), F.size(h).cast("long").alias("n_headers"))


#: The same in DuckDB.
SQL = r"""
with bare as (
  select page_id as p, coalesce(html, '') as html, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as b from pages
), canon as (
  select p, html,
    regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_extract(b, '(?s)^[^/?]*(.*)$', 1), '[?&]utm_[A-Za-z]+=[^&]*', '', 'g'), '^([^?&]*)&', '\1?'), '/$', '') as c from bare
), full_records as (
  select 2 * p as id, c, p as ts, case when p % 5 <> 0 then '"' || md5(html) || '"' end as tag, cast(p // 1000 as varchar) as lm, cast(length(html) as varchar) as cl from canon
), again as (
  select 2 * p + 1 as id, c, p + 7919 as ts, case when p % 5 = 0 then null when p % 7 = 3 then '"other"' else '"' || md5(html) || '"' end as tag, cast(p // 1000 as varchar) as lm from canon
), matched as (
  select a.id, a.c, a.ts, a.tag, a.lm, f.id as fid, f.tag as ftag, f.lm as flm, f.cl as fcl,
    row_number() over (partition by a.id order by f.ts desc nulls last, f.id desc) as rn
  from again a left join full_records f on f.c = a.c and f.ts < a.ts
), judged as (
  select *, case when fid is null then 'no_earlier' when coalesce(case when tag is not null then tag = ftag else lm = flm end, false) then 'resolved' else 'mismatch' end as status
  from matched where rn = 1
)
select id as record_id, c as canonical_url, 'full' as status, id as source_id, cl as content_length, cast(ts as varchar) as date, cast(4 + (tag is not null)::int as bigint) as n_headers from full_records
union all
select id, c, status, case when status = 'resolved' then fid end, case when status = 'resolved' then fcl else '0' end, cast(ts as varchar),
  cast(case when status = 'resolved' then 4 + (tag is not null or ftag is not null)::int else 4 + (tag is not null)::int end as bigint)
from judged
"""
