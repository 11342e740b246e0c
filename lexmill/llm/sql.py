"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from .op5_quality_rules import SLACK

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def jaccard_classes(num: int, den: int, kept: bool) -> str:
    """One row a document with its class under 4-word shingles and the threshold num / den."""
    return rf"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct doc_id, sh from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' ')) end) as sh from w)
), n as (select d.doc_id, count(s.sh) as n from documents d left join s on s.doc_id = d.doc_id group by 1
), shared as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2
), link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where {den} * i >= {num} * (x.n + y.n - i)
), arc as (select a, b from link union select b, a from link
), reach(a, b) as (select a, b from arc union select r.a, l.b from reach r join arc l on l.a = r.b)
select n.doc_id, n.n as n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) as component_id{", n.doc_id <= coalesce(min(r.b), n.doc_id) as kept" if kept else ""} from n left join reach r on r.a = n.doc_id group by 1, 2
"""


def quality_rules(min_docs: int = 100, reach: int = 3) -> str:
    high = lambda k: f"x.{k}_v <= (select max(q3 + {reach} * (q3 - q1) + {SLACK[k][0]}) from best b where b.stat = '{k}' and b.lang is not distinct from x.lang and b.source is not distinct from x.source)"
    low = lambda k: f"x.{k}_v >= (select max(q1 - {reach} * (q3 - q1) - {SLACK[k][0]}) from best b where b.stat = '{k}' and b.lang is not distinct from x.lang and b.source is not distinct from x.source)"
    inside = " and ".join(f"coalesce({f(k)}, true)" for k, (_, both) in SLACK.items() for f in ([high, low] if both else [high]))
    quart = "min(bucket) filter (where upto >= ceil({} * all_)) as {}"
    level = lambda i, keys: (
        f"select {i} as level, {keys[0] or 'null'} as lang, {keys[1] or 'null'} as source, stat, {quart.format(0.25, 'q1')}, {quart.format(0.75, 'q3')}, max(all_) as n from ("
        f"select *, sum(n) over (partition by {', '.join([k for k in keys if k] + ['stat'])} order by bucket) as upto, sum(n) over (partition by {', '.join([k for k in keys if k] + ['stat'])}) as all_ from ("
        f"select {', '.join([k for k in keys if k] + ['stat', 'bucket'])}, sum(n) as n from sketch group by all)) group by {', '.join([k for k in keys if k] + ['stat'])}"
    )
    return rf"""
with w as (
  select doc_id, lang, source, coalesce(text, '') as text, {WORDS} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from documents
), win as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as g from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from w)
), again as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from win) where n > 1
), rep as (select doc_id, count(*) as n from (select distinct doc_id, i + k as p from again, (values (0), (1), (2)) t(k)) group by 1
), x as (
  select w.doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    len(lines) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from w left join rep on rep.doc_id = w.doc_id
), y as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 1000 * word_chars // greatest(n_words, 1) as word_length_v, 1000 * n_symbols // greatest(n_words, 1) as symbols_v,
    1000 * n_dup_lines // greatest(n_lines, 1) as dup_lines_v, 1000 * n_repeat_words // greatest(n_words, 1) as repeats_v from x
), v as (
  select lang, source, 'word_length' as stat, word_length_v as v from y where not base_failed union all select lang, source, 'symbols', symbols_v from y where not base_failed
  union all select lang, source, 'dup_lines', dup_lines_v from y where not base_failed union all select lang, source, 'repeats', repeats_v from y where not base_failed
), sketch as (select lang, source, stat, v - v % (cast(1 as bigint) << greatest(cast(length(bin(v)) as int) - 7, 0)) as bucket, count(*) as n from v group by all
), levels as ({level(0, ('lang', 'source'))} union all {level(1, ('lang', None))} union all {level(2, (None, None))}
), groups as (select distinct lang, source from sketch
), fit as (
  select g.lang, g.source, l.stat, l.q1, l.q3, row_number() over (partition by g.lang, g.source, l.stat order by l.level) as r from groups g join levels l
    on (l.level = 2 or l.lang is not distinct from g.lang) and (l.level > 0 or l.source is not distinct from g.source) where l.level = 2 or l.n >= {min_docs}
), best as (select * from fit where r = 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {inside} as kept from y x
"""


ORACLES = {"op4_jaccard_join": jaccard_classes(85, 100, False), "op13_minhash_dedup": jaccard_classes(80, 100, True), "op5_quality_rules": quality_rules()}
