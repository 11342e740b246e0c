"""Named queries over analogies, with their DuckDB SQL. Parts are terms, the words of the vocabulary among them those one may ask about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalog import add
from .catalog_more import read
from .catalog_quiz import ring_sql
from .operators import analogy
from .operators.edges import GENERIC

FLOOR, COUNT = 0.75, 3  # the vectors of the tables have no structure: the floor lies where their distances do


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Terms, all edges, the verified ones, synonyms and vectors."""
    p, key = read(spark, sf_dir, "part"), F.col("p_partkey")
    lemma = F.when(F.col("p_size") % 9 == 0, "Thing").otherwise(F.concat_ws(" ", "p_name", key.cast("string")))
    terms = p.select(key.alias("term"), lemma.alias("lemma"), F.col("p_type").alias("pos"), ((F.col("p_size") % 3 != 0) & (F.col("p_size") != 7)).alias("vocab"))
    edge = lambda n, name, b, family: p.select((key * 2 + n).alias("id"), key.alias("a"), b.cast("long").alias("b"), F.lit(name).alias("relation"), F.lit(family).alias("family"), ((key % 3 != 0) & (F.col("p_size") % 2 == 0)).alias("ok"))
    edges = edge(0, "is_a", F.floor(key / 3), "kind").unionByName(edge(1, "made_of", key * 7 % 211, "substance").where("a % 4 = 1")).where("a <> b")
    keys = ["p_brand", "p_type", "p_size"]
    same = p.select(key.alias("term"), *keys).join(p.select(key.alias("other"), *keys), keys).where("term <> other").select("term", "other")
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return terms, edges.drop("ok"), edges.where("ok").drop("ok"), same, vectors


def anchored(spark: SparkSession, sf_dir: str, asked: str = "vocab") -> DataFrame:
    terms, _, verified, _, _ = tables(spark, sf_dir)
    return analogy.anchored(verified, terms, terms.where(asked).select("term"))


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, edges, verified, same, vectors = tables(spark, sf_dir)
    questions = analogy.items(analogy.anchored(verified, terms, terms.where("vocab and term % 20 = 0").select("term")))
    return analogy.options(questions, terms, edges, analogy.fanout(edges, ("is_a",)), same, vectors, "is_a", COUNT, FLOOR)


ANCHORED = f"""with recursive term as (
  select p_partkey as term, case when p_size % 9 = 0 then 'Thing' else p_name || ' ' || cast(p_partkey as varchar) end as lemma, p_type as pos, p_size % 3 <> 0 and p_size <> 7 as vocab from part
), edge as (
  select * from (select p_partkey * 2 as id, p_partkey as a, p_partkey // 3 as b, 'is_a' as relation, 'kind' as family, p_partkey % 3 <> 0 and p_size % 2 = 0 as ok from part
    union all select p_partkey * 2 + 1, p_partkey, p_partkey * 7 % 211, 'made_of', 'substance', p_partkey % 3 <> 0 and p_size % 2 = 0 from part where p_partkey % 4 = 1) where a <> b
), marked as (select e.*, x.vocab as va, y.vocab as vb, case when y.vocab then 'vocab_only' else 'one_hard_term' end as style from edge e join term x on x.term = a join term y on y.term = b where ok
), found as (
  select t.id as edge, t.style, t.relation, n.a, n.b, t.a as c, t.b as d, row_number() over (partition by t.id order by {ring_sql('n.id', 't.id')}, n.id) as nth
  from marked t join marked n on n.va = n.vb and n.family = t.family and n.style = t.style and n.a not in (t.a, t.b) and n.b not in (t.a, t.b) where t.va
), anchored as (select edge, style, relation, a, b, c, d from found where nth = 1)"""
ITEMS = """, question as (
  select c, edge, style, relation, a, b, d from (select *, row_number() over (partition by c order by style <> case when left(md5('1:' || cast(c as varchar)), 1) < '8' then 'vocab_only' else 'one_hard_term' end, md5('1:' || cast(edge as varchar)), edge) as rn from anchored) where rn = 1)"""
COSINE = "round(1 - least(greatest(list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1})), -1.0), 1.0), 6)"
OPTIONS = f""", up(a, b) as (select a, b from edge where relation = 'is_a' union select up.a, e.b from up join edge e on e.a = up.b and e.relation = 'is_a'
), fan as (select distinct a as term, relation, b as other from edge where relation <> 'is_a' union select a, 'is_a', b from up where a <> b
), v as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as vector from embeddings
), q as (select q.*, t.pos from question q join term t on t.term = q.d where c % 20 = 0
), own as (select c, other as answer from q join fan on fan.term = c and fan.relation = q.relation
), fit as (select * from own union select c, other from q join fan on fan.term = d and fan.relation = q.relation where c not in (select c from own)
  union select c, s.p_partkey from q join part p on p.p_partkey = d join part s on s.p_brand = p.p_brand and s.p_type = p.p_type and s.p_size = p.p_size and s.p_partkey <> d union select c, d from q
), fair as (
  select q.*, t.term as w, t.lemma, t.vocab, vw.vector as vector from q join term t on t.pos = q.pos and t.term not in (q.a, q.b, q.c, q.d) left join v vw on vw.id = t.term left join v vd on vd.id = q.d
  where not exists (select 1 from fit where fit.c = q.c and fit.answer = t.term) and coalesce({COSINE.format('vw.vector', 'vd.vector')} >= {FLOOR}, true)
), trap as (select distinct f.c, f.w, f.lemma from fair f join fan on fan.term in (f.a, f.b) and fan.relation = f.relation and fan.other = f.w where lower(f.lemma) not in ({', '.join(map(repr, GENERIC))})
), point as (select q.c, list_transform(list_zip(list_transform(list_zip(vb.vector, va.vector), lambda x: x[1] - x[2]), vc.vector), lambda x: x[1] + x[2]) as p from q join v va on va.id = a join v vb on vb.id = b join v vc on vc.id = c where style = 'vocab_only'
), cand as (
  select c, w, 0 as tier, 'analogy_trap' as strategy, row_number() over (partition by c order by lemma, w) as nth from trap
  union all select f.c, w, 1, 'embedding_offset', row_number() over (partition by f.c order by {COSINE.format('f.vector', 'p')}, w) from fair f join point on point.c = f.c where f.vocab and f.vector is not null
  union all select c, w, 1, 'sibling_fanout', row_number() over (partition by c order by {ring_sql('w', 'c')}, w) from fair where style = 'one_hard_term' and d > 0 and w > 0 and w // 3 = d // 3
  union all select c, w, 2, case when style = 'vocab_only' then 'random' else 'random_ordinary' end, row_number() over (partition by c order by {ring_sql('w', 'c')}, w) from fair where vocab = (style = 'vocab_only')
), best as (select c, w, tier, strategy, nth, row_number() over (partition by c, w order by tier, nth) as r from cand
), ranked as (select *, row_number() over (partition by c order by tier, nth) as place from best where r = 1)
select c, w as term, strategy, cast(place as int) as place, (count(*) over (partition by c)) < {COUNT} as degraded from ranked where place <= {COUNT}"""
add("analogies", anchored, ANCHORED + " select * from anchored")
add("analogy_items", lambda spark, d: analogy.items(anchored(spark, d)), ANCHORED + ITEMS + " select * from question")
add("analogy_distractors", options, ANCHORED + ITEMS + OPTIONS)
