"""Named queries over similarity, practice records, vectors and texts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .catalog import add, star
from .functions import columns as fn
from .operators import ingest, progress, relate, vectors
from .plans.star import SQL, load
from .sources.readers import html_sections

STOP = ("the", "of", "and", "to", "in", "a", "is", "that", "de", "la", "le", "der", "die", "und")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(name: str, table: str, query, oracle: str | None = None) -> None:
    add(name, lambda spark, sf_dir: query(read(spark, sf_dir, table)), oracle)


# --- similarity: books through their words; authors likewise
MOST, SHARED, TOP = 0.5, 3, 20
PAIRS = {"doc": ("book_id", "active_link"), "author": ("author", "author_link")}


def similar_sql(entity: str, source: str, most: float, shared: int) -> str:
    return f""", pr as (select {entity} as e, word_id as m from {source}
), n as (select count(distinct e) as n from pr), idf as (select m, count(distinct e) as df, round(ln(any_value(n.n) / count(distinct e)), 6) as idf from pr, n group by m having count(distinct e) <= {most} * any_value(n.n)
), held as (select distinct e, m, cast(cast(idf as decimal(18,6)) * cast(idf as decimal(18,6)) as decimal(20,12)) as w2 from pr join idf using (m)
), norms as (select e, sqrt(cast(sum(w2) as double)) as norm from held group by e
), sh as (select x.e as a, y.e as b, cast(sum(x.w2) as double) as s, count(*) as shared from held x join held y on x.m = y.m and x.e <> y.e group by 1, 2 having count(*) >= {shared}
), sc as (select a, b, round(least(s / (x.norm * y.norm), 1.0), 6) as score, shared from sh join norms x on x.e = a join norms y on y.e = b
), top as (select *, row_number() over (partition by a order by score desc, b) as rn from sc
), edge as (select a, b, score, shared from top where rn <= {TOP})"""


DOC, AUT = similar_sql("book_id", "active_link", MOST, SHARED), similar_sql("author", "author_link", MOST, SHARED)
star("doc_idf", lambda c: relate.idf(c.active_links, "book_id", "word_id", MOST), DOC + " select m as word_id, df, idf from idf")
edges = lambda c: relate.similar(c.active_links, "book_id", "word_id", MOST, SHARED, TOP)
star("doc_similarity_topk", edges, DOC + " select a, b, score, shared from edge")
star("author_similarity_topk", lambda c: relate.similar(c.author_links, "author", "word_id", MOST, SHARED, TOP), AUT + " select a, b, score, shared from edge")
star("shared_words", lambda c: relate.shared_words(c.author_links, "author", "word_id", "Customer#000000042", "Customer#000000043", 0.9), similar_sql("author", "author_link", 0.9, SHARED) + " select m as word_id, idf from idf where m in (select m from pr where e = 'Customer#000000042') and m in (select m from pr where e = 'Customer#000000043')")
star("shelf_similarity_topk", lambda c: relate.similar(c.shelves, "shelf", "word_id", MOST, SHARED, TOP), similar_sql("shelf", "(select distinct l_suppkey as shelf, l_partkey as word_id from lineitem)", MOST, SHARED) + " select a, b, score, shared from edge")
CENTER = "(select min(a) from edge)"


def ego(c):
    e = edges(c)
    first = e.agg(F.min("a").alias("a")).first().a
    return relate.ego_graph(e, -1 if first is None else first, 10, 3, 25).select("node", "ring", "score")


star("related_ego_graph", ego, DOC + f""", f as (select b as node, score from (select *, row_number() over (order by score desc, b) as r from edge where a = {CENTER}) where r <= 10
), o as (select b, score from (select *, row_number() over (partition by a order by score desc, b) as r from edge where a in (select node from f) and b <> {CENTER} and b not in (select node from f)) where r <= 3
), ring as (select node, 1 as ring, score from f union all select b, 2, max(score) from o group by b
) select node, ring, score from (select *, row_number() over (order by ring, score desc, node) as r from ring) where r < 25""")
star("relatedness_global", lambda c: relate.relatedness(edges(c), c.books.select(F.col("id").alias("node")), 3), DOC + """, inside as (select a, b, score, row_number() over (partition by a order by score desc, b) as r from edge
) select least(a, b) as source, greatest(a, b) as target, max(score) as score from inside where r <= 3 group by 1, 2""")
star("ring2_lateral", lambda c: relate.best(edges(c), "a", 2).select("a", "b", "score"), DOC + " select a, b, score from (select *, row_number() over (partition by a order by score desc, b) as r from edge) where r <= 2")


def cluster_map(c):
    """The 200 authors with most books, of those with words, ties to the name, in at most 12 clusters."""
    books = c.books.join(c.author_links.select("author").distinct(), "author", "left_semi").groupBy("author").count()
    top = books.orderBy(F.desc("count"), "author").limit(200).select(F.col("author").alias("node"))
    return relate.cluster(c.author_links, "author", "word_id", top, 12).select("node", "cluster", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


star("cluster_map", cluster_map)

# --- practice records from events
ANSWERS = """with ans as (
  select event_id as question, user_id, cast(user_id as varchar) || ' ' || cast(cast(ts as date) as varchar) as session, cast(json_extract(props, '$.k') as bigint) as word_id, event_type as kind,
    event_type in ('purchase', 'signup') as correct, ts as answered_at, case event_type when 'click' then 0.5 when 'view' then 0.25 else 0.0 end as floor from events)"""


def answers(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("question"), "user_id", F.concat_ws(" ", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session"), F.get_json_object("props", "$.k").cast("long").alias("word_id"),
        F.col("event_type").alias("kind"), F.col("event_type").isin("purchase", "signup").alias("correct"), F.col("ts").alias("answered_at"), F.when(F.col("event_type") == "click", 0.5).when(F.col("event_type") == "view", 0.25).otherwise(0.0).alias("floor"),
    )


def practice(name: str, query, oracle: str | None = None) -> None:
    on(name, "events", lambda e: query(answers(e)), f"{ANSWERS} {oracle}" if oracle else None)


HIT = "cast(count(*) filter (where correct) as bigint) as correct, count(*) as total, round(100 * count(*) filter (where correct) / count(*), 1) as accuracy_pct"
FIRST = "select * from (select *, row_number() over (partition by user_id, word_id order by answered_at, question) as rn from ans) where rn = 1"
practice("session_scores", progress.session_scores, "select session, count(*) as questions, round(100 * sum(c) / count(*), 1) as score_pct from (select session, question, avg(correct::int) as c from ans group by 1, 2) group by 1")
practice("accuracy_by_type", lambda a: progress.accuracy(a, "kind"), f"select kind, {HIT} from ans group by 1")
practice("accuracy_by_user", lambda a: progress.accuracy(a, "user_id"), f"select user_id, {HIT} from ans group by 1")
practice("struggling_words", progress.struggling, "select user_id, word_id, count(*) as exposures, round(avg(1 - correct::int), 6) as miss_rate from ans group by 1, 2 having count(*) >= 2 and avg(1 - correct::int) > 0")
practice("first_exposure", lambda a: progress.first_exposure(a).select("user_id", "word_id", "question", "correct"), f"select user_id, word_id, question, correct from ({FIRST})")
ISLANDS = "select user_id, min(d) as first_day, max(d) as last_day, count(*) as days from (select user_id, d, d - cast(row_number() over (partition by user_id order by d) as int) as i from (select distinct user_id, cast(answered_at as date) as d from ans)) group by user_id, i"
practice("practice_streaks", progress.practice_streaks, ISLANDS)
practice("practice_streak_now", lambda a: progress.current_streak(a, F.to_date(F.lit("2024-01-15"))), f"select user_id, coalesce(max(case when last_day >= date '2024-01-14' then days end), 0) as days from ({ISLANDS}) group by 1")
practice("review_schedule", progress.review_schedule, """, r as (select *, row_number() over (partition by user_id, word_id order by answered_at, question) as nth from ans
), s as (select user_id, word_id, cast(max(nth) - coalesce(max(case when not correct then nth end), 0) as int) as streak, count(*) filter (where correct) as correct, count(*) filter (where not correct) as wrong, max(answered_at) as last_at from r group by 1, 2
) select user_id, word_id, streak, correct, wrong, cast(floor(epoch(last_at)) as bigint) + cast(case when streak > 0 then least(pow(2.0, streak), 30.0) * 24 else 8.0 end * 3600 as bigint) as next_at from s""")


def both(name: str, query, oracle: str) -> None:
    add(name, lambda spark, sf_dir: query(answers(read(spark, sf_dir, "events")), load(spark, sf_dir)), f"{SQL}, {ANSWERS[5:]} {oracle}")


both("personal_difficulty", lambda a, c: progress.personal_difficulty(progress.first_exposure(a), c.words), f""", one as ({FIRST}), b as (select o.*, (w.difficulty - 50) / 16 as b from one o join word w on w.id = o.word_id where w.difficulty is not null)
select user_id, word_id, round(least(greatest(50 + 16 * (b - (correct::int - (floor + (1 - floor) / (1 + exp(b))))), 0.0), 100.0), 6) as personal_difficulty from b""")
both("accuracy_by_field", lambda a, c: progress.accuracy_through(a, c.codes.select("word_id", F.left("code", F.lit(1)).alias("letter")).distinct(), "letter"), f"select letter, {HIT} from ans a join (select distinct word_id, left(code, 1) as letter from code) c on c.word_id = a.word_id group by 1")
both("accuracy_by_book", lambda a, c: progress.accuracy_through(a, c.links, "book_id"), f"select book_id, {HIT} from ans a join link l on l.word_id = a.word_id group by 1")
on("daily_events", "events", lambda e: e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("total")), "select cast(ts as date) as day, event_type, count(*) as n, round(cast(sum(cast(value as decimal(18,4))) as double), 4) as total from events group by 1, 2")

# --- vectors: exact searches from one seed
V = "with v as (select vec_id as id, label, list_transform(embedding, lambda x: cast(x as double)) as vector from embeddings)"
ROUND = "round(1 - least(greatest(list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1})), -1.0), 1.0), 6)"
FROM_SEED = f", q as (select vector as s from v where id = 5), d as (select id, label, {ROUND.format('vector', 's')} as distance from v, q)"


def vec(name: str, query, oracle: str) -> None:
    on(name, "embeddings", lambda e: query(e.select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))), f"{V}{oracle}")


vec("knn", lambda v: vectors.nearest(v, 5), f"{FROM_SEED} select * from d where id <> 5 order by distance, id limit 10")
vec("knn_same_label", lambda v: vectors.nearest(v, 5, 5, label=3), f"{FROM_SEED} select * from d where id <> 5 and label = 3 order by distance, id limit 5")
vec("semantic_band", lambda v: vectors.band(v, 5, 0.75, 0.9), f"{FROM_SEED} select * from d where id <> 5 and distance between 0.75 and 0.9")
vec("vector_offset", lambda v: vectors.offset(v, 1, 2, 3), f", q as (select list_transform(list_zip(list_transform(list_zip(b.vector, a.vector), lambda x: x[1] - x[2]), c.vector), lambda x: x[1] + x[2]) as s from v a, v b, v c where a.id = 1 and b.id = 2 and c.id = 3), d as (select id, label, {ROUND.format('vector', 's')} as distance from v, q) select * from d where id not in (1, 2, 3) order by distance, id limit 10")
vec("knn_two_ring", lambda v: vectors.two_rings(v, 5), f"""{FROM_SEED}, f as (select id, distance from d where id <> 5 order by distance, id limit 8
), o as (select a.id as source, b.id, {ROUND.format('b.vector', 'a.vector')} as distance from v a join f on f.id = a.id join v b on b.id <> a.id and b.id <> 5
), r as (select *, row_number() over (partition by source order by distance, id) as n from o)
select cast(5 as bigint) as source, id, cast(1 as int) as ring, distance from f union all select source, id, 2, distance from r where n <= 3""")

# the same for every row whose id is divisible by 20
FROM_ALL = f", q as (select id as query_id, label as own, vector as s from v where id % 20 = 0), d as (select query_id, own, id, label, {ROUND.format('vector', 's')} as distance from v join q on id <> query_id)"
RANKED = "select query_id, id, label, distance from (select *, row_number() over (partition by query_id order by distance, id) as n from d{0}) where n <= {1}"
asked = lambda v: v.where("id % 20 = 0")
vec("knn_all", lambda v: vectors.compared(v, asked(v), 10), f"{FROM_ALL} {RANKED.format('', 10)}")
vec("knn_same_label_all", lambda v: vectors.compared(v, asked(v), 5, same_label=True), f"{FROM_ALL} {RANKED.format(' where label = own', 5)}")
vec("semantic_band_all", lambda v: vectors.compared(v, asked(v), low=0.75, high=0.9), f"{FROM_ALL} select query_id, id, label, distance from d where distance between 0.75 and 0.9")
vec("knn_two_ring_all", lambda v: vectors.all_two_rings(v, asked(v)), f"""{FROM_ALL}, f as (select query_id, id, distance from ({RANKED.format('', 8)})
), o as (select f.query_id, a.id as source, b.id, {ROUND.format('b.vector', 'a.vector')} as distance from f join v a on f.id = a.id join v b on b.id <> a.id and b.id <> f.query_id
), r as (select *, row_number() over (partition by query_id, source order by distance, id) as n from o)
select query_id, query_id as source, id, cast(1 as int) as ring, distance from f union all select query_id, source, id, 2, distance from r where n <= 3""")

# --- texts
on("word_stats", "documents", lambda d: ingest.word_stats(d, STOP), f"select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) as bigint) as word_count, cast(len(list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda x: lower(x))), lambda x: x not in ({', '.join(map(repr, STOP))}))) as bigint) as distinct_words from documents")
TOKENS = """with occ as (select doc_id, s, lower(s) as lemma from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) as s from documents) where length(s) >= {least}
), cand as (select doc_id, lemma, count(*) as n_tokens, least(count(*), 12) as count_capped,
  round(coalesce(count(*) filter (where not (length(s) > 1 and s = upper(s)) and left(s, 1) <> lower(left(s, 1))) / nullif(count(*) filter (where not (length(s) > 1 and s = upper(s))), 0), 0.0), 6) as capitalised from occ group by 1, 2
), zn as (select lemma, cast(sum(n_tokens) as bigint) as n from cand group by 1), z as (select lemma, n, round(log10(n / (select sum(n) from zn) * 1e9), 4) as zipf from zn)"""
T3 = TOKENS.format(least=3)
JUDGED = ", v as (select doc_id, c.lemma, n_tokens, zipf, case when zipf >= 5.5 then 'too_frequent' when capitalised >= 0.85 then 'proper_noun' end as reason from cand c join z on z.lemma = c.lemma)"
on("token_candidates", "documents", lambda d: ingest.candidates(d).drop("first_at"), f"{T3} select * from cand")
on("corpus_zipf", "documents", lambda d: ingest.zipf(ingest.candidates(d)), f"{T3} select * from z")


def judged(d: DataFrame) -> DataFrame:
    found = ingest.candidates(d)
    return ingest.verdicts(found, ingest.zipf(found), floor=5.5)


on("verdicts", "documents", lambda d: judged(d).select("doc_id", "lemma", "verdict", "reason"), f"{T3}{JUDGED} select doc_id, lemma, case when reason is null then 'keep' else 'drop' end as verdict, reason from v")
on("rejected_lemma_index", "documents", lambda d: ingest.rejected_index(judged(d).where("verdict = 'drop'")), f"{T3}{JUDGED} select lemma, count(distinct doc_id) as book_count, cast(sum(n_tokens) as bigint) as total_count, min(zipf) as zipf, array_to_string(list_sort(list(distinct reason)), '|') as reasons from v where reason is not null group by 1")


def known(d: DataFrame) -> DataFrame:
    j = judged(d)
    return ingest.known_verdicts(j.where("verdict = 'drop'"), j.where("verdict = 'keep'").select("lemma").distinct())


on("known_verdicts", "documents", known, f"{T3}{JUDGED} select lemma, case when bool_or(reason is null) then 'keep' else min(reason) end as verdict from v group by 1")
on("english_fraction", "documents", lambda d: ingest.english_fraction(d, ingest.zipf(ingest.candidates(d, 2)), 5.0), f"{TOKENS.format(least=2)} select doc_id, round(sum(case when zipf >= 5.0 then n_tokens else 0 end) / sum(n_tokens), 6) as fraction from cand c join z on z.lemma = c.lemma group by 1")
on("clean_text", "documents", lambda d: d.select("doc_id", ingest.clean_text(F.col("text")).alias("text")))
on("html_sections", "pages", lambda p: html_sections(p))


def common(d: DataFrame) -> DataFrame:
    return ingest.zipf(ingest.candidates(d)).where("n >= 5")


on("misspelling_neighbours", "documents", lambda d: ingest.neighbours(common(d), gap=1.5), f"{T3}, w as (select lemma, zipf from z where n >= 5 and length(lemma) >= 4), p as (select x.lemma, y.lemma as neighbour, round(y.zipf - x.zipf, 4) as gap, row_number() over (partition by x.lemma order by y.zipf desc, y.lemma) as r from w x join w y on y.zipf >= x.zipf + 1.5 and abs(length(x.lemma) - length(y.lemma)) <= 1 and levenshtein(x.lemma, y.lemma) <= 1) select lemma, neighbour, gap from p where r = 1")
on("misspelling_neighbours_osa", "documents", lambda d: ingest.neighbours(common(d), transpositions=True, gap=1.5))


# mentions of every kept lemma of the corpus in other texts than the first that has it
on("mention_links", "documents", lambda d: ingest.first_mentions(d, floor=5.5), f"""{T3}{JUDGED}, w as (select lemma, min(doc_id) as target from v where reason is null group by 1
), o as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) as s, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), 1) as i from documents
), f as (select doc_id as source, lower(s) as lemma, arg_min(s, i) as surface from o where length(s) >= 3 group by 1, 2)
select source, target, surface from f join w using (lemma) where source <> target""")

# --- scores and scalar columns
ERA = "case when {p} <= 33 then 'early' when {p} <= 66 then 'mid' else 'late' end || ' ' || cast({c} as varchar) || case when {c} % 100 between 11 and 13 then 'th' when {c} % 10 = 1 then 'st' when {c} % 10 = 2 then 'nd' when {c} % 10 = 3 then 'rd' else 'th' end || ' century'".format(p="((publication_year - 1) % 100 + 1)", c="((publication_year - 1) // 100 + 1)")
star("publication_era", lambda c: c.books.select("id", fn.era(F.col("publication_year")).alias("era")), f"select id, {ERA} as era from book")


def scored(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    tier = F.element_at(F.array(*map(F.lit, ("current", "dated", "archaic", "obsolete"))), (F.col("p_size") % 4 + 1).cast("int"))
    peak = F.when(k % 5 != 0, (k % 97) / F.lit(1e7))
    return part.select(k.alias("id"), fn.difficulty((k % 80) / F.lit(16.0), peak, tier, F.lit(0.9), k % 2 == 0, k % 3 == 0).cast("double").alias("difficulty"))


on("difficulty_score", "part", scored, """with x as (select p_partkey as k, list_value(0.0, 0.06, 0.18, 0.25)[p_size % 4 + 1] as base, case when p_partkey % 5 <> 0 then (p_partkey % 97) / 1e7 end as peak from part
), r as (select k, 0.65 * least(greatest((4 - (k % 80) / 16.0) / 4, 0.0), 1.0) + 0.35 * case when coalesce(peak, 0) <= 0 then 1.0 else least(greatest((-log10(peak) - 5) / 6, 0.0), 1.0) end + base * 0.9 + case when k % 2 = 0 then 0.06 else 0.0 end - case when k % 3 = 0 then 0.10 else 0.0 end as s from x)
select k as id, cast(round_even(100 * least(greatest(cast(s as double), 0.0), 1.0), 0) as double) as difficulty from r""")
on("archaic_tier", "part", lambda p: p.select(F.col("p_partkey").alias("id"), fn.archaic_tier(F.when(F.col("p_size") % 3 == 0, "Archaic form"), F.when(F.col("p_size") % 4 == 0, "archaic").when(F.col("p_size") % 5 == 0, "obsolete"), F.lit(1e-5), F.lit(0.2)).alias("t")).select("id", "t.tier", "t.confidence"), """
select p_partkey as id, case when p_size % 4 <> 0 and p_size % 5 = 0 then 'obsolete' when p_size % 3 = 0 or p_size % 4 = 0 then 'archaic' else 'current' end as tier,
  (case when p_size % 4 <> 0 and p_size % 5 = 0 then 0.9 when p_size % 3 = 0 and p_size % 4 = 0 then 0.95 when p_size % 3 = 0 then 0.9 when p_size % 4 = 0 then 0.85 else 0.9 end)::double as confidence from part""")
GRAM = "(select list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))))))"
on("words_trigram", "part", lambda p: p.select("p_partkey", F.round(fn.trigram_similarity(F.col("p_name"), F.lit("small ring")), 6).alias("similarity")).where("similarity > 0.1"), f"with g as (select p_partkey, {GRAM.format('p_name')} as x, {GRAM.format(chr(39) + 'small ring' + chr(39))} as y from part), s as (select p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as similarity from g) select * from s where similarity > 0.1")


def ngram(e: DataFrame) -> DataFrame:
    """Peak, first day of the peak, mean of the last 20 days and their ratio, of each kind's daily counts."""
    daily = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("day")))
    out = daily.withColumn("nth", nth).groupBy("event_type").agg(F.max("n").alias("peak"), F.max_by("day", F.struct("n", -F.datediff("day", F.lit("1970-01-01").cast("date")))).alias("peak_day"), F.round(F.avg(F.when(F.col("nth") <= 20, F.col("n"))), 6).alias("recent"))
    return out.withColumn("ratio", F.when(F.col("peak") > 0, F.round(F.col("recent") / F.col("peak"), 6)))


on("ngram_features", "events", ngram, """with d as (select event_type, cast(ts as date) as day, count(*) as n from events group by 1, 2
), r as (select *, row_number() over (partition by event_type order by day desc) as nth, row_number() over (partition by event_type order by n desc, day) as top from d
) select event_type, max(n) as peak, max(case when top = 1 then day end) as peak_day, round(avg(case when nth <= 20 then n end), 6) as recent, round(round(avg(case when nth <= 20 then n end), 6) / max(n), 6) as ratio from r group by 1""")

# --- merging, upserts, trees
on("part_gap_detection", "orders", lambda o: ingest.part_gaps(o.select(F.concat(F.lit("base "), (F.col("o_custkey")).cast("string")).alias("title_base"), (F.col("o_orderkey") % 9 + 1).alias("first"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 9 + 2).alias("last"))), """
with p as (select 'base ' || cast(o_custkey as varchar) as title_base, unnest(generate_series(o_orderkey % 9 + 1, case when o_orderkey % 4 = 0 then o_orderkey % 9 + 2 else o_orderkey % 9 + 1 end)) as n from orders
), f as (select title_base, n, count(*) as times from p group by 1, 2
), g as (select title_base, cast(sum(times) as bigint) as parts, min(n) as low, max(n) as high, max(times) as most, max(n) - least(min(n), 1) + 1 - count(*) as missing from f group by 1
) select title_base, parts, low, high, missing, case when parts = 1 then 'lone_match' when most > 1 then 'duplicate_number' when missing > 0 then 'gap' end as skip_reason from g""")
star("merge_dedupe", lambda c: ingest.repoint(c.links, 0, tuple(range(1, 200))), "select distinct word_id, case when book_id between 1 and 199 then 0 else book_id end as book_id from link")
on("distinct_on_best", "lineitem", lambda t: t.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"))).where("n = 1").select("l_orderkey", "l_linenumber", "l_partkey"), "select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey) as n from lineitem) where n = 1")


def upserted(p: DataFrame) -> DataFrame:
    base = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")).alias("name"), F.col("p_size").alias("rank"), (F.col("p_size") % 2 == 0).alias("flag"))
    new = p.where("p_partkey % 3 = 0").select((F.col("p_partkey") * 2).alias("id"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")).alias("name"), (F.col("p_size") - 3).alias("rank"), (F.col("p_size") % 7 == 0).alias("flag"))
    return ingest.upsert(base, new, "id", {"name": "fill", "rank": "least", "flag": "sticky"})


on("functional_upsert", "part", upserted, """with o as (select p_partkey as id, case when p_size % 4 = 0 then '' else p_name end as name, p_size as rank, p_size % 2 = 0 as flag from part
), n as (select p_partkey * 2 as id, case when p_size % 5 = 0 then '' else p_brand end as name, p_size - 3 as rank, p_size % 7 = 0 as flag from part where p_partkey % 3 = 0)
select coalesce(o.id, n.id) as id, coalesce(nullif(n.name, ''), o.name) as name, least(o.rank, n.rank) as rank, coalesce(o.flag, false) or coalesce(n.flag, false) as flag from o full join n on n.id = o.id""")
on("category_closure", "part", lambda p: relate.closure(p.where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent")), "child", "parent"), "with recursive up(node, ancestor, depth) as (select p_partkey, p_partkey // 3, 1 from part where p_partkey > 0 union all select node, ancestor // 3, depth + 1 from up where ancestor > 0) select node, ancestor, depth from up")
on("order_outliers", "lineitem", lambda t: ingest.out_of_order(t, "l_orderkey", "l_linenumber", "l_partkey"))
add("tiered_resolution", lambda spark, d: ingest.resolved(read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("lemma")), [
    ("local", read(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("lemma"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("value"))),
    ("other", read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("lemma"), F.col("l_returnflag").alias("value"))),
]), """with a as (select cast(p_partkey as varchar) as lemma, min(p_name) as v from part where p_partkey % 2 = 0 and p_size % 3 <> 0 group by 1), b as (select cast(l_partkey as varchar) as lemma, min(l_returnflag) as v from lineitem where l_quantity > 45 group by 1)
select x.lemma, coalesce(a.v, b.v) as value, case when a.v is not null then 'local' when b.v is not null then 'other' end as tier from (select distinct cast(p_partkey as varchar) as lemma from part) x left join a on a.lemma = x.lemma left join b on b.lemma = x.lemma""")
on("first_definition_per_entry", "conversations", lambda c: c.where("length(trim(text)) >= 40").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("text"), F.count("*").alias("senses")), "select conv_id, arg_min(text, (turn, text)) as text, count(*) as senses from conversations where length(trim(text)) >= 40 group by 1")
star("maintain_status", lambda c: c.all_words.agg(F.count("*").alias("total"), F.round(F.count("difficulty") / F.count("*"), 6).alias("scored"), F.round(F.count(F.when(F.col("quizzable"), 1)) / F.count("*"), 6).alias("quizzable"), F.round(F.count(F.when(F.col("archaic") != "current", 1)) / F.count("*"), 6).alias("archaic")), "select count(*) as total, round(count(difficulty) / count(*), 6) as scored, round(count(*) filter (where quizzable) / count(*), 6) as quizzable, round(count(*) filter (where archaic <> 'current') / count(*), 6) as archaic from all_word")
