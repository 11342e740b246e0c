"""Named queries over listings, selections and text rules, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .catalog import BOOKS, WORDS, add, star
from .catalog_more import ANSWERS, GRAM, JUDGED, T3, answers, judged, on, read
from .operators import facets, ingest, lexicon, listing, progress, rules
from .operators.derived import ENDINGS, derived_roots
from .operators.listing import EntityFilter
from .plans.staging import settled
from .plans.star import SQL, load

#: What is left of a word of w without a known affix.
ROOT_TRIES = " union all ".join(
    [f"select lemma, substr(lemma, {len(h) + 1}) as root from w where starts_with(lemma, '{h}')" for h in lexicon.HEADS]
    + [f"select lemma, left(lemma, length(lemma) - {len(t)}) || e as root from w, (values (''), ('e')) as x(e) where ends_with(lemma, '{t}')" for t in lexicon.TAILS])

# --- listings of entities, filtered after aggregation
BOOK = BOOKS + " select * from books where "
star("books_in_bucket", lambda c: EntityFilter(bucket="0", fame=(3, 7)).apply(facets.books(c)), BOOK + "unique_word_count = 0 and fame_score between 3 and 7")
star("books_in_band", lambda c: EntityFilter(overall="40-60").apply(facets.books(c)), BOOK + "overall_difficulty >= 40 and overall_difficulty < 60")
star("books_without_data", lambda c: EntityFilter(overall=listing.NO_DATA).apply(facets.books(c)), BOOK + "overall_difficulty is null")
star("books_unfamed_by_letter", lambda c: EntityFilter(unfamed=True, letter="T").apply(facets.books(c)), BOOK + "fame_score is null and lower(left(title, 1)) = 't'")
star("word_search_relevance", lambda c: listing.by_relevance(facets.words(c, facets.WordFilter(part_of_speech=("STANDARD", "ECONOMY"))).select("id", "lemma"), "lemma", "small ring"), f""", g as (select id, lemma, {GRAM.format('lemma')} as x, {GRAM.format(chr(39) + 'small ring' + chr(39))} as y from word where part_of_speech in ('STANDARD', 'ECONOMY'))
, s as (select id, lemma, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as similarity from g) select * from s where similarity > 0.1""")
star("words_sample", lambda c: listing.sample(facets.words(c), "id", 20, 7), WORDS + "true order by md5('7:' || cast(w.id as varchar)), w.id limit 20")
star("review_sample", lambda c: listing.sample(c.words.select("id", "quizzable", "difficulty"), "id", 30, 3, F.col("difficulty") > 90), "select id, quizzable, difficulty from word order by coalesce(difficulty > 90, false) desc, md5('3:' || cast(id as varchar)), id limit 30")
star("headline_tops", listing.tops, "select arg_max(id, (difficulty, -id)) as hardest_word, (select arg_max(id, (fame_score, -id)) from book join fame on id = book_id) as most_acclaimed from word where difficulty is not null")
star("facet_values", listing.facet_values, "select 'pos' as facet, part_of_speech as value, count(*) as n from word group by 2 union all select 'genre', genre, count(*) from genre group by 2 union all select 'archaic', archaic, count(*) from word group by 2")
star("job_statistics", lambda c: listing.job_statistics(c.words), "select archaic, count(*) as words, count(difficulty) as scored, round(cast(sum(cast(difficulty as decimal(18,4))) as double) / count(difficulty), 6) as mean, round(median(difficulty), 6) as median from word group by 1")
star("taxonomy", lambda c: listing.taxonomy(c.codes), ", n as (select code from code union select left(code, 1) from code) select code, case when length(code) = 1 then null when contains(code, '.') and split_part(code, '.', 1) in (select code from n) then split_part(code, '.', 1) else left(code, 1) end as parent, cast(case when length(code) = 1 then 0 when contains(code, '.') then 2 else 1 end as int) as level from n")
PROPOSED = "select word_id as id, 0 as position, code || '.9' as code from code union all select word_id, 1, code from code union all select word_id, 2, '?' || code from code"


def proposed(c) -> DataFrame:
    of = lambda n, code: c.codes.select(F.col("word_id").alias("id"), F.lit(n).alias("position"), code.alias("code"))
    return listing.repaired(of(0, F.concat("code", F.lit(".9"))).unionByName(of(1, F.col("code"))).unionByName(of(2, F.concat(F.lit("?"), "code"))).groupBy("id", "position").agg(F.max("code").alias("code")), c.codes)


star("code_repair", proposed, f", p as (select id, position, max(code) as code from ({PROPOSED}) group by 1, 2), k as (select distinct code from code), b as (select id, position, max(k.code) as code from p join k on k.code = regexp_replace(p.code, '[.]9$', '') group by 1, 2), o as (select id, code, min(position) as position from b group by 1, 2) select id, code, row_number() over (partition by id order by position) as rank from o")
star("category_confidence", lambda c: listing.ranked_categories(c.codes.groupBy(F.col("word_id").alias("id")).agg(F.sort_array(F.collect_set("code"), False).alias("codes"))), ", r as (select word_id as id, code, row_number() over (partition by word_id order by code desc) - 1 as rank from (select distinct word_id, code from code)) select id, code, round(greatest(0.4, 1 - 0.25 * rank), 2)::double as confidence, rank = 0 as is_primary from r")
star("dictionary_flags", lambda c: listing.flagged(c.words, c.all_words.select(F.concat(F.upper(F.left("lemma", F.lit(1))), F.substring("lemma", 2, 99)).alias("term"), (F.col("id") % 5 == 0).alias("archaic"), (F.col("id") % 7 == 0).alias("obsolete"))), ", d as (select lower(lemma) as t, bool_or(id % 5 = 0) as a, bool_or(id % 7 = 0) as o from all_word group by 1) select id, coalesce(a, false) as archaic, coalesce(o, false) as obsolete from word left join d on t = lower(lemma)")
star("quiz_targets", lambda c: listing.quiz_targets(c, c.words.where("id % 3 = 0").select(F.col("id").alias("word_id"), (F.col("difficulty") / 2).alias("personal_difficulty")), ("Customer#000000042", "Customer#000000043"), tuple(range(0, 40)), ("1-URGENT",), 5, 60), """, t as (select w.id, case when w.id % 3 = 0 and w.difficulty is not null then w.difficulty / 2 else w.difficulty end as difficulty from word w where quizzable
  and exists (select 1 from link l join book b on b.id = l.book_id where l.word_id = w.id and (b.author in ('Customer#000000042', 'Customer#000000043') or b.id < 40))
  and exists (select 1 from link l join genre g on g.book_id = l.book_id where l.word_id = w.id and g.genre = '1-URGENT')) select * from t where difficulty between 5 and 60""")

# --- verdicts of candidate words
on("ordered_verdicts", "documents", lambda d: listing.ordered_verdicts(judged(d)), f"{T3}{JUDGED}, x as (select doc_id, lemma, case when reason is null then 'keep' else 'drop' end as verdict, zipf, reason from v) select doc_id, lemma, verdict, row_number() over (partition by doc_id, verdict order by case when verdict = 'keep' then zipf end nulls last, reason nulls last, lemma) as position from x")
on("rejected_listing", "documents", lambda d: listing.rejected_listing(judged(d).where("verdict = 'drop'"), d.where("doc_id % 20 = 0").select("doc_id"), ("proper_noun",), "s"), f"{T3}{JUDGED}, r as (select * from v where reason is not null) select lemma, count(distinct doc_id) as book_count, cast(sum(n_tokens) as bigint) as total_count, array_to_string(list_sort(list(distinct reason)), '|') as reasons from r group by 1 having bool_or(doc_id % 20 = 0) and bool_or(reason = 'proper_noun') and lemma like 's%'")


def three_sources(d: DataFrame) -> DataFrame:
    j = judged(d)
    words = j.where("verdict = 'keep'").groupBy("lemma").agg((F.sum("n_tokens") % 2 == 0).alias("active"))
    return listing.matched(d.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("lemma")).where("lemma <> ''"), words, j.where("verdict = 'drop'"))


on("three_source_match", "documents", three_sources, f"{T3}{JUDGED}, k as (select lemma, sum(n_tokens) % 2 = 0 as active from v where reason is null group by 1), r as (select distinct lemma from v where reason is not null), e as (select distinct unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')) as lemma from documents) select e.lemma, case when k.active then 'accepted' when not k.active then 'pruned' when r.lemma is not null then 'rejected' else 'unique' end as match from e left join k on k.lemma = e.lemma left join r on r.lemma = e.lemma where e.lemma <> ''")

# --- practice
on("due_for_recheck", "events", lambda e: listing.due(e.groupBy("user_id").agg(F.max("ts").alias("checked_at"), F.sum("value").alias("total")), "checked_at", F.lit("2024-02-10").cast("timestamp_ntz"), 10, F.col("user_id") % 3 == 0).select("user_id", "checked_at"), "select user_id, checked_at from (select user_id, max(ts) as checked_at from events group by 1) where user_id % 3 = 0 and checked_at < timestamp '2024-02-10' - interval 10 day")
on("word_sets", "events", lambda e: progress.word_sets(answers(e)), f"{ANSWERS}, i as (select user_id, word_id, bool_or(correct) as mastered from ans group by 1, 2) select user_id, count(*) as words, count(*) filter (where mastered) as mastered, count(*) filter (where not mastered) as flashcards from i group by 1")
on("answered_of_expected", "events", lambda e: progress.answered(answers(e), 3), f"{ANSWERS} select session, cast(3 * count(distinct word_id) as bigint) as expected, count(*) as answered, count(*) >= 3 * count(distinct word_id) as complete from ans group by 1")
on("word_history", "events", lambda e: progress.history(answers(e)), f"{ANSWERS}, h as (select *, row_number() over (partition by user_id, word_id order by answered_at, question) as nth from ans) select user_id, word_id, question, nth, correct, cast(sum(correct::int) over (partition by user_id, word_id order by nth) as bigint) as right_so_far from h")

# --- labels, definitions and titles made of the columns at hand
RAW = ("N", "nouns ", "Adj", "sconj", "PROPN", "Trademark", "x", "", "weird", "ADV", "geographical name")
PICK = "list_value(" + ", ".join(f"'{x}'" for x in RAW) + f")[p_partkey % {len(RAW)} + 1]"
PLAIN = "case " + PICK + " " + " ".join(f"when '{r}' then '{rules.POS.get(r.strip().lower(), r.strip().lower())}'" for r in RAW) + " end"
pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
on("part_of_speech_labels", "part", lambda p: p.select("p_partkey", rules.normal_pos(pick(RAW, F.col("p_partkey"))).alias("pos"), rules.junk_reason(pick(RAW, F.col("p_partkey"))).alias("reason")), f"select p_partkey, {PLAIN} as pos, case when {PLAIN} in ('proper noun', 'trademark', 'geographical name') then 'proper_noun' end as reason from part")


def gloss(p: DataFrame):
    n = F.col("p_size") % 4
    return F.when(n == 0, F.concat(F.lit("plural of "), "p_name", F.lit("."))).when(n == 1, F.concat(F.lit("Synonym of "), "p_name", F.lit(' ("a kind").'))).when(n == 2, F.concat(F.lit("plural of "), "p_name", F.lit(": the kind"))).otherwise(F.col("p_name"))


on("cross_references", "part", lambda p: p.select("p_partkey", rules.cross_reference(gloss(p)).alias("r")).select("p_partkey", "r.kind", "r.target", "r.gloss"), f"with g as (select p_partkey, p_size % 4 as n, p_name from part) select p_partkey, case n when 1 then 'synonym' when 3 then null else 'plural' end as kind, case when n <> 3 then p_name end as target, case n when 1 then 'a kind' when 2 then 'the kind' end as gloss from g")
TITLE = "list_value('A Tale, Vol. ', 'Travels. Part ', 'Old Days: Chapters ', 'No Number ')[o_orderkey % 4 + 1] || list_value('3', 'IV', '12 to 14', 'the last', '2 (of 5)')[o_orderkey % 5 + 1]"


def titles(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    title = F.concat(pick(("A Tale, Vol. ", "Travels. Part ", "Old Days: Chapters ", "No Number "), k), pick(("3", "IV", "12 to 14", "the last", "2 (of 5)"), k))
    return o.select("o_orderkey", rules.title_suffix(title).alias("s")).select("o_orderkey", "s.*")


on("title_suffix", "orders", titles, """with t as (select o_orderkey, o_orderkey % 4 as a, o_orderkey % 5 as b from orders) select o_orderkey,
  case when a < 3 then list_value('A Tale', 'Travels', 'Old Days')[a + 1] end as base, case when a < 3 then list_value('vol.', 'part', 'chapters')[a + 1] end as kind,
  cast(case when a < 3 then list_value(3, 4, 12, null, 2)[b + 1] end as int) as first, cast(case when a < 3 and b = 2 then 14 end as int) as last, cast(case when a < 3 and b = 4 then 5 end as int) as total, a < 3 and b = 3 as open_ended from t""")
on("natural_names", "supplier", lambda s: s.select("s_suppkey", rules.natural_name(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Lee, J. (John "), "s_name", F.lit("), 1800-1870"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("Lee, "), "s_name", F.lit(", 1801-"))).otherwise(F.col("s_name"))).alias("name")), "select s_suppkey, case s_suppkey % 3 when 0 then 'John ' || s_name || ' Lee' when 1 then s_name || ' Lee' else s_name end as name from supplier")
on("commons_urls", "part", lambda p: p.select("p_partkey", rules.commons_url(F.concat(F.lit("En-us "), "p_name", F.lit(".ogg"))).alias("url")), "with t as (select p_partkey, replace('En-us ' || p_name || '.ogg', ' ', '_') as t from part) select p_partkey, '/' || left(md5(t), 1) || '/' || left(md5(t), 2) || '/' || t as url from t")
on("checked_scores", "part", lambda p: p.select("p_partkey", rules.checked_score(pick(("7", "11", "0", "x", "3.6", " 10 "), F.col("p_partkey"))).alias("score")), "select p_partkey, list_value(7.0, null, null, null, 3.6, 10.0)[p_partkey % 6 + 1]::double as score from part")
on("representative_sentence", "conversations", lambda c: rules.representative(c.where("text is not null"), "conv_id", "text"), "with t as (select conv_id, text, length(text) as n, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) as w from conversations where text is not null) select conv_id, arg_min(text, (case when w >= 4 then 0 else 1 end, n, text)) as sentence from t group by 1")
on("picked_sense", "lineitem", lambda t: rules.picked_sense(t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nth"), F.col("l_returnflag").alias("pos"), (F.col("l_linestatus") == "O").alias("junk")), "R"), "with s as (select l_orderkey as id, l_linenumber as nth, l_returnflag as pos, l_linestatus = 'O' as junk from lineitem), r as (select *, row_number() over (partition by id order by junk, pos <> 'R', nth, pos) as n from s) select id, nth, pos from r where n = 1")
on("settings", "events", lambda e: e.select("event_id", rules.setting(F.col("props"), "$.k", ("1", "2", "3"), "2").alias("mode")), "select event_id, case when json_extract_string(props, '$.k') in ('1', '2', '3') then json_extract_string(props, '$.k') else '2' end as mode from events")
star("display_summary", lambda c: facets.books(c).select("id", rules.summary(F.col("mean_difficulty"), F.col("stddev_difficulty"), F.col("density")).alias("summary")), BOOKS + " select id, case when mean_difficulty is null then 'not scored' else cast(cast(round(mean_difficulty) as int) as varchar) || coalesce(' ± ' || cast(cast(round(stddev_difficulty) as int) as varchar), '') end || case when density is null then '' else ', ' || cast(cast(round(100 * density) as int) as varchar) || ' %' end as summary from books")

# --- validity of words: every word of the documents, with what the tables say of it. Turns of the system's role are the local
# dictionary, the benchmark is the word list, the share of a word's documents that are not English its context.
LANGS = ("de", "es", "fr")


def spoken(d: DataFrame, lang: str) -> DataFrame:
    """(lemma, zipf) in the documents of one language."""
    return ingest.zipf(ingest.candidates(d.where(F.col("lang") == lang))).select("lemma", F.col("zipf").alias(lang))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each word: n, zipf, local, foreign_context, named, vouched, listed, neighbour, rooted, root and peak (its greatest share of a document; 0 for a word met once)."""
    d = read(spark, sf_dir, "documents")
    words = lambda t: t.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("lemma")).distinct()
    found = ingest.candidates(d).join(d.select("doc_id", "lang"), "doc_id")
    size = Window.partitionBy("doc_id")
    found = found.withColumn("share", F.round(F.col("n_tokens") / F.sum("n_tokens").over(size), 6))
    seen = found.groupBy("lemma").agg(
        F.sum("n_tokens").alias("n"), (2 * F.count(F.when(F.col("lang") != "en", 1)) > F.count("*")).alias("foreign_context"), (F.min("capitalised") >= 0.85).alias("named"), F.max("share").alias("share"))
    scale = ingest.zipf(ingest.candidates(d)).select("lemma", "zipf")
    out = settled(seen.join(scale, "lemma"))
    known = out.where("n >= 5").select("lemma", "zipf")
    near = ingest.neighbours(known, gap=1.5).select("lemma", F.lit(True).alias("neighbour"))
    root = lexicon.roots(known, known).select("lemma", "root", "root_zipf")
    local = words(read(spark, sf_dir, "conversations").where("role = 'system'")).withColumn("local", F.lit(True))
    listed = words(read(spark, sf_dir, "benchmark")).withColumn("listed", F.lit(True))
    for t in (near, root, local, listed):
        out = out.join(t, "lemma", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("lemma", "n", "zipf", flag("local"), "foreign_context", "named", flag("listed"), F.coalesce("listed", F.lit(False)).alias("vouched"), flag("neighbour"), "root", "root_zipf", F.col("root").isNotNull().alias("rooted"), F.when(F.col("n") > 1, F.col("share")).otherwise(0.0).alias("peak"))


SIGNALS = f"""{T3}, cd as (select cand.*, lang, round(n_tokens / sum(n_tokens) over (partition by cand.doc_id), 6) as share from cand join documents using (doc_id)
), seen as (select lemma, cast(sum(n_tokens) as bigint) as n, 2 * count(*) filter (where lang <> 'en') > count(*) as foreign_context, min(capitalised) >= 0.85 as named, max(share) as share from cd group by 1
), w as (select lemma, zipf from z where n >= 5
), near as (select distinct x.lemma from w x join w y on length(x.lemma) >= 4 and length(y.lemma) >= 4 and y.zipf >= x.zipf + 1.5 and abs(length(x.lemma) - length(y.lemma)) <= 1 and levenshtein(x.lemma, y.lemma) <= 1
), tries as (select distinct * from ({ROOT_TRIES}) where length(root) >= 3
), rooted as (select t.lemma, t.root, w.zipf as root_zipf, row_number() over (partition by t.lemma order by w.zipf desc, length(t.root), t.root) as r from tries t join w on w.lemma = t.root
), local as (select distinct unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) as lemma from conversations where role = 'system'
), listed as (select distinct unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) as lemma from benchmark
), f as (
  select s.lemma, s.n, z.zipf, s.lemma in (from local) as local, foreign_context, named, s.lemma in (from listed) as listed, s.lemma in (from listed) as vouched, s.lemma in (from near) as neighbour, rooted.root, rooted.root_zipf,
    rooted.root is not null as rooted, case when s.n > 1 then share else 0.0 end as peak
  from seen s join z on z.lemma = s.lemma left join rooted on rooted.lemma = s.lemma and rooted.r = 1)"""
add("validity_signals", signals, f"{SIGNALS} select * from f")
add("validity_gate", lambda spark, d: signals(spark, d).select("lemma", rules.validity_gate().alias("g")).select("lemma", "g.verdict", "g.reason"), f"""{SIGNALS}, g as (select lemma, case when local then 'keep:' when foreign_context then case when n >= 3 then 'unsure:foreign_language' else 'drop:foreign_language' end when named and not vouched then 'drop:proper_noun' when listed then 'keep:'
  when neighbour then case when n >= 3 then 'unsure:misspelling' else 'drop:misspelling' end when zipf > 0 then 'keep:' when n >= 3 then 'unsure:' else 'drop:not_a_word' end as v from f)
select lemma, split_part(v, ':', 1) as verdict, nullif(split_part(v, ':', 2), '') as reason from g""")
add("validity_estimate", lambda spark, d: signals(spark, d).select("lemma", rules.validity_estimate().alias("v")).select("lemma", "v.score", "v.label"), f"""{SIGNALS}, s as (select lemma, foreign_context, least(greatest(0.35::double + case when peak > 0 then 0.10::double when peak = 0 then -0.25::double else 0 end + case when zipf > 0 then 0.05::double else 0 end + case when listed then 0.40::double else 0 end + case when rooted then 0.15::double else 0 end - case when neighbour then 0.45::double else 0 end, 0), 1) as s from f
), t as (select lemma, round(case when foreign_context then least(s, 0.25) else s end, 2)::double as score from s) select lemma, score, case when score >= 0.6 then 'likely-valid' when score <= 0.35 then 'likely-artifact' else 'uncertain' end as label from t""")
add("frequency_bands", lambda spark, d: signals(spark, d).select("lemma", rules.frequency_band(F.col("zipf")).alias("band"), rules.effective_zipf(F.col("zipf"), F.col("root_zipf")).alias("effective")), f"{SIGNALS} select lemma, case when zipf >= 3.5 then 'common' when zipf >= 2.0 then 'uncommon' else 'rare' end as band, greatest(zipf, root_zipf)::double as effective from f")
add("trusted_lemma", lambda spark, d: signals(spark, d).where("rooted").select(F.col("lemma").alias("surface"), rules.trusted_lemma(F.col("lemma"), F.col("root"), F.col("zipf"), F.col("root_zipf"), ~F.col("neighbour")).alias("lemma")), f"{SIGNALS} select lemma as surface, case when not neighbour and zipf - root_zipf <= 0.5 then root else lemma end as lemma from f where rooted")


def foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    out = spoken(d, "en")
    for lang in LANGS:
        out = out.join(spoken(d, lang), "lemma", "full_outer")
    hint = rules.foreign_hint({x: F.col(x) for x in LANGS}, F.coalesce("en", F.lit(0.0)))
    return out.select("lemma", hint.alias("h")).select("lemma", "h.language", "h.zipf")


add("foreign_hint", foreign, """with occ as (select lang, lower(s) as lemma from (select lang, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) as s from documents where lang in ('en', 'de', 'es', 'fr')) where length(s) >= 3
), n as (select lang, lemma, count(*) as n from occ group by 1, 2), z as (select lang, lemma, round(log10(n / sum(n) over (partition by lang) * 1e9), 4) as z from n
), b as (select x.lemma, arg_max(x.lang, (x.z, x.lang)) as language, max(x.z) as z from z x left join z e on e.lang = 'en' and e.lemma = x.lemma where x.lang <> 'en' and x.z >= 3.0 and x.z >= coalesce(e.z, 0.0) + 1.0 group by 1)
select l.lemma, b.language, b.z::double as zipf from (select distinct lemma from z) l left join b on b.lemma = l.lemma""")



def roots_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of all words of the documents, as they are and with un-; those in -ly are adverbs, every second known word an adjective."""
    s = settled(signals(spark, sf_dir).select("lemma", "n", "zipf"))
    pos = F.when(F.col("lemma").endswith("ly"), "ADV").otherwise("NOUN")
    words = s.select("lemma", pos.alias("pos")).unionByName(s.where("n >= 5").select(F.concat(F.lit("un"), "lemma").alias("lemma"), pos.alias("pos")))
    return derived_roots(words, s.select(F.col("lemma").alias("word"), (F.col("n") % 2 == 0).alias("adjective"), (F.col("n") >= 3).alias("listed")))


TRIED = " union all ".join(f"select s, {i} as nth, left(s, length(s) - {len(end)}) || '{put}' as a from s where s like '%{end}' and length(s) - {len(end)} >= 2" for i, (end, put) in enumerate(ENDINGS))
BARE = "case when {0} like 'un%' and length({0}) >= 6 then substr({0}, 3) end"
add("derived_roots", roots_of, f"""{T3}, w as (select distinct lemma, pos, {BARE.format('lemma')} as bare from (select lemma, case when lemma like '%ly' then 'ADV' else 'NOUN' end as pos from z union all select 'un' || lemma, case when lemma like '%ly' then 'ADV' else 'NOUN' end from z where n >= 5)
), s as (select lemma as s from w union select bare from w where bare is not null
), t as ({TRIED}), adj as (select s, arg_min(a, nth) as a from t where a in (select lemma from z where n % 2 = 0) group by 1
), listed as (select lemma as l from z where n >= 3
), v as (select lemma, pos, coalesce(d.l, x.a, y.a) as root, 'ADJ' as root_pos from w left join adj x on x.s = lemma left join adj y on y.s = bare left join listed d on d.l = {BARE.format('x.a')} where pos = 'ADV'
  union all select lemma, pos, coalesce(a.a, p.l), case when a.a is not null then 'ADJ' else pos end from w left join listed p on p.l = bare left join adj a on a.s = p.l where pos <> 'ADV')
select * from v where root is not null""")

# --- the last rule by the columns of parts
FLAGS = """with f as (select p_partkey as id, p_partkey % 97 = 0 as local, p_partkey % 13 = 0 as foreign_context, p_partkey % 11 = 0 as named, p_partkey % 22 = 0 as vouched, p_partkey % 5 = 0 as listed, p_partkey % 7 = 0 as neighbour, case when p_partkey % 3 = 0 then 0.0 else (p_partkey % 40) / 10.0 end as zipf, p_size % 6 as n,
  p_partkey % 4 = 0 as rooted, case when p_partkey % 6 = 0 then null else (p_partkey % 2) * 1e-7 end as peak from part)"""


def flags(p: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    hit = lambda n: k % n == 0
    return p.select(
        k.alias("id"), hit(97).alias("local"), hit(13).alias("foreign_context"), hit(11).alias("named"), hit(22).alias("vouched"), hit(5).alias("listed"), hit(7).alias("neighbour"),
        F.when(hit(3), 0.0).otherwise((k % 40) / 10.0).alias("zipf"), (F.col("p_size") % 6).alias("n"), hit(4).alias("rooted"), F.when(~hit(6), (k % 2) * F.lit(1e-7)).alias("peak"),
    )


on("quizzable_reason", "part", lambda p: flags(p).select("id", rules.quizzable(pick(("plural of x", "a plain thing", "third-person singular"), F.col("id")), F.when(F.col("rooted"), F.lit("root")), F.col("zipf"), pick(("a — in —", "one who sells old books in — shops", "of —"), F.col("n")), F.when(F.col("listed"), "redacted").otherwise("clean"), F.col("neighbour")).alias("q")).select("id", "q.quizzable", "q.reason"), f"""{FLAGS}, r as (select id, case when id % 3 <> 1 then 'variant form' when rooted and zipf >= 3.0 then 'transparent derivative' when listed and n % 3 <> 1 then 'redacted too far' when neighbour then 'leaks' end as reason from f) select id, reason is null as quizzable, reason from r""")

add("word_details", lambda spark, d: rules.word_details(load(spark, d)), f"{SQL}, c as (select word_id, array_to_string(list_sort(list(code)), ' ') as codes from code group by 1), b as (select word_id, count(*) as books, min(book_id) as first_book from link group by 1) select w.id, lemma, difficulty, c.codes, coalesce(b.books, 0) as books, b.first_book from word w left join c on c.word_id = w.id left join b on b.word_id = w.id")
