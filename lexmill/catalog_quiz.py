"""Named queries over questions, relations, leaks and changes of tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalog import add
from .catalog_more import GRAM, T3, common, on, read
from .operators import edges, ingest, leaks, phrases, quiz, writes
from .operators.distractors import Rule, distractors
from .operators.sessions import Plan, sessions
from .plans.staging import shuffled
from .plans.star import SQL, load

# --- distractors and questions: every quizzable word whose id is divisible by 20. The vectors of the tables have no structure, so
# the band of meanings and the floor of near-synonyms are set where their distances lie.
RULE = Rule(near=(0.6, 0.9), floor=0.75)


def ring_sql(word: str, target: str) -> str:
    at = lambda x: f"cast('0x' || left(md5('{RULE.seed}:' || cast({x} as varchar)), 8) as bigint)"
    return f"(({at(word)} - {at(target)}) % 4294967296 + 4294967296) % 4294967296"


QUOTAS = RULE.quotas()
UPTO = "list_value(" + ", ".join(str(n) for _, n in QUOTAS) + ")"
DISTANCE = "round(1 - least(greatest(list_dot_product(w.vector, t.vector) / sqrt(list_dot_product(w.vector, w.vector) * list_dot_product(t.vector, t.vector)), -1.0), 1.0), 6)"
RECURSIVE = SQL.replace("with all_word as", "with recursive all_word as", 1)
POOL = f"""{RECURSIVE}, field as (select word_id, list(distinct left(code, 1)) as fields from code group by 1
), vec as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as vector from embeddings
), w as (select id, part_of_speech, difficulty, coalesce(fields, []) as fields, {GRAM.format('lemma')} as grams, vector from word left join field on word_id = id left join vec on vec_id = id where quizzable and difficulty is not null
), syn as (select t.p_partkey as target, w.p_partkey as word from part t join part w on t.p_brand = w.p_brand and t.p_type = w.p_type and t.p_size = w.p_size and t.p_partkey <> w.p_partkey where t.p_partkey % 20 = 0
), e0 as (select t.id as target, w.id as word, round(len(list_intersect(w.grams, t.grams)) / len(list_distinct(list_concat(w.grams, t.grams))), 6) as alike, {DISTANCE} as distance, len(list_intersect(w.fields, t.fields)) > 0 as same,
    {ring_sql('w.id', 't.id')} as d, w.difficulty between t.difficulty - {RULE.reach} and t.difficulty + {RULE.reach} as inside
  from w join w t on t.id % 20 = 0 and w.id <> t.id and w.part_of_speech = t.part_of_speech and w.difficulty between t.difficulty - {RULE.reach + RULE.widen} and t.difficulty + {RULE.reach + RULE.widen}
), e as (select * from e0 where coalesce(distance >= {RULE.floor}, true) and not exists (select 1 from syn where syn.target = e0.target and syn.word = e0.word)
), c as (
  select target, word, 0 as s, row_number() over (partition by target order by alike desc, d, word) as nth from e where inside and alike > {RULE.alike}
  union all select target, word, 1, row_number() over (partition by target order by distance, word) from e where inside and distance between {RULE.near[0]} and {RULE.near[1]}
  union all select target, word, 2, row_number() over (partition by target order by d, word) from e where inside and same
  union all select target, word, 3, row_number() over (partition by target order by d, word) from e where inside
), entry as (select target, word, s, row_number() over (partition by target order by s, nth) as i from c where nth <= {2 * RULE.count}
), fold as (select id as target, 0::bigint as i, []::struct(word bigint, s int)[] as got from w where id % 20 = 0
  union all select f.target, f.i + 1, case when len(got) < {UPTO}[n.s + 1] and not list_contains(list_transform(got, lambda x: x.word), n.word) then list_append(got, {{'word': n.word, 's': n.s}}) else got end from fold f join entry n on n.target = f.target and n.i = f.i + 1
), taken as (select target, arg_max(got, i) as got from fold group by 1
), wide as (select e.target, e.word, row_number() over (partition by e.target order by d, e.word) as i from e join taken using (target) where len(got) < {RULE.count} and not list_contains(list_transform(got, lambda x: x.word), e.word)
), grown as (select target, list_concat(got, coalesce((select list({{'word': word, 's': 3}} order by i) from wide where wide.target = taken.target and i <= {RULE.count} - len(got)), [])) as got, len(got) < {RULE.count} as degraded from taken
), picked as (select target, unnest(got).word as word, list_value({", ".join(repr(n) for n, _ in QUOTAS)})[unnest(got).s + 1] as strategy, generate_subscripts(got, 1) as place, degraded from grown)"""


def quiz_words(c) -> DataFrame:
    """The quizzable words with their fields and vectors."""
    field = c.codes.groupBy(F.col("word_id").alias("id")).agg(F.collect_set(F.left("code", F.lit(1))).alias("fields"))
    words = c.words.where("quizzable").join(shuffled(field), "id", "left").join(c.vectors, "id", "left")
    return words.withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))


def synonyms(part: DataFrame, targets: str = "p_partkey % 20 = 0") -> DataFrame:
    """(target, word) of parts alike in brand, type and size, for every target."""
    keys = ["p_brand", "p_type", "p_size"]
    asked = part.where(targets).select(F.col("p_partkey").alias("target"), *keys)
    return asked.join(shuffled(part.select(F.col("p_partkey").alias("word"), *keys)), keys).where("target <> word").select("target", "word")


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = quiz_words(load(spark, sf_dir))
    return distractors(words, words.where("id % 20 = 0"), RULE, [synonyms(read(spark, sf_dir, "part"))])


def quiz_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session of ten questions for every user."""
    asked = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"))
    return sessions(asked, quiz_words(load(spark, sf_dir)), Plan(), RULE, [synonyms(read(spark, sf_dir, "part"), "true")])


add("quiz_sessions", quiz_sessions)


def of_picked(name: str, query, oracle: str) -> None:
    add(name, lambda spark, sf_dir: query(picked(spark, sf_dir)), POOL + oracle)


of_picked("distractor_batch", lambda d: d, " select target, word, strategy, cast(place as int) as place, degraded from picked")
of_picked("choice_questions", quiz.choice_questions, ", o as (select target, word from picked union select target, target from picked), l as (select target, word, row_number() over (partition by target order by md5('1:' || cast(target as varchar) || '-' || cast(word as varchar)), word) as n from o) select target, string_agg(cast(word as varchar), ' ' order by n) as options, cast(max(case when word = target then n end) - 1 as int) as correct, round(1 / count(*), 6) as floor from l group by 1")
of_picked("truth_questions", quiz.truth_questions, " select target, case when left(md5('1:' || cast(target as varchar)), 1) < '8' then target else word end as shown, left(md5('1:' || cast(target as varchar)), 1) < '8' as is_true, 0.5::double as floor from picked where place = 1")
on("graded_matching", "lineitem", lambda t: quiz.graded(t.select(F.col("l_orderkey").alias("question"), (F.col("l_partkey") % 3).alias("expected"), F.when(F.col("l_returnflag") != "N", F.col("l_suppkey") % 3).alias("response"))), "with a as (select l_orderkey as question, l_partkey % 3 as e, case when l_returnflag <> 'N' then l_suppkey % 3 end as r from lineitem), g as (select question, count(*) as pairs, count(r) as submitted, count(*) filter (where r = e) as correct from a group by 1) select *, round(case when submitted > 0 then correct / submitted end, 6) as finish_credit, round(correct / pairs, 6) as review_credit from g")
on("early_stops", "events", lambda e: quiz.stopping(e, "user_id", "event_id", F.col("event_type") == "error", 5, 0.2), "with r as (select user_id, row_number() over w as n, avg((event_type = 'error')::int) over (partition by user_id order by event_id rows unbounded preceding) as rate from events window w as (partition by user_id order by event_id)) select user_id, min(n) as stop_at, round(arg_min(rate, n), 6) as rate from r where n >= 5 and rate > 0.2 group by 1")

# --- relations
PHRASES = ("A kind of {}.", "Part of the old {}", "one who habitually steals a {}", "used for cutting {}", "of or relating to {}", "resembling a big {}", "having the {}, like a {}", "characterized by a {}; a sort of {}", "a plain {}")
VERBS = (("steals", "steal"), ("cutting", "cut"))
TEXT = "replace(list_value(" + ", ".join(f"'{p}'" for p in PHRASES) + f")[p_partkey % {len(PHRASES)} + 1], '{{}}', p_name)"
phrase = lambda: F.replace(F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("p_partkey") % len(PHRASES) + 1).cast("int")), F.lit("{}"), F.col("p_name"))


def stated_edges(p: DataFrame) -> DataFrame:
    """What definitions made of the parts' names state; of a name's two words the second is the noun."""
    names = p.select(F.split("p_name", " ").alias("n")).select(F.explode(F.array(F.struct(F.get("n", F.lit(0)).alias("word"), F.lit("ADJ").alias("pos")), F.struct(F.get("n", F.lit(1)).alias("word"), F.lit("NOUN").alias("pos")))).alias("x"))
    verbs = p.sparkSession.createDataFrame(list(VERBS), "word string, lemma string").select("word", "lemma", F.lit("VERB").alias("pos"))
    lexicon = names.select("x.word", F.col("x.word").alias("lemma"), "x.pos").distinct().unionByName(verbs)
    return phrases.definition_edges(p.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").getItem(1).alias("lemma"), phrase().alias("definition")).withColumn("lemma", F.when(F.col("id") % 4 == 0, F.col("lemma")).otherwise("x")), lexicon)


CLOSED_SQL = " ".join(f"when word in ({', '.join(map(repr, ws))}) then '{pos}'" for pos, ws in reversed(phrases.CLOSED.items()))
FOUND = " union ".join(f"select id, '{r}' as relation, regexp_extract(s, '{phrases.HEAD}', 1) as target from (select id, unnest(regexp_extract_all(tokens, '{phrases.pattern(tuple(places)).replace('*+', '*').replace('++', '+')}')) as s from g)" for r, *places in phrases.PATTERNS)
on("definition_edges", "part", stated_edges, f"""with lexicon as (select word, min(lemma) as lemma, min(pos) as pos from (select split_part(p_name, ' ', 1) as word, split_part(p_name, ' ', 1) as lemma, 'ADJ' as pos from part union all select split_part(p_name, ' ', 2), split_part(p_name, ' ', 2), 'NOUN' from part union all values {', '.join(f"('{w}', '{m}', 'VERB')" for w, m in VERBS)}) group by 1
), t as (select id, word, i from (select p_partkey as id, unnest(regexp_extract_all(lower({TEXT}), '[a-z]+|[^\\sa-z]')) as word, generate_subscripts(regexp_extract_all(lower({TEXT}), '[a-z]+|[^\\sa-z]'), 1) as i from part)
), c as (select t.*, lexicon.lemma, lexicon.pos, case when not regexp_matches(word, '^[a-z]') then 'PUNCT' {CLOSED_SQL} end as closed from t left join lexicon using (word)
), g as (select id, string_agg('<' || case when closed = 'PUNCT' then '.' else word end || '|' || case when closed is null then coalesce(lemma, word) when closed = 'PUNCT' then '.' else word end || '|' || coalesce(closed, pos, case when word like '%ly' then 'ADV' else 'NOUN' end) || '>', '' order by i) as tokens from c group by 1
), f as ({FOUND}) select f.* from f join part on p_partkey = id where target <> '' and target <> case when id % 4 = 0 then split_part(p_name, ' ', 2) else 'x' end""")
tree = lambda p: p.select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent"))
on("sibling_fanout", "part", lambda p: edges.siblings(tree(p), "child", "parent", p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("term"))), "select a.p_partkey as term, b.p_partkey as sibling from part a join part b on a.p_partkey // 3 = b.p_partkey // 3 and a.p_partkey <> b.p_partkey where a.p_partkey % 20 = 0")
edge = lambda p: p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 7 % 211).alias("b"), F.col("p_brand").alias("family"))
checked = lambda p: edges.verified(edge(p), p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 7 % 211).alias("b"), F.when(F.col("p_size") % 2 == 0, "verified").otherwise("rejected").alias("verdict")))
STATUS = "e as (select p_partkey as a, p_partkey * 7 % 211 as b, p_brand as family, case when p_partkey % 3 <> 0 and p_size % 2 = 0 then 'verified' else 'rejected' end as status from part)"
on("edge_verification", "part", checked, f"with {STATUS} select * from e")
on("trap_lemmas", "part", lambda p: edges.traps(p.select((F.col("p_partkey") % 50).alias("term"), F.when(F.col("p_size") % 9 == 0, "thing").otherwise(F.col("p_name")).alias("lemma")), p.where("p_size % 2 = 0").select((F.col("p_partkey") % 50).alias("term"), F.col("p_name").alias("lemma"))), "with f as (select distinct p_partkey % 50 as term, case when p_size % 9 = 0 then 'thing' else p_name end as lemma from part), x as (select distinct p_partkey % 50 as term, p_name as lemma from part where p_size % 2 = 0), k as (select * from f where lemma <> 'thing' and not exists (select 1 from x where x.term = f.term and x.lemma = f.lemma)) select term, count(*) as n, string_agg(lemma, '|' order by lemma) as traps from k group by 1")

# --- leaks: a part's last word in the comment made of its type and name
LEAK = "with d as (select p_partkey as id, split_part(p_name, ' ', 2) as word, 'a ' || lower(p_type) || ' thing like re' || p_name || ' or ' || p_name || 's' as definition from part)"


def leaky(p: DataFrame) -> DataFrame:
    name = F.col("p_name")
    return p.select(F.col("p_partkey").alias("id"), F.split_part(name, F.lit(" "), F.lit(2)).alias("word"), F.concat(F.lit("a "), F.lower("p_type"), F.lit(" thing like re"), name, F.lit(" or "), name, F.lit("s")).alias("definition"))


PRE = "len(list_filter(generate_series(1, least(length(word), length(token))), lambda i: left(word, i) = left(token, i)))"
GLUED = "list_contains(list_value({}), replace(case when length(word) > length(token) then word else token end, case when length(word) > length(token) then token else word end, '')) and ends_with(case when length(word) > length(token) then word else token end, case when length(word) > length(token) then token else word end) and least(length(word), length(token)) >= 4".format(", ".join(f"'{p}'" for p in leaks.PREFIXES))
TOKENS = f"{LEAK}, t as (select distinct id, word, definition, unnest(regexp_extract_all(lower(definition), '[a-z]+')) as token from d), l as (select id, token from t where length(token) >= 3 and (word = token or ({PRE} >= 4 and {PRE} >= 0.55 * least(length(word), length(token))) or ({GLUED})))"
on("leaking_tokens", "part", lambda p: leaks.leaking_tokens(leaky(p), stem=leaks.light_stem))
on("redacted_definitions", "part", lambda p: leaks.redacted(leaky(p), leaks.leaking_tokens(leaky(p), stem=leaks.light_stem)))
# without the spelling ratio and the stem, which SQL lacks
on("leaking_tokens_by_form", "part", lambda p: leaks.leaking_tokens(leaky(p), near=None), f"{TOKENS} select * from l")
on("redacted_by_form", "part", lambda p: leaks.redacted(leaky(p), leaks.leaking_tokens(leaky(p), near=None)), f"{TOKENS}, g as (select id, list(token) as ts from l group by 1) select d.id, case when ts is null then definition else list_aggregate(list_transform(regexp_extract_all(definition, '[A-Za-z]+|[^A-Za-z]+'), lambda x: case when list_contains(ts, lower(x)) then '—' else x end), 'string_agg', '') end as quiz_definition, case when ts is null then 'clean' else 'redacted' end as source from d left join g on g.id = d.id")
on("misspelling_two_edits", "documents", lambda d: ingest.neighbours(common(d), gap=1.5, edits=2), f"{T3}, w as (select lemma, zipf from z where n >= 5 and length(lemma) >= 4), p as (select x.lemma, y.lemma as neighbour, round(y.zipf - x.zipf, 4) as gap, row_number() over (partition by x.lemma order by y.zipf desc, y.lemma) as r from w x join w y on y.zipf >= x.zipf + 1.5 and abs(length(x.lemma) - length(y.lemma)) <= 2 and levenshtein(x.lemma, y.lemma) <= 2) select lemma, neighbour, gap from p where r = 1")

# --- changes of tables
P = "p_partkey as id, p_name as definition, p_brand as previous, p_type as quiz_definition"
on("edited_definitions", "part", lambda p: writes.edited(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("definition"), F.col("p_brand").alias("previous"), F.col("p_type").alias("quiz_definition")), p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.lit("new text")).alias("definition"))), f"select p_partkey as id, case when c then 'new text' else p_name end as definition, case when c then p_name else p_brand end as previous, case when not c then p_type end as quiz_definition from (select *, p_partkey % 3 = 0 and p_size % 2 <> 0 as c from part)")
on("promoted_master", "part", lambda p: writes.promoted(p.where("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("word")).agg(F.lit("Old; B1").alias("books")), p.where("p_partkey % 5 = 0").select(F.upper("p_name").alias("word"), F.concat(F.lit("B"), (F.col("p_size") % 3).cast("string")).alias("book"))), """with m as (select distinct p_name as word from part where p_partkey % 2 = 0), a as (select lower(p_name) as k, upper(min(p_name)) as w, list_sort(list(distinct 'B' || cast(p_size % 3 as varchar))) as bs from part where p_partkey % 5 = 0 group by 1)
select coalesce(m.word, a.w) as word, case when m.word is null then array_to_string(bs, '; ') else array_to_string(list_concat(['Old', 'B1'], list_filter(coalesce(bs, []), lambda b: b <> 'B1')), '; ') end as books from m full join a on a.k = lower(m.word)""")
on("rescued_words", "part", lambda p: writes.rescued(p.where("p_partkey % 4 = 0").select(F.col("p_name").alias("lemma")), p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" x")).alias("lemma"), F.col("p_brand").alias("reason"), F.col("p_type").alias("pos")), p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id")), F.col("pos") == "ECONOMY")[0], "select p_name || ' x' as lemma, min(p_brand) as rescued_reason from part where p_partkey % 4 <> 0 and p_partkey % 3 = 0 and p_type <> 'ECONOMY' group by 1 union all select distinct p_name, null from part where p_partkey % 4 = 0")
on("set_items", "part", lambda p: writes.added_items(p.where("p_partkey % 5 = 0").select((F.col("p_partkey") % 7).alias("set_id"), F.col("p_partkey").alias("word_id"), F.lit(True).alias("mastered")), p.where("p_partkey % 3 = 0").select((F.col("p_partkey") % 7).alias("set_id"), F.col("p_partkey").alias("word_id")), p.where("p_size <> 7").select(F.col("p_partkey").alias("id"))), "select p_partkey % 7 as set_id, p_partkey as word_id, p_partkey % 5 = 0 as mastered from part where p_partkey % 5 = 0 or (p_partkey % 3 = 0 and p_size <> 7)")
on("merge_manifest", "part", lambda p: writes.manifest(p.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("title_base"), F.lit("A").alias("author"), F.col("p_size").alias("parts"), F.lit("gap").alias("skip_reason"), F.when(F.col("p_size") % 3 == 0, F.lit("then")).alias("compiled_at"), F.lit(None).cast("string").alias("merged_at")), p.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("title_base"), F.lit("A").alias("author"), (F.col("p_size") + 1).alias("parts"), F.lit(None).cast("string").alias("skip_reason"))), "select cast(p_partkey as varchar) as title_base, 'A' as author, case when p_partkey % 3 = 0 then p_size + 1 else p_size end as parts, case when p_partkey % 3 <> 0 then 'gap' end as skip_reason, case when p_partkey % 2 = 0 and p_size % 3 = 0 then 'then' end as compiled_at, cast(null as varchar) as merged_at from part where p_partkey % 2 = 0 or p_partkey % 3 = 0")
on("compiled_volumes", "orders", lambda o: writes.compiled(o.where("o_custkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("title_base"), F.col("o_orderkey").alias("first"), F.concat(F.lit("H"), F.col("o_orderkey").cast("string"), F.lit("\n")).alias("header"), F.col("o_orderpriority").alias("body"), F.concat(F.lit("\nF"), F.col("o_orderkey").cast("string")).alias("footer"))), "select cast(o_custkey as varchar) as title_base, 'H' || cast(min(o_orderkey) as varchar) || chr(10) || string_agg(o_orderpriority, chr(10) || chr(10) order by o_orderkey) || chr(10) || 'F' || cast(max(o_orderkey) as varchar) as text from orders where o_custkey % 3 = 0 group by 1")
on("gazetteer_load", "customer", lambda c: writes.gazetteer(c.select(F.lower("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "surname").otherwise("place").alias("kind")).distinct(), c.where("c_custkey % 5 = 0").select(F.concat("c_name", F.lit(" B")).alias("name"), F.lit("surname").alias("kind"))), "select distinct lower(c_name) as name, 'place' as kind from customer where c_custkey % 2 <> 0 union all select distinct lower(c_name || ' B'), 'surname' from customer where c_custkey % 5 = 0")
