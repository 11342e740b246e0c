"""Named queries over roots, senses, pronunciations and composed jobs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .catalog import BOOKS, add, star
from .catalog_more import JUDGED, T3, common, judged, on, read
from .catalog_quiz import of_picked, tree
from .operators import dictionary, embed, entries, facets, fuzzy, ingest, lexicon, relate, writes

HEAD = " union all ".join(f"select lemma, substr(lemma, {len(h) + 1}) as root from w where starts_with(lemma, '{h}')" for h in lexicon.HEADS)
TAIL = " union all ".join(f"select lemma, left(lemma, length(lemma) - {len(t)}) || e as root from w, (values (''), ('e')) as x(e) where ends_with(lemma, '{t}')" for t in lexicon.TAILS)
on("morphological_roots", "documents", lambda d: lexicon.roots(common(d), common(d)), f"{T3}, w as (select lemma, zipf from z where n >= 5), t as (select distinct * from ({HEAD} union all {TAIL}) where length(root) >= 3), r as (select t.lemma, t.root, w.zipf as root_zipf, row_number() over (partition by t.lemma order by w.zipf desc, length(t.root), t.root) as n from t join w on w.lemma = t.root) select lemma, root, root_zipf from r where n = 1")
on("dictionary_senses", "lineitem", lambda t: lexicon.senses(t.select(F.col("l_partkey").cast("string").alias("lemma")), t.select(F.col("l_partkey").cast("string").alias("term"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("nth"), F.col("l_returnflag").alias("definition"))), "select cast(l_partkey as varchar) as lemma, string_agg(l_returnflag, ' | ' order by l_orderkey * 10 + l_linenumber, l_returnflag) as senses from lineitem group by 1")
on("agreed_pronunciations", "part", lambda p: lexicon.pronunciations(p.select("p_name", F.when(F.col("p_size") % 7 == 0, "").when(F.col("p_size") % 2 == 0, F.concat(F.lit("a(b"), F.left("p_brand", F.lit(6)))).otherwise(F.concat(F.lit("a(b"), F.left("p_brand", F.lit(6)), F.lit(")"))).alias("ipa")).withColumnRenamed("p_name", "headword")), "with r as (select lower(p_name) as headword, 'a(b' || left(p_brand, 6) || ')' as ipa from part where p_size % 7 <> 0) select headword, cast(count(distinct ipa) as int) as n, case when count(distinct ipa) = 1 then min(ipa) end as ipa from r group by 1")
on("normal_ipa", "part", lambda p: p.select("p_partkey", lexicon.normal_ipa(F.concat(F.lit("/ə"), "p_brand", F.lit(".(r)t/"))).alias("ipa")), "select p_partkey, 'ə' || replace(replace(replace(p_brand, '.', ''), ' ', ''), '/', '') || 't' as ipa from part")
on("definition_texts", "part", lambda p: p.select("p_partkey", lexicon.definition_text(F.when(F.col("p_size") % 3 == 0, F.col("p_name")), F.when(F.col("p_size") % 3 == 1, F.array("p_brand", "p_type")), F.when(F.col("p_size") % 4 != 0, F.lit(" A sentence "))).alias("t")).select("p_partkey", "t.text", "t.source"), "select p_partkey, case p_size % 3 when 0 then p_name when 1 then p_brand || ', ' || p_type else case when p_size % 4 <> 0 then 'A sentence' end end as text, case p_size % 3 when 0 then 'definition' when 1 then 'synonyms' else case when p_size % 4 <> 0 then 'sentence' end end as source from part")
on("plain_markup", "part", lambda p: p.select("p_partkey", lexicon.plain_markup(F.concat(F.lit("{bc}{it}"), "p_name", F.lit("{/it}  of {sx|"), "p_type", F.lit("||} {a_link|x}"))).alias("text")), "select p_partkey, ': ' || p_name || ' of ' || p_type || ' x' as text from part")
KNOWN = ("Fiction", "Nonfiction", "Novel", "History", "Poetry")
RAW = (("fiction", "novel", "x"), ("Nonfiction ", "poetry", "POETRY"), ("history", "nonfiction", "fiction"), ("none", "", "y"))
on("checked_genres", "part", lambda p: p.select("p_partkey", F.array_join(lexicon.genres(F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in RAW]), (F.col("p_partkey") % 4 + 1).cast("int")), KNOWN), "|").alias("genres")), "select p_partkey, list_value('Novel', 'Nonfiction|Poetry', 'History|Fiction', '')[p_partkey % 4 + 1] as genres from part")
on("record_subjects", "part", lambda p: p.select("p_partkey", F.array_join(lexicon.subjects(F.concat(F.lit("<rdf:value>PS</rdf:value><rdf:value>"), "p_name", F.lit("</rdf:value> <rdf:value>"), "p_type", F.lit("</rdf:value><rdf:value>"), "p_name", F.lit("</rdf:value>"))), "|").alias("subjects")), "select p_partkey, p_name || '|' || p_type as subjects from part")
on("field_prior", "part", lambda p: lexicon.prior(p.select(F.col("p_name").alias("lemma")), p.select(F.col("p_name").alias("lemma"), F.col("p_brand").alias("domain")), p.select(F.col("p_brand").alias("domain"), F.left("p_type", F.lit(1)).alias("field"))), "with d as (select distinct p_name as lemma, p_brand as domain from part), f as (select distinct p_brand as domain, left(p_type, 1) as field from part) select lemma, field, count(*) as n from d join f using (domain) group by 1, 2")
on("possessive_repair", "part", lambda p: lexicon.without_possessives(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("'s"))).otherwise(F.col("p_name")).alias("lemma"))), "select p_partkey as id, p_name || '''s' as lemma, lower(p_name) as root from part where p_partkey % 3 = 0 and lower(p_name) in (select lower(p_name) from part where p_partkey % 3 <> 0)")
on("adverb_roots", "part", lambda p: p.select("p_partkey", lexicon.adjective_of(F.element_at(F.array(*map(F.lit, ("happily", "gently", "basically", "quickly", "family"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.array(*map(F.lit, ("happy", "gentle", "basic", "quick")))).alias("root")), "select p_partkey, list_value('happy', 'gentle', 'basic', 'quick', null)[p_partkey % 5 + 1] as root from part")
on("text_chunks", "documents", lambda d: d.select("doc_id", F.posexplode(lexicon.paragraphs(F.col("text"))).alias("nth", "chunk")).select("doc_id", "nth", F.length("chunk").alias("n_chars")))
on("definition_search", "conversations", lambda c: c.select("conv_id", "turn", F.round(lexicon.window_similarity(F.lit("another question"), F.col("text")), 6).alias("similarity")).where("similarity > 0.3"))


def definition_search_all(c: DataFrame) -> DataFrame:
    """Every twentieth turn asks with its first three words; all turns are searched by the index."""
    rows = c.where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.substring_index("text", " ", 3).alias("asked"))
    return fuzzy.search(fuzzy.gram_index(rows), asked, 0.5)


on("definition_search_all", "conversations", definition_search_all)

# --- vectors trained on the documents
COUNTED = """with w as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda x: length(x) >= 3) as w from documents
), t as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from w
), common as (select word from t group by 1 having count(*) >= 5
), p as (select least(a.word, b.word) as a, greatest(a.word, b.word) as b, k, count(*) as n from t a, (values (1), (2), (3), (4)) as ks(k), t b where b.doc_id = a.doc_id and b.i = a.i + k and a.word in (from common) and b.word in (from common) group by 1, 2, 3
), q as (select a, b, round(sum(n / k), 6) as n from p group by 1, 2
), pairs as (select a as word, b as other, n from q union all select b, a, n from q where a <> b)"""
INFORMED = COUNTED + """, own as (select word, sum(n) as own from pairs group by 1), total as (select sum(pow(own, 0.75)) as context from own
), i as (select p.word, p.other, (greatest(ln(p.n / x.own / (pow(y.own, 0.75) / context)), 0.0) + greatest(ln(p.n / y.own / (pow(x.own, 0.75) / context)), 0.0)) / 2 as value from pairs p join own x on x.word = p.word join own y on y.word = p.other, total)"""
on("word_cooccurrences", "documents", embed.cooccurrences, f"{COUNTED} select * from pairs")
on("word_information", "documents", lambda d: embed.information(d).withColumn("value", F.round("value", 6)), f"{INFORMED} select word, other, round(value, 6) as value from i where value > 0")
on("trained_vectors", "documents", embed.trained_on)

# --- composed
star("books_page_with_total", lambda c: facets.page(facets.books(c), "mean_difficulty", "id", True, 2, 25).select("id", "mean_difficulty").join(F.broadcast(c.active_links.agg(F.countDistinct("book_id").alias("total")))), BOOKS + " select id, mean_difficulty, (select count(*) from books) as total from books order by mean_difficulty desc nulls last, id limit 25 offset 25")
on("relation_edges", "part", lambda p: relate.closure(tree(p).where("child > 0"), "child", "parent").select("node", "ancestor", F.when(F.col("depth") == 1, "direct").otherwise("fanout").alias("kind")), "with recursive up(node, ancestor, depth) as (select p_partkey, p_partkey // 3, 1 from part where p_partkey > 0 union all select node, ancestor // 3, depth + 1 from up where ancestor > 0) select node, ancestor, case when depth = 1 then 'direct' else 'fanout' end as kind from up")
of_picked("session_questions", lambda d: d.groupBy("target").agg(F.count("*").alias("n")).select("target", F.when(F.col("n") < 3, "true_false").when(F.substring(F.md5(F.col("target").cast("string")), 1, 1) < "8", "choice").otherwise("matching").alias("kind")), " select target, case when count(*) < 3 then 'true_false' when left(md5(cast(target as varchar)), 1) < '8' then 'choice' else 'matching' end as kind from picked group by 1")
on("published_facts", "orders", lambda o: writes.published(o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate")).alias("year"), F.lit(None).cast("string").alias("era")), o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit(1900).alias("year"), F.lit("late 19th century").alias("era"))), "select o_orderkey as id, coalesce(case when o_orderkey % 2 = 0 then cast(year(o_orderdate) as int) end, case when o_orderkey % 3 = 0 then 1900 end) as year, case when o_orderkey % 3 = 0 then 'late 19th century' end as era from orders")
on("only_missing", "orders", lambda o: writes.invalidated(o.select("o_custkey").distinct(), o.where("o_orderstatus = 'F'"), "o_custkey"), "select distinct o_custkey from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")


def ingested(d: DataFrame) -> DataFrame:
    """The whole way from texts to a vocabulary: candidates, floor, names, what earlier documents decided, sense and first place."""
    j = judged(d)
    known = ingest.known_verdicts(j.where("verdict = 'drop'"), j.where("verdict = 'keep'").select("lemma").distinct())
    kept = j.join(known.where("verdict = 'keep'").select("lemma"), "lemma", "left_semi").groupBy("lemma").agg(F.countDistinct("doc_id").alias("books"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_doc"))
    return kept.join(lexicon.roots(common(d), common(d)).select("lemma", "root"), "lemma", "left")


on("ingest_end_to_end", "documents", ingested, f"{T3}{JUDGED}, w as (select lemma, zipf from z where n >= 5), t as (select distinct * from ({HEAD} union all {TAIL}) where length(root) >= 3), r as (select t.lemma, t.root, row_number() over (partition by t.lemma order by w.zipf desc, length(t.root), t.root) as n from t join w on w.lemma = t.root), k as (select distinct lemma from v where reason is null), x as (select lemma, count(distinct doc_id) as books, cast(sum(n_tokens) as bigint) as n_tokens, min(doc_id) as first_doc from v where lemma in (select lemma from k) group by 1) select x.*, r.root from x left join r on r.lemma = x.lemma and r.n = 1")


def cluster_tree(c) -> DataFrame:
    books = c.books.join(c.author_links.select("author").distinct(), "author", "left_semi").groupBy("author").count()
    return relate.cluster_tree(c.author_links, "author", "word_id", books.orderBy(F.desc("count"), "author").limit(200).select(F.col("author").alias("node")))


star("cluster_tree", cluster_tree)

# --- dictionary volumes: entries made of a part's columns
def entry_listing(spark, sf_dir: str) -> DataFrame:
    """The second page of the unchecked entries of a volume whose headword holds ``ring`` or the like; definitions are the lines of a part."""
    p, t, key = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem"), F.col("p_partkey")
    rows = p.select(
        key.alias("id"), F.concat_ws(" ", "p_name", key.cast("string")).alias("headword"), (F.col("p_size") % 3).cast("int").alias("volume_id"), (key * 7 % 100).alias("page_number"), key.alias("created_at"),
        (F.col("p_size") % 2 == 0).alias("needs_review"), F.when(key % 5 == 0, "accepted").when(key % 5 == 1, "unique").alias("match"), (key % 7 != 0).alias("lemma"))
    senses = t.select(F.col("l_partkey").alias("entry_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("nth"), F.concat_ws(" ", "l_returnflag", F.col("l_suppkey").cast("string")).alias("text"))
    return entries.entry_page(rows, senses, entries.EntryFilter("r_", 1, match=entries.UNCHECKED), "page_number", True, 2, 20)


add("dictionary_entry_page", entry_listing, """with e as (select p_partkey as id, p_name || ' ' || cast(p_partkey as varchar) as headword, cast(p_size % 3 as int) as volume_id, p_partkey * 7 % 100 as page_number, p_partkey as created_at, p_size % 2 = 0 as needs_review,
  case p_partkey % 5 when 0 then 'accepted' when 1 then 'unique' end as match, p_partkey % 7 <> 0 as lemma from part
), f as (select * from e where lower(headword) like '%r_%' and volume_id = 1 and lemma and match is null
), d as (select l_partkey as id, arg_min(l_returnflag || ' ' || cast(l_suppkey as varchar), (l_orderkey * 10 + l_linenumber, l_returnflag || ' ' || cast(l_suppkey as varchar))) as first_definition from lineitem group by 1)
select f.*, d.first_definition, (select count(*) from f) as total from f left join d on d.id = f.id order by page_number desc, f.id limit 20 offset 20""")
RAW_ENTRY = lambda: F.concat("p_name", F.lit(" (x'y), n. and adj. [from "), "p_brand", F.lit("] Lead of it. 1. A thing of "), "p_type", F.lit(". 1601 Smith Jr. of old. c1702 a line "), F.lit("2. Another one."))
volume = lambda p: dictionary.relations(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("headword"), RAW_ENTRY().alias("raw")))
on("dictionary_entries", "part", lambda p: volume(p)[0], "select p_partkey as id, 'n adj' as pos, 'from ' || p_brand as etymology from part")
on("dictionary_sense_rows", "part", lambda p: volume(p)[1], "select p_partkey as id, n as nth, label, text from (select p_partkey, 0 as n, null as label, 'Lead of it.' as text from part union all select p_partkey, 1, '1', 'A thing of ' || p_type || '. 1601 Smith Jr. of old. c1702 a line' from part union all select p_partkey, 2, '2', 'Another one.' from part)")
on("dictionary_quotations", "part", lambda p: volume(p)[2], "select p_partkey as id, 1 as nth, n, year, approx, author, text from part, (values (0, 1601, false, 'Smith Jr.', 'of old.'), (1, 1702, true, null, 'a line')) as q(n, year, approx, author, text)")
cycle = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
sql_cycle = lambda values: "list_value(" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f")[p_partkey % {len(values)} + 1]"
ARPA, ARPA_IPA = ("R EY1 K ER0", "IH0 K S T R AH1", "XX", "B UH2 K K EY1 S", ""), ("ˈɹeɪkɝ", "ɪˈkstɹʌ", None, "ˌbʊˈkkeɪs", None)
SPELLED, SPELLED_IPA = ("kŏn-kăv′ĭ-tē", "pyo͞o", "bŏg", "q", "kăt, dŏg"), ("kɒnˈkævɪtiː", None, "bɒɡ", None, "kæt")
on("arpabet_ipa", "part", lambda p: p.select("p_partkey", dictionary.arpabet_ipa(cycle(ARPA, F.col("p_partkey"))).alias("ipa")), f"select p_partkey, {sql_cycle(ARPA_IPA)} as ipa from part")
on("respelling_ipa", "part", lambda p: p.select("p_partkey", dictionary.respelling_ipa(cycle(SPELLED, F.col("p_partkey"))).alias("ipa")), f"select p_partkey, {sql_cycle(SPELLED_IPA)} as ipa from part")
READ = (("ˈkæt", "ˈkæt", None), ("(ˈkæt)", "ˈkæt ", "cat (k'aet)"), ("ˈkæt", "ˈkɒt", None), ("əˈbaʊt", "əˈbaʊt", "x (a'baut)"), (None, "x", None))
on("agreed_reading", "part", lambda p: p.select("p_partkey", dictionary.agreed_reading(*[cycle([r[i] for r in READ], F.col("p_partkey")) for i in range(3)]).alias("r")).select("p_partkey", "r.ipa", "r.needs_review"), f"select p_partkey, {sql_cycle(('ˈkæt', None, None, 'əˈbaʊt', None))} as ipa, p_partkey % 5 in (1, 2, 4) as needs_review from part")
REPLIES = ('```json\n[{"w": "Cat", "k": false}, {"w": "dog"}]\n```', 'Sure: {"words": [{"word": "x", "keep": true}]} and more]', "no json", '[{"w": "a", "k": true}] ]')
on("model_verdicts", "part", lambda p: p.select("p_partkey", F.explode(dictionary.verdicts(cycle(REPLIES, F.col("p_partkey")))).alias("v")).select("p_partkey", "v.word", "v.keep"), "select p_partkey, word, keep from part, (values (0, 'cat', false), (0, 'dog', true), (1, 'x', true), (3, 'a', true)) as v(m, word, keep) where p_partkey % 4 = m")
on("preferred_pronunciation", "lineitem", lambda t: dictionary.preferred(t.select(F.col("l_orderkey").alias("word"), F.col("l_linenumber").alias("nth"), F.when(F.col("l_linestatus") == "O", F.col("l_partkey").cast("string")).alias("ipa"), F.array(F.when(F.col("l_returnflag") == "R", "US").otherwise("UK")).alias("tags"))), "select l_orderkey as word, arg_min(cast(l_partkey as varchar), (case when l_returnflag = 'R' then 0 else 1 end, l_linenumber, cast(l_partkey as varchar))) as ipa from lineitem where l_linestatus = 'O' group by 1")
on("hashed_vectors", "conversations", lambda c: dictionary.hashed_vectors(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")), "with w as (select conv_id * 1000 + turn as id, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')) as w from conversations), n as (select id, cast(cast('0x' || left(md5(w), 6) as bigint) % 64 as int) as place, count(*) as n from w where w <> '' group by 1, 2), m as (select id, sqrt(cast(sum(n * n) as double)) as norm from n group by 1) select n.id, place, round(n / norm, 6) as value from n join m on m.id = n.id")
