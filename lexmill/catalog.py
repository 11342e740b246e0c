"""Named queries over the star tables, each with the same result stated in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import facets
from .operators.facets import WordFilter
from .plans.star import BUCKETS, LETTERS, PLACEHOLDERS, SQL, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def star(name: str, query: Callable, oracle: str | None = None) -> None:
    """A query over the corpus; its SQL follows the relations of ``plans.star.SQL``."""
    add(name, lambda spark, sf_dir: query(load(spark, sf_dir)), f"{SQL}\n{oracle}" if oracle else None)


WORDS = """, counts as (select word_id, count(*) as n from link group by all)
select w.id, w.lemma, w.part_of_speech, round(w.difficulty, 6) as difficulty, w.archaic, w.quizzable, coalesce(c.n, 0) as book_count
from word w left join counts c on c.word_id = w.id where """

ENGLISH = "list_value('" + "','".join(f"{b}:{x}" for b, xs in BUCKETS.items() for x in xs) + "')"
BUCKET = f", letter_bucket as (select split_part(x, ':', 2) as letter, split_part(x, ':', 1) as bucket from (select unnest({ENGLISH}) as x)), word_bucket as (select distinct c.word_id, b.bucket from code c join letter_bucket b on b.letter = left(c.code, 1))"
STATS = """
  count(distinct w.id) as word_count, count(w.difficulty) as scored_word_count, round(cast(sum(cast(w.difficulty as decimal(18,4))) as double) / count(w.difficulty), 6) as mean_difficulty,
  round(stddev_samp(w.difficulty), 4) as stddev_difficulty"""
BOOKS = f""", alone as (select word_id, min(book_id) as book_id from active_link group by 1 having count(*) = 1
), uniq as (select book_id, count(*) as n from alone group by 1
), stats as (select l.book_id, {STATS} from active_link l join word w on w.id = l.word_id group by 1
), gl as (select book_id, array_to_string(list_sort(list(distinct genre)), '|') as genres from genre group by 1
), listed as (
  select b.id, b.title, b.author, s.word_count, s.scored_word_count, s.mean_difficulty, s.stddev_difficulty,
    case when b.distinct_words > 0 then round(s.word_count / b.distinct_words, 6) end as density, f.fame_score, coalesce(u.n, 0) as unique_word_count, g.genres
  from stats s join book b on b.id = s.book_id left join fame f on f.book_id = b.id left join uniq u on u.book_id = b.id left join gl g on g.book_id = b.id
), pm as (select id, percent_rank() over (order by mean_difficulty) as m from listed where mean_difficulty is not null
), pd as (select id, percent_rank() over (order by density) as d from listed where density is not null
), books as (
  select l.id, title, author, word_count, scored_word_count, mean_difficulty, stddev_difficulty, density, round(round(100 * (m + d) / 2, 6), 1) as overall_difficulty, fame_score, unique_word_count, genres
  from listed l left join pm on pm.id = l.id left join pd on pd.id = l.id
)"""
AUTHORS = f"""{BOOKS}, aalone as (select word_id, min(author) as author from author_link group by 1 having count(*) = 1
), auniq as (select author, count(*) as n from aalone group by 1
), astats as (select l.author, {STATS} from author_link l join word w on w.id = l.word_id group by 1
), dens as (select author, count(*) as book_count, (2 * cast(sum(cast(round(density * 1000000) as bigint)) as bigint) + count(density)) // nullif(2 * count(density), 0) / 1e6 as density from books where author is not null group by 1
), alisted as (select s.*, d.book_count, d.density, coalesce(u.n, 0) as unique_word_count from astats s join dens d on d.author = s.author left join auniq u on u.author = s.author
), apm as (select author, percent_rank() over (order by mean_difficulty) as m from alisted where mean_difficulty is not null
), apd as (select author, percent_rank() over (order by density) as d from alisted where density is not null
)"""


def labelled(labels: tuple[str, ...], rows: str) -> str:
    values = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    return f", labels(position, label) as (values {values}), rows_ as ({rows}) select l.position, l.label, count(r.label) as count from labels l left join rows_ r on r.label = l.label group by 1, 2"


def case_bucket(n: str) -> str:
    tops = zip(facets.BUCKET_LABELS, (0, 1, 2, 5, 10, 25, 50, 100))
    return "case " + " ".join(f"when {n} <= {top} then '{label}'" for label, top in tops) + " else '101+' end"


LINKED = "exists (select 1 from link l where l.word_id = w.id and {})"
star("book_listing", facets.books, f"{BOOKS} select * from books")
star("author_listing", facets.authors, f"{AUTHORS} select l.author, book_count, word_count, scored_word_count, mean_difficulty, stddev_difficulty, density, round(round(100 * (m + d) / 2, 6), 1) as overall_difficulty, unique_word_count from alisted l left join apm on apm.author = l.author left join apd on apd.author = l.author")
star("words_by_book", lambda c: facets.words(c, WordFilter(books=(7, 8, 9))), WORDS + LINKED.format("l.book_id in (7, 8, 9)"))
AUTHOR = "Customer#000000042"
BY = f"exists (select 1 from link l join book b on b.id = l.book_id where l.word_id = w.id and b.author = '{AUTHOR}')"
star("words_by_author", lambda c: facets.words(c, WordFilter(author=AUTHOR)), WORDS + BY)
star("words_exclusive_book", lambda c: facets.words(c, WordFilter(shelf=c.books.where("id % 20 <> 7"), exclusive=True)), WORDS + LINKED.format("l.book_id % 20 <> 7") + " and not " + LINKED.format("l.book_id % 20 = 7"))
SPARSE = SQL.replace("from lineitem\n", "from lineitem where l_quantity >= 49\n")
add("exclusive_words_all_authors", lambda spark, sf_dir: facets.exclusive_words(load(spark, sf_dir, 49)), f"{SPARSE} select word_id as id, min(b.author) as author from active_link l join book b on b.id = l.book_id group by 1 having count(distinct b.author) = 1 and count(*) = count(b.author)")


def exclusive_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that only the author with most such words has, where a line makes a link from a quantity of 49 on."""
    c = load(spark, sf_dir, 49)
    top = facets.exclusive_words(c).where(~F.col("author").isin(*PLACEHOLDERS)).groupBy("author").count().orderBy("count", "author", ascending=[False, True]).first()
    return facets.words(c, WordFilter(author=top.author if top else "", exclusive=True))


OWN = "select word_id, min(b.author) as author from active_link l join book b on b.id = l.book_id group by 1 having count(distinct b.author) = 1 and count(*) = count(b.author)"
add("words_exclusive_author", exclusive_author, f"{SPARSE}, own as ({OWN}), top as (select author from own where author not in ('Various', 'Unknown Author', 'Unknown', 'Anonymous') group by 1 order by count(*) desc, author limit 1)" + WORDS + "w.id in (select word_id from own join top using (author))")
star("words_uncategorised", lambda c: facets.words(c, WordFilter(uncategorised=True)), WORDS + "not exists (select 1 from code c where c.word_id = w.id)")
star("words_unscored", lambda c: facets.words(c, WordFilter(unscored=True)), WORDS + "w.difficulty is null")
CODE = "exists (select 1 from code c where c.word_id = w.id and {})"
star("words_domain_or", lambda c: facets.words(c, WordFilter(buckets=("emotion_leisure", "making_materials", "no such bucket"))), WORDS + CODE.format("left(c.code, 1) in ('E', 'K', 'C', 'H', 'O')"))
star("words_unknown_domain", lambda c: facets.words(c, WordFilter(buckets=("no such bucket",))), WORDS + "true")
star("words_code_subtree", lambda c: facets.words(c, WordFilter(codes=("A1", "B", "Z3"))), WORDS + CODE.format("(c.code = 'A1' or c.code like 'A1.%' or c.code like 'B%' or c.code = 'Z3' or c.code like 'Z3.%')"))
star("words_code_and", lambda c: facets.words(c, WordFilter(all_codes=("A", "E"), all_buckets=("mind_language",))), WORDS + CODE.format("c.code like 'A%'") + " and " + CODE.format("c.code like 'E%'") + " and " + CODE.format("left(c.code, 1) in ('A', 'P', 'Q', 'X')"))
star("words_genre_and", lambda c: facets.words(c, WordFilter(all_genres=("1-URGENT", "status P"))), WORDS + " and ".join(f"exists (select 1 from link l join genre g on g.book_id = l.book_id where l.word_id = w.id and g.genre = '{g}')" for g in ("1-URGENT", "status P")))
star("words_scored_range", lambda c: facets.words(c, WordFilter(difficulty=(20, 40), archaic=("archaic", "dated"), quizzable=True, part_of_speech=("ECONOMY", "STANDARD"))), WORDS + "w.difficulty >= 20 and w.difficulty <= 40 and w.archaic in ('archaic', 'dated') and w.quizzable and w.part_of_speech in ('ECONOMY', 'STANDARD')")
star("words_prefix", lambda c: facets.words(c, WordFilter(prefix="SM")), WORDS + "lower(w.lemma) like 'sm%'")
star("words_like", lambda c: facets.words(c, WordFilter(like="%r_ng%")), WORDS + "lower(w.lemma) like '%r_ng%'")
star("words_substring", lambda c: facets.words(c, WordFilter(contains="RING 1")), WORDS + "w.lemma ilike '%ring 1%'")
star("words_page", lambda c: facets.page(facets.words(c), "difficulty", "id", descending=True, number=3, size=25), WORDS + "true order by difficulty desc nulls last, w.id limit 25 offset 50")
star("unique_word_hist_book", facets.unique_word_histogram, BOOKS + labelled(facets.BUCKET_LABELS, f"select {case_bucket('coalesce(u.n, 0)')} as label from (select distinct book_id from active_link) b left join uniq u on u.book_id = b.book_id"))
star("unique_word_hist_author", lambda c: facets.unique_word_histogram(c, "author"), AUTHORS + labelled(facets.BUCKET_LABELS, f"select {case_bucket('coalesce(u.n, 0)')} as label from (select distinct author from author_link) b left join auniq u on u.author = b.author"))
star("fame_hist", facets.fame_histogram, labelled((*map(str, range(1, 11)), "unscored"), "select coalesce(cast(f.fame_score as varchar), 'unscored') as label from book b left join fame f on f.book_id = b.id"))
BANDS = tuple(f"{a}-{a + 20}" for a in range(0, 100, 20))
banded = lambda x: f"case when {x} is not null then cast(least(cast(floor({x} / 20) as int), 4) * 20 as varchar) || '-' || cast(least(cast(floor({x} / 20) as int), 4) * 20 + 20 as varchar) end"
star("difficulty_bands", facets.difficulty_bands, labelled((*BANDS, "Not yet scored"), f"select coalesce({banded('difficulty')}, 'Not yet scored') as label from word"))
star("overall_difficulty_hist", facets.overall_difficulty_histogram, BOOKS + labelled((*BANDS, "Not enough data"), f"select coalesce({banded('overall_difficulty')}, 'Not enough data') as label from books"))
star("domain_buckets", facets.domain_buckets, BUCKET + labelled(tuple(BUCKETS), "select bucket as label from word_bucket b join word w on w.id = b.word_id"))
DAYS = ", found as (select d as date, count(*) as n from days group by 1), span as (select unnest(generate_series((select min(date) from found), (select max(date) from found), interval 1 day))::date as date) select s.date, coalesce(f.n, 0) as count from span s left join found f on f.date = s.date"
star("growth_books", facets.growth, ", days as (select created_on as d from book)" + DAYS)
star("growth_authors", lambda c: facets.growth(c, "authors"), ", days as (select min(created_on) as d from book where author is not null group by author)" + DAYS)
star("growth_words", lambda c: facets.growth(c, "words"), ", days as (select min(b.created_on) as d from active_link l join book b on b.id = l.book_id group by l.word_id)" + DAYS)
star("category_counts", facets.category_counts, "select left(code, 1) as letter, count(distinct word_id) as words, count(distinct case when length(code) > 1 then code end) as children from code c join word w on w.id = c.word_id group by 1")
OVER = ", sizes as (select g, count(*) as n from p group by 1), cells as (select a.g as a, b.g as b, count(*) as s from p a join p b on a.m = b.m and a.g < b.g group by 1, 2) select a as code_a, b as code_b, s as shared_words, round(s / (x.n + y.n - s), 4) as ratio from cells join sizes x on x.g = a join sizes y on y.g = b"
star("category_overlap", facets.category_overlap, ", p as (select distinct word_id as m, left(code, 1) as g from code c join word w on w.id = c.word_id)" + OVER)
star("genre_overlap", facets.genre_overlap, ", p as (select distinct word_id as m, genre as g from active_link l join genre g on g.book_id = l.book_id)" + OVER)
star("category_leaders_lift", lambda c: facets.category_leaders(c, "A"), """, hit as (select distinct word_id from code where code like 'A%'
), n as (select l.book_id, count(*) as t, count(h.word_id) as k, round(count(h.word_id) / count(*), 6) as share from active_link l left join hit h on h.word_id = l.word_id group by 1 having count(*) >= 3
), mean as (select cast(sum(cast(share as decimal(18,6))) as double) / count(*) as mean from n)
select book_id as id, t as total_word_count, k as category_word_count, round(share, 4) as share, round(round(share / greatest(mean, 1e-9), 8), 3) as lift from n, mean""")
star("domain_vectors", facets.domain_vectors, """, n as (select book_id, letter, count(*) as n from active_link l join (select distinct word_id, left(code, 1) as letter from code) c on c.word_id = l.word_id group by 1, 2
), t as (select book_id, sum(n) as total from n group by 1 having sum(n) >= 3) select n.book_id, letter, round(n / total, 6) as fraction from n join t on t.book_id = n.book_id""")
star("domain_map_pca", facets.domain_map)
star("title_order", facets.title_order, "select id, regexp_replace(lower(title), '^(the|a|an)\\s+', '') as sort_key, left(regexp_replace(lower(title), '^(the|a|an)\\s+', ''), 1) as letter from book")
star("headline", facets.headline, "select (select count(*) from word) as words, (select count(difficulty) from word) as scored_words, (select count(distinct part_of_speech) from word) as parts_of_speech, (select count(*) from word where quizzable) as quizzable_words, (select count(*) from book) as books, (select count(distinct author) from book) as authors, (select cast(sum(token_count) as bigint) from book) as tokens")

__all__ = ["QUERIES", "ORACLES", "add", "star", "LETTERS"]
