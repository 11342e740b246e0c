"""The vocabulary corpus as DataFrames, and its mapping onto the star tables.

word <- part, book <- orders (author from customer), link <- distinct (part, order) of lineitem; codes,
genres, fame and publication facts are derived from columns of the same tables. ``SQL`` states the same
relations for DuckDB; queries put their own select after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The 21 top-level field letters and the six buckets they fall into.
LETTERS = "ABCEFGHIKLMNOPQSTWXYZ"
BUCKETS = {
    "mind_language": "APQX", "people_society": "BSGZ", "emotion_leisure": "EK",
    "nature_science": "FLWY", "making_materials": "CHO", "time_space_commerce": "MNTI",
}
PLACEHOLDERS = ("Various", "Unknown Author", "Unknown", "Anonymous")


@dataclass(frozen=True)
class Corpus:
    """Relations of the data model; ``words`` holds active rows only, ``all_words`` every row."""

    all_words: DataFrame
    books: DataFrame
    links: DataFrame
    codes: DataFrame
    genres: DataFrame
    fame: DataFrame
    shelves: DataFrame | None = None  # (shelf, word_id): a coarser grouping than books, a supplier's parts
    vectors: DataFrame | None = None  # (id, vector): meanings of some words

    @property
    def words(self) -> DataFrame:
        return self.all_words.where("active")

    @property
    def active_links(self) -> DataFrame:
        return self.links.join(self.words.select(F.col("id").alias("word_id")), "word_id", "left_semi")

    @property
    def author_links(self) -> DataFrame:
        """(author, word_id) of authors that are known by name, once each."""
        named = self.books.where(F.col("author").isNotNull() & ~F.col("author").isin(*PLACEHOLDERS))
        return self.active_links.join(named.select(F.col("id").alias("book_id"), "author"), "book_id").select("author", "word_id").distinct()


def load(spark: SparkSession, sf_dir: str, least_quantity: float = 0.0) -> Corpus:
    """The corpus of the tables in ``sf_dir``; lines of a smaller quantity than ``least_quantity`` make no link."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part, orders, customer, lineitem = read("part"), read("orders"), read("customer"), read("lineitem")
    key, size = F.col("p_partkey"), F.col("p_size")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    words = part.select(
        key.alias("id"), F.concat_ws(" ", "p_name", key.cast("string")).alias("lemma"), F.col("p_type").alias("part_of_speech"), (size != 7).alias("active"),
        F.when(size % 10 != 0, (cents * 7919 + key * 104729) % 10001 / F.lit(100.0)).alias("difficulty"),
        F.element_at(F.array(*map(F.lit, ("current", "archaic", "dated", "obsolete", "current"))), (size % 5 + 1).cast("int")).alias("archaic"),
        (size % 3 != 0).alias("quizzable"),
    )
    order = F.col("o_orderkey")
    author = F.when(F.col("o_custkey") % 50 == 0, None).when(F.col("o_custkey") % 50 == 1, "Unknown").otherwise(F.col("c_name"))
    article = F.element_at(F.array(*map(F.lit, ("The ", "A ", "", "An "))), (order % 4 + 1).cast("int"))
    joined = orders.join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    books = joined.select(
        order.alias("id"), F.concat(article, F.lit("Order "), order.cast("string")).alias("title"), author.alias("author"),
        F.to_date("o_orderdate").alias("created_on"), (order % 320 + 1700).cast("int").alias("publication_year"),
        F.when(order % 17 == 0, 0).otherwise(order % 30 + 20).cast("long").alias("distinct_words"), (order * 37 % 90000).alias("token_count"),
    )
    links = lineitem.where(F.col("l_quantity") >= least_quantity).select(F.col("l_partkey").alias("word_id"), F.col("l_orderkey").alias("book_id")).distinct()
    letter = lambda n: F.substring(F.lit(LETTERS), (n % 21 + 1).cast("int"), F.lit(1))
    one = F.concat(letter(key), (key % 12 + 1).cast("string"), F.lit("."), (size % 4).cast("string"))
    two = F.concat(letter(F.floor(key / 7)), (key % 3 + 1).cast("string"))
    codes = part.select(key.alias("word_id"), F.explode(F.array_distinct(F.filter(F.array(F.when(key % 11 != 0, one), F.when(key % 2 == 0, two)), lambda c: c.isNotNull()))).alias("code"))
    genres = orders.select(order.alias("book_id"), F.explode(F.array("o_orderpriority", F.concat(F.lit("status "), F.col("o_orderstatus")))).alias("genre"))
    fame = orders.where("o_orderstatus = 'F'").select(order.alias("book_id"), (F.floor("o_totalprice") % 10 + 1).cast("int").alias("fame_score"))
    shelves = lineitem.select(F.col("l_suppkey").alias("shelf"), F.col("l_partkey").alias("word_id")).distinct()
    vectors = read("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return Corpus(words, books, links, codes, genres, fame, shelves, vectors)


SQL = f"""
with all_word as (
  select p_partkey as id, p_name || ' ' || cast(p_partkey as varchar) as lemma, p_type as part_of_speech, p_size <> 7 as active,
    case when p_size % 10 <> 0 then ((cast(round(p_retailprice * 100) as bigint) * 7919 + p_partkey * 104729) % 10001) / 100.0 end as difficulty,
    list_value('current', 'archaic', 'dated', 'obsolete', 'current')[p_size % 5 + 1] as archaic, p_size % 3 <> 0 as quizzable
  from part
), word as (select * from all_word where active
), book as (
  select o_orderkey as id, list_value('The ', 'A ', '', 'An ')[o_orderkey % 4 + 1] || 'Order ' || cast(o_orderkey as varchar) as title,
    case when o_custkey % 50 = 0 then null when o_custkey % 50 = 1 then 'Unknown' else c_name end as author, cast(o_orderdate as date) as created_on,
    cast(o_orderkey % 320 + 1700 as int) as publication_year, cast(case when o_orderkey % 17 = 0 then 0 else o_orderkey % 30 + 20 end as bigint) as distinct_words,
    o_orderkey * 37 % 90000 as token_count
  from orders left join customer on o_custkey = c_custkey
), link as (select distinct l_partkey as word_id, l_orderkey as book_id from lineitem
), active_link as (select l.* from link l join word w on w.id = l.word_id
), code as (
  select distinct word_id, code from (
    select p_partkey as word_id, substr('{LETTERS}', cast(p_partkey % 21 + 1 as int), 1) || cast(p_partkey % 12 + 1 as varchar) || '.' || cast(p_size % 4 as varchar) as code from part where p_partkey % 11 <> 0
    union all select p_partkey, substr('{LETTERS}', cast((p_partkey // 7) % 21 + 1 as int), 1) || cast(p_partkey % 3 + 1 as varchar) from part where p_partkey % 2 = 0)
), genre as (select o_orderkey as book_id, o_orderpriority as genre from orders union all select o_orderkey, 'status ' || o_orderstatus from orders
), fame as (select o_orderkey as book_id, cast(cast(floor(o_totalprice) as bigint) % 10 + 1 as int) as fame_score from orders where o_orderstatus = 'F'
), author_link as (
  select distinct b.author, l.word_id from active_link l join book b on b.id = l.book_id where b.author is not null and b.author not in ('Various', 'Unknown Author', 'Unknown', 'Anonymous')
)"""
