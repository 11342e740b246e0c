import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators.fuzzy import candidates, gram_index, search
from lexmill.operators.lexicon import window_similarity


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdeo") for _ in range(r.choice([1, 2, 4, 6]))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 10, 40])))) for i in range(100)]
    return spark.createDataFrame(rows + [(900, None), (901, ""), (902, "…! "), (903, "ab " * 2000)], "id long, text string")


@pytest.mark.parametrize("least", [0.0, 0.3, 0.6])
def test_same_as_comparing_all(spark, texts, least):
    """Every row whose id is divisible by 20 asks with its first words, a misspelt and an unknown one."""
    asked = texts.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.concat(F.substring_index("text", " ", 3), F.lit("x")).alias("asked"))
    asked = asked.unionByName(spark.createDataFrame([(2000, None), (2001, ""), (2002, "zzz qqq"), (2003, "ab")], "query_id long, asked string"))
    every = asked.join(texts, F.lit(True)).select("query_id", "id", F.round(window_similarity(F.col("asked"), F.col("text")), 6).alias("similarity")).where(F.col("similarity") > least)
    index = gram_index(texts)
    got = {tuple(r) for r in search(index, asked, least).collect()}
    assert got == {tuple(r) for r in every.collect()} and got
    if least == 0.6:
        assert candidates(index, asked, least).count() < 0.5 * asked.count() * texts.count()


def test_nothing_to_search(spark, texts):
    index = gram_index(texts.limit(0))
    assert search(index, spark.createDataFrame([(1, "ab")], "query_id long, asked string")).count() == 0
    with pytest.raises(ValueError):
        search(index, texts.select(F.col("id").alias("query_id"), F.col("text").alias("asked")), 1.0)
