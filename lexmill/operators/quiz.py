"""Questions and grading, for whole tables of target words at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .listing import hashed

def choice_questions(picked: DataFrame, seed: int = 1, none_of_these: bool = False) -> DataFrame:
    """(target, options, correct, floor): a multiple-choice question for each target of ``picked``, its options in a hashed order.

    ``correct`` is the place of the right option from 0; ``floor`` the chance to guess it.
    """
    option = picked.select("target", "word").unionByName(picked.select("target", F.col("target").alias("word")).distinct())
    rows = option.groupBy("target").agg(F.sort_array(F.collect_list(F.struct(hashed(F.concat_ws("-", "target", "word"), seed).alias("h"), "word"))).alias("o"))
    ids = F.transform("o", lambda x: x["word"])
    n = F.size("o") + (1 if none_of_these else 0)
    return rows.select("target", F.array_join(ids, " ").alias("options"), (F.array_position(ids, F.col("target")) - 1).cast("int").alias("correct"), F.round(1 / n, 6).alias("floor"))


def truth_questions(picked: DataFrame, seed: int = 1) -> DataFrame:
    """(target, shown, is_true, floor): the target's own definition or that of its first distractor, by a hash of the target."""
    first = picked.where("place = 1")
    true = F.substring(hashed(F.col("target"), seed), 1, 1) < "8"
    return first.select("target", F.when(true, F.col("target")).otherwise(F.col("word")).alias("shown"), true.alias("is_true"), F.lit(0.5).alias("floor"))


def graded(answers: DataFrame) -> DataFrame:
    """(question, pairs, submitted, correct, finish_credit, review_credit) of matching answers (question, expected, response; null: not given).

    A question's credit is the share of right pairs: of those submitted when a session is finished, of all
    when it is reviewed.
    """
    right = F.count(F.when(F.col("response") == F.col("expected"), 1))
    given = F.count("response")
    out = answers.groupBy("question").agg(F.count("*").alias("pairs"), given.alias("submitted"), right.alias("correct"))
    return out.select("*", F.round(F.when(F.col("submitted") > 0, F.col("correct") / F.col("submitted")), 6).alias("finish_credit"), F.round(F.col("correct") / F.col("pairs"), 6).alias("review_credit"))


def stopping(rows: DataFrame, job: str, order: str, failed: Column, least: int = 20, most: float = 0.3) -> DataFrame:
    """(job, stop_at, rate): where each job's share of failures first passes ``most`` after ``least`` rows."""
    w = Window.partitionBy(job).orderBy(order)
    upto = rows.withColumn("__n", F.row_number().over(w)).withColumn("__rate", F.avg(failed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = upto.where((F.col("__n") >= least) & (F.col("__rate") > most))
    return over.groupBy(job).agg(F.min("__n").alias("stop_at"), F.round(F.min_by("__rate", "__n"), 6).alias("rate"))
