"""Practice records: session scores, accuracy, streaks, schedules and personal difficulty.

An answer table has user_id, session, question, word_id, kind, correct (boolean), answered_at and floor
(the chance of guessing right). Questions with several answers first become one number each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def session_scores(answers: DataFrame) -> DataFrame:
    """(session, questions, score_pct): a question's credit is the share of its answers that are right."""
    each = answers.groupBy("session", "question").agg(F.avg(F.col("correct").cast("int")).alias("credit"))
    return each.groupBy("session").agg(F.count("*").alias("questions"), F.round(100 * F.sum(F.coalesce(F.col("credit"), F.lit(0.0))) / F.count("*"), 1).alias("score_pct"))


def accuracy(answers: DataFrame, by: str) -> DataFrame:
    n, right = F.count("*"), F.count(F.when(F.col("correct"), 1))
    return answers.groupBy(by).agg(right.alias("correct"), n.alias("total"), F.round(100 * right / n, 1).alias("accuracy_pct"))


def accuracy_through(answers: DataFrame, link: DataFrame, by: str) -> DataFrame:
    """Accuracy of answers by a many-to-many attribute of their words (each answer counts under each value)."""
    return accuracy(answers.join(link, "word_id"), by)


def struggling(answers: DataFrame, least: int = 2) -> DataFrame:
    """(user_id, word_id, exposures, miss_rate) of words met at least ``least`` times and missed once or more."""
    out = answers.groupBy("user_id", "word_id").agg(F.count("*").alias("exposures"), F.round(F.avg(1 - F.col("correct").cast("int")), 6).alias("miss_rate"))
    return out.where((F.col("exposures") >= least) & (F.col("miss_rate") > 0))


def first_exposure(answers: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id", "word_id").orderBy("answered_at", "question"))
    return answers.withColumn("__n", nth).where("__n = 1").drop("__n")


def practice_streaks(answers: DataFrame) -> DataFrame:
    """(user_id, first_day, last_day, days): runs of consecutive days with practice."""
    days = answers.select("user_id", F.to_date("answered_at").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return days.withColumn("island", island).groupBy("user_id", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("island")


def current_streak(answers: DataFrame, today: Column) -> DataFrame:
    """(user_id, days) of the run that touches today or yesterday, else 0."""
    runs = practice_streaks(answers)
    live = F.when(F.col("last_day") >= F.date_sub(today, 1), F.col("days"))
    return runs.groupBy("user_id").agg(F.coalesce(F.max(live), F.lit(0)).alias("days"))


def personal_difficulty(first: DataFrame, words: DataFrame) -> DataFrame:
    """(user_id, word_id, personal_difficulty): one Rasch step from the word's difficulty at the first exposure."""
    d = first.join(words.select(F.col("id").alias("word_id"), "difficulty").where("difficulty is not null"), "word_id")
    b = (F.col("difficulty") - 50) / 16
    chance = F.col("floor") + (1 - F.col("floor")) / (1 + F.exp(b))
    moved = b - (F.col("correct").cast("int") - chance)
    return d.select("user_id", "word_id", F.round(F.least(F.greatest(50 + 16 * moved, F.lit(0.0)), F.lit(100.0)), 6).alias("personal_difficulty"))


def review_schedule(answers: DataFrame, factor: float = 1.0) -> DataFrame:
    """(user_id, word_id, streak, correct, wrong, next_at): the answers of a word folded in time order.

    A right answer doubles the wait from one day up to 30, times ``factor``; a wrong one sets it to eight
    hours, times ``factor``. What counts of the past is the number of right answers since the last wrong
    one, so the fold is two window aggregates and no list of answers is built.
    """
    w = Window.partitionBy("user_id", "word_id")
    rank = F.row_number().over(w.orderBy("answered_at", "question"))
    rows = answers.withColumn("nth", rank)
    wrong_at = F.coalesce(F.max(F.when(~F.col("correct"), F.col("nth"))), F.lit(0))
    out = rows.groupBy("user_id", "word_id").agg(
        (F.max("nth") - wrong_at).cast("int").alias("streak"), F.count(F.when(F.col("correct"), 1)).alias("correct"), F.count(F.when(~F.col("correct"), 1)).alias("wrong"), F.max("answered_at").alias("last_at"),
    )
    hours = F.when(F.col("streak") > 0, F.least(F.pow(F.lit(2.0), F.col("streak")), F.lit(30.0)) * 24).otherwise(8.0) * factor
    seconds = F.round(hours * 3600).cast("long")
    return out.select("user_id", "word_id", "streak", "correct", "wrong", (F.unix_timestamp(F.col("last_at").cast("timestamp")) + seconds).alias("next_at"))


def word_sets(answers: DataFrame) -> DataFrame:
    """(user_id, words, mastered, flashcards) of the set of words a user has met; a word once answered rightly is mastered."""
    items = answers.groupBy("user_id", "word_id").agg(F.bool_or("correct").alias("mastered"))
    return items.groupBy("user_id").agg(F.count("*").alias("words"), F.count(F.when(F.col("mastered"), 1)).alias("mastered"), F.count(F.when(~F.col("mastered"), 1)).alias("flashcards"))


def answered(answers: DataFrame, each: int) -> DataFrame:
    """(session, expected, answered, complete): ``each`` answers are expected of every word of a session."""
    out = answers.groupBy("session").agg((each * F.countDistinct("word_id")).alias("expected"), F.count("*").alias("answered"))
    return out.withColumn("complete", F.col("answered") >= F.col("expected"))


def history(answers: DataFrame) -> DataFrame:
    """(user_id, word_id, question, nth, correct, right_so_far): each word's answers in order."""
    w = Window.partitionBy("user_id", "word_id").orderBy("answered_at", "question")
    right = F.sum(F.col("correct").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return answers.select("user_id", "word_id", "question", F.row_number().over(w).alias("nth"), "correct", right.alias("right_so_far"))
