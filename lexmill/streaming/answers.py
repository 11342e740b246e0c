"""Answers as a stream: upserts in micro-batches, review state per word, event-time counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.progress import review_schedule
from ..sources.sinks import read_table, replace_table


def read_files(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """Arriving Parquet files; the checkpoint of the query remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, kind, n) by event time; rows later than ``late`` are dropped."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")


def practice_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, n): answers of a user with pauses of at most ``gap``."""
    w = F.session_window("at", gap)
    return events.withWatermark("at", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def keep_schedule(answers: DataFrame, log: str, schedule: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch of answers to ``log`` and renew ``schedule`` for the words it touches.

    A batch is written under its number, so a batch that runs again replaces itself, and the schedule has
    versions, so a stop at any moment loses nothing. Read it with ``sources.sinks.read_table``.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        touched = batch.select("user_id", "word_id").distinct()
        fresh = review_schedule(spark.read.parquet(log).drop("batch").join(touched, ["user_id", "word_id"], "left_semi"))
        old = read_table(spark, schedule)
        old = fresh.limit(0) if old is None else old.join(touched, ["user_id", "word_id"], "left_anti")
        replace_table(old.unionByName(fresh), schedule)

    return answers.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
