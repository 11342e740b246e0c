"""Review schedules as keyed state: each answer changes the state of its user and word, and nothing else is read.

The state of a (user, word) holds its counts, the last wrong answer and the right ones since. So answers may come in any
order within the watermark, and the schedule is that of ``operators.progress.review_schedule`` over all answers so far. A
timer stands at the time of the next review; when the watermark passes it, the word is given out as due. The clock is that
of the events: with timers of the machine's clock a query that reads what waits and stops would never stop.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Reviews(StatefulProcessor):
    """Rows (user_id, word_id, kind, streak, correct, wrong, next_at, seen): ``schedule`` for each batch that touches a word, ``due`` when its time is over."""

    def __init__(self, factor: float = 1.0):
        self.factor = factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "correct long, wrong long, last_at long, wrong_at long, wrong_question long")
        self.since = handle.getListState("right_since", "at long, question long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        correct, wrong, last, wrong_at, wrong_question = self.counts.get() if self.counts.exists() else (0, 0, None, None, None)
        right = list(self.since.get()) if self.since.exists() else []
        for row in rows:
            at = row.at
            last = at if last is None else max(last, at)
            if row.correct:
                correct += 1
                right.append((at, row.question))
            else:
                wrong += 1
                if wrong_at is None or (at, row.question) > (wrong_at, wrong_question):
                    wrong_at, wrong_question = at, row.question
        if wrong_at is not None:
            right = [(a, q) for a, q in right if (a, q) > (wrong_at, wrong_question)]
        self.counts.update((correct, wrong, last, wrong_at, wrong_question))
        if right:
            self.since.put([tuple(r) for r in right])
        elif self.since.exists():
            self.since.clear()
        streak = len(right)
        hours = (min(2.0 ** min(streak, 6), 30.0) * 24 if streak else 8.0) * self.factor
        due = last // 1_000_000 + round(hours * 3600)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due * 1000)
        yield Row(user_id=key[0], word_id=key[1], kind="schedule", streak=streak, correct=correct, wrong=wrong, next_at=due, seen=correct + wrong)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        correct, wrong, *_ = self.counts.get()
        streak = len(list(self.since.get())) if self.since.exists() else 0
        yield Row(user_id=key[0], word_id=key[1], kind="due", streak=streak, correct=correct, wrong=wrong, next_at=expiredTimerInfo.getExpiryTimeInMs() // 1000, seen=correct + wrong)

    def close(self) -> None:
        pass


OUT = "user_id {user}, word_id {word}, kind string, streak int, correct long, wrong long, next_at long, seen long"


def changes(answers: DataFrame, factor: float = 1.0, late: str = "7 days") -> DataFrame:
    """The changes of all schedules that the stream ``answers`` (user_id, word_id, question, correct, answered_at) makes.

    Rows without user, word or time are left out, and so are answers that come more than ``late`` after newer ones; a null
    ``correct`` counts as wrong, a null question as -1.
    """
    rows = answers.where("user_id is not null and word_id is not null and answered_at is not null").withColumn("answered_at", F.col("answered_at").cast("timestamp")).withWatermark("answered_at", late)
    rows = rows.select("user_id", "word_id", F.coalesce(F.col("question").cast("long"), F.lit(-1)).alias("question"), F.coalesce("correct", F.lit(False)).alias("correct"), F.unix_micros("answered_at").alias("at"), "answered_at")
    kinds = dict(rows.dtypes)
    return rows.groupBy("user_id", "word_id").transformWithState(
        statefulProcessor=Reviews(factor), outputStructType=OUT.format(user=kinds["user_id"], word=kinds["word_id"]), outputMode="Append", timeMode="EventTime")


def follow_reviews(answers: DataFrame, log: str, checkpoint: str, factor: float = 1.0, late: str = "7 days") -> StreamingQuery:
    """Write the changes of all waiting answers to Parquet files in ``log``, each once, and stop; the state stays in ``checkpoint``."""
    spark = answers.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return changes(answers, factor, late).writeStream.format("parquet").outputMode("append").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def schedule(spark: SparkSession, log: str) -> DataFrame:
    """(user_id, word_id, streak, correct, wrong, next_at): the last state of each word in the changes at ``log``."""
    rows = spark.read.parquet(log).where("kind = 'schedule'")
    last = rows.groupBy("user_id", "word_id").agg(F.max_by(F.struct("streak", "correct", "wrong", "next_at"), "seen").alias("s"))
    return last.select("user_id", "word_id", "s.*")


def due(spark: SparkSession, log: str) -> DataFrame:
    """(user_id, word_id, next_at) of words whose time is over and that were not answered since."""
    rows = spark.read.parquet(log).groupBy("user_id", "word_id").agg(F.max_by(F.struct("kind", "next_at"), F.struct("seen", (F.col("kind") == "due").alias("d"))).alias("s"))
    return rows.where("s.kind = 'due'").select("user_id", "word_id", "s.next_at")
