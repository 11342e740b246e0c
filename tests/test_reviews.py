import datetime as dt
import random

from lexmill.operators.progress import review_schedule
from lexmill.streaming import answers as stream, reviews

ANSWER = "user_id long, word_id long, question long, correct boolean, answered_at timestamp"


def rows(n=240, seed=7):
    r = random.Random(seed)
    return [(r.randrange(5), r.randrange(6), i, r.random() < 0.7, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(90000))) for i in range(n)]


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    """Three batches of answers in no order, each by a query that ends; the state goes on where it stopped and reads new answers only."""
    all_rows = rows()
    log, check, seen = str(tmp_path / "log"), str(tmp_path / "check"), 0
    for i in range(3):
        part = all_rows[i * 80 : i * 80 + 80]
        spark.createDataFrame(part, ANSWER).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = reviews.follow_reviews(stream.read_files(spark, str(tmp_path / "in"), ANSWER), log, check, late="100 days")
        query.awaitTermination(120)
        assert query.exception() is None
        assert sum(p["numInputRows"] for p in query.recentProgress) == 80
        seen += 80
        want = review_schedule(spark.createDataFrame(all_rows[:seen], ANSWER))
        assert sorted(map(tuple, reviews.schedule(spark, log).collect())) == sorted(map(tuple, want.select("user_id", "word_id", "streak", "correct", "wrong", "next_at").collect()))
    future = dt.datetime(2025, 1, 1)
    spark.createDataFrame([(9, 9, 1, True, future), (None, 1, 1, True, dt.datetime(2024, 1, 1)), (9, 8, None, None, dt.datetime(2024, 6, 1))], ANSWER).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = reviews.follow_reviews(stream.read_files(spark, str(tmp_path / "in"), ANSWER), log, check, late="100 days")
    query.awaitTermination(120)
    late = {(r.user_id, r.word_id) for r in reviews.due(spark, log).collect()}
    assert (9, 9) not in late and {(u, w) for u, w, *_ in all_rows} <= late
    again = {(r.user_id, r.word_id): r for r in reviews.schedule(spark, log).collect()}
    assert again[9, 8].wrong == 1 and again[9, 9].streak == 1
