import pytest
from pyspark.sql import functions as F

from quern.streaming import events as s


def stream(spark, tmp_path, df, parts=3):
    """The rows of df as a stream of files, in order of their first columns."""
    path = str(tmp_path / "in")
    for i in range(parts):
        df.where(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, df, tmp_path, mode="append", **sink):
    q = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp"))
    q = q.foreachBatch(sink["batch"]).start() if sink else q.format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    return None if sink else spark.table("out").collect()


def test_burst_documented_cases(spark):
    rows = [("a", i, 100 * i) for i in range(8)]
    got = s.burst_batch(spark.createDataFrame(rows, "event_key string, event_id long, at_ms long"), 5).collect()
    assert sum(r["logged"] for r in got) == 5 and sum(r["notice"] for r in got) == 1
    rows = [("a", i, i) for i in range(5)] + [("b", 9, 3)]
    assert sum(r["logged"] for r in s.burst_batch(spark.createDataFrame(rows, "event_key string, event_id long, at_ms long"), 3).collect()) == 4


def test_burst_mutes_again_within_a_window():
    b = s.Burst(threshold=2, window=1000, mute=150)
    assert [t for t in (0, 1, 2, 3, 200, 400, 600) if b.see(t)[1]] == [2, 200, 400, 600]
    assert all(s.Burst(threshold=0).see(0) == (True, False) for _ in range(9))


def test_buffer_over_its_size_keeps_the_newest(spark):
    log = spark.createDataFrame([(u, i, i, "x" * n) for u, n in (("a", 5), ("b", 500)) for i in range(4)], "who string, ts long, seq long, text string")
    got = sorted((r["who"], r["ts"]) for r in s.last_entries(log, 3, ["who"], most_bytes=1000).collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 3)]
    assert [r["ts"] for r in s.last_entries(log.where("who = 'a'"), 3, most_bytes=100).collect()] == [3] and s.last_entries(log, 3, most_bytes=10**6).count() == 3


def test_stats_sink(spark, tmp_path):
    rows = [(f"q{i % 2}", "A", "A" if i % 3 else None, i % 4 == 0, i, i // 4) for i in range(12)]
    df = spark.createDataFrame(rows, "question_id string, correct_answer string, selected_answer string, is_correct boolean, timestamp long, batch int")
    out = str(tmp_path / "stats")
    sink = s.stats_sink(spark, out)
    from quern.operators.scoring import attempts

    drained(spark, stream(spark, tmp_path, df), tmp_path, batch=lambda b, i: [sink(attempts(b), i) for _ in range(2)])  # each comes twice
    assert sorted(map(tuple, s.stored_stats(spark, out).collect())) == sorted(map(tuple, attempts(df).collect()))


def test_feed_and_ring(spark):
    feed = spark.createDataFrame([(1, "a", "x"), (2, None, None), (3, "b", "y"), (4, "b", "z")], "seq long, store string, value string")
    assert [tuple(r) for r in s.latest_change(feed).collect()] == [("b", "z")]
    log = spark.createDataFrame([(i, i) for i in range(30)], "ts long, seq long")
    assert [r["ts"] for r in s.last_entries(log, 3).collect()] == [29, 28, 27]


@pytest.mark.parametrize("mode", ["update"])
def test_attempt_stream(spark, tmp_path, mode):
    rows = [("q", "A", "A", True, i, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "question_id string, correct_answer string, selected_answer string, is_correct boolean, timestamp long, batch int")
    assert [tuple(r) for r in drained(spark, s.attempt_stream(stream(spark, tmp_path, df, 1)), tmp_path, mode)] == [("q", 3, 3, 2)]
