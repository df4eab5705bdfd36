import random
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern.streaming import events as s
from quern.streaming import stateful as k


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


class Runs:
    """A query over a folder of files that is stopped and started again after each batch of files, from its checkpoint."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.schema, self.make = spark, schema, make
        self.input, self.cp, self.out = (str(tmp_path / x) for x in ("in", "cp", "out"))

    def feed(self, rows, clock=False):
        """clock: state that goes by the clock keeps such a query busy, so it is stopped once the rows are out."""
        before = self.count()
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.input)
        to = self.make(self.spark.readStream.schema(self.schema).parquet(self.input)).writeStream.format("parquet").option("checkpointLocation", self.cp).option("path", self.out)
        q = to.trigger(**({"processingTime": "1 second"} if clock else {"availableNow": True})).start()
        if clock:
            until = time.time() + 60
            while time.time() < until and self.count() < before + len(rows):
                time.sleep(0.2)
            q.stop()
        else:
            assert q.awaitTermination(120)
        assert q.exception() is None
        return self

    def rows(self):
        return sorted((tuple(r) for r in self.spark.read.parquet(self.out).collect()), key=str)

    def count(self):
        try:
            return len(self.rows())
        except AnalysisException:  # nothing is committed yet
            return 0

    def stored(self, variable):
        return k.stored(self.spark, self.cp, variable)


EVENTS = "event_key string, event_id long, at_ms long"


def burst_rows():
    rng = random.Random(5)
    at, rows = 0, []
    for i in range(240):
        at += rng.choice([0, 1, 5, 40])
        rows.append((f"k{rng.choice([0, 0, 0, 1, 2])}", i, at))
    return rows


def test_muting_survives_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = burst_rows()
    runs = Runs(spark, tmp_path, EVENTS, lambda df: k.burst_stream(df, 2, 30, 15, idle=None))
    for at in range(0, 240, 60):
        runs.feed(rows[at : at + 60][::-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = sorted((tuple(r) for r in s.burst_batch(spark.createDataFrame(rows, EVENTS), 2, 30, 15).collect()), key=str)
    assert runs.rows() == want and {r[4] for r in want} == {True, False}
    assert runs.stored("burst").count() == 3


def test_muting_by_event_time_leaves_no_state(spark, tmp_path):
    rows = burst_rows()
    timed = lambda df: df.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", "0 seconds")
    runs = Runs(spark, tmp_path, EVENTS, lambda df: k.burst_stream(timed(df), 2, 30, 15, event_time=True))
    for at in range(0, 240, 120):
        runs.feed(rows[at : at + 120])
    assert runs.stored("burst").count() > 0
    runs.feed([("late", 999, 10**7)]).feed([("later", 1000, 10**8)])
    assert {r["key"]["event_key"] for r in runs.stored("burst").collect()} <= {"late", "later"}
    want = sorted((tuple(r) for r in s.burst_batch(spark.createDataFrame(rows, EVENTS), 2, 30, 15).collect()), key=str)
    assert [r for r in runs.rows() if not r[0].startswith("late")] == want


def test_muting_state_expires(spark, tmp_path):
    runs = Runs(spark, tmp_path, EVENTS, lambda df: k.burst_stream(df, 2, 1, 15, idle=8000))
    runs.feed([(f"k{i}", i, i) for i in range(5)], clock=True)
    assert runs.stored("burst").count() == 5
    time.sleep(9)
    runs.feed([("new", 9, 9)], clock=True)
    assert {r["key"]["event_key"] for r in runs.stored("burst").collect()} == {"new"}


def actions(rows):
    return [(a, seq, seq * 1000, what, sel, target, qs) for a, seq, what, sel, target, qs in rows]


QUESTIONS = [("q1", "A"), ("q2", None), ("q3", "B"), ("q4", "C")]


def exam():
    return actions([
        ("u", 0, "answer", "A", None, None), ("u", 1, "start", None, None, QUESTIONS), ("u", 2, "answer", "A", None, None), ("u", 3, "next", None, None, None), ("u", 4, "answer", "A", None, None),
        ("u", 5, "abort", None, None, None), ("u", 6, "answer", "B", None, None), ("u", 7, "resume", None, None, None), ("u", 8, "answer", "B", None, None), ("u", 9, "goto", None, 9, None), ("u", 10, "goto", None, 2, None),
        ("u", 11, "next", None, None, None), ("u", 12, "prev", None, None, None), ("u", 13, "odd", None, None, None), ("u", 14, "finish", None, None, None), ("u", 15, "resume", None, None, None),
        ("v", 0, "start", None, None, QUESTIONS), ("v", 1, "answer", None, None, None), ("w", 0, "start", None, None, []), ("w", 1, "answer", "A", None, None), ("w", 2, "finish", None, None, None), ("x", 0, "start", None, None, QUESTIONS), ("x", 1, "reset", None, None, None), ("x", 2, "resume", None, None, None),
    ])


def test_session_rules(spark):
    got = {(r["session_id"], r["seq"]): r for r in k.session_batch(spark.createDataFrame(exam(), k.ACTIONS)).collect()}
    u = lambda i: tuple(got["u", i])[3:8]
    assert u(0) == (False, 0, 0, 0, None) and u(1) == (True, 0, 3, 0, "q1") and u(3) == (True, 1, 3, 1, "q3")
    assert u(5) == u(6) == (False, 0, 0, 0, None) and u(7) == u(8) == (True, 1, 3, 2, "q3")
    assert u(9)[1] == 1 and u(10)[1] == 2 and u(11)[1] == 2 and u(12)[1] == 1 and u(13)[1] == 1
    done = got["u", 14]
    assert (done["correct"], done["wrong"], done["skipped"], done["score"], done["total_time"], done["active"]) == (2, 0, 1, 67, 13000, False)
    assert u(15) == (False, 0, 0, 0, None)
    assert got["w", 2]["score"] == 0 and not got["x", 2]["active"] and got["v", 1]["answered"] == 1


def test_sessions_go_on_after_a_stop(spark, tmp_path):
    rows = exam()
    runs = Runs(spark, tmp_path, k.ACTIONS, k.session_stream)
    for at in range(0, len(rows), 5):
        runs.feed(rows[at : at + 5][::-1])
    want = sorted((tuple(r) for r in k.session_batch(spark.createDataFrame(rows, k.ACTIONS)).collect()), key=str)
    assert runs.rows() == want
    left = runs.stored("session").collect()  # finished and reset sessions are gone
    assert [r["key"]["session_id"] for r in left] == ["v"] and left[0]["value"]["ids"] == ["q1", "q3", "q4"] and left[0]["value"]["answered"] == [True, False, False]


def test_saved_sessions_are_filtered_on_resume(spark, tmp_path):
    saved = spark.createDataFrame(
        [("a", False, 2, 0, ["q1", "q2", "q3"], ["A", None, "B"], ["A", "B", None], [True, True, False]), ("b", False, 1, 0, ["q1", "q2"], ["A", None], [None, None], [False, False]), ("c", False, 0, 0, ["q2"], [None], [None], [False])],
        "session_id string, " + k.SAVED,
    )
    runs = Runs(spark, tmp_path, k.ACTIONS, lambda df: k.session_stream(df, saved))
    runs.feed(actions([(x, 0, "resume", None, None, None) for x in "abc"]))
    got = {r[0]: r[3:8] for r in runs.rows()}
    assert got == {"a": (True, 1, 2, 1, "q3"), "b": (True, 0, 1, 0, "q1"), "c": (False, 0, 0, 0, None)}
    assert {r["key"]["session_id"] for r in runs.stored("session").collect()} == {"a", "b"}


CHUNKS = "request_id string, seq long, at_ms long, chunk string, is_last boolean"


def chunk_rows():
    a = [("a", 0, 0, "one ", False), ("a", 1, 100, "two", True), ("b", 0, 150, "lost ", False), ("b", 1, 5000, "anew ", False), ("b", 2, 5100, None, True)]
    a += [("c", 0, 5200, "never ", False), ("c", 1, 5300, "ends", False), ("d", 0, 9000, "still on", False), ("a", 2, 9050, "again", True)]
    return [(r, seq, at + 10_000, chunk, last) for r, seq, at, chunk, last in a]


@pytest.mark.parametrize("step", [2, 9])
def test_replies_are_given_up_by_event_time(spark, tmp_path, step):
    rows = chunk_rows()
    timed = lambda df: df.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", "0 seconds")
    runs = Runs(spark, tmp_path, CHUNKS, lambda df: k.reply_stream(timed(df), 1000))
    for at in range(0, len(rows), step):
        runs.feed(rows[at : at + step])
    want = sorted((tuple(r) for r in k.reply_batch(spark.createDataFrame(rows, CHUNKS), 1000, 19_050).collect()), key=str)
    assert runs.rows() == want
    assert [r[2] for r in want if r[4]] == ["lost ", "never ends"] and ("b", 2, "anew ", True, False) in want
    assert [r["key"]["request_id"] for r in runs.stored("reply").collect()] == ["d"]


def test_doubtful_replies_end_twice(spark):
    from quern.functions import text

    rows = [("a", 0, "short", False, False), ("a", 1, "short end", True, False), ("b", 0, "A or B: " + "x" * 90 + " key", True, False), ("c", 0, "gone", False, True)]
    got = k.cautioned(spark.createDataFrame(rows, k.REPLIES), text.confidence(F.col("text"), ("key",)), 0.7, " (unsure)").collect()
    assert [(r["request_id"], r["done"], r["cautioned"]) for r in got] == [("a", False, False), ("a", True, False), ("a", True, True), ("b", True, False), ("c", False, False)]
    assert [r["text"] for r in got if r["cautioned"]] == ["short end (unsure)"]
