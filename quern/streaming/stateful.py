"""Keyed state that outlives a query's restarts, on transformWithState: burst muting, resumable sessions, replies that end or are given up.

Each has a batch twin that must give the same rows. State lies in RocksDB, so it is not bound by an executor's memory; what ends or
expires leaves none. Within a micro-batch the rows of a key are taken in time order, and only what the fold needs of them is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.streaming.events import BURST, Burst

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _needs_rocksdb(spark: SparkSession) -> None:
    """transformWithState has no other state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stored(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """key, value of a state variable as the last finished micro-batch of a query left it, read from its checkpoint."""
    _needs_rocksdb(spark)
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()


# Burst muting


class _Muting(StatefulProcessor):
    def __init__(self, threshold: int, window: int, mute: int, idle: int | None, timed: bool):
        self.rule, self.idle, self.timed = (threshold, window, mute), idle, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("burst", "first long, count long, until long", None if self.timed else self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of a key's events in a micro-batch, two numbers each are held.
        parts = [(p["at_ms"].to_numpy(np.int64), p["event_id"].to_numpy(np.int64)) for p in rows]
        at, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, at))
        before = tuple(self.state.get()) if self.state.exists() else None
        burst = Burst(*self.rule, before)
        seen = [burst.see(int(t)) for t in at[order]]
        self.state.update((burst.first, burst.count, burst.until))
        if self.timed and (before is None or before[0] != burst.first):
            # Once the watermark is past the window, the next event opens a new one, with or without this state.
            if before is not None:
                self.handle.deleteTimer(before[0] + self.rule[1] + 1)
            self.handle.registerTimer(burst.first + self.rule[1] + 1)
        yield pd.DataFrame({"event_key": key[0], "event_id": ids[order], "at_ms": at[order], "logged": [x for x, _ in seen], "notice": [x for _, x in seen]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])


def burst_stream(events: DataFrame, threshold: int = 5, window: int = 1000, mute: int = 1000, idle: int | None = 3_600_000, event_time: bool = False) -> DataFrame:
    """``events.burst_batch`` over a stream of events (event_key, event_id, at_ms). State (variable ``burst``): three numbers a key.

    event_time: events have a column with a watermark (at_ms in its time); a timer drops a key's state when the watermark is
    past its window. Else the state expires after ``idle`` ms of clock time without an event (at least the window); None: never."""
    _needs_rocksdb(events.sparkSession)
    ttl = None if idle is None else max(idle, window)
    mode = "EventTime" if event_time else "None" if idle is None else "ProcessingTime"
    return events.groupBy("event_key").transformWithStateInPandas(_Muting(threshold, window, mute, ttl, event_time), BURST, "Append", mode)


# Resumable sessions

ACTIONS = "session_id string, seq long, at_ms long, action string, selected string, target int, questions array<struct<id: string, answer: string>>"
STEPS = "session_id string, seq long, action string, active boolean, current int, total int, answered int, question_id string, correct int, wrong int, skipped int, score int, total_time long"
SAVED = "active boolean, current int, started long, ids array<string>, keys array<string>, given array<string>, answered array<boolean>"


class Session:
    """One user's exam, as its actions change it.

    start (questions): those with an answer, from the first; what was saved is replaced. answer (selected): of the question shown; once more
    replaces it. next, prev, goto (target): as far as there are questions. abort: nothing is shown any more, progress stays saved.
    resume: on with the saved progress, without questions that have no answer; the same question is shown if it is still there, else that at its place,
    or the last; where none is left, nothing remains saved. finish: the score; nothing remains. reset: nothing remains.
    Actions that find nothing to act on change nothing, unknown ones neither."""

    def __init__(self, saved: tuple | None = None):
        self.empty()
        if saved is not None:
            self.active, self.current, self.started = bool(saved[0]), int(saved[1]), int(saved[2])
            self.ids, self.keys, self.given, self.answered = (list(x) for x in saved[3:7])
            self.saved = True

    def empty(self) -> None:
        self.saved = self.active = False
        self.current, self.started = 0, 0
        self.ids, self.keys, self.given, self.answered = [], [], [], []

    def state(self) -> tuple | None:
        """What is to be stored; None: nothing."""
        return (self.active, self.current, self.started, self.ids, self.keys, self.given, self.answered) if self.saved else None

    def _keep(self, at: list[int]) -> None:
        self.ids, self.keys, self.given, self.answered = ([x[i] for i in at] for x in (self.ids, self.keys, self.given, self.answered))

    def see(self, action: str, at_ms: int, selected: str | None, target: int | None, questions: list | None) -> tuple:
        """(active, current, total, answered, question_id, correct, wrong, skipped, score, total_time) after an action."""
        result = (None,) * 5
        if action == "start":
            asked = [q for q in (questions if questions is not None else []) if q["answer"] is not None]
            self.empty()
            self.saved = self.active = True
            self.started, self.ids, self.keys = at_ms, [q["id"] for q in asked], [q["answer"] for q in asked]
            self.given, self.answered = [None] * len(asked), [False] * len(asked)
        elif action == "resume" and self.saved:
            left = [i for i, k in enumerate(self.keys) if k is not None]
            if left:
                self.current = left.index(self.current) if self.current in left else min(self.current, len(left) - 1)
                self._keep(left)
                self.active = True
            else:
                self.empty()
        elif action == "reset":
            self.empty()
        elif self.active:
            n = len(self.ids)
            if action == "answer" and self.current < n:
                self.given[self.current], self.answered[self.current] = selected, True
            elif action == "next":
                self.current = min(self.current + 1, max(n - 1, 0))
            elif action == "prev":
                self.current = max(self.current - 1, 0)
            elif action == "goto" and target is not None and 0 <= target < n:
                self.current = int(target)
            elif action == "abort":
                self.active = False
            elif action == "finish":
                marked = [g == k for g, k, a in zip(self.given, self.keys, self.answered) if a and k is not None]
                answerable = sum(k is not None for k in self.keys)
                score = (200 * sum(marked) + answerable) // (2 * answerable) if answerable else 0  # halves are rounded up
                result = (sum(marked), len(marked) - sum(marked), n - sum(self.answered), score, at_ms - self.started)
                self.empty()
        shown = self.active and self.current < len(self.ids)
        return (self.active, self.current if self.active else 0, len(self.ids) if self.active else 0, sum(self.answered) if self.active else 0, self.ids[self.current] if shown else None, *result)


_STEP_COLUMNS = [c.split(" ")[0] for c in STEPS.split(", ")]
_INTS = {"current": "Int32", "total": "Int32", "answered": "Int32", "correct": "Int32", "wrong": "Int32", "skipped": "Int32", "score": "Int32", "total_time": "Int64", "seq": "Int64"}


def _or_none(x):
    return None if x is None or x is pd.NA or isinstance(x, float) and np.isnan(x) else x


def _steps(session: Session, key: str, rows) -> list[tuple]:
    return [(key, seq, action, *session.see(action, int(at), _or_none(selected), _or_none(target), questions)) for seq, at, action, selected, target, questions in rows]


def _table(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=_STEP_COLUMNS).astype(_INTS)


_READ = ["seq", "at_ms", "action", "selected", "target", "questions"]


class _Sessions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", SAVED)

    def handleInitialState(self, key, initial: pd.DataFrame, timerValues) -> None:
        for row in initial[[c.split(" ")[0] for c in SAVED.split(", ")]].itertuples(index=False):
            self.state.update((bool(row[0]), int(row[1]), int(row[2]), *(list(x) for x in row[3:6]), [bool(x) for x in row[6]]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        actions = pd.concat(list(rows)).sort_values("seq")  # what one user does within a micro-batch
        session = Session(self.state.get() if self.state.exists() else None)
        out = _steps(session, key[0], actions[_READ].itertuples(index=False))
        state = session.state()
        if state is not None:
            self.state.update(state)
        elif self.state.exists():
            self.state.clear()
        yield _table(out)


def session_stream(actions: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """actions (ACTIONS, seq in order a session) -> STEPS, a row an action. State (variable ``session``): the progress of sessions neither
    finished nor reset, so a query that is stopped and started again goes on where it was, as ``resume`` does for a user.
    saved (session_id and SAVED): progress from before this query, for its first start."""
    _needs_rocksdb(actions.sparkSession)
    return actions.groupBy("session_id").transformWithStateInPandas(_Sessions(), STEPS, "Append", "None", saved.groupBy("session_id") if saved is not None else None)


def session_batch(actions: DataFrame) -> DataFrame:
    """The same over a table; rows are streamed through tasks that hold whole sessions in order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, session = None, None
        for pdf in parts:
            out = []
            for k, *row in pdf[["session_id", *_READ]].itertuples(index=False):
                if session is None or k != key:
                    key, session = k, Session()
                out += _steps(session, k, [row])
            yield _table(out)

    return actions.select("session_id", *_READ).repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(run, STEPS)


# Replies

REPLIES = "request_id string, seq long, text string, done boolean, abandoned boolean"


class _Replies(StatefulProcessor):
    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reply", "text string, seq long, at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = pd.concat([p[["seq", "at_ms", "chunk", "is_last"]] for p in rows]).sort_values("seq")  # one reply's part in a micro-batch
        held = tuple(self.state.get()) if self.state.exists() else None
        if held:
            self.handle.deleteTimer(held[2] + self.patience + 1)
        out = []
        for seq, at, chunk, last in chunks.itertuples(index=False):
            if held and at - held[2] > self.patience:
                out.append((key[0], held[1], held[0], False, True))
                held = None
            text = (held[0] if held else "") + (chunk or "")
            out.append((key[0], int(seq), text, bool(last), False))
            held = None if last else (text, int(seq), int(at))
        if held:
            self.state.update(held)
            self.handle.registerTimer(held[2] + self.patience + 1)
        elif self.state.exists():
            self.state.clear()
        yield pd.DataFrame(out, columns=["request_id", "seq", "text", "done", "abandoned"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text, seq, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], seq, text, False, True)], columns=["request_id", "seq", "text", "done", "abandoned"])


def reply_stream(chunks: DataFrame, patience: int) -> DataFrame:
    """chunks (request_id, seq, at_ms, chunk, is_last, and a column with a watermark in the time of at_ms) -> REPLIES: the text so far after
    each chunk; a reply without a chunk for more than ``patience`` ms is given up: a row with all it had, and no state (variable ``reply``)."""
    _needs_rocksdb(chunks.sparkSession)
    return chunks.groupBy("request_id").transformWithStateInPandas(_Replies(patience), REPLIES, "Append", "EventTime")


def reply_batch(chunks: DataFrame, patience: int, until: int) -> DataFrame:
    """The same over a table; until: the watermark up to which replies without a further chunk are given up, in the time of at_ms."""
    of_request = Window.partitionBy("request_id").orderBy("seq")
    before = of_request.rowsBetween(Window.unboundedPreceding, -1)
    broken = F.coalesce(F.col("at_ms") - F.lag("at_ms").over(of_request) > patience, F.lit(False))
    # A reply begins anew after an end and after a break.
    marked = chunks.select("request_id", "seq", "at_ms", "chunk", "is_last", broken.alias("broken"))
    turned = marked.withColumn("turn", F.coalesce(F.sum(F.col("is_last").cast("int")).over(before), F.lit(0)) + F.sum(F.col("broken").cast("int")).over(of_request.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = Window.partitionBy("request_id", "turn").orderBy("seq")
    text = F.array_join(F.collect_list(F.coalesce("chunk", F.lit(""))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "")
    rows = turned.select("request_id", "seq", text.alias("text"), F.col("is_last").alias("done"), (F.lead("seq").over(own).isNull() & ~F.col("is_last") & ((F.lead("seq").over(of_request).isNotNull()) | (F.col("at_ms") + patience + 1 <= until))).alias("given_up"))
    ends = F.when(F.col("given_up"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return rows.select("request_id", "seq", "text", F.col("done"), F.explode(ends).alias("abandoned"))


def cautioned(replies: DataFrame, confidence, threshold: float = 0.6, caution: str = "") -> DataFrame:
    """replies (a stream or a table) where a done one of low confidence (a column over text) ends a second time, with the caution after its text."""
    again = F.col("done") & (confidence < threshold)
    texts = F.when(again, F.array(F.col("text"), F.concat("text", F.lit(caution)))).otherwise(F.array(F.col("text")))
    return replies.select(*(c for c in replies.columns if c != "text"), F.posexplode(texts).alias("ending", "text")).select(*replies.columns, (F.col("ending") == 1).alias("cautioned"))
