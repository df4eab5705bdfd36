"""Streams and their batch twins: bursts, texts so far, statistics, feeds. What keeps state of its own a key is in ``stateful``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.sources.stores import merge_stats
from quern.sources.versions import MergedParts

BURST = "event_key string, event_id long, at_ms long, logged boolean, notice boolean"


class Burst:
    """Mutes repeats of one key: a window opens at the first event and closes when one comes more than ``window`` after it; an event
    beyond ``threshold`` of them gives a notice and makes the key mute for ``mute`` (or until its window closes). Events count while
    it is mute, so what comes after a mute that ends within the window gives a notice and a mute again. Threshold 0: no muting."""

    def __init__(self, threshold: int = 5, window: int = 1000, mute: int = 1000, state: tuple[int, int, int] | None = None):
        self.threshold, self.window, self.mute = threshold, window, mute
        self.first, self.count, self.until = state or (-(2**62), 0, -(2**62))

    def see(self, at: int) -> tuple[bool, bool]:
        """(logged, notice) of an event at a time in ms."""
        if self.threshold <= 0:
            return True, False
        if at - self.first > self.window:
            self.first, self.count, self.until = at, 1, -(2**62)
            return True, False
        self.count += 1
        if at < self.until:
            return False, False
        if self.count > self.threshold:
            self.until = at + self.mute
            return False, True
        return True, False


def burst_batch(events: DataFrame, threshold: int = 5, window: int = 1000, mute: int = 1000) -> DataFrame:
    """events (event_key, event_id, at_ms) -> BURST. The state is a few numbers a key, so rows are streamed through tasks that hold
    whole keys in time order, never gathered: a hot key costs time in its task, not memory."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in parts:
            out = []
            for k, i, at in zip(pdf["event_key"], pdf["event_id"], pdf["at_ms"]):
                if state is None or k != key:
                    key, state = k, Burst(threshold, window, mute)
                out.append((k, i, at, *state.see(at)))
            yield pd.DataFrame(out, columns=["event_key", "event_id", "at_ms", "logged", "notice"])

    return events.select("event_key", "event_id", "at_ms").repartition("event_key").sortWithinPartitions("event_key", "at_ms", "event_id").mapInPandas(run, BURST)


def prefixes(chunks: DataFrame) -> DataFrame:
    """chunks (request_id, seq, chunk, is_last) -> the text so far after each chunk, and whether it is done. A chunk after the last
    one starts anew. The output itself grows with the square of a request's chunks, as each shows all before it; a request is
    one reply, so bounded."""
    w = Window.partitionBy("request_id").orderBy("seq")
    rows = chunks.withColumn("_turn", F.coalesce(F.sum(F.col("is_last").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("request_id", "_turn").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("request_id", "seq", F.array_join(F.collect_list("chunk").over(own), "").alias("text"), F.col("is_last").alias("done"))


def attempt_stream(answers: DataFrame) -> DataFrame:
    """Running statistics of a stream of answers, update mode."""
    tried = answers.where(F.col("correct_answer").isNotNull() & F.col("selected_answer").isNotNull())
    return tried.groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("attempts"), F.count_if("is_correct").alias("correct"), F.max("timestamp").alias("last_tried_at"))


STORED = "id string, attempts long, correct long, last_tried_at long"


def stored_parts(spark: SparkSession, path: str, fan: int = 8) -> MergedParts:
    """The table that ``stats_sink`` writes: parts that are added up, a row an id."""
    return MergedParts(spark, path, STORED, lambda rows: merge_stats(rows, rows.limit(0)), fan)


def stats_sink(spark: SparkSession, path: str, fan: int = 8):
    """foreachBatch: adds each micro-batch's attempts (id, attempts, correct, last_tried_at) to a versioned table, exactly once: a batch that comes again
    changes nothing. What is read stays bounded, as parts are merged (``MergedParts``)."""
    table = stored_parts(spark, path, fan)

    def put(batch: DataFrame, batch_id: int) -> None:
        table.put(batch, batch_id)

    return put


def stored_stats(spark: SparkSession, path: str) -> DataFrame:
    """What ``stats_sink`` has stored so far, a row an id."""
    return stored_parts(spark, path).read()


def latest_change(feed: DataFrame, key: str = "store") -> DataFrame:
    """feed (seq, key, value): the last value of each key; a null key clears all before it."""
    cleared = feed.agg(F.max(F.when(F.col(key).isNull(), F.col("seq"))).alias("_cleared"))
    rows = feed.where(F.col(key).isNotNull()).crossJoin(cleared).where(F.col("seq") > F.coalesce("_cleared", F.lit(-(2**62))))  # one row
    return rows.groupBy(key).agg(F.max_by("value", "seq").alias("value"))


FEED = "seq long, store string, value string"


def _last_changes(rows: DataFrame) -> DataFrame:
    """The newest clearing (a null store) and what came after it, the last of each store: parts of a feed merge so in any order."""
    cleared = rows.agg(F.max(F.when(F.col("store").isNull(), F.col("seq"))).alias("_cleared"))
    last = rows.groupBy("store").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
    return last.crossJoin(F.broadcast(cleared)).where(F.col("store").isNull() | (F.col("seq") > F.coalesce("_cleared", F.lit(-(2**62))))).select("seq", "store", "value")  # one row


def feed_table(spark: SparkSession, path: str, fan: int = 8) -> MergedParts:
    return MergedParts(spark, path, FEED, _last_changes, fan)


def feed_sink(spark: SparkSession, path: str, fan: int = 8):
    """foreachBatch: a change feed (seq, store, value; a null store clears all) into a versioned table, each batch once, late and unordered changes
    too. ``current`` is what a reader who comes then sees."""
    table = feed_table(spark, path, fan)

    def put(batch: DataFrame, batch_id: int) -> None:
        table.put(_last_changes(batch.select("seq", "store", "value")), batch_id)

    return put


def current(spark: SparkSession, path: str) -> DataFrame:
    """store, value: the last value of each store since the last clearing."""
    return feed_table(spark, path).read().where("store IS NOT NULL").select("store", "value")


def last_entries(log: DataFrame, n: int = 20, partition: list[str] | None = None, most_bytes: int | None = None) -> DataFrame:
    """The last n log entries (of each partition), newest first. most_bytes: where these take more as JSON, only the newest is left
    (a buffer over its size is reset to it)."""
    if not partition:
        out, mine = log.orderBy(F.desc("ts"), F.desc("seq")).limit(n), [F.lit(0)]
    else:
        w = Window.partitionBy(*partition).orderBy(F.desc("ts"), F.desc("seq"))
        out, mine = log.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r"), partition
    if most_bytes is None:
        return out
    # At most n rows a partition meet in the windows.
    size = F.sum(F.octet_length(F.to_json(F.struct(*log.columns))) + 1).over(Window.partitionBy(*mine)) + 1
    newest = F.row_number().over(Window.partitionBy(*mine).orderBy(F.desc("ts"), F.desc("seq"))) == 1
    return out.withColumn("_size", size).withColumn("_newest", newest).where((F.col("_size") <= most_bytes) | F.col("_newest")).drop("_size", "_newest")


def windowed_counts(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: event-time windows with a watermark, for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")
