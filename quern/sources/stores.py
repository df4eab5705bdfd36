"""Versioned stores, merges, exports and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STATS = "version int, items map<string, struct<attempts: bigint, correct: bigint, lastTriedAt: bigint>>"
PROGRESS = "version int, savedAt bigint, state struct<isActive: boolean, startTime: bigint, config: map<string, string>, currentIndex: int, questions: array<string>, answers: array<struct<questionId: string, selectedAnswer: string>>>"


def load_stats(blobs: DataFrame, json: str = "json", version: int = 1) -> DataFrame:
    """blobs (owner, json) -> owner, id, attempts, correct, last_tried_at. A blob of another version, or with one bad entry
    (attempts below 1, more correct than attempts, nulls), counts as empty as a whole."""
    parsed = blobs.select("owner", F.from_json(json, STATS).alias("b"))
    sound = F.forall(F.map_values("b.items"), lambda s: (s["attempts"] >= 1) & (s["correct"] >= 0) & (s["correct"] <= s["attempts"]) & s["lastTriedAt"].isNotNull())
    return parsed.where((F.col("b.version") == version) & F.coalesce(sound, F.lit(False))).select("owner", F.explode("b.items").alias("id", "s")).select("owner", "id", "s.attempts", "s.correct", F.col("s.lastTriedAt").alias("last_tried_at"))


def dump_stats(stats: DataFrame, version: int = 1) -> DataFrame:
    """The inverse: owner, json (entries by id, so that equal stats are equal blobs)."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct("attempts", "correct", F.col("last_tried_at").alias("lastTriedAt"))))))
    return stats.groupBy("owner").agg(F.to_json(F.struct(F.lit(version).alias("version"), entries.alias("items"))).alias("json"))


def progress(json: Column, version: int = 1) -> Column:
    """The saved session, or null: unreadable, another version, a field missing, an index outside of the questions (an idle session
    may have none), or an active one without its start or settings."""
    p = F.from_json(json, PROGRESS)
    s = p["state"]
    n, active = F.size(s["questions"]), s["isActive"]
    inside = (s["currentIndex"] >= 0) & F.when(n == 0, ~active).otherwise(s["currentIndex"] < n)
    sound = (p["version"] == version) & p["savedAt"].isNotNull() & s["answers"].isNotNull() & active.isNotNull() & inside & (~active | (s["startTime"].isNotNull() & s["config"].isNotNull()))
    return F.when(F.coalesce(sound, F.lit(False)), p)


def saved_progress(old: DataFrame, sessions: DataFrame, version: int = 1) -> DataFrame:
    """old (owner, json) after sessions (owner, saved_at, state as in PROGRESS; a null state clears): active ones replace what was
    saved, others leave it as it is. One session an owner."""
    new = sessions.select("owner", F.col("state").isNull().alias("_clear"), F.when(F.col("state.isActive"), F.to_json(F.struct(F.lit(version).alias("version"), F.col("saved_at").alias("savedAt"), "state"))).alias("_json"))
    return old.join(new, "owner", "full_outer").where(~F.coalesce("_clear", F.lit(False))).select("owner", F.coalesce("_json", "json").alias("json")).where(F.col("json").isNotNull())


def merge_stats(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Sums of attempts and correct, the latest time: a union and one more aggregate, so partial results merge in any order."""
    cols = (*keys, "attempts", "correct", "last_tried_at")
    return old.select(*cols).unionByName(new.select(*cols)).groupBy(*keys).agg(F.sum("attempts").alias("attempts"), F.sum("correct").alias("correct"), F.max("last_tried_at").alias("last_tried_at"))


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by the order columns (upsert by key)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def export_result(summary: DataFrame, wrong: DataFrame, questions: DataFrame) -> DataFrame:
    """session_id, json: the summary with the wrong answers and their stems ('' for an unknown question)."""
    named = wrong.join(questions.select(F.col("id").alias("question_id"), "stem"), "question_id", "left").select("session_id", F.struct("question_id", F.coalesce("stem", F.lit("")).alias("stem"), "selected_answer", "correct_answer").alias("w"))
    lists = named.groupBy("session_id").agg(F.array_sort(F.collect_list("w")).alias("wrong"))
    cols = [c for c in summary.columns if c != "session_id"]
    return summary.join(lists, "session_id", "left").select("session_id", F.to_json(F.struct("session_id", *cols, F.coalesce("wrong", F.array().cast("array<struct<question_id: string, stem: string, selected_answer: string, correct_answer: string>>")).alias("wrong"))).alias("json"))


def gap_report(buckets: DataFrame, most: int = 20) -> DataFrame:
    """bucket, markdown: a heading with the count and the first ids; buckets (bucket, id)."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))  # its limit holds before the shuffle too
    first = buckets.select("bucket", "id").distinct().withColumn("_r", rank).where(F.col("_r") <= most).groupBy("bucket").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    n = buckets.groupBy("bucket").agg(F.count("*").alias("n")).join(first, "bucket")
    return n.select("bucket", F.concat(F.lit("## "), "bucket", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("- "), i)), "\n")).alias("markdown"))
