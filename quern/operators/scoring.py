"""Answers to scores: latest answers, session results, breakdowns, attempts, weak items, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quern.functions.scalars import percent


def latest_answers(answers: DataFrame, keys: tuple[str, ...] = ("session_id", "question_id")) -> DataFrame:
    """The last answer to each question, in the slot of the first (seq)."""
    rest = [c for c in answers.columns if c not in (*keys, "seq")]
    out = answers.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("timestamp", "seq")).alias("_r"), F.min("seq").alias("seq"))
    return out.select(*keys, *(F.col("_r")[c].alias(c) for c in rest), "seq")


def session_scores(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """answers: the latest; questions (session_id, question_id, has_answer) drawn. An answer left empty is wrong, not skipped;
    questions without a key count for nothing."""
    asked = questions.groupBy("session_id").agg(F.count("*").alias("asked"), F.count_if("has_answer").alias("answerable"))
    given = answers.groupBy("session_id").agg(F.count("*").alias("given"), F.count_if(F.col("correct_answer").isNotNull() & F.col("is_correct")).alias("correct"), F.count_if(F.col("correct_answer").isNotNull() & ~F.col("is_correct")).alias("wrong"), F.sum("time_spent").alias("total_time"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return asked.join(given, "session_id", "left").select("session_id", zero("correct").alias("correct"), zero("wrong").alias("wrong"), "answerable", (F.col("asked") - zero("given")).alias("skipped"), percent(zero("correct"), F.col("answerable")).alias("score"), zero("total_time").alias("total_time"))


def breakdown(answers: DataFrame, categories: tuple[str, ...] = ("main_bank", "external_mock", "ai_generated"), low: int = 60) -> DataFrame:
    """By source of the question, in fixed order; unscorable answers and unknown sources are out, no source is the first one."""
    names = F.array(*map(F.lit, categories))
    rows = answers.where(F.col("is_correct").isNotNull()).select(F.coalesce("source_category", F.lit(categories[0])).alias("category"), "is_correct").where(F.array_contains(names, F.col("category")))
    out = rows.groupBy("category").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"))
    out = out.withColumn("pct", percent(F.col("correct"), F.col("total"))).withColumn("low", (F.col("pct") < low) & (F.col("category") != categories[0]))
    return out.orderBy(F.array_position(names, F.col("category")))


def attempts(answers: DataFrame) -> DataFrame:
    """id, attempts, correct, last_tried_at: only answers with a key and a choice are attempts."""
    tried = answers.where(F.col("correct_answer").isNotNull() & F.col("selected_answer").isNotNull())
    return tried.groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("attempts"), F.count_if("is_correct").alias("correct"), F.max("timestamp").alias("last_tried_at"))


def weakest(stats: DataFrame, least: int = 3, below: float = 0.5, limit: int = 10) -> DataFrame:
    """Lowest rate first, then more attempts, then the later, then the id."""
    rate = F.col("correct") / F.col("attempts")
    return stats.where(F.col("attempts") >= least).withColumn("rate", rate).where(F.col("rate") < below).orderBy("rate", F.desc("attempts"), F.desc("last_tried_at"), "id").limit(limit)


def weakest_named(stats: DataFrame, questions: DataFrame, **options) -> DataFrame:
    """With stems; an unknown id drops out after the limit, so fewer rows may be left."""
    return weakest(stats, **options).join(questions.select("id", "stem"), "id")


def wrong_answers(answers: DataFrame) -> DataFrame:
    return answers.where(F.col("is_correct") == F.lit(False))


def composition(items: DataFrame, category: str = "source_type") -> DataFrame:
    """category, n, pct of all, width of its bar against the largest."""
    n = items.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))
    all_ = n.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return n.crossJoin(all_).select("category", "n", percent(F.col("n"), F.col("total")).alias("pct"), percent(F.col("n"), F.greatest(F.col("most"), F.lit(1))).alias("width"))  # one row of totals


def progress(sessions: DataFrame) -> DataFrame:
    """sessions (session_id, current, total, answered) with the rounded percentage answered."""
    return sessions.withColumn("percentage", percent(F.col("answered"), F.col("total")))


def resumed(saved: DataFrame, questions: DataFrame) -> DataFrame:
    """saved (session_id, pos, question_id, current) where questions (id) still exist: new positions from 0, and where to go on:
    at the same question, or if it is gone at the same index, or the last."""
    left = saved.join(questions.select(F.col("id").alias("question_id")).distinct(), "question_id", "left_semi")
    w = Window.partitionBy("session_id")
    left = left.withColumn("new_pos", F.row_number().over(w.orderBy("pos")) - 1)
    same = F.max(F.when(F.col("pos") == F.col("current"), F.col("new_pos"))).over(w)
    return left.withColumn("new_current", F.coalesce(same, F.least(F.col("current"), F.count("*").over(w) - 1)).cast("long"))


def option_status(option_key, answer, selected, shown):
    """How one option looks. Until the answer is shown: selected or default. Then: correct for the answer (chosen or not), incorrect
    for another one that was chosen, else default."""
    chosen = option_key.eqNullSafe(selected)
    after = F.when(option_key.eqNullSafe(answer), "correct").when(chosen, "incorrect").otherwise("default")
    return F.when(shown, after).otherwise(F.when(chosen, "selected").otherwise("default"))


def answer_text(options, answer):
    return F.try_element_at(F.filter(options, lambda o: o["key"] == answer), F.lit(1))["text"]


def prompt(stem, options, answer):
    """Stem, one line an option, and the answer."""
    lines = F.transform(options, lambda o: F.concat(o["key"], F.lit(". "), o["text"]))
    return F.concat_ws("\n", stem, F.array_join(lines, "\n"), F.concat(F.lit("Answer: "), F.coalesce(answer, F.lit("none"))))

