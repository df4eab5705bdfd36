"""Catalogue: the batch twins of the streams that keep state of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.streaming import stateful

from .catalog import query
from .text_queries import _read


@query("""WITH RECURSIVE e AS (SELECT user_id AS session_id, event_id AS seq, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
  CASE WHEN value >= 50 THEN 'A' ELSE 'B' END AS sel, event_id % 5 AS target,
  CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'answer' WHEN 'view' THEN 'next' WHEN 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'finish' ELSE 'prev' END
    ELSE CASE event_id % 4 WHEN 0 THEN 'abort' WHEN 1 THEN 'resume' WHEN 2 THEN 'goto' ELSE 'reset' END END AS a FROM events),
s AS (
  SELECT DISTINCT session_id, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS k, '' AS a, false AS saved, false AS active, 0 AS cur, CAST(NULL AS VARCHAR) AS g1, CAST(NULL AS VARCHAR) AS g2, CAST(NULL AS VARCHAR) AS g3,
    CAST(0 AS BIGINT) AS started, CAST(NULL AS INTEGER) AS correct, CAST(NULL AS INTEGER) AS given, CAST(NULL AS BIGINT) AS total_time FROM e
  UNION ALL
  SELECT e.session_id, e.seq, e.k, e.a,
    CASE WHEN e.a = 'start' THEN true WHEN e.a = 'reset' OR e.a = 'finish' AND s.active THEN false ELSE s.saved END,
    CASE WHEN e.a = 'start' OR e.a = 'resume' AND s.saved THEN true WHEN e.a IN ('reset', 'abort', 'finish') THEN false ELSE s.active END,
    CASE WHEN e.a IN ('start', 'reset') OR e.a = 'finish' AND s.active THEN 0 WHEN NOT s.active THEN s.cur WHEN e.a = 'next' THEN least(s.cur + 1, 2) WHEN e.a = 'prev' THEN greatest(s.cur - 1, 0) WHEN e.a = 'goto' AND e.target < 3 THEN CAST(e.target AS INTEGER) ELSE s.cur END,
    CASE WHEN e.a IN ('start', 'reset') OR e.a = 'finish' AND s.active THEN NULL WHEN s.active AND e.a = 'answer' AND s.cur = 0 THEN e.sel ELSE s.g1 END,
    CASE WHEN e.a IN ('start', 'reset') OR e.a = 'finish' AND s.active THEN NULL WHEN s.active AND e.a = 'answer' AND s.cur = 1 THEN e.sel ELSE s.g2 END,
    CASE WHEN e.a IN ('start', 'reset') OR e.a = 'finish' AND s.active THEN NULL WHEN s.active AND e.a = 'answer' AND s.cur = 2 THEN e.sel ELSE s.g3 END,
    CASE WHEN e.a = 'start' THEN e.at_ms ELSE s.started END,
    CASE WHEN s.active AND e.a = 'finish' THEN coalesce(s.g1 = 'A', false)::INT + coalesce(s.g2 = 'B', false)::INT + coalesce(s.g3 = 'A', false)::INT END,
    CASE WHEN s.active AND e.a = 'finish' THEN (s.g1 IS NOT NULL)::INT + (s.g2 IS NOT NULL)::INT + (s.g3 IS NOT NULL)::INT END,
    CASE WHEN s.active AND e.a = 'finish' THEN e.at_ms - s.started END
  FROM s JOIN e ON e.session_id = s.session_id AND e.k = s.k + 1)
SELECT session_id, seq, a AS action, active, CASE WHEN active THEN cur ELSE 0 END AS current, CASE WHEN active THEN 3 ELSE 0 END AS total,
  CASE WHEN active THEN (g1 IS NOT NULL)::INT + (g2 IS NOT NULL)::INT + (g3 IS NOT NULL)::INT ELSE 0 END AS answered, CASE WHEN active THEN CASE cur WHEN 0 THEN 'q1' WHEN 1 THEN 'q3' ELSE 'q4' END END AS question_id,
  coalesce(correct, -1) AS correct, coalesce(given - correct, -1) AS wrong, coalesce(3 - given, -1) AS skipped, coalesce(CAST(floor(100.0 * correct / 3 + 0.5) AS INTEGER), -1) AS score, coalesce(total_time, -1) AS total_time FROM s WHERE k > 0""")
def session_actions(spark, d):
    """A user's events as what they do in exams of four questions, one of them without an answer."""
    e = _read(spark, d, "events")
    i = F.col("event_id")
    other = F.element_at(F.array(*map(F.lit, ("abort", "resume", "goto", "reset"))), (i % 4 + 1).cast("int"))
    action = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "click", "answer").when(F.col("event_type") == "view", "next").when(F.col("event_type") == "purchase", F.when(i % 2 == 0, "finish").otherwise("prev")).otherwise(other)
    asked = F.array(*(F.struct(F.lit(q).alias("id"), F.lit(a).alias("answer")) for q, a in (("q1", "A"), ("q2", None), ("q3", "B"), ("q4", "A"))))
    actions = e.select(F.col("user_id").cast("string").alias("session_id"), i.alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), action.alias("action"), F.when(F.col("value") >= 50, "A").otherwise("B").alias("selected"), (i % 5).cast("int").alias("target"), asked.alias("questions"))
    steps = stateful.session_batch(actions).withColumn("session_id", F.col("session_id").cast("long"))
    return steps.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("correct", "wrong", "skipped", "score", "total_time")})


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS chunk, turn * 1000 + CASE WHEN (conv_id + turn) % 5 = 0 THEN 800 ELSE 0 END AS at_ms, turn % 4 = 3 AS last FROM conversations),
b AS (SELECT *, coalesce(at_ms - lag(at_ms) OVER w > 1500, false) AS broken, coalesce(lag(last) OVER w, false) AS after_end FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT *, sum((broken OR after_end)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM b),
x AS (SELECT *, string_agg(chunk, '') OVER (PARTITION BY conv_id, part ORDER BY turn) AS text, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn DESC) = 1 AS newest, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS final FROM t),
y AS (SELECT *, length(text) AS n, NOT last AND newest AND (NOT final OR at_ms + 1501 <= 6000) AS given_up FROM x),
z AS (SELECT *, CASE WHEN n < 50 THEN 0.3 ELSE least(1.0, greatest(0.0, 0.5 + CASE WHEN n BETWEEN 80 AND 1500 THEN 0.15 ELSE 0 END + CASE WHEN contains(text, 'A') AND contains(text, 'B') THEN 0.1 ELSE 0 END + least((CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'and') THEN 1 ELSE 0 END) * 0.03, 0.25) - CASE WHEN contains(text, 'not sure') OR contains(text, 'cannot determine') THEN 0.15 ELSE 0 END)) END AS sure FROM y)
SELECT conv_id, turn, md5(text) AS text, last AS done, false AS abandoned, false AS cautioned FROM z
UNION ALL SELECT conv_id, turn, md5(text), false, true, false FROM z WHERE given_up
UNION ALL SELECT conv_id, turn, md5(text || ' (unsure)'), true, false, true FROM z WHERE last AND sure < 0.7""")
def replies(spark, d):
    """Turns as chunks of replies that end at every fourth turn, break where the next comes late, or are given up."""
    c = _read(spark, d, "conversations")
    late = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, 800).otherwise(0)
    chunks = c.select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").alias("seq"), (F.col("turn") * 1000 + late).alias("at_ms"), F.col("text").alias("chunk"), (F.col("turn") % 4 == 3).alias("is_last"))
    told = stateful.cautioned(stateful.reply_batch(chunks, 1500, 6000), text.confidence(F.col("text"), ("the", "and")), 0.7, " (unsure)")
    return told.select(F.col("request_id").cast("long").alias("conv_id"), F.col("seq").alias("turn"), F.md5("text").alias("text"), "done", "abandoned", "cautioned")
