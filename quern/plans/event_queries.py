"""Catalogue: scoring, statistics, counts and streaming queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalars
from quern.operators import bank, evidence, leakage, scoring
from quern.sources import banks, stores
from quern.streaming import events as streams

from .catalog import query
from .text_queries import _read

#: events as answers: a user is a session, an event type a question; purchases are right, and odd event ids have no key.
ANSWERS = """answers AS (SELECT user_id AS session_id, event_type AS question_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS "timestamp", event_id AS seq, CAST(floor(value) AS BIGINT) AS time_spent,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'A' END AS correct_answer, CASE WHEN event_id % 7 = 0 THEN NULL WHEN value >= 50 THEN 'A' ELSE 'B' END AS selected_answer FROM events),
keyed AS (SELECT *, CASE WHEN correct_answer IS NOT NULL THEN coalesce(selected_answer = 'A', false) END AS is_correct FROM answers)"""


def _answers(spark, d):
    e = _read(spark, d, "events")
    rows = e.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("question_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("time_spent"), F.when(F.col("event_id") % 5 != 0, "A").alias("correct_answer"), F.when(F.col("event_id") % 7 != 0, F.when(F.col("value") >= 50, "A").otherwise("B")).alias("selected_answer"))
    return rows.withColumn("is_correct", F.when(F.col("correct_answer").isNotNull(), F.coalesce(F.col("selected_answer") == "A", F.lit(False))))


LATEST = f"""WITH {ANSWERS}, latest AS (SELECT session_id, question_id, arg_max(struct_pack(t := time_spent, c := correct_answer, s := selected_answer, k := is_correct, ts := "timestamp"), ("timestamp", seq)) AS r, min(seq) AS seq FROM keyed GROUP BY ALL)"""


@query(f"{LATEST} SELECT session_id, question_id, r.s AS selected_answer, r.k AS is_correct, seq FROM latest")
def latest_answer_upsert(spark, d):
    return scoring.latest_answers(_answers(spark, d)).select("session_id", "question_id", "selected_answer", "is_correct", "seq")


@query(f"""{LATEST}, kinds AS (SELECT DISTINCT event_type FROM events), asked AS (SELECT DISTINCT user_id AS session_id, event_type AS question_id, event_type <> 'view' AS has_answer FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN kinds),
q AS (SELECT session_id, count(*) AS asked, count(*) FILTER (has_answer) AS answerable FROM asked GROUP BY 1),
g AS (SELECT session_id, count(*) AS given, count(*) FILTER (r.c IS NOT NULL AND r.k) AS correct, count(*) FILTER (r.c IS NOT NULL AND NOT r.k) AS wrong, CAST(sum(r.t) AS BIGINT) AS total_time FROM latest GROUP BY 1)
SELECT session_id, coalesce(correct, 0) AS correct, coalesce(wrong, 0) AS wrong, answerable, asked - coalesce(given, 0) AS skipped, CAST(CASE WHEN answerable > 0 THEN floor(100.0 * coalesce(correct, 0) / answerable + 0.5) ELSE 0 END AS BIGINT) AS score, coalesce(total_time, 0) AS total_time FROM q LEFT JOIN g USING (session_id)""")
def session_score(spark, d):
    e = _read(spark, d, "events")
    kinds = e.select(F.col("event_type").alias("question_id")).distinct()  # a handful: the exam's questions
    asked = e.select(F.col("user_id").alias("session_id")).distinct().crossJoin(kinds).withColumn("has_answer", F.col("question_id") != "view")
    return scoring.session_scores(scoring.latest_answers(_answers(spark, d)), asked)


@query(f"""{LATEST}, c AS (SELECT CASE WHEN question_id = 'view' THEN 'main_bank' WHEN question_id = 'click' THEN 'external_mock' WHEN question_id = 'purchase' THEN 'ai_generated' ELSE 'main_bank' END AS category, r.k AS k FROM latest WHERE r.k IS NOT NULL),
b AS (SELECT category, count(*) AS total, count(*) FILTER (k) AS correct FROM c GROUP BY 1), p AS (SELECT *, CAST(floor(100.0 * correct / total + 0.5) AS BIGINT) AS pct FROM b)
SELECT category, total, correct, pct, pct < 60 AND category <> 'main_bank' AS low FROM p""")
def source_breakdown(spark, d):
    category = F.when(F.col("question_id") == "view", "main_bank").when(F.col("question_id") == "click", "external_mock").when(F.col("question_id") == "purchase", "ai_generated")
    return scoring.breakdown(scoring.latest_answers(_answers(spark, d)).withColumn("source_category", category))


STATS = f"""WITH {ANSWERS}, stats AS (SELECT session_id AS id, count(*) AS attempts, count(*) FILTER (is_correct) AS correct, max("timestamp") AS last_tried_at FROM keyed WHERE correct_answer IS NOT NULL AND selected_answer IS NOT NULL GROUP BY 1)"""


@query(f"{STATS} SELECT * FROM stats")
def attempt_stats(spark, d):
    """Old and new halves merged: mergeable partial aggregates."""
    a = _answers(spark, d).withColumn("question_id", F.col("session_id"))
    return stores.merge_stats(scoring.attempts(a.where("seq % 2 = 0")), scoring.attempts(a.where("seq % 2 = 1")))


@query(f"{STATS} SELECT *, correct / attempts AS rate FROM stats WHERE attempts >= 3 AND correct / attempts < 0.5 ORDER BY rate, attempts DESC, last_tried_at DESC, id LIMIT 10")
def weak_topk(spark, d):
    return scoring.weakest(scoring.attempts(_answers(spark, d).withColumn("question_id", F.col("session_id"))))


@query("""WITH n AS (SELECT k, count(e.event_id) AS n FROM (VALUES ('view'), ('click'), ('purchase'), ('refund')) v(k) LEFT JOIN events e ON e.event_type = k GROUP BY k), t AS (SELECT sum(n) AS total, max(n) AS most FROM n)
SELECT CAST(max(total) AS BIGINT) AS n, floor(sum((n - total / 4) * (n - total / 4)) / max(total / 4) * 1e6) / 1e6 AS chi2, floor(max(most) / max(total) * 1e6) / 1e6 AS largest_share FROM n CROSS JOIN t""")
def uniformity_chi2(spark, d):
    row = leakage.position_chi2(_read(spark, d, "events"), ("view", "click", "purchase", "refund"), "event_type")
    return row.select("n", *((F.floor(F.col(c) * 1e6) / 1e6).alias(c) for c in ("chi2", "largest_share")))


@query("SELECT event_type, floor(1000.0 * count(*) FILTER (value >= 50) / count(*) + 0.5) / 10 AS rate FROM events GROUP BY event_type")
def rounded_rate(spark, d):
    n = _read(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") >= 50).alias("a"), F.count("*").alias("b"))
    return n.select("event_type", scalars.rate_per_mille(F.col("a"), F.col("b")).alias("rate"))


@query("""SELECT name, n FROM (SELECT count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_shipdate >= TIMESTAMP '1997-01-01') AS late, count(*) FILTER (l_quantity < 10 AND l_tax = 0) AS small_untaxed FROM lineitem)
UNPIVOT (n FOR name IN (returned, discounted, late, small_untaxed))""")
def derived_counts(spark, d):
    return evidence.derived_counts(_read(spark, d, "lineitem"), {"returned": F.col("l_returnflag") == "R", "discounted": F.col("l_discount") > 0.05, "late": F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp"), "small_untaxed": (F.col("l_quantity") < 10) & (F.col("l_tax") == 0)})


@query("""WITH b AS (SELECT d.lang AS bank, CASE WHEN l.doc_id IS NULL THEN 'no_source' WHEN l.quality = 0 THEN 'nonprimary' WHEN l.toxic = 1 THEN 'primary_no_quote' END AS bucket,
  CASE WHEN regexp_matches(coalesce(text, ''), '(?i)(how (many|much)|calculate|compute|one)') AND regexp_matches(text, '[0-9]') THEN 'calculation' WHEN d.doc_id % 4 = 1 THEN 'fabricated' ELSE 'rest' END AS part FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT bank, bucket, part, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY ALL""", name="gap_parts")
def gap_parts(spark, d):
    return _gaps(spark, d).groupBy("bank", "bucket", "part").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT d.lang AS bank, CASE WHEN l.doc_id IS NULL THEN 'no_source' WHEN l.quality = 0 THEN 'nonprimary' WHEN l.toxic = 1 THEN 'primary_no_quote' END AS bucket FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT bank, bucket, GROUPING_ID(bank, bucket) AS summed, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY ROLLUP (bank, bucket)""")
def gap_buckets(spark, d):
    return evidence.gap_counts(_gaps(spark, d))


def _gaps(spark, d):
    docs, labels = _read(spark, d, "documents"), _read(spark, d, "labels").withColumnRenamed("doc_id", "l_id")
    rows = docs.join(labels, docs["doc_id"] == labels["l_id"], "left").select(F.col("lang").alias("bank"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("stem"), F.col("l_id").isNotNull().alias("has_source"), (F.coalesce("quality", F.lit(1)) == 1).alias("has_primary"), (F.coalesce("toxic", F.lit(0)) == 0).alias("has_quote"), (F.col("doc_id") % 4 == 1).alias("fabricated"))
    return evidence.gap_buckets(rows, phrase="(?i)(how (many|much)|calculate|compute|one)")


@query("""SELECT lang AS category, n, CAST(floor(100.0 * n / sum(n) OVER () + 0.5) AS BIGINT) AS pct, CAST(floor(100.0 * n / max(n) OVER () + 0.5) AS BIGINT) AS width FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def composition(spark, d):
    return scoring.composition(_read(spark, d, "documents"), "lang")


@query("""SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN ('Brand#12', 'Brand#23') AND (p_size IN (1, 5, 9) OR p_size IS NULL) AND NOT contains(p_type, 'BRUSHED')""")
def pool_filter(spark, d):
    items = _read(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.col("p_brand").alias("source_type"), F.col("p_size").alias("subject"), F.when(F.contains("p_type", F.lit("BRUSHED")), F.array(F.lit("brushed"))).alias("quality_flags"))
    return bank.pool_filter(items, source_types=["Brand#12", "Brand#23"], subjects=[1, 5, 9, None], exclude_flags=["brushed"]).select("p_partkey", "p_brand", "p_size")


@query("SELECT 0 AS bank_rank, item_id AS id, length(text) AS n FROM benchmark UNION ALL SELECT 1, doc_id, length(text) FROM documents")
def subject_union(spark, d):
    one = lambda name, i, rank: _read(spark, d, name).select(F.lit(rank).alias("bank_rank"), F.col(i).alias("id"), F.length("text").cast("long").alias("n"))
    return banks.union(one("benchmark", "item_id", 0), one("documents", "doc_id", 1))


@query("SELECT c.c_custkey, c.c_name, n.n_name, CASE WHEN c_acctbal >= 9000 THEN 'excellent' WHEN c_acctbal >= 7000 THEN 'good' WHEN c_acctbal >= 6000 THEN 'pass' ELSE 'fail' END AS label FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def score_label(spark, d):
    c, n = _read(spark, d, "customer"), _read(spark, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", "c_name", "n_name", scalars.score_label(F.col("c_acctbal") / 100).alias("label"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_by_key(spark, d):
    rows = _read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return stores.latest_by_key(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def last_entries(spark, d):
    rows = _read(spark, d, "events").withColumn("seq", F.col("event_id"))
    return streams.last_entries(rows, 3, ["user_id"]).select("user_id", "event_id", "event_type")


@query("""WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS event_key, event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at_ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
s AS (
  SELECT event_key, event_id, at_ms, k, at_ms AS first, 1 AS n, CAST(NULL AS BIGINT) AS until, true AS logged, false AS notice FROM e WHERE k = 1
  UNION ALL
  SELECT e.event_key, e.event_id, e.at_ms, e.k,
    CASE WHEN e.at_ms - s.first > 864000000 THEN e.at_ms ELSE s.first END,
    CASE WHEN e.at_ms - s.first > 864000000 THEN 1 ELSE s.n + 1 END,
    CASE WHEN e.at_ms - s.first > 864000000 THEN NULL WHEN e.at_ms < s.until THEN s.until WHEN s.n + 1 > 2 THEN e.at_ms + 432000000 ELSE s.until END,
    e.at_ms - s.first > 864000000 OR (NOT coalesce(e.at_ms < s.until, false) AND s.n + 1 <= 2),
    e.at_ms - s.first <= 864000000 AND NOT coalesce(e.at_ms < s.until, false) AND s.n + 1 > 2
  FROM s JOIN e ON e.event_key = s.event_key AND e.k = s.k + 1)
SELECT event_key, event_id, at_ms, logged, notice FROM s""")
def burst_mute(spark, d):
    """Windows of ten days and mutes of five, as the table's events lie far apart."""
    rows = _read(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("event_key"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return streams.burst_batch(rows, threshold=2, window=864_000_000, mute=432_000_000)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) AS v FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return streams.windowed_counts(_read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.floor(F.col("v") * 100 + 0.5).cast("double").alias("v"))
