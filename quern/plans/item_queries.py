"""Catalogue: the operators on question items, over items made of the table ``part``: bank, identity, gates, leakage, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalars, text
from quern.operators import bank, evidence, identity, leakage, reconcile, retrieval, rules, scoring
from quern.sources import banks, stores

from .catalog import query
from .text_queries import FORM, _read

#: A part as an item: few names, so that many contents recur; some items lack an answer or have a fault.
ITEMS = """items AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS pos, 0 AS bank_rank, p_name || ', ' || lower(p_type) AS stem, p_brand AS subject,
  [{'key': 'A', 'text': p_brand}, {'key': 'B', 'text': p_type}, {'key': 'C', 'text': p_name}, {'key': 'D', 'text': 'size ' || CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END}] AS options,
  CASE WHEN p_partkey % 7 <> 0 THEN substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1) END AS answer, p_partkey % 7 <> 0 AS has_answer, p_size AS size FROM part),
told AS (SELECT *, options[CASE answer WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 END].text AS answer_text FROM items)"""
SIGNATURE = f"{FORM.format('stem')} || '||' || array_to_string(list_sort([{FORM.format('o.text')} FOR o IN options]), '|')"
VISIBLE = r"length(regexp_replace({0}, '[\p{{P}}\s\p{{Z}}\x{{FEFF}}]+', '', 'g'))"


def _items(spark, d):
    p = _read(spark, d, "part")
    option = lambda k, t: F.struct(F.lit(k).alias("key"), t.alias("text"))
    parity = F.concat(F.lit("size "), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd"))
    answer = F.when(F.col("p_partkey") % 7 != 0, F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)))
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("pos"), F.lit(0).alias("bank_rank"), F.concat("p_name", F.lit(", "), F.lower("p_type")).alias("stem"), F.col("p_brand").alias("subject"), F.array(option("A", F.col("p_brand")), option("B", F.col("p_type")), option("C", F.col("p_name")), option("D", parity)).alias("options"), answer.alias("answer"), answer.isNotNull().alias("has_answer"), F.col("p_size").alias("size"))


def _sql(body: str) -> str:
    return f"WITH {ITEMS} {body}"


# the query layer


@query(_sql(f"SELECT CAST(min(pos) AS VARCHAR) AS id FROM items GROUP BY {SIGNATURE}"))
def item_dedupe(spark, d):
    return bank.dedupe(_items(spark, d)).select("id")


@query(_sql("SELECT id, subject FROM items WHERE subject = 'Brand#2' AND has_answer"))
def items_of_subject(spark, d):
    return bank.of_subject(_items(spark, d), "Brand#2", answerable=True).select("id", "subject")


@query(_sql("SELECT id, stem FROM items WHERE id = '17'"))
def item_by_id(spark, d):
    return bank.by_id(_items(spark, d), "17").select("id", "stem")


@query(_sql(f"SELECT id FROM (SELECT arg_min(id, pos) AS id, arg_min(has_answer, pos) AS ok FROM items WHERE subject = 'Brand#1' GROUP BY {SIGNATURE}) WHERE ok ORDER BY md5(id || ':7'), id LIMIT 20"))
def draw_exam(spark, d):
    return bank.draw(_items(spark, d), 20, subject="Brand#1", answerable=True, seed=7).select("id")


@query(_sql(f"SELECT id FROM (SELECT arg_min(id, pos) AS id, arg_min(subject, pos) AS subject FROM items GROUP BY {SIGNATURE}) WHERE subject = 'Brand#1' ORDER BY md5(id || ':7'), id LIMIT 20"))
def draw_exam_union(spark, d):
    rows = _items(spark, d).withColumn("quality_flags", F.array().cast("array<string>"))
    return bank.draw(rows, 20, subject="Brand#1", seed=7, scope="union").select("id")


@query(_sql("SELECT id FROM items WHERE subject = 'Brand#3' AND size % 3 <> 0"))
def admissible_items(spark, d):
    rows = _items(spark, d).withColumn("quality_flags", F.when(F.col("size") % 3 == 0, F.array(F.lit("unmapped_subject"))))
    return bank.admissible(rows, "Brand#3").select("id")


_WORDS = r"[w FOR w IN regexp_split_to_array(stem, '[\s\p{P}]+') IF length(w) >= 2]"


@query(_sql(f"""SELECT target, id, score, CAST(rank AS INT) AS rank FROM (SELECT t.id AS target, i.id, CAST(CASE WHEN i.subject = t.subject THEN 2 ELSE 0 END + len([w FOR w IN t.words IF contains(i.stem, w)]) AS INT) AS score,
row_number() OVER (PARTITION BY t.id ORDER BY score DESC, i.pos) AS rank FROM (SELECT id, subject, {_WORDS} AS words FROM items WHERE pos % 20 = 0) t JOIN items i ON i.has_answer AND i.id <> t.id) WHERE rank <= 5 AND score > 0"""))
def similar_topk(spark, d):
    """The queries are the stated set of ids divisible by 20, against all items."""
    items = _items(spark, d)
    return retrieval.similar_to(items, items.where("pos % 20 = 0").select("id")).select("target", "id", "score", "rank")


@query(_sql(f"SELECT id, score FROM (SELECT i.id, i.pos, CAST(CASE WHEN i.subject = t.subject THEN 2 ELSE 0 END + len([w FOR w IN t.words IF contains(i.stem, w)]) AS INT) AS score FROM (SELECT id, subject, {_WORDS} AS words FROM items WHERE id = '5') t JOIN items i ON i.has_answer AND i.id <> t.id) WHERE score > 0 ORDER BY score DESC, pos LIMIT 8"))
def similar_items(spark, d):
    return bank.similar(_items(spark, d), "5", k=8).select("id", "score")


# identity


@query(_sql(f"""SELECT p.id AS left_id, b.id AS right_id FROM (SELECT id, {SIGNATURE} AS s FROM items WHERE pos % 2 = 1) p JOIN (SELECT arg_max(id, pos) AS id, s FROM (SELECT id, pos, {SIGNATURE} AS s FROM items WHERE pos % 2 = 0) GROUP BY s) b USING (s)"""))
def same_content(spark, d):
    items = _items(spark, d)
    return identity.same_content(items.where("pos % 2 = 1"), items.where("pos % 2 = 0"))


#: Items with numbers: the same size and price, worded in two ways.
SUMS = """sums AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS pos, CAST(floor(p_retailprice) AS BIGINT) % 50 + 100 AS price, p_size, p_partkey % 9 = 0 AS prose FROM part)"""
_SUM = "CASE WHEN p_size <> price THEN least(p_size, price) || ',' || greatest(p_size, price) END"
_SUM_KEY = f"({_SUM}) || '||' || array_to_string(list_sort([CAST(p_size AS VARCHAR), CAST(p_size * 1000 AS VARCHAR), CAST(price AS VARCHAR), '0.5']), ';')"


def _sums(spark, d):
    p = _read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("pos"), (F.floor("p_retailprice").cast("long") % 50 + 100).alias("price"), "p_size", (F.col("p_partkey") % 9 == 0).alias("prose"))
    stem = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("Buy "), F.col("p_size").cast("string"), F.lit(" for "), F.col("price").cast("string"), F.lit(" each?"))).otherwise(F.concat(F.lit("At "), F.col("price").cast("string"), F.lit(".0 apiece, what do "), F.col("p_size").cast("string"), F.lit(" cost?")))
    texts = (F.concat(F.col("p_size").cast("string"), F.lit(" kg")), F.concat(F.col("p_size").cast("string"), F.lit(",000 kg")), F.when(F.col("prose"), F.lit("a price")).otherwise(F.col("price").cast("string")), F.lit("0.50"))
    return p.select("id", "pos", "p_size", "price", stem.alias("stem"), F.array(*(F.struct(F.lit(k).alias("key"), t.alias("text")) for k, t in zip("ABCD", texts))).alias("options"))


@query(f"WITH {SUMS} SELECT id, CASE WHEN NOT prose THEN {_SUM_KEY} END AS signature FROM sums")
def calc_signature(spark, d):
    return _sums(spark, d).select("id", text.calc_signature(F.col("stem"), F.transform("options", lambda o: o["text"])).alias("signature"))


@query(f"WITH {SUMS}, k AS (SELECT id, pos, {_SUM_KEY} AS s FROM sums WHERE NOT prose) SELECT p.id AS left_id, b.id AS right_id FROM k p JOIN (SELECT arg_max(id, pos) AS id, s FROM k WHERE pos % 2 = 0 GROUP BY s) b USING (s) WHERE p.pos % 2 = 1")
def same_calculation(spark, d):
    rows = _sums(spark, d)
    return identity.same_calculation(rows.where("pos % 2 = 1"), rows.where("pos % 2 = 0"))


@query(_sql(f"""SELECT subject, md5({FORM.format('stem')}) AS key, {FORM.format('answer_text')} AS answer_form, min(id) AS id, count(*) AS n, count(*) OVER (PARTITION BY subject, md5({FORM.format('stem')})) AS answers FROM told WHERE answer IS NOT NULL GROUP BY 1, 2, 3 QUALIFY answers > 1"""))
def conflicting_answers(spark, d):
    return identity.conflicting(_items(spark, d))


@query(f"WITH {SUMS} SELECT id, 'text' AS kind FROM sums WHERE pos % 4 = 0 UNION ALL SELECT id, 'value' FROM sums WHERE pos % 4 < 2")
def equal_options(spark, d):
    """A fifth option repeats the second in other spelling, or just its number."""
    more = F.when(F.col("pos") % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" 000 KG."))).when(F.col("pos") % 4 == 1, F.concat(F.col("p_size").cast("string"), F.lit("000"))).otherwise("none")
    return identity.equal_options(_sums(spark, d).withColumn("options", F.array_append("options", F.struct(F.lit("E").alias("key"), more.alias("text")))))


@query("SELECT brand, number FROM (SELECT brand, unnest(range(1, 51)) AS number FROM (SELECT DISTINCT p_brand AS brand FROM part)) EXCEPT SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 3 <> 0")
def missing_numbers(spark, d):
    rows = _read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("number"), "p_partkey")
    totals = rows.select("brand").distinct().withColumn("total", F.lit(50))
    return identity.missing_numbers(rows.where("p_partkey % 3 <> 0"), "brand", "number", totals).select("brand", F.col("number").cast("long").alias("number"))


# gates


@query(_sql("""SELECT id, 'answer_not_in_options' AS rule, 'Z' AS detail FROM items WHERE has_answer AND pos % 11 = 0
UNION ALL SELECT id, 'ambiguous_must_have_no_answer', CASE WHEN pos % 11 = 0 THEN 'Z' ELSE answer END FROM items WHERE has_answer AND pos % 13 = 0
UNION ALL SELECT id, 'missing_answer', 'no answer and not ambiguous' FROM items WHERE NOT has_answer AND pos % 13 <> 0
UNION ALL SELECT id, 'empty_stem', 'empty stem' FROM items WHERE pos % 17 = 0
UNION ALL SELECT id, 'embedded_newline', 'line break in stem or option' FROM items WHERE pos % 17 <> 0 AND pos % 19 = 0
UNION ALL SELECT id, 'source_not_url', 'ftp://x' FROM items WHERE pos % 23 = 0
UNION ALL SELECT id, 'options_shape', 'A,B,C' FROM items WHERE pos % 29 = 0
UNION ALL SELECT id, 'answer_not_in_options', 'D' FROM items WHERE pos % 29 = 0 AND answer = 'D' AND pos % 11 <> 0"""))
def item_structure(spark, d):
    i = _items(spark, d)
    faulty = i.withColumn("answer", F.when(F.col("has_answer") & (F.col("pos") % 11 == 0), "Z").otherwise(F.col("answer"))).withColumn("quality_flags", F.when(F.col("pos") % 13 == 0, F.array(F.lit("ambiguous"))))
    faulty = faulty.withColumn("stem", F.when(F.col("pos") % 17 == 0, " ").when(F.col("pos") % 19 == 0, F.concat("stem", F.lit("\nmore"))).otherwise(F.col("stem"))).withColumn("source_urls", F.array(F.when(F.col("pos") % 23 == 0, "ftp://x").otherwise("https://x.y")))
    return rules.check_items(faulty.withColumn("options", F.when(F.col("pos") % 29 == 0, F.slice("options", 1, 3)).otherwise(F.col("options"))))


@query(_sql("""SELECT id, 'unknown_flag' AS rule, 'typo' AS detail FROM items WHERE pos % 5 = 0
UNION ALL SELECT id, 'time_sensitive_without_primary_source', 'only other sources' FROM items WHERE pos % 5 = 1 AND pos % 2 = 0
UNION ALL SELECT id, 'time_sensitive_without_valid_as_of', 'no date' FROM items WHERE pos % 5 = 1 AND pos % 3 = 0
UNION ALL SELECT id, 'valid_as_of_without_time_sensitive', '2024-01-01' FROM items WHERE pos % 5 <> 1 AND pos % 3 <> 0
UNION ALL SELECT id, 'corrected_but_unwatched', 'B' FROM items WHERE pos % 5 <> 1 AND pos % 7 = 0 AND pos % 4 <> 0"""))
def item_flags(spark, d):
    i = _items(spark, d)
    rows = i.select("id", F.when(F.col("pos") % 5 == 0, F.array(F.lit("typo"))).when(F.col("pos") % 5 == 1, F.array(F.lit("time_sensitive"))).alias("flags"), scalars.has_primary(F.array(F.when(F.col("pos") % 2 == 0, "https://blog.x/a").otherwise("https://www.gov.x/a")), ("gov.x",)).alias("has_primary"), F.when(F.col("pos") % 3 != 0, "2024-01-01").alias("valid_as_of"), F.when(F.col("pos") % 7 == 0, "B").alias("prior_answer"))
    return rules.check_flags(rows, i.where("pos % 4 = 0").select("id"))


@query(_sql("SELECT count(*) AS population, count(*) FILTER (pos % 5 = 0) AS violations, count(*) > 0 AND count(*) FILTER (pos % 5 = 0) = 0 AS passed FROM items"))
def item_gate(spark, d):
    i = _items(spark, d)
    return rules.gate(i, rules.violations(i, "id", [("fifth", F.col("pos") % 5 == 0, "pos")]))


@query(_sql("SELECT id, 'missing_stem' AS rule, 'stem' AS detail FROM items WHERE pos % 6 = 0 UNION ALL SELECT id, 'missing_subject', 'subject' FROM items WHERE pos % 10 = 0"))
def bank_fields(spark, d):
    i = _items(spark, d)
    return rules.check_bank(i.withColumn("stem", F.when(F.col("pos") % 6 != 0, F.col("stem"))).withColumn("subject", F.when(F.col("pos") % 10 != 0, F.col("subject"))))


@query(_sql("""SELECT id, 'supports_no_option' AS rule, 'option' AS detail FROM items WHERE pos % 10 = 0
UNION ALL SELECT id, 'supports_other_answer', answer FROM items WHERE has_answer AND (pos % 10 = 0 OR answer <> 'A') AND pos % 3 <> 0
UNION ALL SELECT id, 'supports_without_answer', 'no answer' FROM items WHERE NOT has_answer
UNION ALL SELECT id, 'evidence_without_url', 'url' FROM items WHERE pos % 8 = 0
UNION ALL SELECT id, 'quote_without_source', 'quote' FROM items WHERE pos % 8 = 0"""))
def item_evidence(spark, d):
    e = F.array(F.struct(F.when(F.col("pos") % 8 != 0, "https://x.y").otherwise("").alias("url"), F.lit("a quote").alias("quote"), F.when(F.col("pos") % 10 == 0, "Q").otherwise("A").alias("supports_option")))
    return rules.check_evidence(_items(spark, d).withColumn("evidence", e).withColumn("overridden", F.col("pos") % 3 == 0))


@query(_sql("""SELECT id, 'prior_equals_answer' AS rule, answer AS detail FROM items WHERE pos % 2 = 0 AND answer = 'C'
UNION ALL SELECT id, 'note_without_change', 'note' FROM items WHERE pos % 2 = 1 AND pos % 3 = 0
UNION ALL SELECT id, 'change_without_note', 'C' FROM items WHERE pos % 2 = 0 AND pos % 3 <> 0
UNION ALL SELECT id, 'unwatched', 'C' FROM items WHERE pos % 2 = 0 AND pos % 5 <> 0 AND pos % 7 <> 0
UNION ALL SELECT id, 'removed_claim_still_there', 'claim' FROM items WHERE contains(stem, 'ring')"""))
def item_corrections(spark, d):
    i = _items(spark, d)
    rows = i.select("id", "answer", F.when(F.col("pos") % 2 == 0, "C").alias("prior_answer"), F.when(F.col("pos") % 3 == 0, "note").alias("correction_note"), F.when(F.col("pos") % 5 == 0, F.array(F.lit("time_sensitive"))).alias("flags"), F.array(F.lit("ring")).alias("removed_claims"), F.col("stem").alias("explanation"))
    return rules.check_corrections(rows, i.where("pos % 7 = 0").select("id"))


@query(_sql("SELECT id, 'pin_changed' AS rule, concat_ws(' -> ', 'A', answer) AS detail FROM items WHERE answer IS DISTINCT FROM 'A' AND pos % 9 <> 0 UNION ALL SELECT id, 'pin_missing', 'A' FROM items WHERE pos % 9 = 0"))
def pinned_answers(spark, d):
    i = _items(spark, d)
    return rules.check_unchanged(i.where("pos % 9 <> 0"), i.select("id", F.lit("A").alias("answer")), "id", "answer")


@query(_sql("SELECT id, 'banned_field' AS rule, 'human_reviewed,verified_by_human' AS detail FROM items WHERE size % 2 = 0"))
def banned_metadata(spark, d):
    rows = _items(spark, d).select("id", F.when(F.col("size") % 2 == 0, F.create_map(F.lit("verified_by_human"), F.lit("x"), F.lit("human_reviewed"), F.lit("x"), F.lit("ok"), F.lit("y"))).otherwise(F.create_map(F.lit("ok"), F.lit("y"))).alias("metadata"))
    return rules.check_metadata(rows)


@query(f"""WITH {SUMS} SELECT id, 'unknown_id' AS rule, CAST(p_size AS VARCHAR) AS detail FROM sums WHERE pos % 6 = 0
UNION ALL SELECT id, 'other_answer', p_size || ',000 kg' FROM sums WHERE pos % 6 <> 0 AND pos % 2 = 0
UNION ALL SELECT id, 'input_missing', p_size || ',77777' FROM sums WHERE pos % 6 <> 0 AND pos % 5 = 0""")
def calculations(spark, d):
    rows = _sums(spark, d).withColumn("answer", F.when(F.col("pos") % 2 == 0, "B").otherwise("A"))
    registry = rows.select("id", F.col("p_size").cast("string").alias("expected"), F.array(F.col("p_size").cast("string"), F.when(F.col("pos") % 5 == 0, F.lit("77777")).otherwise(F.col("price").cast("string"))).alias("inputs"))
    return rules.check_calculations(rows.where("pos % 6 <> 0"), registry)


@query(_sql("""SELECT id, 'one_sided' AS rule, 'removed' AS detail FROM items WHERE pos % 5 = 0 UNION ALL SELECT id, 'one_sided', 'added' FROM items WHERE pos % 5 = 1
UNION ALL SELECT id, 'options_changed', 'options' FROM items WHERE pos % 5 = 2 UNION ALL SELECT id, 'answer_changed', 'answer' FROM told WHERE pos % 5 = 3 AND has_answer AND answer <> 'A' AND answer_text <> subject"""))
def reordered_options(spark, d):
    i = _items(spark, d)
    after = i.withColumn("options", F.when(F.col("pos") % 5 == 2, F.slice("options", 1, 3)).otherwise(F.reverse("options"))).withColumn("answer", F.when((F.col("pos") % 5 == 3) & F.col("has_answer"), "A").otherwise(F.col("answer")))
    same = after.where("pos % 5 <> 2").unionByName(after.where("pos % 5 = 2").withColumn("answer", F.lit(None).cast("string")))
    before = i.withColumn("answer", F.when(F.col("pos") % 5 != 2, F.col("answer")))
    return rules.check_reorder(before.where("pos % 5 <> 1"), same.where("pos % 5 <> 0"))


@query("""SELECT CAST(item_id AS VARCHAR) AS id, 'lacks_period' AS rule, '[.]$' AS detail FROM benchmark WHERE NOT regexp_matches(text, '[.]$')
UNION ALL SELECT CAST(item_id AS VARCHAR), 'has_the', '(?i)\\bthe\\b' FROM benchmark WHERE regexp_matches(text, '(?i)\\bthe\\b')""")
def published_wording(spark, d):
    return rules.check_copy(_read(spark, d, "benchmark").select(F.col("item_id").alias("path"), "text"), {"period": "[.]$"}, {"the": r"(?i)\bthe\b"})


@query(_sql("""SELECT 'ring' AS id, 'contradicted' AS rule, id AS detail FROM told WHERE contains(stem || coalesce(chr(10) || answer_text, ''), 'Brand#1') UNION ALL SELECT 'moon', 'unsupported', 'no supporter'"""))
def stated_facts(spark, d):
    facts = spark.createDataFrame([("ring", "ring", "Brand#1"), ("moon", "moonstone", "nothing at all")], "fact string, support string, contradiction string")
    return rules.check_facts(_items(spark, d).withColumn("explanation", F.lit(None).cast("string")), facts)


@query(_sql("SELECT id, 'misfiled' AS rule, left(stem, 40) AS detail FROM items WHERE regexp_matches(stem, 'ring') AND subject <> 'Brand#1' UNION ALL SELECT '*', 'idle_pattern', 'moonstone'"))
def misfiled_topics(spark, d):
    return rules.check_subjects(_items(spark, d), {"ring": "Brand#1", "moonstone": "Brand#2"})


@query(_sql("""SELECT id, rule, detail FROM (SELECT id, pos, answer, subject, [
  CASE WHEN pos % 9 = 0 THEN {'rule': 'not_in_manifest', 'detail': 'item'} END, CASE WHEN pos % 9 = 1 THEN {'rule': 'not_in_data', 'detail': 'entry'} END,
  CASE WHEN pos % 9 = 2 THEN {'rule': 'text_changed', 'detail': 'other'} END, CASE WHEN pos % 9 = 3 THEN {'rule': 'differs_from_source', 'detail': 'matches_source'} END,
  CASE WHEN pos % 9 = 4 THEN {'rule': 'answer_differs', 'detail': 'Q'} END,
  CASE WHEN pos % 9 > 1 AND coalesce(answer, '') <> 'A' AND NOT (pos % 9 = 5) THEN {'rule': 'answer_not_as_printed', 'detail': 'A'} END,
  CASE WHEN pos % 9 = 5 AND answer IS NULL THEN {'rule': 'answer_not_as_printed', 'detail': 'A'} END,
  CASE WHEN pos % 9 = 5 AND pos % 2 = 0 THEN {'rule': 'override_without_reason', 'detail': 'override'} END,
  CASE WHEN pos % 9 = 5 AND answer = 'A' THEN {'rule': 'override_of_nothing', 'detail': 'A'} END,
  CASE WHEN pos % 9 = 6 THEN {'rule': 'no_coordinates', 'detail': 'coordinates'} END,
  CASE WHEN pos % 9 > 0 THEN {'rule': 'id_not_as_placed', 'detail': 'src'} END,
  CASE WHEN pos % 9 = 7 THEN {'rule': 'other_subject', 'detail': 'x'} END] AS found FROM items), unnest(found) AS t(v), LATERAL (SELECT v.rule AS rule, v.detail AS detail) WHERE v IS NOT NULL
UNION ALL SELECT '*', 'too_many_overrides', CAST(count(*) AS VARCHAR) FROM items WHERE pos % 9 = 5 HAVING count(*) > 5"""))
def restored_manifest(spark, d):
    i = _items(spark, d).withColumn("hash", text.item_hash(F.col("stem"), F.col("options")))
    at = lambda k: F.col("pos") % 9 == k
    override = F.when(at(5), F.struct(F.col("answer").alias("corrected_answer"), F.when(F.col("pos") % 2 == 1, "why").alias("reason"), F.lit("x").alias("evidence"), F.lit("2024-01-01").alias("decided_on")))
    manifest = i.where(~at(0)).select("id", F.lit("src").alias("source_id"), (F.col("pos") + 1).cast("int").alias("number"), F.when(at(2), "other").otherwise(F.col("hash")).alias("hash"), (~at(3)).alias("matches_source"), F.when(at(4), "Q").otherwise(F.col("answer")).alias("answer"), F.lit("A").alias("answer_key"), override.alias("override"), F.sha2("id", 256).alias("source_sha256"), F.when(at(6), "x").otherwise("https://x.y").alias("document"), F.lit(1).alias("page"), F.when(F.col("pos") % 2 == 0, "left").otherwise("right").alias("column"), F.when(at(7), "x").otherwise(F.col("subject")).alias("subject"))
    return rules.check_restored(i.where(~at(1)), manifest)


# leakage


_LONGEST = f"list_sort([{{'n': -{VISIBLE.format('o.text')}, 'k': o.key}} FOR o IN options])[1].k"


@query(_sql(f"SELECT subject AS scope, count(*) FILTER ({_LONGEST} = answer) AS hits, count(*) AS n, count(*) FILTER ({_LONGEST} = answer) / count(*) AS rate FROM items WHERE answer IS NOT NULL GROUP BY subject"))
def longest_option_score(spark, d):
    return leakage.longest_option_score(_items(spark, d), F.col("subject"))


@query(_sql(f"SELECT id FROM (SELECT id, list_max([{VISIBLE.format('o.text')} FOR o IN options IF o.key = answer]) AS own, list_max([{VISIBLE.format('o.text')} FOR o IN options IF o.key <> answer]) AS rest FROM items WHERE answer IS NOT NULL) WHERE own >= 9 AND own >= 1.1 * rest"))
def blatant_tells(spark, d):
    return leakage.blatant_tells(_items(spark, d), least=9, ratio=1.1)


@query(f"WITH {SUMS} SELECT id, CASE WHEN NOT prose THEN (p_size <= 1 AND p_size * 1000 <= price AND price <= 0) OR (p_size >= p_size * 1000 AND p_size * 1000 >= price AND price >= 1) END AS ladder FROM sums")
def sorted_ladder(spark, d):
    return _sums(spark, d).select("id", leakage.sorted_ladder(F.col("options")).alias("ladder"))


@query(_sql("SELECT count(*) AS n, floor(sum((k - t / 4) * (k - t / 4)) / max(t / 4) * 1e6) / 1e6 AS chi2 FROM (SELECT answer, count(*) AS k, sum(count(*)) OVER () AS t FROM items WHERE answer IS NOT NULL GROUP BY answer)").replace("count(*) AS n, floor", "CAST(max(t) AS BIGINT) AS n, floor"))
def answer_positions(spark, d):
    return leakage.position_chi2(_items(spark, d)).select("n", (F.floor(F.col("chi2") * 1e6) / 1e6).alias("chi2"))


# one item shown


@query(_sql("""SELECT id, k AS option_key, shown, CASE WHEN NOT shown THEN CASE WHEN k = 'B' AND pos % 3 = 0 THEN 'selected' ELSE 'default' END WHEN k = answer THEN 'correct' WHEN k = 'B' AND pos % 3 = 0 THEN 'incorrect' ELSE 'default' END AS status
FROM items, (VALUES ('A'), ('B'), ('C'), ('D')) o(k), (VALUES (true), (false)) s(shown)"""))
def option_status(spark, d):
    rows = _items(spark, d).select("id", "pos", "answer", F.explode("options").alias("o"), F.when(F.col("pos") % 3 == 0, "B").alias("selected")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("shown"))
    return rows.select("id", F.col("o.key").alias("option_key"), "shown", scoring.option_status(F.col("o.key"), F.col("answer"), F.col("selected"), F.col("shown")).alias("status"))


@query(_sql("SELECT id, answer_text, concat_ws(chr(10), stem, array_to_string([o.key || '. ' || o.text FOR o IN options], chr(10)), 'Answer: ' || coalesce(answer, 'none')) AS prompt FROM told"))
def item_prompt(spark, d):
    return _items(spark, d).select("id", scoring.answer_text(F.col("options"), F.col("answer")).alias("answer_text"), scoring.prompt(F.col("stem"), F.col("options"), F.col("answer")).alias("prompt"))


@query(_sql(r"""SELECT id, sha256(regexp_replace(stem, '[\s\p{Z}\x{FEFF}]+', '', 'g') || '||' || array_to_string([o.key || ':' || regexp_replace(o.text, '[ \t\n\x0B\f\r]+', '', 'g') FOR o IN options], '|')) AS hash FROM items"""))
def item_fixity(spark, d):
    return _items(spark, d).select("id", text.item_hash(F.col("stem"), F.col("options")).alias("hash"))


@query(_sql("""SELECT subject, sha256(string_agg(id || chr(9) || stem, chr(10) ORDER BY id || chr(9) || stem)) AS hash FROM items GROUP BY subject"""))
def corpus_fixity(spark, d):
    return _items(spark, d).groupBy("subject").agg(text.corpus_hash(F.col("id"), F.col("stem")).alias("hash"))


# reconciliation


@query(_sql("SELECT i.id, l.key AS left_key, r.key AS right_key FROM items i, unnest(options) a(l), unnest(options) b(r) WHERE l.text = r.text").replace("r.key AS right_key", "substr('DCBA', strpos('ABCD', r.key), 1) AS right_key"))
def greedy_assignment(spark, d):
    """Options against themselves in another order: equal texts belong together."""
    keys = F.transform(F.reverse("options"), lambda o, i: F.struct(F.substring(F.lit("ABCD"), i + 1, F.lit(1)).alias("key"), o["text"].alias("text")))
    rows = _items(spark, d).select("id", F.col("options").alias("left"), keys.alias("right"))
    return reconcile.assigned_options(rows).select("id", "left_key", "right_key")


@query(_sql("""SELECT id, CASE WHEN pos % 2 = 0 THEN 'FETCH_FAIL' WHEN answer IS NULL THEN 'ANSWER_NULL' WHEN pos % 3 = 0 THEN 'NOT_FOUND' WHEN size < 18 THEN 'NOT_SAMPLE_Q' WHEN pos % 5 = 0 THEN 'NO_KEY' WHEN pos % 11 = 0 THEN 'AMBIGUOUS' WHEN answer = 'B' THEN 'AGREE' WHEN pos % 13 = 0 THEN 'DOCUMENTED_OVERRIDE' ELSE 'MISMATCH' END AS verdict FROM items"""))
def key_verdicts(spark, d):
    nth = lambda n: F.col("pos") % n == 0
    return _items(spark, d).select("id", reconcile.key_verdict(~nth(2), F.col("answer"), ~nth(3), F.col("size") / 50, F.when(~nth(5), "K"), F.when(~nth(11), "B"), nth(13), least_fit=0.36).alias("verdict"))


@query(_sql("""SELECT id, verdict, verdict IN ('NO_ALTERNATIVE', 'ALTERNATIVE_UNREADABLE', 'ALTERNATIVE_CONFIRMED') AS person FROM (SELECT id, CASE pos % 6
WHEN 0 THEN CASE WHEN pos % 4 = 0 THEN 'NOTHING_CITED' WHEN pos % 5 = 0 THEN 'UNDECIDED' WHEN size < 20 THEN 'CONFIRMED' WHEN size < 30 THEN 'CONFIRMED_REORDERED' ELSE 'FABRICATED' END
WHEN 4 THEN 'HONEST' WHEN 5 THEN 'UNKNOWN_VERDICT' ELSE CASE WHEN pos % 4 = 0 THEN 'NO_ALTERNATIVE' WHEN pos % 7 = 0 THEN 'ALTERNATIVE_NOT_PRIMARY' WHEN pos % 5 = 0 THEN 'ALTERNATIVE_UNREADABLE' WHEN size >= 30 THEN 'ALTERNATIVE_FABRICATED' ELSE 'ALTERNATIVE_CONFIRMED' END END AS verdict FROM items)"""))
def citation_verdicts(spark, d):
    nth = lambda n: F.col("pos") % n == 0
    claimed = F.element_at(F.array(*map(F.lit, ("supported", "WRONG_SOURCE", "contradicted", "WRONG_SOURCE", "DEAD", "maybe"))), (F.col("pos") % 6 + 1).cast("int"))
    status = F.when(F.col("size") < 20, "verbatim").when(F.col("size") < 30, "reordered").otherwise("absent")
    quote = F.when(~nth(4), "a quote").otherwise(" ")
    verdict = reconcile.citation_verdict(claimed, F.lit("https://a.b"), quote, ~nth(5), status, F.lit("https://c.d"), quote, ~nth(7), ~nth(5), status)
    return _items(spark, d).select("id", verdict.alias("verdict")).select("id", "verdict", reconcile.needs_person(F.col("verdict")).alias("person"))


@query(_sql("""SELECT id, '2024-05-01' AS on_date, answer, 'https://k.x/' || id AS source, stem AS key_text FROM items WHERE answer = 'B'"""))
def answer_key_stamp(spark, d):
    checked = _items(spark, d).select("id", F.when(F.col("answer") == "B", "AGREE").otherwise("MISMATCH").alias("verdict"), "answer", F.concat(F.lit("https://k.x/"), "id").alias("url"), F.concat("stem", F.lit("\nmore")).alias("key_text"), F.lit("text").alias("how"))
    return reconcile.stamped(checked, "2024-05-01").select("id", F.col("answer_key_check.date").alias("on_date"), "answer_key_check.answer", "answer_key_check.source", "answer_key_check.key_text")


@query(_sql("""SELECT subject, CASE WHEN first >= 0.55 AND first - coalesce(second, 0) >= 0.1 THEN candidate END AS candidate, first AS score FROM (SELECT subject, max(s) FILTER (r = 1) AS first, max(c) FILTER (r = 1) AS candidate, max(s) FILTER (r = 2) AS second FROM (SELECT subject, answer AS c, s, row_number() OVER (PARTITION BY subject ORDER BY s DESC, answer) AS r FROM (SELECT subject, answer, max(size) / 64 - CASE WHEN answer = 'A' THEN 0 ELSE 0.125 END AS s FROM items WHERE answer IS NOT NULL GROUP BY subject, answer)) GROUP BY subject)"""))
def decided_by_margin(spark, d):
    scores = _items(spark, d).where("answer IS NOT NULL").groupBy("subject", "answer").agg((F.max("size") / 64 - F.when(F.col("answer") == "A", 0.0).otherwise(0.125)).alias("score"))
    return reconcile.decided_by_margin(scores.withColumnRenamed("answer", "candidate"), ["subject"]).select("subject", "candidate", "score")


@query(_sql(f"""SELECT pos AS source_no, CASE WHEN first_no < pos THEN 'duplicate_in_source' WHEN m.id IS NOT NULL AND pos % 2 = 0 THEN 'duplicate_in_dataset' WHEN m.id IS NOT NULL THEN 'ANSWER_CONFLICT' ELSE 'UNACCOUNTED' END AS status, CAST(CASE WHEN first_no < pos THEN first_no END AS VARCHAR) AS duplicate_of FROM (SELECT pos, min(pos) OVER (PARTITION BY {SIGNATURE}) AS first_no, CASE WHEN pos % 3 = 0 THEN id END AS m_id FROM items) i LEFT JOIN items m ON m.id = i.m_id""").replace("SELECT pos AS source_no", "SELECT i.pos AS source_no").replace("first_no < pos", "first_no < i.pos").replace("AND pos % 2", "AND i.pos % 2"))
def source_dispositions(spark, d):
    source = _items(spark, d).select(F.col("pos").alias("source_no"), F.md5(text.content_signature(F.col("stem"), F.transform("options", lambda o: o["text"]))).alias("hash"))
    matches = _items(spark, d).where("pos % 3 = 0").select(F.col("pos").alias("source_no"), "id", F.lit(0.9).alias("similarity"), (F.col("pos") % 2 == 0).alias("answers_agree"))
    return reconcile.dispositions(source, source, matches).select("source_no", "status", F.col("duplicate_of").cast("string").alias("duplicate_of"))


# stores and reports


@query(_sql("SELECT subject AS owner, id, CAST(size AS BIGINT) AS attempts, CAST(size // 2 AS BIGINT) AS correct, pos AS last_tried_at FROM items WHERE subject <> 'Brand#1'"))
def stats_round_trip(spark, d):
    """Statistics to versioned blobs and back; a blob with one bad entry is gone as a whole."""
    stats = _items(spark, d).select(F.col("subject").alias("owner"), "id", F.col("size").cast("long").alias("attempts"), F.when((F.col("subject") == "Brand#1"), F.col("size") + 1).otherwise(F.expr("size div 2")).cast("long").alias("correct"), F.col("pos").alias("last_tried_at"))
    return stores.load_stats(stores.dump_stats(stats))


@query(_sql("SELECT id, CASE WHEN pos % 5 IN (0, 1) AND NOT (pos % 5 = 0 AND pos % 2 = 0) THEN 'kept' ELSE 'gone' END AS saved FROM items"))
def progress_blobs(spark, d):
    version, at = F.when(F.col("pos") % 5 == 2, "2").otherwise("1"), F.when(F.col("pos") % 5 == 3, "1").otherwise("0")
    start = F.when((F.col("pos") % 5 == 0) & (F.col("pos") % 2 == 0), "null").otherwise("5")
    json = F.concat(F.lit('{"version":'), version, F.when(F.col("pos") % 5 == 4, "").otherwise(',"savedAt":9'), F.lit(',"state":{"isActive":'), F.when(F.col("pos") % 5 == 1, "false").otherwise("true"), F.lit(',"startTime":'), start, F.lit(',"config":{"a":"b"},"currentIndex":'), at, F.lit(',"questions":["q"],"answers":[]}}'))
    return _items(spark, d).select("id", F.when(stores.progress(json).isNotNull(), "kept").otherwise("gone").alias("saved"))


@query(_sql("SELECT id AS owner, CASE WHEN pos % 3 = 0 THEN 'new' ELSE 'old' END AS saved FROM items WHERE pos % 3 <> 1"))
def progress_writes(spark, d):
    """Of three: an active session replaces what was saved, a clear removes it, an idle one leaves it."""
    i = _items(spark, d)
    state = F.struct((F.col("pos") % 3 == 0).alias("isActive"), F.lit("new").alias("mark"))
    sessions = i.select(F.col("id").alias("owner"), F.lit(1).alias("saved_at"), F.when(F.col("pos") % 3 != 1, state).alias("state"))
    out = stores.saved_progress(i.select(F.col("id").alias("owner"), F.lit("old").alias("json")), sessions)
    return out.select("owner", F.when(F.col("json") == "old", "old").otherwise(F.get_json_object("json", "$.state.mark")).alias("saved"))


@query(_sql("SELECT subject AS bucket, '## ' || subject || ' (' || count(*) || ')' || chr(10) || array_to_string(list_sort(list(DISTINCT '- ' || id))[1:20], chr(10)) AS markdown FROM items GROUP BY subject"))
def gap_report(spark, d):
    return stores.gap_report(_items(spark, d).select(F.col("subject").alias("bucket"), "id"))


@query(_sql("""SELECT key, name, total, n, total = n AS agrees FROM (SELECT 'subject' AS key, subject AS name, count(*) + CASE WHEN subject = 'Brand#2' THEN 1 ELSE 0 END AS total, count(*) AS n FROM items GROUP BY subject UNION ALL SELECT '*', '*', count(*), count(*) FROM items UNION ALL SELECT 'size', 'none', 3, 0)"""))
def bank_statistics(spark, d):
    i = _items(spark, d)
    declared = i.groupBy(F.col("subject").alias("name")).agg(F.count("*").alias("n")).select(F.lit("subject").alias("key"), "name", (F.col("n") + F.when(F.col("name") == "Brand#2", 1).otherwise(0)).alias("total"))
    declared = declared.unionByName(i.agg(F.count("*").alias("total")).select(F.lit("*").alias("key"), F.lit("*").alias("name"), "total")).unionByName(spark.createDataFrame([("size", "none", 3)], "key string, name string, total long"))
    return evidence.bank_statistics(i, declared)


@query(_sql("SELECT subject AS key, CAST(total AS VARCHAR) AS total, CAST(n AS VARCHAR) AS n, coalesce(total, 0) = coalesce(n, 0) AS agrees FROM (SELECT subject, count(*) AS n FROM items WHERE subject <> 'Brand#3' GROUP BY subject) FULL JOIN (SELECT subject, count(*) AS total FROM items WHERE subject <> 'Brand#1' GROUP BY subject) USING (subject)"))
def reconciled_totals(spark, d):
    i = _items(spark, d)
    declared = i.where("subject <> 'Brand#1'").groupBy("subject").agg(F.count("*").alias("total"))
    out = evidence.reconciled_totals(i.where("subject <> 'Brand#3'"), declared, "subject")
    return out.select(F.col("subject").alias("key"), F.col("total").cast("string").alias("total"), F.col("n").cast("string").alias("n"), "agrees")


@query(_sql("SELECT subject, count(*) AS n FROM items GROUP BY subject"))
def tally(spark, d):
    return evidence.tally(_items(spark, d), "subject").withColumnRenamed("count", "n")


@query(_sql("SELECT count(*) AS total, count(*) FILTER (size >= 30) AS reverified, count(*) FILTER (size < 30 AND size % 2 = 0) AS carried_over, count(*) FILTER (size < 30) AS not_reviewed FROM items"))
def review_coverage(spark, d):
    on = F.when(F.col("size") >= 30, "2024-02-01").when(F.col("size") % 2 == 0, "2023-02-01")
    return evidence.coverage(_items(spark, d).select(on.alias("reviewed_on")), "2024-01-01")


@query(_sql("SELECT subject, CASE WHEN count(*) > count(*) FILTER (size > 45) THEN floor(1000.0 * count(*) FILTER (size < 3) / (count(*) - count(*) FILTER (size > 45)) + 0.5) / 10 END AS rate FROM items GROUP BY subject"))
def error_rate(spark, d):
    n = _items(spark, d).groupBy("subject").agg(F.count("*").alias("n"), F.count_if(F.col("size") > 45).alias("u"), F.count_if(F.col("size") < 3).alias("bad"))
    return n.select("subject", evidence.error_rate(F.col("n"), F.col("u"), F.col("bad")).alias("rate"))


@query(_sql("SELECT name, CASE WHEN name = 'none' THEN NULL ELSE 'doc' END AS path, CAST(claimed AS VARCHAR) AS claimed, n, CASE WHEN claimed IS NULL THEN 'dead' WHEN claimed = n THEN 'ok' ELSE 'wrong' END AS status FROM (SELECT 'items' AS name, count(*) AS claimed, count(*) AS n FROM items UNION ALL SELECT 'answered', 5, count(answer) FROM items UNION ALL SELECT 'none', NULL, 0)"))
def claim_diffs(spark, d):
    i = _items(spark, d)
    docs = i.agg(F.format_string("There are %d items, 5 answered", F.count("*")).alias("text")).select(F.lit("doc").alias("path"), "text")
    claims = banks.claims_in(docs, {"items": "are ([0-9]+) items", "answered": "([0-9]+) answered", "none": "([0-9]+) nothings"})
    return evidence.claim_diffs(claims, evidence.derived_counts(i, {"items": F.lit(True), "answered": F.col("answer").isNotNull(), "none": F.lit(False)})).withColumn("claimed", F.col("claimed").cast("string"))


@query()
def best_matches(spark, d):
    """Every twentieth part's stem with a slip, against all parts: rows only, as the likeness is Python's own."""
    items = _items(spark, d)
    slipped = F.concat(F.substring("stem", 1, 6), F.lit("x"), F.substring("stem", 9, 1000))
    return reconcile.best_match(items.where("pos % 20 = 0").select(F.col("pos").cast("int").alias("source_no"), slipped.alias("stem")), items.select("id", "stem", "pos"))


@query(_sql("""SELECT id, 'banned_field' AS rule, 'confidence' AS detail FROM items WHERE pos % 4 = 0 UNION ALL SELECT id, 'no_source', 'research_agent' FROM items WHERE pos % 4 = 1 UNION ALL SELECT id, 'not_a_citation', subject FROM items WHERE pos % 4 = 2"""))
def honest_metadata(spark, d):
    source = F.when(F.col("pos") % 4 == 1, "research_agent").when(F.col("pos") % 4 == 2, F.col("subject")).otherwise("ISO 14067")
    rows = _items(spark, d).select("id", F.when(F.col("pos") % 4 == 0, F.create_map(F.lit("confidence"), F.lit("high"))).otherwise(F.create_map(F.lit("verification_source"), source)).alias("metadata"))
    return rules.check_honesty(rows, "ISO|Art")


@query(_sql("""SELECT id, rule, detail FROM (SELECT id, 'replaced_without_date' AS rule, '' AS detail FROM items WHERE pos % 3 = 1 UNION ALL SELECT id, 'replaced_without_reason', 'short' FROM items WHERE pos % 3 = 1 AND size % 2 = 0
UNION ALL SELECT id, 'replaced_by_other_than_primary', 'https://blog/' || id FROM items WHERE pos % 3 = 2 UNION ALL SELECT id, 'replaced_by_the_same', 'options' FROM items WHERE pos % 3 = 2)"""))
def replaced_options(spark, d):
    i, kind = _items(spark, d), F.col("pos") % 3
    why = F.when(F.col("size") % 2 == 0, "short").otherwise("a reason that is long enough to say something")
    made = F.struct(F.when(kind == 2, "2026-07-19").alias("on"), F.when(kind == 2, F.col("options")).otherwise(F.reverse("options")).alias("prior_options"), F.lit("A").alias("prior_answer"), F.concat(F.when(kind == 2, "https://blog/").otherwise("https://gov/"), "id").alias("source_url"), F.when(kind == 1, why).otherwise("a reason that is long enough to say something").alias("why"))
    return rules.check_replaced(i.withColumn("replaced", F.when(kind > 0, made)), F.contains("replaced.source_url", F.lit("gov")))


@query(_sql("""SELECT id, 'unregistered' AS rule, left(stem, 44) AS detail FROM items WHERE size % 2 = 0 AND pos % 5 = 4 UNION ALL SELECT id, 'other_answer', coalesce(answer_text, subject) FROM told WHERE pos % 5 = 1 UNION ALL SELECT id, 'no_basis', subject FROM items WHERE pos % 5 = 2"""))
def numeric_registry(spark, d):
    i, k = _items(spark, d).withColumn("answer", F.coalesce("answer", F.lit("A"))), F.col("pos") % 5
    text = F.try_element_at(F.filter("options", lambda o: o["key"] == F.col("answer")), F.lit(1))["text"]
    registry = i.where(k < 4).select("id", F.when(k == 1, "no such answer").when(k == 2, F.col("subject")).otherwise(F.concat(F.lit(" "), text)).alias("expected"), F.when(k == 2, "looked_up").otherwise("worked").alias("kind"), F.lit(None).cast("string").alias("basis"))
    answered = i.withColumn("answer", F.when(k == 2, "A").otherwise(F.col("answer")))
    return rules.check_numeric_registry(answered, registry, F.col("size") % 2 == 0)
