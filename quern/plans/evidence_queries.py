"""Catalogue: figures, references, labels, dispositions and manifests that stand beside the banks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalars, text
from quern.operators import bank, identity, metrics
from quern.sources import manifest

from .catalog import query
from .text_queries import _read


@query("""WITH i AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'pool' ELSE 'main' END AS bank, CASE WHEN p_partkey % 7 <> 0 THEN 'A' END AS answer, CASE p_partkey % 10 WHEN 1 THEN 'A' WHEN 2 THEN 'B' END AS prior,
  p_size % 2 = 0 AS watched, p_partkey % 4 <> 0 AS sourced, p_partkey % 4 = 1 AS prim, p_partkey % 4 = 1 AND p_size % 5 <> 0 AS quoted, CASE p_partkey % 6 WHEN 0 THEN 'supported' WHEN 1 THEN 'citation_replaced' WHEN 2 THEN 'citation_disputed' WHEN 3 THEN 'no_quote' WHEN 4 THEN 'dead' END AS audit,
  p_partkey % 8 = 0 AS checked, CASE WHEN p_size > 10 THEN '2026-07-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') ELSE '' END AS as_of FROM part),
c AS (SELECT *, bank = 'main' AS m, bank = 'pool' AS p, bank = 'main' AND prior IS NOT NULL AND prior IS DISTINCT FROM answer AS corr FROM i)
SELECT unnest(['total', 'with_answer', 'time_sensitive', 'corrections', 'main_quote', 'main_primary', 'main_nosource', 'pool_total', 'pool_quote', 'pool_primary', 'corr_with_url', 'corr_no_url', 'akc_confirmed', 'ca_supported', 'ca_replaced', 'ca_disputed', 'ca_no_quote', 'ca_dead', 'ca_wrong', 'reverified', 'carried_over', 'not_reviewed']) AS name,
  unnest([count(*) FILTER (m), count(*) FILTER (m AND answer IS NOT NULL), count(*) FILTER (m AND watched), count(*) FILTER (corr), count(*) FILTER (m AND quoted), count(*) FILTER (m AND prim), count(*) FILTER (m AND NOT sourced), count(*) FILTER (p), count(*) FILTER (p AND quoted), count(*) FILTER (p AND prim),
    count(*) FILTER (corr AND sourced), count(*) FILTER (corr AND NOT sourced), count(*) FILTER (checked), count(*) FILTER (audit = 'supported'), count(*) FILTER (audit = 'citation_replaced'), count(*) FILTER (audit = 'citation_disputed'), count(*) FILTER (audit = 'no_quote'), count(*) FILTER (audit = 'dead'), count(*) FILTER (audit LIKE 'citation_%'),
    count(*) FILTER (m AND as_of >= '2026-07-13'), count(*) FILTER (m AND watched AND as_of < '2026-07-13'), count(*) FILTER (m AND as_of < '2026-07-13')]) AS n FROM c""")
def bank_metrics(spark, d):
    p = _read(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    audit = F.element_at(F.array(*map(F.lit, ("supported", "citation_replaced", "citation_disputed", "no_quote", "dead", None))), (k % 6 + 1).cast("int"))
    as_of = F.when(size > 10, F.concat(F.lit("2026-07-"), F.lpad((size % 28 + 1).cast("string"), 2, "0")))
    evidence = F.array(F.struct(F.lit("u").alias("url"), F.when(size % 5 != 0, "q").otherwise(" ").alias("quote"), (k % 4 == 1).alias("primary")))
    items = p.select(F.when(k % 3 == 0, "pool").otherwise("main").alias("bank"), k.cast("string").alias("id"), F.when(k % 7 != 0, "A").alias("answer"), F.when(k % 10 == 1, "A").when(k % 10 == 2, "B").alias("prior_answer"), F.when(size % 2 == 0, F.array(F.lit("time_sensitive"))).alias("flags"), F.when(k % 4 != 0, F.array(F.lit("u"))).alias("sources"), F.when(k % 4 == 1, 1).otherwise(0).alias("primary"), evidence.alias("evidence"), audit.alias("audit"), (k % 8 == 0).alias("key_checked"), as_of.alias("valid_as_of"))
    return metrics.counted(items, "2026-07-13")


@query("""SELECT name, 'R' AS path, claimed, n, CASE WHEN claimed = n THEN 'ok' ELSE 'wrong' END AS status FROM (SELECT 'total' AS name, 0 AS claimed, count(*) AS n FROM part UNION ALL SELECT 'with_answer', 1, count(*) FILTER (p_partkey % 7 <> 0) FROM part) WHERE claimed <> n""")
def review_gate(spark, d):
    k = F.col("p_partkey")
    nothing = {"prior_answer": "string", "flags": "array<string>", "sources": "array<string>", "primary": "int", "evidence": "array<struct<url: string, quote: string, primary: boolean>>", "audit": "string", "key_checked": "boolean", "valid_as_of": "string"}
    items = _read(spark, d, "part").select(F.lit("main").alias("bank"), k.cast("string").alias("id"), F.when(k % 7 != 0, "A").alias("answer"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    declared = items.limit(1).select(F.explode(F.array(F.struct(F.lit("total").alias("name"), F.lit(0).alias("claimed")), F.struct(F.lit("with_answer").alias("name"), F.lit(1).alias("claimed")))).alias("c")).select("c.name", F.lit("R").alias("path"), "c.claimed")
    return metrics.review_gate(items, declared, "2026-07-13")


_SAID = ("A、D 為 Scope 1", "前句才剛說 A 屬 Category 1", "故 A 為不正確之敘述", "優惠費率 A 為最低", "升溫 1.5°C 是上限", "故選 B", "沒有字母")


@query("""WITH s AS (SELECT conv_id, turn, (conv_id + turn) % 7 AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'A、D|D ' WHEN 1 THEN 'A' WHEN 2 THEN 'A ' WHEN 5 THEN '故選 B| B' ELSE '' END AS refs FROM s""")
def chinese_letter_refs(spark, d):
    c = _read(spark, d, "conversations")
    said = F.element_at(F.array(*map(F.lit, _SAID)), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"))
    found = text.letter_references(said, **text.CHINESE_LETTERS)
    return c.select("conv_id", "turn", F.array_join(F.transform(F.slice(found, 1, 3), lambda x: F.regexp_replace(x, "^ (?=A)", "")), "|").alias("refs"))


_LAW = "中央主管機關應擬訂國家因應氣候變遷行動綱領，報請行政院核定"


@query(f"""SELECT p_partkey AS id, code, '{_LAW}' || p_size AS quote FROM part, (VALUES ('O1'), ('O2')) c(code) WHERE p_partkey % 4 < 2 AND (code = 'O1' OR p_partkey % 4 = 1)""")
def law_quotes(spark, d):
    """Laws named, and a quote of one; one text names none, one quotes a mere title."""
    p = _read(spark, d, "part")
    quote = F.concat(F.lit("「" + _LAW), F.col("p_size").cast("string"), F.lit("」"))
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat(F.lit("依氣候法"), quote)).when(k == 1, F.concat(F.lit("碳費辦法與氣候法"), quote)).when(k == 2, quote).otherwise(F.lit("氣候法「國家因應氣候變遷行動綱領計畫書草案」"))
    return p.select(F.col("p_partkey").alias("id"), F.explode(text.law_quotes(said, {"氣候法": "O1", "碳費辦法": "O2"})).alias("q")).select("id", "q.code", "q.quote")


@query("""WITH t AS (SELECT p_partkey AS id, 'O1' AS code, p_size AS article FROM part UNION SELECT p_partkey, 'O2', 12 FROM part WHERE p_partkey % 2 = 0), corpus AS (SELECT DISTINCT 'O1' AS code, p_size AS article FROM part WHERE p_size % 5 <> 0)
SELECT CAST(id AS VARCHAR) AS id, code, CAST(article AS VARCHAR) AS article FROM t ANTI JOIN corpus USING (code, article)""")
def missing_articles(spark, d):
    """References in digits and in numerals, against the articles that there are."""
    p = _read(spark, d, "part")
    said = F.concat(F.lit("見氣候法第"), F.col("p_size").cast("string"), F.lit("條"), F.when(F.col("p_partkey") % 2 == 0, "與《碳費辦法》第十二條").otherwise(""))
    corpus = p.where("p_size % 5 <> 0").select(F.lit("O1").alias("code"), F.col("p_size").alias("article")).distinct()
    return identity.missing_references(p.select(F.col("p_partkey").cast("string").alias("id"), said.alias("text")), corpus, {"氣候法": "O1", "碳費辦法": "O2"})


@query(r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS h, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN h = '' OR h IS NULL THEN url WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN CASE WHEN contains(path, '/en/') THEN 'English' WHEN contains(path, '/de/') THEN 'German' ELSE 'Other' END
  WHEN h = 'example.net' OR ends_with(h, '.example.net') THEN 'Net' WHEN h = 'org' OR ends_with(h, '.org') THEN 'law §7' ELSE regexp_replace(h, '^www\.', '') END AS label FROM u""")
def source_labels(spark, d):
    url = F.when(F.endswith(scalars.host(F.col("url")), F.lit("org")), F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("?pcode=X&flno=7"))).otherwise(F.col("url"))
    label = scalars.source_label(url, {"example.net": "Net"}, {"org": {"O1": "Act"}}, None, {"example.com": [("/en/", "English"), ("/de/", "German"), ("", "Other")]})
    return _read(spark, d, "pages").select("page_id", label.alias("label"))


@query("""WITH r AS (SELECT p_brand AS source, p_size AS number, CASE WHEN p_partkey % 3 = 0 THEN 'kept' ELSE 'dropped' END AS status FROM part)
SELECT source, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'dropped') AS dropped, count(*) AS accounted, 40 AS total, 40 - count(DISTINCT number) FILTER (number BETWEEN 1 AND 40) AS missing, count(*) - count(DISTINCT number) FILTER (number BETWEEN 1 AND 40) AS repeated FROM r GROUP BY source""")
def disposition_summary(spark, d):
    p = _read(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("source"), F.col("p_size").alias("number"), F.when(F.col("p_partkey") % 3 == 0, "kept").otherwise("dropped").alias("status"))
    found = identity.disposition_summary(rows, rows.select("source", F.lit(40).alias("total")).distinct())
    n = lambda s: F.coalesce(F.try_element_at("statuses", F.lit(s)), F.lit(0))
    return found.select("source", n("kept").alias("kept"), n("dropped").alias("dropped"), "accounted", "total", "missing", "repeated")


@query("""SELECT upper(id) AS id FROM (SELECT CAST(p_partkey AS VARCHAR) || 'x' AS id FROM part WHERE p_brand = 'Brand#12' ORDER BY md5(CAST(p_partkey AS VARCHAR) || 'x:5'), id LIMIT 10)""")
def picked_items(spark, d):
    """Filtered, sampled, and only then converted."""
    pool = _read(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("x")).alias("id"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("source_type"), F.lit("1").alias("subject"), F.array().cast("array<string>").alias("quality_flags"))
    return bank.pick(pool, 10, lambda drawn: drawn.select(F.upper("id").alias("id")), 5, source_types=["Brand#12"])


@query("""SELECT CAST(s_suppkey AS VARCHAR) || 'x' AS id FROM supplier""")
def whole_sample(spark, d):
    """A sample of as many as there are, or more, is all of them."""
    s = _read(spark, d, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit("x")).alias("id"), F.col("s_suppkey").alias("pos"))
    return bank.sample(s, 10_000_000).select("id")


@query("""SELECT count(*) AS n, md5(string_agg(line, chr(10) ORDER BY b COLLATE "C", k)) AS md5 FROM (SELECT p_brand AS b, p_partkey AS k, '{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || '}' AS line FROM part)""".replace(' COLLATE "C"', ""))
def manifest_lines(spark, d):
    """The manifest's lines in the order of its parts: all of them, as one text (here small)."""
    lines = manifest.numbered_lines(_read(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand", "p_partkey"], 100)
    return lines.agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "_0", "_1", "line"))), lambda x: x["line"]), "\n")).alias("md5"))
