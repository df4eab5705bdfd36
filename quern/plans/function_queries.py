"""Catalogue: scalar, text, source, evidence and reconciliation functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalars, text
from quern.operators import evidence, reconcile, scoring
from quern.sources import banks, stores
from quern.streaming import events as streams

from .catalog import query
from .text_queries import _HOST, _read


@query("SELECT event_id, CAST(CAST(floor(value) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS took FROM events")
def durations(spark, d):
    return _read(spark, d, "events").select("event_id", scalars.duration(F.floor("value") * 1000 + 500).alias("took"))


@query("""SELECT event_id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || ' min' WHEN m < 1440 THEN m // 60 || ' h' ELSE m // 1440 || ' d' END AS ago
FROM (SELECT event_id, CAST(greatest(epoch_us(TIMESTAMP '2024-02-15') // 1000 - epoch_us(ts) // 1000, 0) // 60000 AS BIGINT) AS m FROM events)""")
def relative_times(spark, d):
    now = F.unix_millis(F.lit("2024-02-15").cast("timestamp"))
    return _read(spark, d, "events").select("event_id", scalars.relative_time(now, F.unix_millis(F.col("ts").cast("timestamp"))).alias("ago"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 OR event_id = 0 THEN NULL ELSE least(event_id, 100) END AS VARCHAR) AS n FROM events")
def clamped_counts(spark, d):
    typed = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id").cast("string"), F.lit("x"))).otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string")))
    return _read(spark, d, "events").select("event_id", scalars.clamped_count(typed).cast("string").alias("n"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS dated, o_orderkey % 2 = 0 AND strftime(o_orderdate, '%Y-%m-%d') >= '1997-01-01' AS recent FROM orders")
def iso_dates(spark, d):
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _read(spark, d, "orders").select("o_orderkey", scalars.is_iso_date(shown).alias("dated"), scalars.not_before(shown, "1997-01-01").alias("recent"))


@query(r"""SELECT page_id, host || CASE WHEN length(path) > 1 THEN path ELSE '' END || CASE WHEN ident <> '' THEN ' #' || ident ELSE '' END AS shown FROM (
SELECT page_id, """ + _HOST + r""" AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?&]id=([^&#]+)', 1) AS ident FROM pages)""")
def pretty_urls(spark, d):
    return _read(spark, d, "pages").select("page_id", scalars.pretty_url(F.col("url")).alias("shown"))


@query("SELECT page_id, host || CASE page_id % 3 WHEN 0 THEN ':8080' ELSE '' END AS host FROM (SELECT page_id, " + _HOST + " AS host FROM pages)")
def hosts_and_ports(spark, d):
    port = F.when(F.col("page_id") % 3 == 0, ":8080").when(F.col("page_id") % 3 == 1, F.when(F.startswith("url", F.lit("https")), ":443").otherwise(":80")).otherwise("")
    return _read(spark, d, "pages").select("page_id", scalars.host_and_port(F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), port, F.lit("/x"))).alias("host"))


@query("SELECT page_id, starts_with(url, 'http') AS web, host = 'example.org' OR ends_with(host, '.example.org') AS primary_ FROM (SELECT page_id, url, " + _HOST + " AS host FROM pages)")
def primary_sources(spark, d):
    return _read(spark, d, "pages").select("page_id", scalars.is_http_url(F.col("url")).alias("web"), scalars.has_primary(F.array(F.lit("no url"), F.col("url")), ("example.org",)).alias("primary_"))


@query("SELECT item_id, 'https://f.x/form?id=' || item_id || '&stem=' || left(regexp_replace(text, '[^A-Za-z]', '', 'g'), 100) || CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 100 THEN '%E2%80%A6' ELSE '' END AS url FROM benchmark")
def feedback_urls(spark, d):
    return _read(spark, d, "benchmark").select("item_id", scalars.feedback_url("https://f.x/form", F.col("item_id").cast("string"), F.regexp_replace("text", "[^A-Za-z]", "")).alias("url"))


@query("SELECT conv_id, turn, '<h2>' || role || '</h2><br><strong>' || turn || '</strong> &lt;' || role || '&gt; <code>x</code><br><li>' || conv_id || '</li>' AS html FROM conversations")
def markdown_pages(spark, d):
    c = _read(spark, d, "conversations")
    md = F.concat(F.lit("## "), "role", F.lit("\n**"), F.col("turn").cast("string"), F.lit("** <"), "role", F.lit("> `x`\n- "), F.col("conv_id").cast("string"))
    return c.select("conv_id", "turn", scalars.markdown_to_html(md).alias("html"))


@query("""SELECT event_id, '[redacted]' AS by_map, '{"sessionId":"[redacted]","list":[{"e":{"f":{"g":"[truncated]"}},"Credit-Card":"[redacted]"}],"k":' || event_id || '}' AS by_json FROM events""")
def redacted_contexts(spark, d):
    json = F.concat(F.lit('{"sessionId": 5, "list": [{"e": {"f": {"g": {"h": 1}}}, "Credit-Card": {"no": 1}}], "k": '), F.col("event_id").cast("string"), F.lit("}"))
    return _read(spark, d, "events").select("event_id", scalars.redacted(F.create_map(F.lit("apiKey"), F.lit("x")))["apiKey"].alias("by_map"), scalars.redacted_json(json).alias("by_json"))


@query("SELECT conv_id, turn, CASE WHEN turn % 5 < 4 THEN role ELSE NULL END AS reply FROM conversations")
def model_replies(spark, d):
    wrap = [('{"message": {"content": "', '"}}'), ('{"message": {"content": [{"text": "', '"}]}}'), ('{"content": ["', '"]}'), ("", "")]
    json = F.lit('{"message": {"content": [{}]}}')
    for i, (a, b) in enumerate(wrap):
        json = F.when(F.col("turn") % 5 == i, F.concat(F.lit(a), "role", F.lit(b))).otherwise(json)
    return _read(spark, d, "conversations").select("conv_id", "turn", scalars.reply_text(json).alias("reply"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 4 WHEN 'click' THEN 2 ELSE 0 END AS rank FROM events")
def level_ranks(spark, d):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "Info").otherwise("other")
    return _read(spark, d, "events").select("event_id", scalars.level_rank(level).cast("int").alias("rank"))


# text


_QUOTE = r"regexp_replace({0}, '[\p{{P}}\s\p{{Z}}\x{{FEFF}}\p{{So}}\p{{Co}}■-◿]+', '', 'g')"


@query(rf"""SELECT doc_id, md5({_QUOTE.format("coalesce(text, '')")}) AS quote, md5({_QUOTE.format("translate(coalesce(text, ''), 'éñ', 'en')")}) AS folded, md5(regexp_replace(coalesce(text, ''), '[\s\p{{Z}}\x{{FEFF}}.,#]+', '', 'g')) AS listed, md5(regexp_replace(lower(text), '[\s\x{{3000}}-\x{{303F}}\x{{FF00}}-\x{{FFEF}}\-_/.,:;()\[\]]+', '', 'g')) AS tag FROM documents""")
def normal_forms(spark, d):
    t = F.col("text")
    return _read(spark, d, "documents").select("doc_id", F.md5(text.quote_form(t)).alias("quote"), F.md5(text.folded(t, {"é": "e", "ñ": "n"})).alias("folded"), F.md5(text.listed_form(t, ".,#")).alias("listed"), F.md5(text.tag_form(t)).alias("tag"))


@query("SELECT doc_id, md5(regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '[\\p{P}\\s\\p{Z}\\x{FEFF}_]+', '', 'g')) AS form FROM documents")
def composed_form(spark, d):
    """With compatibility composition; these texts have no compatibility signs, so canonical composition gives the same."""
    return _read(spark, d, "documents").select("doc_id", F.md5(text.content_form(F.col("text"), compose=True)).alias("form"))


@query("SELECT p_partkey, p_size % 2 = 0 AS numeric_ FROM part")
def numeric_texts(spark, d):
    t = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("≥ "), F.col("p_size").cast("string"), F.lit(" × 1,000 kWh ± 2%"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" pieces")))
    return _read(spark, d, "part").select("p_partkey", text.is_numeric_text(t).alias("numeric_"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_size - 0.5) * 3.0 WHEN 1 THEN (p_size - 0.5) * 3.0 * 2 WHEN 2 THEN p_size * 1000.0 END AS value FROM part")
def option_values(spark, d):
    size = F.col("p_size").cast("string")
    t = F.element_at(F.array(F.concat(F.lit("("), size, F.lit(" − 0.5) × 3 kg")), F.concat(size, F.lit("-0.5 x 3.0 * 2")), F.concat(size, F.lit(",000 t")), F.concat(size, F.lit(" of 7"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _read(spark, d, "part").select("p_partkey", text.option_value(t).alias("value"))


@query("SELECT p_partkey, 'the ' || p_brand || ': ' AS common, CASE WHEN p_partkey % 2 = 0 THEN 'the ' || p_brand END AS redundant FROM part")
def option_prefixes(spark, d):
    options = F.transform(F.array(F.lit("x"), F.lit("y"), F.lit("z")), lambda x: F.concat(F.lit("the "), F.col("p_brand"), F.lit(": "), x))
    stem = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("What of the "), "p_brand")).otherwise("What else")
    return _read(spark, d, "part").select("p_partkey", text.common_prefix(options).alias("common"), text.redundant_prefix(stem, options).alias("redundant"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\s*\n\s*', ' ', 'g'), '[ \t]+', ' ', 'g'))) AS joined FROM documents WHERE text IS NOT NULL")
def joined_lines(spark, d):
    return _read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.joined_lines(F.col("text"))).alias("joined"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'answer is B' WHEN 1 THEN 'A, C/D' WHEN 2 THEN 'C ' ELSE '' END AS found, CASE p_partkey % 4 WHEN 0 THEN p_size % 2 = 0 END AS agree FROM part""")
def letter_refs(spark, d):
    t = F.element_at(F.array(*map(F.lit, ("So the answer is B.", "Of these A, C/D fit.", "Here C is wrong, 20° C is not.", "ABC and Brand A4"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _read(spark, d, "part").select("p_partkey", F.array_join(text.letter_references(t), "|").alias("found"), text.letters_agree(t, F.when(F.col("p_size") % 2 == 0, "B").otherwise("C")).alias("agree"))


@query(r"""SELECT conv_id, turn, turn % 2 = 0 AS cited, CASE WHEN turn % 3 = 0 THEN 'https://b.c/x' END AS undeclared FROM conversations""")
def references_in_text(spark, d):
    c = _read(spark, d, "conversations")
    t = F.concat(F.coalesce(F.translate("text", "[]:", ""), F.lit("")), F.when(F.col("turn") % 2 == 0, " as in [1, 2]").otherwise(" as in [x]"), F.lit(" see https://a.b/c "), F.when(F.col("turn") % 3 == 0, "(https://b.c/x)").otherwise(""))
    return c.select("conv_id", "turn", text.has_bracket_citation(t).alias("cited"), F.try_element_at(text.undeclared_urls(t, F.array(F.lit("https://a.b/c"))), F.lit(1)).alias("undeclared"))


@query(r"""WITH x AS (SELECT page_id, 'rate' || page_id || '.5%in20' || page_id % 90 + 10 || 'bySection' || page_id % 9 || ',1950年' AS t, regexp_replace(coalesce(url, ''), '[\s\p{Z}\x{FEFF}]+', '', 'g') || '12,5' AS s FROM pages),
c AS (SELECT page_id, s, 'percent' AS kind, unnest(list_distinct(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)?%'))) AS claim FROM x
UNION ALL SELECT page_id, s, 'year', unnest(list_distinct(regexp_extract_all(t, '(?:19|20)[0-9]{2}年?'))) FROM x
UNION ALL SELECT page_id, s, 'section', unnest(list_distinct(regexp_extract_all(t, '(?i:article|art\.|para\.?|section)[0-9]+'))) FROM x)
SELECT page_id, kind, claim FROM c WHERE NOT contains(s, claim) AND NOT (kind <> 'section' AND length(regexp_replace(claim, '[^0-9.]+', '', 'g')) >= 2 AND contains(s, regexp_replace(claim, '[^0-9.]+', '', 'g')))""")
def unsupported_claims(spark, d):
    kinds = {k: text.CLAIMS[k] for k in ("percent", "year", "section")}
    n = lambda c: c.cast("string")
    said = F.concat(F.lit("rate "), n(F.col("page_id")), F.lit(".5 % in 20"), n(F.col("page_id") % 90 + 10), F.lit(" by Section "), n(F.col("page_id") % 9), F.lit(", 1950 年"))
    found = text.unsupported_claims(said, F.array(F.col("url"), F.lit("12,5")), kinds)
    return _read(spark, d, "pages").select("page_id", F.explode(found).alias("c")).select("page_id", "c.kind", "c.claim")


@query("""SELECT p_partkey, kind, claim FROM part, (VALUES ('article', '第十二條', 0), ('article sign', '§12-3', 1), ('standard', 'ISO14064-1', 2), ('regulation', 'EU2023/956', 3), ('appendix', 'AppendixB', 4), ('amount', '1,200公噸', 5)) c(kind, claim, k) WHERE p_partkey % 6 <> k AND (kind <> 'amount' OR p_partkey % 2 = 0)""")
def claim_kinds(spark, d):
    claims = ("第 十二 條", "§ 12-3", "ISO 14064-1", "EU 2023/956", "Appendix B", "1,200 公噸")
    said = F.lit("，".join(claims))
    allowed = F.array(F.element_at(F.array(*map(F.lit, claims)), (F.col("p_partkey") % 6 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 1, "mass 1200 1,200").otherwise(None))
    kinds = {k: v for k, v in text.CLAIMS.items() if k not in ("year", "percent", "section")}
    return _read(spark, d, "part").select("p_partkey", F.explode(text.unsupported_claims(said, allowed, kinds, compose=True)).alias("c")).select("p_partkey", "c.kind", "c.claim")


@query("""SELECT doc_id, CASE WHEN text IS NULL OR n < 50 THEN 0.3 ELSE least(1.0, greatest(0.0, 0.5 + CASE WHEN n BETWEEN 80 AND 1500 THEN 0.15 ELSE 0 END + CASE WHEN contains(text, 'A') AND contains(text, 'B') THEN 0.1 ELSE 0 END + least((CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'and') THEN 1 ELSE 0 END) * 0.03, 0.25) - CASE WHEN contains(text, 'not sure') OR contains(text, 'cannot determine') THEN 0.15 ELSE 0 END)) END AS confidence FROM (SELECT doc_id, text, length(text) AS n FROM documents)""")
def text_confidence(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.round(text.confidence(F.col("text"), ("the", "and")), 6).alias("confidence"))


@query("SELECT conv_id, turn, len(q) AS n, q[1] AS first FROM (SELECT conv_id, turn, [x FOR x IN [left(coalesce(text, ''), 20), role] IF length(x) >= 16] AS q FROM (SELECT conv_id, turn, role, translate(text, '「」', '') AS text FROM conversations))")
def quoted_texts(spark, d):
    c = _read(spark, d, "conversations").withColumn("text", F.translate("text", "「」", ""))
    q = text.quotes_in(F.concat(F.lit("so 「"), F.left(F.coalesce("text", F.lit("")), F.lit(20)), F.lit("」 and 「"), "role", F.lit("」")))
    return c.select("conv_id", "turn", q.alias("q")).select("conv_id", "turn", F.size("q").cast("long").alias("n"), F.try_element_at("q", F.lit(1)).alias("first"))


@query(rf"""SELECT doc_id, n >= 60 AS verbatim, n >= 60 AS fragments, CASE WHEN doc_id % 2 = 0 OR n < 60 THEN 'absent' ELSE 'verbatim' END AS status FROM (SELECT doc_id, length({_QUOTE.format("coalesce(text, '')")}) AS n FROM documents)""")
def quote_checks(spark, d):
    """Two pieces of a text with an ellipsis between are verbatim in it; a made-up quote is absent."""
    rows = _read(spark, d, "documents").select("doc_id", text.quote_form(F.col("text")).alias("f"))
    long = F.length("f") >= 60
    pieces = F.when(long, F.concat(F.substring("f", 31, 25), F.lit("…"), F.substring("f", 1, 25))).otherwise("nowhere at all…nor is this")
    said = F.when((F.col("doc_id") % 2 == 0) | ~long, "what no text of this kind ever says").otherwise(F.substring("f", 5, 40))
    return rows.select("doc_id", text.is_verbatim(pieces, F.col("f")).alias("verbatim"), text.fragments_present(pieces, F.col("f")).alias("fragments"), text.quote_status(said, F.col("f")).alias("status"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'L1,L2' WHEN 1 THEN 'L2' ELSE '' END AS codes, CASE p_partkey % 3 WHEN 0 THEN 'L1:' || p_size || ',L2:12' WHEN 1 THEN 'L2:35' ELSE '' END AS articles FROM part")
def law_references(spark, d):
    aliases = {"氣候法": "L1", "氣候變遷因應法": "L1", "碳費辦法": "L2"}
    t = F.element_at(F.array(F.concat(F.lit("依《氣候變遷因應法》第 "), F.col("p_size").cast("string"), F.lit(" 條及碳費辦法第十二條")), F.lit("碳費辦法 §35"), F.lit("第 3 條")), (F.col("p_partkey") % 3 + 1).cast("int"))
    refs = F.transform(text.article_references(t, aliases), lambda r: F.concat(r["code"], F.lit(":"), r["article"]))
    return _read(spark, d, "part").select("p_partkey", F.array_join(text.mentioned(t, {k: v for k, v in aliases.items() if k != "氣候法"}), ",").alias("codes"), F.array_join(refs, ",").alias("articles"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS n FROM part")
def chinese_numbers(spark, d):
    digit = lambda x: F.element_at(F.array(F.lit(""), *map(F.lit, text.NUMERALS)), (x + 1).cast("int"))
    tens, ones = F.floor(F.col("p_size") / 10), F.col("p_size") % 10
    shown = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, text.TEN).otherwise(""), digit(ones))
    return _read(spark, d, "part").select("p_partkey", text.chinese_number(shown).cast("string").alias("n"))


# sources and evidence


@query("SELECT page_id, CASE WHEN starts_with(url, 'https') THEN url || ' ' ELSE '' END || 'https://one.x' AS urls, CASE WHEN starts_with(url, 'https') THEN 2 ELSE 1 END + 1 AS n FROM pages")
def item_urls(spark, d):
    listed = F.array(F.when(F.startswith("url", F.lit("https")), F.col("url")), F.lit("ftp://x"), F.lit("https://one.x"))
    e = F.array(F.struct(F.lit("https://one.x").alias("url"), F.lit("").alias("quote"), F.lit("").alias("supports_option")), F.struct(F.lit("http://two.x").alias("url"), F.lit("").alias("quote"), F.lit("").alias("supports_option")))
    return _read(spark, d, "pages").select("page_id", F.array_join(banks.source_urls(listed, F.lit("https://one.x")), " ").alias("urls"), F.size(banks.evidence_urls(listed, F.lit(None).cast("string"), e)).alias("n"))


_MANIFEST = "m AS (SELECT CAST(page_id AS VARCHAR) AS qid, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS bank, url, " + _HOST + """ AS host, page_id % 3 = 0 AS has_quote FROM pages),
r AS (SELECT *, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'primary' WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'secondary' ELSE 'unknown' END AS authority FROM m WHERE url IS NOT NULL)"""


def _manifest(spark, d):
    p = _read(spark, d, "pages").where("url IS NOT NULL")
    e = F.array(F.struct(F.col("url"), F.when(F.col("page_id") % 3 == 0, "quoted").otherwise(" ").alias("quote")))
    rows = p.select(F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("bank"), F.col("page_id").cast("string").alias("qid"), F.array("url").alias("urls"), e.alias("evidence"))
    return evidence.evidence_manifest(rows, spark.createDataFrame([("example.com", "primary"), ("example.org", "secondary")], "host string, tier string"))


@query(f"WITH {_MANIFEST} SELECT qid, bank, url, host, authority, has_quote, authority = 'primary' AND has_quote AS tier1 FROM r")
def evidence_manifest(spark, d):
    return _manifest(spark, d)


@query(f"WITH {_MANIFEST} SELECT bank, authority, count(*) AS urls, count(*) FILTER (has_quote) AS quoted, (SELECT count(DISTINCT qid) FROM r x WHERE x.bank = r.bank AND authority = 'primary' AND has_quote) AS tier1_questions FROM r GROUP BY bank, authority")
def evidence_tiers(spark, d):
    return evidence.tier_summary(_manifest(spark, d))


@query(f"WITH {_MANIFEST} SELECT DISTINCT host FROM r WHERE authority = 'unknown'")
def unclassified_hosts(spark, d):
    return evidence.unclassified_hosts(_manifest(spark, d))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'archive' END AS resolved, CASE WHEN page_id % 3 < 2 THEN length(html) ELSE 0 END AS n FROM pages")
def fetched_pages(spark, d):
    p = _read(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("url"), F.col("html").alias("text"))
    out = banks.with_fallback(p.select("page_id", "url"), p.where("page_id % 3 = 0").select("url", "text"), p.where("page_id % 3 <= 1").select("url", "text"))
    return out.select("page_id", "resolved", F.length("text").cast("long").alias("n"))


@query("SELECT page_id, page_id % 4 = 0 AS pdf FROM pages")
def pdf_pages(spark, d):
    return _read(spark, d, "pages").select("page_id", banks.is_pdf(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("%PDF-1.7"), F.col("html"))).otherwise(F.col("html")).cast("binary")).alias("pdf"))


@query(r"""WITH w AS (SELECT conv_id, turn, unnest([x FOR x IN regexp_split_to_array(coalesce(text, ''), '\s+') IF x <> '']) AS word, generate_subscripts([x FOR x IN regexp_split_to_array(coalesce(text, ''), '\s+') IF x <> ''], 1) - 1 AS i FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS document, CAST(turn + 1 AS INT) AS page, CAST(i // 4 % 2 AS INT) AS "column", CAST(i // 8 AS BIGINT) * 4 + 20 AS line, string_agg(word, ' ' ORDER BY i) AS text FROM w WHERE i < 400 GROUP BY ALL""")
def pdf_layout(spark, d):
    """Words laid out in two columns of four words a line; what lies below the page's band is a footer."""
    c = _read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")).alias("i", "text"))
    i = F.col("i")
    words = c.select(F.col("conv_id").cast("string").alias("document"), (F.col("turn") + 1).cast("int").alias("page"), (F.when(F.expr("i div 4") % 2 == 0, 40.0).otherwise(300.0) + i % 4 * 20).alias("x0"), (F.expr("i div 8") * 12.0 + 60).alias("top"), "text")
    return banks.laid_out_lines(words, gutter=292, header=40, footer=659).withColumn("column", F.col("column").cast("int"))


@query("SELECT p_partkey AS number, p_brand AS stem, p_type || ' ' || p_name AS first, '' AS rest FROM part")
def numbered_items(spark, d):
    """Lines of one document a brand, cut into items with options."""
    p = _read(spark, d, "part")
    lines = p.select(F.col("p_partkey").cast("string").alias("document"), F.explode(F.array(F.struct(F.lit(1).alias("line"), F.concat(F.lit("7. "), "p_brand").alias("text")), F.struct(F.lit(2).alias("line"), F.concat(F.lit("(A) "), "p_type").alias("text")), F.struct(F.lit(3).alias("line"), F.col("p_name").alias("text")))).alias("x"))
    found = banks.numbered_items(lines.select("document", F.lit(1).alias("page"), F.lit(0).alias("column"), "x.line", "x.text"))
    return found.where("number = 7").select(F.col("document").cast("long").alias("number"), "stem", F.element_at("options", 1)["text"].alias("first"), F.array_join(F.transform(F.slice("options", 2, 9), lambda o: o["text"]), ",").alias("rest"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS code, CAST(n AS VARCHAR) AS article_no, p_name AS text FROM (SELECT p_partkey, replace(p_name, ' ', '') AS p_name FROM part), (VALUES (2), (10)) a(n)")
def law_articles(spark, d):
    html = F.concat(F.lit("<title>Act</title>"), *(F.concat(F.lit(f'<a name="{n}"></a><pre>'), "p_name", F.lit("</pre>")) for n in (10, 2)))
    return banks.law_articles(_read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("code"), F.lit("Act").alias("expected"), html.alias("html")))


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'gist-' WHEN 1 THEN 'b' ELSE 'p' END || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'gist' WHEN 1 THEN 'unique' ELSE 'ai_generated' END AS source_type, CASE WHEN p_partkey % 3 < 2 THEN 'main_bank' ELSE 'ai_generated' END AS category, CASE WHEN p_partkey % 3 < 2 THEN p_brand ELSE CASE WHEN contains(p_brand, '1') THEN 'subject 1' ELSE 'subject 2' END END AS subject,
p_partkey % 3 = 2 AND NOT contains(p_brand, '1') AND NOT contains(p_brand, '2') AS unmapped, CAST(p_partkey % 3 AS INT) AS bank_rank FROM part""")
def canonical_items(spark, d):
    """Three banks of different shapes as one relation."""
    p = _read(spark, d, "part")
    nothing, options = (lambda kind: F.lit(None).cast(kind)), F.array().cast(banks.OPTIONS)
    of = lambda k: p.where(F.col("p_partkey") % 3 == k)
    common = [F.col("p_name").alias("stem"), options.alias("options"), F.lit("A").alias("answer"), nothing("string").alias("explanation"), nothing("array<string>").alias("quality_flags"), nothing(banks.METADATA).alias("metadata")]
    a = of(0).select(F.col("p_partkey").cast("int").alias("index"), F.col("p_brand").alias("exam_subject"), *common)
    b = of(1).select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("item_id"), F.lit(2024).alias("year"), nothing("array<string>").alias("topic_tags"), F.col("p_brand").alias("exam_subject"), F.struct(F.lit("https://x.y").alias("url")).alias("source"), *common)
    origin = F.struct(F.lit("ai_generated").alias("source_type"), *(F.lit("x").alias(n) for n in ("source_origin", "verified_date", "verify_verdict")))
    c = of(2).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("subject"), origin.alias("provenance"), nothing("array<string>").alias("topic_tags"), nothing("string").alias("difficulty"), nothing("array<string>").alias("sources"), *common)
    all_ = banks.union(banks.from_variant_a(a), banks.from_variant_b(b), banks.from_pool(c))
    return all_.select("id", "source_type", banks.source_category(F.col("source_type")).alias("category"), "subject", F.coalesce(F.array_contains("quality_flags", "unmapped_subject"), F.lit(False)).alias("unmapped"), "bank_rank")


@query(r"""WITH q AS (SELECT CAST(item_id AS VARCHAR) AS id, left(regexp_replace(text, '\s+', '', 'g'), 14) AS probe FROM benchmark), p AS (SELECT CAST(doc_id AS VARCHAR) AS url, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS text FROM documents)
SELECT id, url FROM q JOIN p ON contains(text, probe) WHERE length(probe) >= 8""")
def pages_with_stem(spark, d):
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    q = _read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), flat("text").alias("stem"))
    return reconcile.pages_with(q, _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), flat("text").alias("text")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS url, n AS number, CASE n WHEN 3 THEN substr('ABCD', CAST(p_size % 4 AS INT) + 1, 1) ELSE c END AS letter FROM part, (VALUES (1, 'B'), (2, 'C'), (3, '')) v(n, c)")
def answer_cards(spark, d):
    t = F.concat(F.lit("1. (B) text\n2 C\nAnswer 3: "), F.substring(F.lit("ABCD"), F.col("p_size") % 4 + 1, F.lit(1)))
    return reconcile.key_letters(_read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("url"), t.alias("text")))


# sessions and feeds


@query("""WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations WHERE turn % 4 <> 1)
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS VARCHAR) AS question_id, p AS new_pos, coalesce(max(CASE WHEN turn = 1 THEN p END) OVER (PARTITION BY conv_id), least(1, count(*) OVER (PARTITION BY conv_id) - 1)) AS new_current FROM s""")
def resumed_sessions(spark, d):
    """Sessions that stood at their second question, which is gone since."""
    c = _read(spark, d, "conversations")
    saved = c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("pos"), F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("question_id"), F.lit(1).cast("long").alias("current"))
    left = saved.where("pos % 4 <> 1").select(F.col("question_id").alias("id"))
    return scoring.resumed(saved, left).select("session_id", F.element_at(F.split("question_id", "/"), 2).alias("question_id"), F.col("new_pos").cast("long").alias("new_pos"), "new_current")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS total, count(*) FILTER (role = 'user') AS answered, CAST(floor(100.0 * count(*) FILTER (role = 'user') / count(*) + 0.5) AS BIGINT) AS percentage FROM conversations GROUP BY conv_id")
def session_progress(spark, d):
    s = _read(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.count("*").alias("total"), F.count_if(F.col("role") == "user").alias("answered"))
    return scoring.progress(s)


@query("""SELECT CAST(conv_id AS VARCHAR) AS session_id, '{"session_id":"' || conv_id || '","n":' || count(*) || ',"wrong":[' || coalesce(string_agg('{"question_id":"' || turn || '","stem":"' || CASE WHEN turn = 0 THEN 'first' ELSE '' END || '","selected_answer":"x","correct_answer":"y"}', ',' ORDER BY CAST(turn AS VARCHAR)) FILTER (role = 'user'), '') || ']}' AS json FROM conversations GROUP BY conv_id""")
def exported_results(spark, d):
    c = _read(spark, d, "conversations").withColumn("session_id", F.col("conv_id").cast("string"))
    wrong = c.where("role = 'user'").select("session_id", F.col("turn").cast("string").alias("question_id"), F.lit("x").alias("selected_answer"), F.lit("y").alias("correct_answer"))
    questions = spark.createDataFrame([("0", "first")], "id string, stem string")
    return stores.export_result(c.groupBy("session_id").agg(F.count("*").alias("n")), wrong, questions)


@query("SELECT CAST(user_id AS VARCHAR) AS store, CAST(arg_max(event_id, event_id) AS VARCHAR) AS value FROM events WHERE event_id > (SELECT coalesce(max(event_id), -1) FROM events WHERE event_id % 1000 = 500) GROUP BY user_id")
def latest_changes(spark, d):
    """A feed of changes that a clear interrupts now and then."""
    feed = _read(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 1000 != 500, F.col("user_id").cast("string")).alias("store"), F.col("event_id").cast("string").alias("value"))
    return streams.latest_change(feed)


@query("SELECT session_id, question_id FROM (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS question_id, turn % 3 AS k FROM conversations) WHERE k = 1")
def wrong_answers(spark, d):
    rows = _read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("question_id"), F.when(F.col("turn") % 3 != 0, F.col("turn") % 3 == 2).alias("is_correct"))
    return scoring.wrong_answers(rows).select("session_id", "question_id")


@query("""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, length('{"user_id":' || user_id || ',"event_id":' || event_id || ',"ts":' || epoch_us(ts) || ',"seq":' || event_id || ',"event_type":"' || event_type || '"}') AS n FROM events),
s AS (SELECT *, sum(n + 1) OVER (PARTITION BY user_id) + 1 AS size FROM l WHERE r <= 5) SELECT user_id, event_id FROM s WHERE size <= 435 OR r = 1""")
def bounded_log(spark, d):
    """The last five entries of each user, where they fit a buffer that about half of them don't."""
    rows = _read(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), "event_type")
    return streams.last_entries(rows, 5, ["user_id"], most_bytes=435).select("user_id", "event_id")
