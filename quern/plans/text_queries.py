"""Catalogue: text, identity and page queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quern.functions import scalars, text
from quern.operators import bank, identity, leakage, rules
from quern.operators.patterns import occurrences
from quern.sources import banks
from quern.streaming import events as streams

from .catalog import query


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The content form in SQL; white space as in quern.functions.text.SPACE.
FORM = r"regexp_replace(lower({0}), '[\p{{P}}\s\p{{Z}}\x{{FEFF}}_]+', '', 'g')"
DOC = FORM.format("coalesce(text, '')")


@query(f"SELECT doc_id, md5({DOC}) AS fingerprint FROM documents")
def norm_fingerprint(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(text.content_form(F.col("text"))).alias("fingerprint"))


@query(f"SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS n FROM documents GROUP BY md5({DOC})")
def content_dedupe(spark, d):
    """The first of each group of equal contents. Only ids and hashes are shuffled."""
    rows = _read(spark, d, "documents").select("doc_id", "source", F.md5(text.content_form(F.col("text"))).alias("key"))
    return bank.first_of_each(rows, F.col("key"), ["doc_id"], count="n").drop("key")


@query(f"SELECT lang, md5({DOC}) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return bank.duplicate_groups(_read(spark, d, "documents"), [F.col("lang"), F.md5(text.content_form(F.col("text"))).alias("key")], "doc_id")


_WORDS = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT item_id, {_WORDS} AS probe FROM benchmark), g AS (SELECT doc_id, ' ' || {_WORDS} || ' ' AS page FROM documents)
SELECT item_id, doc_id FROM p JOIN g ON contains(page, ' ' || probe || ' ') WHERE probe <> ''""")
def cross_bank_containment(spark, d):
    """Benchmark items whose words stand, whole and in order, in a document: an equi-join on word windows, then the exact test."""
    form = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    probes = _read(spark, d, "benchmark").select(F.col("item_id").alias("probe_id"), form.alias("text"))
    found = bank.containment(probes, _read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), form.alias("text")))
    return found.select(F.col("probe_id").alias("item_id"), F.col("page_id").alias("doc_id"))


_HOST = "nullif(regexp_replace(lower(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '@')[-1]), ':[0-9]*$', ''), '')"


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def host_extract(spark, d):
    return _read(spark, d, "pages").select("page_id", scalars.host(F.col("url")).alias("host"))


_TIERS = (("example.com", "primary"), ("example.org", "secondary"), ("tionsh.example.net", "secondary"))


@query(f"""SELECT page_id, h.host, CASE min(CASE tier WHEN 'primary' THEN 0 WHEN 'secondary' THEN 1 END) WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' END AS tier
FROM (SELECT page_id, {_HOST} AS host FROM pages) h LEFT JOIN (VALUES {', '.join(map(str, _TIERS))}) r(host, tier) ON h.host = r.host OR ends_with(h.host, '.' || r.host) GROUP BY page_id, h.host""")
def authority_tier(spark, d):
    rules_ = spark.createDataFrame(list(_TIERS), "host string, tier string")
    return scalars.authority(_read(spark, d, "pages").select("page_id", "url"), rules_).select("page_id", "host", "tier")


_HTML = r"regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query(f"SELECT page_id, length({_HTML}) AS n, md5({_HTML}) AS h FROM pages")
def html_to_text(spark, d):
    t = banks.html_text(F.col("html"), unescape=False)
    return _read(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").alias("n"), F.md5("t").alias("h"))


_PAGE = FORM.format(_HTML)


@query(f"SELECT page_id, length({_PAGE}) >= 500 AND (length({_PAGE}) - length(replace({_PAGE}, '�', ''))) / greatest(length({_PAGE}), 1) < 0.02 AS readable FROM pages")
def readable_pages(spark, d):
    form = text.content_form(banks.html_text(F.col("html"), unescape=False))
    return _read(spark, d, "pages").select("page_id", form.alias("f")).select("page_id", banks.is_readable(F.col("f")).alias("readable"))


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'idiot')")
def keyword_search(spark, d):
    return bank.search(_read(spark, d, "documents"), " Idiot ", "text").select("doc_id", "n_chars")


@query("SELECT doc_id, lang FROM documents ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':42')), doc_id LIMIT 100")
def seeded_sample(spark, d):
    return _read(spark, d, "documents").select("doc_id", "lang").orderBy(bank.sample_order(F.col("doc_id"), 42), "doc_id").limit(100)


@query(r"""SELECT doc_id, len(x) AS n, x[1] AS least, x[-1] AS largest FROM (
SELECT doc_id, list_sort(list_distinct([CAST(v AS DOUBLE) FOR v IN regexp_extract_all(regexp_replace(coalesce(text, ''), '[,，]', '', 'g'), '[0-9]+(?:\.[0-9]+)?')])) AS x FROM documents)""")
def number_tokens(spark, d):
    rows = _read(spark, d, "documents").select("doc_id", text.numbers(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), F.try_element_at("x", F.lit(1)).alias("least"), F.try_element_at("x", F.lit(-1)).alias("largest"))


@query("""WITH r AS (SELECT doc_id AS id, text, lang, source, coalesce(text, '') AS t FROM documents)
SELECT CAST(id AS VARCHAR) AS id, 'empty_text' AS rule, 'no text' AS detail FROM r WHERE trim(t) = ''
UNION ALL SELECT CAST(id AS VARCHAR), 'shouting', left(t, 20) FROM r WHERE regexp_matches(t, '!!')
UNION ALL SELECT CAST(id AS VARCHAR), 'license_line', lang FROM r WHERE contains(t, 'All rights reserved')
UNION ALL SELECT CAST(id AS VARCHAR), 'secret', source FROM r WHERE regexp_matches(t, 'token = "[0-9a-f]{40}"')""")
def rule_violations(spark, d):
    """Several rules in one pass over the texts."""
    t = F.coalesce("text", F.lit(""))
    return rules.violations(_read(spark, d, "documents"), "doc_id", [
        ("empty_text", F.trim(t) == "", "no text"),
        ("shouting", F.regexp_like(t, F.lit("!!")), F.left(t, F.lit(20))),
        ("license_line", F.contains(t, F.lit("All rights reserved")), F.col("lang")),
        ("secret", F.regexp_like(t, F.lit('token = "[0-9a-f]{40}"')), F.col("source")),
    ])


@query("""SELECT CAST(l.doc_id AS VARCHAR) AS id, 'toxic_but_good' AS rule, '' AS detail FROM labels l WHERE quality = 1 AND toxic = 1
UNION ALL SELECT CAST(l.doc_id AS VARCHAR), 'no_document', '' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = l.doc_id)
UNION ALL SELECT CAST(l.doc_id AS VARCHAR), 'label_domain', '' FROM labels l WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)""")
def flag_coherence(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.lit(True).alias("there"))
    met = _read(spark, d, "labels").join(docs, "doc_id", "left")
    return rules.violations(met, "doc_id", [("toxic_but_good", (F.col("quality") == 1) & (F.col("toxic") == 1), ""), ("no_document", F.col("there").isNull(), ""), ("label_domain", ~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1), "")])


@query("""SELECT doc_id, 'missing' AS gap FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'ghost' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def registry_gaps(spark, d):
    return identity.registry_gaps(_read(spark, d, "documents"), _read(spark, d, "labels"), "doc_id")


_HASH = r"sha256(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x{FEFF}]+', '', 'g') || '||')"


@query(f"""WITH o AS (SELECT doc_id, source, {_HASH} AS hash FROM documents), n AS (
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'moved' ELSE source END AS source, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE hash END AS hash FROM o WHERE doc_id % 13 <> 0)
SELECT doc_id, 'source' AS field, o.source AS old, n.source AS new FROM o JOIN n USING (doc_id) WHERE o.source <> n.source
UNION ALL SELECT doc_id, 'hash', o.hash, n.hash FROM o JOIN n USING (doc_id) WHERE o.hash <> n.hash
UNION ALL SELECT o.doc_id, '*', 'removed', NULL FROM o ANTI JOIN n ON o.doc_id = n.doc_id""")
def manifest_diff(spark, d):
    """Documents against a changed copy of their own manifest, field by field."""
    old = _read(spark, d, "documents").select("doc_id", "source", text.item_hash(F.coalesce("text", F.lit("")), F.array().cast(banks.OPTIONS)).alias("hash"))
    new = old.where("doc_id % 13 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "moved").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return identity.field_diff(old, new, ["doc_id"])


@query("""WITH o AS (SELECT lang, source FROM documents), n AS (SELECT lang, CASE WHEN doc_id % 9 = 0 THEN 'src0' ELSE source END AS source FROM documents)
SELECT lang, source, 'old' AS side, count(*) AS n FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) GROUP BY ALL
UNION ALL SELECT lang, source, 'new', count(*) FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) GROUP BY ALL""")
def multiset_diff(spark, d):
    docs = _read(spark, d, "documents")
    return identity.multiset_diff(docs.select("lang", "source"), docs.select("lang", F.when(F.col("doc_id") % 9 == 0, "src0").otherwise(F.col("source")).alias("source")))


_PURE = r"length(regexp_replace(coalesce(text, ''), '[\p{P}\s\p{Z}\x{FEFF}]+', '', 'g'))"


@query(f"SELECT conv_id, arg_max(turn, (n, -turn)) AS longest_turn, max(n) AS n FROM (SELECT conv_id, turn, {_PURE} AS n FROM conversations) GROUP BY conv_id")
def longest_option(spark, d):
    rows = _read(spark, d, "conversations").select("conv_id", "turn", leakage.visible_length(F.col("text")).alias("n"))
    return rows.groupBy("conv_id").agg(F.max_by("turn", F.struct("n", -F.col("turn"))).alias("longest_turn"), F.max("n").alias("n"))


@query("SELECT conv_id, turn, string_agg(coalesce(text, '') || '|', '') OVER (PARTITION BY conv_id, turn >= 2 ORDER BY turn) AS so_far FROM conversations")
def token_stream_prefix(spark, d):
    """Turns as chunks of replies, each up to turn 1 and then the rest."""
    c = _read(spark, d, "conversations")
    chunks = c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.concat(F.coalesce("text", F.lit("")), F.lit("|")).alias("chunk"), (F.col("turn") == 1).alias("is_last"))
    return streams.prefixes(chunks).select(F.col("request_id").alias("conv_id"), F.col("seq").alias("turn"), F.col("text").alias("so_far"))


@query(r"""SELECT conv_id, turn, len(list_distinct(regexp_extract_all(coalesce(text, ''), 'https?://[^\s)\]>"'']+'))) AS n_urls FROM conversations""")
def urls_in_text(spark, d):
    return _read(spark, d, "conversations").select("conv_id", "turn", F.size(text.urls_in(F.col("text"))).cast("long").alias("n_urls"))


@query(r"""SELECT page_id, len(list_distinct(regexp_extract_all(x, '[0-9]+(?:\.[0-9]+)?%'))) AS percents, len(list_distinct(regexp_extract_all(x, '(?:19|20)[0-9]{2}'))) AS years
FROM (SELECT page_id, regexp_replace(coalesce(html, ''), '[\s\p{Z}\x{FEFF}]+', '', 'g') AS x FROM pages)""")
def claim_counts(spark, d):
    none = F.array(F.lit(""))
    c = text.unsupported_claims(F.col("html"), none, {k: (p, False) for k, (p, _) in text.CLAIMS.items() if k in ("percent", "year")})
    n = lambda k: F.size(F.filter("c", lambda x: x["kind"] == k)).cast("long")
    return _read(spark, d, "pages").select("page_id", c.alias("c")).select("page_id", n("percent").alias("percents"), n("year").alias("years"))


@query(r"""WITH b AS (SELECT item_id, regexp_replace(coalesce(text, ''), '[\p{P}\s\p{Z}\x{FEFF}\p{So}\p{Co}■-◿]+', '', 'g') AS q FROM benchmark),
p AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\p{P}\s\p{Z}\x{FEFF}\p{So}\p{Co}■-◿]+', '', 'g') AS p FROM documents)
SELECT item_id, count(*) FILTER (contains(p, q)) AS pages FROM b CROSS JOIN p GROUP BY item_id""", name="verbatim_quote")
def _verbatim(spark, d):
    """How many documents hold each benchmark item verbatim; the items are the stated queries."""
    b = _read(spark, d, "benchmark").select("item_id", text.quote_form(F.col("text")).alias("q"))
    hits = _quoting(b.withColumnRenamed("q", "pattern"), _read(spark, d, "documents")).groupBy("item_id").agg(F.count("*").alias("n"))
    return b.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("long").alias("pages"))


def _quoting(quotes, docs):
    """item_id, doc_id where the document in quote form holds the pattern of quotes (item_id, pattern)."""
    hits = occurrences(docs.select(F.col("doc_id").alias("text_id"), text.quote_form(F.col("text")).alias("text")), quotes.select(F.col("item_id").alias("pattern_id"), "pattern"))
    return hits.select(F.col("pattern_id").alias("item_id"), F.col("text_id").alias("doc_id"))


@query()
def similarity_ratio(spark, d):
    """Each turn of a conversation against the one before: Python's own ratio, so rows only."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = _read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), before.alias("b"))
    return rows.select("conv_id", "turn", text.similarity(F.col("a"), F.col("b")).alias("ratio"))


@query()
def quote_splice(spark, d):
    """Every benchmark item as a quote of every document: the pairs in which it stands there, whole or spliced. Either way its first
    twelve characters do, so only such pairs are looked at further."""
    b = _read(spark, d, "benchmark").select("item_id", text.quote_form(F.col("text")).alias("q")).where("q <> ''")
    docs = _read(spark, d, "documents")
    near = _quoting(b.select("item_id", F.substring("q", 1, 12).alias("pattern")), docs).join(b, "item_id").join(docs.select("doc_id", text.quote_form(F.col("text")).alias("p")), "doc_id")
    return near.select("item_id", "doc_id", text.quote_status(F.col("q"), F.col("p")).alias("status")).where("status <> 'absent'")
