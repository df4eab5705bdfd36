"""URL filters: stated host and path rules first, then association rules mined from labelled pages by Spark's FP-growth.

DataFrame and SQL functions only (FP-growth is Spark's own, in the JVM). A URL is a set of tokens: the scheme, each part of
its host, each part of its path that is no number, its extension, its query's parameter names and whether it has a fragment.
Token combinations that imply the label "block" with enough support and confidence become rules, pruned where a more general
rule is as confident. Rules match by an inverted index on their rarest token, so a page meets few candidates.

Defined cases: very long URLs are cut whole; of rules that fit equally long ones the greater. Null URLs, or those without ``://``: empty host and path, no tokens, verdict allow. No labels, or no rule that
passes: everything that no stated rule blocks is allowed. Repeated pages: each row judged alike. Empty tables: empty results.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import meet, table, written

#: (host, path, verdict) as the contract states them.
STATED = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: A rule needs this share of the labelled pages, and so many pages at least, or else it is chance.
SUPPORT, LEAST, CONFIDENCE = 0.002, 10, 0.8
#: Stated lists of at most so many rules are part of the plan.
IN_PLAN = 1000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    return F.coalesce(F.when(at > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def stated_rule(host: Column, path: Column, rules=STATED) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null, for lists short enough to stand in the plan."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def with_stated_rule(rows: DataFrame, rules=STATED) -> DataFrame:
    """rows (host, path, ...) with _rule as ``stated_rule`` has it. Longer lists are a table: the distinct hosts and paths meet it
    by the host and the domains above it."""
    if len(rules) <= IN_PLAN:
        return rows.withColumn("_rule", stated_rule(F.col("host"), F.col("path"), rules))
    listed = written(rows.sparkSession.createDataFrame([(h, p, h + p, v) for h, p, v in rules], "_domain string, _path string, rule string, verdict string"), "stated")
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = meet(rows.select("host", "path").distinct().select("host", "path", F.explode(above).alias("_domain")), listed, ["_domain"])
    best = met.where(F.startswith("path", F.col("_path"))).groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("_rule"))
    return rows.join(best, ["host", "path"], "left")


def tokens(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    rest = F.regexp_extract(url, r"^.*?://[^/?#]*[^?#]*(.*)$", 1)
    steps = F.filter(F.split(path, "[/.]"), lambda x: F.length(F.regexp_replace(x, "^[0-9]*$", "")) > 0)
    names = F.filter(F.regexp_extract_all(rest, F.lit(r"[?&]([^=&#]+)"), 1), lambda x: x != "")
    found = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"^(.*?)://", 1)))),
        F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(steps, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(names, lambda x: F.concat(F.lit("query:"), x)),
        F.when(F.contains(rest, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.instr(url, "://") > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


LABEL = "label:block"


def token_classes(baskets: DataFrame, blocked_at_least: Column) -> DataFrame:
    """baskets (basket, items, block) -> token, item: the tokens on enough blocked pages, and the one (the least) that stands for all that are
    on the very same pages. No rule has two of a class, as one alone is as sure; and each can take another's place."""
    each = baskets.select("basket", "block", F.explode("items").alias("token"))
    pages = F.struct(F.count("*"), F.bit_xor(F.xxhash64("basket")), F.bit_xor(F.xxhash64("basket", F.lit(1))), F.sum(F.xxhash64("basket", F.lit(2)).cast("decimal(20,0)")))
    sets = each.groupBy("token").agg(F.count_if("block").alias("blocked"), pages.alias("pages")).where(F.col("blocked") >= blocked_at_least)
    return sets.groupBy("pages").agg(F.collect_list("token").alias("tokens")).select(F.array_min("tokens").alias("item"), F.explode("tokens").alias("token"))


def _not_beaten(sets: DataFrame, confidence: float) -> DataFrame:
    """sets (items, n, confidence: of all frequent sets) -> the confident ones of which no true subset is as confident. Level by level: what a set's
    subsets of one item less have reached at most, they and their subsets, is looked up by the hash of their items."""
    rules, below, n = [], None, 0
    sets = sets.withColumn("key", F.xxhash64("items"))
    deepest = sets.agg(F.max("n").alias("n")).first()["n"] or 0
    for n in range(1, deepest + 1):
        level = sets.where(F.col("n") == n)
        if below is None:
            level = level.withColumn("reached", F.lit(0.0))
        else:
            less = level.select("key", F.explode(F.transform("items", lambda x: F.xxhash64(F.array_remove("items", x)))).alias("without"))
            known = less.join(below, "without").groupBy("key").agg(F.max("best").alias("reached"))
            level = level.join(known, "key", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0)))
        level = written(level, "level")
        rules.append(level.where((F.col("confidence") >= confidence) & (F.col("confidence") > F.col("reached"))).drop("reached"))
        sure = F.when(F.col("confidence") >= confidence, F.col("confidence")).otherwise(0.0)
        below = level.select(F.col("key").alias("without"), F.greatest("reached", sure).alias("best"))
    return reduce(DataFrame.unionByName, rules) if rules else sets


def mine(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """labelled (items array<string>, block boolean) -> rules (rule_id, items, choices, n, support, confidence), sorted tokens; choices: for each
    item all tokens that may stand in its place (``token_classes``), so a rule says what all its variants would say.

    support: share of labelled pages that hold the tokens and the label (``least`` pages at least); a rule has any number of tokens. A rule goes if one
    with a true subset of its tokens is at least as confident. Only tokens frequent among the blocked pages can take part, and
    they are found before mining, as are tokens that always come together, which would else be mined in all their combinations.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "rule_id long, items array<string>, choices array<array<string>>, n int, support double, confidence double")
    baskets = written(labelled.select(F.monotonically_increasing_id().alias("basket"), "items", "block").where(F.col("block") | (F.size("items") > 0)), "baskets")
    total = baskets.count()
    if not total:
        return none
    share = min(1.0, max(support, (least - 0.5) / total))
    classes = written(token_classes(baskets, F.lit(int(math.ceil(share * total - 1e-9)))), "classes")
    held = baskets.select("basket", F.explode("items").alias("token"))
    chosen = meet(held, classes, ["token"]).groupBy("basket").agg(F.collect_set("item").alias("items"))
    marked = baskets.select("basket", "block").join(chosen, "basket", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("block"), F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(marked)
    frequent = written(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "frequent")
    labelled_sets = frequent.where(F.array_contains("items", LABEL) & (F.size("items") > 1)).select(F.array_remove("items", LABEL).alias("items"), F.col("freq").alias("blocked"))
    sets = labelled_sets.join(frequent, "items").select("items", F.size("items").alias("n"), (F.col("blocked") / total).alias("support"), (F.col("blocked") / F.col("freq")).alias("confidence"))
    rules = _not_beaten(written(sets, "sets"), confidence)
    if "key" not in rules.columns:
        return none
    rules = rules.select(F.col("key").alias("rule_id"), "items", "n", "support", "confidence")
    all_choices = classes.groupBy("item").agg(F.array_sort(F.collect_list("token")).alias("choice"))
    spread = rules.select("rule_id", F.posexplode("items").alias("at", "item")).join(all_choices, "item")
    choices = spread.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "choice"))), lambda c: c["choice"]).alias("choices"))
    return rules.join(choices, "rule_id").select("rule_id", "items", "choices", "n", "support", "confidence")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The (url, rule_id) of distinct URLs and the rules of whose items they all hold a choice."""
    stands = written(rules.select(F.explode(F.arrays_zip("items", "choices")).alias("c")).select("c.items", F.explode("c.choices").alias("_held")).distinct(), "choices")
    found = urls.select("url").where(F.col("url").isNotNull()).distinct().withColumn("_held", F.explode(tokens(F.col("url"))))
    known = meet(found, stands.withColumnRenamed("items", "item"), ["_held"])
    held = known.groupBy("url").agg(F.collect_set("item").alias("items")).withColumn("_token", F.explode("items"))
    often = held.groupBy("_token").count()
    listed = rules.select("rule_id", F.col("items").alias("rule_items"), F.explode("items").alias("_token")).join(often, "_token")
    index = written(listed.groupBy("rule_id").agg(F.min_by(F.struct("_token", "rule_items"), F.struct("count", "_token")).alias("at")).select("rule_id", "at.*"), "index")
    return meet(held, index, ["_token"]).where(F.size(F.array_except("rule_items", "items")) == 0).select("url", "rule_id")


def judge(pages: DataFrame, labelled: DataFrame, stated=STATED, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """pages (page_id, url), labelled (url, block) -> page_id, host, path, rule, verdict, mined (whether a mined rule matches)."""
    rules = written(mine(labelled.select(tokens(F.col("url")).alias("items"), F.coalesce(F.col("block"), F.lit(False)).alias("block")), support, least, confidence), "url_rules")
    out = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hit = matches(out, rules).select("url").distinct().withColumn("mined", F.lit(True))
    out = with_stated_rule(out.join(hit, "url", "left"), stated)
    mined = F.coalesce(F.col("mined"), F.lit(False))
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), F.when(mined, "block").otherwise("allow")).alias("verdict"), mined.alias("mined"))


def query(spark, sf_dir):
    """A page's labels are those of the document of its id; of low quality or toxic: block."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    labelled = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return judge(pages, labelled)


_LOWER = "translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The same by plain set enumeration: every set of up to three tokens is counted, with and without the label. Longer rules, which
#: the operator mines too, are tested by brute force.
ORACLE = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN {_LOWER} ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    regexp_extract(url, '^.*?://[^/?#]*[^?#]*(.*)$', 1) AS rest FROM pages),
tok AS (
  SELECT DISTINCT url, unnest(list_concat(
    ['scheme:' || lower(regexp_extract(url, '^(.*?)://', 1))],
    [('host:' || x) FOR x IN string_split(host, '.') IF x <> ''],
    [('path:' || x) FOR x IN regexp_split_to_array(path, '[/.]') IF regexp_replace(x, '^[0-9]*$', '') <> ''],
    [('query:' || x) FOR x IN regexp_extract_all(rest, '[?&]([^=&#]+)', 1) IF x <> ''],
    CASE WHEN contains(rest, '#') THEN ['fragment'] ELSE [] END)) AS t
  FROM cut WHERE instr(url, '://') > 0),
lab AS (
  SELECT row_number() OVER () AS b, p.url, coalesce(quality = 0 OR toxic = 1, false) AS block FROM pages p JOIN labels l ON p.page_id = l.doc_id),
basket AS (SELECT b, block, t FROM lab LEFT JOIN tok USING (url)),
n AS (SELECT count(*) AS n FROM (SELECT b FROM basket GROUP BY b HAVING count(t) > 0 OR bool_or(block))),
sets AS (
  SELECT b, block, [t] AS items FROM basket WHERE t IS NOT NULL
  UNION ALL SELECT x.b, x.block, [x.t, y.t] FROM basket x JOIN basket y ON x.b = y.b AND x.t < y.t
  UNION ALL SELECT x.b, x.block, [x.t, y.t, z.t] FROM basket x JOIN basket y ON x.b = y.b AND x.t < y.t JOIN basket z ON x.b = z.b AND y.t < z.t),
counted AS (SELECT items, count(*) AS c, count(*) FILTER (block) AS cb FROM sets GROUP BY items),
rules AS (SELECT items, cb / c AS confidence FROM counted, n WHERE cb >= greatest(ceil({SUPPORT} * n.n), {LEAST}) AND cb / c >= {CONFIDENCE}),
hit AS (
  SELECT DISTINCT h.url FROM (SELECT url, list(t) AS held FROM tok GROUP BY url) h JOIN rules r ON list_has_all(h.held, r.items)),
ruled AS (
  SELECT c.*, s.rule, s.verdict AS stated, row_number() OVER (PARTITION BY page_id, c.url ORDER BY length(s.rule) DESC, s.rule DESC) AS k
  FROM cut c LEFT JOIN (VALUES {', '.join(f"('{h}', '{p}', '{h}{p}', '{v}')" for h, p, v in STATED)}) s(rule_host, rule_path, rule, verdict)
    ON (c.host = s.rule_host OR ends_with(c.host, '.' || s.rule_host)) AND starts_with(c.path, s.rule_path))
SELECT page_id, host, path, rule, coalesce(stated, CASE WHEN hit.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, hit.url IS NOT NULL AS mined
FROM ruled LEFT JOIN hit ON ruled.url = hit.url WHERE k = 1
"""
