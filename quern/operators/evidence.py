"""Sources and evidence: authority, tiers, manifests, gaps, derived counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.scalars import authority, half_up


def evidence_manifest(items: DataFrame, rules: DataFrame) -> DataFrame:
    """items (bank, qid, urls array<string>, evidence array<struct<url, quote>>) -> a row an URL: qid, bank, url, host, authority,
    has_quote, tier1 (primary, and quoted on that very URL)."""
    rows = items.select("bank", "qid", F.explode("urls").alias("url"), "evidence")
    quoted = F.exists(F.coalesce("evidence", F.array().cast("array<struct<url: string, quote: string>>")), lambda e: (e["url"] == F.col("url")) & (F.trim(e["quote"]) != ""))
    out = authority(rows.withColumn("has_quote", F.coalesce(quoted, F.lit(False))).drop("evidence"), rules)
    return out.select("qid", "bank", "url", "host", F.coalesce("tier", F.lit("unknown")).alias("authority"), "has_quote", (F.coalesce(F.col("tier") == "primary", F.lit(False)) & F.col("has_quote")).alias("tier1"))


def tier_summary(manifest: DataFrame) -> DataFrame:
    """bank, authority, urls, quoted; and how many distinct questions of the bank have tier-1 evidence."""
    by = manifest.groupBy("bank", "authority").agg(F.count("*").alias("urls"), F.count_if("has_quote").alias("quoted"))
    return by.join(manifest.groupBy("bank").agg(F.count_distinct(F.when(F.col("tier1"), F.col("qid"))).alias("tier1_questions")), "bank")


def unclassified_hosts(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("authority") == "unknown").select("host").distinct()


CALCULATION = r"(?i)(how (many|much)|calculate|compute)"


def is_calculation(text: Column, phrase: str = CALCULATION) -> Column:
    return F.regexp_like(text, F.lit(phrase)) & F.regexp_like(text, F.lit("[0-9]"))


def gap_buckets(items: DataFrame, phrase: str = CALCULATION) -> DataFrame:
    """items (bank, id, stem, has_source, has_primary, has_quote, fabricated): bucket and part of each that lacks something."""
    bucket = F.when(~F.col("has_source"), "no_source").when(~F.col("has_primary"), "nonprimary").when(~F.col("has_quote"), "primary_no_quote")
    part = F.when(is_calculation(F.col("stem"), phrase), "calculation").when(F.col("fabricated"), "fabricated").otherwise("rest")
    return items.select("bank", "id", bucket.alias("bucket"), part.alias("part")).where("bucket IS NOT NULL")


def gap_counts(buckets: DataFrame) -> DataFrame:
    """With subtotals: bank and bucket are null in the rows that sum over them; ``summed`` tells these from rows of a null bank: 0 for
    none, 1 for all buckets of a bank, 3 for all."""
    return buckets.rollup("bank", "bucket").agg(F.grouping_id().cast("int").alias("summed"), F.count("*").alias("n"))


def derived_counts(items: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """name, n of each condition, all in one pass."""
    row = items.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in metrics.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in metrics))).alias("m")).select("m.name", "m.n")


def bank_statistics(items: DataFrame, declared: DataFrame) -> DataFrame:
    """declared (key, name, total: key is a column of items, name a value of it, '*' for all rows) against items, all in one pass:
    key, name, total, n, agrees."""
    keys = [r["key"] for r in declared.select("key").distinct().collect() if r["key"] in items.columns]  # columns of one table
    cells = F.array(F.struct(F.lit("*").alias("key"), F.lit("*").alias("name")), *(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("name")) for k in keys))
    n = items.select(F.explode(cells).alias("c")).groupBy("c.key", "c.name").agg(F.count("*").alias("n"))
    met = declared.join(n, ["key", "name"], "left")
    return met.select("key", "name", "total", F.coalesce("n", F.lit(0)).alias("n"), (F.col("total") == F.coalesce("n", F.lit(0))).alias("agrees"))


def claim_diffs(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """claims (name, path, claimed) against metrics (name, n): status ok, wrong, dead (pattern met nothing) or unknown."""
    met = claims.join(metrics, "name", "left")
    return met.select("name", "path", "claimed", "n", F.when(F.col("claimed").isNull(), "dead").when(F.col("n").isNull(), "unknown").when(F.col("claimed") == F.col("n"), "ok").otherwise("wrong").alias("status"))


def coverage(items: DataFrame, since: str) -> DataFrame:
    """items (reviewed_on): reverified, carried_over, not_reviewed, and total."""
    on = F.coalesce("reviewed_on", F.lit(""))
    n = items.agg(F.count("*").alias("total"), F.count_if(on >= since).alias("reverified"), F.count_if((on < since) & (on != "")).alias("carried_over"))
    return n.withColumn("not_reviewed", F.col("total") - F.col("reverified"))


def error_rate(population: Column, unverifiable: Column, defects: Column) -> Column:
    """Percent with one decimal of what can be verified."""
    return F.when(population > unverifiable, half_up(1000.0 * defects / (population - unverifiable)) / 10)


def reconciled_totals(items: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """declared (key, total) against the data; either side may lack a key."""
    n = items.groupBy(key).agg(F.count("*").alias("n"))
    return declared.join(n, key, "full_outer").select(key, "total", "n", (F.coalesce("total", F.lit(0)) == F.coalesce("n", F.lit(0))).alias("agrees"))


def tally(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).count().orderBy(F.desc("count"), by)
