"""The figures that documents and metadata state about the banks, counted in one pass, and the gate that compares them.

items: bank ('main' or 'pool'), id, answer, prior_answer, flags (array), sources (array of URLs), primary (how many of them are primary), evidence
(array<struct<url, quote, primary>>), audit (the citation's verdict), key_checked (boolean), valid_as_of (ISO date). Nulls count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.operators.evidence import claim_diffs, derived_counts

#: Verdicts of the citation audit, by the figure that counts them.
VERDICTS = {"ca_supported": "supported", "ca_replaced": "citation_replaced", "ca_disputed": "citation_disputed", "ca_no_quote": "no_quote", "ca_dead": "dead"}


def bank_metrics(since: str) -> dict[str, Column]:
    """name -> condition. since: the last review's date; what was checked on it or later counts as checked again, an item without a date as never."""
    main, pool, both = F.col("bank") == "main", F.col("bank") == "pool", F.col("bank").isin("main", "pool")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    watched = F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), "time_sensitive")
    corrected = main & filled("prior_answer") & ~F.col("prior_answer").eqNullSafe(F.col("answer"))
    sourced = F.coalesce(F.size("sources"), F.lit(0)) > 0
    primary = F.coalesce(F.col("primary"), F.lit(0)) > 0
    quoted = F.exists("evidence", lambda e: F.coalesce(e["primary"], F.lit(False)) & (F.trim(F.coalesce(e["quote"], F.lit(""))) != ""))
    as_of = F.coalesce("valid_as_of", F.lit(""))
    wrong = F.col("audit").isin(VERDICTS["ca_replaced"], VERDICTS["ca_disputed"])
    counted = {
        "total": main, "with_answer": main & filled("answer"), "time_sensitive": main & watched, "corrections": corrected,
        "main_quote": main & quoted, "main_primary": main & primary, "main_nosource": main & ~sourced,
        "pool_total": pool, "pool_quote": pool & quoted, "pool_primary": pool & primary,
        "corr_with_url": corrected & sourced, "corr_no_url": corrected & ~sourced, "akc_confirmed": both & F.col("key_checked"),
        **{name: both & (F.col("audit") == verdict) for name, verdict in VERDICTS.items()}, "ca_wrong": both & wrong,
        "reverified": main & (as_of >= since), "carried_over": main & watched & (as_of < since), "not_reviewed": main & (as_of < since),
    }
    return counted


def counted(items: DataFrame, since: str) -> DataFrame:
    """name, n of every figure of ``bank_metrics``."""
    return derived_counts(items, bank_metrics(since))


def review_gate(items: DataFrame, declared: DataFrame, since: str) -> DataFrame:
    """declared (name, path, claimed) against the data -> what is not ok: a wrong figure, a name that nothing counts, an anchor that met nothing."""
    return claim_diffs(declared, counted(items, since)).where("status <> 'ok'")


def synced(texts: DataFrame, rules: dict[str, str], metrics: DataFrame) -> DataFrame:
    """texts (path, text), metrics (name, n), rules (name -> pattern with one group, the number) -> path, text, changed (names whose number was not the
    counted one), dead (names whose pattern met nothing there): the texts with the counted numbers put where the patterns' groups are."""
    one = metrics.where(F.col("name").isin(*rules)).agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("n").cast("string").alias("n")))).alias("_n"))  # one row, an entry a rule
    out = texts.select("path", "text", F.array().cast("array<string>").alias("changed"), F.array().cast("array<string>").alias("dead")).crossJoin(F.broadcast(one))
    for name, pattern in rules.items():
        whole, said, now = F.regexp_extract("text", pattern, 0), F.regexp_extract("text", pattern, 1), F.try_element_at("_n", F.lit(name))
        met, other = whole != "", F.regexp_replace(said, ",", "") != now
        # Within what the pattern met, the number is put in place of the group's text where it stands first.
        at = F.instr(F.col("text"), whole) + F.instr(whole, said) - 1
        new = F.concat(F.substr(F.col("text"), F.lit(1), at - 1), now, F.substr(F.col("text"), at + F.length(said)))
        out = out.withColumns({
            "text": F.when(met & now.isNotNull() & other, new).otherwise(F.col("text")),
            "changed": F.when(met & now.isNotNull() & other, F.array_append("changed", F.lit(name))).otherwise(F.col("changed")),
            "dead": F.when(met, F.col("dead")).otherwise(F.array_append("dead", F.lit(name))),
        })
    return out.drop("_n")
