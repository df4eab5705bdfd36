"""Gates: rules that return violations (id, rule, detail). All rules of a gate run in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.scalars import is_http_url
from quern.operators.patterns import matches

KEYS = ("A", "B", "C", "D")
FLAGS = ("ambiguous", "time_sensitive", "low_confidence", "needs_review")
VERDICTS = ("CONFIRMED", "CORRECTED", "AMBIGUOUS")
DIFFICULTIES = ("easy", "medium", "hard")
SOURCE_TYPES = ("external_mock", "ai_generated")


def violations(rows: DataFrame, ident: Column | str, rules: Iterable[tuple[str, Column, Column | str]]) -> DataFrame:
    """rules: (name, condition, detail). A null condition is no violation. One projection and one explode; no union of scans."""
    hits = [F.when(c, F.struct(F.lit(n).alias("rule"), (F.lit(d) if isinstance(d, str) else F.coalesce(d.cast("string"), F.lit(""))).alias("detail"))) for n, c, d in rules]
    ident = F.col(ident) if isinstance(ident, str) else ident
    return rows.select(ident.cast("string").alias("id"), F.explode(F.filter(F.array(*hits), lambda v: v.isNotNull())).alias("v")).select("id", "v.rule", "v.detail")


def gate(rows: DataFrame, found: DataFrame, least: int = 1) -> DataFrame:
    """population, violations, passed: a gate over fewer than ``least`` rows has not passed."""
    n, v = rows.agg(F.count("*").alias("population")), found.agg(F.count("*").alias("violations"))
    return n.crossJoin(v).withColumn("passed", (F.col("population") >= least) & (F.col("violations") == 0))  # one row each


def enforce(found: DataFrame, most: int = 10) -> None:
    """Raises with the first violations (and how many more there are), if there is any."""
    some = found.orderBy("id", "rule").limit(most).collect()
    if some:
        more = found.count() - len(some)
        raise ValueError("\n".join(f"[{v['rule']}] {v['id']}: {v['detail']}" for v in some) + (f"\nand {more} more" if more > 0 else ""))


def _texts(c: str = "options") -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<struct<key: string, text: string>>")), lambda o: F.coalesce(o["text"], F.lit("")))


def _has(flag: str, column: str = "quality_flags") -> Column:
    return F.coalesce(F.array_contains(column, flag), F.lit(False))


def _any_like(texts: Column, pattern: str) -> Column:
    return F.exists(texts, lambda t: F.regexp_like(t, F.lit(pattern)))


def check_items(items: DataFrame, furniture: tuple[str, ...] = (r"(?i)page [0-9]+ of [0-9]+",), removed: str = r"\[deleted\]") -> DataFrame:
    """Structure of items (id, stem, options, answer, quality_flags, source_urls). furniture: patterns of page headers and footers;
    removed: a take-down marker."""
    keys = F.transform("options", lambda o: o["key"])
    shown, stem = F.array_join(keys, ","), F.coalesce("stem", F.lit(""))
    answered, ambiguous = F.coalesce(F.col("answer") != "", F.lit(False)), _has("ambiguous")
    all_ = F.concat(F.array(stem), _texts())
    first = F.coalesce(*(F.when(_any_like(all_, p), F.lit(p)) for p in furniture))
    bad = F.filter(F.coalesce("source_urls", F.array().cast("array<string>")), lambda u: ~is_http_url(u))
    good = F.exists(F.coalesce("source_urls", F.array().cast("array<string>")), is_http_url)
    return violations(items, "id", [
        ("options_shape", F.coalesce(shown != ",".join(KEYS), F.lit(True)), shown),
        ("ambiguous_must_have_no_answer", ambiguous & answered, F.col("answer")),
        ("missing_answer", ~ambiguous & ~answered, "no answer and not ambiguous"),
        ("answer_not_in_options", answered & ~F.coalesce(F.array_contains(keys, F.col("answer")), F.lit(False)), F.col("answer")),
        ("embedded_newline", F.exists(all_, lambda t: F.regexp_like(t, F.lit(r"[\r\n]"))), "line break in stem or option"),
        ("pdf_furniture", first.isNotNull(), first),
        ("source_site_residue", F.regexp_like(stem, F.lit(removed)) | F.regexp_like(stem, F.lit(r"^\s*[0-9]{1,3}\s*[.\x{3001}]\s*\S")), F.substring(stem, 1, 24)),
        ("empty_stem", F.regexp_replace(stem, r"[\s\p{Z}]+", "") == "", "empty stem"),
        ("empty_option", F.exists(_texts(), lambda t: F.regexp_replace(t, r"[\s\p{Z}]+", "") == ""), "empty option"),
        ("source_not_url", F.size(bad) > 0, F.array_join(bad, ", ")),
        ("time_sensitive_without_source", _has("time_sensitive") & ~good, "no http(s) source"),
    ])


def check_flags(items: DataFrame, stable: DataFrame | None = None, known: tuple[str, ...] = FLAGS, strict_dates: bool = True) -> DataFrame:
    """Coherence of flags: items (id, flags, has_primary, valid_as_of, prior_answer); stable (id): corrected answers registered
    as not going to change."""
    if stable is not None:
        items = items.join(stable.select("id", F.lit(True).alias("_stable")).distinct(), "id", "left")
    settled = F.coalesce(F.col("_stable"), F.lit(False)) if stable is not None else F.lit(False)
    watched, dated = _has("time_sensitive", "flags"), F.coalesce(F.col("valid_as_of") != "", F.lit(False))
    unknown = F.array_except(F.coalesce("flags", F.array().cast("array<string>")), F.array(*map(F.lit, known)))
    return violations(items, "id", [
        ("unknown_flag", F.size(unknown) > 0, F.array_join(unknown, ",")),
        ("time_sensitive_without_primary_source", watched & ~F.coalesce("has_primary", F.lit(False)), "only other sources"),
        ("time_sensitive_without_valid_as_of", watched & ~dated, "no date"),
        ("valid_as_of_without_time_sensitive", F.lit(strict_dates) & ~watched & dated, F.col("valid_as_of")),
        ("corrected_but_unwatched", F.col("prior_answer").isNotNull() & ~watched & ~settled, F.col("prior_answer")),
    ])


def check_bank(items: DataFrame, ident: str = "id") -> DataFrame:
    """Required fields of the main bank."""
    return violations(items, ident, [(f"missing_{c}", F.col(c).isNull(), c) for c in ("stem", "options", "subject") if c in items.columns])


def check_pool(items: DataFrame) -> DataFrame:
    """Practice pool: domains, the verdict against the flags, provenance, repeated option keys; and the structure rules."""
    verdict, kind = F.col("provenance.verify_verdict"), F.col("provenance.source_type")
    ambiguous, answered = _has("ambiguous"), F.coalesce(F.col("answer") != "", F.lit(False))
    keys = F.transform("options", lambda o: o["key"])
    wrong = F.array_except(F.coalesce("quality_flags", F.array().cast("array<string>")), F.array(*map(F.lit, FLAGS)))
    own = violations(items, "id", [
        ("verdict_domain", ~F.coalesce(verdict.isin(*VERDICTS), F.lit(False)), verdict),
        ("source_type_domain", ~F.coalesce(kind.isin(*SOURCE_TYPES), F.lit(False)), kind),
        ("difficulty_domain", F.col("difficulty").isNotNull() & ~F.col("difficulty").isin(*DIFFICULTIES), F.col("difficulty")),
        ("flag_domain", F.size(wrong) > 0, F.array_join(wrong, ",")),
        ("ambiguous_verdict_without_flag", (verdict == "AMBIGUOUS") & ~ambiguous, "flag missing"),
        ("ambiguous_flag_without_verdict", ambiguous & (verdict != "AMBIGUOUS"), verdict),
        ("ambiguous_verdict_with_answer", (verdict == "AMBIGUOUS") & answered, F.col("answer")),
        ("ai_without_metadata", (kind == "ai_generated") & F.col("provenance.ai_metadata").isNull(), "ai_metadata"),
        ("repeated_option_key", F.size(F.array_distinct(keys)) < F.size(keys), F.array_join(keys, ",")),
    ])
    return own.unionByName(check_items(items.select("id", "stem", "options", "answer", "quality_flags", F.col("sources").alias("source_urls"))))


def check_evidence(items: DataFrame) -> DataFrame:
    """Evidence (id, options, answer, evidence, overridden): what it supports is an option, and the answer; with no answer, none;
    it has a URL; a quote has a source."""
    e = F.coalesce("evidence", F.array().cast("array<struct<url: string, quote: string, supports_option: string>>"))
    keys = F.transform("options", lambda o: o["key"])
    named = F.filter(e, lambda x: x["supports_option"].isNotNull())
    return violations(items, "id", [
        ("supports_no_option", F.exists(named, lambda x: ~F.array_contains(keys, x["supports_option"])), "option"),
        ("supports_other_answer", F.col("answer").isNotNull() & ~F.coalesce("overridden", F.lit(False)) & F.exists(named, lambda x: x["supports_option"] != F.col("answer")), F.col("answer")),
        ("supports_without_answer", F.col("answer").isNull() & (F.size(named) > 0), "no answer"),
        ("evidence_without_url", F.exists(e, lambda x: ~is_http_url(x["url"])), "url"),
        ("quote_without_source", F.exists(e, lambda x: (F.trim(x["quote"]) != "") & (F.coalesce(x["url"], F.lit("")) == "")), "quote"),
    ])


def check_corrections(items: DataFrame, registered: DataFrame) -> DataFrame:
    """Bookkeeping of corrected answers: items (id, answer, prior_answer, correction_note, flags, removed_claims, explanation);
    registered (id): those known not to change again."""
    rows = items.join(registered.select("id", F.lit(True).alias("_known")).distinct(), "id", "left")
    changed = F.col("prior_answer").isNotNull()
    return violations(rows, "id", [
        ("prior_equals_answer", F.col("prior_answer").eqNullSafe(F.col("answer")) & changed, F.col("answer")),
        ("note_without_change", F.col("correction_note").isNotNull() & ~changed, F.col("correction_note")),
        ("change_without_note", changed & F.col("correction_note").isNull(), F.col("prior_answer")),
        ("unwatched", changed & ~_has("time_sensitive", "flags") & F.col("_known").isNull(), F.col("prior_answer")),
        ("removed_claim_still_there", F.exists(F.coalesce("removed_claims", F.array().cast("array<string>")), lambda c: F.contains(F.coalesce("explanation", F.lit("")), c)), "claim"),
    ])


def check_unchanged(rows: DataFrame, pins: DataFrame, key: str, value: str) -> DataFrame:
    """Pinned values (key, value) that rows no longer have, or no longer exist."""
    met = pins.select(key, F.col(value).alias("_pin")).join(rows.select(key, F.col(value).alias("_now"), F.lit(True).alias("_there")), key, "left")
    return violations(met, key, [("pin_missing", F.col("_there").isNull(), F.col("_pin")), ("pin_changed", F.col("_there").isNotNull() & ~F.col("_pin").eqNullSafe(F.col("_now")), F.concat_ws(" -> ", "_pin", "_now"))])


def check_metadata(rows: DataFrame, banned: str = r"(?i)(verified_by_human|human_reviewed)") -> DataFrame:
    """id, metadata (map<string,string>): fields that must not exist under any name that fits."""
    bad = F.map_keys(F.map_filter("metadata", lambda k, v: F.regexp_like(k, F.lit(banned))))
    return violations(rows, "id", [("banned_field", F.size(bad) > 0, F.array_join(F.array_sort(bad), ","))])


#: Metadata fields whose names claim what they can't keep, and notes of the pipeline that are no source.
BANNED_FIELDS = ("answer_verified", "sources_count", "confidence", "verification_batch", "verification_date")
NO_SOURCES = ("sync_from_310", "batch_verification", "research_agent")


def check_honesty(rows: DataFrame, citation: str, banned: tuple[str, ...] = BANNED_FIELDS, no_sources: tuple[str, ...] = NO_SOURCES, source: str = "verification_source", least: int = 1) -> DataFrame:
    """id, metadata (map<string,string>): fields that must not stand at the top, sources that are notes of a pipeline, and sources that name no document
    (``citation``: the pattern of those that do). Where fewer than ``least`` rows have metadata, or a source at all, the gate is idle, which is a violation too (id ``*``)."""
    fields, said = F.map_keys(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), F.trim(F.coalesce(F.try_element_at("metadata", F.lit(source)), F.lit("")))
    lying = F.array_sort(F.array_intersect(fields, F.array(*map(F.lit, banned))))
    own = violations(rows, "id", [
        ("banned_field", F.size(lying) > 0, F.array_join(lying, ",")),
        ("no_source", said.isin(*no_sources), said),
        ("not_a_citation", (said != "") & ~said.isin(*no_sources) & ~F.regexp_like(said, F.lit(citation)), said),
    ])
    n = rows.agg(F.count_if(F.size(fields) > 0).alias("held"), F.count_if(said != "").alias("sourced"))
    return own.unionByName(violations(n, F.lit("*"), [("no_metadata", F.col("held") < least, F.col("held")), ("no_sources", F.col("sourced") < least, F.col("sourced"))]))


def check_replaced(items: DataFrame, primary: Column, least: int = 30) -> DataFrame:
    """items (id, options, replaced struct<on, prior_options array<struct<key,text>>, prior_answer, source_url, why>): options that were replaced as a whole must
    say when (an ISO date), what they and the answer were, on what primary source (``primary``: whether ``replaced.source_url`` is one) and why, in more than
    ``least`` characters; and they must have changed. A null struct: nothing was replaced."""
    there, text = F.col("replaced").isNotNull(), lambda c: F.trim(F.coalesce(F.col(f"replaced.{c}"), F.lit("")))
    pairs = lambda options: F.transform(options, lambda o: F.struct(o["key"].alias("key"), o["text"].alias("text")))
    none = F.coalesce(F.size("replaced.prior_options"), F.lit(0)) < 1
    return violations(items, "id", [
        ("replaced_without_date", there & ~F.regexp_like(text("on"), F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), text("on")),
        ("replaced_without_reason", there & (F.length(text("why")) <= least), text("why")),
        ("replaced_without_source", there & (text("source_url") == ""), "source_url"),
        ("replaced_by_other_than_primary", there & (text("source_url") != "") & ~F.coalesce(primary, F.lit(False)), text("source_url")),
        ("replaced_without_prior_options", there & none, "prior_options"),
        ("replaced_without_prior_answer", there & (text("prior_answer") == ""), "prior_answer"),
        ("replaced_by_the_same", there & ~none & pairs("replaced.prior_options").eqNullSafe(pairs("options")), "options"),
    ])


def check_numeric_registry(items: DataFrame, registry: DataFrame, numeric: Column) -> DataFrame:
    """Every question whose options are numbers (``numeric``, over items) is registered: worked out, or looked up with a basis. items (id, options, answer), registry
    (id, expected, kind: 'worked' or 'looked_up', basis). The answer's text holds what is expected, white space and commas aside."""
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s,，]+", "")
    text = F.try_element_at(F.filter("options", lambda o: o["key"] == F.col("answer")), F.lit(1))["text"]
    met = registry.join(items.select("id", text.alias("_text"), F.lit(True).alias("_there")), "id", "left")
    there = F.coalesce("_there", F.lit(False))
    listed = violations(met, "id", [
        ("unknown_id", ~there, F.col("expected")),
        ("other_answer", there & ~F.contains(flat(F.col("_text")), flat(F.col("expected"))), F.col("_text")),
        ("no_basis", (F.col("kind") == "looked_up") & (F.trim(F.coalesce("basis", F.lit(""))) == ""), F.col("expected")),
        ("unknown_kind", ~F.coalesce(F.col("kind").isin("worked", "looked_up"), F.lit(False)), F.col("kind")),
    ])
    missing = items.where(F.coalesce(numeric, F.lit(False))).join(registry.select("id").distinct(), "id", "left_anti")
    return listed.unionByName(violations(missing, "id", [("unregistered", F.lit(True), F.substring("stem", 1, 44))]))


def check_calculations(items: DataFrame, registry: DataFrame) -> DataFrame:
    """registry (id, expected, inputs array<string>) against items (id, stem, options, answer): the digits of the answer's text,
    every input in the stem, and ids that no longer exist."""
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]+", "")
    text = F.try_element_at(F.filter("options", lambda o: o["key"] == F.col("answer")), F.lit(1))["text"]
    met = registry.join(items.withColumn("_text", text).withColumn("_there", F.lit(True)), "id", "left")
    return violations(met, "id", [
        ("unknown_id", F.col("_there").isNull(), F.col("expected")),
        ("other_answer", F.col("_there") & (digits("_text") != digits("expected")), F.col("_text")),
        ("input_missing", F.col("_there") & ~F.forall("inputs", lambda i: F.contains(F.replace(F.col("stem"), F.lit(","), F.lit("")), F.replace(i, F.lit(","), F.lit("")))), F.array_join("inputs", ",")),
    ])


def check_reorder(before: DataFrame, after: DataFrame) -> DataFrame:
    """Option texts must be the same set before and after a reorder (id, options), and the answer's text the same."""
    text = lambda side: F.try_element_at(F.filter(f"{side}.options", lambda o: o["key"] == F.col(f"{side}.answer")), F.lit(1))["text"]
    both = before.alias("b").join(after.alias("a"), F.col("a.id") == F.col("b.id"), "full_outer")
    sorted_ = lambda side: F.array_sort(F.transform(f"{side}.options", lambda o: o["text"]))
    there = F.col("a.id").isNotNull() & F.col("b.id").isNotNull()
    rows = both.select(F.coalesce("a.id", "b.id").alias("id"), there.alias("both"), F.when(F.col("a.id").isNull(), "removed").otherwise("added").alias("lone"), (sorted_("a") == sorted_("b")).alias("same"), text("a").eqNullSafe(text("b")).alias("same_answer"))
    return violations(rows, "id", [("one_sided", ~F.col("both"), F.col("lone")), ("options_changed", F.col("both") & ~F.col("same"), "options"), ("answer_changed", F.col("both") & ~F.col("same_answer"), "answer")])


def check_restored(items: DataFrame, manifest: DataFrame, most_overrides: int = 5) -> DataFrame:
    """Restored items (id, hash, answer, subject) against their manifest (id, source_id, number, hash, matches_source, answer, answer_key,
    override struct<corrected_answer, reason, evidence, decided_on>, source_sha256, document, page, column, subject): one to one,
    the same texts, answers as printed unless an override says why, full coordinates, no number twice, few overrides."""
    m = manifest.select(F.col("id").alias("m_id"), "source_id", "number", F.col("hash").alias("m_hash"), "matches_source", F.col("answer").alias("m_answer"), "answer_key", "override", "source_sha256", "document", "page", "column", F.col("subject").alias("m_subject"))
    both = items.select("id", "hash", "answer", "subject").join(m, F.col("id") == F.col("m_id"), "full_outer").withColumn("_id", F.coalesce("id", "m_id"))
    paired, listed = F.col("id").isNotNull() & F.col("m_id").isNotNull(), F.col("m_id").isNotNull()
    o = F.col("override")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    not_ = lambda c: ~F.coalesce(c, F.lit(False))
    placed = F.regexp_like("source_sha256", F.lit("^[0-9a-f]{64}$")) & is_http_url(F.col("document")) & (F.col("page") >= 1) & F.col("column").isin("left", "right") & (F.col("number") >= 1) & F.col("answer_key").isin(*KEYS)
    own = violations(both, "_id", [
        ("not_in_manifest", ~listed, "item"),
        ("not_in_data", F.col("id").isNull(), "entry"),
        ("text_changed", paired & ~F.col("hash").eqNullSafe(F.col("m_hash")), F.col("m_hash")),
        ("differs_from_source", listed & not_(F.col("matches_source")), "matches_source"),
        ("answer_differs", paired & ~F.col("answer").eqNullSafe(F.col("m_answer")), F.col("m_answer")),
        ("answer_not_as_printed", paired & ~F.col("answer").eqNullSafe(F.col("answer_key")) & not_(o["corrected_answer"] == F.col("answer")), F.col("answer_key")),
        ("override_without_reason", o.isNotNull() & (blank(o["reason"]) | blank(o["evidence"]) | not_(F.regexp_like(o["decided_on"], F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")))), "override"),
        ("override_of_nothing", o["corrected_answer"] == F.col("answer_key"), F.col("answer_key")),
        ("no_coordinates", listed & not_(placed), "coordinates"),
        ("id_not_as_placed", listed & ~F.col("m_id").eqNullSafe(F.concat(F.col("source_id"), F.lit("-q"), F.lpad(F.col("number").cast("string"), 3, "0"))), F.col("source_id")),
        ("other_subject", paired & ~F.col("subject").eqNullSafe(F.col("m_subject")), F.col("m_subject")),
    ])
    twice = manifest.groupBy("source_id", "number").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    all_ = manifest.agg(F.count("override").alias("n"), F.count_if(F.col("column") == "left").alias("left"), F.count_if(F.col("column") == "right").alias("right"))
    whole = violations(all_, F.lit("*"), [("too_many_overrides", F.col("n") > most_overrides, F.col("n")), ("one_column_only", (F.col("left") == 0) | (F.col("right") == 0), "columns")])
    return own.unionByName(violations(twice, "id", [("number_twice", F.lit(True), F.concat_ws("#", "source_id", "number"))])).unionByName(whole)


def check_subjects(items: DataFrame, topics: dict[str, str]) -> DataFrame:
    """Misfiled items (id, subject, stem). topics: pattern -> the one subject that may have it. A pattern that no item has is a
    violation of its own, as it checks nothing."""
    own = violations(items, "id", [("misfiled", F.regexp_like("stem", F.lit(p)) & ~F.col("subject").eqNullSafe(F.lit(s)), F.substring("stem", 1, 40)) for p, s in topics.items()])
    idle = items.agg(*(F.count_if(F.regexp_like("stem", F.lit(p))).alias(f"_{i}") for i, p in enumerate(topics)))
    return own.unionByName(violations(idle, F.lit("*"), [("idle_pattern", F.col(f"_{i}") == 0, p) for i, p in enumerate(topics)]))


def check_copy(docs: DataFrame, required: dict[str, str], forbidden: dict[str, str]) -> DataFrame:
    """Published wording (path, text): patterns that must and must not occur."""
    return violations(docs, "path", [*((f"lacks_{n}", ~F.regexp_like("text", F.lit(p)), p) for n, p in required.items()), *((f"has_{n}", F.regexp_like("text", F.lit(p)), p) for n, p in forbidden.items())])


def check_facts(items: DataFrame, facts: DataFrame) -> DataFrame:
    """facts (fact, support, contradiction: patterns) over stem, explanation and the correct option of items. A fact needs one
    supporter, and none may contradict it (a violation an item that does). Items meet the patterns whose literals they hold (``patterns.matches``)."""
    answer = F.try_element_at(F.filter("options", lambda o: o["key"] == F.col("answer")), F.lit(1))["text"]
    texts = items.select(F.col("id").cast("string").alias("text_id"), F.concat_ws("\n", "stem", "explanation", answer).alias("text"))
    said = lambda kind: facts.select(F.struct(F.col("fact").cast("string").alias("fact"), F.lit(kind).alias("kind")).alias("rule_id"), F.col(kind).alias("pattern"))
    met = matches(texts, said("support").unionByName(said("contradiction"))).select("rule_id.fact", "rule_id.kind", F.col("text_id").alias("_item")).distinct()
    backed = met.where("kind = 'support'").select(F.col("fact").alias("_fact")).distinct()
    none = facts.join(backed, F.col("fact").cast("string") == F.col("_fact"), "left_anti")
    return violations(none, "fact", [("unsupported", F.lit(True), "no supporter")]).unionByName(violations(met, "fact", [("contradicted", F.col("kind") == "contradiction", F.col("_item"))]))
