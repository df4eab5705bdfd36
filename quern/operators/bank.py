"""The query layer over the canonical relation (or any table with such columns)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import content_signature, tag_form
from quern.operators.patterns import MOST, occurrences


def of_subject(items: DataFrame, subject: str = "all", answerable: bool = False) -> DataFrame:
    out = items if subject == "all" else items.where(F.col("subject") == subject)
    return out.where("has_answer") if answerable else out


def search(items: DataFrame, keyword: str, text: str = "stem") -> DataFrame:
    """Case-insensitive substring; a blank keyword finds nothing."""
    k = keyword.strip().lower()
    return items.where(F.contains(F.lower(text), F.lit(k))) if k else items.where(F.lit(False))


def pool_filter(items: DataFrame, source_types: list | None = None, subjects: list | None = None, difficulties: list | None = None, tags: list[str] | None = None, exclude_flags: list[str] | None = None) -> DataFrame:
    """All constraints hold; None is no constraint, an empty list fits nothing (but excludes nothing). None may be a subject."""
    for column, allowed in (("source_type", source_types), ("subject", subjects), ("difficulty", difficulties)):
        if allowed is not None:
            known = [a for a in allowed if a is not None]
            fits = F.coalesce(F.col(column).isin(known), F.lit(False)) if known else F.lit(False)
            items = items.where(fits | F.col(column).isNull() if None in allowed else fits)
    if tags is not None:
        wanted = F.array(*(tag_form(F.lit(t)) for t in tags)) if tags else F.array().cast("array<string>")
        items = items.where(F.coalesce(F.arrays_overlap(F.transform("topic_tags", tag_form), wanted), F.lit(False)))
    if exclude_flags:
        items = items.where(~F.coalesce(F.arrays_overlap("quality_flags", F.array(*map(F.lit, exclude_flags))), F.lit(False)))
    return items


def admissible(items: DataFrame, subject: str = "all") -> DataFrame:
    """For a named subject, unmapped items are out; for all, nothing is."""
    if subject == "all":
        return items
    return items.where(~F.coalesce(F.array_contains("quality_flags", "unmapped_subject"), F.lit(False)) & (F.col("subject") == subject))


def signature_key(stem: str = "stem", options: str = "options") -> Column:
    return F.md5(content_signature(F.col(stem), F.transform(options, lambda o: o["text"])))


def first_of_each(items: DataFrame, key: Column, order: list[str], count: str | None = None) -> DataFrame:
    """The first row of each key by the order columns: an aggregate with map-side combination, so a hot key isn't sorted in one
    task; ties in the order are broken by nothing else, so it must be total. count: a further column with the key's rows."""
    rest = items.columns
    low = items.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.count("*").alias("_n"))
    return low.select(*(F.col("_r")[c].alias(c) for c in rest), *([F.col("_n").alias(count)] if count else []))


def dedupe(items: DataFrame, order: tuple[str, ...] = ("bank_rank", "pos")) -> DataFrame:
    return first_of_each(items, signature_key(), list(order))


def duplicate_groups(items: DataFrame, keys: list[Column], ident: str = "id") -> DataFrame:
    return items.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ident).alias("first_id")).where("n > 1")


def sample_order(ident: Column, seed: int) -> Column:
    """A reproducible random order: md5 of id and seed, then the id."""
    return F.md5(F.concat(ident.cast("string"), F.lit(f":{seed}")))


def draw(items: DataFrame, count: int, subject: str = "all", answerable: bool = False, seed: int = 0, scope: str = "subject", shuffled: bool = True) -> DataFrame:
    """An exam: count items of different contents (all, if there are fewer). scope 'subject' keeps to the subject first and then
    drops duplicates; 'union' drops duplicates over everything first, so a twin whose first copy is elsewhere is lost."""
    if scope == "union":
        items = admissible(dedupe(items), subject)
    else:
        items = dedupe(of_subject(items, subject))
    items = items.where("has_answer") if answerable else items
    if not shuffled:
        return items.orderBy("bank_rank", "pos").limit(count)
    return items.orderBy(sample_order(F.col("id"), seed), "id").limit(count)


def sample(items: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """count rows in a reproducible random order; where there are no more than count, all of them as they stand (by bank_rank and pos)."""
    if items.limit(count + 1).count() <= count:
        return items.orderBy(*(c for c in ("bank_rank", "pos") if c in items.columns))
    return items.orderBy(sample_order(F.col("id"), seed), "id").limit(count)


def pick(pool: DataFrame, count: int, convert: Callable[[DataFrame], DataFrame], seed: int = 0, **filters) -> DataFrame:
    """Filters a pool (as ``pool_filter``), samples it, and converts only what is drawn."""
    return convert(sample(pool_filter(pool, **filters), count, seed))


def similar(items: DataFrame, ident, k: int = 5, id_col: str = "id", text: str = "stem", cut: str = r"[\s\p{P}]+") -> DataFrame:
    """The k items most like one: 2 points for the subject, 1 for each keyword of its text (two characters or more, repeats count)
    that the other's text holds. One pass over items; the one row's keywords are joined as a single row."""
    words = F.filter(F.split(text, cut), lambda w: F.length(w) >= 2)
    one = items.where(F.col(id_col) == ident).orderBy("pos").limit(1).select(words.alias("_words"), F.col("subject").alias("_subject"))
    scored = items.where((F.col(id_col) != ident) & F.col("has_answer")).crossJoin(F.broadcast(one))  # one row
    score = F.when(F.col("subject") == F.col("_subject"), 2).otherwise(0) + F.size(F.filter("_words", lambda w: F.contains(F.col(text), w)))
    return scored.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "pos").limit(k).drop("_words", "_subject")


def by_id(items: DataFrame, ident, id_col: str = "id") -> DataFrame:
    """The item of an id: the first, if there are several; none for an unknown id."""
    return items.where(F.col(id_col) == ident).orderBy("bank_rank", "pos").limit(1)


def containment(probes: DataFrame, pages: DataFrame, most: int = MOST) -> DataFrame:
    """probes (probe_id, text), pages (page_id, text), both in normal form (words with one space between) -> pairs where the page holds the probe,
    word by word: all probes in one pass over the pages (``patterns.occurrences``). Empty and null texts hold nothing and are held by none."""
    spaced = F.when(F.length("text") > 0, F.concat(F.lit(" "), "text", F.lit(" ")))
    hits = occurrences(pages.select(F.col("page_id").alias("text_id"), spaced.alias("text")), probes.select(F.col("probe_id").alias("pattern_id"), spaced.alias("pattern")), most)
    return hits.select(F.col("pattern_id").alias("probe_id"), F.col("text_id").alias("page_id"))

