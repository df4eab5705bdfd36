"""Question banks: schemas, readers, the canonical relation, and ingestion of pages, laws, documents and laid-out words.

Order is data here: every relation carries (bank_rank, pos), as Spark keeps no array order of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.functions.scalars import is_http_url
from quern.functions.text import unescape_html

OPTIONS = "array<struct<key: string, text: string>>"
EVIDENCE = "array<struct<url: string, quote: string, supports_option: string>>"
METADATA = f"struct<verification_source: string, sources: array<string>, valid_as_of: string, prior_answer: string, evidence: {EVIDENCE}>"
VARIANT_A = f"index int, number int, stem string, options {OPTIONS}, answer string, source string, exam_subject string, explanation string, quality_flags array<string>, metadata {METADATA}"
VARIANT_B = f"item_id string, year int, topic_tags array<string>, stem string, options {OPTIONS}, answer string, explanation string, source struct<source_id: string, url: string, publisher: string>, exam_subject string, quality_flags array<string>, metadata {METADATA}"
POOL = f"id string, stem string, options {OPTIONS}, answer string, explanation string, subject string, topic_tags array<string>, difficulty string, provenance struct<source_type: string, source_origin: string, verified_date: string, verify_verdict: string, ai_metadata: struct<model_family: string, generation_date: string>>, sources array<string>, quality_flags array<string>, metadata {METADATA}"
CANONICAL = ("id", "stem", "options", "answer", "subject", "source_type", "year", "has_answer", "sources", "explanation", "provenance", "quality_flags", "topic_tags", "difficulty", "bank_rank", "pos")


def read_items(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The array ``field`` of one JSON document as rows with pos. Records that don't fit the schema become nulls, not errors."""
    doc = spark.read.schema(f"{field} array<struct<{_struct(schema)}>>").option("multiLine", True).json(path)
    return doc.select(F.posexplode(field).alias("pos", "item")).select(F.col("pos").cast("long").alias("pos"), "item.*")


def _struct(ddl: str) -> str:
    """Field list of a struct from a column list (top-level names get a colon)."""
    out, depth, field = [], 0, ""
    for c in ddl + ",":
        if c == "," and depth == 0:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            field = ""
            continue
        depth += (c == "<") - (c == ">")
        field += c
    return ", ".join(out)


def source_urls(listed: Column, single: Column) -> Column:
    """http(s) sources, distinct, in order; null if there is none."""
    found = F.array_distinct(F.filter(F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.array(single)), is_http_url))
    return F.when(F.size(found) > 0, found)


def evidence_urls(listed: Column, single: Column, evidence: Column) -> Column:
    """The same with the evidence's URLs: the one definition that counts, tiers and reports share; never null."""
    more = F.transform(F.coalesce(evidence, F.array().cast(EVIDENCE)), lambda e: e["url"])
    return F.array_distinct(F.filter(F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.array(single), more), is_http_url))


#: How the canonical relation names items of the main bank's two shapes, and their answers' category.
NUMBERED_PREFIX, NUMBERED, NAMED, MAIN_BANK = "gist-", "gist", "unique", "main_bank"


def source_category(source_type: Column) -> Column:
    """The category under which answers are counted: one for the main bank's shapes, else the pool item's own source; none counts as the main bank."""
    return F.when(source_type.isNull() | source_type.isin(NUMBERED, NAMED), MAIN_BANK).otherwise(source_type)


def from_variant_a(items: DataFrame, rank: int = 0) -> DataFrame:
    """Items by number; their year is not known."""
    return items.select(F.concat(F.lit(NUMBERED_PREFIX), F.col("index").cast("string")).alias("id"), "stem", "options", "answer", F.col("exam_subject").alias("subject"), F.lit(NUMBERED).alias("source_type"), F.lit(None).cast("int").alias("year"), F.col("answer").isNotNull().alias("has_answer"), source_urls(F.col("metadata.sources"), F.lit(None).cast("string")).alias("sources"), "explanation", "quality_flags", F.lit(rank).alias("bank_rank"), *([c for c in ("pos",) if c in items.columns]))


def from_variant_b(items: DataFrame, rank: int = 1) -> DataFrame:
    return items.select(F.col("item_id").alias("id"), "stem", "options", "answer", F.col("exam_subject").alias("subject"), F.lit(NAMED).alias("source_type"), "year", F.col("answer").isNotNull().alias("has_answer"), source_urls(F.col("metadata.sources"), F.col("source.url")).alias("sources"), "explanation", "quality_flags", "topic_tags", F.lit(rank).alias("bank_rank"), *([c for c in ("pos",) if c in items.columns]))


def mapped_subject(raw: Column, first: tuple[str, str] = ("1", "一"), second: tuple[str, str] = ("2", "二"), names: tuple[str, str] = ("subject 1", "subject 2")) -> tuple[Column, Column]:
    """(subject, whether it could be mapped): the first sign that occurs decides; unmapped ones go to the second."""
    one = F.contains(raw, F.lit(first[0])) | F.contains(raw, F.lit(first[1]))
    two = F.contains(raw, F.lit(second[0])) | F.contains(raw, F.lit(second[1]))
    return F.when(one, names[0]).otherwise(names[1]), F.coalesce(one | two, F.lit(False))


def from_pool(items: DataFrame, rank: int = 2) -> DataFrame:
    """Explanations are not carried over; an unmapped subject is flagged (a computed flag, never stored)."""
    subject, known = mapped_subject(F.col("subject"))
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    return items.select("id", "stem", "options", "answer", subject.alias("subject"), F.coalesce(F.col("provenance.source_type"), F.lit(MAIN_BANK)).alias("source_type"), F.lit(None).cast("int").alias("year"), F.col("answer").isNotNull().alias("has_answer"), source_urls(F.col("sources"), F.lit(None).cast("string")).alias("sources"), F.struct(*(F.col(f"provenance.{n}").alias(n) for n in ("source_type", "source_origin", "verified_date", "verify_verdict"))).alias("provenance"), F.when(known, flags).otherwise(F.array_append(flags, F.lit("unmapped_subject"))).alias("quality_flags"), "topic_tags", "difficulty", F.lit(rank).alias("bank_rank"), *([c for c in ("pos",) if c in items.columns]))


def union(*banks: DataFrame) -> DataFrame:
    """Ordered concatenation: (bank_rank, pos) orders the rows."""
    out = banks[0]
    for b in banks[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def html_text(html: Column, unescape: bool = True) -> Column:
    """Text of a page: scripts and styles out with what is in them, tags to spaces, entities unescaped (Arrow)."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</(script|style)\s*>", " "), r"(?s)<[^>]*>", " ")
    return unescape_html(bare) if unescape else bare


def read_results(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Files of a glob, each a JSON array of objects -> (file, result as JSON text), and (file, size) of those that are no JSON
    array, which are reported and not guessed at."""
    files = spark.read.option("wholetext", True).text(glob).select(F.input_file_name().alias("file"), "value")
    listed = files.withColumn("_all", F.from_json("value", "array<variant>"))
    good = F.col("_all").isNotNull() & F.regexp_like("value", F.lit(r"^\s*\["))
    results = listed.where(good).select("file", F.posexplode("_all").alias("pos", "_r")).select("file", "pos", F.to_json("_r").alias("result"))
    return results, listed.where(~good).select("file", F.length("value").alias("size"))


class Pool:
    """A bank that is read when it is first asked for, once, and held in Spark's cache until it is released."""

    def __init__(self, read: Callable[[], DataFrame]):
        self.read, self.held = read, None

    def get(self) -> DataFrame:
        if self.held is None:
            self.held = self.read().persist()
        return self.held

    def prefetch(self) -> DataFrame:
        """Reads it now, so that the first query finds it there."""
        self.get().count()
        return self.held

    def release(self) -> None:
        if self.held is not None:
            self.held.unpersist()
        self.held = None


def is_pdf(raw: Column) -> Column:
    """By the first bytes, never by name."""
    return F.coalesce(F.substring(raw, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def is_readable(form: Column, least: int = 500, broken: float = 0.02) -> Column:
    """Enough text in normal form, and few replacement characters. A page that fails was not read: nothing is absent from it."""
    n = F.length(form)
    return (n >= least) & ((n - F.length(F.replace(form, F.lit("�"), F.lit("")))) / F.greatest(n, F.lit(1)) < broken)


def with_fallback(urls: DataFrame, live: DataFrame, archive: DataFrame) -> DataFrame:
    """urls (url) with text and resolved ('live', 'archive' or null: unreadable) from snapshots (url, text), live first."""
    found = urls.join(live.select("url", F.col("text").alias("_live")), "url", "left").join(archive.select("url", F.col("text").alias("_old")), "url", "left")
    ok = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    return found.withColumn("text", F.when(ok("_live"), F.col("_live")).when(ok("_old"), F.col("_old")).otherwise("")).withColumn("resolved", F.when(ok("_live"), "live").when(ok("_old"), "archive")).drop("_live", "_old")


def law_articles(pages: DataFrame, row: str = r'(?s)<a name="([0-9-]+)">.*?<pre>(.*?)</pre>', name: str = r"(?s)<title>\s*(.*?)\s*</title>") -> DataFrame:
    """pages (code, expected, html) -> code, article_no, text without white space. A wrong name or no article is an error."""
    hits = pages.select("code", "expected", F.regexp_extract("html", name, 1).alias("name"), F.regexp_extract_all("html", F.lit(row), 1).alias("no"), F.regexp_extract_all("html", F.lit(row), 2).alias("text"))
    fault = F.when(F.col("name") != F.col("expected"), F.concat(F.lit("another law: "), "name")).when(F.size("no") == 0, F.concat(F.lit("no articles: "), "code"))
    rows = hits.select("code", F.explode(F.when(fault.isNull(), F.arrays_zip("no", "text")).otherwise(F.raise_error(fault).cast("array<struct<no: string, text: string>>"))).alias("a"))
    return rows.select("code", F.col("a.no").alias("article_no"), F.regexp_replace(F.regexp_replace("a.text", r"<[^>]*>", ""), r"[\s\p{Z}]+", "").alias("text")).orderBy("code", F.split("article_no", "-")[0].try_cast("int"), "article_no")


def laid_out_lines(words: DataFrame, gutter: float, header: float, footer: float, row: float = 3.0) -> DataFrame:
    """words (document, page, x0, top, text) -> document, page, column, line, text: a two-column page in reading order. Words in
    the bands above header and below footer go; rows are bands of ``row`` units."""
    kept = words.where((F.col("top") >= header) & (F.col("top") <= footer)).select("document", "page", F.when(F.col("x0") < gutter, 0).otherwise(1).alias("column"), F.floor(F.col("top") / row + 0.5).cast("long").alias("line"), "x0", "text")
    lines = kept.groupBy("document", "page", "column", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("w"))
    return lines.select("document", "page", "column", "line", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"))


def numbered_items(lines: DataFrame, start: str = r"^\s*([0-9]{1,3})\s*[.]\s*", option: str = r"^\s*\(?([A-D])\)\s*") -> DataFrame:
    """Lines -> items: a line that starts with a number opens an item, one that starts with (A) to (D) an option, others go on."""
    w = Window.partitionBy("document").orderBy("page", "column", "line")
    number, key = F.regexp_extract("text", start, 1), F.regexp_extract("text", option, 1)
    rows = lines.withColumn("_no", F.when(number != "", number.cast("int"))).withColumn("_key", F.when(F.col("_no").isNotNull(), F.lit("")).when(key != "", key))
    rows = rows.withColumn("item", F.sum(F.when(F.col("_no").isNotNull(), 1).otherwise(0)).over(w)).where("item > 0")
    part = Window.partitionBy("document", "item").orderBy("page", "column", "line")
    rows = rows.withColumn("key", F.last("_key", ignorenulls=True).over(part)).withColumn("_n", F.struct("page", "column", "line"))
    rows = rows.withColumn("text", F.regexp_replace(F.regexp_replace("text", start, ""), option, ""))
    parts = rows.groupBy("document", "item", "key").agg(F.max("_no").alias("number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), " ").alias("text"))
    return parts.groupBy("document", "item").agg(F.max("number").alias("number"), F.max(F.when(F.col("key") == "", F.col("text"))).alias("stem"), F.array_sort(F.collect_list(F.when(F.col("key") != "", F.struct("key", "text")))).alias("options"))


def claims_in(docs: DataFrame, rules: dict[str, str]) -> DataFrame:
    """docs (path, text) -> path, name, claimed (int) by patterns with one group; a rule that no document meets has claimed null
    (a dead anchor, which checks treat as a failure)."""
    rows = docs.select("path", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.nullif(F.regexp_extract("text", p, 1), F.lit("")).alias("v")) for n, p in rules.items()))).alias("c")).select("path", "c.name", F.regexp_replace("c.v", ",", "").try_cast("long").alias("claimed"))
    named = docs.sparkSession.createDataFrame([(n,) for n in rules], "name string")
    return named.join(rows.where("claimed IS NOT NULL"), "name", "left").select("path", "name", "claimed")
