"""Identity across collections: duplicates by content and by numbers, conflicting answers, registries, manifests, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import article_references, calc_signature, content_form, content_signature, option_value


def _options() -> Column:
    return F.transform("options", lambda o: o["text"])


def matched(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """(left_id, right_id) with equal, non-null keys; of several right ones the last by pos. The right side is one row a key
    before the join."""
    last = right.select(key.alias("_key"), "id", "pos").where(F.col("_key").isNotNull()).groupBy("_key").agg(F.max_by("id", "pos").alias("right_id"))
    return left.select(F.col("id").alias("left_id"), key.alias("_key")).where(F.col("_key").isNotNull()).join(last, "_key").select("left_id", "right_id")


def same_content(pool: DataFrame, bank: DataFrame) -> DataFrame:
    return matched(pool, bank, F.md5(content_signature(F.col("stem"), _options())))


def same_calculation(pool: DataFrame, bank: DataFrame) -> DataFrame:
    return matched(pool, bank, calc_signature(F.col("stem"), _options()))


def conflicting(items: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Groups of one subject and stem in normal form with several answer texts: subject, key, answers (a row each: least id, answer).
    Grouped before pairing, so a group of copies gives a row an answer, never a pair of items. registered (id_a, id_b): pairs whose
    answers are known to differ; a group all of whose answers are in such pairs is no conflict."""
    answer = F.try_element_at(F.filter("options", lambda o: o["key"] == F.col("answer")), F.lit(1))["text"]
    rows = items.where(F.col("answer").isNotNull()).select("subject", F.md5(content_form(F.col("stem"))).alias("key"), content_form(answer).alias("answer_form"), "id")
    one = rows.groupBy("subject", "key", "answer_form").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    several = one.groupBy("subject", "key").agg(F.count("*").alias("answers")).where("answers > 1")
    out = one.join(several, ["subject", "key"])
    if registered is not None:
        # Registered answers are those of one group that a registered pair of ids joins; a group goes if they are all of it.
        ids = rows.select("subject", "key", "answer_form", "id")
        side = lambda c: ids.join(registered.select(F.col(c).alias("id"), F.least("id_a", "id_b").alias("_x"), F.greatest("id_a", "id_b").alias("_y")), "id")
        settled = side("id_a").unionByName(side("id_b")).groupBy("subject", "key", "_x", "_y").agg(F.collect_set("answer_form").alias("forms")).where("size(forms) = 2")
        known = settled.select("subject", "key", F.explode("forms").alias("answer_form")).distinct().groupBy("subject", "key").agg(F.count("*").alias("known"))
        out = out.join(known, ["subject", "key"], "left").where(F.coalesce("known", F.lit(0)) < F.col("answers"))
    return out.select("subject", "key", "answer_form", "id", "n", "answers")


def equal_options(items: DataFrame) -> DataFrame:
    """id, kind: items two of whose options are the same text in normal form, or the same value."""
    forms, values = F.transform(_options(), lambda x: content_form(x)), F.filter(F.transform(_options(), option_value), lambda v: v.isNotNull())
    kinds = F.array_compact(F.array(F.when(F.size(F.array_distinct(forms)) < F.size(forms), F.lit("text")), F.when(F.size(F.array_distinct(values)) < F.size(values), F.lit("value"))))
    return items.select("id", F.explode(kinds).alias("kind"))


def registry_gaps(data: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """key, gap: 'missing' (in the data, not registered) and 'ghost' (registered, not in the data)."""
    d, r = data.select(key).distinct(), registry.select(key).distinct()
    return d.join(r, key, "left_anti").withColumn("gap", F.lit("missing")).unionByName(r.join(d, key, "left_anti").withColumn("gap", F.lit("ghost")))


def field_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, old, new (as text) of every field that differs, and of rows that one side lacks (field '*')."""
    fields = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*fields).alias("_a"))
    b = new.select(*keys, F.struct(*fields).alias("_b"))
    both = a.join(b, keys, "full_outer")
    cells = [F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"_a.{c}").cast("string").alias("old"), F.col(f"_b.{c}").cast("string").alias("new"))) for c in fields]
    none = F.lit(None).cast("string")
    whole = F.when(F.col("_a").isNull(), F.array(F.struct(F.lit("*").alias("field"), none.alias("old"), F.lit("added").alias("new")))).when(F.col("_b").isNull(), F.array(F.struct(F.lit("*").alias("field"), F.lit("removed").alias("old"), none.alias("new")))).otherwise(F.array_compact(F.array(*cells)))
    return both.select(*keys, F.explode(whole).alias("d")).select(*keys, "d.field", "d.old", "d.new")


def multiset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with how often more one side has them: side ('old' or 'new'), n. One aggregate over both."""
    cols = old.columns
    n = old.withColumn("_n", F.lit(-1)).unionByName(new.select(*cols).withColumn("_n", F.lit(1))).groupBy(*cols).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return n.withColumn("side", F.when(F.col("_n") > 0, "new").otherwise("old")).withColumn("n", F.abs("_n")).drop("_n")


def missing_numbers(rows: DataFrame, source: str, number: str, totals: DataFrame) -> DataFrame:
    """totals (source, total): numbers 1 to total that a source lacks."""
    want = totals.select(source, F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))).alias(number))
    return want.join(rows.select(source, F.col(number).cast("int").alias(number)).distinct(), [source, number], "left_anti")


def missing_references(texts: DataFrame, corpus: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """texts (id, text), corpus (code, article) -> id, code, article: the articles that a text refers to and the corpus does not have."""
    named = texts.select("id", F.explode(article_references(F.col("text"), aliases)).alias("r")).select("id", "r.code", F.col("r.article").cast("string").alias("article")).distinct()
    return named.join(corpus.select("code", F.col("article").cast("string").alias("article")), ["code", "article"], "left_anti").select("id", "code", "article")


def disposition_summary(dispositions: DataFrame, totals: DataFrame) -> DataFrame:
    """dispositions (source, number, status), totals (source, total) -> source, statuses (map of status to count), accounted, total, missing (numbers 1 to
    total without a disposition), repeated (dispositions beyond a number's first, or of no such number), complete: nothing is lost and nothing counted twice."""
    n = dispositions.groupBy("source", "status").agg(F.count("*").alias("n"))
    by_status = n.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"), F.sum("n").alias("accounted"))
    inside = dispositions.join(totals, "source").where((F.col("number") >= 1) & (F.col("number") <= F.col("total"))).groupBy("source").agg(F.count_distinct("number").alias("found"))
    met = totals.join(by_status, "source", "left").join(inside, "source", "left")
    none = F.create_map().cast("map<string,bigint>")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = met.select("source", F.coalesce("statuses", none).alias("statuses"), zero("accounted").alias("accounted"), F.col("total").cast("long").alias("total"), (F.col("total") - zero("found")).cast("long").alias("missing"), (zero("accounted") - zero("found")).alias("repeated"))
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("repeated") == 0))
