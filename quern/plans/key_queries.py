"""Catalogue: printed answer keys, on pages that are set from the table ``part``."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quern.sources import answer_keys, layout

from .catalog import query
from .text_queries import _read


@query("""WITH i AS (SELECT p_partkey AS k, p_brand, p_type, p_name, p_size, row_number() OVER (PARTITION BY p_partkey // 15 ORDER BY p_partkey) AS n, substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1) AS x FROM part),
b AS (SELECT *, 'Part ' || k || ' that is called ' || p_name || '?' || chr(10) || '(A) ' || p_brand || chr(10) || '(B) ' || p_type || ' (C) ' || p_name || chr(10) || '(D) size ' || p_size AS body FROM i)
SELECT CAST(k AS VARCHAR) AS id, CAST(k // 15 AS VARCHAR) AS url, 1 AS blocks, CASE WHEN k % 5 < 3 THEN x END AS letter,
  CASE k % 5 WHEN 0 THEN 'card' WHEN 1 THEN 'labelled' WHEN 2 THEN 'second_column' WHEN 3 THEN 'unknown_layout' ELSE 'few_options' END AS how, true AS fits,
  md5(CASE k % 5 WHEN 0 THEN '(' || x || ') ' || n || '. ' || body WHEN 1 THEN n || '. ' || body || chr(10) || '（答案：' || x || '）' WHEN 2 THEN n || '. ' || body || ' (' || x || ') ' || p_brand WHEN 3 THEN n || '. ' || body
    ELSE n || '. ' || 'Part ' || k || ' that is called ' || p_name || '?' || chr(10) || '(A) ' || p_brand || ' (B) ' || p_type END) AS block FROM b""")
def printed_keys(spark, d):
    """Fifteen parts a page as questions in five layouts, three of them with a key."""
    p, key = _read(spark, d, "part"), F.col("p_partkey")
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    x, kind = F.substring(F.lit("ABCD"), (key % 4 + 1).cast("int"), F.lit(1)), key % 5
    url = F.floor(key / 15).cast("string")
    numbered = p.withColumn("n", F.row_number().over(Window.partitionBy(F.floor(key / 15)).orderBy(key)).cast("string"))
    name, brand, type_, size = (F.col(c).cast("string") for c in ("p_name", "p_brand", "p_type", "p_size"))
    stem = say("Part ", key.cast("string"), " that is called ", name, "?")
    body = say(stem, "\n(A) ", brand, "\n(B) ", type_, " (C) ", name, "\n(D) size ", size)
    number = say(F.col("n"), ". ")
    card, label, column = say("(", x, ") ", number, body), say(number, body, "\n（答案：", x, "）"), say(number, body, " (", x, ") ", brand)
    block = F.when(kind == 0, card).when(kind == 1, label).when(kind == 2, column).when(kind == 3, say(number, body)).otherwise(say(number, stem, "\n(A) ", brand, " (B) ", type_))
    option = lambda k, t: F.struct(F.lit(k).alias("key"), t.alias("text"))
    both = [option("A", brand), option("B", type_)]
    rows = numbered.select(key, url.alias("url"), key.cast("string").alias("id"), stem.alias("stem"), F.lit(None).cast("string").alias("quote"), F.when(kind == 4, F.array(*both)).otherwise(F.array(*both, option("C", name), option("D", say("size ", size)))).alias("options"), block.alias("block"))
    pages = rows.groupBy("url").agg(F.concat(F.lit("Notes\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "block"))), lambda r: r["block"]), "\n"), F.lit("\n99. end")).alias("text"))
    found = answer_keys.printed_keys(rows, pages)
    return found.select("id", "url", "blocks", "letter", "how", (F.col("fit") > 0.9).alias("fits"), F.md5("block").alias("block"))


@query("""SELECT CAST(p_partkey // 10 AS VARCHAR) AS document, CAST(p_partkey % 10 + 1 AS INT) AS page, c AS "column", 1 AS position, CASE c WHEN 'left' THEN 'B' ELSE 'D' END AS answer, CASE c WHEN 'left' THEN 7 ELSE 8 END AS number,
  p_brand || ' stem ' || p_type AS stem, CASE c WHEN 'left' THEN 'A=' || p_name || ' and ' || p_size || ';B=second' ELSE 'C=only' END AS options, CASE c WHEN 'left' THEN p_type || ' explains it' ELSE '' END AS note FROM part, (VALUES ('left'), ('right')) v(c)""")
def sheet_questions(spark, d):
    """A part a page, ten pages a document: a question with a note in the left column, one without in the right."""
    p = _read(spark, d, "part")
    key = F.col("p_partkey")
    said = lambda *parts: F.concat_ws(" ", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    left = [(0, said("no question yet")), (0, said("(B) 7.", F.col("p_brand"), "stem")), (15, said(F.col("p_type"))), (0, said("(A)", F.col("p_name"))), (12, said("and", F.col("p_size"))), (0, said("(B) second")), (0, said("--------")), (0, said(F.col("p_type"))), (20, said("explains it"))]
    right = [(0, said("(D) 8.", F.col("p_brand"), "stem")), (0, said(F.col("p_type"))), (0, said("(C) only"))]
    line = lambda x, i, n, text: F.struct(F.lit(float(x + i)).alias("x0"), F.lit(60.0 + 12 * n).alias("top"), text.alias("text"))
    lines = F.array(*(line(40, i, n, t) for n, (i, t) in enumerate(left)), *(line(300, i, n, t) for n, (i, t) in enumerate(right)), line(40, 0, 70, said("(A) 9. footer")))
    rows = p.select(F.floor(key / 10).cast("string").alias("document"), (key % 10 + 1).cast("int").alias("page"), F.lit(842.0).alias("height"), F.explode(lines).alias("l"))
    words = rows.select("document", "page", "height", F.col("l.x0").alias("from"), "l.top", F.posexplode(F.split("l.text", " ")).alias("i", "text")).withColumn("x0", F.col("from") + F.col("i") * 9)
    found = layout.questions(words)
    return found.withColumn("options", F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit("="), o["text"])), ";"))
