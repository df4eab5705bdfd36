"""Exam sheets in two columns, from laid-out words to questions, options and notes.

A column of a page is read on its own, top to bottom: a question that it breaks off ends there. So every window holds a column of a page, however long the document is.

A line is a question's beginning (a key, a number, its text), an option's beginning, a ruler, or goes on with what is before it: a stem with any line, an option
with a line that is indented against the column's edge. A line at the edge after an option begins the note, and what follows is the note too, indented or not, until the next
beginning. What is above a column's first question belongs to none.

Defined cases: words with a null place or text are left out; words of one place are in the order of their texts. Numbers may repeat, also within a page; ``position``
tells questions of a column apart. Null documents are a document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Sheet:
    """Fixed values that results depend on: the columns' boundary, the bands of header and footer, a line's height, the indent that
    tells an option's next line; patterns (Java's) of a question (key, number, text), an option (key, text) and a ruler."""

    boundary: float = 292.0
    header: float = 42.0
    footer: float = 46.0
    line: float = 3.0
    indent: float = 8.0
    question: str = r"(?Us)^\(([A-D])\)\s*([0-9]{1,3})\s*[.、]\s*(.*)$"
    option: str = r"(?Us)^\(([A-D])\)\s*(.*)$"
    ruler: str = r"^-{5,}$"


_CJK, _IDEOGRAPH, _SEAM = r"\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}", r"\x{4E00}-\x{9FFF}", "\x01"


def _seamed(pieces: Column) -> Column:
    """Pieces as one text: a space between two, but none next to a CJK character."""
    whole = F.array_join(F.filter(pieces, lambda p: p != ""), _SEAM)
    return F.replace(F.regexp_replace(F.regexp_replace(whole, f"(?<=[{_CJK}]){_SEAM}", ""), f"{_SEAM}(?=[{_CJK}])", ""), F.lit(_SEAM), F.lit(" "))


def _tidy(text: Column) -> Column:
    """Without the spaces that justified lines put between ideographs, and without repeated or outer ones."""
    close = F.regexp_replace(text, rf"(?U)(?<=[{_IDEOGRAPH}])\s+(?=[{_IDEOGRAPH}])", "")
    return F.regexp_replace(F.regexp_replace(close, r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")


def column_lines(words: DataFrame, sheet: Sheet = Sheet()) -> DataFrame:
    """words (document, page, height, x0, top, text) -> document, page, column, line, text, indented: what stands between header and footer, in
    lines; rulers and blank lines go."""
    inside = (F.col("top") > sheet.header) & (F.col("top") < F.col("height") - sheet.footer)
    kept = words.where(inside & F.col("x0").isNotNull() & F.col("text").isNotNull())
    placed = kept.select("document", "page", F.when(F.col("x0") < sheet.boundary, "left").otherwise("right").alias("column"), F.bround(F.col("top") / sheet.line).cast("long").alias("line"), "x0", "text")
    lines = placed.groupBy("document", "page", "column", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("w"))
    edge = F.min(F.col("w")[0]["x0"]).over(Window.partitionBy("document", "page", "column"))
    text = F.regexp_replace(_seamed(F.transform("w", lambda w: w["text"])), r"(?U)^\s+|\s+$", "")
    told = lines.select("document", "page", "column", "line", text.alias("text"), (F.col("w")[0]["x0"] > edge + sheet.indent).alias("indented"))
    return told.where((F.col("text") != "") & ~F.regexp_like("text", F.lit(sheet.ruler)))


def questions(words: DataFrame, sheet: Sheet = Sheet()) -> DataFrame:
    """words as ``column_lines`` takes them -> document, page, column, position (from 1 in its column), answer, number, stem, options
    (array<struct<key,text>> in their order), note."""
    column = Window.partitionBy("document", "page", "column").orderBy("line")
    lines = column_lines(words, sheet)
    begins = F.regexp_like("text", F.lit(sheet.question))
    marked = lines.withColumn("begins", begins).withColumn("option", F.when(~F.col("begins"), F.regexp_like("text", F.lit(sheet.option))).otherwise(False))
    numbered = marked.withColumn("position", F.sum(F.col("begins").cast("int")).over(column)).where("position > 0")
    own = ("document", "page", "column", "position")
    part = numbered.withColumn("part", F.sum(F.col("option").cast("int")).over(Window.partitionBy(*own).orderBy("line")))
    # In an option's part, the first line at the edge begins the note.
    breaks = (F.col("part") > 0) & ~F.col("option") & ~F.col("indented")
    noted = part.withColumn("noted", F.max(breaks).over(Window.partitionBy(*own, "part").orderBy("line")) & ~F.col("option"))
    said = F.when(F.col("begins"), F.regexp_extract("text", sheet.question, 3)).when(F.col("option"), F.regexp_extract("text", sheet.option, 2)).otherwise(F.col("text"))
    rows = noted.withColumn("said", F.regexp_replace(said, r"(?U)^\s+|\s+$", ""))
    line = F.struct("line", "part", "noted", "option", "text", "said")
    whole = rows.groupBy(*own).agg(F.array_sort(F.collect_list(line)).alias("l"), F.max(F.when(F.col("begins"), F.col("text"))).alias("first"), F.max("part").alias("parts"))
    texts = lambda where: F.transform(F.filter("l", where), lambda x: x["said"])
    options = F.transform(
        F.filter("l", lambda x: x["option"]),
        lambda o: F.struct(F.regexp_extract(o["text"], sheet.option, 1).alias("key"), _tidy(_seamed(F.transform(F.filter("l", lambda x: (x["part"] == o["part"]) & ~x["noted"]), lambda x: x["said"]))).alias("text")),
    )
    return whole.select(
        "document", "page", "column", F.col("position").cast("int").alias("position"),
        F.regexp_extract("first", sheet.question, 1).alias("answer"), F.regexp_extract("first", sheet.question, 2).cast("int").alias("number"),
        _tidy(_seamed(texts(lambda x: x["part"] == 0))).alias("stem"), options.alias("options"), _tidy(F.array_join(texts(lambda x: x["noted"]), " ")).alias("note"),
    )
