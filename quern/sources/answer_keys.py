"""Printed answer keys: from a page's text to the blocks in which a question may stand, their options, and the letter that the page gives as right.

A stem may stand on a page more than once, with different options, so all its blocks are cut; which is meant is decided by whose options are most like
the item's. Blocks are cut by a table function over the hits of a page; the hits come from one pass over the pages (``patterns.occurrences``). Pages, hits and options meet in
merges by hint, as there: none of them goes through the driver.

Defined cases: null stems, quotes and texts have no blocks. A stem with too few characters isn't looked for. Repeated urls are pages of their own that are
read as one url's. A block without option marks, with fewer than three options, or without a known layout of its key has a null letter and says why in ``how``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F

from quern.functions.text import SPACE
from quern.operators.patterns import occurrences


@dataclass(frozen=True)
class Layout:
    """How the pages are set; patterns are Python's.

    The default patterns and numbers are fixed values that results depend on: where another question begins, an option's
    mark, a card in front of a number, a card with a label, what ends the last option; the characters of an anchor
    and the least of them, how long a block without a following question is, and how near that may be."""

    question: str = r"\n\s*(?:[(（][A-D][)）]\s*)?(?:Q\s*)?\d{1,3}\s*[.．、]|\nQ\s*\d"
    mark: str = r"[(（]([A-D])[)）]|(?<![A-Za-z])([A-D])[.．]\s"
    card: str = r"\s*[(（]([A-D])[)）]\s*\d{1,3}\s*[.．]"
    labelled: str = r"[(（]\s*答案\s*[:：]?\s*([A-D])\s*[)）]"
    stop: str = r"\n\s*\n|-{4,}|ML\s*[(（]|\n\s*考科\s*\d"
    last: str = "D"
    mark_width: int = 3
    anchor: int = 14
    least: int = 6
    reach: int = 480
    near: int = 12


BLOCK = "url string, id string, place int, block string, options array<struct<key: string, text: string>>, letter string, how string"


def block_at(page: str, at: int, layout: Layout) -> str:
    """From the beginning of the line in which a question's anchor stands to the next question."""
    begin = page.rfind("\n", 0, max(0, at - 1)) + 1
    search = re.compile(layout.question).search(page, at + layout.near)
    return page[begin : search.start() if search else min(len(page), at + layout.reach)]


def read_block(block: str, layout: Layout) -> tuple[list[tuple[str, str]], str | None, str]:
    """(options in the order of their marks, the key's letter, where it was found or why not)."""
    card = re.match(layout.card, block)
    body = block[card.end() :] if card else block
    marks = [(m.start(), m[m.lastindex]) for m in re.finditer(layout.mark, body)]
    if not marks:
        return [], None, "no_marks"
    ends = [at for at, _ in marks[1:]] + [len(body)]
    options: dict[str, str] = {}
    for (at, letter), end in zip(marks, ends):
        # A letter's first mark is the option; what comes again is a key.
        if letter not in options:
            options[letter] = re.split(layout.stop, body[at + layout.mark_width : end], maxsplit=1)[0].strip()
    found = list(options.items())
    if len(found) < 3:
        return found, None, "few_options"
    if card and card[1] in options:
        return found, card[1], "card"
    labelled = re.search(layout.labelled, body)
    if labelled and labelled[1] in options:
        return found, labelled[1], "labelled"
    letters = [letter for _, letter in marks]
    after = letters[letters.index(layout.last) + 1 :] if layout.last in options else []
    return (found, after[0], "second_column") if after else (found, None, "unknown_layout")


def _cutter(layout: Layout):
    """The table function: a row of hits (url, id, places in the text without white space, text, flat) to its blocks."""

    class Blocks:
        def __init__(self):
            self.page, self.origin = None, []

        def eval(self, row: Row):
            if row["text"] != self.page:  # the hits of a page follow one another
                self.page, self.origin, rest = row["text"], [], iter(enumerate(row["text"]))
                for c in row["flat"]:
                    self.origin.append(next(i for i, x in rest if x == c))
            for place in row["places"]:
                block = block_at(self.page, self.origin[place], layout)
                options, letter, how = read_block(block, layout)
                yield row["url"], row["id"], place, block, options, letter, how

    return F.udtf(Blocks, returnType=BLOCK)


def candidate_blocks(items: DataFrame, pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """items (id, stem, quote), pages (url, text) -> BLOCK: every block in which an item may stand. Where its stem isn't on a page, its
    quote is looked for instead."""
    flat = lambda c: F.regexp_replace(c, f"[{SPACE}]+", "")
    flattened = pages.select(F.col("url").cast("string").alias("url"), "text", flat("text").alias("flat"))
    probe = lambda c: items.select(F.col("id").cast("string").alias("pattern_id"), F.substring(flat(c), 1, layout.anchor).alias("pattern")).where(F.length("pattern") >= layout.least)
    texts = flattened.select(F.col("url").alias("text_id"), F.col("flat").alias("text"))
    by_stem = occurrences(texts, probe("stem"))
    by_quote = occurrences(texts, probe("quote")).join(by_stem.hint("merge"), ["text_id", "pattern_id"], "left_anti")
    hits = by_stem.unionByName(by_quote).select(F.col("text_id").alias("url"), F.col("pattern_id").alias("id"), "places")
    return _cutter(layout)(hits.join(flattened.hint("merge"), "url").asTable().partitionBy("url"))


def option_fit(own: Column, other: Column) -> Column:
    """How like an item's options (array<string>) a block's are: the mean over the item's of the likeness of the nearest; -1 without any."""

    @F.pandas_udf("double")
    def fit(mine: pd.Series, theirs: pd.Series) -> pd.Series:
        def one(a, b):
            if a is None or b is None or not len(a) or not len(b):
                return -1.0
            theirs = [y or "" for y in b]
            # An equal text's likeness is 1, the most there is.
            return sum(1.0 if x in theirs else max(SequenceMatcher(None, x, y).ratio() for y in theirs) for x in (x or "" for x in a)) / len(a)

        return pd.Series([one(a, b) for a, b in zip(mine, theirs)], dtype=float)

    return fit(own, other)


def printed_keys(items: DataFrame, pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """items (id, stem, quote, options array<struct<key,text>>), pages (url, text) -> id, url, blocks (how many), fit, block, options, letter,
    how: of the block on a page whose options are most like the item's (of equals the first)."""
    form = lambda options: F.transform(options, lambda o: F.regexp_replace(o["text"], f"[{SPACE}]+", ""))
    own = items.select(F.col("id").cast("string").alias("id"), F.col("options").alias("own"))
    fitted = candidate_blocks(items, pages, layout).join(own.hint("merge"), "id").withColumn("fit", option_fit(form(F.col("own")), form(F.col("options"))))
    best = F.max_by(F.struct("fit", "block", "options", "letter", "how"), F.struct("fit", -F.col("place")))
    return fitted.groupBy("id", "url").agg(F.count("*").cast("int").alias("blocks"), best.alias("b")).select("id", "url", "blocks", "b.*")
