import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quern.operators import patterns
from quern.sources import answer_keys as a

ITEM = "id string, stem string, quote string, options array<struct<key: string, text: string>>"


def options(*texts):
    return [(k, t) for k, t in zip("ABCD", texts)]


PAGE = """Course notes
(C) 1. What is meant by mitigation of climate?
(A) red (B) green (C) blue (D) grey
2. Which gas is named first in the list?
(A) one  gas
(B) two gas
(C) three gas
(D) four gas
（答案：B）
3. What is meant by mitigation of climate?
A. less B. more C. same D. none (D)
ML (2024) notes
4、A question of few options here
(A) yes (B) no
Q5 Another question, and this has no key
(A) ja (B) nein (C) doch (D) vielleicht

trailing words
"""


@pytest.mark.parametrize(
    ("block", "letters", "letter", "how"),
    [
        ("(C) 1. stem\n(A) red (B) green (C) blue (D) grey", "ABCD", "C", "card"),
        ("2. stem (A) r (B) g (C) b (D) y\n（答案：B）", "ABCD", "B", "labelled"),
        ("3. stem A. less B. more C. same D. none (D)", "ABCD", "D", "second_column"),
        ("4. stem (A) yes (B) no", "AB", None, "few_options"),
        ("5. stem without", "", None, "no_marks"),
        ("6. stem (A) 1 (B) 2 (C) 3 (D) 4", "ABCD", None, "unknown_layout"),
        ("(D) 7. stem (A) 1 (B) 2 (C) 3", "ABC", None, "unknown_layout"),
        ("", "", None, "no_marks"),
    ],
)
def test_layouts(block, letters, letter, how):
    found, got, where = a.read_block(block, a.Layout())
    assert ("".join(k for k, _ in found), got, where) == (letters, letter, how)


def test_the_last_option_ends_before_the_footer():
    found, _, _ = a.read_block("9. s (A) a (B) b (C) c (D) all of these \n ML (2024.08) \n 4", a.Layout())
    assert dict(found)["D"] == "all of these"


def test_the_block_with_the_items_options_is_taken(spark):
    stem = "What is meant by mitigation of climate?"
    rows = [("first", stem, None, options("red", "green", "blue", "grey")), ("second", stem, None, options("less", "more", "same", "none")), ("gas", "Which gas is named first", None, options("one gas", "two gas", "three gas", "four gas"))]
    rows += [("few", "A question of few options", None, options("yes", "no")), ("open", "Another question, and this", None, options("ja", "nein", "doch", "vielleicht")), ("quoted", "not on the page at all", "Which gas is named", options("one gas")), ("short", "What", None, options("a")), ("null", None, None, None)]
    pages = spark.createDataFrame([("p", PAGE), ("blank", ""), ("none", None), ("other", "Which  gas\nis named first")], "url string, text string")
    got = {(r["id"], r["url"]): r for r in a.printed_keys(spark.createDataFrame(rows, ITEM), pages).collect()}
    assert {k: (r["blocks"], r["letter"], r["how"]) for k, r in got.items()} == {
        ("first", "p"): (2, "C", "card"), ("second", "p"): (2, "D", "second_column"), ("gas", "p"): (1, "B", "labelled"), ("few", "p"): (1, None, "few_options"),
        ("open", "p"): (1, None, "unknown_layout"), ("quoted", "p"): (1, "B", "labelled"), ("gas", "other"): (1, None, "no_marks"), ("quoted", "other"): (1, None, "no_marks"),
    }
    assert got["first", "p"]["fit"] == 1.0 and dict(map(tuple, got["gas", "p"]["options"]))["A"] == "one  gas" and got["few", "p"]["block"].startswith("4、")


def test_blocks_against_brute_force(spark):
    """Pages are built from lines; a block is what was put there for the question."""
    rng = random.Random(8)
    items, pages, want = [], [], set()
    for page in range(6):
        text = "head\n"
        for q in range(rng.randint(1, 9)):
            stem = f"stem {page} {q} " + "".join(rng.choice("xyz 日") for _ in range(30)) + "?"
            body = f"{q + 1}. {stem}\n" + " ".join(f"({k}) {k.lower()}{q}" for k in "ABCD")
            for _ in range(rng.choice([1, 1, 2])):
                text += body + "\n"
            want.add((f"{page}-{q}", body))
            items.append((f"{page}-{q}", stem, None, options(*(f"{k}{q}" for k in "abcd"))))
        pages.append((f"u{page}", text + "12. end\n"))
    got = a.candidate_blocks(spark.createDataFrame(items, ITEM), spark.createDataFrame(pages, "url string, text string")).collect()
    assert {(r["id"], r["block"]) for r in got} == want
    assert all(p[1][: p[1].find(r["block"]) + 1] for p in pages for r in got if r["url"] == p[0]) and len(got) >= len(want)


def test_nothing_to_read(spark):
    items, pages = spark.createDataFrame([], ITEM), spark.createDataFrame([("p", PAGE)], "url string, text string")
    assert a.printed_keys(items, pages).count() == 0 and a.printed_keys(spark.createDataFrame([("a", "What is meant by", None, None)], ITEM), pages.limit(0)).count() == 0


@pytest.mark.parametrize("most", [10**6, 1])
def test_nothing_is_joined_through_the_driver(spark, monkeypatch, most):
    """However small the optimizer takes the tables to be: its estimate is of the files, not of the pages, patterns and options made from them."""
    monkeypatch.setattr(a, "occurrences", lambda texts, probes: patterns.occurrences(texts, probes, most))
    rows = [("gas", "Which gas is named first", None, options("one gas", "two gas", "three gas", "four gas")), ("quoted", "not on the page at all", "Which gas is named", options("one gas"))]
    items, pages = spark.createDataFrame(rows, ITEM), spark.createDataFrame([("p", PAGE)], "url string, text string")
    got = a.printed_keys(items, pages)
    assert {(r["id"], r["letter"], r["how"]) for r in got.collect()} == {("gas", "B", "labelled"), ("quoted", "B", "labelled")}
    for df in (got, patterns._described(items.select(F.col("stem").alias("pattern")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fit_is_the_mean_likeness_of_the_nearest(spark):
    cases = [(["red", "green"], ["green", "rad"]), (["one", None], ["", "two"]), (["a" * 300, "b"], ["a" * 300]), (["x"], [None]), ([], ["x"]), (None, ["x"]), (["x"], None)]
    near = lambda x, theirs: max(SequenceMatcher(None, x or "", y or "").ratio() for y in theirs)
    want = [sum(near(x, theirs) for x in own) / len(own) if own and theirs else -1.0 for own, theirs in cases]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, own array<string>, theirs array<string>")
    assert [r["fit"] for r in df.select("i", a.option_fit(F.col("own"), F.col("theirs")).alias("fit")).orderBy("i").collect()] == want
