import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import patterns as p


def brute(texts, pats):
    out = set()
    for i, t in texts:
        for j, x in pats:
            at = [m.start() for m in re.finditer(f"(?={re.escape(x)})", t)] if t and x else []
            if at:
                out.add((i, j, tuple(at)))
    return out


def found(spark, texts, pats, **kw):
    df = p.occurrences(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(pats, "pattern_id string, pattern string"), **kw)
    return [(r["text_id"], r["pattern_id"], tuple(r["places"])) for r in df.collect()]


@pytest.mark.parametrize("most", [10**6, 7])
def test_occurrences_against_brute_force(spark, most):
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("aab c日😀") for _ in range(n))
    texts = [(i, word(rng.randint(0, 120))) for i in range(40)] + [(90, None), (91, ""), (92, "a" * 3000), (93, "the same beginning of all patterns x")]
    pats = [(f"s{i}", word(rng.randint(1, 7))) for i in range(20)] + [(f"c{i}", t[1][i : i + rng.randint(8, 40)]) for i, t in enumerate(texts[:40])]
    pats += [("null", None), ("empty", ""), ("twin", "aab"), ("twin", "a"), ("other", "aab"), ("long", "a" * 2999)] + [(f"b{i}", f"the same beginning of all patterns {c}") for i, c in enumerate("xyz")]
    got = found(spark, texts, pats, most=most)
    assert len(got) == len(set(got)) and set(got) == brute(texts, pats) and len(got) > 60


def test_nothing_to_find(spark):
    assert found(spark, [(1, "abc")], []) == [] and found(spark, [], [("a", "abc")]) == [] and found(spark, [(1, "abc")], [("a", ""), ("b", None)]) == []


def test_shared_beginnings_are_not_looked_for(spark):
    pats = spark.createDataFrame([(f"the quick brown fox number {i}",) for i in range(50)], "pattern string")
    rows = p._described(pats).collect()
    assert len(rows) == 50 and all(r["at"] + 8 > len("the quick brown fox number ") for r in rows)


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("abc", ["abc"]), ("abc|defg", ["abc", "defg"]), ("a.cdeg*f", ["cde"]), (r"a\.bcd", ["a.bcd"]), ("(abc)?def", ["def"]), ("abc(d|e)", ["abc"]), ("ab{2}cde", ["cde"]), ("[abc]xyz+", ["xyz"]), (r"\d+ kg each", [" kg each"]), ("(?i)abc", None), ("ab|cdef", None), ("a(bc", None), ("[]a]bcd", None), (r"[\]x]bcd", ["bcd"]), ("", None)],
)
def test_needed_literals(pattern, want):
    assert p.needed_literals(pattern) == want


def test_rules_against_brute_force(spark):
    texts = [(1, "ten kg each"), (2, "abc or defg"), (3, "ABC"), (4, ""), (5, None), (6, "a.bcd 7 kg each")]
    rules = [("k", r"\d+ kg each"), ("alt", "abc|defg"), ("fold", "(?i)abc"), ("dot", r"a\.bcd"), ("none", None), ("short", "or"), ("never", "zzz+y")]
    got = p.matches(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(rules, "rule_id string, pattern string")).collect()
    want = {(i, r) for i, t in texts for r, x in rules if t and x and re.search(x, t)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_partitions_do_not_matter(spark):
    texts = spark.range(50).select(F.col("id").alias("text_id"), F.concat(F.lit("number "), "id", F.lit(" of many")).alias("text"))
    pats = spark.range(50).select(F.col("id").alias("pattern_id"), F.concat(F.lit("er "), "id", F.lit(" of")).alias("pattern"))
    rows = [sorted((r["text_id"], r["pattern_id"], tuple(r["places"])) for r in p.occurrences(texts.repartition(n), pats.repartition(n)).collect()) for n in (1, 7)]
    assert rows[0] == rows[1] and [r[:2] for r in rows[0]] == [(i, i) for i in range(50)]


def test_of_many_patterns_none_is_sent_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(p, "_hits", None)
    monkeypatch.setattr(p, "FILTER", 1 << 15)  # a full filter passes more and loses nothing
    texts = [(i, f"number {i} of many, number {i} of many") for i in range(60)] + [(60, None), (7, "number 7 of many, number 7 of many")]
    pats = [(str(i), f"number {i} of") for i in range(60)]
    got = found(spark, texts, pats, most=5)
    assert len(got) == 61 and got.count((7, "7", (0, 18))) == 2 and {r[:2] for r in got} == {(i, str(i)) for i in range(60)}
