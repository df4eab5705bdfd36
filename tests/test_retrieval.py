import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval

ITEMS = "id string, pos long, subject string, stem string, has_answer boolean"


def brute(rows, targets, k):
    out = []
    for t in targets:
        own = min((r for r in rows if r[0] == t), key=lambda r: r[1], default=None)
        if own is None:
            continue
        words = [w for w in re.split(r"[\s.,!-]+", own[3] or "") if len(w) >= 2]
        score = lambda r: (2 if r[2] is not None and r[2] == own[2] else 0) + sum(w in (r[3] or "") for w in words)
        best = sorted(((-score(r), r[1], r[0]) for r in rows if r[4] and r[0] != t and score(r) > 0))[:k]
        out += [(t, i, -s, n + 1) for n, (s, _, i) in enumerate(best)]
    return sorted(out)


def near(spark, rows, targets, **kw):
    got = retrieval.similar_to(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([(t,) for t in targets], "id string"), cut=r"[\s.,!-]+", **kw)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize(("seed", "k", "seeds"), [(1, 5, 40), (2, 3, 4), (3, 1, 2), (4, 60, 5), (5, 5, 300)])
def test_against_all_pairs(spark, seed, k, seeds):
    """Common words, rare words, words within words, repeats, and texts that are equal."""
    rng = random.Random(seed)
    common, rare = ["the", "an", "and", "of", "factor", "act"], [f"w{i}x" for i in range(60)] + ["w1", "2x"]
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randint(0, 12)))
    rows = [(f"q{i}", 1000 - i, rng.choice(["a", "b", None]), rng.choice([text(), "", None, "same words here, same", text() + "-" + text()]), rng.random() < 0.8) for i in range(60)]
    rows += [(f"p{i}", 2000 + i, "a", rows[i][3], True) for i in range(8)] + [("q1", 5000, "a", "a later row of one id", True)]
    targets = [r[0] for r in rows[::2]] + ["q1", "q1", "no such id"]
    assert near(spark, rows, targets, k=k, seeds=seeds) == brute(rows, set(targets), k)


def test_subjects_alone(spark):
    rows = [(f"q{i}", i, "s", f"unlike{i}", True) for i in range(9)] + [("x", 99, "t", "unlike5", True), ("y", 100, None, "", True)]
    targets = [r[0] for r in rows]
    assert near(spark, rows, targets, k=4) == brute(rows, targets, 4)


def test_nothing(spark):
    assert near(spark, [], ["a"]) == [] and near(spark, [("a", 0, "s", "some words", True)], ["a"]) == [] and near(spark, [("a", 0, "s", "some words", True)], []) == []


def test_copies_are_looked_up_once(spark):
    """Many items of few contents: the work is that of the contents, with the best items of each in order."""
    rows = [(f"q{i}", i, "ab"[i % 2], ["red ring", "red bolt", "old red ring"][i % 3], i % 7 > 0) for i in range(300)]
    rows += [("q2", 1000 + i, "a", "old red ring", True) for i in range(12)]
    targets = [f"q{i}" for i in range(0, 300, 4)] + ["q2"]
    assert near(spark, rows, targets, k=4) == brute(rows, set(targets), 4)


def test_rows_do_not_grow_with_pairs_of_copies(spark):
    """Of copies a class keeps a bounded number of rows, whichever id is passed over."""
    rows = spark.range(2000).selectExpr("'c' AS class", "cast(id % 1000 AS string) AS id", "id AS pos")
    assert [(r["id"], r["pos"]) for r in retrieval._first(rows, "class", 3, F.lit(0)).orderBy("pos").collect()] == [(str(i), i) for i in range(6)]
    one = spark.range(50).selectExpr("'c' AS class", "cast(greatest(id, 9) AS string) AS id", "id AS pos")
    assert [r["pos"] for r in retrieval._first(one, "class", 2, F.lit(0)).orderBy("pos").collect()] == [0, 1, 10, 11]
