import os
import random

import pytest

from quern.streaming import events as s


def rows(spark, *r):
    return spark.createDataFrame(list(r), s.STORED)


def stored(table):
    return {r["id"]: (r["attempts"], r["correct"], r["last_tried_at"]) for r in table.read().collect()}


def test_reads_stay_bounded_and_old_parts_go(spark, tmp_path):
    table, rng, want = s.stored_parts(spark, str(tmp_path / "t"), fan=3), random.Random(1), {}
    assert stored(table) == {}
    for batch in range(14):
        new = [(f"q{rng.randrange(5)}", rng.randint(1, 3), 1, 100 + batch)]
        assert table.put(rows(spark, *new), batch)
        for i, n, c, at in new:
            a = want.get(i, (0, 0, 0))
            want[i] = (a[0] + n, a[1] + c, at)
        levels = list(table.entry()["parts"].values())
        assert all(levels.count(x) < 3 for x in levels)
        assert len(os.listdir(tmp_path / "t" / "parts")) <= 2 * 3 * 3 and len(table.versions()) <= 2
    assert stored(table) == want and sorted(table.entry()["parts"].values()) == [0, 0, 1, 2]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = s.stored_parts(spark, str(tmp_path / "t"))
    assert table.put(rows(spark, ("a", 2, 1, 5)), 7) and not table.put(rows(spark, ("a", 2, 1, 5)), 7) and not table.put(rows(spark, ("a", 9, 9, 9)), 3)
    assert stored(table) == {"a": (2, 1, 5)} and table.put(rows(spark, ("a", 1, 0, 4)), 8) and stored(table) == {"a": (3, 1, 5)}
    assert {r["id"]: r["attempts"] for r in table.read(0).collect()} == {"a": 2}


def test_a_failure_before_the_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = s.stored_parts(spark, str(tmp_path / "t"))
    table.put(rows(spark, ("a", 2, 1, 5)), 0)
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda entry: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.put(rows(spark, ("a", 5, 5, 9)), 1)
    assert stored(table) == {"a": (2, 1, 5)} and len(os.listdir(tmp_path / "t" / "parts")) == 2
    assert table.put(rows(spark, ("a", 5, 5, 9)), 1) and stored(table) == {"a": (7, 6, 9)} and len(os.listdir(tmp_path / "t" / "parts")) == 2


def test_a_second_writer_is_refused(spark, tmp_path):
    table = s.stored_parts(spark, str(tmp_path / "t"))
    table.put(rows(spark, ("a", 2, 1, 5)), 0)
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit({"version": 0, "batch": 9, "parts": {}})
    assert stored(table) == {"a": (2, 1, 5)} and not [n for n in os.listdir(tmp_path / "t" / "log") if n.endswith("draft")]


def test_an_empty_batch(spark, tmp_path):
    table = s.stored_parts(spark, str(tmp_path / "t"), fan=2)
    for batch in range(3):
        assert table.put(rows(spark), batch)
    assert stored(table) == {}
