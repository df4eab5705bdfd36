import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quern.sources import manifest


def files(path):
    return {n: (path / n).read_bytes() for n in sorted(os.listdir(path))}


def table(spark, n=500):
    return spark.range(n).select(F.concat(F.lit("é"), (F.col("id") * 7 % 50).cast("string")).alias("k"), F.when(F.col("id") % 9 != 0, F.col("id") % 13).alias("n"), F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 10 != 0, F.col("id") / 3).alias("x"))


@pytest.mark.parametrize("size", [20, 10**6])
def test_bytes_do_not_depend_on_partitions(spark, tmp_path, size):
    rows, found = table(spark), []
    for i, parts in enumerate((1, 7, 3)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        to = tmp_path / f"m{i}"
        manifest.write_manifest(rows.orderBy(F.xxhash64("k", "n", "x", F.lit(i))).repartition(parts), str(to), ["k", "n", "x"], size)
        found.append(files(to))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and (len(found[0]) > 10) == (size == 20)
    listed = manifest.read_manifest(spark, str(tmp_path / "m0"))
    assert listed["rows"] == 500 and [hashlib.sha256(found[0][p["file"]]).hexdigest() for p in listed["parts"]] == [p["sha256"] for p in listed["parts"]]
    lines = b"".join(found[0][p["file"]] for p in listed["parts"]).decode().splitlines()
    want = [r["j"] for r in rows.select("k", "n", "x", F.to_json(F.struct("k", "n", "x")).alias("j")).orderBy("k", "n", "x", "j").collect()]
    assert lines == want


def test_a_later_manifest_replaces_all_of_an_earlier_one(spark, tmp_path):
    to = tmp_path / "m"
    manifest.write_manifest(table(spark), f"file://{to}", ["k"], 10)
    manifest.write_manifest(table(spark, 3), f"file://{to}", ["k"], 10**6)
    assert sorted(os.listdir(to)) == ["_manifest.json", "part-000000.jsonl"] and manifest.read_manifest(spark, f"file://{to}")["rows"] == 3
    manifest.write_manifest(table(spark, 0), str(to), ["k"])
    assert json.loads((to / "_manifest.json").read_text())["parts"] == [] and os.listdir(to) == ["_manifest.json"]


def test_one_changed_row_leaves_other_parts(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    manifest.write_manifest(rows, str(tmp_path / "a"), ["k"], 100)
    manifest.write_manifest(rows.withColumn("v", F.when(F.col("k") == 1000, "changed").otherwise(F.col("v"))), str(tmp_path / "b"), ["k"], 100)
    a, b = (set(files(tmp_path / x).values()) for x in "ab")
    assert len(a) > 10 and len(a - b) <= 4


def test_too_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "MOST_PARTS", 5)
    with pytest.raises(ValueError, match="larger size"):
        manifest.write_manifest(table(spark), str(tmp_path / "m"), ["k"], 2)
