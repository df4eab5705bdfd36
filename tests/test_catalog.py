import pytest

import __spark_entry__
from quern.plans import catalog
from tests.oracle import same


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, data, name):
    same(catalog.queries()[name](spark, data), catalog.oracle_sql()[name], data)


@pytest.mark.parametrize("name", ["content_dedupe", "attempt_stats", "burst_mute", "multiset_diff"])
def test_partitions_do_not_matter(spark, data, name):
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, catalog.queries()[name](spark, data).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]
