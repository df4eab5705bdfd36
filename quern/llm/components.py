"""Connected components by alternating large-star and small-star, as joins and aggregates over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, meet, written

#: Nodes with more neighbours are joined apart, so that theirs don't meet in one task.
HUB = 1000


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _tied(rows: DataFrame, low: DataFrame) -> DataFrame:
    """rows (a, b) with the m of a from low (a, m, n: neighbours of a; written)."""
    few, hubs = low.where(F.col("n") <= HUB), low.where(F.col("n") > HUB)
    if hubs.isEmpty():
        return rows.join(low, "a")
    return rows.join(few, "a").unionByName(meet(rows, hubs, ["a"]))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges (a, b), any direction, repeats and loops allowed -> (id, component): of every node with an edge to another, the
    least id it can reach. Each round is one table in the shared folder; only its row count and a checksum reach the driver.

    Large-star: each node ties its larger neighbours to the least of its neighbours and itself. Small-star: it ties its smaller
    ones, and itself, to the least of them. Both keep connectivity; when a round changes nothing, only stars are left.
    """
    # a > b throughout.
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least")
        large = _tied(both, low).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")), "edges")
        discard(low, now)
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = _tied(large, least).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = written(small, "edges")
        discard(large, least)
        after = _state(now)
        if after == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = after
    raise RuntimeError(f"no end after {rounds} rounds")
