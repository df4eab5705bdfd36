"""Does the form of the options give the answer away? Longest option, blatant tells, positions, ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import SPACE


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\p{{P}}{SPACE}]+", ""))


def longest_key(options: Column) -> Column:
    """Key of the longest option; of equally long ones the first."""
    ranked = F.transform(options, lambda o, i: F.struct(visible_length(o["text"]).alias("n"), (-i).alias("i"), o["key"].alias("k")))
    return F.array_max(ranked)["k"]


def longest_option_score(items: DataFrame, scope: Column | None = None) -> DataFrame:
    """How often the longest option is the answer, by scope: scope, hits, n, rate (null of nothing)."""
    rows = items.where(F.col("answer").isNotNull() & (F.size("options") >= 4))
    out = rows.groupBy((scope if scope is not None else F.lit("all")).alias("scope")).agg(F.count_if(longest_key(F.col("options")) == F.col("answer")).alias("hits"), F.count("*").alias("n"))
    return out.withColumn("rate", F.try_divide("hits", "n"))


def blatant_tells(items: DataFrame, least: int = 25, ratio: float = 2.2) -> DataFrame:
    """Ids of items with four options at least whose answer is long and much longer than any other option."""
    lengths = lambda of: F.transform(F.filter("options", of), lambda o: visible_length(o["text"]))
    own, rest = F.array_max(lengths(lambda o: o["key"] == F.col("answer"))), F.array_max(lengths(lambda o: o["key"] != F.col("answer")))
    return items.where((F.size("options") >= 4) & (own >= least) & (own >= ratio * rest)).select("id")


def position_chi2(items: DataFrame, keys: tuple[str, ...] = ("A", "B", "C", "D"), value: str = "answer") -> DataFrame:
    """n, chi2 against even positions, largest share; positions that never occur count as 0."""
    rows = items.where(F.col(value).isin(*keys))
    row = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(value) == k).alias(f"_{i}") for i, k in enumerate(keys)))
    e = F.col("n") / len(keys)
    total = sum(((F.col(f"_{i}") - e) * (F.col(f"_{i}") - e) for i in range(1, len(keys))), (F.col("_0") - e) * (F.col("_0") - e))
    return row.select("n", F.try_divide(total, e).alias("chi2"), F.try_divide(F.greatest(*(F.col(f"_{i}") for i in range(len(keys)))), F.col("n")).alias("largest_share"))


def sorted_ladder(options: Column) -> Column:
    """Whether options of one number each ascend or descend; null if one has none or several."""
    found = F.transform(options, lambda o: F.regexp_extract_all(F.replace(o["text"], F.lit(","), F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0))
    values = F.transform(found, lambda f: F.try_element_at(f, F.lit(1)).cast("double"))
    up = F.array_sort(values)
    return F.when(F.forall(found, lambda f: F.size(f) == 1) & (F.size(options) > 1), (values == up) | (values == F.reverse(up)))
