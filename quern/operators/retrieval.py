"""The items most like each of a set of items, by an inverted index and a bound on what an unseen item can score.

An item scores 2 for a target's subject and 1 for each of the target's words (repeats count) that its text holds. A word holds no separator, so it stands
within one word of the text: the index of the distinct words of all texts tells which texts hold it; subjects are terms of the index like words. Per target
the terms are taken from the rarest on. Some items of the rarest terms, scored in full, give a score that the k-th best reaches at least; terms whose weights
together stay below it need not be looked up, as an item known by them alone can't be among the best. Of what the other terms find, only items that
can still reach the bound are scored in full.

All this is done with classes of items that have the same subject and text, on both sides: copies are indexed and scored once, and a class gives no
more than its first 2 * k items, which is enough whatever the target's own id is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .patterns import occurrences

SUBJECT = 2


def _words(text: Column, cut: str) -> Column:
    return F.filter(F.split(text, cut), lambda w: F.length(w) >= 2)


def similar_to(items: DataFrame, targets: DataFrame, k: int = 5, text: str = "stem", cut: str = r"[\s\p{P}]+", seeds: int = 300) -> DataFrame:
    """items (id, pos, subject, has_answer, text; id and pos name a row), targets (id) -> target, id, score, rank: of each target that is
    an item (the first by pos) the k best other items that have an answer and a score; of equals the first by pos. Null texts hold no words, null
    subjects are like none. seeds: about how many classes give a target's bound (only speed depends on it)."""
    whole = items.select("id", "pos", "subject", F.coalesce(text, F.lit("")).alias("text"), "has_answer")
    # Items of equal subjects and texts are one class; so are the targets, as they have the same scores.
    alike = F.sha2(F.to_json(F.struct("subject", "text")), 256)
    found = whole.join(targets.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("subject", "text"), "pos").alias("r"))
    found = found.select(F.col("id").alias("target"), F.col("r.subject").alias("subject"), F.col("r.text").alias("text")).withColumn("asker", alike)
    asked = found.groupBy("asker").agg(F.first("subject").alias("own"), F.first("text").alias("text")).select("asker", "own", _words(F.col("text"), cut).alias("words"))
    answered = whole.where("has_answer").withColumn("class", alike)
    classes = answered.groupBy("class").agg(F.first("subject").alias("subject"), F.first("text").alias("text"), F.min(F.struct("pos", "id")).alias("first"))
    members = _first(answered.select("class", "id", "pos"), "class", k, F.lit(0))
    is_word = lambda c: F.concat(F.lit("w:"), c)
    is_subject = lambda c: F.concat(F.lit("s:"), c)

    words = asked.select("asker", F.explode("words").alias("word")).groupBy("asker", "word").agg(F.count("*").alias("weight"))
    tokens = classes.select("class", "first", F.explode(F.array_distinct(_words(F.col("text"), cut))).alias("token"))
    vocabulary = tokens.select(F.col("token").alias("text_id"), F.col("token").alias("text")).distinct()
    within = occurrences(vocabulary, words.select(F.col("word").alias("pattern_id"), F.col("word").alias("pattern")).distinct())
    of_words = tokens.join(within.select(F.col("text_id").alias("token"), is_word(F.col("pattern_id")).alias("term")), "token").select("term", "class", "first").distinct()
    of_subjects = classes.where("subject IS NOT NULL").select(is_subject(F.col("subject").cast("string")).alias("term"), "class", "first")
    holds = of_words.unionByName(of_subjects)
    subjects = asked.where("own IS NOT NULL").select("asker", is_subject(F.col("own").cast("string")).alias("term"), F.lit(SUBJECT).cast("long").alias("weight"))
    wanted = words.select("asker", is_word(F.col("word")).alias("term"), "weight").unionByName(subjects)

    # The rarest terms first; rest: the weight of the terms after this one.
    spread = holds.groupBy("term").agg(F.count("*").alias("classes"))
    order = Window.partitionBy("asker").orderBy("classes", "term")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = wanted.join(spread, "term").select("asker", "term", "weight", (F.sum("classes").over(so_far) - F.col("classes")).alias("before"), (F.sum("weight").over(Window.partitionBy("asker")) - F.sum("weight").over(so_far)).alias("rest"))

    def scored(pairs: DataFrame) -> DataFrame:
        own_score = F.when(F.col("subject") == F.col("own"), SUBJECT).otherwise(0)
        full = pairs.join(asked, "asker").join(classes.select("class", "subject", "text"), "class")
        return full.select("asker", "class", (own_score + F.size(F.filter("words", lambda w: F.contains("text", w)))).alias("score")).where("score > 0")

    def best(pairs: DataFrame) -> DataFrame:
        """asker, near: of pairs of classes the best rows, in order; enough for every target of the class, as its own id is passed over."""
        rows = _first(scored(pairs).join(members, "class"), "asker", k, -F.col("score"))
        return rows.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "pos", "id"))).alias("near"))

    first = holds.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy("first", "class"))).where(F.col("_r") <= seeds).drop("_r")
    tried = ranked.where(F.col("before") < seeds).select("asker", "term").join(first, "term").select("asker", "class")
    # What is equal to a target is hardly ever beaten.
    tried = tried.unionByName(asked.select("asker", F.col("asker").alias("class"))).distinct()
    without = lambda i: F.filter("near", lambda r: i.isNull() | (r["id"] != i))
    kth = lambda rows: F.when(F.size(rows) >= k, -F.try_element_at(rows, F.lit(k))["less"]).otherwise(0)
    reached = best(tried).select("asker", F.array_min(F.transform(F.array_distinct(F.transform("near", lambda r: r["id"])), lambda i: kth(without(i)))).alias("least"))

    # A term is looked up unless the weight from it on is below the bound.
    looked = ranked.join(reached, "asker", "left").withColumn("least", F.coalesce("least", F.lit(0))).where(F.col("rest") + F.col("weight") >= F.col("least"))
    looked = looked.withColumn("left", F.min("rest").over(Window.partitionBy("asker")))
    partly = looked.select("asker", "term", "weight", "left", "least").join(holds, "term").groupBy("asker", "class").agg(F.sum("weight").alias("part"), F.first("left").alias("left"), F.first("least").alias("least"))
    may = partly.where(F.col("part") + F.col("left") >= F.col("least")).select("asker", "class")
    final = found.select("target", "asker").join(best(may), "asker").select("target", F.posexplode(F.slice(F.filter("near", lambda r: r["id"] != F.col("target")), 1, k)).alias("at", "r"))
    return final.select("target", F.col("r.id").alias("id"), (-F.col("r.less")).alias("score"), (F.col("at") + 1).alias("rank"))


def _first(rows: DataFrame, group: str, k: int, before: Column) -> DataFrame:
    """The rows (group, id, pos, ...) of a group that are among its first k, by ``before``, pos and id, when the rows of any one id are left out: an id has
    at most k of them, all have at most 2 * k."""
    own = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group, "id").orderBy(before, "pos"))).where(F.col("_r") <= k)
    return own.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(before, "pos", "id"))).where(F.col("_r") <= 2 * k).drop("_r")
