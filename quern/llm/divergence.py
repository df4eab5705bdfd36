"""Which sources of a language differ in their words, and by which: exact divergences of all pairs of a language's groups.

The divergence of two groups sums f(p, q) over all kept terms, of which most occur in neither. Inclusion-exclusion over the groups'
supports A and B avoids them: sum over A of f(p, zero of B) + sum over B of f(zero of A, q) + over terms of both a correction,
f(p, q) - f(p, zero) - f(zero, q) + f(zero, zero), + (V - |A| - |B|) times f(zero, zero). The one-sided sums need only a group's histogram
(how many terms have a count), as p depends on the count alone; the corrections come from a join of postings (a term's groups with their
counts) with themselves; the last part is one number a pair. Each unordered pair is worked out once, as f is symmetric.

Counts are summed in the tasks that cut the texts, then by Spark by (language, source, term), so a hot source or word is split. A term has
at most one posting a group, so no term is hot in the join; the rows of the result, one a pair, bound the rest.

Defined cases: null text, lang and source are empty strings and form groups like any other. A group without kept terms has
its pairs (value by the zeros alone) and no term rows; a language without kept terms has pairs of value 0; a language's only
source has no pairs. Empty texts and texts without letters count as documents of no terms. Repeated rows are documents of their own. Ties
rank by the item in UTF-8. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import doc_columns, meet, table, written

LEAST_DOCS, ONE, RANKS = 10, 1_000_000_000, 10
#: Terms held in a task before they go out as partial sums.
HELD = 300_000
#: Bytes that end a term are spaces here, A-Z are lower-cased; what is over 0x7F stays, so no character is cut.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, summed within a task; the term '' stands for the group itself."""

    def run(parts):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (n, in_docs) in held.items():
                n[b""] += 0
                yield pd.DataFrame({"lang": lang, "source": source, "term": [t.decode("utf-8", "replace") for t in n], "n": list(n.values()), "docs": [in_docs[t] for t in n]})
            held.clear()

        for pdf in parts:
            for text, group in zip(pdf["text"], zip(pdf["lang"], pdf["source"])):
                n, in_docs = held.setdefault(group, (Counter(), Counter()))
                terms = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
                n.update(terms)
                in_docs.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()

    cols = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    return doc_columns(docs, "text", "lang", "source").select(*cols).mapInPandas(run, COUNTS)


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """A written table lang, source, term, n, n_lang, lead of the kept terms (lead: one posting of each term); and a row of term ''
    (n = 0) for every group."""
    counts = partial_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    rows = counts.select("*", F.sum("n").over(of_term).alias("n_lang"), F.sum("docs").over(of_term).alias("in_docs"), F.min("source").over(of_term).alias("first"))
    kept = rows.where((F.col("in_docs") >= least_docs) | (F.col("term") == ""))
    return written(kept.select("lang", "source", "term", "n", "n_lang", (F.col("first") == F.col("source")).alias("lead")), "postings")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(ONE * (n + 2) / (total + 2 * terms)), in decimals as the product may be beyond a long; null where there are no terms."""
    return F.lit(1) + F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most ONE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _groups(posted: DataFrame) -> DataFrame:
    """A written table of the groups: lang, source, total, size (of the support), terms, total_lang, zero (share of a term it lacks)."""
    real, of_lang = F.col("term") != "", Window.partitionBy("lang")
    sums = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(real).alias("size"), F.count_if(real & F.col("lead")).alias("leads"))
    found = sums.select("lang", "source", "total", "size", F.sum("leads").over(of_lang).alias("terms"), F.sum("total").over(of_lang).alias("total_lang"))
    return written(found.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups")


def pair_divergences(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (sources, a < b), value. priced: postings with their share p and their group's zero."""
    other = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"), F.col("size").alias("size_b"))
    first, a, b = F.col("source") < F.col("b"), F.col("source"), F.col("b")
    # No term in common as yet: the constant for the terms that neither has ...
    neither = meet(groups, other, ["lang"]).where(first).select("lang", a.alias("a"), "b", F.coalesce((F.col("terms") - F.col("size") - F.col("size_b")) * apart(F.col("zero"), F.col("zero_b")), F.lit(0)).alias("value"))
    # ... and both supports against the other's zero, by the histograms of shares.
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    single = meet(histogram, other, ["lang"]).where(a != b).groupBy("lang", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(F.col("times") * apart(F.col("p"), F.col("zero_b"))).alias("value"))
    # Terms of both: what they add in truth, less what the parts above took them for.
    left = priced.select("lang", "term", "source", "p", "zero")
    right = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("zero").alias("zero_b"))
    p, q, zero, zero_b = map(F.col, ("p", "q", "zero", "zero_b"))
    both = left.join(right, ["lang", "term"]).where(first).groupBy("lang", a.alias("a"), "b").agg(F.sum(apart(p, q) - apart(p, zero_b) - apart(zero, q) + apart(zero, zero_b)).alias("value"))
    return neither.unionByName(single).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part ('pair': item is another source; 'term': item is a term that the source overuses), item, value, rank."""
    posted = postings(docs, least_docs)
    groups = _groups(posted)
    priced = meet(posted.where("term <> ''"), groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    each = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pair_divergences(priced, groups).select("lang", each.alias("way"), "value").select("lang", "way.source", "way.item", "value")
    q = share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    terms = priced.where((F.col("n") > 0) & (F.col("p") > q)).select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), q).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select("*", F.lit("pair").alias("part"), rank.alias("rank")).select(*columns).unionByName(terms.select("*", F.lit("term").alias("part"), rank.alias("rank")).where(F.col("rank") <= ranks).select(*columns))


def query(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT uid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT uid) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
dense AS (SELECT g.lang, g.source, k.term, k.n_lang, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS total, count(*) OVER (PARTITION BY lang, source)::HUGEINT AS v FROM dense),
l AS (SELECT lang, sum(n_lang)::HUGEINT AS total_lang FROM kept GROUP BY lang),
p AS (SELECT s.lang, s.source, s.term, s.n, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::BIGINT AS p,
             (1 + (1000000000::HUGEINT * (n_lang + 2)) // (total_lang + 2 * v))::BIGINT AS q FROM s JOIN l USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 10
"""
