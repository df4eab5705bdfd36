"""Document fingerprints: SimHash, and the search for all fingerprints within a Hamming radius by permuted block tables.

A text's terms are its windows of two lower-cased words (one hash of the whole sequence where it has fewer). Each distinct
term's hash gives BITS signs, which vote with weight 1 + ln(times); the fingerprint holds the signs of the sums. It is a
lower-case hex string, so equal texts have equal fingerprints on any machine.

Defined cases: null, empty or blank text: no votes, the fingerprint is all zeros, and two of them are alike (1.0). Very long
texts are hashed whole. Repeated documents follow one another in the order (doc_id, text) like any others. A single document
is its own next one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import doc_columns, mix, partitions, range_bounds, range_bucket, shingle_hashes, table, words_of

BITS, TERM_WORDS = 256, 2


def fingerprint(text: str | None, bits: int = BITS, k: int = TERM_WORDS) -> bytes:
    terms, times = np.unique(shingle_hashes(words_of(text), k), return_counts=True)
    if not len(terms):
        return bytes(bits // 8)
    votes = np.zeros(bits, np.float64)
    for at in range(0, len(terms), 1 << 14):  # bounded memory for very long texts
        part, n = terms[at : at + (1 << 14)], times[at : at + (1 << 14)]
        signs = np.stack([mix(part + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1))) for i in range(bits // 64)], axis=1)
        ones = np.unpackbits(signs.view(np.uint8), axis=1)
        once = n == 1
        votes += 2.0 * ones[once].sum(axis=0, dtype=np.int64) - once.sum()
        if not once.all():
            votes += (1 + np.log(n[~once])) @ (2.0 * ones[~once] - 1)
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / (8 * len(a))


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): each partition holds a range of ids, descending, and after them one guest row: the next document.

    Only ids are looked at to place cut points and guests; each text is shuffled once.
    """
    spark = docs.sparkSession
    bounds = range_bounds(docs, "doc_id", partitions(spark))
    docs = docs.withColumn("bucket", range_bucket(F.col("doc_id"), bounds))
    # At most as many rows as there are buckets: each bucket's first document, and the bucket that it follows.
    heads = docs.groupBy("bucket").agg(F.max(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("h"))).alias("at"))
    order = sorted(heads.collect(), key=lambda r: -r["bucket"])
    after = {(x["at"]["id"], x["at"]["h"]): order[i - 1]["bucket"] for i, x in enumerate(order)}  # the first follows the last
    guests = spark.createDataFrame([(i, h, b) for (i, h), b in after.items()], "_id long, _h long, guest_of int")
    texts = docs.join(F.broadcast(guests), (F.coalesce(F.col("doc_id"), F.lit(-(2**63))) == F.col("_id")) & (F.xxhash64("text") == F.col("_h")))
    one = texts.groupBy("guest_of").agg(F.min("doc_id").alias("doc_id"), F.max("text").alias("text"))
    rows = docs.select("bucket", "doc_id", "text", F.lit(False).alias("guest")).unionByName(one.select(F.col("guest_of").alias("bucket"), "doc_id", "text", F.lit(True).alias("guest")))
    return rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("guest", F.desc("doc_id"), F.desc(F.xxhash64("text")))


def compare(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The contract's comparison of every document with its edited text and its next document."""

    def run(parts):
        held: list = []

        def rows(them):
            prints = [fingerprint(t, bits) for _, t, _ in them]
            out = []
            for (i, text, _), (_, follows, _), a, b in zip(them, them[1:], prints, prints[1:]):
                other = edited(text, follows)
                c = fingerprint(other, bits)
                out.append((i, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), a.hex(), c.hex(), likeness(a, c), likeness(a, b)))
            return pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for pdf in parts:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                held += zip(part["doc_id"].astype("Int64"), part["text"], part["guest"])
                # A partition is one bucket and ends with its guest; nothing follows a guest.
                if len(held) > 1:
                    yield rows(held)
                    held = held[-1:]

    return with_next(doc_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "text", "guest").mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, bits: int = BITS, k: int = TERM_WORDS) -> DataFrame:
    """doc_id, fingerprint (hex) of every document."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, bits, k).hex())

    return docs.select("doc_id", of(F.coalesce("text", F.lit(""))).alias("fingerprint"))


def within(prints: DataFrame, radius: int = 12, bits: int = BITS, keyed: int = 2) -> DataFrame:
    """All pairs (a < b, distance) of distinct fingerprints at most ``radius`` bits apart. prints: fingerprint (hex).

    The bits are cut into radius + keyed blocks of near equal width. Two fingerprints within the radius agree on at least
    ``keyed`` whole blocks, so one table a choice of ``keyed`` blocks, keyed by their bits, finds every pair; the distance is
    then checked on all bits. Equal fingerprints are taken once, so a group of copies makes no pairs. More keyed blocks: more
    tables, but fewer chance candidates at a large number of fingerprints (choose keyed * bits / (radius + keyed) > log2 of it).
    """
    n = radius + keyed
    cuts = [bits * i // n for i in range(n + 1)]
    one = prints.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
    chunks = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bits // 16 - 1)), lambda i: F.lpad(F.conv(F.substr(F.col("fingerprint"), i * 4 + 1, F.lit(4)), 16, 2), 16, "0")), "")
    one = one.withColumn("bits", chunks)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.xxhash64(*(F.substring("bits", cuts[b] + 1, cuts[b + 1] - cuts[b]) for b in chosen)).alias("key")) for t, chosen in enumerate(combinations(range(n), keyed))))
    rows = one.select("fingerprint", F.explode(tables).alias("at")).select("fingerprint", "at.t", "at.key")
    pairs = rows.alias("x").join(rows.alias("y"), ["t", "key"]).where(F.col("x.fingerprint") < F.col("y.fingerprint")).select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b")).distinct()
    apart = F.aggregate(F.sequence(F.lit(0), F.lit(bits // 32 - 1)), F.lit(0), lambda s, i: s + F.bit_count(F.conv(F.substr(F.col("a"), i * 8 + 1, F.lit(8)), 16, 10).cast("long").bitwiseXOR(F.conv(F.substr(F.col("b"), i * 8 + 1, F.lit(8)), 16, 10).cast("long"))))
    return pairs.withColumn("distance", apart).where(F.col("distance") <= radius)


def query(spark, sf_dir):
    return compare(table(spark, sf_dir, "documents"))
