"""MinHash near-duplicates: many universal hash minima with banding, signature verification, exact confirmation, components.

1. Each text becomes its set of distinct word shingles, HASHES minima of universal hash functions, and BANDS keys of ROWS minima
   each. Texts of equal sets (by a 128-bit BLAKE2 digest of the sorted set) are one class, known by half of its digest, so copies
   never make pairs.
2. Members of a band's bucket are paired with its least member (a star; some bands also form small stars within a bucket), pairs
   whose signatures are too unlike are dropped, the rest is confirmed on the full sets of the whole texts, and the links' components are found.
3. A star can miss a link between two other members. In every bucket that still holds several components, all pairs between
   different components are compared: by a join where the bucket is small, and block by block within tasks where it is large
   (its members dealt to blocks of BLOCK rows, a task a pair of blocks; only links leave the task).
   So no bucket is capped, and within buckets no link that could join two components is lost.

At a likeness of 0.8 two texts share no bucket with probability (1 - 0.8^6)^40 = 5e-6; a pair's signatures agree on fewer than
SURE of 240 with probability below 1e-6.

Defined cases: null, empty and blank texts: an empty set, linked with nothing. Texts of fewer words than a shingle: the whole
sequence is one. Very long texts are compared whole. Repeated rows are copies. Rows of one doc_id with different texts are judged
each by its text. Null doc_ids: each row has an id of its own, a hash of its text, language and source, so it's a document like
others; beside rows with a doc_id, one of those is kept; a group in which no row has a doc_id has a null component_id, and one of
it is kept. Ties don't arise: a likeness of exactly 80 % is a link. Empty tables: an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, mix, shingle_hashes, spare, table, words_of, written
from .components import components

ROWS, BANDS = 6, 40
HASHES = ROWS * BANDS
SMALL, BLOCK, SLOT = 48, 512, 8
#: Pairs of texts that are compared at a time.
TOGETHER = 200


def _functions(n: int = HASHES, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift over 32-bit keys: strongly universal with 64-bit factors and terms."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**63, (2, n), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (2, n), dtype=np.uint64)
    return a | np.uint64(1), b


def signature(shingles: np.ndarray, functions=None) -> np.ndarray:
    """The minima (uint32) of distinct shingles' hashes."""
    a, b = functions or _functions()
    keys = shingles & np.uint64(0xFFFFFFFF)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(keys), 256):
        part = ((a[:, None] * keys[None, at : at + 256] + b[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(best, part.min(axis=1), out=best)
    return best


def row_id(docs: DataFrame) -> Column:
    """A non-null id of each row: its doc_id or, where that is null, a hash of at least 2^62. An empty text stands for a null one,
    as xxhash64 passes over nulls."""
    content = F.xxhash64(*(F.coalesce(docs[c], F.lit("")) for c in ("text", "lang", "source") if c in docs.columns))
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(2**62) + F.pmod(content, F.lit(2**62)))


def content_id(docs: DataFrame) -> Column:
    """A hash of a row's id, text, language and source: equal for rows that are equal in these."""
    return F.xxhash64(*(F.struct(F.coalesce(docs[c].cast("string"), F.lit("")), docs[c].isNull()) for c in ("doc_id", "text", "lang", "source") if c in docs.columns))


def sets(docs: DataFrame, k: int) -> DataFrame:
    """row (the id), uid, doc_id, n_shingles, key1, key2 (128 bits of the whole set), bands (array<long>), sketch (the low byte of
    each minimum)."""

    def run(parts):
        functions = _functions()
        number = np.arange(BANDS, dtype=np.uint64)
        for pdf in parts:
            out = []
            for row, uid, i, text in zip(pdf["row"], pdf["uid"], pdf["doc_id"].astype("Int64"), pdf["text"]):
                found = np.unique(shingle_hashes(words_of(text), k))
                if not len(found):
                    out.append((row, uid, i, 0, None, None, None, None))
                    continue
                minima = signature(found, functions)
                keys = number + np.uint64(1)
                for column in minima.reshape(BANDS, ROWS).T:
                    keys = mix(keys * np.uint64(0xD1342543DE82EF95) + column)
                whole = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), "<i8").tolist()
                out.append((row, uid, i, len(found), *whole, keys.astype(np.int64), minima.astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["row", "uid", "doc_id", "n_shingles", "key1", "key2", "bands", "sketch"]).astype({"doc_id": "Int64", "key1": "Int64", "key2": "Int64"})

    return docs.select("row", "uid", "doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "row long, uid long, doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, sketch binary")


def least_agreeing(percent: int) -> int:
    """How many minima must agree: the expected number at this likeness less five standard deviations."""
    j = percent / 100
    return int(HASHES * j - 5 * (HASHES * j * (1 - j)) ** 0.5)


def _sized(a: Column, b: Column, percent: int) -> Column:
    """Sets of such sizes can be that alike."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the likeness."""
    sure = least_agreeing(percent)

    @F.pandas_udf("int")
    def agreeing(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        p, q = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
        return pd.Series((p == q).sum(axis=1).astype(np.int32))

    side = lambda n: classes.select(F.col("rep").alias(n), F.col("n_shingles").alias(f"n_{n}"), F.col("sketch").alias(f"s_{n}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(_sized(F.col("n_a"), F.col("n_b"), percent))
    return met.where(agreeing("s_a", "s_b") >= sure).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are that alike. texts: rep, text."""

    def shingles(text):
        words = words_of(text)
        return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)}

    def run(batches):
        last, held = None, set()
        for batch in batches:
            good = []
            for at in range(0, batch.num_rows, TOGETHER):  # only so many texts are Python strings at a time
                for a, b, x, y in zip(*(column.to_pylist() for column in batch.slice(at, TOGETHER).columns)):
                    if last != (a, x):
                        last, held = (a, x), shingles(x)
                    other = shingles(y)
                    both = len(held & other)
                    if 100 * both >= percent * (len(held) + len(other) - both):
                        good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], ["a", "b"])

    met = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _between(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """rows (key, rep, component, n_shingles, sketch, text, members) of large buckets -> links (a, b) between different components.
    Each pair of blocks is a group of its own; signatures and then the full shingle sets (by 64-bit hashes) are compared within the
    task, and once two components are linked there their other pairs are left out, so that only links leave it."""
    sure = least_agreeing(percent)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    rows = rows.select("key", "rep", "component", "n_shingles", "sketch", "text", "_own", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        out: list[tuple[int, int]] = []
        own, ids, comps, sizes = (pdf[c].to_numpy() for c in ("_own", "rep", "component", "n_shingles"))
        comps = comps.copy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if len(left) and len(right):
            sketches = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
            texts, found = pdf["text"].to_numpy(), {}

            def full(at: int) -> np.ndarray:
                if at not in found:
                    found[at] = np.unique(shingle_hashes(words_of(texts[at]), k))
                return found[at]

            for a in left:
                ok = (comps[right] != comps[a]) & (100 * np.minimum(sizes[right], sizes[a]) >= percent * np.maximum(sizes[right], sizes[a]))
                if i == j:
                    ok &= ids[right] > ids[a]
                near = right[ok]
                near = near[(sketches[near] == sketches[a]).sum(axis=1) >= sure]
                if not len(near):
                    continue
                mine, others = full(a), [full(x) for x in near]
                joined = np.concatenate(others)
                at = np.minimum(np.searchsorted(mine, joined), len(mine) - 1)
                both = np.add.reduceat((mine[at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum([len(o) for o in others])[:-1]]))
                for b in near[100 * both >= percent * (sizes[a] + sizes[near] - both)]:
                    if comps[a] != comps[b]:
                        out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
                        comps[comps == comps[b]] = comps[a]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed rows, classes, links): signed: row, uid, doc_id, n_shingles, key1, key2; classes: rep (the class's own id), row (its
    least), least_id (null where no row has a doc_id), key1, key2, uid (of one of its rows), ...; links: confirmed pairs (a, b) of
    classes that connect all that is connected."""
    docs = docs.select(row_id(docs).alias("row"), content_id(docs).alias("uid"), docs["doc_id"], docs["text"])
    signed = written(sets(docs, k), "signed")
    classes = written(signed.where("n_shingles > 0").groupBy("key1", "key2").agg(F.first("key1").alias("rep"), F.min("row").alias("row"), F.min("uid").alias("uid"), F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    rows = classes.select("rep", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("least")).where("members > 1")
    members = written(rows.join(full, "key"), "buckets")
    # One whole text of each class that shares a bucket with another.
    shared = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "uid")
    texts = written(docs.join(shared, "uid").groupBy("uid", "rep").agg(F.min("text").alias("text")).drop("uid"), "texts")
    star = members.where(F.col("rep") != F.col("least")).select(F.col("least").alias("a"), F.col("rep").alias("b"))
    # In about a quarter of the bands, larger buckets are also dealt by hash to slots, each a small star of its own: texts that are
    # unlike their bucket's least member mostly meet others of their group here, which leaves few components to compare below.
    dealt = members.where((F.col("members") > SLOT) & (F.pmod("key", F.lit(4)) == 0)).withColumn("slot", F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("members") / SLOT)))
    low = dealt.groupBy("key", "slot").agg(F.min("rep").alias("a"))
    star = written(star.unionByName(dealt.join(low, ["key", "slot"]).where(F.col("rep") != F.col("a")).select("a", F.col("rep").alias("b"))).distinct(), "pairs")
    first = written(confirmed(alike(star, classes, percent), texts, k, percent), "links")
    found = components(first)
    own = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "members", F.coalesce("component", "rep").alias("component"))
    several = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    rest = written(own.join(several, "key", "left_semi"), "rest")
    small = rest.where(F.col("members") <= SMALL)
    sized = classes.select("rep", "n_shingles")
    near = small.join(sized, "rep")
    side = lambda n: near.select("key", F.col("rep").alias(n), F.col("component").alias(f"c_{n}"), F.col("n_shingles").alias(f"n_{n}"))
    few = side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & _sized(F.col("n_a"), F.col("n_b"), percent)).select("a", "b").distinct()
    many = _between(rest.where(F.col("members") > SMALL).join(classes.select("rep", "n_shingles", "sketch"), "rep").join(texts, "rep"), k, percent).distinct()
    # What the star has already tried and found unlike isn't tried again.
    second = written(alike(few, classes, percent).unionByName(many).distinct().join(star, ["a", "b"], "left_anti"), "pairs")
    more = written(confirmed(second, texts, k, percent), "links")
    discard(members, texts, star, rest, second)
    return signed, classes, first.unionByName(more)


def grouped(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, kept, a row a document; see groups()."""
    signed, classes, pairs = links(docs, k, percent)
    found = written(components(pairs).withColumnRenamed("id", "rep"), "components")
    # The least doc_id and the least id of each component, from its classes.
    least = classes.select("rep", "row", "least_id").join(found, "rep").groupBy("component").agg(F.min("least_id").alias("least_doc"), F.min("row").alias("least_row"))
    linked = found.join(least, "component").select("rep", "least_doc", "least_row")
    own = classes.select("key1", "key2", "rep", "row", "least_id").join(linked, "rep", "left")
    alone = F.col("least_row").isNull()
    named = own.select("key1", "key2", F.when(alone, F.col("least_id")).otherwise(F.col("least_doc")).alias("component_id"), F.coalesce("least_row", "row").alias("first"))
    out = signed.select("row", "uid", "doc_id", "n_shingles", "key1", "key2").join(named, ["key1", "key2"], "left")
    # No class: an empty text, which stands for itself.
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.when(component.isNull(), F.col("row") == F.coalesce("first", "row")).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False)))
    return out.select("uid", "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable, itself included), kept (doc_id = component_id; where no row of the
    group has a doc_id, the row of the least id), a row a document."""
    return grouped(docs, k, percent).drop("uid")


#: The same by all pairs that share a shingle, and a recursive search of what is reachable.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON d.doc_id = least.a
"""


def query(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"), k=2)


def stage(spark, docs, sf_dir):
    """One document of each group (five words, 0.8), with its columns as they are; of equal rows just one stays."""
    own = spare(docs, "_uid")
    kept = grouped(docs, k=5).where("kept").select(F.col("uid").alias(own)).distinct()
    return docs.withColumn(own, content_id(docs)).join(kept, own, "left_semi").dropDuplicates([own]).select(*docs.columns)
