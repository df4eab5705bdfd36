"""Packing: optimal length buckets by dynamic programming over the global length histogram, then token-budget batches.

Documents longer than ``longest`` are cut into windows of that many tokens, so a length is at most that and the histogram, which
is counted over all documents, has at most ``longest`` rows: the only thing that reaches the driver. There, the programme chooses
at most ``buckets`` upper bounds with the least padding in total (every sequence is padded to its bucket's bound). Within a
bucket, sequences form batches of floor(budget / bound), in order, inside slices of it (a hash of the document): a bucket that
holds most rows is dealt over many tasks, and at most one batch a bucket and slice is partly filled. Each bucket has slices of its
own size, of SLICE_BATCHES full batches at least.

The query and the stage count the ids of the byte-level BPE tokenizer (as ``wavelet`` writes them) and an end token; ``pack``
without a length counts bytes.

Defined cases: null or empty text: the end token alone (length 1). Very long texts: as many windows as they need. Repeated rows:
each is packed. Equal lengths and ids: in order of the window. An empty table: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import wavelet
from .common import doc_columns, table, written

LONGEST, BUCKETS, BUDGET, SLICE_ROWS, SLICE_BATCHES = 8192, 16, 131072, 20000, 8


def byte_tokens(text: Column) -> Column:
    """Tokens of a byte-level model without merges: a token a UTF-8 byte, and the end token."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def bpe_tokens(text: Column, model: str | None = None, memo: int = 600_000) -> Column:
    """Ids of a text by the byte-level BPE tokenizer, and the end token. memo: chunks that a worker keeps; only memory and speed depend on it."""
    path = model or wavelet.model_path()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        coder = wavelet.encoder(path, memo)
        return pd.Series([len(ids) + 1 for ids in coder.encode(texts)], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, ascending, that minimise the total padding; each is a length that occurs, the last the largest.

    best[k][j]: least padding of the j shortest lengths in k buckets = min over i < j of best[k - 1][i] + cost(i, j), where
    cost(i, j) = lengths[j - 1] * (sequences in (i, j]) - (their tokens). Ties: the smaller i.
    """
    if not lengths:
        return []
    order = np.argsort(lengths)
    size, n = np.array(lengths, np.int64)[order], np.array(counts, np.int64)[order]
    seqs, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    m, far = len(size), np.iinfo(np.int64).max // 4
    best, back = np.full(m + 1, far), []
    best[0] = 0
    for _ in range(min(buckets, m)):
        now, came = np.full(m + 1, far), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            cost = best[:j] + size[j - 1] * (seqs[j] - seqs[:j]) - (tokens[j] - tokens[:j])
            came[j] = int(np.argmin(cost))
            now[j] = cost[came[j]]
        back.append(came)
        best = now
    out, j = [], m
    for came in reversed(back):
        out.append(int(size[j - 1]))
        j = int(came[j])
        if not j:
            break
    return out[::-1]


def sequences(docs: DataFrame, length: Column, longest: int = LONGEST) -> DataFrame:
    """doc_id, window, length of every window; length: tokens of a document, at least 1."""
    sized = docs.select("doc_id", F.greatest(length, F.lit(1)).cast("long").alias("_all"))
    cut = sized.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_all - 1) div {longest}"))))
    return cut.select("doc_id", "window", F.least(F.lit(longest).cast("long"), F.col("_all") - F.col("window") * longest).alias("length"))


def pack(docs: DataFrame, length: Column | None = None, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, window, length, bucket (its bound), slice, batch, position, padding of every window."""
    if length is None:
        docs, length = doc_columns(docs, "doc_id", "text"), byte_tokens(F.col("text"))
    rows = written(sequences(docs, length, longest), "sequences")
    histogram = rows.groupBy("length").count().collect()  # at most ``longest`` rows
    chosen = bounds([r["length"] for r in histogram], [r["count"] for r in histogram], buckets)
    bound = F.array_min(F.filter(F.array(*(F.lit(b).cast("long") for b in chosen)), lambda b: b >= F.col("length"))) if chosen else F.lit(None).cast("long")
    slices = F.lit(1)
    for low, high in zip([0, *chosen], chosen):
        full = max(1, budget // high)
        size = -(-max(SLICE_ROWS, SLICE_BATCHES * full) // full) * full
        slices = F.when(F.col("bucket") == high, max(1, sum(r["count"] for r in histogram if low < r["length"] <= high) // size)).otherwise(slices)
    rows = rows.withColumn("bucket", bound).withColumn("slice", F.pmod(F.xxhash64("doc_id"), slices).cast("int"))
    rank = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("doc_id", "window", "length")) - 1
    fits = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div bucket"))
    rows = rows.withColumn("_rank", rank.cast("long")).withColumn("_fits", fits)
    return rows.select("doc_id", "window", "length", "bucket", "slice", F.expr("_rank div _fits").alias("batch"), (F.col("_rank") % F.col("_fits")).alias("position"), (F.col("bucket") - F.col("length")).alias("padding"))


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), bpe_tokens(F.col("text")))


def stage(spark, docs, sf_dir):
    """Every document that is left, cut to windows and dealt to batches. Workers outlive the stage and what they keep is held beside the
    next stages' work, so they keep less than the query's."""
    return pack(docs, bpe_tokens(F.col("text"), memo=100_000))
