"""LM scoring: a Katz back-off bigram model, Good-Turing discounted, with exactly normalised back-off weights.

* Unigrams: c > K: c / N; c <= K: Good-Turing discounted; what is left goes to one class of unknown words.
* Bigrams seen at least LEAST times (1: all that were seen): d(c) * c / c(context). Else: alpha(context) * unigram, where alpha
  makes the probabilities of all words and the unknown class sum to 1 for every context.

A word is known by 64 bits of its hash, a bigram by 64 bits of its words'. Texts start from a begin context; each word and one end
token are predicted. Most bigrams of a corpus are seen once, so a row a bigram would cost many times the texts. Instead:

1. ``blocks``: whole texts in blocks of about BLOCK tokens; a block keeps its distinct words and its texts as numbers of these.
2. ``counts``: a block asks for the counts of its distinct words and bigrams. Requests go to buckets of the hashes' range, so a
   frequent word is one key a block, and are sorted, delta-coded and compressed. Buckets answer with the counts over all blocks.
3. ``fit``: each n-gram has one block that owns it and writes it: the tables of unigrams and of bigrams, partitioned by order,
   and from the bigrams the table of contexts with their back-off weights.
4. ``score``: blocks ask for the weights of their contexts in the same way and score each token: the bigram, else the weight
   times the unigram. Texts that the model was fitted to still have the counts from step 2; others (``score_texts``) ask the
   stored tables for these too.

Only counts of counts reach the driver. A task holds one block or one bucket (about KEYS keys); there are as many as the input needs.

Defined cases: null or empty text: the end token alone. Very long texts are a block of their own at most. No training rows: every token is unknown, with probability 1 (score 0,
and the base of nothing known, log10(0.5 / 0.5) = 0). Repeated rows count each. An empty table: an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import doc_columns, mix, new_path, partitions, table, word_hashes, words_of, written

K, LEAST = 5, 1
BLOCK, KEYS = 1_200_000, 1_200_000
#: Keys of the end token and of the begin context (no word has a space in it).
END, BEGIN = b" end", b" begin"
NULL_ID = -(2**63)
GRAMS = "order int, v long, w long, c long, context long, p double"


def held_out(doc_id: Column, mod: int = 5, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: the high bytes of small ones cost next to nothing."""
    import zstandard

    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes()) if len(numbers) else b""


def expanded(blob: bytes, dtype) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob) if blob else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(dtype)


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(expanded(blob, np.uint64), dtype=np.uint64)


def _key_blob(ascending: np.ndarray) -> bytes:
    return squeezed(np.diff(ascending, prepend=np.uint64(0)))


def _buckets(ascending: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """(bucket, where) of sorted hashes; buckets are equal ranges of their upper halves."""
    of = ((ascending >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return [(int(of[a]), slice(a, b)) for a, b in zip(first, [*first[1:], len(of)])]


def blocks(docs: DataFrame, tokens: int = BLOCK) -> DataFrame:
    """docs (doc_id, held_out, text) -> block, n_tokens, train_tokens, train_docs; ids, held, lengths of the texts in order; words
    (sorted distinct hashes); seq (each token's number in words)."""

    def run(parts):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        end = word_hashes([END])

        def flush():
            ids, out = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.bool_)
            lengths = np.array([len(x[2]) for x in held], np.int64)
            words, seq = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
            blobs = squeezed(ids), squeezed(out), squeezed(lengths), _key_blob(words), squeezed(seq.astype(np.uint32))
            return pd.DataFrame([(number, lengths.sum(), lengths[~out].sum(), (~out).sum(), *blobs)], columns=["block", "n_tokens", "train_tokens", "train_docs", "ids", "held", "lengths", "words", "seq"])

        for pdf in parts:
            for i, out, text in zip(pdf["doc_id"].astype("Int64").fillna(NULL_ID), pdf["held_out"], pdf["text"]):
                held.append((i, out, np.concatenate([word_hashes(words_of(text)), end])))
                size += len(held[-1][2])
                if size >= tokens:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "block long, n_tokens long, train_tokens long, train_docs long, ids binary, held binary, lengths binary, words binary, seq binary")


class Block:
    """One row of ``blocks``. pairs: distinct bigrams (v, w: numbers in names, which are the words and then the begin context);
    of: each token's pair; order: the pairs by ascending code."""

    def __init__(self, row):
        self.ids, self.held, self.lengths = expanded(row.ids, np.int64), expanded(row.held, np.bool_), expanded(row.lengths, np.int64)
        self.words, self.seq = _keys(row.words), expanded(row.seq, np.uint32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.names = np.append(self.words, word_hashes([BEGIN]))

    def pair(self) -> None:
        n, before = np.uint64(len(self.words)), np.empty(len(self.seq), np.uint64)
        before[1:] = self.seq[:-1]
        before[self.starts] = n
        pairs, self.of = np.unique(before * n + self.seq, return_inverse=True)
        self.v, self.w = pairs // n, pairs % n
        codes = mix(self.names[self.v] * np.uint64(0xD1342543DE82EF95) + self.words[self.w])
        self.order = np.argsort(codes)
        self.codes = codes[self.order]

    def take(self, got: pd.DataFrame) -> None:
        """From the rows of ``counts``: c and own of words, pair_c and pair_own of pairs."""
        rows = got[got["w"].notna()].sort_values("bucket")
        words, pairs = (np.concatenate([expanded(x, np.int64) for x in rows[c]]) for c in ("w", "b"))
        back = np.empty_like(pairs)
        back[self.order] = pairs
        self.c, self.own, self.pair_c, self.pair_own = words >> 1, words & 1, back >> 1, back & 1

    def weigh(self, got: pd.DataFrame) -> None:
        """From the rows of ``weights``: alpha and extra of names."""
        rows, order = got[got["alpha"].notna()].sort_values("bucket"), np.argsort(self.names)
        self.alpha, self.extra = np.empty(len(order)), np.empty(len(order), np.int8)
        self.alpha[order] = np.concatenate([expanded(x, np.float64) for x in rows["alpha"]])
        self.extra[order] = np.concatenate([expanded(x, np.int8) for x in rows["extra"]])


def requests(found: DataFrame, n: int) -> DataFrame:
    """bucket, block, w, w_n, b, b_n: sorted words and bigrams of a block in that bucket and their counts in training texts."""

    def run(parts):
        for pdf in parts:
            for row in pdf.itertuples():
                x = Block(row)
                x.pair()
                train = np.repeat(~x.held, x.lengths)
                words, pairs = np.bincount(x.seq[train], minlength=len(x.words)), np.bincount(x.of[train], minlength=len(x.v))[x.order]
                out: dict[int, list] = {}
                for k, (keys, count) in enumerate(((x.words, words), (x.codes, pairs))):
                    for bucket, at in _buckets(keys, n):
                        out.setdefault(bucket, [b""] * 4)[2 * k : 2 * k + 2] = _key_blob(keys[at]), squeezed(count[at])
                yield pd.DataFrame([(bucket, row.block, *blobs) for bucket, blobs in out.items()], columns=["bucket", "block", "w", "w_n", "b", "b_n"])

    return found.mapInPandas(run, "bucket int, block long, w binary, w_n binary, b binary, b_n binary")


def counts(asked: DataFrame) -> DataFrame:
    """block, bucket, w, b: for each request, in its order, twice the count over all blocks, plus 1 for the block that owns the key;
    stats: once a bucket, the distinct keys and those seen 1 .. K + 1 times, of words and then of bigrams."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, stats = {"block": pdf["block"], "bucket": pdf["bucket"]}, []
        for name in ("w", "b"):
            keys, n = [_keys(x) for x in pdf[name]], np.concatenate([expanded(x, np.int64) for x in pdf[f"{name}_n"]])
            _, of = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(of, weights=n).astype(np.int64)
            seen = np.flatnonzero(n)
            reply = 2 * total[of]
            reply[seen[np.unique(of[seen], return_index=True)[1]]] += 1
            out[name] = [squeezed(x) for x in np.split(reply, np.cumsum([len(x) for x in keys])[:-1])]
            stats += [int(np.count_nonzero(total)), *np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()]
        return pd.DataFrame(out | {"stats": [stats, *[None] * (len(pdf) - 1)]})

    return asked.groupBy("bucket").applyInPandas(run, "block long, bucket int, w binary, b binary, stats array<long>")


def discounts(n: dict[int, int], k: int = K) -> list[float]:
    """d(1) .. d(k) from counts of counts n(1) .. n(k + 1); where Good-Turing gives none in (0, 1), absolute: (r - 0.5) / r."""
    common = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    out = []
    for r in range(1, k + 1):
        d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - common) / (1 - common) if n.get(r) and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    few = np.array([0.0, *(r * x for r, x in enumerate(d, 1))])
    return np.where(c <= len(d), few[np.minimum(c, len(d))], c.astype(np.float64))


class Known:
    """What is global: tokens, texts and distinct words of training, discounts, and the probability of the unknown class."""

    def __init__(self, tokens: int, texts: int, stats: list[int]):
        self.tokens, self.texts, self.distinct = tokens, texts, stats[0]
        words, pairs = ({r: x for r, x in enumerate(stats[at : at + K + 1], 1) if x} for at in (1, K + 3))
        self.d1, self.d2 = discounts(words), discounts(pairs)
        few = {r: words.get(r, 0) for r in range(1, K + 1)}
        mass = (tokens - sum(r * n for r, n in few.items()) + sum(r * n * self.d1[r - 1] for r, n in few.items())) / max(tokens, 1)
        self.unknown = max(1 - mass, 1 / (tokens + 1))
        self.share = (1 - self.unknown) / mass / max(tokens, 1) if mass else 0.0

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _discounted(c, self.d1) * self.share, self.unknown)


def grams(found: DataFrame, replies: DataFrame, known: Known) -> DataFrame:
    """order 1: w, c, p (its probability), v 0, context (tokens); order 2, those seen LEAST times or more: v, w, c, context (count
    of v as one), p (unigram probability of w). Each from the block that owns it."""

    def run(row: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        x = Block(row.iloc[0])
        x.pair()
        x.take(got)
        one, two = np.flatnonzero(x.own), np.flatnonzero(x.pair_own & (x.pair_c >= LEAST))
        v, w, names, p = x.v[two], x.w[two], x.names.view(np.int64), known.unigram(x.c)
        both = {"order": (1, 2), "v": (0, names[v]), "w": (names[one], names[w]), "c": (x.c[one], x.pair_c[two]), "context": (known.tokens, np.append(x.c, known.texts)[v]), "p": (p[one], p[w])}
        return pd.concat([pd.DataFrame({name: pair[k] for name, pair in both.items()}, index=range(n)) for k, n in enumerate((len(one), len(two)))])

    return found.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, GRAMS)


def contexts(bigrams: DataFrame, d2: list[float]) -> DataFrame:
    """v, alpha, extra: the weights of contexts that have bigrams of their own (1 for all others). A context whose discounted
    bigrams leave nothing is counted extra (1) times more."""
    c = F.col("c").cast("double")
    for r, d in enumerate(d2, 1):
        c = F.when(F.col("c") == r, F.lit(d * r)).otherwise(c)
    sums = bigrams.groupBy("v").agg(F.sum(c).alias("dc"), F.sum("p").alias("p"), F.max("context").alias("c"))
    sums = sums.withColumn("extra", F.when(F.col("c") - F.col("dc") < 1e-9 * F.col("c"), 1).otherwise(0))
    return sums.select("v", ((1 - F.col("dc") / (F.col("c") + F.col("extra"))) / (1 - F.col("p"))).alias("alpha"), "extra")


def weights(found: DataFrame, known_contexts: DataFrame, n: int) -> DataFrame:
    """block, bucket, alpha, extra: for the sorted names of a block in that bucket."""

    def ask(parts):
        for pdf in parts:
            for block, words in zip(pdf["block"], pdf["words"]):
                names = np.sort(np.append(_keys(words), word_hashes([BEGIN])))
                yield pd.DataFrame([(bucket, block, _key_blob(names[at])) for bucket, at in _buckets(names, n)], columns=["bucket", "block", "v"])

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        v = held["v"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(v)
        # One more that no name finds.
        v, alpha, extra = v[order], np.append(held["alpha"].to_numpy(np.float64)[order], 1.0), np.append(held["extra"].to_numpy(np.int8)[order], np.int8(0))
        out = []
        for block, bucket, blob in zip(asked["block"], asked["bucket"], asked["v"]):
            names = _keys(blob)
            at = np.searchsorted(v, names)
            at[np.append(v, np.uint64(0))[at] != names] = len(v)
            out.append((block, bucket, squeezed(alpha[at]), squeezed(extra[at])))
        return pd.DataFrame(out, columns=["block", "bucket", "alpha", "extra"])

    asked = found.select("block", "words").mapInPandas(ask, "bucket int, block long, v binary")
    dealt = known_contexts.withColumn("bucket", F.shiftright(F.shiftrightunsigned("v", 32) * F.lit(n).cast("long"), 32).cast("int"))
    return asked.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(run, "block long, bucket int, alpha binary, extra binary")


def stored_counts(found: DataFrame, ngrams: DataFrame, n: int) -> DataFrame:
    """What ``counts`` replies, but from the stored table of n-grams: block, bucket, w, b, with a count of 0 for what it lacks."""

    @F.pandas_udf("long")
    def key(order: pd.Series, v: pd.Series, w: pd.Series) -> pd.Series:
        before, word = (x.to_numpy(np.int64).view(np.uint64) for x in (v, w))
        return pd.Series(np.where(order == 1, word, mix(before * np.uint64(0xD1342543DE82EF95) + word)).astype(np.uint64).view(np.int64))

    def ask(parts):
        for pdf in parts:
            for row in pdf.itertuples():
                x = Block(row)
                x.pair()
                out: dict[int, list] = {}
                for k, keys in enumerate((x.words, x.codes)):
                    for bucket, at in _buckets(keys, n):
                        out.setdefault(bucket, [b""] * 2)[k] = _key_blob(keys[at])
                yield pd.DataFrame([(bucket, row.block, *blobs) for bucket, blobs in out.items()], columns=["bucket", "block", "w", "b"])

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = {"block": asked["block"], "bucket": asked["bucket"]}
        for order, name in ((1, "w"), (2, "b")):
            own = held[held["order"] == order]
            known = own["key"].to_numpy(np.int64).view(np.uint64)
            at = np.argsort(known)
            known, c = np.append(known[at], np.uint64(0)), np.append(own["c"].to_numpy(np.int64)[at], 0)
            answers = []
            for blob in asked[name]:
                keys = _keys(blob)
                place = np.searchsorted(known[:-1], keys)
                answers.append(squeezed(2 * np.where(known[place] == keys, c[place], 0)))
            out[name] = answers
        return pd.DataFrame(out)

    asked = found.mapInPandas(ask, "bucket int, block long, w binary, b binary")
    dealt = ngrams.select("order", key("order", "v", "w").alias("key"), "c").withColumn("bucket", F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(n).cast("long"), 32).cast("int"))
    return asked.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(run, "block long, bucket int, w binary, b binary")


def score_texts(docs: DataFrame, ngrams: DataFrame, held: DataFrame, known: Known, n: int, tokens: int = BLOCK) -> DataFrame:
    """Scores any texts (doc_id, text) by a stored model: the tables of n-grams and contexts that ``fit`` wrote, and what is global."""
    found = written(blocks(doc_columns(docs, "doc_id", "text").withColumn("held_out", F.lit(True)), tokens), "blocks")
    answers = stored_counts(found, ngrams, n).unionByName(weights(found, held, n), allowMissingColumns=True)
    return score(found, answers, known).drop("held_out")


def score(found: DataFrame, replies: DataFrame, known: Known) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score, a row a document. replies: rows of ``counts`` and ``weights``."""

    def run(row: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        x = Block(row.iloc[0])
        x.pair()
        x.take(got)
        x.weigh(got)
        one = np.log10(known.unigram(x.c))
        size = (np.append(x.c, known.texts) + x.extra)[x.v]
        kept = x.pair_c >= LEAST
        own = np.where(kept, _discounted(x.pair_c, known.d2) / np.maximum(size, 1), x.alpha[x.v])
        two = np.log10(own) + np.where(kept, 0.0, one[x.w])
        base = np.log10((x.c + 0.5) / (known.tokens + 0.5 * (known.distinct + 1)))
        sums = lambda values: np.add.reduceat(values, x.starts)
        ids = pd.Series(x.ids, dtype="Int64").mask(x.ids == NULL_ID)
        return pd.DataFrame({"doc_id": ids, "held_out": x.held, "n_tokens": x.lengths, "n_known": sums((x.c > 0).astype(np.int64)[x.seq]), "base_score": sums(base[x.seq]), "score": sums(two[x.of])})

    return found.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def fit(found: DataFrame, keys: int = KEYS) -> tuple[DataFrame, DataFrame, DataFrame, int, Known]:
    """Rows of ``blocks`` -> rows of ``counts``, the model's tables (n-grams partitioned by order; contexts), the number of
    buckets, and what is global. Learns from the texts that are not held out."""
    spark = found.sparkSession
    total = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "train_tokens", "train_docs"))).first()
    n = max(partitions(spark), -(-2 * total["n_tokens"] // keys))
    replies = written(counts(requests(found, n)), "counts")
    stats = {r["pos"]: r["n"] for r in replies.select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    known = Known(total["train_tokens"], total["train_docs"], [stats.get(i, 0) for i in range(2 * K + 4)])
    path = new_path(spark, "ngrams")
    # A block's words recur in its bigrams: a dictionary that holds them all takes a quarter off the table.
    grams(found, replies, known).write.partitionBy("order").option("parquet.dictionary.page.size", 4 << 20).option("compression", "zstd").parquet(path)
    ngrams = spark.read.schema(GRAMS).parquet(path)
    return replies, ngrams, written(contexts(ngrams.where("order = 2"), known.d2), "contexts"), n, known


def judge(docs: DataFrame, mod: int = 5, rest: int = 1, tokens: int = BLOCK, keys: int = KEYS) -> DataFrame:
    docs = doc_columns(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), mod, rest))
    found = written(blocks(docs, tokens), "blocks")
    replies, _, held, n, known = fit(found, keys)
    answers = replies.drop("stats").unionByName(weights(found, held, n), allowMissingColumns=True)
    return score(found, answers, known).withColumn("train_tokens", F.lit(known.tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))
