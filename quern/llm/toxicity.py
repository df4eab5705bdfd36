"""Toxicity: non-negative positive-unlabelled learning of linear classifiers, trained with numpy.

Learns from confirmed toxic texts and unlabelled ones. With the class prior p (the share of toxic among labelled rows, over all of
them), the risk is p * R+(positive) + max(0, R-(unlabelled) - p * R-(positive)): the unlabelled texts' negative risk, corrected
for the positives among them, never below zero; where it would be, the step goes up it instead (non-negative correction).
Features: whether a text holds a word, or a word that begins with certain 3 to 8 letters; those kept lie much more often in
positive than in unlabelled texts.

1. ``positive_names``: the features of the positive texts, counted by Spark. At most POSITIVES labelled texts, chosen by hash, are
   learnt from: the only bound there is, on labelled rows, so that the positives fit beside each task's texts.
2. ``unlabelled_counts``: how many of all texts allowed hold each of these; ``choose`` keeps the KEPT most telling.
3. ``fit``: every text allowed is unlabelled. They are dealt to chunks of about CHUNK texts; a task fits a classifier to its chunk
   and the positives, and the chunks' weights are averaged by their texts (parameter mixing). Only sums reach the driver.
4. ``score``: one pass, no shuffle.

Defined cases: null or empty text, and texts without any kept feature: the score of the intercept; ``stage`` keeps them, as nothing
speaks against them. No positive labels at all: every score is 0 (to 17 digits). Repeated labels count as often as they stand;
repeated rows are unlabelled texts each, but one positive text an id (the least text). Very long texts count and are scored whole.
Ties of ``choose`` go to the lesser name. Empty tables: an empty result. Null doc_ids are never held out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, doc_columns, spare, table, words_of, written
from .memo import Memo

POSITIVES, CHUNK, KEPT, THRESHOLD = 4000, 8000, 1024, 0.3
SIGNS = ".,;:!?|\"'()[]#*$%&<>-"


def held_out(doc_id: Column, mod: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def names_of(word: bytes) -> list[str]:
    """Features of a word: itself without signs around it, and its first 3 to 8 letters."""
    text = word.decode("utf-8", "replace").strip(SIGNS)
    return [f"w{text}", *(f"p{text[:k]}" for k in range(3, min(8, len(text)) + 1))] if text else []


class Features:
    """The distinct features of texts: as names, or as their numbers in ``kept``."""

    def __init__(self, kept: list[str] | None = None):
        at = {name: i for i, name in enumerate(kept or ())}
        heads = {name[1:4] for name in at}  # few words begin like a kept feature

        def numbers(word: bytes) -> tuple:
            text = word.decode("utf-8", "replace").strip(SIGNS)
            return tuple(at[n] for n in names_of(word) if n in at) if text[:3] in heads else ()

        self.memo = Memo(lambda words: map(names_of if kept is None else numbers, words), 300_000)

    def found(self, text: str | None) -> set:
        words = set(words_of(text))
        known = self.memo.need(words)
        found = set(chain.from_iterable(map(known.__getitem__, words)))
        self.memo.trim()
        return found

    def of(self, text: str | None) -> list:
        return sorted(self.found(text))


@dataclass
class Model:
    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = -40.0


@dataclass
class Sparse:
    """Rows of a 0/1 matrix with a last column of ones: the row and the column of each other one."""

    row: np.ndarray
    at: np.ndarray
    n: int
    width: int

    @classmethod
    def of(cls, blobs: list[bytes], width: int) -> Sparse:
        sizes = [len(b) // 2 for b in blobs]
        return cls(np.repeat(np.arange(len(blobs)), sizes), np.frombuffer(b"".join(blobs), "<u2").astype(np.int64), len(blobs), width)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n) + w[-1]

    def back(self, g: np.ndarray) -> np.ndarray:
        """The transposed matrix times g."""
        return np.append(np.bincount(self.at, weights=g[self.row], minlength=self.width), g.sum())

    def __len__(self) -> int:
        return self.n


class Lone(Sparse):
    """One real column and the column of ones."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return self.x * w[0] + w[1]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.array([self.x @ g, g.sum()])


def choose(p: np.ndarray, u: np.ndarray, positives: int, texts: int, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Which features are kept (ascending), and by how much each is oftener in positive texts (log, held down if rare)."""
    # How sure it is that a feature is oftener in positive texts: z of two shares.
    q = (p + u) / (positives + texts)
    z = (p / positives - u / texts) / np.sqrt(q * (1 - q) * (1 / positives + 1 / texts) + 1e-12)
    lift = np.log((p + 0.5) / (positives + 1)) - np.log((u + 2.0) / (texts + 4))
    z[(p < 3) | (lift <= 0)] = 0
    best = np.argsort(-z, kind="stable")[:kept]
    best = np.sort(best[z[best] > 4])
    return best, lift[best]


def _low(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sigmoid_loss(z: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its gradient by z; bounded, so that single texts can't carry the corrected risk away."""
    s = _low(-label * z)
    return s, -label * s * (1 - s)


def logistic_loss(z: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
    return np.logaddexp(0, -label * z), -label * _low(-label * z)


def risk(xp: Sparse, xu: Sparse, w: np.ndarray, prior: float, loss) -> tuple[float, float, np.ndarray]:
    """The positive part, the corrected negative part (which may be below 0) and the direction to descend by: the gradient of
    their sum, or where the negative part is below 0, the way up it."""
    zp, zu = xp @ w, xu @ w
    (l1, gp), (l0, gn), (lu, gu) = loss(zp, 1), loss(zp, -1), loss(zu, -1)
    rest = float(lu.mean() - prior * l0.mean())
    up = xu.back(gu) / len(xu) - prior * xp.back(gn) / len(xp)
    return prior * float(l1.mean()), rest, prior * xp.back(gp) / len(xp) + up if rest >= 0 else -up


def descend(xp: Sparse, xu: Sparse, w: np.ndarray, prior: float, steps: int, rate: float, decay: float, loss) -> np.ndarray:
    """Adam on the non-negative positive-unlabelled risk."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = risk(xp, xu, w, prior, loss)[2] + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit_chunk(positive: list[bytes], unlabelled: list[bytes], lift: np.ndarray, prior: float, steps: int = 250, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> np.ndarray:
    """Weights, the intercept last. Texts: their features' numbers as uint16."""
    width, rng = len(lift), np.random.default_rng(seed)
    # Weights from about 7 of 10 texts; the scale of the scores from the others, whose fit they haven't seen.
    tp, tu = rng.random(len(positive)) < 0.7, rng.random(len(unlabelled)) < 0.7
    tp[:1], tu[:1] = True, True
    part = lambda texts, taken: Sparse.of([x for x, t in zip(texts, taken) if t], width)
    w = descend(part(positive, tp), part(unlabelled, tu), np.append(0.5 * lift, -2.0), prior, steps, rate, decay, sigmoid_loss)
    zp, zu = part(positive, ~tp) @ w, part(unlabelled, ~tu) @ w
    if len(zp) < 20 or len(zu) < 20:
        zp, zu = Sparse.of(positive, width) @ w, Sparse.of(unlabelled, width) @ w
    slope, shift = descend(Lone(zp), Lone(zu), np.array([1.0, 0.0]), prior, 600, 0.05, 1e-4, logistic_loss)
    slope = max(slope, 0.05)
    return np.append(slope * w[:-1], slope * w[-1] + shift)


def positive_names(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """names (array), a row a positive text."""
    toxic = labels.where(F.col("toxic") == 1).select("doc_id").distinct()
    # The ids alone are ordered; at most so many texts are then read.
    ids = toxic.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most)

    def run(parts):
        features = Features()
        for pdf in parts:
            yield pd.DataFrame({"names": [features.of(t) for t in pdf["text"]]})

    return docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text").mapInPandas(run, "names array<string>")


def unlabelled_counts(docs: DataFrame, names: list[str]) -> DataFrame:
    """at, u: how many texts hold the feature of that number. A task adds up its texts before anything is shuffled."""

    def run(parts):
        features, total = Features(names), np.zeros(len(names), np.int64)
        for pdf in parts:
            for text in pdf["text"]:
                total[list(features.found(text))] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at.astype(np.int32), "u": total[at]})

    return docs.select("text").mapInPandas(run, "at int, u long").groupBy("at").agg(F.sum("u").alias("u"))


def numbered(docs: DataFrame, names: list[str]) -> DataFrame:
    """f (binary): the numbers of a text's kept features."""

    def run(parts):
        features = Features(names)
        for pdf in parts:
            yield pd.DataFrame({"f": [np.array(features.of(t), "<u2").tobytes() for t in pdf["text"]]})

    return docs.select("text").mapInPandas(run, "f binary")


def dealt(rows: DataFrame, chunks: int) -> DataFrame:
    """rows (f) -> chunk, f, times: about equally many to each chunk, by content alone, so neither files nor partitions matter. Copies are counted
    first and then spread over the chunks, so a large group of them is split."""
    counted = rows.groupBy("f").agg(F.count("*").alias("c"))
    each = counted.select("f", "c", F.explode(F.sequence(F.lit(0), F.least(F.col("c"), F.lit(chunks)).cast("int") - 1)).alias("i"))
    times = F.floor(F.col("c") / chunks) + (F.col("i") < F.col("c") % chunks).cast("int")
    return each.select(F.pmod(F.xxhash64("f") + F.col("i"), F.lit(chunks)).cast("int").alias("chunk"), "f", times.cast("int").alias("times"))


def fit(rows: DataFrame, chunks: int, positive: list[bytes], lift: np.ndarray, prior: float) -> np.ndarray:
    """The mean of the chunks' weights. They are added up as whole billionths, so the order of chunks doesn't matter."""

    def run(parts):
        held = sorted(b for pdf in parts for b, times in zip(pdf["f"], pdf["times"]) for _ in range(times))
        if held:
            w = fit_chunk(positive, held, lift, prior)
            yield pd.DataFrame({"at": np.arange(len(w), dtype=np.int32), "w": np.round(w * 1e9).astype(np.int64) * len(held), "n": np.full(len(w), len(held))})

    got = dealt(rows, chunks).repartitionById(chunks, F.col("chunk")).mapInPandas(run, "at int, w long, n long").groupBy("at").agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("w"), F.sum("n").alias("n")).collect()
    return np.array([float(r["w"]) / r["n"] / 1e9 for r in sorted(got)])


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, chunk: int = CHUNK, kept: int = KEPT) -> Model:
    """Fits to docs (doc_id, text) and labels (doc_id, toxic), both without what is held out."""
    docs, labels = doc_columns(docs, "doc_id", "text"), doc_columns(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull())
    n = labels.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    if not n["p"]:
        return Model()
    found = written(positive_names(docs, labels, positives), "positives")
    known = found.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("p")).where("p >= 3").toArrow().sort_by("name")
    names, p, count, texts = known["name"].to_pylist(), known["p"].to_numpy(), found.count(), docs.count()
    u = np.zeros(len(names), np.int64)
    held = unlabelled_counts(docs, names).toArrow()
    u[held["at"].to_numpy()] = held["u"].to_numpy()
    best, lift = choose(p, u, max(count, 1), max(texts, 1), kept)
    if not len(best):
        discard(found)
        return Model()
    names = [names[i] for i in best]
    at = {name: i for i, name in enumerate(names)}
    listed = F.filter("names", lambda x: x.isin(names))
    positive = sorted(np.array([at[x] for x in r["f"]], "<u2").tobytes() for r in found.select(listed.alias("f")).collect())
    rows = written(numbered(docs, names), "numbered")
    w = fit(rows, max(1, texts // chunk), positive, lift, n["p"] / n["n"])
    discard(found, rows)
    return Model(names, w[:-1], float(w[-1]))


def score(text: Column, model: Model) -> Column:
    """struct(score: between 0 and 1, higher: likelier toxic; known: how many kept features the text has)."""

    @F.pandas_udf("score double, known int")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features(model.names)
        for texts in parts:
            found = [features.of(t) for t in texts]
            z = np.array([model.intercept + model.weights[f].sum() if f else model.intercept for f in found], float)
            yield pd.DataFrame({"score": _low(z), "known": np.array([len(f) for f in found], np.int32)})

    return of(F.coalesce(text, F.lit("")))


def judge(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; nothing of a held-out row is learnt from."""
    docs = doc_columns(docs, "doc_id", "text")
    model = learn(docs.where(~held_out(F.col("doc_id"), mod, rest)), labels.where(~held_out(labels["doc_id"], mod, rest)), **sizes)
    return docs.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), score(F.col("text"), model).getField("score").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark, docs, sf_dir):
    """The documents not found toxic, with their columns as they are. Learns as the query does, from what is not held out."""
    labels = table(spark, sf_dir, "labels")
    model = learn(docs.where(~held_out(docs["doc_id"])), labels.where(~held_out(F.col("doc_id"))))
    own = spare(docs, "_judged")
    return docs.withColumn(own, score(docs["text"], model)).where((F.col(own)["score"] < THRESHOLD) | (F.col(own)["known"] == 0)).select(*docs.columns)
