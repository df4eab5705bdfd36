"""Centroid clustering by sort-means, in whole numbers, so results depend neither on partitions nor on the order of sums.

A round: the other centroids of each centroid are sorted by their distance from it; a vector is scanned from its centroid of the
round before, along that order, and the scan stops at the first centroid strictly beyond twice the vector's current distance, as by the
triangle inequality none from there on can be as near. Then each centroid is replaced by the floor of its vectors' mean.

The vectors lie in a table of the shared folder with their cluster; a round reads it, writes the next and drops the one before, so a
lost executor costs tasks, never a round. Sums are made by Spark, with partial sums in each task; only the centroids (k of them) come to
the driver. Rounds after one that changes no centroid would repeat it, so they are left out.

Defined cases: vectors of another length, or with null, NaN or infinite components, are not kept; nor are null vectors. Rows with equal or null
vec_id are vectors of their own, a null id counts as '' in the choice of the first centroids, ties there go by the vector's components. With fewer
vectors than centroids there are as many centroids as vectors. A vector with a scaled component outside -2**27 to 2**27 has no
squared distance that a long holds: it is returned with null cluster, distance and sums and takes no part. Sums of distances beyond a long are null.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, table, written

WIDTH, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Components up to here have squared distances (of 64 components) that a signed 64-bit number holds.
MOST = 2**27


def scaled(embeddings: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long: floor(scale * component)), fits: the vectors that are kept."""
    e = F.col("e")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(e, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("e"))
    kept = rows.where(F.size("e") == width).where(finite)
    return kept.select("vec_id", whole.alias("v"), F.forall(e, lambda x: F.abs(x * F.lit(float(scale))) < F.lit(float(MOST))).alias("fits"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of smallest hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in vectors.orderBy(digest, "v").select("v").limit(k).collect()], np.int64)


def scan(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of each row of x, from its centroid before."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    k = len(centroids)
    order = np.argsort(between, axis=1, kind="stable")
    others = np.array([[c for c in order[a] if c != a] for a in range(k)], np.int64).reshape(k, k - 1)
    current = ((x - centroids[before]) ** 2).sum(axis=1)
    best, least = before.copy(), current.copy()
    live = np.arange(len(x))
    for step in range(k - 1):
        a = before[live]
        c = others[a, step]
        live_on = between[a, c] <= 4 * current[live]  # twice the distance is four times its square
        live, c = live[live_on], c[live_on]
        if not len(live):
            break
        d = ((x[live] - centroids[c]) ** 2).sum(axis=1)
        nearer = (d < least[live]) | (d == least[live]) & (c < best[live])
        best[live[nearer]], least[live[nearer]] = c[nearer], d[nearer]
    return best, least


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (vec_id, v, cluster) with the cluster and the distance of this round."""

    def run(parts):
        for pdf in parts:
            if len(pdf):
                best, least = scan(np.stack(pdf["v"].to_list()).astype(np.int64), pdf["cluster"].to_numpy(np.int64), centroids)
                yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64"), "v": pdf["v"], "cluster": best.astype(np.int32), "distance": least})

    return vectors.select("vec_id", "v", "cluster").mapInPandas(run, "vec_id long, v array<long>, cluster int, distance long")


def means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of each cluster's vectors; a cluster without any keeps its centroid. At most k rows come back."""
    width = centroids.shape[1]
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)]
    out = centroids.copy()
    for r in vectors.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def sort_means(vectors: DataFrame, starts: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """A written table vec_id, v, cluster, distance after the rounds and a last assignment, and the centroids it belongs to."""
    centroids, now, last = starts, written(vectors.select("vec_id", "v", F.lit(0).alias("cluster")), "vectors"), None
    for _ in range(rounds):
        now, last = written(assigned(now, centroids), "assigned"), now
        discard(last)
        moved = means(now, centroids)
        if (moved == centroids).all():
            return now, centroids
        centroids = moved
    now, last = written(assigned(now, centroids), "assigned"), now
    discard(last)
    return now, centroids


def clusters(embeddings: DataFrame, width: int = WIDTH, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    kept = scaled(embeddings, width, scale)
    fit = kept.where("fits")
    starts = first_centroids(fit, k, seed)
    none = kept.where("NOT fits").select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    if not len(starts):
        return none
    found, centroids = sort_means(fit, starts, rounds)
    totals = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.select("vec_id", "cluster", "distance", _of([_long(totals.get(c)) for c in range(len(centroids))], "bigint").alias("cluster_inertia"), F.lit(_long(sum(totals.values()))).cast("long").alias("inertia"), _of(hashes, "string").alias("centroid_sha256")).unionByName(none)


def _long(n: int | None) -> int | None:
    return n if n is not None and n < 2**63 else None


def _of(values: list, kind: str) -> Column:
    """The entry of a short list at the row's cluster."""
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster"))


def query(spark, sf_dir):
    return clusters(table(spark, sf_dir, "embeddings"))
