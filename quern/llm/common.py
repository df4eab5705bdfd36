"""Shared helpers of the training-data operators: tables, the shared folder, words, and ordered buckets."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space as the words of every operator here see it: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a new temporary folder in local mode; on a
    cluster an error, as each machine would write to a disk of its own and read nothing back."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: cuts the lineage, survives lost executors, is read as often as needed."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.__dict__.pop("_written_to"))


#: Tables of at most so many rows (a few numbers each) are broadcast; larger ones are joined by salted keys.
SMALL_TABLE, SALTS = 20_000, 32


def meet(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their groups' columns (an inner join). groups: a written table with few rows a key. Broadcast if it is small;
    else every group is repeated SALTS times and rows are dealt to these by hash, so a hot group is split."""
    if groups.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE:
        return rows.join(F.broadcast(groups), keys)
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*(c for c in rows.columns if c not in keys)), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) UTF-8 words; bytes.split() cuts at exactly the white space of WORD."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public SplitMix64 one) over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of all windows of k words, in order and with repeats; of fewer words, one hash of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k, n = min(k, len(h)), max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15 + k), np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + h[i : i + n])
    return out


def range_bounds(df: DataFrame, key: str, parts: int) -> np.ndarray:
    """At most parts - 1 cut points of an integer key, about equally many rows between two. One aggregate over one column."""
    if parts < 2:
        return np.empty(0, np.int64)
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(F.col(key).cast("long"), at, max(1000, 10 * parts)).alias("b")).first()["b"]
    return np.unique(np.asarray(got or [], dtype=np.int64))


def range_bucket(key: Column, bounds: np.ndarray) -> Column:
    """The number of cut points below the key (binary search), so buckets are in the key's order; null: 0."""

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), side="left").astype(np.int32))

    return bucket(F.coalesce(key.cast("long"), F.lit(-(2**63))))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_columns(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that further columns of the input can't clash with what an operator adds."""
    return df.select(*(df[n] for n in names))


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name
