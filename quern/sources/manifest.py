"""A sorted JSON-lines manifest whose bytes depend on its rows alone: not on partitions, files, the session or the time.

Rows are in the order of the given columns, ties in that of their JSON. A row begins a new part if its own hash says so (about one in ``size`` does), so the same
rows are cut at the same places, however they lie, and a changed row changes the parts next to it only. The cutting rows, of which there are as few as parts, tell each
row its part; a part is sorted and written by one task of a data source, under a name that counts once the job is committed. ``_manifest.json`` lists the parts
with their digests, and a digest of that list.

Defined cases: an empty table has one empty part list. Null columns are left out of a line, and sort first. Repeated rows are repeated lines, all in one part. Not
a number sorts last.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT, SIZE = "quern_manifest", 500_000
#: Cutting rows on the driver at most; a table that would need more wants a larger size.
MOST_PARTS = 200_000


@dataclass
class _Written(WriterCommitMessage):
    parts: list  # (number, draft's name, rows, bytes, sha256)


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Writer(DataSourceWriter):
    """Rows (part, line), sorted within a partition that has whole parts."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, rows):
        store, path = _place(self.path)
        store.create_dir(f"{path}/_drafts", recursive=True)
        done, now, out, name, lines, size, digest = [], None, None, "", 0, 0, None
        for row in rows:
            if row["part"] != now:
                if out is not None:
                    out.close()
                    done.append((now, name, lines, size, digest.hexdigest()))
                now, name, lines, size, digest = row["part"], uuid.uuid4().hex, 0, 0, hashlib.sha256()
                out = store.open_output_stream(f"{path}/_drafts/{name}", compression=None)
            line = row["line"].encode() + b"\n"
            out.write(line)
            digest.update(line)
            lines, size = lines + 1, size + len(line)
        if out is not None:
            out.close()
            done.append((now, name, lines, size, digest.hexdigest()))
        return _Written(done)

    def commit(self, messages) -> None:
        """Names the drafts that count, lists them, and removes the rest: an earlier manifest, and drafts of tasks that were run again."""
        from pyarrow import fs

        store, path = _place(self.path)
        parts = sorted(p for m in messages if m is not None for p in m.parts)
        keep = {"_manifest.json"}
        listed = []
        for number, name, lines, size, digest in parts:
            file = f"part-{number:06d}.jsonl"
            keep.add(file)
            if store.get_file_info(f"{path}/{file}").type != fs.FileType.NotFound:
                store.delete_file(f"{path}/{file}")
            store.move(f"{path}/_drafts/{name}", f"{path}/{file}")
            listed.append({"file": file, "rows": lines, "bytes": size, "sha256": digest})
        whole = hashlib.sha256("".join(f"{p['sha256']}  {p['file']}\n" for p in listed).encode()).hexdigest()
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/_manifest.json", compression=None) as f:
            f.write(json.dumps({"parts": listed, "rows": sum(p["rows"] for p in listed), "sha256": whole}, indent=1, sort_keys=True).encode() + b"\n")
        for found in store.get_file_info(fs.FileSelector(path)):
            if found.base_name == "_drafts":
                store.delete_dir(found.path)
            elif found.base_name not in keep and found.base_name.startswith("part-"):
                store.delete_file(found.path)

    def abort(self, messages) -> None:
        store, path = _place(self.path)
        for m in messages:
            for _, name, *_ in m.parts if m is not None else []:
                store.delete_file(f"{path}/_drafts/{name}")


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "part int, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("a manifest is written whole: use mode('overwrite')")
        return _Writer(self.options["path"])


def _rank(value):
    """Spark's order of a value: nulls first; text by code points, as by its UTF-8."""
    return (0,) if value is None else (1, value)


def numbered_lines(rows: DataFrame, order: list[str], size: int = SIZE) -> DataFrame:
    """part, line and the order columns (_0, _1, ...): each row's JSON and the part that it is in."""
    columns = []
    for c in order:
        if rows.schema[c].dataType.typeName() in ("float", "double"):  # not a number is last, and no value to compare
            columns += [F.coalesce(F.isnan(c), F.lit(False)), F.when(~F.isnan(c), F.col(c))]
        else:
            columns.append(F.col(c))
    keys = [f"_{i}" for i in range(len(columns))]
    lines = rows.select(*(c.alias(k) for c, k in zip(columns, keys)), F.to_json(F.struct(*rows.columns)).alias("line"))
    cutting = lines.where(F.pmod(F.xxhash64("line"), F.lit(size)) == 0).distinct()
    found = cutting.limit(MOST_PARTS + 1).collect()
    if len(found) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts: give a larger size")
    cuts = sorted(tuple(_rank(v) for v in r) for r in found)

    @F.pandas_udf("int")
    def part(whole: pd.DataFrame) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, tuple(_rank(v) for v in r)) for r in whole.astype(object).where(whole.notna(), None).itertuples(index=False)], dtype="int32")

    return lines.withColumn("part", part(F.struct(*keys, "line")) if cuts else F.lit(0))


def write_manifest(rows: DataFrame, path: str, order: list[str], size: int = SIZE) -> None:
    """Writes rows as a manifest to a folder that the driver and all executors share, over what is there."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(ManifestSource)
    lines = numbered_lines(rows, order, size)
    keys = [c for c in lines.columns if c not in ("part", "line")]
    lines.repartition("part").sortWithinPartitions("part", *keys, "line").select("part", "line").write.format(FORMAT).mode("overwrite").save(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The list of parts that a manifest's last commit wrote."""
    store, at = _place(path.rstrip("/"))
    with store.open_input_stream(f"{at}/_manifest.json") as f:
        return json.loads(f.read())
