"""A table of mergeable parts with a log of versions: every write happens once, readers see whole versions, and old parts go.

Below a path lie ``parts`` (Parquet folders) and ``log`` (a small JSON a version: the parts that make it, and the last batch in it). A version counts once its
log entry is there, which a rename puts there or not; parts that no entry names are left-overs of a failure and go with the next write. Parts have a level: as soon
as ``fan`` parts are of one level they are merged into one of the next, so a reader meets at most ``fan - 1`` parts a level, of which there are as many as the
logarithm of the batches, and a row is written again once a level. One writer at a time, as a streaming query is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


class MergedParts:
    """merge(rows): the rows of several parts made one, in any order and any number of times the same. keep: versions that a slow reader may still read."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], fan: int = 8, keep: int = 2):
        if fan < 2 or keep < 1:
            raise ValueError("fan must be 2 at least, keep 1")
        self.spark, self.path, self.schema, self.merge, self.fan, self.keep = spark, path.rstrip("/"), schema, merge, fan, keep

    # the log

    def _hadoop(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _listed(self, folder: str) -> list[str]:
        files, at = self._hadoop(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._listed("log") if n.endswith(".json") and not n.startswith((".", "_")))

    def entry(self, version: int | None = None) -> dict:
        """parts (name -> level) and batch of a version; of the newest, if none is given; nothing before the first."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": -1, "batch": -1, "parts": {}}
            version = known[-1]
        files, at = self._hadoop(f"{self.path}/log/{version:012d}.json")
        stream = files.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, entry: dict) -> None:
        files, to = self._hadoop(f"{self.path}/log/{entry['version']:012d}.json")
        _, draft = self._hadoop(f"{self.path}/log/.{uuid.uuid4().hex}.draft")
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        if files.exists(to) or not files.rename(draft, to):
            files.delete(draft, False)
            raise RuntimeError(f"another writer has made version {entry['version']} of {self.path}")

    # reading and writing

    def read(self, version: int | None = None) -> DataFrame:
        """The merged rows of a version (the newest)."""
        parts = self.entry(version)["parts"]
        rows = self.spark.read.schema(self.schema)
        if not parts:
            return self.merge(self.spark.createDataFrame([], self.schema))
        return self.merge(rows.parquet(*(f"{self.path}/parts/{p}" for p in sorted(parts))))

    def _write(self, rows: DataFrame, level: int) -> tuple[str, int]:
        name = f"l{level}-{uuid.uuid4().hex}"
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.path}/parts/{name}")
        return name, level

    def put(self, rows: DataFrame, batch: int) -> bool:
        """Adds a batch, unless it or a later one is in already (a batch that comes again after a failure). Whether it was added."""
        last = self.entry()
        if batch <= last["batch"]:
            return False
        parts = dict(last["parts"])
        parts.update([self._write(rows, 0)])
        while full := [level for level in set(parts.values()) if sum(x == level for x in parts.values()) >= self.fan]:
            level = min(full)
            old = [p for p, x in parts.items() if x == level]
            merged = self.merge(self.spark.read.schema(self.schema).parquet(*(f"{self.path}/parts/{p}" for p in old)))
            parts = {p: x for p, x in parts.items() if p not in old} | dict([self._write(merged, level + 1)])
        self._commit({"version": last["version"] + 1, "batch": batch, "parts": parts})
        self.vacuum()
        return True

    def vacuum(self) -> None:
        """Deletes old versions and all parts that none of the kept ones names."""
        kept = self.versions()[-self.keep :]
        named = reduce(set.union, (set(self.entry(v)["parts"]) for v in kept), set())
        for name in self._listed("parts"):
            if name not in named:
                files, at = self._hadoop(f"{self.path}/parts/{name}")
                files.delete(at, True)
        for v in self.versions():
            if v not in kept:
                files, at = self._hadoop(f"{self.path}/log/{v:012d}.json")
                files.delete(at, False)
