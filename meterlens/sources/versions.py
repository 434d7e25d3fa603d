"""Marts as versions: immutable day folders, and a manifest that names the current ones.

A writer puts new day folders beside the old ones and then adds one manifest file, so a
reader sees the whole old or the whole new mart, and an aborted run changes nothing.
The manifest also holds row counts and sums per day: how fresh a mart is and whether
it has a total is known without a job.  Files are reached through Hadoop's file system,
so a mart may lie in any store that Spark writes to.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "usage_date"
MANIFESTS, DATA = "_manifests", "data"
#: What a version that no reader can still be using must exceed to be removed, in versions and in seconds.
KEPT_VERSIONS, KEPT_SECONDS = 2, 24 * 3600


class Conflict(RuntimeError):
    """Another writer has added a version since this one was read."""


@dataclass
class Manifest:
    """One version: ``days`` of each table map a day to the write that holds it, its rows and its sums."""
    number: int = 0
    days: dict[str, dict[str, dict]] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)

    def of(self, table: str, start: str | None = None, end: str | None = None) -> dict[str, dict]:
        return {d: x for d, x in self.days.get(table, {}).items() if (start is None or d >= start) and (end is None or d <= end)}

    def rows(self, table: str, start: str | None = None, end: str | None = None) -> int:
        return sum(x["rows"] for x in self.of(table, start, end).values())

    def total(self, table: str, column: str, start: str | None = None, end: str | None = None) -> float:
        return sum(x["sums"].get(column) or 0 for x in self.of(table, start, end).values())


class Store:
    """The versions under one folder.  Tables of one store change together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(MANIFESTS) if n.endswith(".json")]

    def _read(self, number: int) -> Manifest:
        stream = self._fs.open(self._path(f"{self.root}/{MANIFESTS}/{number:012d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def current(self) -> Manifest | None:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else None

    def open(self, table: str, start: str | None = None, end: str | None = None, manifest: Manifest | None = None) -> DataFrame | None:
        """A table of the current (or given) version; only the folders of the days asked for are listed."""
        manifest = manifest or self.current()
        if manifest is None or table not in manifest.days:
            return None
        if not (known := manifest.of(table)):
            return None
        folders: dict[str, list[str]] = {}
        for day, x in (manifest.of(table, start, end) or dict(list(known.items())[:1])).items():
            folders.setdefault(x["write"], []).append(f"{self.root}/{DATA}/{x['write']}/{table}/{DAY}={day}")
        parts = [self.spark.read.option("basePath", f"{self.root}/{DATA}/{write}/{table}").parquet(*paths) for write, paths in folders.items()]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return out if manifest.of(table, start, end) else out.limit(0)

    def stage(self, frames: dict[str, DataFrame], sums: dict[str, list[str]] | None = None) -> dict[str, dict[str, dict]]:
        """Write day folders that no version names yet; what a manifest needs to know of them.

        Rebalancing by day gives a small day one file and splits a large one over several tasks.
        """
        write, out = f"{time.time_ns():020d}-{uuid.uuid4().hex}", {}
        for table, df in frames.items():
            path = f"{self.root}/{DATA}/{write}/{table}"
            df.filter(F.col(DAY).isNotNull()).hint("rebalance", DAY).write.partitionBy(DAY).parquet(path)
            names = [n.removeprefix(f"{DAY}=") for n in self._names(f"{DATA}/{write}/{table}") if n.startswith(f"{DAY}=")]
            if not names:
                self._fs.delete(self._path(path), True)
            out[table] = {}
            if names:
                added = [F.sum(F.col(c).cast("double")).alias(c) for c in (sums or {}).get(table, [])]
                counted = self.spark.read.parquet(path).groupBy(F.col(DAY).cast("string").alias("d")).agg(F.count("*").alias("n"), *added)
                out[table] = {r["d"]: {"write": write, "rows": r["n"], "sums": {k: v for k, v in r.asDict().items() if k not in ("d", "n")}}
                              for r in counted.collect()}  # one row per day written
        folder = self._path(f"{self.root}/{DATA}/{write}")
        if self._fs.exists(folder) and not any(out.values()):
            self._fs.delete(folder, True)
        return out

    def commit(self, base: Manifest | None, days: dict[str, dict[str, dict]], notes: dict[str, str] | None = None) -> Manifest:
        """Make ``days`` the next version after ``base``; a version added by somebody else meanwhile is a conflict."""
        manifest = Manifest((base.number if base else 0) + 1, days, notes or {})
        folder, name = f"{self.root}/{MANIFESTS}", f"{manifest.number:012d}.json"
        staged, target = self._path(f"{folder}/_{uuid.uuid4().hex}"), self._path(f"{folder}/{name}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            raise Conflict(f"version {manifest.number} of {self.root} exists")
        return manifest

    def replace(self, frames: dict[str, DataFrame], sums: dict[str, list[str]] | None = None, notes: dict[str, str] | None = None) -> Manifest:
        """A version that consists of ``frames`` only."""
        return self.commit(self.current(), self.stage(frames, sums), notes)

    def change(self, made: Callable[[Manifest], dict[str, DataFrame]], sums: dict[str, list[str]] | None = None,
               notes: dict[str, str] | None = None) -> Manifest:
        """A version in which the days of ``made(current)`` replace those of the same tables; other days stay as they are."""
        base = self.current() or Manifest()
        new = self.stage(made(base), sums)
        days = {table: base.days.get(table, {}) | new.get(table, {}) for table in {**base.days, **new}}
        return self.commit(base if base.number else None, days, base.notes | (notes or {}))

    def discard(self, staged: dict[str, dict[str, dict]]) -> None:
        """Remove a write that no version names."""
        for write in {x["write"] for days in staged.values() for x in days.values()}:
            self._fs.delete(self._path(f"{self.root}/{DATA}/{write}"), True)

    def clean(self, versions: int = KEPT_VERSIONS, seconds: int = KEPT_SECONDS) -> list[str]:
        """Remove writes that none of the last ``versions`` names: replaced days, and what aborted runs have left.

        Writes younger than ``seconds`` stay, since their run may still be going on.
        """
        numbers = self._numbers()
        named = {x["write"] for n in numbers[-versions:] for days in self._read(n).days.values() for x in days.values()}
        limit = time.time_ns() - int(seconds * 1e9)
        gone = [w for w in self._names(DATA) if w not in named and int(w.split("-")[0]) < limit]
        for write in gone:
            self._fs.delete(self._path(f"{self.root}/{DATA}/{write}"), True)
        for number in numbers[:-versions]:
            self._fs.delete(self._path(f"{self.root}/{MANIFESTS}/{number:012d}.json"), False)
        return gone
