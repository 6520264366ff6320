"""Key-value state on append-only tables: latest or first per key, hits, misses, merges."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables, their columns and keys; ``replace`` keeps the latest write of a key, ``ignore`` the first.
TABLES = {
    "responses": ("key string, value string", ("key",), "replace"),
    "captions": ("hash string, value string", ("hash",), "replace"),
    "glossary": ("scope string, term string, rendering string", ("scope", "term"), "ignore"),
    "selections": ("key string, value string", ("key",), "replace"),
    "chunks": ("scope string, idx int, part int, value string", ("scope", "idx", "part"), "replace"),
    "chapters": ("scope string, idx int, value string", ("scope", "idx"), "replace"),
}
#: Of these, reads give nothing and writes are dropped while reuse is off.
GATED = frozenset(("responses", "chunks", "chapters"))


def latest(log: DataFrame, key: list[str], sequence: str, *values: str) -> DataFrame:
    """Last write of each key; partial aggregation, so hot keys shrink before the shuffle."""
    return log.groupBy(*key).agg(*(F.max_by(v, sequence).alias(v) for v in values))


def first(log: DataFrame, key: list[str], sequence: str, *values: str) -> DataFrame:
    """First write of each key."""
    return log.groupBy(*key).agg(*(F.min_by(v, sequence).alias(v) for v in values))


def so_far(log: DataFrame, key: list[str], sequence: str, value: str) -> DataFrame:
    """``log`` with the value that the first write of each row's key had, which is the first so far at any time."""
    known = first(log, key, sequence, value).select(*(F.col(k).alias(f"_{k}") for k in key), F.col(value).alias("_first"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return log.join(known, same).withColumn(value, F.col("_first")).drop("_first", *(f"_{k}" for k in key))


def hits(requests: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    """Requests with what the store has for them; an empty value is a hit."""
    return requests.join(store, key, "left")


def pending(requests: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    """Requests that the store has nothing for."""
    return requests.join(store.select(*key), key, "left_anti")


def conflicts(new: DataFrame, existing: DataFrame, term: str = "term", rendering: str = "rendering") -> DataFrame:
    """New terms that exist with another rendering."""
    old = existing.select(F.col(term), F.col(rendering).alias("existing"))
    return new.join(old, term).where(F.col(rendering) != F.col("existing"))


class StateStore:
    """State tables under one shared folder: versions of Parquet deltas and snapshots, resolved by key when read.

    A write puts its rows beside the table, claims the next version by creating a file that no other writer can create
    too, and publishes the rows by a rename; where another writer was faster it claims the one after.  A version's
    rows are numbered by the caller's ``sequence`` and, where that is equal or missing, by their values; so of two
    writes of one key the winner is defined by (version, sequence, values), whatever the clocks.  A write that runs
    again with the token of one that was published does nothing.  Reads are of a version, by default of the latest.
    """

    def __init__(self, spark: SparkSession, folder: str, enabled: bool = True) -> None:
        self.spark, self.folder, self.enabled = spark, folder.rstrip("/"), enabled

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[tuple[int, str, str]]:
        """Published versions: number, kind (delta or snapshot) and token, in order."""
        files, at = self._files(), self._path(name, "published")
        if not files.exists(at):
            return []
        found = [f.getPath().getName().split("-", 2) for f in files.listStatus(at)]
        return sorted((int(n), kind, token) for n, kind, token in found)

    def write(self, name: str, rows: DataFrame, sequence: Column | None = None, token: str | None = None) -> int | None:
        """Publishes the rows as the next version and gives its number; None where nothing was written."""
        if not self.enabled and name in GATED:
            return None
        schema, _, _ = TABLES[name]
        columns = [c.split()[0] for c in schema.split(", ")]
        numbered = rows.select(*columns, (F.lit(None) if sequence is None else sequence).cast("bigint").alias("seq"))
        return self._publish(name, numbered, "delta", token)

    def compact(self, name: str, to: str | None = None) -> int | None:
        """Publishes what the latest version resolves to as a snapshot, from which later reads start; or writes it to
        the store at another folder."""
        latest_one = max((v for v, _, _ in self.versions(name)), default=0)
        rows = self.read(name, latest_one).withColumn("seq", F.lit(None).cast("bigint"))
        if to is not None:
            return StateStore(self.spark, to)._publish(name, rows, "delta", None)
        return self._publish(name, rows, "snapshot", None, latest_one) if latest_one else None

    def _publish(self, name: str, rows: DataFrame, kind: str, token: str | None, of: int | None = None) -> int | None:
        token = re.sub(r"[^A-Za-z0-9_.]", "_", token) if token else uuid.uuid4().hex
        if any(t == token for _, _, t in self.versions(name)):
            return None
        files, staged = self._files(), self._path(name, "staged", uuid.uuid4().hex)
        rows.write.parquet(staged.toString())
        while True:
            taken = self.versions(name)
            if any(t == token for _, _, t in taken) or of is not None and taken[-1][0] != of:
                files.delete(staged, True)  # the same write was published meanwhile, or others after what is compacted
                return None
            n = max([v for v, _, _ in taken] + [int(f.getPath().getName()) for f in self._listed(name, "claims")], default=0) + 1
            if self._claimed(files, self._path(name, "claims", str(n))):
                break
        files.mkdirs(self._path(name, "published"))
        if not files.rename(staged, self._path(name, "published", f"{n:012d}-{kind}-{token}")):
            raise OSError(f"version {n} of {name} could not be published")
        return n

    def _listed(self, *parts: str):
        files, at = self._files(), self._path(*parts)
        return [f for f in files.listStatus(at) if not f.getPath().getName().startswith(".")] if files.exists(at) else []

    @staticmethod
    def _claimed(files, path) -> bool:
        """Whether this writer created the file; of several that try, one does."""
        from py4j.protocol import Py4JJavaError

        files.mkdirs(path.getParent())
        try:
            files.create(path, False).close()
        except Py4JJavaError as e:
            if files.exists(path):
                return False
            raise OSError(str(path)) from e
        return True

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as of a version: a row a key."""
        schema, key, rule = TABLES[name]
        empty = self.spark.createDataFrame([], schema)
        known = [x for x in self.versions(name) if version is None or x[0] <= version]
        if not known or not self.enabled and name in GATED:
            return empty
        snapshots = [n for n, kind, _ in known if kind == "snapshot"]
        values = [c for c in empty.columns if c not in key]
        log = None
        for n, kind, token in known:
            if not snapshots or n >= snapshots[-1]:
                part = self.spark.read.schema(f"{schema}, seq bigint").parquet(self._path(name, "published", f"{n:012d}-{kind}-{token}").toString())
                part = part.withColumn("_order", F.struct(F.lit(n).alias("version"), F.col("seq"), *values))
                log = part if log is None else log.unionByName(part)
        return (latest if rule == "replace" else first)(log, list(key), "_order", *values)
