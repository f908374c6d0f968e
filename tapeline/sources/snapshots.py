"""Stored tables that change atomically: immutable data files and numbered manifests.

A manifest names, for every partition value, the folders that hold its rows. A writer puts new
files beside the old ones and publishes the next manifest under a name that only one writer can
take; readers resolve the newest manifest, so they see the table before or after a change, never
between. A writer that dies before publishing leaves files that no manifest names. A writer that
loses the name starts over on the winner's table, or, where the winner changed other partitions
only, publishes again without computing anew.

Manifests and partition values pass through the driver; their number is bounded by the table's
partitions, which are expected to be calendar periods or buckets. Rows never do.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A change may touch so many partitions; more are an error, as their names pass through the driver.
MOST_PARTITIONS = 100_000
#: Attempts to publish against other writers.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Manifest:
    """Folders by partition value, and the last change of every numbered feed that the table holds."""

    version: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class SnapshotTable:
    """A table at ``path`` with rows of ``schema``, partitioned by the text of one column."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, partition: str):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{self.path}/manifests"))

    # -- manifests ------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        version = (self.versions() or [0])[-1] if version is None else version
        if not version:
            return Manifest()
        file = self._fs.open(self._at(self._name(version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()
        return Manifest(**json.loads(text))

    def _name(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def publish(self, manifest: Manifest) -> None:
        """Writes the manifest aside and gives it its name, which only the first writer gets."""
        aside = f"{self.path}/manifests/_{uuid.uuid4().hex}"
        out = self._fs.create(self._at(aside), False)
        out.write(bytearray(json.dumps(vars(manifest)).encode()))
        out.close()
        name = self._name(manifest.version)
        try:
            if self._fs.getScheme() == "file":  # a local rename would replace the other writer's file, a link doesn't
                local = lambda p: self._at(p).toUri().getPath()
                os.link(local(aside), local(name))
            else:
                jvm = self.spark._jvm
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._at(aside), self._at(name), none)
        except Exception as e:
            if self._fs.exists(self._at(name)):
                raise Conflict(name) from e
            raise
        finally:
            self._fs.delete(self._at(aside), False)

    # -- reading --------------------------------------------------------------------------------

    def read(self, partitions: list[str] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The newest table, or some partitions of it; only their folders are listed."""
        m = manifest or self.manifest()
        folders = [f"{self.path}/{f}" for p in (m.parts if partitions is None else partitions) for f in m.parts.get(p, ())]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    # -- changes --------------------------------------------------------------------------------

    def _values(self, rows: DataFrame) -> list[str]:
        found = rows.select(F.coalesce(F.col(self.partition).cast("string"), F.lit("")).alias("p")).distinct().limit(MOST_PARTITIONS + 1)
        values = sorted(r.p for r in found.toLocalIterator())
        if len(values) > MOST_PARTITIONS:
            raise ValueError(f"a change of more than {MOST_PARTITIONS} partitions")
        return values

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        folder = f"data/{uuid.uuid4().hex}"
        names = [f.name for f in self.schema.fields]
        rows.select(*names, F.coalesce(F.col(self.partition).cast("string"), F.lit("")).alias("_part")).write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        parts = {}
        for s in self._fs.listStatus(self._at(f"{self.path}/{folder}")):
            name = s.getPath().getName()
            if name.startswith("_part="):
                value = unquote(name.removeprefix("_part="))
                parts["" if value == "__HIVE_DEFAULT_PARTITION__" else value] = [f"{folder}/{name}"]
        return parts

    def _commit(self, base: Manifest, change: Callable[[Manifest], dict[str, list[str]]], touched: set[str], feed: tuple[str, int] | None) -> Manifest:
        """Publishes ``change`` on ``base``, or on newer manifests that leave the touched partitions as they were in it."""
        now = base
        for _ in range(ATTEMPTS):
            if any(now.parts.get(p) != base.parts.get(p) for p in touched):
                raise Conflict(f"{self.path}: partitions changed since version {base.version}")
            if feed and now.applied.get(feed[0], -1) >= feed[1]:
                return now
            new = Manifest(now.version + 1, {p: f for p, f in change(now).items() if f}, {**now.applied, **({feed[0]: feed[1]} if feed else {})})
            try:
                self.publish(new)
                return new
            except Conflict:
                now = self.manifest()
        raise Conflict(f"{self.path}: no version published in {ATTEMPTS} attempts")

    def append(self, rows: DataFrame, feed: tuple[str, int] | None = None) -> Manifest:
        """Adds rows; nothing stored is read. A feed's change that the table already holds is passed over."""
        base = self.manifest()
        if feed and base.applied.get(feed[0], -1) >= feed[1]:
            return base
        new = self._write(rows)
        return self._commit(base, lambda m: {**m.parts, **{p: m.parts.get(p, []) + f for p, f in new.items()}}, set(), feed)

    def upsert(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], feed: tuple[str, int] | None = None) -> Manifest:
        """Replaces the partitions that incoming rows lie in by ``merge(stored, incoming)``; no other partition is read or written.

        The merged rows have to stay in these partitions.
        """
        touched = self._values(incoming)
        for _ in range(ATTEMPTS):
            base = self.manifest()
            if feed and base.applied.get(feed[0], -1) >= feed[1]:
                return base
            new = self._write(merge(self.read(touched, base), incoming))
            if not set(new) <= set(touched):
                raise ValueError(f"merged rows lie in partitions without incoming rows: {sorted(set(new) - set(touched))[:5]}")
            try:
                return self._commit(base, lambda m: {**m.parts, **{p: new.get(p, []) for p in touched}}, set(touched), feed)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: not merged in {ATTEMPTS} attempts")

    def compact(self, merge: Callable[[DataFrame], DataFrame], most: int = 8) -> Manifest:
        """Brings partitions of more than ``most`` folders back to one, their rows passed through ``merge``."""
        base = self.manifest()
        many = [p for p, f in base.parts.items() if len(f) > most]
        if not many:
            return base
        new = self._write(merge(self.read(many, base)))
        return self._commit(base, lambda m: {**m.parts, **{p: new.get(p, []) for p in many}}, set(many), None)

    def forget(self, stale: Callable[[str], bool]) -> Manifest:
        """Takes partitions whose value is stale out of the table."""
        base = self.manifest()
        gone = {p for p in base.parts if stale(p)}
        return self._commit(base, lambda m: {p: f for p, f in m.parts.items() if p not in gone}, gone, None) if gone else base

    def sweep(self, keep: int = 10, older_than: float = 3600.0) -> int:
        """Deletes all but the newest manifests, and data folders that none of these names.

        Folders younger than ``older_than`` seconds stay: their writer may still publish them.
        Returns how many folders went.
        """
        versions = self.versions()
        kept = versions[-keep:]
        named = {f.rsplit("/", 1)[0] for v in kept for fs in self.manifest(v).parts.values() for f in fs}
        for v in versions[:-keep]:
            self._fs.delete(self._at(self._name(v)), False)
        data = self._at(f"{self.path}/data")
        gone = 0
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f"data/{s.getPath().getName()}" not in named and s.getModificationTime() / 1000 < time.time() - older_than:
                gone += self._fs.delete(s.getPath(), True)
        return gone


def newest(columns: list[str], keys: list[str], load: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Merge of stored and incoming rows: the row of the latest load stays, in whatever order loads arrive."""
    rest = [c for c in columns if c not in keys]

    def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
        both = stored.select(*columns).unionByName(incoming.select(*columns))
        return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(load, F.xxhash64(*rest))).alias("r")).select(*keys, "r.*").select(*columns)

    return merge
