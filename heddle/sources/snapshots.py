"""Versions of a set of tables: data files that are never changed, and a commit that makes a version visible at once.

A version is a manifest: for every table, the folder that holds each of its buckets. A writer adds folders for the buckets
it changes, writes a manifest that points at these and at the old ones, and commits by creating the file of the next
version, which fails if another writer was first. What a failed writer leaves is in no manifest. A reader opens one
version and keeps reading that one, whatever is committed meanwhile.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """One version. tables: name to {bucket: folder}; schemas: name to DDL; facts: what the writer noted."""

    spark: SparkSession
    version: int = 0
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)

    def table(self, name: str, buckets: list[int] | None = None, schema: str | None = None) -> DataFrame:
        """A table of this version, or some buckets of it; one that it lacks is empty, with the schema given."""
        held = self.tables.get(name, {})
        paths = [f"{folder}/bucket={b}" for b, folder in held.items() if buckets is None or int(b) in buckets]
        shape = self.schemas.get(name) or schema
        if shape is None:
            raise KeyError(f"no table {name} in version {self.version}")
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _put(self, name: str, text: str, only_if_new: bool) -> None:
        stream = self._fs.create(self._at(name), not only_if_new)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _get(self, name: str) -> str:
        lines = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()
        return lines[0].value if lines else ""

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self._names("commits") if n.startswith("v="))

    def open(self, version: int | None = None) -> Snapshot:
        """A version, by default the newest; version 0 has no tables. A commit that is being written does not count yet."""
        for v in reversed(self.versions()):
            if (version is None or v == version) and (manifest := self._get(f"commits/v={v}")):
                held = json.loads(self._get(f"manifests/{manifest}"))
                return Snapshot(self.spark, v, held["tables"], held["schemas"], held["facts"])
        if version:
            raise KeyError(f"there is no version {version}")
        return Snapshot(self.spark)

    def write(self, name: str, rows: DataFrame, key: str, files: int = 1) -> tuple[str, list[str], str]:
        """Write buckets of a table under a new folder: (folder, buckets in it, schema). Not visible before a commit.

        With ``files`` over one a bucket is cut by ranges of its key into about as many files, so that a bucket is not one
        task's; rows are in the order of the key, so that readers of a few keys skip the other files and row groups."""
        folder = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", bucket_of(F.col(key)))
        dealt = dealt.repartition("bucket") if files == 1 else dealt.repartitionByRange(files * BUCKETS, "bucket", key)
        dealt.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(folder)
        buckets = [n.split("=")[1] for n in self._names(folder[len(self.path) + 1 :]) if n.startswith("bucket=")]
        return folder, buckets, rows.schema.toDDL()

    def commit(self, base: Snapshot, written: dict[str, tuple[str, list[str], str]], touched: list[int], facts: dict) -> Snapshot:
        """Make a version after ``base`` in which the touched buckets of the written tables are the new ones; those of
        them without rows go. Raises Conflict if there is a newer version than ``base`` already."""
        tables, schemas = {k: dict(v) for k, v in base.tables.items()}, dict(base.schemas)
        for name, (folder, buckets, schema) in written.items():
            held = {b: f for b, f in tables.get(name, {}).items() if int(b) not in touched}
            tables[name], schemas[name] = held | dict.fromkeys(buckets, folder), schema
        manifest = f"{uuid.uuid4().hex}.json"
        self._put(f"manifests/{manifest}", json.dumps({"tables": tables, "schemas": schemas, "facts": facts}), True)
        version = base.version + 1
        if self.versions() and self.versions()[-1] >= version:
            raise Conflict(f"version {version} is there already")
        try:
            self._put(f"commits/v={version}", manifest, True)
        except Exception as e:  # of two writers the file system lets one create the file
            raise Conflict(f"version {version} is there already") from e
        return Snapshot(self.spark, version, tables, schemas, facts)

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the newest ``keep`` versions uses; the number deleted. Not while a writer is at work."""
        used = {f for v in self.versions()[-keep:] for t in self.open(v).tables.values() for f in t.values()}
        gone = [f"data/{t}/{n}" for t in self._names("data") for n in self._names(f"data/{t}") if f"{self.path}/data/{t}/{n}" not in used]
        for name in gone:
            self._fs.delete(self._at(name), True)
        for v in self.versions()[:-keep]:
            self._fs.delete(self._at(f"commits/v={v}"), False)
        return len(gone)
