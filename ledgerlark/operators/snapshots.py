"""Tables that change together: snapshots named by a manifest, with rows in hash buckets of their keys.

A load reads and rewrites only the buckets that its rows fall into, in new folders. Nothing that readers see is touched.
When all tables are written and their references hold, one small manifest is made, under the next number, by a rename that
fails if the number is taken (as on HDFS; a local disk needs one load at a time): before it every table has the old rows, after it every table has the new ones. Readers take
the highest manifest, and may keep to an older one as long as it is there. A load that breaks off leaves folders
that no manifest names; expire() removes these and old snapshots.

    root/manifest/0000000007.json      {"tables": {name: {"buckets": n, "keys": [...], "folders": {bucket: folder}}}}
    root/data/<load>/<table>/bucket=5/part-...parquet
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlark.operators import load

#: Buckets of a table when it is made. A bucket should stay within some hundred megabytes.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another load has made the next snapshot first; nothing of this one shows. Load again."""


class Broken(ValueError):
    """Rows refer to rows that the new snapshot would not have; nothing has changed."""


@dataclass
class Change:
    """New rows of a table. update: they replace rows of their key, else only absent keys are added. references: (columns, table)
    pairs: values of the columns, where none is null, must be a key of the other table."""

    rows: DataFrame
    keys: list[str]
    update: bool
    references: list[tuple[list[str], str]] = field(default_factory=list)


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        found = self._files.globStatus(self._path(f"{self.root}/manifest/*.json")) or []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in found)

    def manifest(self, version: int | None = None) -> dict:
        """The tables of a snapshot, by default the newest; without any, none."""
        known = self.versions()
        if not known:
            return {}
        name = f"{self.root}/manifest/{(known[-1] if version is None else version):010d}.json"
        return json.loads("\n".join(r.value for r in self.spark.read.text(name, wholetext=True).collect()))["tables"]

    def table(self, name: str, schema: StructType, version: int | None = None) -> DataFrame:
        """All rows of a table as of a snapshot."""
        return self._read(self.manifest(version).get(name), schema)

    def _read(self, entry: dict | None, schema: StructType, only: set[int] | None = None) -> DataFrame:
        folders = [f"{self.root}/{f}/bucket={b}" for b, f in (entry or {"folders": {}})["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def load(self, changes: dict[str, Change]) -> int:
        """Bring in all changes as one new snapshot; its number. Loading the same rows again changes no table."""
        known = self.versions()
        tables = self.manifest() if known else {}
        number = (known[-1] if known else 0) + 1
        folder = f"data/{uuid.uuid4().hex}"
        fresh = dict(tables)
        for name, change in changes.items():
            fresh[name] = self._merged(f"{folder}/{name}", tables.get(name), change)
        for name, change in changes.items():
            for columns, other in change.references:
                self._held(name, change.rows, columns, other, fresh, changes)
        self._commit(number, fresh)
        return number

    def _merged(self, folder: str, entry: dict | None, change: Change) -> dict:
        entry = entry or {"buckets": self.buckets, "keys": change.keys, "folders": {}}
        if entry["keys"] != change.keys:
            raise ValueError(f"the table's keys are {entry['keys']}")
        bucket = bucket_of([F.col(k) for k in change.keys], entry["buckets"])
        touched = {r[0] for r in change.rows.select(bucket).distinct().collect()}  # as many as buckets at most
        old = self._read(entry, change.rows.schema, touched)
        columns = [c for c in change.rows.columns if c not in change.keys]
        merged = load.upserted(old, change.rows, change.keys, columns) if change.update else load.inserted_if_absent(old, change.rows, change.keys)
        # a bucket's rows are some hundred megabytes, so a task may write all of them
        merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        return entry | {"folders": entry["folders"] | {str(b): folder for b in sorted(touched)}}

    def _held(self, name: str, rows: DataFrame, columns: list[str], other: str, tables: dict, changes: dict[str, Change]) -> None:
        """Only the other table's buckets that the values fall into are read."""
        entry = tables.get(other)
        if entry is None:
            raise Broken(f"{name} refers to {other}, which is not there")
        asked = rows.select(*[F.col(c).alias(k) for c, k in zip(columns, entry["keys"])]).dropna().distinct()
        buckets = {r[0] for r in asked.select(bucket_of([F.col(k) for k in entry["keys"]], entry["buckets"])).distinct().collect()}
        there = self._read(entry, asked.schema, buckets)
        lost = asked.join(there, entry["keys"], "left_anti").limit(5).collect()
        if lost:
            raise Broken(f"{name}({', '.join(columns)}) has values that {other} lacks, such as {tuple(lost[0])}")

    def _commit(self, number: int, tables: dict) -> None:
        beside, final = f"{self.root}/manifest/_{uuid.uuid4().hex}", f"{self.root}/manifest/{number:010d}.json"
        out = self._files.create(self._path(beside), False)
        out.write(bytearray(json.dumps({"tables": tables}).encode()))
        out.close()
        # not before it is whole, and never over another's
        if self._files.exists(self._path(final)) or not self._files.rename(self._path(beside), self._path(final)):
            self._files.delete(self._path(beside), False)
            raise Conflict(f"snapshot {number} is there already")

    def expire(self, keep: int = 2) -> None:
        """Remove all snapshots but the newest, and folders that none of these names. Not while a load runs."""
        known = self.versions()
        for version in known[:-keep]:
            self._files.delete(self._path(f"{self.root}/manifest/{version:010d}.json"), False)
        used = {f for v in known[-keep:] for entry in self.manifest(v).values() for f in entry["folders"].values()}
        for status in self._files.globStatus(self._path(f"{self.root}/data/*/*")) or []:
            path = status.getPath()
            if f"data/{path.getParent().getName()}/{path.getName()}" not in used:
                self._files.delete(path, True)


def bucket_of(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
