"""Versioned tables as immutable Parquet parts and one small file per version.

A version's file names the parts it consists of, and is published by a rename
that fails if the version exists: of two commits that follow the same version
exactly one wins, and the other is told.  A commit that repeats an id already
published changes nothing, which makes a retried streaming batch harmless.  A
table can be kept in buckets; a commit then rewrites only some of them and
takes the others over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionConflict(RuntimeError):
    """Another commit took the version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        sc = spark.sparkContext
        self._jvm, self._gateway = sc._jvm, sc._gateway
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._conf = sc._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _file(self, version: int) -> str:
        return f"{self.root}/v{version:012d}.json"

    def _describe(self, version: int) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(self._file(version)).collect()))  # one line

    def versions(self) -> list[int]:
        top = self._path(self.root)
        if not self._fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return sorted(int(n[1:13]) for n in names if n.startswith("v") and n.endswith(".json"))

    def commits(self) -> dict[int, str]:
        """Published versions and the ids of their commits."""
        return {v: self._describe(v)["commit"] for v in self.versions()}

    def latest(self) -> int:
        """The newest version; 0 if there is none."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A version's rows; of a table in buckets, only those of ``buckets`` if they are named."""
        known = self.versions()
        version = max(known, default=0) if version is None else version
        if version not in known:
            raise KeyError(f"no version {version}")
        found = self._describe(version)
        parts = found["parts"]
        if "" not in parts:
            parts = {b: f"{p}/bucket={b}" for b, p in parts.items() if buckets is None or int(b) in buckets}
        rows = self.spark.read.schema(found["schema"])
        return rows.parquet(*(f"{self.root}/{p}" for p in parts.values())) if parts else self.spark.createDataFrame([], found["schema"])

    def _publish(self, version: int, description: dict) -> None:
        """Make the version's file appear at once, or fail if there is one."""
        part = self._path(f"{self.root}/_file-{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(description).encode()))
        out.close()
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # never overwrites
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(part), self._fs.makeQualified(self._path(self._file(version))), options)
        except Exception as e:
            self._fs.delete(part, False)
            if self._fs.exists(self._path(self._file(version))):
                raise VersionConflict(f"version {version} was published meanwhile") from e
            raise

    def commit(self, df: DataFrame, commit_id: str, expected: int | None = None) -> int:
        """Publish ``df`` as the next version and return its number."""
        return self._commit(df, commit_id, expected, None)

    def commit_buckets(self, df: DataFrame, bucket, touched: list[int], commit_id: str, expected: int | None = None) -> int:
        """Publish a version in which the ``touched`` buckets hold ``df`` and the others what they held."""
        return self._commit(df.withColumn("bucket", bucket), commit_id, expected, touched)

    def _commit(self, df: DataFrame, commit_id: str, expected: int | None, touched: list[int] | None) -> int:
        known = self.commits()
        for version, found in known.items():
            if found == commit_id:
                return version
        now = max(known, default=0)
        if expected is not None and expected != now:
            raise VersionConflict(f"expected version {expected}, found {now}")
        part = f"part-{uuid.uuid4().hex}"
        parts = {"": part}
        columns = [c for c in df.columns if touched is None or c != "bucket"]
        if touched is None:
            df.write.parquet(f"{self.root}/{part}")
        else:
            df.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{part}")
            parts = dict(self._describe(now)["parts"]) if now else {}
            there = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{part}"))}
            for b in touched:
                parts.pop(str(b), None)
                if f"bucket={b}" in there:  # a bucket may have become empty
                    parts[str(b)] = part
        try:
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)
            self._publish(now + 1, {"commit": commit_id, "parts": parts, "schema": fields})
        except (VersionConflict, PySparkException):
            self._fs.delete(self._path(f"{self.root}/{part}"), True)
            raise
        return now + 1

    def keep(self, newest: int) -> list[int]:
        """Drop all but the newest versions, and parts that no version names any more; returns the versions dropped."""
        known = self.versions()
        gone, stay = known[: max(0, len(known) - newest)], known[max(0, len(known) - newest) :]
        old = {p for v in gone for p in self._describe(v)["parts"].values()} - {p for v in stay for p in self._describe(v)["parts"].values()}
        for v in gone:
            self._fs.delete(self._path(self._file(v)), False)
        for p in old:
            self._fs.delete(self._path(f"{self.root}/{p}"), True)
        return gone


def bucket_of(keys: list[str], buckets: int):
    """The bucket of a row by its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
