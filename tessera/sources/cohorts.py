"""Versioned cohort tables on plain Parquet.

A table is a folder of immutable cohorts (one partition folder each) and a log of
numbered manifests, each naming the cohorts that make up its version.  A commit
writes the cohort first, then the whole manifest under a name of its own, and last renames that
to the next version, which fails where the version exists.  So two writers of one version
can't both succeed, and a writer that dies leaves no half version.  The rename needs a file system
that has it (HDFS, a local or shared disk), not a plain object store.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConflictError(RuntimeError):
    """Another writer made the version first."""


class MissingVersionError(LookupError):
    """The version was never made, or its cohorts are gone."""


class CohortTable:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def version(self) -> int:
        """The newest version; 0 for a table without one."""
        log = self._path("_versions")
        if not self._fs.exists(log):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int) -> list[str]:
        """The cohorts of a version."""
        return self._entry(version)["cohorts"]

    def batch(self, version: int) -> int:
        """The number of the last stream batch in a version; -1 before the first."""
        return self._entry(version).get("batch", -1)

    def _entry(self, version: int) -> dict:
        if version == 0:
            return {"cohorts": []}
        path = self._path(f"_versions/{version:020d}.json")
        if not self._fs.exists(path):
            raise MissingVersionError(f"version {version} of {self.folder}")
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(b & 255 for b in stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, version: int, cohorts: list[str], batch: int) -> int:
        own = self._path(f"_versions/.{uuid.uuid4().hex}.part")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps({"cohorts": cohorts, "batch": batch}).encode()))
        out.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            files.rename(self._fs.makeQualified(own), self._fs.makeQualified(self._path(f"_versions/{version:020d}.json")), options)
        except Py4JJavaError as error:
            self._fs.delete(own, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise ConflictError(f"version {version} of {self.folder} exists") from error
            raise
        return version

    def append(self, rows: DataFrame, base: int | None = None, replace: Sequence[str] = (), batch: int | None = None) -> int:
        """Write ``rows`` as a cohort and make the version after ``base`` (default: the newest) of it; cohorts of ``replace`` are left out.

        ``batch`` is the number of the stream batch that the version takes in; without it the base's is kept.
        """
        if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in self.schema]:
            raise ValueError(f"rows are {rows.schema.simpleString()}, the table is {self.schema.simpleString()}")
        base = self.version() if base is None else base
        cohort = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/cohort={cohort}")
        return self._commit(base + 1, [c for c in self.manifest(base) if c not in replace] + [cohort], self.batch(base) if batch is None else batch)

    def read(self, version: int | None = None) -> DataFrame:
        """Exactly the rows of a version."""
        cohorts = self.manifest(self.version() if version is None else version)
        if not cohorts:
            return self.spark.createDataFrame([], self.schema)
        if gone := [c for c in cohorts if not self._fs.exists(self._path(f"cohort={c}"))]:
            raise MissingVersionError(f"{len(gone)} cohorts of a version of {self.folder} were removed")
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/cohort={c}" for c in cohorts))

    def changes(self, start: int, end: int, keys: Sequence[str]) -> DataFrame:
        """Keys that differ between two versions, with their kind of change."""
        return change_plan(self.read(start), self.read(end), keys)

    def compact(self, files: int = 1) -> int:
        """Rewrite the newest version as one cohort of ``files`` files; older versions stay readable."""
        version = self.version()
        return self.append(self.read(version).coalesce(files), version, self.manifest(version))

    def vacuum(self, keep: Sequence[int]) -> list[str]:
        """Remove cohorts that no kept version names (the newest is always kept)."""
        named = {c for v in {*keep, self.version()} for c in self.manifest(v)}
        gone = []
        for status in self._fs.listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith("cohort=") and name[7:] not in named:
                self._fs.delete(status.getPath(), True)
                gone.append(name[7:])
        return gone


def change_plan(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` and ``change`` (insert, delete, update) of each key whose rows differ.

    Rows are compared null-safely by fingerprint.  A key with several rows has one line: what is compared is
    how often each of them stands there, as a count and a sum of hashes, which combine before the shuffle.
    """
    from tessera.functions.identity import row_fingerprint

    def prints(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*keys, F.xxhash64(row_fingerprint(df)).cast("decimal(38,0)").alias("__p"))
        return rows.groupBy(*keys).agg(F.struct(F.count("*").alias("n"), F.sum("__p").alias("sum")).alias(name))

    change = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "delete").otherwise("update")
    a, b = prints(old, "__a"), prints(new, "__b").withColumnsRenamed({k: f"__{k}" for k in keys})
    same = functools.reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    both = a.join(b, same, "full").where(~F.col("__a").eqNullSafe(F.col("__b")))
    return both.select(*(F.coalesce(k, f"__{k}").alias(k) for k in keys), change.alias("change"))
