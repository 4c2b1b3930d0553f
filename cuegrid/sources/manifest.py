"""A table of keyed parts that is replaced part by part, all of a commit or none of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit was published since this one began."""


class Library:
    """Rows with a key, in a folder that all executors share: data/ID has a commit's rows, manifests/ID says for each key of the table which commit its rows are of, versions/N names the manifest of version N.

    A commit writes its rows and a whole new manifest under names that nobody knows, then publishes it by renaming one small file to a name that must be new. A reader opens the last version's manifest and
    nothing else, so it sees all of a commit or none of it, whenever the writer is lost; and of two writers that began at one version the second fails. A manifest is a table: keys never
    reach the driver. What lost commits and replaced rows leave is deleted by vacuum()."""

    def __init__(self, spark: SparkSession, at: str, key: str = "video_id"):
        self.spark, self.at, self.key = spark, at.rstrip("/"), key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.at).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.at}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def version(self) -> int:
        """The last version's number; 0 of a library without any."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=0)

    def _manifest(self, version: int) -> DataFrame | None:
        if not version:
            return None
        stream = self._fs.open(self._path(f"{self.at}/versions/{version:012}"))
        try:
            name = stream.readUTF()
        finally:
            stream.close()
        return self.spark.read.parquet(f"{self.at}/manifests/{name}")

    def commit(self, rows: DataFrame, gone: DataFrame | None = None, base: int | None = None) -> int:
        """A new version in which rows replace all that their keys had, and the keys of `gone` have nothing. Rows of a null key are one part. Raises Conflict if `base` (now's version) is no longer the last."""
        base = self.version() if base is None else base
        name = uuid.uuid4().hex
        data = f"{self.at}/data/{name}"
        rows.withColumn("__commit", F.lit(name)).write.parquet(data)
        new = self.spark.read.parquet(data).select(self.key, "__commit").distinct()
        old = self._manifest(base)
        if old is not None:
            lost = new.select(self.key) if gone is None else new.select(self.key).unionByName(gone.select(self.key)).distinct()
            new = old.join(lost.withColumnRenamed(self.key, "__k"), F.col(self.key).eqNullSafe(F.col("__k")), "left_anti").unionByName(new)
        new.write.parquet(f"{self.at}/manifests/{name}")
        self._publish(name, base + 1)
        return base + 1

    def _publish(self, name: str, version: int) -> None:
        folder, here = self._path(f"{self.at}/versions"), self._path(f"{self.at}/versions/.{name}")
        self._fs.mkdirs(folder)
        out = self._fs.create(here)
        out.writeUTF(name)
        out.close()
        to = self._path(f"{self.at}/versions/{version:012}")
        if self._fs.exists(to) or not self._fs.rename(here, to):
            self._fs.delete(here, False)
            raise Conflict(f"version {version} of {self.at} was published by another commit")

    def read(self, schema: StructType | str, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default; none of a library without any. Folders are one a commit that still counts."""
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        manifest = self._manifest(self.version() if version is None else version)
        names = [] if manifest is None else [r[0] for r in manifest.select("__commit").distinct().collect()]
        if not names:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType([*schema, *StructType.fromDDL("__commit string")])).parquet(*[f"{self.at}/data/{n}" for n in names])
        known = manifest.select(F.col(self.key).alias("__k"), F.col("__commit").alias("__c"))
        return rows.join(known, F.col(self.key).eqNullSafe(F.col("__k")) & (F.col("__commit") == F.col("__c")), "left_semi").drop("__commit")

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what the last `keep` versions don't need, lost commits included; how many folders that were. No commit may be under way."""
        versions = [int(n) for n in self._names("versions") if n.isdigit()][-keep:]
        needed, manifests = set(), set()
        for v in versions:
            stream = self._fs.open(self._path(f"{self.at}/versions/{v:012}"))
            manifests.add(stream.readUTF())
            stream.close()
            needed |= {r[0] for r in self._manifest(v).select("__commit").distinct().collect()}
        lost = [f"data/{n}" for n in self._names("data") if n not in needed] + [f"manifests/{n}" for n in self._names("manifests") if n not in manifests]
        for n in [*lost, *[f"versions/{n}" for n in self._names("versions") if not n.isdigit() or int(n) not in versions]]:
            self._fs.delete(self._path(f"{self.at}/{n}"), True)
        return len(lost)
