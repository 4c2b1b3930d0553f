"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary folder is set for the session, but only if driver and
    executors are one process, as in tests; on a cluster that folder would be another one on each machine, so this raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cuegrid-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """df, written and read back: it is computed once, and an executor that is lost later costs a new read, not a new run.

    The table stays as long as the shared folder does."""
    return _write(df, f"{shared_dir(df.sparkSession)}/cuegrid/{uuid.uuid4().hex}")


class Scratch:
    """Tables that an operator writes on its way. They are deleted together at the end of its `with` block, or one by one
    with drop(); what the operator returns must not read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_dir(spark)}/cuegrid/{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame) -> DataFrame:
        return _write(df, f"{self.at}/{uuid.uuid4().hex}")

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            for file in table.inputFiles()[:1]:
                self._delete(file.rpartition("/")[0])

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.at)
