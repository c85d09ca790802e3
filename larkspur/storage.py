"""Intermediate tables on storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes a query's shuffle files at its end where this is set.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master a temporary one where that is unset.

    A cluster without the setting is an error: its machines have no folder in common.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/larkspur-shared"
    return root.rstrip("/")


def run_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_root(spark)}/larkspur/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that are not written yet read them."""
    remove(spark, run_root(spark))


class Scratch:
    """A fresh folder below the shared root for the tables of one run.

    ``keep`` writes a table there and returns a reader of it, which cuts lineage in a way that
    outlives lost executors; ``drop`` deletes tables that nothing reads any more. The shuffle files of
    a table go when it is written, not when the driver happens to collect its garbage. What is left at the
    end of an application, ``clean`` removes. ``compression`` is Parquet's, the session's if not given.
    """

    def __init__(self, spark: SparkSession, name: str, compression: str | None = None):
        self.spark, self.compression = spark, compression
        self.path = f"{run_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n}-{name}"
        before = self.spark.conf.get(FREED, None)
        self.spark.conf.set(FREED, "true")
        try:
            df.write.parquet(path, compression=self.compression)
        finally:
            self.spark.conf.unset(FREED) if before is None else self.spark.conf.set(FREED, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t.scratch_path)
