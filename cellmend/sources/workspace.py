"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes a query's shuffle files when it ends; else they wait for the driver's garbage collection.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_scopes: list[list[Workspace]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if all tasks run on this machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="cellmend-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        path = _own[app]
    return path.rstrip("/")


@contextmanager
def scope() -> Iterator[None]:
    """Deletes, at its end, the tables of all workspaces that were opened within it."""
    _scopes.append([])
    try:
        yield
    finally:
        for work in _scopes.pop():
            work.close()


class Workspace:
    """Tables of one run, as Parquet files under one folder of the shared one.

    Writing a table cuts its lineage: later plans begin at its files, and a lost
    executor costs the tasks it ran and nothing before them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for scope in _scopes[-1:]:
            scope.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table. The shuffle files of the write go when it ends."""
        path = f"{self.path}/{name}"
        before = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Delete all tables."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
