"""Intermediate results that survive the loss of an executor.

Everything that is read more than once, or that must keep its partitions, is
written to the folder all executors share. That folder is the session's
``spark.checkpoint.dir``; only where it is unset and the master is local (tests, a
laptop) is a temporary folder of this machine taken. On a cluster without a shared
folder nothing is written: that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: Spark's setting by which a query's shuffle files are deleted at its end.
CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also makes it the checkpoint folder of the context."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + _own[app])
    return "file://" + _own[app]


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder by one run of an operator.

    ``write`` stores a frame and returns one that reads it; ``drop`` deletes a
    table that is no longer read. Tables the caller's result still reads stay
    until the process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self._clean)

    def write(self, df: DataFrame, clear: bool = False) -> tuple[DataFrame, str]:
        """``clear``: what was shuffled for it is deleted at once, not when the driver happens to collect its garbage."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEAR, None)
        if clear:
            self.spark.conf.set(CLEAR, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            if clear:
                self.spark.conf.unset(CLEAR) if before is None else self.spark.conf.set(CLEAR, before)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str | None) -> None:
        if path:
            delete_path(self.spark, path)

    def _clean(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the context may have ended first
            pass
