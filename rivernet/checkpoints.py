"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir holds; only a local master may do without: it gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """The table that a loop hands on, kept as Parquet in the shared folder.

    What is read again has the size of its files as its estimate.  A checkpoint
    keeps that of the plan behind it, and the estimate of a join is the product
    of both sides: its digits double each round, until joins in a loop cost more
    to plan than to run and nothing counts as small enough to broadcast.
    """

    def __init__(self, first: DataFrame):
        self._path: str | None = None
        self.table = self.put(first)

    def put(self, df: DataFrame) -> DataFrame:
        """Takes ``df``, which may read the table before it; that one's files go as soon as ``df`` is written."""
        path = f"{ensure_checkpoint_dir(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if self._path:
            _remove(df.sparkSession, self._path)
        self._path, self.table = path, df.sparkSession.read.schema(df.schema).parquet(path)
        return self.table


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own in the shared folder, with a size estimate of its own."""
    return Rounds(df).table


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
