"""Reading the test tables and cutting lineage where a result is used more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

#: Folders written by durable() in this process, by application.
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a test directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for written stages: the session's ``spark.checkpoint.dir``.

    Only where none is set, and only in local mode, a temporary folder of this machine is used; on a cluster that is an
    error, because executors could not read each other's files.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docfacts-")
        sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read from there with their schema.

    A lost executor costs no result, later stages read only the columns they need, and the size of a stage is known to
    the planner. The files go when the application ends, or earlier by released().
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/docfacts-{app}/{uuid.uuid4().hex}"
    _WRITTEN.setdefault(app, []).append(path)
    try:
        df.write.parquet(path)
    finally:  # the path must exist to be marked
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop.getParent())
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes the files of the stages that are written inside the block at its end, for sessions that live long."""
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(written)
    try:
        yield
    finally:
        for path in written[before:]:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        del written[before:]


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df over all of the session's shuffle partitions by the keys.

    For rows that are few bytes but much work: a shuffle without a number would be coalesced by bytes, to one task for
    a small table. Aggregations and windows by the keys reuse the partitioning. Where df comes from an aggregation by the
    same keys, give a hash of them, because Spark leaves out a shuffle by keys by which rows are partitioned already.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
