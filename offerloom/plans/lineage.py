"""Cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints/offerloom"
#: The paths that ``cut`` has written inside the ``cut_alone`` that is running in this thread or context.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only for a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", LOCAL_CHECKPOINTS)
    return LOCAL_CHECKPOINTS


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the files then stay for the folder's own clean-up
        pass


#: Whether the shuffle files of a query go when it ends, instead of when the driver's memory is next tidied.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidied(spark: SparkSession):
    """Queries in here leave no shuffle files; for those that are run once."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


def cut(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result survives the loss of any executor and is computed once however often it is read. The files go when
    the driver ends, or in ``cut_alone``; shuffle files of the writing go at once. With ``by`` they are partitioned by that column.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/offerloom-{uuid.uuid4().hex}/{name}"
    with _tidied(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    atexit.register(_remove, spark, path)
    made = _made.get()
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_alone(make: Callable[[], DataFrame], name: str = "step") -> DataFrame:
    """``cut`` of what ``make`` returns; the tables that ``make`` has written on the way there are deleted then.

    Only its own: what other threads cut meanwhile stays, and a call inside another hands its result, not its steps, to the outer one.
    """
    mine: list[str] = []
    outer = _made.set(mine)
    try:
        made = make()
    finally:
        _made.reset(outer)
    out = cut(made, name)
    for path in mine:
        _remove(out.sparkSession, path)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/offerloom-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path, if it is there."""
    _remove(spark, path)


class Growing:
    """A table in the shared folder that rows are appended to; what is there is never written again."""

    def __init__(self, spark: SparkSession, schema, name: str):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_dir(spark)}/offerloom-{uuid.uuid4().hex}/{name}"
        spark.createDataFrame([], schema).write.parquet(self.path)
        atexit.register(_remove, spark, self.path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are at most ``most``; else as it is, for a shuffle join."""
    return F.broadcast(df) if rows <= most else df
