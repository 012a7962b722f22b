"""Shared tables: intermediate results that survive a lost executor.

Every iterative or multi-pass operator writes what a later pass needs to a
Parquet table below the folder named by ``spark.checkpoint.dir`` and reads it
back.  That cuts lineage without ``localCheckpoint`` and, unlike
``DataFrame.checkpoint``, computes the plan once.  Shuffle files of the write
are released as soon as it ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; one of our own where none is set and all run in this machine.

    A cluster without the setting is refused: its executors would write to their own
    disks, and a table read from the driver's would come out empty.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_on_context.get() if set_on_context.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="ledgerframe-"))
        found = _own[0]
    return found.rstrip("/")


def carried(docs: DataFrame, columns: list[str] | None) -> list[Column]:
    """One struct column of columns to take along, or none: their names meet no others there."""
    return [] if columns is None else [F.struct(*(F.col(f"`{c}`") for c in columns)).alias("carried")]


def fields_of(df: DataFrame, *more: str) -> T.StructType:
    """The schema of a DataFrame with more columns, given as ``name type``."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(more)).fields])


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = temporary_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerframe_path = path
    return out


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/ledgerframe/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and no later plan reads."""
    for df in tables:
        path = getattr(df, "_ledgerframe_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    """Intermediate tables go with the session that made them."""
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended already
            return


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
