"""Tables between the stages of a composite: written once below ``spark.checkpoint.dir``, read by every branch."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def stage_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where driver and executors are one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not given and on_context.isDefined():
        given = on_context.get()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="ledgerframe-stages-"))
    return _own[0]


def staged(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a table of their own, computed once; lost executors lose none of it.

    The table is deleted when the driver's Python ends.  The shuffles behind it are
    released when it is written.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/ledgerframe/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _forget() -> None:
    for spark, path in _written:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended already
            return
