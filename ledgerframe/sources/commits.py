"""Ledgers that several writers may extend: a folder of numbered commits, each created at most once.

A writer reads the tail, makes the row that names its hash, and creates the next
number without overwriting.  Of two writers that saw the same tail one creates it; the
other's row would extend a tail that has moved, so it fails and nothing is lost.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r"([0-9]{8})\.json$"


class TailMoved(RuntimeError):
    """Another writer has extended the ledger."""


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(index, row) of a ledger's commits by number; none yet: no rows; a missing number fails the read."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], "index long, row string")
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "[0-9]*.json").load(path)
    rows = files.select(F.regexp_extract("path", _NAME, 1).cast("long").alias("index"), F.col("content").cast("string").alias("row"))
    n, last = rows.agg(F.count("*"), F.max("index")).first()
    if n != (last or 0):
        raise ValueError(f"ledger_commit_missing:{n} of {last}")
    return rows


def commit(spark: SparkSession, path: str, index: int, row: str) -> None:
    """Create commit ``index`` (from 1) with its whole content, or raise ``TailMoved`` where it exists.

    A local file is linked into place, which no two writers can; other file systems
    create without overwriting, which HDFS and stores with conditional writes do atomically.
    """
    if index < 1:
        raise ValueError("ledger_index_invalid")
    at, fs = _at(spark, f"{path}/{index:08d}.json")
    fs.mkdirs(at.getParent())
    if fs.getScheme() == "file":
        target = at.toUri().getPath()
        draft = f"{os.path.dirname(target)}/.draft-{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as out:
            out.write(row)
        try:
            os.link(draft, target)
        except FileExistsError:
            raise TailMoved(f"ledger_tail_moved:{index}") from None
        finally:
            os.unlink(draft)
        return
    if fs.exists(at):
        raise TailMoved(f"ledger_tail_moved:{index}")
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            raise TailMoved(f"ledger_tail_moved:{index}") from None
        raise
    try:
        out.write(row.encode())
    finally:
        out.close()
