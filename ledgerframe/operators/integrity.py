"""Checks on whole tables that must hold before a result counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unaligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: any row is an error."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.col("_l").isNotNull().alias("in_left"), F.col("_r").isNotNull().alias("in_right")).filter("NOT (in_left AND in_right)")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def within_caps(rows: DataFrame, key: str, size: str, max_items: int, max_bytes: int, max_item_bytes: int) -> DataFrame:
    """The first cap that each group breaks, or null; caps fail, they never truncate."""
    g = rows.groupBy(key).agg(F.count("*").alias("n_items"), F.sum(size).alias("n_bytes"), F.max(size).alias("largest"))
    code = F.when(F.col("n_items") > max_items, "item_limit_exceeded").when(F.col("n_bytes") > max_bytes, "total_size_limit_exceeded").when(F.col("largest") > max_item_bytes, "file_size_limit_exceeded")
    return g.select(key, "n_items", "n_bytes", code.alias("violation"))


def require_empty(errors: DataFrame, code: str) -> None:
    """Fail closed: raise with the first offending row."""
    found = errors.limit(1).collect()
    if found:
        raise ValueError(f"{code}:{found[0].asDict()}")
