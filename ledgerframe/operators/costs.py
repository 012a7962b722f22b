"""Token costs of prompts along a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_half_even(x: Column, places: int) -> Column:
    """A double rounded by its exact binary value, an exact half to even.

    ``round`` and ``bround`` go by a double's shortest decimal text, which may show a
    half where the double lies beside it.  The fraction in units of 2**-60 is an exact
    integer; smaller parts of a double cannot decide.
    """
    unit, scale = F.lit(1 << 60).cast("decimal(20,0)"), 10**places
    size = F.abs(x)
    whole = F.floor(size)
    parts = ((size - whole) * float(1 << 60)).cast("long").cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    low = whole * scale + F.call_function("div", parts, unit).cast("long")
    rest = F.pmod(parts, unit) * 2
    up = F.when(rest > unit, 1).when(rest < unit, 0).otherwise(F.pmod(low, F.lit(2)))
    return F.when(x < 0, -1.0).otherwise(1.0) * (low + up).cast("double") / float(scale)


def percent_reduction(baseline: Column, candidate: Column) -> Column:
    """Rounded to one place, half to even where the double is an exact half; 0 for an empty baseline."""
    return F.when(baseline == 0, F.lit(0.0)).otherwise(round_half_even((baseline - candidate) * 100.0 / baseline, 1))


def cumulative(rows: DataFrame, key: str, order: str, cost: str) -> DataFrame:
    """Adds the cost of each prefix, and of replaying all prefixes so far."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("prefix_cost", F.sum(cost).over(w)).withColumn("replay_cost", F.sum("prefix_cost").over(w))


def break_even(rows: DataFrame, key: str, depth: str, candidate: str, baseline: str) -> DataFrame:
    """The first depth at which the candidate costs no more than the baseline, or null."""
    return rows.groupBy(key).agg(F.min(F.when(F.col(candidate) <= F.col(baseline), F.col(depth))).alias("break_even_depth"))


def nearest_rank(rows: DataFrame, key: str, value: str, fraction: float, ranges: int = 200) -> DataFrame:
    """The value at index ``int((n - 1) * fraction + 0.999999)`` of each group's sorted values; nulls come first."""
    at = lambda n: F.greatest(F.lit(0), F.least(n - 1, F.floor((n - 1) * fraction + 0.999999)))
    return _ranked(rows, key, value, at, ranges).select(key, F.round("_v", 3).alias("percentile_value"))


def _ranked(rows: DataFrame, key: str, value: str, index, ranges: int = 200) -> DataFrame:
    """(key, _v): the value at ``index`` (a function of a group's size) of each group's sorted values.

    Values are counted, the counts summed along ranges of about equal size, and only
    the range that holds the index is sorted.
    """
    counts = rows.groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    cuts = rows.groupBy(F.col(key).alias("_j")).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)]).alias("_cuts"), F.count("*").alias("_n"))
    place = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    placed = counts.join(cuts, F.col("_k").eqNullSafe(F.col("_j"))).select("_k", "_v", "_c", index(F.col("_n")).alias("_at"), place.alias("_b"))
    totals = placed.groupBy("_k", "_b").agg(F.sum("_c").alias("_m"), F.first("_at").alias("_at"))
    start = F.sum("_m").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")
    hit = totals.withColumn("_start", start).filter("_start <= _at AND _at < _start + _m").select(F.col("_k").alias("_j"), F.col("_b").alias("_i"), "_start")
    inside = placed.join(hit, F.col("_k").eqNullSafe(F.col("_j")) & (F.col("_b") == F.col("_i")))
    end = F.col("_start") + F.sum("_c").over(Window.partitionBy("_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("_end", end).filter("_end - _c <= _at AND _at < _end").select(F.col("_k").alias(key), "_v")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The median of each group, the mean of the two middle values of an even number; nulls do not count.

    Two ranks, found as in ``nearest_rank``: no state holds a group's values.
    """
    known = rows.filter(F.col(value).isNotNull())
    low, high = (_ranked(known, key, value, lambda n, k=k: F.floor((n - k) / 2)).withColumnRenamed("_v", f"_v{k}") for k in (1, 0))
    high = high.withColumnRenamed(key, "_j")
    return low.join(high, F.col(key).eqNullSafe(F.col("_j"))).select(key, F.round((F.col("_v1") + F.col("_v0")) / 2, 6).alias("median_value"))
