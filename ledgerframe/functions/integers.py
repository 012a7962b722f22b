"""Exact integer arithmetic: Spark's ``div`` truncates, these round as named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1_000_000


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def div(a: Column, b: Column) -> Column:
    """Quotient of non-negative integers."""
    return _div(a, b)


def floor_div(a: Column, b: Column) -> Column:
    return _div(a - F.pmod(a, b), b)


def ceil_div(a: Column, b: Column) -> Column:
    return -floor_div(-a, b)


def isqrt(n: Column) -> Column:
    """Floor of the square root, exact for all non-negative BIGINT: a double, corrected by one."""
    r = F.floor(F.sqrt(n.cast("double"))).cast("long")
    square = lambda x: x.cast("decimal(38,0)") * x.cast("decimal(38,0)")
    return F.when(square(r) > n, r - 1).when(square(r + 1) <= n, r + 1).otherwise(r)
