"""The three-valued status of an assessment: a total order, not SQL's NULL logic.

``fail`` outranks ``unavailable``, which outranks ``pass``.  An unknown or null
status is an error, never a pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS, UNAVAILABLE, FAIL = "pass", "unavailable", "fail"


def rank(status: Column) -> Column:
    """0, 1 or 2; anything else raises when the row is computed."""
    return F.when(status == PASS, 0).when(status == UNAVAILABLE, 1).when(status == FAIL, 2).otherwise(F.raise_error(F.lit("assessment_status_invalid")).cast("int"))


def name(rank_: Column) -> Column:
    return F.element_at(F.array(F.lit(PASS), F.lit(UNAVAILABLE), F.lit(FAIL)), rank_ + 1)


def worst(*statuses: Column) -> Column:
    """The rank of the worst of several statuses of one row."""
    return F.greatest(*(rank(s) for s in statuses)) if len(statuses) > 1 else rank(statuses[0])


def worst_of(status: Column) -> Column:
    """Aggregate: the rank of the worst status of a group."""
    return F.max(rank(status))


def verdict(rank_: Column) -> Column:
    return F.when(rank_ == 2, "REJECTED").when(rank_ == 1, "UNDECIDABLE").otherwise("VERIFIED")


def decision(rank_: Column, on_undecidable: Column, rollback: Column) -> Column:
    """``rollback``: a side effect was seen and the policy supports rolling it back."""
    return F.when(rank_ == 2, F.when(rollback, "ROLLBACK_REQUEST").otherwise("DENY")).when(rank_ == 1, on_undecidable).otherwise("COMMIT")
