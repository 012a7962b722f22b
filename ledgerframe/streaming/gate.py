"""Decisions on a stream of receipts: the batch gate's own columns on each micro-batch.

Trust and artifacts are static tables that a receipt meets by joins, so every one of
the seven assessments runs on the stream as it does on a table.  Receipts that arrive
twice within the watermark are decided once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import gate
from ..operators.gateway import decide_receipts


def decide_stream(receipts: DataFrame, artifacts: DataFrame, trust: DataFrame, policy: gate.Policy, now_micros: int, watermark: str = "1 hour", **options) -> DataFrame:
    """``receipts`` streams receipt_id, arrived_at and raw; the tables and options are ``decide_receipts``'s."""
    once = receipts.withWatermark("arrived_at", watermark).dropDuplicatesWithinWatermark(["receipt_id"])
    return decide_receipts(once, artifacts, trust, policy, now_micros, **options)
