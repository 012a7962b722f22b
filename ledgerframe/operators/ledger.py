"""Append-only hash-chained ledgers: build, check, seal; predictions under frozen thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of one ledger, which are folded in one row: more fail the job.
MAX_ROWS = 4096


def _gathered(rows: DataFrame, group: list[str], item: Column) -> DataFrame:
    """(group, n, rows): each ledger's items in order, none of one beyond the cap."""
    place = F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("_item"))
    capped = F.when(F.count("*") > MAX_ROWS, F.raise_error(F.lit("ledger_row_limit_exceeded")).cast("long")).otherwise(F.count("*"))
    # Without groups the first rows are taken by a sorted limit, not gathered first.
    few = rows.select(*group, item.alias("_item"))
    few = few.withColumn("_place", place).filter(F.col("_place") <= MAX_ROWS + 1) if group else few.orderBy("_item").limit(MAX_ROWS + 1)
    return few.groupBy(*group).agg(F.array_sort(F.collect_list("_item")).alias("rows"), capped.alias("n"))


def build(rows: DataFrame, order: list[str], content: Column, group: list[str] | None = None) -> DataFrame:
    """(group, index, content, previous_hash, row_hash) of ledger rows in order.

    A row's hash covers its content and the hash before it, so a ledger is folded
    in one row; one of more than ``MAX_ROWS`` rows fails the job.
    """
    group = group or []
    rows = _gathered(rows, group, F.struct(*order, content.alias("content"))).filter("n > 0")
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<struct<content:string,previous_hash:string,row_hash:string>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        h = F.sha2(F.concat(r["content"], F.lit("|"), acc["last"]), 256)
        return F.struct(h.alias("last"), F.concat(acc["out"], F.array(F.struct(r["content"].alias("content"), acc["last"].alias("previous_hash"), h.alias("row_hash")))).alias("out"))

    out = rows.select(*group, F.posexplode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("i", "r"))
    return out.select(*group, (F.col("i") + 1).alias("index"), "r.*")


def faults(ledger: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Rows whose own hash or link to the row before is wrong; the rows meet by their index."""
    group = group or []
    before = ledger.select(*group, (F.col("index") + 1).alias("index"), F.col("row_hash").alias("_before"))
    own = F.col("row_hash") != F.sha2(F.concat("content", F.lit("|"), "previous_hash"), 256)
    link = F.col("previous_hash") != F.coalesce("_before", F.lit(""))
    return ledger.join(before, [*group, "index"], "left").withColumns({"bad_hash": own, "bad_link": link}).drop("_before").filter("bad_hash OR bad_link")


def seal(ledger: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The number of rows and the hash over all row hashes in order: what an unlock binds."""
    rows = _gathered(ledger, group or [], F.struct("index", "row_hash"))
    return rows.select(*(group or []), "n", F.sha2(F.array_join(F.transform("rows", lambda r: r["row_hash"]), ","), 256).alias("seal"))


def predict(rows: DataFrame, thresholds: DataFrame, direction: str, by: str = "metric", value: str = "value") -> DataFrame:
    """Adds the frozen threshold of each metric and the prediction it gives."""
    joined = rows.join(thresholds.select(by, "threshold"), by)
    hit = F.col(value) >= F.col("threshold") if direction == "high" else F.col(value) <= F.col("threshold")
    return joined.withColumn("pred", hit.cast("int"))


def recompute_errors(claimed: Column, recomputed: Column, claimed_reasons: Column, reasons: Column) -> Column:
    """Codes of a decision receipt that does not follow from its own assessments."""
    return F.array_compact(F.array(F.when(~claimed.eqNullSafe(recomputed), "decision_recompute_mismatch"), F.when(~claimed_reasons.eqNullSafe(reasons), "reason_codes_recompute_mismatch")))
