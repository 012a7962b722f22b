"""Hash-linked chains of receipts: links, status, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import status
from ..sources.stages import staged
from .gateway import intake


def links(items: DataFrame) -> DataFrame:
    """Link reasons of each item of a chain.

    ``items`` has chain_id, index, run_id, issuer, sequence, parent_hash and
    envelope_hash.  Items without a run_id have no payload and are skipped, as is
    their successor.
    """
    w = Window.partitionBy("chain_id").orderBy("index")
    return items.withColumn("link_reasons", link_reasons(lambda c: F.lag(c).over(w)))


def link_reasons(before: Callable[[str], Column]) -> Column:
    """Link reasons of an item; ``before`` gives a column of the item before it."""
    first, i = F.col("index") == 0, F.col("index").cast("string")
    both = F.col("run_id").isNotNull() & before("run_id").isNotNull() & ~first
    differs = lambda a, b: ~a.eqNullSafe(b)
    codes = [
        F.when(first & F.col("run_id").isNotNull() & differs(F.col("sequence"), F.lit(0)), "chain:first_sequence_not_zero"),
        F.when(first & F.col("parent_hash").isNotNull(), "chain:first_parent_present"),
        F.when(both & differs(F.col("sequence"), before("sequence") + 1), F.concat(F.lit("chain:sequence_gap:"), i)),
        F.when(both & differs(F.col("parent_hash"), before("envelope_hash")), F.concat(F.lit("chain:parent_mismatch:"), i)),
        F.when(both & differs(F.col("run_id"), before("run_id")), F.concat(F.lit("chain:run_id_changed:"), i)),
        F.when(both & differs(F.col("issuer"), before("issuer")), F.concat(F.lit("chain:issuer_changed:"), i)),
    ]
    return F.array_compact(F.array(*codes))


def item_columns(rows: DataFrame) -> DataFrame:
    """Adds item_reasons, ``_intake`` (the worst status) and the payload's fields to rows that were taken in."""
    names = ("integrity", "provenance", "normalization")
    told = lambda n: F.transform(F.col(f"{n}.reason_codes"), lambda r: F.concat(F.lit("item:"), F.col("index").cast("string"), F.lit(f":{n}:"), r))
    p = F.from_json("payload", "run_id string, issuer string, sequence long, parent_hash string, action struct<type:string,name:string>, claim string")
    rows = rows.withColumns({"item_reasons": F.concat(*map(told, names)), "_intake": status.name(status.worst(*(F.col(f"{n}.status") for n in names))), "_p": p, "envelope_hash": F.coalesce("envelope_hash", F.lit(""))})
    return rows.select("*", "_p.*").drop("_p")


def chain_results(linked: DataFrame, max_items: int = 256, intake_status: Column | None = None, max_bytes: int | None = None) -> DataFrame:
    """One row per chain: status and distinct sorted reasons; a chain over a cap fails with that reason alone.

    ``linked`` has link_reasons, and where they are known item_reasons and size (bytes).
    """
    intake = status.rank(intake_status) if intake_status is not None else F.lit(0)
    reasons = F.concat("item_reasons", "link_reasons") if "item_reasons" in linked.columns else F.col("link_reasons")
    rows = linked.withColumn("_rank", F.greatest(intake, F.when(F.size("link_reasons") > 0, 2).otherwise(0)))
    size = F.sum("size") if "size" in linked.columns else F.lit(0)
    # Reasons are distinct by row already; a chain's are bounded by its item cap.
    out = rows.groupBy("chain_id").agg(F.count("*").alias("items"), size.alias("bytes"), F.max("_rank").alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("index") < max_items, reasons))))).alias("reasons"))
    over = F.when(F.col("items") > max_items, "chain_item_limit_exceeded").when(F.lit(max_bytes is not None) & (F.col("bytes") > (max_bytes or 0)), "chain_total_size_limit_exceeded")
    return out.select("chain_id", "items", F.when(over.isNotNull(), status.FAIL).otherwise(status.name(F.col("rank"))).alias("status"), F.when(over.isNotNull(), F.array(over)).otherwise(F.col("reasons")).alias("reason_codes"))


def verify_chains(receipts: DataFrame, trust: DataFrame, chains: DataFrame | None = None, max_source_bytes: int = 1 << 20, max_items: int = 256, max_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """Chains of native receipts from their bytes: (results by chain, items).

    ``receipts`` has chain_id, index and raw; ``chains`` (chain_id) names chains that may
    have no item, which fail as empty.  A chain over a cap fails by its counts alone: its
    receipts are neither inspected nor linked, and not among the items.  Results have
    status, reason_codes, items and tip_hash; items have payload, run_id, issuer, sequence,
    parent_hash, action, claim, hashes and reasons.  The intake of the receipts is
    staged: they are verified once, whatever reads results and items.
    """
    if max_items < 1 or max_bytes < 1:
        raise ValueError("chain_limit_invalid")
    counted = receipts.groupBy("chain_id").agg(F.count("*").alias("items"), F.sum(F.octet_length("raw")).alias("bytes"))
    over = F.when(F.col("items") > max_items, "chain_item_limit_exceeded").when(F.col("bytes") > max_bytes, "chain_total_size_limit_exceeded")
    caps = staged(counted.select("chain_id", "items", over.alias("over")), "caps")
    rows = receipts.join(caps.filter("over IS NULL").select("chain_id"), "chain_id", "left_semi").withColumn("size", F.octet_length("raw"))
    rows = staged(intake(rows, trust, max_source_bytes), "taken_in")
    items = links(item_columns(rows))
    tips = items.groupBy("chain_id").agg(F.max_by("envelope_hash", "index").alias("tip_hash"), F.max_by("run_id", -F.col("index")).alias("run_id"))
    results = chain_results(items, max_items, F.col("_intake"), max_bytes).join(tips, "chain_id")
    none = F.lit(None).cast("string")
    results = results.unionByName(caps.filter("over IS NOT NULL").select("chain_id", "items", F.lit(status.FAIL).alias("status"), F.array("over").alias("reason_codes"), F.lit("").alias("tip_hash"), none.alias("run_id")))
    if chains is not None:
        empty = chains.select("chain_id").distinct().join(caps, "chain_id", "left_anti")
        results = results.unionByName(empty.select("chain_id", F.lit(0).cast("long").alias("items"), F.lit(status.FAIL).alias("status"), F.array(F.lit("chain_empty")).alias("reason_codes"), none.alias("tip_hash"), none.alias("run_id")))
    return results, items.drop("_intake")


def fold_hashes(items: DataFrame, key: str, order: str, content: Column, max_items: int = 4096) -> DataFrame:
    """The running hash of each group: sha256 of the hash so far, ``|`` and the row's content.

    A group is folded in one row, so one over the cap fails the job.
    """
    n = F.count("*")
    capped = F.when(n > max_items, F.raise_error(F.lit("chain_item_limit_exceeded")).cast("long")).otherwise(n)
    # Only rows within the cap are gathered; the count tells of the others.
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    gathered = F.collect_list(F.when(F.col("_place") <= max_items, F.struct(F.col(order).alias("at"), content.alias("content"))))
    rows = items.withColumn("_place", place).groupBy(key).agg(F.array_sort(gathered).alias("rows"), capped.cast("long").alias("n"))
    fold = F.aggregate("rows", F.lit(""), lambda h, r: F.sha2(F.concat(h, F.lit("|"), r["content"]), 256))
    return rows.select(key, "n", fold.alias("tip_hash"))


def monotone_ledger(rows: DataFrame, group: str, index: list[str], order: list[str]) -> DataFrame:
    """Ledger rows whose index (the first of ``index``, the others break ties) has a gap or whose order does not strictly rise."""
    w = Window.partitionBy(group).orderBy(*index)
    here = F.struct(*order)
    out = rows.withColumns({"gap": F.row_number().over(w) != F.col(index[0]), "disordered": F.coalesce(F.lag(here).over(w) >= here, F.lit(False))})
    return out.filter("gap OR disordered")
