"""Chains of receipts on a stream: each receipt is linked to the one before it, whatever order they arrive in.

State per chain is the last linked receipt and those that came before their turn; a
receipt is linked, by the rules that hold for tables, once its predecessor is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status
from ..operators.chain import item_columns, link_reasons
from ..operators.gateway import intake

_LINKED = ["run_id", "issuer", "sequence", "envelope_hash"]
_ITEM = ["run_id", "issuer", "sequence", "parent_hash", "envelope_hash", "item_reasons", "intake_status"]
_TYPES = "run_id string, issuer string, sequence string, parent_hash string, envelope_hash string, item_reasons string, intake_status string"
_OUT = f"chain_id string, index long, note string, {_TYPES}, " + ", ".join(f"before_{c} string" for c in _LINKED)


def _in_turn(max_items: int):
    """Gives out a chain's receipts in order, each with what the one before it held."""

    def run(key: tuple, tables: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turn, before, held = state.get if state.exists else (0, json.dumps(dict.fromkeys(_LINKED)), "{}")
        before, held = json.loads(before), json.loads(held)
        out = []
        told = lambda i, note, item, b: out.append((key[0], i, note, *(item[c] for c in _ITEM), *(b[c] for c in _LINKED)))
        for table in tables:
            for r in table.itertuples():
                item, i = {c: getattr(r, c) for c in _ITEM}, int(r.index_)
                if i >= max_items:
                    told(i, "chain_item_limit_exceeded", dict.fromkeys(_ITEM), dict.fromkeys(_LINKED))
                elif i < turn or str(i) in held:
                    told(i, "chain_index_repeated", item, dict.fromkeys(_LINKED))
                else:
                    held[str(i)] = item
        while str(turn) in held:
            item = held.pop(str(turn))
            told(turn, None, item, before)
            before, turn = {c: item[c] for c in _LINKED}, turn + 1
        state.update((turn, json.dumps(before), json.dumps(held)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"index": "int64"})

    return run


def link_stream(receipts: DataFrame, trust: DataFrame, max_items: int = 256, max_source_bytes: int = 1 << 20) -> DataFrame:
    """(chain_id, index, intake_status, item_reasons, link_reasons) of a stream of (chain_id, index, raw), in order within a chain.

    The same reasons as ``chain.verify_chains`` gives its items.  A receipt whose
    predecessor has not come is not given out yet.  One beyond the cap, or of an index that
    came before, is given out at once with that as its only link reason and is not
    linked; so the state of a chain holds less than ``max_items`` receipts, without their bytes.
    """
    if max_items < 1:
        raise ValueError("chain_limit_invalid")
    rows = item_columns(intake(receipts.withColumn("raw", F.when(F.octet_length("raw") <= max_source_bytes, F.col("raw"))), trust, max_source_bytes))
    rows = rows.select(F.col("chain_id").cast("string").alias("chain_id"), F.col("index").cast("long").alias("index_"), "run_id", "issuer", F.col("sequence").cast("string").alias("sequence"), "parent_hash", "envelope_hash", F.to_json("item_reasons").alias("item_reasons"), F.col("_intake").alias("intake_status"))
    placed = rows.groupBy("chain_id").applyInPandasWithState(_in_turn(max_items), _OUT, "turn long, before string, held string", "append", "NoTimeout")
    placed = placed.withColumns({"sequence": F.col("sequence").cast("long"), "before_sequence": F.col("before_sequence").cast("long"), "item_reasons": F.from_json("item_reasons", "array<string>")})
    reasons = F.when(F.col("note").isNotNull(), F.array(F.concat(F.lit("chain:"), F.col("note"), F.lit(":"), F.col("index").cast("string")))).otherwise(link_reasons(lambda c: F.col(f"before_{c}")))
    return placed.select("chain_id", "index", F.coalesce("intake_status", F.lit(status.FAIL)).alias("intake_status"), F.coalesce("item_reasons", F.array().cast("array<string>")).alias("item_reasons"), reasons.alias("link_reasons"))
