"""What each prefix of a run would hand on, and what it costs: one pass over a run instead of one for each prefix.

Whether an item is accepted depends on its own decisions alone, so a prefix's handoff
is its counts so far and its last accepted items.  Both are running values of one
sorted pass: the last items are gathered among accepted rows only and carried on over
the others, never more than ``max_claims`` at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .costs import break_even, percent_reduction
from .handoff import policy_hashes, prompt_text, unsigned_text

COUNTED = ("full", "unsigned", "handoff")


def prefix_handoffs(items: DataFrame, allowed: list[str], max_claims: int = 3) -> DataFrame:
    """(chain_id, index, chain_length, accepted_count, excluded_count, prompt, unsigned) of every prefix.

    ``items`` has chain_id, index (from 0), run_id, sequence, envelope_hash, action, facts
    (canonical texts) and excluded (null: accepted), as ``handoff.project`` places them.
    The prompt is the one that ``project`` renders for the chain cut after this item;
    unsigned is the same selection without any sign of verification.
    """
    if max_claims < 1:
        raise ValueError("handoff_limit_invalid")
    hashes, accepted = policy_hashes(allowed), F.col("excluded").isNull()
    so_far = Window.partitionBy("chain_id").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy("chain_id", accepted).orderBy("index").rowsBetween(1 - max_claims, 0)
    item = F.struct("index", "sequence", F.coalesce("action", F.lit("")).alias("action"), F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))
    rows = items.withColumn("_last", F.when(accepted, F.collect_list(item).over(alike)))
    rows = rows.withColumns({
        "chain_length": F.count("*").over(so_far), "accepted_count": F.count(F.when(accepted, 1)).over(so_far), "excluded_count": F.count(F.when(~accepted, 1)).over(so_far),
        "_last": F.coalesce(F.last("_last", ignorenulls=True).over(so_far), F.array().cast(rows.schema["_last"].dataType)),
    })

    def texts(rows: pd.DataFrame) -> pd.DataFrame:
        made = [(prompt_text(hashes, r.run_id, r.chain_length, r.envelope_hash, r.accepted_count, r.excluded_count, r.items), unsigned_text(r.accepted_count, r.items)) for r in rows.itertuples()]
        return pd.DataFrame(made, columns=["prompt", "unsigned"])

    told = F.pandas_udf(texts, "prompt string, unsigned string")(F.struct("run_id", "chain_length", "envelope_hash", "accepted_count", "excluded_count", F.col("_last").alias("items")))
    return rows.withColumn("_t", told).select("chain_id", "index", "chain_length", "accepted_count", "excluded_count", "_t.prompt", "_t.unsigned")


def prefix_costs(handoffs: DataFrame, steps: DataFrame, count: Callable[[Column], Column]) -> DataFrame:
    """Tokens of every prefix's whole transcript, unsigned and verified handoff, and of all prefixes up to it.

    ``steps`` has chain_id, index and step, the transcript's text of an item.  A transcript
    is its steps joined by line ends, whose tokens are those of its steps and, where the
    counter counts them, of the line ends: steps must neither begin nor end with white
    space, or the job fails.
    """
    edge = F.col("step").rlike(r"^\s|\s$")
    sound = F.when(edge, F.raise_error(F.concat(F.lit("step_edge_is_blank:"), F.col("index").cast("string")))).otherwise(F.col("step"))
    so_far = Window.partitionBy("chain_id").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    own = steps.select("chain_id", "index", count(sound).alias("_step"), count(F.lit("\n")).alias("_end"))
    rows = handoffs.join(own, ["chain_id", "index"]).withColumns({"unsigned_tokens": count(F.col("unsigned")), "handoff_tokens": count(F.col("prompt"))})
    rows = rows.withColumn("full_tokens", F.sum(F.col("_step") + F.when(F.col("index") > 0, F.col("_end")).otherwise(0)).over(so_far))
    rows = rows.withColumns({f"cumulative_{c}": F.sum(f"{c}_tokens").over(so_far) for c in COUNTED})
    return rows.select("chain_id", "index", "chain_length", "accepted_count", *(f"{c}_tokens" for c in COUNTED), *(f"cumulative_{c}" for c in COUNTED))


def cost_rows(costs: DataFrame) -> DataFrame:
    """One row per run: its depth, the costs of its last prefix and of replaying all, reductions in percent, and the first depth from which handing on costs no more than replaying."""
    last = F.max(F.struct("index", "chain_length", *(f"{c}_tokens" for c in COUNTED), *(f"cumulative_{c}" for c in COUNTED))).alias("l")
    rows = costs.groupBy("chain_id").agg(last).select("chain_id", F.col("l.chain_length").alias("depth"), *(F.col(f"l.{c}_tokens").alias(f"{c}_tokens") for c in COUNTED), *(F.col(f"l.cumulative_{c}").alias(f"cumulative_{c}") for c in COUNTED))
    even = break_even(costs, "chain_id", "chain_length", "cumulative_handoff", "cumulative_full")
    return rows.join(even, "chain_id").withColumns({
        "handoff_reduction_percent": percent_reduction(F.col("full_tokens"), F.col("handoff_tokens")), "cumulative_reduction_percent": percent_reduction(F.col("cumulative_full"), F.col("cumulative_handoff")),
    })
