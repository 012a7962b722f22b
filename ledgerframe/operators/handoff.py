"""Bounded projection of approved facts from verified runs."""

from __future__ import annotations

import functools
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strict_json import dumps, loads, object_hash
from ..sources.stages import staged
from .decisions import verify_decisions
from .validate import SOURCE_SCHEMA

HANDOFF_SCHEMA = "handoff.v1"


def admit(items: DataFrame, decisions: DataFrame, allowed_policies: list[str], max_action: int = 128, max_claim: int = 280) -> DataFrame:
    """Adds ``excluded`` (the first applicable reason, or null) to chain items.

    ``items`` has source_sha256, action and claim; ``decisions`` has source_sha256,
    policy_sha256, verdict and decision.  Decisions under other policies are
    ignored.  A source with any decision that is no commit is excluded.
    """
    eligible = decisions.filter(F.col("policy_sha256").isin(*allowed_policies))
    by_source = eligible.groupBy("source_sha256").agg(F.bool_or((F.col("verdict") != "VERIFIED") | (F.col("decision") != "COMMIT")).alias("conflict"))
    joined = items.join(by_source, "source_sha256", "left")
    code = F.when(F.col("conflict").isNull(), "no_allowed_policy_decision").when(F.col("conflict"), "eligible_non_commit_or_conflict").when(F.char_length("action") > max_action, "action_too_large").when(F.char_length("claim") > max_claim, "source_claim_too_large")
    return joined.withColumn("excluded", code).drop("conflict")


def excluded_by_reason(admitted: DataFrame) -> DataFrame:
    return admitted.filter("excluded IS NOT NULL").groupBy("run_id", F.col("excluded").alias("reason")).agg(F.count("*").alias("n"))


def outside_chain(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on sources that no chain holds: any row means the handoff must stop."""
    return decisions.join(items.select("source_sha256"), "source_sha256", "left_anti")


def last_accepted(admitted: DataFrame, k: int = 3) -> DataFrame:
    """The last k accepted items of each run, in order."""
    accepted = admitted.filter("excluded IS NULL")
    w = Window.partitionBy("run_id").orderBy(F.desc("sequence"))
    return accepted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def facts(items: DataFrame, decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct facts of each source's decisions, sorted by their canonical text.

    ``rules`` has policy_sha256 and fact (canonical JSON text).
    """
    found = items.select("source_sha256").join(decisions.select("source_sha256", "policy_sha256"), "source_sha256").join(rules, "policy_sha256")
    return found.groupBy("source_sha256").agg(F.array_sort(F.collect_set("fact")).alias("facts"))


def summary(admitted: DataFrame, k: int = 3) -> DataFrame:
    """Counts of each run's projection."""
    ok = F.col("excluded").isNull()
    out = admitted.groupBy("run_id").agg(F.count("*").alias("chain_length"), F.count_if(ok).alias("accepted_count"), F.count_if(~ok).alias("excluded_count"))
    return out.withColumn("omitted_accepted_count", F.greatest(F.lit(0).cast("long"), F.col("accepted_count") - k))


def policy_hashes(allowed: list[str]) -> list[str]:
    """The allowlist, sorted and without repeats; an empty one or one with no hash is refused."""
    hexes = "0123456789abcdefABCDEF"
    if not allowed or not all(isinstance(x, str) and len(x) == 64 and {*x} <= {*hexes} for x in allowed):
        raise ValueError("handoff_policy_allowlist_invalid")
    return sorted({*allowed})


def project(results: DataFrame, items: DataFrame, decisions: DataFrame, trust: DataFrame, allowed: list[str], max_claims: int = 3, max_claim: int = 280, max_action: int = 128, max_decisions: int = 512, max_facts: int = 64, max_fact_bytes: int = 4096) -> DataFrame:
    """The handoff of each chain: counts, the last accepted items, the prompt, or why it is refused.

    ``results`` and ``items`` come from ``chain.verify_chains``, ``decisions`` has
    chain_id, index and decision_receipt.  The first of these refuses a chain: it is not
    verified, it has too many decisions, its run id is too long, a decision (the first by
    index) is invalid, of another format or on a source outside the chain, an accepted
    item's facts (the first item's) pass a limit.  Decisions under policies that are not
    allowed are counted and ignored; any eligible one that is no commit excludes its
    source.  No row is dropped: a refused chain has a row with its reason.  Decisions are
    staged, and verified once.
    """
    hashes = policy_hashes(allowed)
    if min(max_claims, max_claim, max_action, max_facts, max_fact_bytes) < 1:
        raise ValueError("handoff_limit_invalid")
    if max_decisions < 1:
        raise ValueError("handoff_decision_limit_exceeded")
    key = ["chain_id", "source_sha256"]
    sources = items.select(*key).distinct().withColumn("_in", F.lit(True))
    # A chain with too many decisions is refused unseen.
    decisions = staged(decisions.select("chain_id", "index", "decision_receipt"), "decisions")
    many = decisions.groupBy("chain_id").agg((F.count("*") > max_decisions).alias("_many"))
    # Chains over the limit are few (each has more than max_decisions), so no receipt is shuffled to meet them.
    seen = verify_decisions(decisions.filter("chain_id IS NOT NULL").join(F.broadcast(many.filter("_many").select("chain_id")), "chain_id", "left_anti"), trust)
    seen = seen.select("chain_id", "index", "errors", F.col("checked.source_format").alias("format"), F.col("checked.source_sha256").alias("source_sha256"), F.col("checked.policy_sha256").alias("policy"), F.col("checked.verdict").alias("verdict"), F.col("checked.decision").alias("decision"), F.col("checked.facts").alias("facts"))
    seen = staged(seen, "checked").join(sources, key, "left")
    at = F.col("index").cast("string")
    code = F.when(F.size("errors") > 0, F.concat(F.lit("handoff_decision_invalid:"), at, F.lit(":"), F.array_join("errors", ","))).when(~F.col("format").eqNullSafe(F.lit(SOURCE_SCHEMA)), F.concat(F.lit("handoff_decision_source_format_invalid:"), at)).when(F.col("_in").isNull(), F.concat(F.lit("handoff_decision_source_outside_chain:"), at))
    seen = seen.withColumns({"code": code, "allowed": F.coalesce(F.col("policy").isin(hashes), F.lit(False))})
    by_chain = seen.groupBy("chain_id").agg(F.min_by("code", F.when(F.col("code").isNotNull(), F.col("index"))).alias("bad"), F.count_if(~F.col("allowed")).alias("ignored_decision_count"))
    eligible = seen.filter("code IS NULL AND allowed")
    commits = eligible.groupBy(*key).agg(F.bool_or((F.col("verdict") != "VERIFIED") | (F.col("decision") != "COMMIT")).alias("conflict"), F.max(F.size("facts")).alias("rules"))
    facts = eligible.select(*key, F.explode("facts").alias("fact")).distinct().groupBy(*key).agg(F.count("*").alias("n_facts"), F.max(F.octet_length("fact")).alias("widest"), F.array_sort(F.collect_list("fact")).alias("facts"))
    name, claim = F.coalesce("action.name", F.lit("")), F.coalesce("claim", F.lit(""))
    placed = items.select(*key, "index", "sequence", name.alias("action_name"), claim.alias("claim")).join(commits, key, "left").join(facts, key, "left")
    excluded = F.when(F.col("conflict").isNull(), "no_allowed_policy_decision").when(F.col("conflict"), "eligible_non_commit_or_conflict").when(F.char_length("action_name") > max_action, "action_too_large").when(F.char_length("claim") > max_claim, "source_claim_too_large")
    over = F.when(F.col("rules") > max_facts, "handoff_fact_limit_exceeded").when(F.col("widest") > max_fact_bytes, "handoff_fact_size_limit_exceeded").when(F.col("n_facts") > max_facts, "handoff_fact_limit_exceeded")
    placed = placed.withColumn("excluded", excluded).withColumn("over", F.when(F.col("excluded").isNull(), over))
    placed = placed.withColumn("_r", F.when(F.col("excluded").isNull(), F.row_number().over(Window.partitionBy("chain_id", F.col("excluded").isNull()).orderBy(F.desc("index")))))
    shown = F.when(F.col("_r") <= max_claims, F.struct("index", "sequence", F.col("action_name").alias("action"), "claim", F.coalesce("facts", F.array().cast("array<string>")).alias("facts")))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))
    reasons = placed.filter("excluded IS NOT NULL").groupBy("chain_id", F.col("excluded").alias("reason")).agg(F.count("*").alias("n")).groupBy("chain_id").agg(counts.alias("excluded_by_reason"))
    told = placed.groupBy("chain_id").agg(F.count("*").alias("chain_length"), F.count_if(F.col("excluded").isNull()).alias("accepted_count"), F.count_if(F.col("excluded").isNotNull()).alias("excluded_count"), F.min_by("over", F.when(F.col("over").isNotNull(), F.col("index"))).alias("over"), F.array_sort(F.collect_list(shown)).alias("items"))
    rows = results.select("chain_id", "status", "run_id", "tip_hash").join(told, "chain_id", "left").join(by_chain, "chain_id", "left").join(many, "chain_id", "left").join(reasons, "chain_id", "left")
    refused = F.when(F.col("status") != "pass", "handoff_chain_not_verified").when(F.col("_many"), "handoff_decision_limit_exceeded").when(F.char_length("run_id") > 128, "handoff_run_id_too_large").otherwise(F.coalesce("bad", "over"))
    rows = rows.withColumn("refused", refused).withColumns({"ignored_decision_count": F.coalesce("ignored_decision_count", F.lit(0).cast("long")), "omitted_accepted_count": F.greatest(F.lit(0).cast("long"), F.col("accepted_count") - max_claims)})
    made = ["run_id", "chain_length", "tip_hash", "accepted_count", "omitted_accepted_count", "excluded_count", "excluded_by_reason", "ignored_decision_count", "items"]
    rows = rows.select("chain_id", "refused", *(F.when(F.col("refused").isNull(), F.col(c)).alias(c) for c in made))
    return rows.withColumn("prompt", F.when(F.col("refused").isNull(), render_jsonl(hashes)("run_id", "chain_length", "tip_hash", "accepted_count", "excluded_count", "items")))


def _item_line(item: Any) -> dict:
    facts = [loads(x.encode()) for x in item["facts"]]
    return {"seq": int(item["sequence"]), "a": item["action"], "facts": [[f["evidence_id"], f["pointer"], f["expected"]] for f in facts]}


def _lines(header: dict, items: Any) -> str:
    return "".join(dumps(x).decode() + "\n" for x in ({"k": "h", **header}, *({"k": "i", **i} for i in items)))


@functools.lru_cache(64)
def _seal(hashes: tuple[str, ...]) -> str:
    return object_hash([*hashes])[:16]


def prompt_text(hashes: list[str], run: str, n: int, tip: str, ok: int, drop: int, items: Any) -> str:
    """A handoff's canonical lines, a header and an item each.

    A line holds only what the receiver chose: facts, never a source's claim; text is
    escaped, so no value can begin a line.
    """
    header = {"s": HANDOFF_SCHEMA, "run": run, "n": int(n), "tip": (tip or "")[:16], "ok": int(ok), "show": len(items), "drop": int(drop), "pn": len(hashes), "ps": _seal((*hashes,))}
    return _lines(header, map(_item_line, items))


def unsigned_text(ok: int, items: Any) -> str:
    """The same selection without any sign of verification: a benchmark's control, no basis of a decision."""
    return _lines({"s": "unsigned.compact.v1", "ok": int(ok), "show": len(items)}, map(_item_line, items))


def render_jsonl(hashes: list[str]):
    """A function of a handoff's columns: ``prompt_text`` for a prompt."""

    def made(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([None if r.run_id is None else prompt_text(hashes, r.run_id, r.chain_length, r.tip_hash, r.accepted_count, r.excluded_count, r.items) for r in rows.itertuples()], dtype=object)

    return lambda *columns: F.pandas_udf(made, "string")(F.struct(*columns))


def render(visible: DataFrame, line: str = "line") -> DataFrame:
    """One newline-terminated text per run of its items' canonical lines, in order."""
    rows = visible.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("sequence", F.col(line).alias("line")))).alias("rows"))
    return rows.select("run_id", F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("prompt"))
