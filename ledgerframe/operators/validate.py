"""Validators of typed documents: the first error's code, or null.

The order of the rules is part of the contract.  Whether unknown fields or wrong
types occur is decided when a document is parsed (``functions.strict_json``); here
a missing field is null.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_lower_sha256, is_safe_id, is_sha256

SOURCE_SCHEMA = "source.v1"


def exact_fields(x: dict, label: str, needed: set[str], allowed: set[str]) -> str | None:
    if needed <= x.keys() <= allowed:
        return None
    missing, unknown = sorted(needed - {*x}), sorted({*x} - allowed)
    return f"{label}_missing:{','.join(missing)}" if missing else f"{label}_unknown:{','.join(unknown)}" if unknown else None


_HEX = re.compile("[0-9A-Fa-f]{64}")


def _digest(x: Any) -> bool:
    return isinstance(x, str) and _HEX.fullmatch(x) is not None


def source_error(p: dict) -> str | None:
    """The first error of a source payload with its JSON types."""
    needed = {"schema", "issuer", "issued_at", "run_id", "sequence", "action", "claim", "evidence"}
    if code := exact_fields(p, "source", needed, needed | {"parent_hash", "extensions"}):
        return code
    filled = lambda x: isinstance(x, str) and x != ""
    a, n = p["action"], p["sequence"]
    early = [
        (p["schema"] != SOURCE_SCHEMA, "source_schema_unsupported"),
        *((not filled(p[k]), f"source_{k}_invalid") for k in ("issuer", "issued_at", "run_id")),
        (type(n) is not int or n < 0, "source_sequence_invalid"),
        (p.get("parent_hash") is not None and not _digest(p["parent_hash"]), "source_parent_hash_invalid"),
        (not isinstance(a, dict), "source_action_invalid"),
    ]
    code = next((c for wrong, c in early if wrong), None) or exact_fields(a, "action", {"type", "name"}, {"type", "name", "target"})
    if code:
        return code
    late = [
        (not (filled(a["type"]) and filled(a["name"])), "source_action_invalid"),
        ("target" in a and not isinstance(a["target"], str), "source_target_invalid"),
        (not filled(p["claim"]), "source_claim_invalid"),
        (not isinstance(p["evidence"], list), "source_evidence_invalid"),
    ]
    if code := next((c for wrong, c in late if wrong), None):
        return code
    seen: set[str] = set()
    for e in p["evidence"]:
        if not isinstance(e, dict):
            return "source_evidence_entry_invalid"
        if code := exact_fields(e, "evidence", {"id", "sha256"}, {"id", "sha256", "media_type"}):
            return code
        rules = [(not filled(e["id"]) or e["id"] in seen, "id"), (not _digest(e["sha256"]), "hash"), ("media_type" in e and not isinstance(e["media_type"], str), "media_type")]
        if code := next((f"source_evidence_{c}_invalid" for wrong, c in rules if wrong), None):
            return code
        seen.add(e["id"])
    return "source_extensions_invalid" if "extensions" in p and not isinstance(p["extensions"], dict) else None


#: A decision receipt's fields, verdicts and decisions.
DECISION_SCHEMA = "decision.v1"
DECISION_FIELDS = {"schema", "gate_id", "issued_at", "source_format", "source_sha256", "policy", "verdict", "decision", "reason_codes", "side_effect_observed", "assessments"}
VERDICTS = ("VERIFIED", "REJECTED", "UNDECIDABLE")
DECISIONS = ("COMMIT", "QUARANTINE", "DENY", "NO_BADGE", "ROLLBACK_REQUEST")


def decision_error(p: dict) -> str | None:
    """The first error of a decision payload with its JSON types."""
    if code := exact_fields(p, "decision", DECISION_FIELDS, DECISION_FIELDS):
        return code
    filled = lambda k: isinstance(p[k], str) and p[k] != ""
    holds = {
        "schema_unsupported": p["schema"] == DECISION_SCHEMA, "gate_id_invalid": filled("gate_id"), "issued_at_invalid": filled("issued_at"), "source_format_invalid": filled("source_format"),
        "source_hash_invalid": _digest(p["source_sha256"]), "verdict_invalid": p["verdict"] in VERDICTS, "disposition_invalid": p["decision"] in DECISIONS, "side_effect_invalid": isinstance(p["side_effect_observed"], bool),
        "reasons_invalid": isinstance(p["reason_codes"], list) and all(isinstance(x, str) for x in p["reason_codes"]), "policy_invalid": isinstance(p["policy"], dict), "assessments_invalid": isinstance(p["assessments"], dict),
    }
    return next((f"decision_{k}" for k, ok in holds.items() if not ok), None)


def first_error(*rules: tuple[Column, str]) -> Column:
    """Rules are (what is wrong, code); a null condition counts as wrong."""
    return F.coalesce(*(F.when(F.coalesce(wrong, F.lit(True)), code) for wrong, code in rules))


def _blank(x: Column) -> Column:
    return F.coalesce(x == "", F.lit(True))


def _any(items: Column, wrong) -> Column:
    return F.exists(F.coalesce(items, F.array()), lambda x: F.coalesce(wrong(x), F.lit(True)))


def source_payload(p: Column) -> Column:
    """``p``: schema, issuer, issued_at, run_id, sequence, parent_hash, action (type, name), claim, evidence (id, sha256)."""
    ids = F.transform(p["evidence"], lambda e: e["id"])
    return first_error(
        (p["schema"] != SOURCE_SCHEMA, "source_schema_unsupported"),
        (_blank(p["issuer"]), "source_issuer_invalid"),
        (_blank(p["issued_at"]), "source_issued_at_invalid"),
        (_blank(p["run_id"]), "source_run_id_invalid"),
        (p["sequence"] < 0, "source_sequence_invalid"),
        (p["parent_hash"].isNotNull() & ~is_sha256(p["parent_hash"]), "source_parent_hash_invalid"),
        (_blank(p["action"]["type"]) | _blank(p["action"]["name"]), "source_action_invalid"),
        (_blank(p["claim"]), "source_claim_invalid"),
        (p["evidence"].isNull(), "source_evidence_invalid"),
        (_any(ids, lambda i: i == "") | (F.size(F.array_distinct(ids)) < F.size(ids)), "source_evidence_id_invalid"),
        (_any(p["evidence"], lambda e: ~is_sha256(e["sha256"])), "source_evidence_hash_invalid"),
    )


def transcript(turns: Column, roles: tuple[str, ...] = ("user", "assistant", "tool"), tool: str = "tool") -> Column:
    """``turns``: array of index, role, text, tool_name in order."""
    at = F.sequence(F.lit(0), F.greatest(F.size(turns) - 1, F.lit(0)))
    return first_error(
        (turns.isNull(), "transcript_invalid"),
        ((F.size(turns) > 0) & (F.transform(turns, lambda t: t["index"].cast("int")) != at), "transcript_index_not_contiguous"),
        (_any(turns, lambda t: ~t["role"].isin(*roles)), "transcript_role_invalid"),
        (_any(turns, lambda t: t["text"].isNull()), "transcript_text_invalid"),
        (_any(turns, lambda t: (t["role"] == tool) != t["tool_name"].isNotNull()), "transcript_tool_name_invalid"),
    )


def signal(points: Column) -> Column:
    return first_error((points.isNull(), "signal_invalid"), (_any(points, lambda x: (x < 0) | (x > 1_000_000)), "signal_out_of_range"))


def graph(claims: Column, evidence: Column, relations: Column) -> Column:
    """Arrays of (id, content_hash) nodes and of (src, dst, relation_type) edges."""
    c, e = F.transform(claims, lambda x: x["id"]), F.transform(evidence, lambda x: x["id"])
    both = F.concat(c, e)
    is_claim, is_evidence = lambda x: F.array_contains(c, x), lambda x: F.array_contains(e, x)
    known = lambda x: F.array_contains(both, x)
    kind = lambda r: r["relation_type"]
    keys = F.transform(relations, lambda r: F.struct(r["src"], r["dst"], r["relation_type"]))
    return first_error(
        (claims.isNull() | evidence.isNull() | relations.isNull(), "graph_invalid"),
        (_any(both, lambda x: ~is_safe_id(x)) | (F.size(F.array_distinct(both)) < F.size(both)), "graph_node_id_invalid"),
        (_any(F.concat(claims, evidence), lambda x: ~is_lower_sha256(x["content_hash"])), "graph_node_hash_invalid"),
        ((c != F.array_sort(c)) | (e != F.array_sort(e)), "graph_nodes_not_sorted"),
        (_any(relations, lambda r: ~known(r["src"]) | ~known(r["dst"])), "graph_relation_dangling"),
        (_any(relations, lambda r: (kind(r) == "supports") & ~(is_evidence(r["src"]) & is_claim(r["dst"]))), "graph_supports_invalid"),
        (_any(relations, lambda r: (kind(r) == "contradicts") & ~(is_claim(r["src"]) & is_claim(r["dst"]))), "graph_contradicts_invalid"),
        (_any(relations, lambda r: (kind(r) == "depends_on") & ~is_claim(r["dst"])), "graph_depends_on_invalid"),
        (_any(relations, lambda r: ~kind(r).isin("supports", "contradicts", "depends_on")), "graph_relation_type_invalid"),
        ((keys != F.array_sort(keys)) | (F.size(F.array_distinct(keys)) < F.size(keys)), "graph_relations_not_sorted"),
    )


def outcome(o: Column, kinds: tuple[str, ...], window: int) -> Column:
    """``o``: outcome, kind, correction_index, observed_turns, ended."""
    positive = o["outcome"] == 1
    return first_error(
        (~o["outcome"].isin(0, 1), "outcome_value_invalid"),
        ((o["observed_turns"] < 0) | (o["observed_turns"] > window), "outcome_window_invalid"),
        (o["ended"].isNull(), "outcome_metadata_invalid"),
        (positive & ~F.coalesce(o["kind"].isin(*kinds), F.lit(False)), "outcome_kind_invalid"),
        (positive & F.coalesce(o["correction_index"] < 0, F.lit(True)), "outcome_correction_index_invalid"),
        (~positive & (o["kind"].isNotNull() | o["correction_index"].isNotNull()), "outcome_negative_with_correction"),
        (~positive & (o["observed_turns"] < window) & ~o["ended"], "outcome_window_incomplete"),
    )


def outcome_against(o: Column, events: Column, ended: Column, window: int) -> Column:
    """An outcome against its continuation's events (role) in order."""
    positive, i = o["outcome"] == 1, o["correction_index"]
    turns = lambda a: F.size(F.filter(a, lambda e: e["role"] == "assistant"))
    before = turns(F.slice(events, F.lit(1), F.greatest(F.coalesce(i, F.lit(0)), F.lit(0)).cast("int")))
    role = F.get(events, i.cast("int"))["role"]
    return first_error(
        (o["ended"] != ended, "outcome_ended_mismatch"),
        (positive & ~F.coalesce(role == "user", F.lit(False)), "outcome_correction_not_by_user"),
        (positive & (before > window), "outcome_outside_window"),
        (positive & (o["observed_turns"] != before), "outcome_turn_count_mismatch"),
        (~positive & (turns(events) < window) & ~ended, "outcome_window_incomplete"),
        (~positive & (o["observed_turns"] != F.least(turns(events), F.lit(window))), "outcome_turn_count_mismatch"),
    )
