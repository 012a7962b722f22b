"""Documents of sessions, of their continuations and of the trial's protocol, with closed schemas.

A document's JSON is parsed once to a variant, whose own types tell an integer from
text or a fraction and a field that is null from one that is missing.  Duplicate
names make a document invalid.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.integers import SCALE
from ..functions.text import parse_instant
from .metrics import Profile
from .validate import _any, first_error, graph, signal, transcript

SESSION, CONTINUATION, PROTOCOL, ALGORITHM = "session.v1", "continuation.v1", "protocol.v1", "measurement.v1"
EVENTS = "array<struct<index: bigint, role: string, text: string, tool_name: string>>"
NODES, RELATIONS = "array<struct<id: string, content_hash: string>>", "array<struct<src: string, dst: string, relation_type: string>>"

#: The only types that the members of a document's arrays may have.
_EVENT = ["OBJECT<index: BIGINT, role: STRING, text: STRING, tool_name: VOID>", "OBJECT<index: BIGINT, role: STRING, text: STRING, tool_name: STRING>"]
_MEMBERS = {
    "claims": "OBJECT<content_hash: STRING, id: STRING, material: BOOLEAN>",
    "evidence": "OBJECT<content_hash: STRING, id: STRING, observed: BOOLEAN>",
    "relations": "OBJECT<dst: STRING, relation_type: STRING, src: STRING>",
}


def _other_fields(doc: Column, path: str, *fields: str) -> Column:
    """Whether the value at a path is no object of exactly these fields."""
    names = F.map_keys(F.try_variant_get(doc, path, "map<string,variant>"))
    return ~F.array_sort(names).eqNullSafe(F.array(*map(F.lit, sorted(fields))))


def _other_members(doc: Column, path: str, *types: str) -> Column:
    """Whether the value at a path is no array of members of these types."""
    items = F.try_variant_get(doc, path, "array<variant>")
    return items.isNull() | _any(items, lambda x: ~F.schema_of_variant(x).isin(*types))


def _head(doc: Column, label: str, schema: str, time: str, *fields: str) -> Column:
    text = lambda f: F.try_variant_get(doc, f"$.{f}", "string")
    return first_error(
        (doc.isNull(), f"{label}_json_invalid"),
        (_other_fields(doc, "$", *fields), f"{label}_fields_invalid"),
        ((F.schema_of_variant(F.try_variant_get(doc, "$.session_id", "variant")) != "STRING") | (text("schema") != schema) | (text("session_id") == ""), f"{label}_identity_invalid"),
        (parse_instant(text(time), utc_only=True).isNull(), f"{label}_time_invalid"),
    )


def _events(doc: Column, label: str, path: str) -> Column:
    typed = F.try_variant_get(doc, path, EVENTS)
    return F.coalesce(
        first_error((_other_members(doc, path, *_EVENT), f"{label}_event_fields_invalid")),
        transcript(typed),
        F.when(_any(F.filter(typed, lambda t: t["role"] == "tool"), lambda t: t["tool_name"] == ""), "transcript_tool_name_invalid"),
    )


def _graph(doc: Column, path: str) -> Column:
    """The graph's own rules, after those on its fields and on observed evidence."""
    get = lambda f, t: F.try_variant_get(doc, f"{path}.{f}", t)
    seen = get("evidence", "array<struct<observed: boolean>>")
    return F.coalesce(
        first_error(
            (_other_fields(doc, path, *_MEMBERS), "graph_fields_invalid"),
            *((_other_members(doc, f"{path}.{f}", t), f"graph_{f}_invalid") for f, t in _MEMBERS.items()),
            (_any(seen, lambda x: ~x["observed"]), "graph_evidence_unobserved"),
        ),
        graph(get("claims", NODES), get("evidence", NODES), get("relations", RELATIONS)),
    )


def session_error(raw: Column, schema: str = SESSION, algorithm: str = ALGORITHM) -> Column:
    """The first error of a session's JSON text, or null.

    A session holds nothing from after its handoff: no other field is allowed.
    """
    doc, own = F.try_parse_json(raw), "$.measurement_input"
    points = f"{own}.signal_points_micros"
    return F.coalesce(
        _head(doc, "session", schema, "handoff_at_utc", "schema", "session_id", "handoff_at_utc", "transcript", "measurement_input"),
        _events(doc, "session", "$.transcript"),
        first_error(
            (_other_fields(doc, own, "algorithm_id", "signal_points_micros", "previous_graph", "current_graph"), "measurement_fields_invalid"),
            (F.try_variant_get(doc, f"{own}.algorithm_id", "string") != algorithm, "measurement_algorithm_unsupported"),
            (_other_members(doc, points, "BIGINT"), "signal_invalid"),
        ),
        signal(F.try_variant_get(doc, points, "array<bigint>")),
        _graph(doc, f"{own}.previous_graph"),
        _graph(doc, f"{own}.current_graph"),
    )


def continuation_error(raw: Column, schema: str = CONTINUATION) -> Column:
    """The first error of a continuation's JSON text, or null."""
    doc = F.try_parse_json(raw)
    return F.coalesce(
        _head(doc, "continuation", schema, "started_at_utc", "schema", "session_id", "started_at_utc", "events", "ended"),
        first_error((F.schema_of_variant(F.try_variant_get(doc, "$.ended", "variant")) != "BOOLEAN", "continuation_ended_invalid")),
        _events(doc, "continuation", "$.events"),
    )


def session_columns(raw: Column) -> list[Column]:
    """The parts of a valid session that the metrics take."""
    doc, own = F.try_parse_json(raw), "$.measurement_input"
    graphs = [F.struct(*(F.try_variant_get(doc, f"{own}.{g}.{f}", RELATIONS if f == "relations" else NODES).alias(f) for f in _MEMBERS)).alias(g) for g in ("previous_graph", "current_graph")]
    texts = [F.try_variant_get(doc, f"$.{f}", "string").alias(f) for f in ("session_id", "handoff_at_utc")]
    return [*texts, F.try_variant_get(doc, "$.transcript", EVENTS).alias("transcript"), F.try_variant_get(doc, f"{own}.signal_points_micros", "array<bigint>").alias("points"), *graphs]


def continuation_columns(raw: Column) -> list[Column]:
    doc = F.try_parse_json(raw)
    kinds = {"session_id": "string", "started_at_utc": "string", "events": EVENTS, "ended": "boolean"}
    return [F.try_variant_get(doc, f"$.{f}", t).alias(f) for f, t in kinds.items()]


#: A receiver profile's fields beside its integers, and its states.
PROFILE_TEXTS = {"profile_id", "signal_schema_id", "calibration_status", "calibration_corpus_hash"}
PROFILE_NUMBERS = {
    "calibration_sample_count", "smoothing_window", "epsilon_window", "i_c_micros", "alpha_k_micros", "alpha_e_micros", "stability_delta_micros", "kappa_critical_micros", "phi_min_micros",
    "amber_kappa_micros", "amber_epsilon_micros", "amber_dhol_micros", "dhol_claim_weight_micros", "dhol_evidence_weight_micros", "dhol_relation_weight_micros",
}
CALIBRATED, UNCALIBRATED = "calibrated", ("synthetic_conformance", "uncalibrated_reference")
LEAST_SAMPLES = 500


def receiver_profile(document: Any) -> Profile:
    """The metrics' profile of a receiver's document; raises ValueError with an error code."""
    if not isinstance(document, dict) or {*document} != PROFILE_TEXTS | PROFILE_NUMBERS:
        raise ValueError("profile_fields_invalid")
    name, unit, state, corpus = (document[k] for k in ("profile_id", "signal_schema_id", "calibration_status", "calibration_corpus_hash"))
    numbers = {k: document[k] for k in PROFILE_NUMBERS}
    if any(type(v) is not int or not 0 <= v < 2**53 for v in numbers.values()):
        raise ValueError("profile_value_invalid")
    digest = isinstance(corpus, str) and len(corpus) == 64 and not corpus.strip("0123456789abcdef")
    holds = {
        "id": isinstance(name, str) and name != "" and name.isascii(),
        "signal_schema": unit is None or isinstance(unit, str) and unit != "",
        "status": isinstance(state, str) and state in (CALIBRATED, *UNCALIBRATED),
        "calibration": digest and numbers["calibration_sample_count"] >= LEAST_SAMPLES if state == CALIBRATED else corpus is None and numbers["calibration_sample_count"] == 0,
    }
    if code := next((k for k, ok in holds.items() if not ok), None):
        raise ValueError(f"profile_{code}_invalid")
    drop = lambda k: k.removesuffix("_micros").removeprefix("dhol_")
    return Profile(**{drop(k): v for k, v in numbers.items() if drop(k) in Profile.__dataclass_fields__})


def protocol_profile(document: Any, schema: str = PROTOCOL, algorithm: str = ALGORITHM) -> Profile:
    """The profile of a trial's protocol, once the protocol holds; raises ValueError with an error code."""
    part = lambda x, k: x.get(k) if isinstance(x, dict) else None
    contract, inference = part(document, "measurement_contract"), part(document, "primary_inference")
    share = lambda k: type(part(inference, k)) is int and 0 < part(inference, k) < SCALE
    if part(document, "schema") != schema:
        raise ValueError("protocol_schema_unsupported")
    if part(contract, "algorithm_id") != algorithm:
        raise ValueError("protocol_algorithm_unsupported")
    profile = receiver_profile(part(contract, "receiver_profile"))
    if part(contract, "profile_authority") != "receiver":
        raise ValueError("protocol_authority_invalid")
    if not (share("alpha_micros") and share("confidence_micros")):
        raise ValueError("protocol_inference_invalid")
    return profile
