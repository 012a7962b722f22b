"""Outcome rows as closed documents, and against the continuations and the unlock that they bind.

A row's text is parsed once to a variant, as sessions are; a row then meets the first
row of its session and its continuation by joins, and the first rule that it breaks
is its fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_lower_sha256, parse_instant
from .sessions import _other_fields
from .trial import OUTCOME
from .validate import first_error, outcome, outcome_against

#: An outcome row's fields with the types that a value may have, and its phases.
TYPES = {
    "schema": ["STRING"], "phase": ["STRING"], "session_id": ["STRING"], "outcome": ["BIGINT"], "kind": ["STRING", "VOID"], "correction_message_index": ["BIGINT", "VOID"], "continuation_sha256": ["STRING"],
    "window_observed_assistant_turns": ["BIGINT"], "continuation_ended": ["BOOLEAN"], "labeled_at_utc": ["STRING"], "outcome_unlock_sha256": ["STRING", "VOID"], "notes": ["STRING"],
}
CALIBRATION, PROSPECTIVE = "calibration", "prospective"
_AS = {"BIGINT": "bigint", "BOOLEAN": "boolean", "STRING": "string"}


def _get(doc: Column, field: str) -> Column:
    return F.try_variant_get(doc, f"$.{field}", _AS[TYPES[field][0]])


def _mistyped(doc: Column, field: str) -> Column:
    """Whether a field's JSON value has another type than those it may have."""
    return ~F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{field}", "variant")), F.lit("VOID")).isin(TYPES[field])


def _judged(doc: Column) -> Column:
    names = {"outcome": "outcome", "kind": "kind", "correction_message_index": "correction_index", "window_observed_assistant_turns": "observed_turns", "continuation_ended": "ended"}
    return F.struct(*(_get(doc, f).alias(n) for f, n in names.items()))


def outcome_error(raw: Column, kinds: tuple[str, ...], window: int, phase: str | None = None, schema: str = OUTCOME) -> Column:
    """The first error of an outcome row's JSON text, or null: fields, phase, unlock, types, then the outcome's own rules.

    Only the numbers 0 and 1 are outcomes; ``phase`` is the one that must be, if given.
    """
    doc = F.try_parse_json(raw)
    get = lambda f: _get(doc, f)
    wrong = lambda f: _mistyped(doc, f)
    calibrating = get("phase") == CALIBRATION
    return F.coalesce(
        first_error(
            (doc.isNull(), "outcome_json_invalid"),
            (_other_fields(doc, "$", *TYPES) | wrong("schema") | (get("schema") != schema), "outcome_fields_invalid"),
            (wrong("phase") | ~get("phase").isin(CALIBRATION, PROSPECTIVE), "outcome_phase_invalid"),
            (F.lit(False) if phase is None else get("phase") != phase, "outcome_phase_mismatch"),
            (calibrating & (F.schema_of_variant(F.try_variant_get(doc, "$.outcome_unlock_sha256", "variant")) != "VOID"), "outcome_unlock_forbidden"),
            (~calibrating & (wrong("outcome_unlock_sha256") | ~is_lower_sha256(get("outcome_unlock_sha256"))), "outcome_unlock_invalid"),
            (wrong("outcome") | ~get("outcome").isin(0, 1) | wrong("session_id"), "outcome_value_invalid"),
            (wrong("labeled_at_utc") | parse_instant(get("labeled_at_utc"), utc_only=True).isNull(), "outcome_time_invalid"),
            (wrong("continuation_sha256") | ~is_lower_sha256(get("continuation_sha256")), "outcome_continuation_hash_invalid"),
            (wrong("window_observed_assistant_turns"), "outcome_window_invalid"),
            ((get("window_observed_assistant_turns") < 0) | (get("window_observed_assistant_turns") > window), "outcome_window_invalid"),
            (wrong("continuation_ended") | wrong("notes"), "outcome_metadata_invalid"),
            (wrong("kind"), "outcome_kind_invalid"),
            (wrong("correction_message_index"), "outcome_correction_index_invalid"),
        ),
        outcome(_judged(doc), kinds, window),
    )


def outcome_columns(raw: Column) -> list[Column]:
    """The fields of a valid row."""
    doc = F.try_parse_json(raw)
    return [_get(doc, f).alias(f) for f in TYPES]


def outcome_faults(rows: DataFrame, continuations: DataFrame, kinds: tuple[str, ...], window: int, phase: str, unlock_sha256: str | None = None) -> DataFrame:
    """(line, session_id, fault) of rows (line, raw) that break a rule: each row's first.

    ``continuations`` has session_id, started_at_utc, events, ended and sha256 (the hash
    of its object), as ``read_continuations`` gives them.  After a row's own errors come: a
    session that an earlier line judged, another unlock, no continuation, another
    continuation's hash, a label from before its start, and what its events contradict.
    """
    doc = F.try_parse_json("raw")
    read = rows.select("line", outcome_error(F.col("raw"), kinds, window, phase).alias("_error"), _judged(doc).alias("_o"), *(_get(doc, f).alias(f) for f in ("session_id", "outcome_unlock_sha256", "continuation_sha256", "labeled_at_utc")))
    first = read.filter("session_id IS NOT NULL").groupBy(F.col("session_id").alias("_s")).agg(F.min("line").alias("_first"))
    c = continuations.select(F.col("session_id").alias("_c"), F.struct("started_at_utc", "events", "ended", F.col("sha256").alias("hash")).alias("c"))
    met = read.join(first, F.col("session_id") == F.col("_s"), "left").join(c, F.col("session_id") == F.col("_c"), "left")
    instant = lambda x: parse_instant(F.col(x), utc_only=True)
    fault = F.coalesce(
        "_error",
        first_error(
            (F.col("line") > F.col("_first"), "outcome_session_duplicate"),
            (F.lit(False) if unlock_sha256 is None else F.col("outcome_unlock_sha256") != unlock_sha256, "outcome_unlock_mismatch"),
            (F.col("_c").isNull(), "outcome_continuation_missing"),
            (F.col("continuation_sha256") != F.col("c.hash"), "outcome_continuation_mismatch"),
            (instant("labeled_at_utc") < instant("c.started_at_utc"), "outcome_label_before_start"),
        ),
        outcome_against(F.col("_o"), F.col("c.events"), F.col("c.ended"), window),
    )
    return met.select("line", "session_id", fault.alias("fault")).filter("fault IS NOT NULL")
