"""The prospective trial: registered sessions, sealed predictions, the unlock, labels, alignment.

A ledger is a table of (index, row): the row's JSON text, as it stands in its file.  A
row's hash covers its canonical ASCII text; each row names the hash of the whole row
before it.  Rows meet their predecessors and one another by index and by session, so a
ledger is checked in parallel; only the unlock, which binds whole ledgers, gathers
them, up to ``ledger.MAX_ROWS`` rows.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strict_json import dumps_ascii, object_hash_ascii
from ..functions.text import is_lower_sha256, parse_instant
from .ledger import _gathered
from .validate import first_error

#: Schemas and fields of the ledgers' rows.
ELIGIBILITY, PREDICTION, OUTCOME, UNLOCK = "eligibility.v1", "prediction.v1", "outcome.v1", "outcome-unlock.v1"
ELIGIBILITY_FIELDS = ["schema", "trial_id", "eligibility_index", "session_id", "handoff_at_utc", "registered_at_utc", "protocol_sha256", "freeze_sha256", "session_sha256", "previous_eligibility_hash", "eligibility_hash"]
PREDICTION_FIELDS = [
    "schema", "trial_id", "session_id", "handoff_at_utc", "predicted_at_utc", "protocol_sha256", "freeze_sha256", "receiver_profile_sha256", "session_sha256", "metrics", "features", "primary_prediction",
    "secondary_predictions", "comparator_predictions", "eligibility_index", "eligibility_hash", "previous_prediction_hash", "prediction_hash",
]
_NUMBERS = {"eligibility_index": "bigint", "primary_prediction": "int"}
_HASHED = "struct<canonical:string, whole:string, base:string, fields:array<string>>"


def hashed(row: Column | str, own: str) -> Column:
    """Of a row's JSON text: canonical text, hash of all of it, hash without its own hash, sorted fields; null if it is no object."""

    def one(x: Any) -> tuple:
        try:
            value = None if x is None else json.loads(x)
        except ValueError:
            value = None
        if not isinstance(value, dict):
            return (None,) * 4
        return dumps_ascii(value).decode(), object_hash_ascii(value), object_hash_ascii({k: v for k, v in value.items() if k != own}), sorted(value)

    return F.pandas_udf(lambda rows: pd.DataFrame([one(x) for x in rows], columns=["canonical", "whole", "base", "fields"]), _HASHED)(row)


def _opened(ledger: DataFrame, fields: list[str], own: str) -> DataFrame:
    """(index, h, r, before): hashes and fields of each row, and the hash and fields of the row before."""
    schema = ", ".join(f"{f} {_NUMBERS.get(f, 'string')}" for f in fields)
    rows = ledger.select("index", hashed("row", own).alias("h"), F.from_json("row", schema).alias("r"))
    before = rows.select((F.col("index") + 1).alias("index"), F.struct("h", "r").alias("before"))
    return rows.join(before, "index", "left")


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("r.session_id").alias("_s")).agg((F.count("*") > 1).alias("_again"))


def _in_window(at: Column, start: Column, lag_seconds: int) -> Column:
    return at.between(start, start + F.lit(lag_seconds * 1_000_000))


def chained_rows(rows: DataFrame, order: list[str], document: Column, index_field: str, previous_field: str, own: str, group: list[str] | None = None) -> DataFrame:
    """(index, row): ledger rows of documents (JSON texts) in order, each with its index, its predecessor's hash and its own."""

    def chain(table: pd.DataFrame) -> pd.DataFrame:
        out, before = [], None
        for k, text in enumerate(table["rows"].iloc[0], 1):
            value = {**json.loads(text["document"]), index_field: k, previous_field: before}
            value[own] = object_hash_ascii(value)
            before = object_hash_ascii(value)
            out.append((k, dumps_ascii(value).decode()))
        return pd.DataFrame(out, columns=["index", "row"])

    # One bounded ledger: its rows are folded in one task, as each needs the one before.
    gathered = _gathered(rows, group or [], F.struct(*order, document.alias("document"))).filter("n > 0").withColumn("one", F.lit(1))
    return gathered.groupBy("one").applyInPandas(chain, "index long, row string")


def eligibility_faults(ledger: DataFrame, sessions: DataFrame, trial_id: str, protocol_sha256: str, freeze_sha256: str, frozen_micros: int, max_lag_seconds: int) -> DataFrame:
    """(index, session_id, fault): the first fault of each faulty row; no row: the ledger holds.

    ``sessions`` has session_id, handoff_at_utc and session_sha256.
    """
    rows = _opened(ledger, ELIGIBILITY_FIELDS, "eligibility_hash")
    r, b = F.col("r"), F.col("before.r")
    rows = rows.join(_repeated(rows), F.col("r.session_id") == F.col("_s"), "left")
    known = sessions.select(F.col("session_id").alias("_k"), F.col("handoff_at_utc").alias("_at"), F.col("session_sha256").alias("_hash"))
    rows = rows.join(known, F.col("r.session_id") == F.col("_k"), "left")
    handoff, registered = parse_instant(r["handoff_at_utc"], utc_only=True), parse_instant(r["registered_at_utc"], utc_only=True)
    key = F.struct(handoff, r["session_id"])
    last = F.struct(parse_instant(b["handoff_at_utc"], utc_only=True), b["session_id"])
    fault = first_error(
        ((F.col("h.fields") != F.array_sort(F.array(*map(F.lit, ELIGIBILITY_FIELDS)))) | (r["schema"] != ELIGIBILITY), "eligibility_row_invalid"),
        ((r["trial_id"] != trial_id) | (r["protocol_sha256"] != protocol_sha256), "eligibility_protocol_mismatch"),
        (r["freeze_sha256"] != freeze_sha256, "eligibility_freeze_mismatch"),
        (r["eligibility_index"] != F.col("index"), "eligibility_index_mismatch"),
        ((F.coalesce(r["session_id"], F.lit("")) == "") | F.col("_again"), "eligibility_session_invalid"),
        (handoff <= frozen_micros, "eligibility_not_after_freeze"),
        (~_in_window(registered, handoff, max_lag_seconds), "eligibility_window_missed"),
        (F.col("before").isNotNull() & F.coalesce(key <= last, F.lit(False)), "eligibility_order_broken"),
        (~r["previous_eligibility_hash"].eqNullSafe(F.col("before.h.whole")), "eligibility_chain_mismatch"),
        (r["eligibility_hash"] != F.col("h.base"), "eligibility_hash_mismatch"),
        (F.col("_k").isNull(), "eligibility_session_missing"),
        ((r["handoff_at_utc"] != F.col("_at")) | (r["session_sha256"] != F.col("_hash")), "eligibility_session_mismatch"),
    )
    return rows.select("index", r["session_id"].alias("session_id"), fault.alias("fault")).filter("fault IS NOT NULL")


def prediction_faults(predictions: DataFrame, eligibility: DataFrame, trial_id: str, protocol_sha256: str, freeze_sha256: str, profile_sha256: str, max_lag_seconds: int) -> DataFrame:
    """(index, session_id, fault) as above: the i-th prediction must be that of the i-th registered session."""
    rows = _opened(predictions, PREDICTION_FIELDS, "prediction_hash")
    entry = ", ".join(f"{f} {_NUMBERS.get(f, 'string')}" for f in ELIGIBILITY_FIELDS)
    rows = rows.join(eligibility.select("index", F.from_json("row", entry).alias("e")), "index", "left")
    rows = rows.join(_repeated(rows), F.col("r.session_id") == F.col("_s"), "left")
    r, e = F.col("r"), F.col("e")
    handoff, predicted, registered = (parse_instant(x, utc_only=True) for x in (r["handoff_at_utc"], r["predicted_at_utc"], e["registered_at_utc"]))
    bound = F.lit(True)
    for f in ("session_sha256", "handoff_at_utc", "eligibility_index", "eligibility_hash"):
        bound = bound & r[f].eqNullSafe(e[f])
    fault = first_error(
        (e.isNull(), "prediction_beyond_eligibility"),
        ((F.col("h.fields") != F.array_sort(F.array(*map(F.lit, PREDICTION_FIELDS)))) | (r["schema"] != PREDICTION), "prediction_row_invalid"),
        (r["session_id"].isNull() | F.col("_again"), "prediction_session_invalid"),
        (r["session_id"] != e["session_id"], "prediction_order_broken"),
        (r["trial_id"] != trial_id, "prediction_trial_mismatch"),
        (r["protocol_sha256"] != protocol_sha256, "prediction_protocol_mismatch"),
        (r["freeze_sha256"] != freeze_sha256, "prediction_freeze_mismatch"),
        (r["receiver_profile_sha256"] != profile_sha256, "prediction_profile_mismatch"),
        (~bound, "prediction_binding_mismatch"),
        ((predicted < registered) | ~_in_window(predicted, handoff, max_lag_seconds), "prediction_window_missed"),
        (~r["previous_prediction_hash"].eqNullSafe(F.col("before.h.whole")), "prediction_chain_mismatch"),
        (r["prediction_hash"] != F.col("h.base"), "prediction_hash_mismatch"),
    )
    return rows.select("index", r["session_id"].alias("session_id"), fault.alias("fault")).filter("fault IS NOT NULL")


def sealed(ledger: DataFrame, own: str) -> DataFrame:
    """One row: n, the hash of the whole ledger as a list, and that of its last row."""
    rows = ledger.select("index", hashed("row", own).alias("h")).select(F.struct("index", F.col("h.canonical").alias("text"), F.col("h.whole").alias("whole")).alias("item"))
    g = _gathered(rows, [], F.col("item"))
    text = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda x: x["text"]), ","), F.lit("]"))
    return g.select("n", F.sha2(text, 256).alias("sha256"), F.try_element_at(F.col("rows"), F.lit(-1))["whole"].alias("tail"))


def unlock(eligibility: DataFrame, predictions: DataFrame, trial_id: str, protocol_sha256: str, freeze_sha256: str, test_n: int, generated_at: str) -> DataFrame:
    """One row (unlock, refused): the receipt that binds both whole ledgers, or why outcomes stay locked."""
    e = sealed(eligibility, "eligibility_hash").select(F.col("n").alias("en"), F.col("sha256").alias("eligibility_ledger_sha256"), F.col("tail").alias("eligibility_chain_tail"))
    p = sealed(predictions, "prediction_hash").select(F.col("n").alias("pn"), F.col("sha256").alias("predictions_sha256"), F.col("tail").alias("prediction_chain_tail"))
    last = predictions.select(parse_instant(F.get_json_object("row", "$.predicted_at_utc"), utc_only=True).alias("at")).agg(F.max("at").alias("last"))
    rows = e.crossJoin(p).crossJoin(last)  # three single rows
    code = F.when((F.col("en") != test_n) | (F.col("pn") != test_n), "unlock_sample_incomplete").when(parse_instant(F.lit(generated_at), utc_only=True) < F.col("last"), "unlock_before_last_prediction")
    fields = {"schema": F.lit(UNLOCK), "trial_id": F.lit(trial_id), "generated_at_utc": F.lit(generated_at), "protocol_sha256": F.lit(protocol_sha256), "freeze_sha256": F.lit(freeze_sha256), "test_n": F.lit(test_n)}
    fields |= {c: F.col(c) for c in ("eligibility_ledger_sha256", "eligibility_chain_tail", "predictions_sha256", "prediction_chain_tail")}
    # Canonical in ASCII, as every document of the trial is.
    made = hashed(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), "")["canonical"]
    return rows.select(F.when(code.isNull(), made).alias("unlock"), code.alias("refused"))


def unlock_fault(given: str, eligibility: DataFrame, predictions: DataFrame, trial_id: str, protocol_sha256: str, freeze_sha256: str, test_n: int) -> DataFrame:
    """One row (fault): whether an unlock receipt binds these ledgers; null if it does."""
    try:
        claim = json.loads(given)
    except ValueError:
        claim = None
    claim = claim if isinstance(claim, dict) else {}
    want = unlock(eligibility, predictions, trial_id, protocol_sha256, freeze_sha256, test_n, str(claim.get("generated_at_utc")))
    told = F.from_json("unlock", "map<string,string>")
    text = {k: str(v) for k, v in claim.items()}
    agree = lambda *fields: _all(told[f].eqNullSafe(F.lit(text.get(f))) for f in fields)
    fields = F.lit({*claim} == {"schema", "trial_id", "generated_at_utc", "protocol_sha256", "freeze_sha256", "eligibility_ledger_sha256", "eligibility_chain_tail", "predictions_sha256", "prediction_chain_tail", "test_n"})
    fault = F.coalesce(
        F.when(F.col("refused") == "unlock_sample_incomplete", F.col("refused")), F.when(~fields | F.lit(claim.get("schema") != UNLOCK), "unlock_invalid"), F.when(F.lit(claim.get("trial_id") != trial_id or claim.get("protocol_sha256") != protocol_sha256), "unlock_protocol_mismatch"),
        F.when(F.lit(claim.get("freeze_sha256") != freeze_sha256), "unlock_freeze_mismatch"), F.col("refused"),
        F.when(~agree("eligibility_ledger_sha256", "eligibility_chain_tail", "predictions_sha256", "prediction_chain_tail", "test_n"), "unlock_binding_mismatch"),
    )
    return want.select(fault.alias("fault"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def label(judged: DataFrame, continuations: DataFrame, predictions: DataFrame, unlock_sha256: str, unlocked_micros: int, window: int) -> DataFrame:
    """Outcome rows of judged sessions, and ``refused``: why one cannot be labelled.

    ``judged`` has session_id, outcome, kind, correction_index, notes and
    labeled_at_utc; ``continuations`` has session_id, started_at_utc, events (role, in
    order), ended and sha256; ``predictions`` session_id and predicted_at_utc.
    """
    c = continuations.select("session_id", F.struct("started_at_utc", "events", "ended", "sha256").alias("c"))
    rows = judged.join(predictions.select("session_id", parse_instant(F.col("predicted_at_utc"), utc_only=True).alias("_p")), "session_id", "left").join(c, "session_id", "left")
    at, began = parse_instant(F.col("labeled_at_utc"), utc_only=True), parse_instant(F.col("c.started_at_utc"), utc_only=True)
    positive, i, events = F.col("outcome") == 1, F.col("correction_index"), F.col("c.events")
    turns = lambda a: F.size(F.filter(a, lambda e: e["role"] == "assistant"))
    inside = i.between(0, F.size(events) - 1)
    observed = F.when(positive, turns(F.slice(events, F.lit(1), F.greatest(F.coalesce(i, F.lit(0)), F.lit(0)).cast("int")))).otherwise(F.least(F.lit(window), turns(events)))
    refused = first_error(
        (F.col("_p").isNull(), "label_without_prediction"), (F.col("c").isNull(), "label_without_continuation"), (F.col("_p") >= began, "label_prediction_after_start"), (at < unlocked_micros, "label_before_unlock"), (at <= F.col("_p"), "label_before_prediction"),
        (~F.coalesce(F.col("outcome").isin(0, 1), F.lit(False)), "outcome_value_invalid"), (positive & ~F.coalesce(inside, F.lit(False)), "outcome_correction_index_invalid"), (positive & F.coalesce(F.get(events, i.cast("int"))["role"] != "user", F.lit(True)), "outcome_correction_not_by_user"),
        (positive & (observed > window), "outcome_outside_window"), (~positive & (F.col("kind").isNotNull() | i.isNotNull()), "outcome_negative_with_correction"), (~positive & (observed < window) & ~F.col("c.ended"), "outcome_window_incomplete"), (at < began, "label_before_start"),
        (~is_lower_sha256(F.col("c.sha256")), "outcome_continuation_hash_invalid"),
    )
    return rows.select("session_id", "outcome", "kind", "correction_index", F.col("c.sha256").alias("continuation_sha256"), observed.cast("int").alias("observed_turns"), F.col("c.ended").alias("ended"), "labeled_at_utc", F.lit(unlock_sha256).alias("outcome_unlock_sha256"), "notes", refused.alias("refused"))


def alignment_faults(eligible: DataFrame, predictions: DataFrame, sessions: DataFrame, continuations: DataFrame, outcomes: DataFrame, key: str = "session_id") -> DataFrame:
    """(session_id, missing): sessions that any of the five tables lacks, with the names of those."""
    tables = {"eligibility": eligible, "predictions": predictions, "sessions": sessions, "continuations": continuations, "outcomes": outcomes}
    every = None
    for name, t in tables.items():
        rows = t.select(key, F.lit(name).alias("_in"))
        every = rows if every is None else every.unionByName(rows)
    held = every.groupBy(key).agg(F.collect_set("_in").alias("_in"))
    return held.select(key, F.array_except(F.array(*map(F.lit, tables)), "_in").alias("missing")).filter(F.size("missing") > 0)


def time_faults(predictions: DataFrame, continuations: DataFrame, outcomes: DataFrame, unlocked_micros: int) -> DataFrame:
    """(session_id, fault): predictions that a continuation precedes, and labels before the unlock."""
    micros = lambda c: parse_instant(F.col(c), utc_only=True)
    rows = predictions.join(continuations.select("session_id", "started_at_utc"), "session_id").join(outcomes.select("session_id", "labeled_at_utc"), "session_id")
    fault = first_error((micros("predicted_at_utc") >= micros("started_at_utc"), "prediction_after_start"), (micros("labeled_at_utc") < unlocked_micros, "label_before_unlock"))
    return rows.select("session_id", fault.alias("fault")).filter("fault IS NOT NULL")


def require_complete(rows: DataFrame, primary: str) -> DataFrame:
    """The rows; one whose primary metric is null fails the job."""
    return rows.filter(F.when(F.col(primary).isNotNull(), True).otherwise(F.raise_error(F.lit("primary_metric_incomplete")).cast("boolean")))


def last_handoff(sessions: DataFrame, at: str = "handoff_at_utc") -> DataFrame:
    """The largest handoff time as text, which for one fixed format is the latest."""
    return sessions.agg(F.max(at).alias(at))
