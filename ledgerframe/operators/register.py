"""Extending a trial's ledgers: register a session, score it; one commit each, after every rule holds.

The candidate is checked as the ledger's next row by the rules that hold for ledgers
(``trial.eligibility_faults`` and ``trial.prediction_faults``), so what can be appended
is exactly what verifies.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strict_json import dumps_ascii, object_hash_ascii
from ..sources.commits import commit, read_ledger
from . import trial as t


@dataclasses.dataclass(frozen=True)
class Trial:
    """What a protocol and a freeze fix for all rows."""

    trial_id: str
    protocol_sha256: str
    freeze_sha256: str
    profile_sha256: str
    frozen_micros: int
    max_lag_seconds: int
    test_n: int


def _tail(ledger: DataFrame) -> tuple[int, dict | None]:
    """The number of rows, and the last of them."""
    last = ledger.orderBy(F.desc("index")).limit(1).collect()
    return (last[0]["index"], json.loads(last[0].row)) if last else (0, None)


def _sealed(row: dict, before: dict | None, previous: str, own: str) -> dict:
    row = {**row, previous: None if before is None else object_hash_ascii(before)}
    return {**row, own: object_hash_ascii(row)}


def _require(faults: DataFrame) -> None:
    first = faults.orderBy("index").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].fault}:{first[0]['index']}")


def _with(ledger: DataFrame, index: int, row: dict) -> DataFrame:
    return ledger.unionByName(ledger.sparkSession.createDataFrame([(index, dumps_ascii(row).decode())], "index long, row string"))


def register(spark: SparkSession, path: str, session: dict, trial: Trial, registered_at: str) -> dict:
    """Append a session (session_id, handoff_at_utc, session_sha256) to the eligibility ledger; returns its row.

    Refused with the ledger's own codes: a faulty ledger, a repeated session, a handoff not
    after the freeze, a missed window, an earlier handoff found late (order), and more
    sessions than the protocol fixes (``eligibility_sample_complete``).  A writer that
    lost the race gets ``TailMoved`` and may try again.
    """
    ledger = read_ledger(spark, path)
    n, before = _tail(ledger)
    if n >= trial.test_n:
        raise ValueError("eligibility_sample_complete")
    base = {
        "schema": t.ELIGIBILITY, "trial_id": trial.trial_id, "eligibility_index": n + 1, "registered_at_utc": registered_at, "protocol_sha256": trial.protocol_sha256, "freeze_sha256": trial.freeze_sha256,
        **{k: session[k] for k in ("session_id", "handoff_at_utc", "session_sha256")},
    }
    row = _sealed(base, before, "previous_eligibility_hash", "eligibility_hash")
    extended = _with(ledger, n + 1, row)
    # Earlier rows were bound to their sessions' documents when they were appended.
    known = extended.select(F.from_json("row", "session_id string, handoff_at_utc string, session_sha256 string").alias("r")).select("r.*").dropDuplicates(["session_id"])
    _require(t.eligibility_faults(extended, known, trial.trial_id, trial.protocol_sha256, trial.freeze_sha256, trial.frozen_micros, trial.max_lag_seconds))
    commit(spark, path, n + 1, dumps_ascii(row).decode())
    return row


def score(spark: SparkSession, eligibility_path: str, path: str, session: dict, prediction: dict, trial: Trial, predicted_at: str) -> dict:
    """Append the prediction of the next registered session; returns its row.

    ``prediction`` has metrics, features, primary_prediction, secondary_predictions and
    comparator_predictions.  Refused: a session that is not the next one of the
    eligibility ledger or differs from its entry, a time before registration or beyond the
    window, a faulty ledger, and more predictions than the protocol fixes.
    """
    eligibility, ledger = read_ledger(spark, eligibility_path), read_ledger(spark, path)
    n, before = _tail(ledger)
    if n >= trial.test_n:
        raise ValueError("prediction_sample_complete")
    entry = eligibility.filter(F.col("index") == n + 1).collect()
    if not entry:
        raise ValueError("prediction_beyond_eligibility")
    entry = json.loads(entry[0].row)
    base = {
        "schema": t.PREDICTION, "trial_id": trial.trial_id, **{k: session[k] for k in ("session_id", "handoff_at_utc", "session_sha256")}, "predicted_at_utc": predicted_at, "protocol_sha256": trial.protocol_sha256,
        "freeze_sha256": trial.freeze_sha256, "receiver_profile_sha256": trial.profile_sha256, **{k: prediction[k] for k in ("metrics", "features", "primary_prediction", "secondary_predictions", "comparator_predictions")},
        "eligibility_index": entry["eligibility_index"], "eligibility_hash": entry["eligibility_hash"],
    }
    row = _sealed(base, before, "previous_prediction_hash", "prediction_hash")
    _require(t.prediction_faults(_with(ledger, n + 1, row), eligibility, trial.trial_id, trial.protocol_sha256, trial.freeze_sha256, trial.profile_sha256, trial.max_lag_seconds))
    commit(spark, path, n + 1, dumps_ascii(row).decode())
    return row
