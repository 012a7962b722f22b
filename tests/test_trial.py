"""Outcome files, order in time, and the small parts of a trial."""

import json
import time

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import ed25519
from ledgerframe.functions.strict_json import StrictError, loads, pretty
from ledgerframe.functions.text import now_micros, parse_now
from ledgerframe.operators import evaluation, outcomes, trial
from ledgerframe.sources import files

ROW = {
    "schema": "outcome.v1", "phase": "prospective", "session_id": "s1", "outcome": 1, "kind": "corrected", "correction_message_index": 2, "continuation_sha256": "ab" * 32,
    "window_observed_assistant_turns": 1, "continuation_ended": False, "labeled_at_utc": "2024-01-02T00:00:00Z", "outcome_unlock_sha256": "ee" * 32, "notes": "",
}
EVENTS = "array<struct<index:bigint,role:string,text:string,tool_name:string>>"


def talks(spark):
    events = [(i, r, "t", None) for i, r in enumerate(["user", "assistant", "user", "assistant", "assistant"])]
    rows = [(f"s{k}", "2024-01-01T00:00:00Z", events, False, "ab" * 32) for k in (1, 2)]
    return spark.createDataFrame(rows, f"session_id string, started_at_utc string, events {EVENTS}, ended boolean, sha256 string")


def read(spark, tmp_path, *rows, **options):
    (tmp_path / "o.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return files.read_outcomes(spark, f"file://{tmp_path}/o.jsonl", talks(spark), ("corrected",), 3, options.get("phase", "prospective"), options.get("unlock", "ee" * 32))


def test_outcome_file(spark, tmp_path):
    negative = {**ROW, "session_id": "s2", "outcome": 0, "kind": None, "correction_message_index": None, "window_observed_assistant_turns": 3}
    got = read(spark, tmp_path, ROW, "", "  ", negative).orderBy("line").collect()
    assert [(r.line, r.session_id, r.outcome, r.kind, r.correction_message_index) for r in got] == [(1, "s1", 1, "corrected", 2), (4, "s2", 0, None, None)]
    calibration = {**ROW, "phase": "calibration", "outcome_unlock_sha256": None}
    assert read(spark, tmp_path, calibration, phase="calibration", unlock=None).count() == 1


@pytest.mark.parametrize("change,code", [
    ({"outcome": True}, "outcome_value_invalid"), ({"outcome": "1"}, "outcome_value_invalid"), ({"correction_message_index": "2"}, "outcome_correction_index_invalid"), ({"correction_message_index": 1}, "outcome_correction_not_by_user"), ({"correction_message_index": -1}, "outcome_correction_index_invalid"),
    ({"kind": "other"}, "outcome_kind_invalid"), ({"notes": None}, "outcome_metadata_invalid"), ({"window_observed_assistant_turns": 1.0}, "outcome_"), ({"phase": "calibration"}, "outcome_phase_mismatch"), ({"window_observed_assistant_turns": 2}, "outcome_turn_count_mismatch"),
    ({"continuation_ended": True}, "outcome_ended_mismatch"), ({"outcome_unlock_sha256": None}, "outcome_unlock_invalid"), ({"session_id": "s9"}, "outcome_continuation_missing"),
])
def test_outcome_rules(spark, tmp_path, change, code):
    with pytest.raises(ValueError, match=code):
        read(spark, tmp_path, {**ROW, **change})


def test_the_earliest_line_s_first_fault_is_told(spark, tmp_path):
    with pytest.raises(ValueError, match="'line': 2, .*outcome_session_duplicate"):
        read(spark, tmp_path, ROW, ROW, "not json")
    with pytest.raises(ValueError, match="'line': 1, .*outcome_json_invalid"):
        read(spark, tmp_path, '{"a":1,"a":2}', {**ROW, "outcome": 5})
    rows = spark.createDataFrame([(1, json.dumps({**ROW, "phase": "calibration"}))], "line int, raw string")
    assert outcomes.outcome_faults(rows, talks(spark), ("corrected",), 3, "calibration").collect()[0].fault == "outcome_unlock_forbidden"


def test_times(spark):
    stamp = lambda s: spark.createDataFrame([(k, v) for k, v in s.items()], "session_id string, at string")
    predictions = stamp({"a": "2024-01-01T00:00:00Z", "b": "2024-01-01T01:00:00Z", "c": "2024-01-01T00:00:00Z", "d": "no"}).withColumnRenamed("at", "predicted_at_utc")
    started = stamp({k: "2024-01-01T01:00:00Z" for k in "abcd"}).withColumnRenamed("at", "started_at_utc")
    labels = stamp({"a": "2024-01-03T00:00:00Z", "b": "2024-01-03T00:00:00Z", "c": "2024-01-02T23:59:59Z", "d": "2024-01-03T00:00:00Z"}).withColumnRenamed("at", "labeled_at_utc")
    got = {r.session_id: r.fault for r in trial.time_faults(predictions, started, labels, parse_now("2024-01-03T00:00:00Z")).collect()}
    assert got == {"b": "prediction_after_start", "c": "label_before_unlock", "d": "prediction_after_start"}
    assert trial.last_handoff(started.withColumnRenamed("started_at_utc", "handoff_at_utc")).collect()[0][0] == "2024-01-01T01:00:00Z"


def test_primary_metric_must_be_complete(spark):
    rows = spark.createDataFrame([(1, 2), (2, None)], "id int, m int")
    assert trial.require_complete(rows.filter("id = 1"), "m").count() == 1
    with pytest.raises(Exception, match="primary_metric_incomplete"):
        trial.require_complete(rows, "m").collect()


def test_accuracy_to_one_place(spark):
    rows = spark.createDataFrame([("a", k < 5) for k in range(8)] + [("b", True)], "track string, hit boolean")
    got = {r.track: (r.n, r.correct, r.accuracy_percent) for r in evaluation.accuracy_percent(rows, "track", "hit").collect()}
    assert got == {"a": (8, 5, 62.5), "b": (1, 1, 100.0)}


def test_clocks_keys_and_indented_text():
    assert parse_now("1970-01-01T01:00:00+01:00") == 0 and parse_now("1970-01-01T00:00:00.000001Z") == 1
    with pytest.raises(ValueError, match="timestamp_timezone_missing"):
        parse_now("2024-01-01T00:00:00")
    assert abs(now_micros() - time.time() * 1e6) < 5e6
    seeds = {ed25519.generate_seed() for _ in range(3)}
    assert len(seeds) == 3 and all(len(bytes.fromhex(s)) == 32 for s in seeds)
    assert pretty({"b": ["é"], "a": 1}) == '{\n  "a": 1,\n  "b": [\n    "é"\n  ]\n}\n' and loads(pretty({"b": 1}).encode()) == {"b": 1}
    with pytest.raises(StrictError, match="float_unsupported"):
        pretty(1.5)
