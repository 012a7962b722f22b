"""Documents of sessions, continuations and protocols, and their sources."""

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions.strict_json import dumps_ascii
from ledgerframe.operators import sessions
from ledgerframe.sources import files

H = "ab" * 32
GRAPH = {
    "claims": [{"id": "c", "content_hash": H, "material": False}],
    "evidence": [{"id": "e", "content_hash": H, "observed": True}],
    "relations": [{"src": "e", "dst": "c", "relation_type": "supports"}],
}
EVENTS = [{"index": 0, "role": "user", "text": "", "tool_name": None}, {"index": 1, "role": "tool", "text": "x", "tool_name": "grep"}]
SESSION = {
    "schema": sessions.SESSION, "session_id": "s", "handoff_at_utc": "2024-01-01T00:00:00Z", "transcript": EVENTS,
    "measurement_input": {"algorithm_id": sessions.ALGORITHM, "signal_points_micros": [0, 1_000_000], "previous_graph": {"claims": [], "evidence": [], "relations": []}, "current_graph": GRAPH},
}
CONTINUATION = {"schema": sessions.CONTINUATION, "session_id": "s", "started_at_utc": "2024-01-01T00:00:00Z", "events": EVENTS, "ended": False}
PROFILE = {
    "profile_id": "p", "signal_schema_id": None, "calibration_status": "uncalibrated_reference", "calibration_corpus_hash": None, **dict.fromkeys(sessions.PROFILE_NUMBERS, 2),
    "calibration_sample_count": 0, "dhol_claim_weight_micros": 333_334, "dhol_evidence_weight_micros": 333_333, "dhol_relation_weight_micros": 333_333,
}
PROTOCOL = {
    "schema": sessions.PROTOCOL, "measurement_contract": {"algorithm_id": sessions.ALGORITHM, "receiver_profile": PROFILE, "profile_authority": "receiver"},
    "primary_inference": {"alpha_micros": 50_000, "confidence_micros": 950_000}, "more": "kept",
}
GONE = object()


def changed(document, path, value):
    made = copy.deepcopy(document)
    at = made
    for k in path[:-1]:
        at = at[k]
    if value is GONE:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return made


def errors(spark, check, cases):
    rows = [(i, x if x is None or isinstance(x, str) else json.dumps(x)) for i, (x, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, "i int, raw string").select("i", check(F.col("raw")).alias("e")).collect()
    assert [r.e for r in sorted(got)] == [e for _, e in cases]


OWN = "measurement_input"


def test_sessions(spark):
    s = lambda *path, to=GONE: changed(SESSION, path, to)
    errors(spark, sessions.session_error, [
        (SESSION, None), (s("transcript", to=[]), None), (s(OWN, "signal_points_micros", to=[]), None),
        (None, "session_json_invalid"), ("", "session_json_invalid"), ("{", "session_json_invalid"), ('{"a":1,"a":2}', "session_json_invalid"),
        ("[]", "session_fields_invalid"), ("null", "session_fields_invalid"), (s("schema"), "session_fields_invalid"), (s("outcome", to=1), "session_fields_invalid"),
        (s("schema", to="session.v0"), "session_identity_invalid"), (s("session_id", to=""), "session_identity_invalid"), (s("session_id", to=7), "session_identity_invalid"), (s("session_id", to=None), "session_identity_invalid"),
        (s("handoff_at_utc", to="2024-01-01T00:00:00+00:30"), "session_time_invalid"), (s("handoff_at_utc", to=3), "session_time_invalid"),
        (s("transcript", to="no"), "session_event_fields_invalid"), (s("transcript", to=[None]), "session_event_fields_invalid"), (s("transcript", 0, "late", to=1), "session_event_fields_invalid"),
        (s("transcript", 0, "tool_name"), "session_event_fields_invalid"), (s("transcript", 0, "index", to="0"), "session_event_fields_invalid"), (s("transcript", 0, "index", to=0.5), "session_event_fields_invalid"), (s("transcript", 0, "text", to=None), "session_event_fields_invalid"),
        (s("transcript", 0, "index", to=1), "transcript_index_not_contiguous"), (s("transcript", 0, "role", to="system"), "transcript_role_invalid"), (s("transcript", 0, "tool_name", to="x"), "transcript_tool_name_invalid"),
        (s("transcript", 1, "tool_name", to=None), "transcript_tool_name_invalid"), (s("transcript", 1, "tool_name", to=""), "transcript_tool_name_invalid"),
        (s(OWN, "weights", to=1), "measurement_fields_invalid"), (s(OWN, to=[]), "measurement_fields_invalid"), (s(OWN, "algorithm_id", to="other"), "measurement_algorithm_unsupported"), (s(OWN, "algorithm_id", to=None), "measurement_algorithm_unsupported"),
        (s(OWN, "signal_points_micros", to=[True]), "signal_invalid"), (s(OWN, "signal_points_micros", to=[1.5]), "signal_invalid"), (s(OWN, "signal_points_micros", to=["1"]), "signal_invalid"), (s(OWN, "signal_points_micros", to=[None]), "signal_invalid"),
        (s(OWN, "signal_points_micros", to=[1_000_001]), "signal_out_of_range"), (s(OWN, "signal_points_micros", to=[-1]), "signal_out_of_range"),
        (s(OWN, "previous_graph", to={}), "graph_fields_invalid"), (s(OWN, "current_graph", "claims", 0, "material", to=1), "graph_claims_invalid"), (s(OWN, "current_graph", "evidence", to=None), "graph_evidence_invalid"),
        (s(OWN, "current_graph", "evidence", 0, "observed", to=False), "graph_evidence_unobserved"), (s(OWN, "current_graph", "relations", 0, "weight", to=1), "graph_relations_invalid"), (s(OWN, "current_graph", "relations", 0, "dst", to="x"), "graph_relation_dangling"),
    ])


def test_continuations(spark):
    c = lambda *path, to=GONE: changed(CONTINUATION, path, to)
    errors(spark, sessions.continuation_error, [
        (CONTINUATION, None), (c("events", to=[]), None), (c("ended"), "continuation_fields_invalid"), (c("ended", to=1), "continuation_ended_invalid"), (c("ended", to=None), "continuation_ended_invalid"),
        (c("session_id", to=""), "continuation_identity_invalid"), (c("started_at_utc", to="today"), "continuation_time_invalid"), (c("events", to=None), "continuation_event_fields_invalid"), (c("events", 1, "index", to=5), "transcript_index_not_contiguous"),
    ])


def test_folders(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "c").mkdir()
    for name in "ab":
        (tmp_path / "s" / f"{name}.json").write_text(json.dumps(changed(SESSION, ("session_id",), name)))
        (tmp_path / "c" / f"{name}.json").write_text(json.dumps(changed(CONTINUATION, ("session_id",), name), indent=1))
    got = {r.session_id: r for r in files.read_sessions(spark, str(tmp_path / "s")).collect()}
    assert got["a"].points == [0, 1_000_000] and got["a"].transcript[1].tool_name == "grep" and got["b"].current_graph.relations[0].dst == "c" and got["b"].previous_graph.claims == []
    assert got["a"].sha256 == hashlib.sha256((tmp_path / "s" / "a.json").read_bytes()).hexdigest()
    got = {r.session_id: r for r in files.read_continuations(spark, str(tmp_path / "c")).collect()}
    assert got["b"].sha256 == hashlib.sha256(dumps_ascii(changed(CONTINUATION, ("session_id",), "b"))).hexdigest() and got["b"].ended is False and len(got["b"].events) == 2
    (tmp_path / "s" / "again.json").write_text(json.dumps(changed(SESSION, ("session_id",), "a")))
    with pytest.raises(Exception, match="session_duplicate"):
        files.read_sessions(spark, str(tmp_path / "s"))
    (tmp_path / "s" / "again.json").write_text("{}")
    with pytest.raises(Exception, match="session_invalid"):
        files.read_sessions(spark, str(tmp_path / "s"))


def test_protocols():
    made = sessions.protocol_profile(PROTOCOL)
    assert (made.claim_weight, made.epsilon_window, made.i_c, made.kappa_critical) == (333_334, 2, 2, 2)
    at = ("measurement_contract", "receiver_profile")
    for path, to, code in (
        (("schema",), "x", "protocol_schema"), (("measurement_contract",), None, "protocol_algorithm"), (("measurement_contract", "profile_authority"), "producer", "protocol_authority"), (("primary_inference",), GONE, "protocol_inference"),
        (("primary_inference", "alpha_micros"), 0, "protocol_inference"), (("primary_inference", "alpha_micros"), True, "protocol_inference"), (("primary_inference", "confidence_micros"), 1_000_000, "protocol_inference"),
        ((*at, "extra"), 1, "profile_fields"), ((*at, "i_c_micros"), 0, "profile_window"), ((*at, "epsilon_window"), 1, "profile_window"), ((*at, "phi_min_micros"), -1, "profile_value"), ((*at, "phi_min_micros"), True, "profile_value"),
        ((*at, "profile_id"), "é", "profile_id"), ((*at, "signal_schema_id"), "", "profile_signal_schema"), ((*at, "calibration_status"), "calibrated", "profile_calibration"), ((*at, "calibration_status"), [], "profile_status"),
        ((*at, "calibration_corpus_hash"), H, "profile_calibration"), ((*at, "dhol_claim_weight_micros"), 1, "profile_weights"),
    ):
        with pytest.raises(ValueError, match=code):
            sessions.protocol_profile(changed(PROTOCOL, path, to))
    full = changed(changed(changed(PROTOCOL, (*at, "calibration_status"), "calibrated"), (*at, "calibration_corpus_hash"), H), (*at, "calibration_sample_count"), 500)
    assert sessions.protocol_profile(full) == made
    with pytest.raises(ValueError, match="profile_calibration"):
        sessions.protocol_profile(changed(full, (*at, "calibration_sample_count"), 499))
