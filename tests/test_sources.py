"""Manifests, artifacts, JSON lines and ledgers of commits from files."""

import json
import threading

import pytest

from ledgerframe.functions.strict_json import dumps_ascii, object_hash_ascii
from ledgerframe.operators import trial as t
from ledgerframe.operators.register import Trial, register, score
from ledgerframe.sources import commits, files


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("b.json", "a.json", "a[1] +%.json"):
        (tmp_path / "d" / n).write_text(n)
    return tmp_path


def test_artifacts_in_order(spark, folder):
    manifest = folder / "m.json"
    manifest.write_text('{"z": "d/b.json", "a": "d/../d/a.json", "z2": "d/b.json", "odd": "d/a[1] +%.json"}')
    got = files.read_artifacts(spark, f"file://{manifest}").orderBy("index").collect()
    assert [(r.evidence_id, bytes(r.content).decode()) for r in got] == [("z", "b.json"), ("a", "a.json"), ("z2", "b.json"), ("odd", "a[1] +%.json")]
    manifest.write_text("{}")
    assert files.read_artifacts(spark, f"file://{manifest}").collect() == []


@pytest.mark.parametrize("text,code", [
    ('{"a":5}', "evidence_manifest_invalid:a"), ('{"a":null}', "evidence_manifest_invalid:a"), ('{"ok":"d/a.json","a":["d/a.json"]}', "evidence_manifest_invalid:a"), ('{"a":"../x"}', "evidence_path_escape:a"), ('{"a":"/etc/passwd"}', "evidence_path_escape:a"),
    ('{"a":"d/../../x"}', "evidence_path_escape:a"), ('{"a":"http://x/y"}', "evidence_path_escape:a"), ('{"a":"."}', "evidence_path_escape:a"), ('{"a":"d/a.json","a":"d/b.json"}', "duplicate_json_key:a"), ("[]", "json_object_required"), ('{"a"', "invalid_json"),
])
def test_artifact_manifests_that_are_refused(spark, folder, text, code):
    (folder / "m.json").write_text(text)
    with pytest.raises(ValueError, match=code.replace("[", r"\[")):
        files.read_artifacts(spark, f"file://{folder}/m.json")


def test_limits_of_artifacts(spark, folder):
    (folder / "m.json").write_text('{"a": "d/a.json", "b": "d/b.json"}')
    for limit, code in (({"max_files": 1}, "evidence_manifest_count_limit_exceeded"), ({"max_bytes": 5}, "file_size_limit_exceeded"), ({"max_total": 11}, "evidence_total_size_limit_exceeded")):
        with pytest.raises(ValueError, match=code):
            files.read_artifacts(spark, f"file://{folder}/m.json", **limit)
    assert files.read_artifacts(spark, f"file://{folder}/m.json", max_files=2, max_bytes=6, max_total=12).count() == 2


@pytest.mark.parametrize("text,code", [("[1]", "file_manifest_invalid:0"), ('["d/a.json", {}]', "file_manifest_invalid:1"), ('["d/a.json", "../x"]', "file_manifest_path_escape:1"), ("{}", "json_array_required")])
def test_file_manifests_that_are_refused(spark, folder, text, code):
    (folder / "m.json").write_text(text)
    with pytest.raises(ValueError, match=code):
        files.read_manifest(spark, f"file://{folder}/m.json")


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n  \n{"k": 2}\n')
    assert sorted((r.line, r.row.k) for r in files.read_lines(spark, f"file://{tmp_path}", "k long").collect()) == [(1, 1), (4, 2)]
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n[2]\n')
    with pytest.raises(ValueError, match="json_line_invalid.*'line': 2.*json_object_required"):
        files.read_lines(spark, f"file://{tmp_path}", "k long")


def test_racing_writers_extend_a_tail_once(spark, tmp_path):
    path, lost = f"file://{tmp_path}/ledger", []
    for index in range(1, 6):
        start = threading.Barrier(4)

        def write(k, index=index, start=start):
            start.wait()
            try:
                commits.commit(spark, path, index, f'{{"by":{k}}}')
            except commits.TailMoved:
                lost.append(index)

        writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
        [w.start() for w in writers]
        [w.join() for w in writers]
    assert sorted(lost) == sorted([*range(1, 6)] * 3)
    rows = commits.read_ledger(spark, path).orderBy("index").collect()
    assert [r["index"] for r in rows] == [1, 2, 3, 4, 5] and all(json.loads(r.row)["by"] in range(4) for r in rows)
    (tmp_path / "ledger" / "00000003.json").unlink()
    with pytest.raises(ValueError, match="ledger_commit_missing"):
        commits.read_ledger(spark, path)
    assert commits.read_ledger(spark, f"file://{tmp_path}/none").collect() == []


TRIAL = Trial("t", "aa" * 32, "bb" * 32, "cc" * 32, 1_704_067_200_000_000, 3600, 3)


def session(k, hour):
    return {"session_id": f"s{k}", "handoff_at_utc": f"2024-02-01T{hour:02}:00:00Z", "session_sha256": f"{k:02}" * 32}


PREDICTION = {"metrics": {"m": 1}, "features": {"é": "x"}, "primary_prediction": 1, "secondary_predictions": {}, "comparator_predictions": {"c": 0}}


def test_register_and_score(spark, tmp_path):
    e, p = f"file://{tmp_path}/eligibility", f"file://{tmp_path}/predictions"
    first = register(spark, e, session(1, 5), TRIAL, "2024-02-01T05:10:00Z")
    assert first["previous_eligibility_hash"] is None and first["eligibility_index"] == 1
    refused = [
        (session(1, 6), "2024-02-01T06:10:00Z", "eligibility_session_invalid"), (session(0, 4), "2024-02-01T04:10:00Z", "eligibility_order_broken:2"), (session(2, 6), "2024-02-01T05:59:59Z", "eligibility_window_missed:2"),
        (session(2, 6), "2024-02-01T07:00:01Z", "eligibility_window_missed:2"), ({**session(2, 6), "handoff_at_utc": "2024-01-01T00:00:00Z"}, "2024-01-01T00:00:00Z", "eligibility_not_after_freeze:2"), ({**session(2, 6), "session_id": ""}, "2024-02-01T06:10:00Z", "eligibility_session_invalid:2"),
    ]
    for given, at, code in refused:
        with pytest.raises(ValueError, match=code):
            register(spark, e, given, TRIAL, at)
    with pytest.raises(ValueError, match="eligibility_protocol_mismatch"):
        register(spark, e, session(2, 6), Trial("other", *list(vars(TRIAL).values())[1:]), "2024-02-01T06:10:00Z")
    second = register(spark, e, session(2, 6), TRIAL, "2024-02-01T06:10:00Z")
    assert second["previous_eligibility_hash"] == object_hash_ascii(first)
    score_one = lambda s, at, **other: score(spark, e, p, s, PREDICTION, Trial(**{**vars(TRIAL), **other}), at)
    for given, at, code in [(session(2, 6), "2024-02-01T06:20:00Z", "prediction_order_broken:1"), (session(1, 5), "2024-02-01T05:09:00Z", "prediction_window_missed:1"), (session(1, 5), "2024-02-01T06:00:01Z", "prediction_window_missed:1"), ({**session(1, 5), "session_sha256": "99" * 32}, "2024-02-01T05:20:00Z", "prediction_binding_mismatch:1")]:
        with pytest.raises(ValueError, match=code):
            score_one(given, at)
    one = score_one(session(1, 5), "2024-02-01T05:20:00Z")
    two = score_one(session(2, 6), "2024-02-01T06:20:00Z")
    assert two["previous_prediction_hash"] == object_hash_ascii(one)
    with pytest.raises(ValueError, match="prediction_beyond_eligibility"):
        score_one(session(3, 7), "2024-02-01T07:20:00Z")
    register(spark, e, session(3, 7), TRIAL, "2024-02-01T07:10:00Z")
    with pytest.raises(ValueError, match="eligibility_sample_complete"):
        register(spark, e, session(4, 8), TRIAL, "2024-02-01T08:10:00Z")
    ledger = commits.read_ledger(spark, p)
    assert t.prediction_faults(ledger, commits.read_ledger(spark, e), "t", TRIAL.protocol_sha256, TRIAL.freeze_sha256, TRIAL.profile_sha256, 3600).collect() == []
    # A row changed behind the ledger's back stops every later append.
    (tmp_path / "predictions" / "00000001.json").write_bytes(dumps_ascii({**one, "primary_prediction": 0}))
    with pytest.raises(ValueError, match="prediction_hash_mismatch:1"):
        score_one(session(3, 7), "2024-02-01T07:20:00Z")


def test_a_lost_race_changes_nothing(spark, tmp_path, monkeypatch):
    """Another writer commits between the read and the commit."""
    from ledgerframe.operators import register as module

    e = f"file://{tmp_path}/eligibility"
    real = module.commit

    def late(spark, path, index, row):
        real(spark, path, index, '{"theirs":1}')
        real(spark, path, index, row)

    monkeypatch.setattr(module, "commit", late)
    with pytest.raises(commits.TailMoved):
        register(spark, e, session(1, 5), TRIAL, "2024-02-01T05:10:00Z")
    assert [r.row for r in commits.read_ledger(spark, e).collect()] == ['{"theirs":1}']
