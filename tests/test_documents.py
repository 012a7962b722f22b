"""Freeze and evaluation documents: their parts, what they bind, and where two differ."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators import documents as doc
from ledgerframe.operators import evaluation
from ledgerframe.plans import derived, trial

HEAD = {"trial_id": "t", "protocol_sha256": "aa" * 32, "generated_at_utc": "2024-03-01T00:00:00Z"}


def canonical(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"))


def sessions(n=12):
    return [(f"é{k:02}", f"2024-02-{k % 9 + 1:02}T00:00:00Z", f"{k:02}" * 32, f"{k + 50:02}" * 32, int(k % 3 == 0)) for k in range(n)]


def frozen(spark, rows, values=None):
    values = values or [(s, m, (k * 7) % 10 + (3 if y else 0)) for k, (s, *_, y) in enumerate(rows) for m in ("p", "q", "c")]
    calibration = spark.createDataFrame(rows, "session_id string, handoff_at_utc string, session_sha256 string, continuation_sha256 string, outcome int")
    return doc.freeze(calibration, spark.createDataFrame(values, "session_id string, metric string, value int"), ("p", "high"), {"q": "low", "none": "high"}, {"c": "high"}, HEAD, 30)


def test_freeze(spark):
    rows = sessions()
    r = frozen(spark, rows).collect()[0]
    d = json.loads(r.document)
    assert r.document == canonical(d) and r.sha256 == hashlib.sha256(r.document.encode()).hexdigest()
    ordered = sorted(rows, key=lambda x: (x[1], x[0]))
    manifest = [{"session_id": s, "session_sha256": h, "continuation_sha256": c, "outcome": y} for s, _, h, c, y in ordered]
    assert d["calibration_manifest_sha256"] == hashlib.sha256(canonical(manifest).encode()).hexdigest()
    assert d["calibration_selection"] == {"rule": "most_recent_pre_freeze", "input_session_count": 30, "selected_session_ids": [x[0] for x in ordered]}
    assert (d["calibration_n"], d["calibration_max_handoff_at_utc"]) == (12, max(x[1] for x in rows))
    assert d["secondary"]["none"] == {"status": "unavailable", "fit": None} and d["secondary"]["q"]["status"] == "frozen" and d["secondary"]["q"]["fit"]["direction"] == "low"
    safe = d["comparators"]["always_safe"]
    assert (safe["tp"], safe["tn"], safe["fp"], safe["fn"], safe["type"]) == (0, 8, 0, 4, "fixed") and d["comparators"]["c"]["type"] == "threshold"
    values = spark.createDataFrame([("p", (k * 7) % 10 + (3 if y else 0), y) for k, (*_, y) in enumerate(rows)], "metric string, value int, y int")
    fit = evaluation.fit_threshold(values, "high").collect()[0]
    assert d["primary"] == {"metric": "p", "direction": "high", **{c: fit[c] for c in ("threshold", *doc.RATES)}}


def test_a_changed_session_changes_the_freeze(spark):
    rows = sessions()
    claimed = frozen(spark, rows).collect()[0].document
    assert doc.check_document(claimed, frozen(spark, rows)).collect() == []
    changed = [(*x[:2], "ff" * 32, *x[3:]) if k == 5 else x for k, x in enumerate(rows)]
    assert [r.pointer for r in doc.check_document(claimed, frozen(spark, changed)).collect()] == ["/calibration_manifest_sha256"]
    other = json.loads(claimed)
    other["primary"]["threshold"] += 1
    other["calibration_selection"]["selected_session_ids"].pop()
    assert sorted(r.pointer for r in doc.check_document(json.dumps(other), frozen(spark, rows)).collect()) == ["/calibration_selection/selected_session_ids/11", "/primary/threshold"]
    assert [r.pointer for r in doc.check_document("no json", frozen(spark, rows)).collect()] == [""]


def test_a_primary_that_a_session_lacks_fails(spark):
    rows = sessions(4)
    with pytest.raises(Exception, match="metric_incomplete:p"):
        frozen(spark, rows, [(x[0], m, 1) for x in rows for m in ("p", "q", "c") if (x[0], m) != ("é01", "p")]).collect()


PAIRS = [(c, str(k), int(k % 2), int(k % 2 if k % 5 else 1), int((k + (c == "b")) % 3 == 0)) for c in ("a", "b") for k in range(16)]


def test_evaluation(spark):
    pairs = spark.createDataFrame(PAIRS, "comparator string, session_id string, y int, primary int, other int")
    r = doc.evaluate(pairs, {"trial_id": "t", "freeze_sha256": "bb" * 32}, "p", 50_000, 950_000, 3).collect()[0]
    d = json.loads(r.document)
    assert r.document == canonical(d) and r.sha256 == hashlib.sha256(r.document.encode()).hexdigest()
    assert (d["test_n"], d["class_counts"], d["eligible_for_primary_verdict"], d["freeze_sha256"]) == (16, {"correction": 8, "no_correction": 8}, True, "bb" * 32)
    tests = {x.comparator: x for x in evaluation.permutation_test(pairs).collect()}
    spans = {x.comparator: x for x in evaluation.bootstrap_interval(pairs).collect()}
    for c in "ab":
        assert d["inference"][c]["exact_randomization"]["p_numerator"] == tests[c].p_numerator
        assert {k: d["inference"][c]["bootstrap"][k] for k in ("lower_micros", "upper_micros")} == {"lower_micros": spans[c].lower_micros, "upper_micros": spans[c].upper_micros}
    ba = {c: d["comparators"][c]["balanced_accuracy_micros"] for c in "ab"}
    assert d["best_comparator"] == min(ba, key=lambda c: (-ba[c], c))
    assert d["primary_minus_best_comparator_balanced_accuracy_micros"] == d["primary"]["balanced_accuracy_micros"] - max(ba.values())
    assert d["disposition"] == evaluation.disposition(pairs, evaluation.permutation_test(pairs), least_pos=3, least_neg=3).collect()[0].disposition
    few = json.loads(doc.evaluate(pairs, {}, "p", 50_000, 950_000, 9).collect()[0].document)
    assert (few["disposition"], few["inference"], few["eligible_for_primary_verdict"]) == ("INSUFFICIENT_SAMPLE", None, False)


def test_differences(spark):
    cases = [
        ('{"a":1}', '{"a":1}', []), ('{"a":1}', '{"a":true}', ["/a"]), ('{"a":1}', '{"a":1.0}', ["/a"]), ('{"a":{"x/y":[1,2]}}', '{"a":{"x/y":[1,3,4]}}', ["/a/x~1y/1", "/a/x~1y/2"]), ('{"a~":null}', "{}", ["/a~0"]), ("[]", "{}", [""]), ("3", "3", []),
        ('{"p":"99999999999999999999999999"}', '{"p":"99999999999999999999999998"}', ["/p"]), ("{", "{}", [""]), (None, "{}", [""]),
    ]
    df = spark.createDataFrame([(a, b, i) for i, (a, b, _) in enumerate(cases)], "a string, b string, i int")
    assert {r.i: r.d for r in df.select("i", doc.differences("a", "b").alias("d")).collect()} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_more_sessions_than_a_ledger_holds(spark):
    n = 4500
    rows = [(f"s{k}", f"2024-02-{k % 9 + 1:02}T00:00:00Z", f"{k:064}", f"{k + 1:064}", int(k % 3 == 0)) for k in range(n)]
    d = json.loads(frozen(spark, rows).collect()[0].document)
    ordered = sorted(rows, key=lambda x: (x[1], x[0]))
    manifest = [{"session_id": s, "session_sha256": h, "continuation_sha256": c, "outcome": y} for s, _, h, c, y in ordered]
    assert d["calibration_manifest_sha256"] == hashlib.sha256(canonical(manifest).encode()).hexdigest()
    assert d["calibration_n"] == n and d["calibration_selection"]["selected_session_ids"] == [x[0] for x in ordered]


def test_rules_of_a_freeze_predict(spark):
    freeze = frozen(spark, sessions())
    d = json.loads(freeze.collect()[0].document)
    high, c = d["primary"]["threshold"], d["comparators"]["c"]["threshold"]
    rules = doc.frozen_rules(freeze)
    assert {(r.role, r.name, r.metric, r.direction, r.threshold, r.prediction) for r in rules.collect()} == {("primary", "p", "p", "high", high, None), ("comparator", "always_safe", None, None, None, 0), ("comparator", "c", "c", "high", c, None)}
    new = spark.createDataFrame([(f"n{k}", k % 2) for k in range(4)], "session_id string, y int")
    values = [(f"n{k}", m, t - 2 + k) for k in range(4) for m, t in (("p", high), ("c", c), ("q", 0))]
    got = {(r.comparator, r.session_id): (r.y, r.primary, r.other) for r in doc.frozen_pairs(rules, new, spark.createDataFrame(values, "session_id string, metric string, value int")).collect()}
    assert got == {(name, f"n{k}"): (k % 2, int(k >= 2), int(k >= 2 and name == "c")) for k in range(4) for name in ("always_safe", "c")}
    low = rules.withColumn("direction", F.lit("low"))
    assert {r.session_id: r.primary for r in doc.frozen_pairs(low, new, spark.createDataFrame(values, "session_id string, metric string, value int")).collect()} == {f"n{k}": int(k <= 2) for k in range(4)}
    with pytest.raises(Exception, match="metric_incomplete:c"):
        doc.frozen_pairs(rules, new, spark.createDataFrame([v for v in values if v[:2] != ("n1", "c")], "session_id string, metric string, value int")).collect()


def test_the_freeze_decides_the_evaluation(spark):
    sf = "/root/testdata/sf0.01"
    freeze = json.loads(trial.freeze_document(spark, sf).collect()[0].document)
    told = json.loads(trial.evaluation_document(spark, sf).collect()[0].document)
    y = {r.session_id: r.y for r in evaluation.most_recent(derived.outcomes(spark, sf), trial.N).collect()}
    value = {(r.session_id, r.metric): r.value for r in derived.predictors(spark, sf).collect()}
    cells = lambda m, t: {name: sum(1 for s in y if y[s] == label and int(value[s, m] >= t) == pred) for name, label, pred in (("tp", 1, 1), ("fn", 1, 0), ("tn", 0, 0), ("fp", 0, 1))}
    of = lambda part: {k: part[k] for k in ("tp", "fn", "tn", "fp")}
    assert sorted(told["comparators"]) == ["always_safe", "n_points"]
    assert of(told["primary"]) == cells("peak", freeze["primary"]["threshold"])
    assert of(told["comparators"]["n_points"]) == cells("n_points", freeze["comparators"]["n_points"]["threshold"])
    assert of(told["comparators"]["always_safe"]) == {"tp": 0, "fp": 0, "fn": sum(y.values()), "tn": len(y) - sum(y.values())}
