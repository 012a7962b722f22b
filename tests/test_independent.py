"""The second way to an evaluation finds the first one's document, and whatever was changed."""

import json
import random

import pytest

from ledgerframe.functions.strict_json import dumps_ascii, object_hash_ascii
from ledgerframe.operators import documents, independent


def trial(n, seed=1, good=0.9):
    r = random.Random(seed)
    rows, outcomes, pairs, before = [], [], [], None
    for k in range(1, n + 1):
        y = int(r.random() < 0.5)
        ours = y if r.random() < good else 1 - y
        theirs = {"always_safe": 0, "length": int(r.random() < 0.5)}
        row = {"schema": "prediction.v1", "session_id": f"s{k}", "primary_prediction": ours, "comparator_predictions": theirs, "previous_prediction_hash": before, "zz": "é"}
        row["prediction_hash"] = object_hash_ascii(row)
        before = object_hash_ascii(row)
        rows.append((k, dumps_ascii(row).decode()))
        outcomes.append((k, json.dumps({"session_id": f"s{k}", "outcome": y})))
        pairs += [(c, f"s{k}", y, ours, p) for c, p in theirs.items()]
    return rows, outcomes, pairs


def tables(spark, rows, outcomes, pairs):
    return spark.createDataFrame(rows, "index long, row string"), spark.createDataFrame(outcomes, "line long, raw string"), spark.createDataFrame(pairs, "comparator string, session_id string, y int, primary int, other int")


@pytest.mark.parametrize("n,seed,good,least", [(20, 1, 0.9, 3), (60, 2, 1.0, 5), (90, 3, 0.5, 5), (6, 4, 0.9, 5)])
def test_both_ways_agree(spark, n, seed, good, least):
    rows, outcomes, pairs = trial(n, seed, good)
    ledger, judged, paired = tables(spark, rows, outcomes, pairs)
    claimed = documents.evaluate(paired, {"trial_id": "t"}, "m", 50_000, 950_000, least).collect()[0].document
    assert independent.verify_evaluation(claimed, ledger, judged, least).collect() == []


def test_changes_are_found(spark):
    rows, outcomes, pairs = trial(20)
    ledger, judged, paired = tables(spark, rows, outcomes, pairs)
    claimed = documents.evaluate(paired, {"trial_id": "t"}, "m", 50_000, 950_000, 3).collect()[0].document
    found = lambda doc, a=ledger, b=judged: {r.pointer for r in independent.verify_evaluation(doc, a, b, 3).collect()}
    told = json.loads(claimed)
    told["primary"]["tp"] += 1
    told["inference"]["length"]["exact_randomization"]["p_numerator"] += "0"
    told["disposition"] = "ELSE"
    assert found(json.dumps(told)) == {"/primary/tp", "/exact/length/p_numerator", "/disposition"}
    flipped = [(k, t.replace('"outcome": 1', '"outcome": 0')) if k == int(next(i for i, x in outcomes if '"outcome": 1' in x)) else (k, t) for k, t in outcomes]
    assert "/class_counts/correction" in found(claimed, b=spark.createDataFrame(flipped, "line long, raw string"))
    assert "/test_n" in found(claimed, a=spark.createDataFrame(rows[:-1], "index long, row string"))


def test_ledgers_by_their_texts(spark):
    rows, *_ = trial(6)
    faults = lambda x: {(r["index"], r.fault) for r in independent.ledger_faults(spark.createDataFrame(x, "index long, row string"), "previous_prediction_hash", "prediction_hash").collect()}
    assert faults(rows) == set()
    changed = [(k, t.replace('"session_id":"s3"', '"session_id":"sX"')) for k, t in rows]
    assert faults(changed) == {(3, "hash_mismatch"), (4, "chain_mismatch")}
    assert faults(rows[:2] + rows[3:]) == {(k, "index_gap") for k in (4, 5, 6)}
    spaced = [(k, t.replace('","', '", "') if k == 2 else t) for k, t in rows]
    assert (3, "chain_mismatch") in faults(spaced)
