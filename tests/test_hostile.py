"""Hostile and unusual input: repeated names, half surrogates, instants, repeated keys and artifacts, batches of signatures."""

import json
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import ed25519
from ledgerframe.functions.strict_json import StrictError, canonical, dumps, loads
from ledgerframe.functions.text import parse_instant
from ledgerframe.operators import envelopes, gateway
from ledgerframe.operators.gate import Policy, Rule

SEEDS = [bytes([k]) * 32 for k in (1, 2, 3)]


@pytest.mark.parametrize("text,name", [("{" + ",".join(['"a":1'] * 170_000) + "}", "a"), ("{" + ",".join(f'"k{i}":1' for i in range(60_000)) + ',"k59999":2}', "k59999"), ('{"x":{"b":1,"c":2,"b":3},"x":1}', "b")])
def test_repeated_names_of_a_large_document(text, name):
    began = time.perf_counter()
    with pytest.raises(StrictError, match=f"^duplicate_json_key:{name}$"):
        loads(text.encode())
    assert time.perf_counter() - began < 2


def test_half_surrogates_are_no_canonical_text(spark):
    for bad in (r'"\ud800"', r'{"\udc00":1}', r'["\ud83d x"]'):
        with pytest.raises(StrictError, match="invalid_json"):
            loads(bad.encode())
    assert loads('"🙂 é"'.encode()) == "🙂 é"
    got = spark.createDataFrame([(r'{"a":"\ud800"}',), ('{"b":2,"a":1}',)], "t string").select(canonical("t").alias("c")).collect()
    assert [tuple(r.c) for r in got] == [(None, "invalid_json"), ('{"a":1,"b":2}', None)]


@pytest.mark.parametrize("value,code", [(1.5, "float_unsupported:$"), ({"a": [1, float("nan")]}, r"float_unsupported:$.a[1]"), ({1: 2}, "non_string_key:$"), ({"a": {"b", "c"}}, "unsupported_type:$.a:set"), ({"a": {None: 1}}, "non_string_key:$.a")])
def test_values_that_are_no_json(value, code):
    with pytest.raises(StrictError) as e:
        dumps(value)
    assert str(e.value) == code


def test_values_at_the_limits():
    deep = lambda n: json.loads("[" * n + "]" * n)
    assert dumps(deep(129)) == dumps(deep(129), known=True)
    with pytest.raises(StrictError, match="json_depth_limit_exceeded"):
        dumps(deep(130))
    with pytest.raises(StrictError, match="json_node_limit_exceeded"):
        dumps([0] * 100_000)
    assert dumps({"b": (1, 2), "a": True}) == b'{"a":true,"b":[1,2]}'


DATES = ["2024-01-01", "20240229", "2023-02-29", "2024-W01-3", "2020W537", "2021-W53-1", "0001-01-01", "9999-12-31", "2024-13-01", "2024-1-1", "2024-0101"]
TIMES = ["T00:00", "T00", "T000000", "T23:59:59.1", " 12:34:56,1234567", "t12", "T24:00", "T23:60", "T23:59:60", "T1:00", "T00:0000", ""]
ZONES = ["Z", "+00:00", "-0530", "+05:30:15.5", "-23:59:59", "+24:00", "z", "", "+5", "+00:00Z"]


def python_s_instant(x):
    try:
        at = datetime.fromisoformat(x[:-1] + "+00:00" if x.endswith("Z") else x)
        return None if at.tzinfo is None else (at.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    except (ValueError, OverflowError):
        return None


def test_instants_equal_python_s(spark):
    texts = sorted({d + t + z for d in DATES for t in TIMES for z in ZONES} | {"", "Z", "2024-01-01T00:00:00Z\n", "２０２４-01-01T00Z", "2024-01-01😀00:00Z"})
    rows = spark.createDataFrame([(x,) for x in texts] + [(None,)], "x string").select("x", parse_instant(F.col("x")).alias("any"), parse_instant(F.col("x"), utc_only=True).alias("utc")).collect()
    want = {x: python_s_instant(x) for x in texts} | {None: None}
    assert {r.x: r.any for r in rows} == want
    assert {r.x: r.utc for r in rows} == {x: v if x is not None and x.endswith("Z") else None for x, v in want.items()}
    assert sum(v is not None for v in want.values()) > 150


def test_batches_of_signatures_equal_single_ones():
    messages = [b"message %d" % i for i in range(40)]
    seeds = [SEEDS[0] if i < 30 else SEEDS[i % 3] for i in range(40)]
    signatures = ed25519.sign_many(seeds, messages)
    assert signatures == [ed25519.sign(s, m) for s, m in zip(seeds, messages)]
    keys = [ed25519.public_key(s).hex() for s in seeds]
    texts = [s.hex() for s in signatures]
    order = 2**252 + 27742317777372353535851937790883648493
    texts[3] = texts[3][:64] + (int.from_bytes(signatures[3][32:], "little") + order).to_bytes(32, "little").hex()  # the same scalar, not reduced
    texts[5], texts[7], texts[9], keys[11], keys[13], keys[15] = "00" * 64, texts[7][:-2], None, "ff" * 32, keys[13].upper(), None
    texts[17] = ("0" if texts[17][0] != "0" else "1") + texts[17][1:]
    messages[19] += b"!"
    got = ed25519.verify_many(keys, texts, messages)
    assert got == [ed25519.verify(k, s, m) for k, s, m in zip(keys, texts, messages)]
    assert [i for i, ok in enumerate(got) if not ok] == [3, 5, 7, 9, 11, 15, 17, 19]
    assert ed25519.verify_many([], [], []) == ed25519.sign_many([], []) == []


def test_openssl_and_numpy_agree(monkeypatch):
    """Hostile keys, scalars and points too; Python here has OpenSSL's Ed25519."""
    messages = [b"message %d" % i for i in range(24)]
    seeds = [SEEDS[i % 3] for i in range(24)]
    signatures, keys = ed25519.sign_many(seeds, messages), [ed25519.public_key(s).hex() for s in seeds]
    small = [bytes(32), (1).to_bytes(32, "little"), (ed25519.P - 1).to_bytes(32, "little"), (ed25519.P + 1).to_bytes(32, "little"), (1 | 1 << 255).to_bytes(32, "little")]
    forged = [(k, r + (s).to_bytes(32, "little"), b"m") for k in small for r in small for s in (0, 1, ed25519.Q - 1, ed25519.Q)]
    every = [*zip(keys, [s.hex() for s in signatures], messages), *((k.hex(), s.hex(), m) for k, s, m in forged), (keys[0], signatures[0].hex(), b"")]
    ask = lambda: ed25519.verify_many(*map(list, zip(*every)))
    assert ed25519._crypto() is not None
    native = ask()
    monkeypatch.setattr(ed25519, "_crypto", lambda: None)
    assert ask() == native and ed25519.sign_many(seeds, messages) == signatures
    assert all(native[:24]) and not native[-1]


POLICY = Policy("p", "1", ("act",), ("e",), (Rule("r", "e", "/ok", 1),), 10**9)


def receipts(spark):
    import hashlib

    payload = {"schema": "source.v1", "issuer": "i", "issued_at": "20240101T000000+0000", "run_id": "r", "sequence": 0, "action": {"type": "act", "name": "n"}, "claim": "c", "evidence": [{"id": "e", "sha256": hashlib.sha256(b'{"ok":1}').hexdigest()}]}
    raw = dumps(envelopes.issue(payload, SEEDS[0].hex(), "k"))
    return spark.createDataFrame([(1, bytearray(raw))], "receipt_id int, raw binary")


def decided(spark, artifacts, keys):
    trust = spark.createDataFrame(keys, "key_id string, trusted string")
    files = spark.createDataFrame([(1, "e", bytearray(x)) for x in artifacts], "receipt_id int, evidence_id string, content binary")
    r = gateway.decide_receipts(receipts(spark), files, trust, POLICY, 1_704_067_300_000_000).collect()[0]
    return r.decision, r.reason_codes


def test_repeated_keys_and_artifacts_fail_closed(spark):
    key = ed25519.public_key(SEEDS[0]).hex()
    good = b'{"ok":1}'
    assert decided(spark, [good], [("k", key)]) == ("COMMIT", [])
    assert decided(spark, [good, good], [("k", key), ("k", key)]) == ("COMMIT", [])
    assert decided(spark, [good, b'{"ok":2}'], [("k", key)]) == ("DENY", ["claim_support:claim_artifact_missing:r", "evidence:artifact_duplicate:e"])
    with pytest.raises(Exception, match="trust_key_duplicate:k"):
        decided(spark, [good], [("k", key), ("k", ed25519.public_key(SEEDS[1]).hex())])


def test_a_question_of_a_batch_is_answered_once():
    def task(x):
        if x is None:
            return "none"
        return (yield x)

    key, signature = ed25519.public_key(SEEDS[0]).hex(), ed25519.sign(SEEDS[0], b"m").hex()
    assert ed25519.settle([task(None), task((key, signature, b"m")), task((key, signature, b"n"))]) == ["none", True, False]
    assert ed25519.settle([]) == []
