"""From signed bytes to decisions: intake of receipts, claims on artifacts, the gate."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import status
from ..functions.strict_json import StrictError, dumps, loads, resolve
from ..functions.text import parse_instant
from . import gate
from .envelopes import AdapterProfile, inspected
from .validate import SOURCE_SCHEMA

_ACTION = "struct<type:string,name:string>"
_TYPED = f"struct<issued_at:string,action:{_ACTION},evidence:array<struct<id:string,sha256:string>>>"


def same(a: Any, b: Any) -> bool:
    """Equal values of one type at the top (true is not 1)."""
    return type(a) is type(b) and a == b


def inspections(receipts: DataFrame, adapters: list[AdapterProfile] = [], max_bytes: int = 1 << 20) -> DataFrame:  # noqa: B006  never changed
    """Adds ``_i``, what each receipt's adapter finds, and ``_limit``, why none looked.

    A receipt's ``source_format`` (native if the column is missing) picks the adapter;
    an adapter sees no other receipts and none over the limit.
    """
    if max_bytes < 1:
        raise ValueError("max_source_bytes_invalid")
    rows = receipts if "source_format" in receipts.columns else receipts.withColumn("source_format", F.lit(SOURCE_SCHEMA))
    known = [SOURCE_SCHEMA, *(a.source_format for a in adapters)]
    limit = F.when(~F.coalesce(F.octet_length("raw") <= max_bytes, F.lit(False)), "source_size_limit_exceeded").when(~F.coalesce(F.col("source_format").isin(known), F.lit(False)), "source_format_unsupported")
    rows = rows.withColumn("_limit", limit)
    mine = lambda name: F.col("_limit").isNull() & (F.col("source_format") == name)
    looks = [inspected, *(a.inspected for a in adapters)]
    for k, (name, look) in enumerate(zip(known, looks, strict=True)):
        rows = rows.withColumn(f"_i{k}", look(F.when(mine(name), F.col("raw"))))
    found = F.coalesce(*(F.when(mine(name), F.col(f"_i{k}")) for k, name in enumerate(known)))
    return rows.withColumn("_i", found).drop(*(f"_i{k}" for k in range(len(known))))


def pins(trust: DataFrame) -> DataFrame:
    """(key_id, trusted): the pinned key of each id; an id with two keys fails the job."""
    one = F.when(F.min("trusted") < F.max("trusted"), F.raise_error(F.concat(F.lit("trust_key_duplicate:"), F.first("key_id")))).otherwise(F.max("trusted"))
    return trust.groupBy("key_id").agg(one.alias("trusted"))


def intake(receipts: DataFrame, trust: DataFrame, max_bytes: int = 1 << 20, adapters: list[AdapterProfile] = []) -> DataFrame:  # noqa: B006  never changed
    """Adds integrity, provenance and normalization checks, the payload and hashes to receipts.

    ``receipts`` has raw bytes, ``trust`` has key_id and trusted.  A payload that
    fails integrity is kept; it is null if the bytes are too large, do not parse or
    hold no object, and {} counts as none.
    """
    rows = inspections(receipts, adapters, max_bytes)
    pinned = pins(trust).withColumnRenamed("key_id", "_key")
    rows = rows.join(pinned, F.col("_i.key_id") == F.col("_key"), "left")
    errors, native, limit = F.col("_i.errors"), F.col("source_format") == SOURCE_SCHEMA, F.col("_limit")
    checked = lambda s, code: gate.check(F.lit(s), code)
    unread = lambda own: F.when(native, own).otherwise("foreign_receipt_unavailable")
    looked = lambda c: F.when(limit.isNotNull(), checked(status.UNAVAILABLE, limit)).otherwise(c)
    sound = F.size(errors) == 0
    integrity = F.struct(F.when(sound, status.PASS).otherwise(status.FAIL).alias("status"), errors.alias("reason_codes"), F.coalesce("_i.integrity_details", F.lit("{}")).alias("details"))
    provenance = F.when(~F.col("_i.readable"), checked(status.UNAVAILABLE, unread("source_integrity_failed"))).when(~sound, checked(status.UNAVAILABLE, F.lit("source_integrity_failed"))).otherwise(gate.provenance_check(F.col("_i.public_key"), F.col("trusted"), F.col("_i.key_id")))
    normalization = F.when(~F.col("_i.readable"), checked(status.UNAVAILABLE, unread("source_payload_unavailable"))).when(F.col("_i.normalization").isNotNull(), checked(status.FAIL, F.col("_i.normalization"))).otherwise(gate.check(F.lit(status.PASS), details=F.col("_i.normalization_details")))
    out = rows.withColumns({
        "payload": F.when(F.col("_i.payload") != "{}", F.col("_i.payload")), "key_id": F.col("_i.key_id"),
        "integrity": F.when(limit == "source_size_limit_exceeded", checked(status.FAIL, limit)).otherwise(looked(integrity)), "provenance": looked(provenance), "normalization": looked(normalization),
        "source_sha256": F.sha2("raw", 256), "envelope_hash": F.col("_i.envelope_hash"),
    })
    return out.drop("_i", "_limit", "_key", "trusted")


def claim_support(policy: gate.Policy):
    """A function of a map of artifacts: the check of all claim rules, strictly parsed."""
    rules = [(r.rule_id, r.evidence_id, r.pointer, dumps(r.expected)) for r in policy.claim_rules]

    needed = {r.evidence_id for r in policy.claim_rules}

    def parsed(content: Any) -> Any:
        try:
            return loads(content.encode() if isinstance(content, str) else bytes(content))
        except StrictError as e:
            return e

    def one(artifacts: dict) -> tuple[str, list[str], str]:
        if not rules:
            return status.UNAVAILABLE, ["claim_rules_missing"], '{"evaluated":[]}'
        documents = {k: parsed(v) for k, v in artifacts.items() if k in needed and v is not None}
        failed, absent, seen = [], [], []
        for rule, evidence, pointer, expected in rules:
            document = documents.get(evidence)
            if evidence not in documents:
                absent.append(f"claim_artifact_missing:{rule}")
            elif isinstance(document, StrictError):
                failed.append(f"claim_evidence_invalid_json:{rule}")
            else:
                try:
                    matched = same(resolve(document, pointer), loads(expected))
                except StrictError:
                    failed.append(f"claim_fact_missing:{rule}")
                    continue
                seen.append({"rule_id": rule, "evidence_id": evidence, "pointer": pointer, "matched": matched})
                failed += [] if matched else [f"claim_fact_mismatch:{rule}"]
        worst = status.FAIL if failed else status.UNAVAILABLE if absent else status.PASS
        return worst, sorted(failed + absent), dumps({"evaluated": seen}).decode()

    def checked(ids: pd.Series, contents: pd.Series) -> pd.DataFrame:
        # Many receipts rest on the same artifacts: each distinct set is parsed once a batch.
        keys = [() if i is None else tuple(zip(i, c, strict=True)) for i, c in zip(ids, contents, strict=True)]
        found = {k: one(dict(k)) for k in {*keys}}
        made = [found[k] for k in keys]
        return pd.DataFrame(made, columns=["status", "reason_codes", "details"])

    return lambda artifacts: F.pandas_udf(checked, "struct<status:string, reason_codes:array<string>, details:string>")(F.map_keys(artifacts), F.map_values(artifacts))


def commitment(evidence: Column, required: str) -> Column:
    """The committed hash of an evidence id; of several the last."""
    return F.get(F.reverse(F.filter(evidence, lambda e: e["id"] == required)), F.lit(0))["sha256"]


def evidence_of(policy: gate.Policy, evidence: Column, artifacts: Column, unclear: Column | None = None) -> Column:
    """All required evidence of a policy: the worst status, reasons in the policy's order.

    An id in ``unclear`` has artifacts of different contents and fails.
    """
    if not policy.required_evidence:
        return gate.check(F.lit(status.PASS), details=F.lit('{"verified":[]}'))
    twice = lambda e: F.lit(False) if unclear is None else F.coalesce(F.array_contains(unclear, e), F.lit(False))
    parts = [F.when(twice(e), gate.check(F.lit(status.FAIL), F.lit(f"artifact_duplicate:{e}"))).otherwise(gate.evidence_check(e, commitment(evidence, e), F.try_element_at(artifacts, F.lit(e)))) for e in policy.required_evidence]
    good = F.array_compact(F.array(*(F.when(p["status"] == status.PASS, F.lit(e)) for e, p in zip(policy.required_evidence, parts, strict=True))))
    return F.struct(status.name(status.worst(*(p["status"] for p in parts))).alias("status"), F.flatten(F.array(*(p["reason_codes"] for p in parts))).alias("reason_codes"), F.to_json(F.struct(good.alias("verified"))).alias("details"))


def assessments(policy: gate.Policy, now_micros: int) -> dict[str, Column]:
    """The seven assessments of rows that have been taken in, with ``_issued``, ``_p`` (what the payload holds) and artifacts as ``artifact_maps`` has them."""
    p = F.col("_p")
    gone = gate.check(F.lit(status.UNAVAILABLE), F.lit("source_payload_unavailable"))
    present = lambda c: F.when(F.col("payload").isNull(), gone).otherwise(c)
    return {
        "integrity": F.col("integrity"), "provenance": F.col("provenance"), "normalization": F.col("normalization"),
        "policy": present(gate.action_check(p["action"]["type"], policy)),
        "freshness": present(gate.freshness_check(F.col("_issued"), now_micros, policy)),
        "evidence": present(evidence_of(policy, p["evidence"], F.col("_a"), F.col("_unclear"))),
        "claim_support": present(claim_support(policy)(F.col("_a"))),
    }


def artifact_maps(artifacts: DataFrame, policy: gate.Policy) -> DataFrame:
    """(receipt_id, _a, _unclear): each receipt's artifacts by evidence id, as many as its policy requires.

    An id with artifacts of different contents has none, and is among the unclear.
    """
    needed = artifacts.filter(F.col("evidence_id").isin(*policy.required_evidence)).groupBy("receipt_id", "evidence_id").agg(F.max("content").alias("content"), (F.min("content") < F.max("content")).alias("unclear"))
    entry = F.when(~F.col("unclear"), F.struct("evidence_id", "content"))
    return needed.groupBy("receipt_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_a"), F.collect_list(F.when(F.col("unclear"), F.col("evidence_id"))).alias("_unclear"))


def decide_taken_in(rows: DataFrame, artifacts: DataFrame, policy: gate.Policy, now_micros: int, side_effect: Column | None = None, keep: bool = False) -> DataFrame:
    """Decisions on rows that ``intake`` or ``chain.verify_chains`` took in, by receipt_id: for several policies, one intake serves."""
    return gate.decide(placed(rows, artifacts, policy), assessments(policy, now_micros), policy, side_effect, keep).drop(*PLACED)


#: What ``placed`` adds to rows.
PLACED = ("_a", "_unclear", "_issued", "_p")


def placed(rows: DataFrame, artifacts: DataFrame, policy: gate.Policy) -> DataFrame:
    """Rows with all that ``assessments`` reads: any policy that requires no other evidence can follow.

    A payload is parsed once: the assessments read columns.
    """
    out = rows.join(artifact_maps(artifacts, policy), "receipt_id", "left").withColumn("_p", F.from_json("payload", _TYPED))
    return out.withColumn("_issued", parse_instant(F.col("_p.issued_at")))


def decide_receipts(receipts: DataFrame, artifacts: DataFrame, trust: DataFrame, policy: gate.Policy, now_micros: int, side_effect: Column | None = None, max_bytes: int = 1 << 20, adapters: list[AdapterProfile] = [], keep: bool = False) -> DataFrame:  # noqa: B006  never changed
    """Decisions on (receipt_id, raw) with artifacts (receipt_id, evidence_id, content).

    With ``keep`` the assessments, which a signed decision holds, are kept.
    """
    return decide_taken_in(intake(receipts, trust, max_bytes, adapters), artifacts, policy, now_micros, side_effect, keep)
