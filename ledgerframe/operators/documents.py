"""A trial's freeze and evaluation as single canonical documents, made of distributed aggregates.

Each part is an aggregate of its own; only their few rows meet, as JSON, and the
document is the canonical ASCII text of them all.  It binds its inputs by hashes, so a
reader recomputes it and compares: ``differences`` names by JSON pointer what is not the same.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import staged
from . import evaluation
from .trial import hashed

FREEZE, EVALUATION = "freeze.v1", "evaluation.v1"
#: The parts of a fit or a classification that documents hold.
RATES = ["tp", "tn", "fp", "fn", "sensitivity_micros", "specificity_micros", "balanced_accuracy_micros", "accuracy_micros"]


def _sealed(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(document, sha256) of one row's fields; a field that is null stays null."""
    text = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})
    return rows.select(hashed(text, "").alias("h")).select(F.col("h.canonical").alias("document"), F.col("h.whole").alias("sha256"))


def _one(*tables: DataFrame) -> DataFrame:
    """The single rows of tables side by side."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(t)  # single rows
    return out


def _by_name(rows: DataFrame, name: str, value: Column, as_: str) -> DataFrame:
    """One row: a map of all rows by their names, of which there are as many as a protocol lists."""
    return rows.select(F.struct(F.col(name).alias("name"), value.alias("value")).alias("e")).agg(F.map_from_entries(F.array_sort(F.collect_list("e"), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))).alias(as_))


def _manifest(entries: DataFrame) -> DataFrame:
    """One row (n, last, ids, manifest) of entries (at, id, text): how many, the latest time, the ids in order, and the hash of the texts as a list; no row of none.

    The texts are made in parallel.  A hash takes its bytes in order, so they pass one
    hasher as a sorted stream: only the ids, which the document lists, are held.
    """

    def fold(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, last, ids = hashlib.sha256(b"["), None, []
        for table in tables:
            for at, id_, text in zip(table["at"], table["id"], table["text"], strict=True):
                digest.update(("," if ids else "").encode() + text.encode())
                last = last if at is None else at
                ids.append(id_)
        digest.update(b"]")
        if ids:
            yield pd.DataFrame({"n": [len(ids)], "last": [last], "ids": [ids], "manifest": [digest.hexdigest()]})

    return entries.repartition(1).sortWithinPartitions("at", "id", "text").mapInPandas(fold, "n long, last string, ids array<string>, manifest string")


def freeze(calibration: DataFrame, values: DataFrame, primary: tuple[str, str], secondary: dict[str, str], comparators: dict[str, str], head: dict[str, Any], input_count: int) -> DataFrame:
    """One row (document, sha256): thresholds fitted to the calibration sessions, and what they were fitted to.

    ``calibration`` has session_id, handoff_at_utc, session_sha256, continuation_sha256 and
    outcome, ``values`` session_id, metric and value.  ``primary`` is a metric and its
    direction (high or low), ``secondary`` and ``comparators`` name directions by metric; a
    secondary metric that any session lacks is unavailable, a primary or a comparator's
    fails the job.  ``head`` goes in as it stands (trial, protocol, time, hashes of the
    contract and the profile).  The manifest's hash binds every session's and
    continuation's bytes and outcome.  The document lists the sessions' ids, so it grows
    with them; their entries do not come together.  Without sessions there is no row.
    """
    directions = {**comparators, **secondary, primary[0]: primary[1]}
    rows = calibration.select("session_id", F.col("outcome").alias("y")).join(values, "session_id").filter(F.col("value").isNotNull())
    fits = None
    for direction in sorted({*directions.values()}):
        names = [m for m, d in directions.items() if d == direction]
        fit = evaluation.fit_threshold(rows.filter(F.col("metric").isin(names)), direction).withColumn("direction", F.lit(direction))
        fits = fit if fits is None else fits.unionByName(fit)
    have = rows.groupBy("metric").agg(F.countDistinct("session_id").alias("have"))
    fits = _by_name(fits.join(have, "metric"), "metric", F.struct("have", F.struct("direction", "threshold", *RATES).alias("fit")), "fits")
    safe = F.struct("session_id", F.lit("always_safe").alias("comparator"), F.col("outcome").alias("y"), F.lit(0).alias("pred"))
    safe = evaluation.confusion(calibration.select(safe.alias("s")).select("s.*"), ["comparator"]).select(F.struct(F.lit("fixed").alias("type"), F.lit(0).alias("prediction"), *RATES).alias("safe"))
    entry = F.struct("session_id", "session_sha256", "continuation_sha256", "outcome")
    told = _manifest(calibration.select(F.col("handoff_at_utc").alias("at"), F.col("session_id").alias("id"), hashed(F.to_json(entry), "")["canonical"].alias("text")))
    fit = lambda m: F.try_element_at(F.col("fits"), F.lit(m))
    complete = lambda m: F.coalesce(fit(m)["have"] == F.col("n"), F.lit(False))
    needed = lambda m: F.when(complete(m), fit(m)["fit"]).otherwise(F.raise_error(F.lit(f"metric_incomplete:{m}")).cast(fits.schema["fits"].dataType.valueType["fit"].dataType))
    parts = lambda m, **more: F.struct(*(v.alias(k) for k, v in more.items()), *(needed(m)[c].alias(c) for c in ("direction", "threshold", *RATES)))
    second = {m: F.struct(F.when(complete(m), "frozen").otherwise("unavailable").alias("status"), F.when(complete(m), fit(m)["fit"]).alias("fit")) for m in secondary}
    fields = {k: F.lit(v) for k, v in head.items()} | {
        "schema": F.lit(FREEZE), "calibration_n": F.col("n"), "calibration_max_handoff_at_utc": F.col("last"), "calibration_manifest_sha256": F.col("manifest"),
        "calibration_selection": F.struct(F.lit("most_recent_pre_freeze").alias("rule"), F.lit(input_count).alias("input_session_count"), F.col("ids").alias("selected_session_ids")),
        "primary": parts(primary[0], metric=F.lit(primary[0])), "secondary": F.struct(*(v.alias(m) for m, v in second.items())) if second else F.create_map().cast("map<string,string>"),
        "comparators": F.struct(F.col("safe").alias("always_safe"), *(parts(m, type=F.lit("threshold")).alias(m) for m in comparators)),
    }
    return _sealed(_one(told, fits, safe), fields)


_RULE = "struct<type:string,metric:string,direction:string,threshold:bigint,prediction:int>"


def frozen_rules(freeze: DataFrame) -> DataFrame:
    """(sha256, role, name, metric, direction, threshold, prediction): the rules of a freeze (document, sha256), a row each.

    They are the primary, and every comparator by its name: a threshold on a metric or a
    fixed prediction.
    """
    d = F.from_json("document", f"primary {_RULE}, comparators map<string,{_RULE}>")
    rule = lambda role, name, metric, r: F.struct(F.lit(role).alias("role"), name.alias("name"), metric.alias("metric"), *(r[c].alias(c) for c in ("direction", "threshold", "prediction")))
    first = rule("primary", F.col("d.primary.metric"), F.col("d.primary.metric"), F.col("d.primary"))
    others = F.transform(F.map_entries("d.comparators"), lambda e: rule("comparator", e["key"], F.when(e["value"]["type"] == "threshold", e["key"]), e["value"]))
    return freeze.select("sha256", d.alias("d")).select("sha256", F.explode(F.concat(F.array(first), others)).alias("r")).select("sha256", "r.*")


def frozen_pairs(rules: DataFrame, sessions: DataFrame, values: DataFrame) -> DataFrame:
    """(comparator, session_id, y, primary, other): what the rules of a freeze predict for sessions it has not seen.

    ``rules`` come from ``frozen_rules``, ``sessions`` has session_id and y, ``values``
    session_id, metric and value.  A session without a rule's metric fails the job.
    Predictions are staged: the tests of an evaluation read them, not the tables behind.
    """
    met = sessions.select("session_id", "y").crossJoin(F.broadcast(rules)).join(values.filter("value IS NOT NULL"), ["session_id", "metric"], "left")  # a few rules
    absent = F.raise_error(F.concat(F.lit("metric_incomplete:"), F.col("name"))).cast("int")
    beyond = F.when(F.col("direction") == "high", F.col("value") >= F.col("threshold")).when(F.col("direction") == "low", F.col("value") <= F.col("threshold")).cast("int")
    pred = F.when(F.col("metric").isNull(), F.col("prediction")).when(F.col("value").isNull(), absent).otherwise(beyond)
    met = staged(met.select("session_id", "y", "role", "name", pred.alias("pred")), "predictions")
    ours = met.filter("role = 'primary'").select("session_id", F.col("pred").alias("primary"))
    return met.filter("role = 'comparator'").select(F.col("name").alias("comparator"), "session_id", "y", F.col("pred").alias("other")).join(ours, "session_id").select("comparator", "session_id", "y", "primary", "other")


def evaluate(pairs: DataFrame, bound: dict[str, Any], primary: str, alpha_micros: int, confidence_micros: int, least_per_class: int) -> DataFrame:
    """One row (document, sha256): the primary against every comparator, and the verdict.

    ``pairs`` has comparator, session_id, y, primary and other, every session once for each
    comparator.  ``bound`` goes in as it stands: the trial, the time, and the hashes of what
    was evaluated.  The exact tests run only if both classes have ``least_per_class``
    sessions; their integers, which have no bound, are digits as text.
    """
    tail = (1_000_000 - confidence_micros) // 2
    tests = evaluation.permutation_test(pairs, alpha_micros=alpha_micros)
    spans = evaluation.bootstrap_interval(pairs, low=(tail, 1_000_000), high=(1_000_000 - tail, 1_000_000))
    kind = F.struct(*RATES)
    ours = evaluation.confusion(pairs, ["comparator"], pred="primary")
    ours = ours.orderBy("comparator").limit(1).select(kind.alias("ours"), (F.col("tp") + F.col("fn")).alias("pos"), (F.col("tn") + F.col("fp")).alias("neg"))
    theirs = evaluation.confusion(pairs, ["comparator"], pred="other")
    best = evaluation.best_comparator(theirs).select(F.col("comparator").alias("best"), F.col("balanced_accuracy_micros").alias("best_ba"))
    exact = F.struct("observed", "discordant_n", "p_numerator", "p_denominator", "p_micros", "significant")
    span = F.struct("lower_numerator", "upper_numerator", "lower_micros", "upper_micros", "resample_space")
    inferred = _by_name(tests.join(spans, "comparator", "left"), "comparator", F.struct(exact.alias("exact_randomization"), span.alias("bootstrap")), "inferred")
    verdict = evaluation.disposition(pairs, tests, least_pos=least_per_class, least_neg=least_per_class)
    rows = _one(ours, _by_name(theirs, "comparator", kind, "theirs"), best, inferred, verdict)
    enough = (F.col("pos") >= least_per_class) & (F.col("neg") >= least_per_class)
    fields = {k: F.lit(v) for k, v in bound.items()} | {
        "schema": F.lit(EVALUATION), "test_n": F.col("pos") + F.col("neg"), "class_counts": F.struct(F.col("pos").alias("correction"), F.col("neg").alias("no_correction")), "eligible_for_primary_verdict": enough,
        "primary": F.struct(F.lit(primary).alias("metric"), *(F.col(f"ours.{c}").alias(c) for c in RATES)), "comparators": F.col("theirs"), "inference": F.when(enough, F.col("inferred")),
        "best_comparator": F.col("best"), "primary_minus_best_comparator_balanced_accuracy_micros": F.col("ours.balanced_accuracy_micros") - F.col("best_ba"),
        "primary_gate": F.struct(F.col("beats_all").alias("strictly_beats_all_comparators"), F.col("significant_against_all").alias("exact_randomization_p_le_alpha_against_all"), F.lit(alpha_micros).alias("alpha_micros"), F.lit(confidence_micros).alias("confidence_micros")),
        "disposition": F.col("disposition"),
    }
    return _sealed(rows, fields)


_MISSING = object()


def _differences(a: Any, b: Any, at: str = "") -> list[str]:
    if type(a) is not type(b) or not isinstance(a, (dict, list)):
        return [] if type(a) is type(b) and a == b else [at]
    keys = sorted({*a} | {*b}) if isinstance(a, dict) else range(max(len(a), len(b)))
    get = (lambda x, k: x.get(k, _MISSING)) if isinstance(a, dict) else (lambda x, k: x[k] if k < len(x) else _MISSING)
    name = lambda k: str(k).replace("~", "~0").replace("/", "~1")
    return [d for k in keys for d in _differences(get(a, k), get(b, k), f"{at}/{name(k)}")]


def differences(claimed: Column | str, recomputed: Column | str) -> Column:
    """JSON pointers, in order, of what two documents do not share with the same type and value; ``""`` where one is no JSON."""

    def one(a: Any, b: Any) -> list[str]:
        try:
            return _differences(json.loads(a), json.loads(b))
        except (TypeError, ValueError, RecursionError):
            return [""]

    return F.pandas_udf(lambda a, b: pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object), "array<string>")(claimed, recomputed)


def check_document(claimed: str, recomputed: DataFrame) -> DataFrame:
    """(pointer): where a document differs from the one that its inputs give; no row: it holds."""
    return recomputed.select(F.explode(differences(F.lit(claimed), "document")).alias("pointer"))
