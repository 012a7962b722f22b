"""Queries of the prospective trial: its documents, its ledgers, the unlock, labels and alignment, the ledgers over the newest twenty sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, evaluation, outcomes, sessions, trial
from ..sources.stages import staged
from . import derived as d
from .derived import OUTCOMES, table
from .queries import _COUNTED, _LABELLED, _RATES, query

PROTOCOL, FREEZE, PROFILE = "aa" * 32, "bb" * 32, "cc" * 32
FROZEN = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
N = 20
_HOUR = 3600


def _iso(micros):
    return F.concat(F.replace(F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def _sessions(spark, sf_dir):
    """The newest sessions with times as text."""
    s = evaluation.most_recent(d.outcomes(spark, sf_dir), N)
    at = F.col("handoff_micros")
    return s.select(F.col("session_id").cast("string").alias("session_id"), at, _iso(at).alias("handoff_at_utc"), F.sha2(F.col("session_id").cast("string"), 256).alias("session_sha256"))


def _eligibility(spark, sf_dir):
    lag = F.when(F.col("session_id").cast("long") % 11 == 0, 2 * _HOUR * 1_000_000).otherwise(60_000_000)
    registered = _iso(F.col("handoff_micros") + lag)
    document = F.to_json(F.struct(F.lit(trial.ELIGIBILITY).alias("schema"), F.lit("t").alias("trial_id"), "session_id", "handoff_at_utc", registered.alias("registered_at_utc"), F.lit(PROTOCOL).alias("protocol_sha256"), F.lit(FREEZE).alias("freeze_sha256"), "session_sha256"))
    return trial.chained_rows(_sessions(spark, sf_dir), ["handoff_micros", "session_id"], document, "eligibility_index", "previous_eligibility_hash", "eligibility_hash")


def _predictions(spark, sf_dir, eligibility):
    e = eligibility.select("index", *(F.get_json_object("row", f"$.{c}").alias(c) for c in ("session_id", "handoff_at_utc", "session_sha256", "eligibility_hash")))
    predicted = F.replace("handoff_at_utc", F.lit("2024-"), F.when(F.col("index") % 7 == 0, F.lit("2023-")).otherwise(F.lit("2024-")))
    later = F.get_json_object("row", "$.registered_at_utc")
    e = e.join(eligibility.select("index", later.alias("registered_at_utc")), "index").withColumn("predicted", F.when(F.col("index") % 7 == 0, predicted).otherwise(F.col("registered_at_utc")))
    empty = F.create_map().cast("map<string,string>")
    document = F.to_json(F.struct(F.lit(trial.PREDICTION).alias("schema"), F.lit("t").alias("trial_id"), "session_id", "handoff_at_utc", F.col("predicted").alias("predicted_at_utc"), F.lit(PROTOCOL).alias("protocol_sha256"), F.lit(FREEZE).alias("freeze_sha256"), F.lit(PROFILE).alias("receiver_profile_sha256"), "session_sha256", empty.alias("metrics"), empty.alias("features"), F.lit(1).alias("primary_prediction"), empty.alias("secondary_predictions"), empty.alias("comparator_predictions"), "eligibility_hash"))
    return trial.chained_rows(e, ["index"], document, "eligibility_index", "previous_prediction_hash", "prediction_hash")


_NEWEST = f"WITH {OUTCOMES}, newest AS (SELECT *, row_number() OVER (ORDER BY handoff_micros, CAST(session_id AS VARCHAR)) AS i FROM (SELECT * FROM outcomes ORDER BY handoff_micros DESC, session_id DESC LIMIT {N}))"
_FAULTS = "CASE WHEN i % 4 = 0 THEN 'eligibility_protocol_mismatch' WHEN session_id % 11 = 0 THEN 'eligibility_window_missed' WHEN i % 4 = 1 AND i > 1 THEN 'eligibility_chain_mismatch' WHEN i % 6 = 2 THEN 'eligibility_session_missing' END"


@query(f"{_NEWEST} SELECT i AS index, CAST(session_id AS VARCHAR) AS session_id, {_FAULTS} AS fault FROM newest WHERE {_FAULTS} IS NOT NULL")
def eligibility_faults(spark, sf_dir):
    ledger = _eligibility(spark, sf_dir)
    changed = ledger.withColumn("row", F.when(F.col("index") % 4 == 0, F.replace("row", F.lit(PROTOCOL), F.lit("dd" * 32))).otherwise(F.col("row")))
    gone = ledger.filter("index % 6 = 2").select(F.get_json_object("row", "$.session_id").alias("session_id"))
    sessions = _sessions(spark, sf_dir).join(gone, "session_id", "left_anti")
    return trial.eligibility_faults(changed, sessions, "t", PROTOCOL, FREEZE, FROZEN, _HOUR)


_PREDICTED = "CASE WHEN i % 6 = 2 THEN 'prediction_order_broken' WHEN i % 7 = 0 OR session_id % 11 = 0 THEN 'prediction_window_missed' WHEN i % 6 = 3 THEN 'prediction_chain_mismatch' END"


@query(f"{_NEWEST} SELECT i AS index, CASE WHEN i % 6 = 2 THEN 'z' ELSE CAST(session_id AS VARCHAR) END AS session_id, {_PREDICTED} AS fault FROM newest WHERE {_PREDICTED} IS NOT NULL")
def prediction_faults(spark, sf_dir):
    eligibility = _eligibility(spark, sf_dir)
    rows = _predictions(spark, sf_dir, eligibility)
    other = F.regexp_replace("row", '"session_id":"[0-9]+"', '"session_id":"z"')
    first = F.col("index") % 6 == 2
    # Distinct ids of nobody: a repeated id would be a fault of its own.
    rows = rows.withColumn("row", F.when(first & (F.col("index") == 2), other).when(first, F.regexp_replace("row", '"session_id":"[0-9]+"', F.concat(F.lit('"session_id":"z'), F.col("index").cast("string"), F.lit('"')))).otherwise(F.col("row")))
    out = trial.prediction_faults(rows, eligibility, "t", PROTOCOL, FREEZE, PROFILE, _HOUR)
    return out.withColumn("session_id", F.when(F.col("index") % 6 == 2, "z").otherwise(F.col("session_id")))


_TEXT = "'{\"eligibility_hash\":\"' || h || '\",' || body || '}'"


@query(f"""WITH RECURSIVE {_NEWEST.removeprefix('WITH ')}, parts AS (
  SELECT i, '"freeze_sha256":"{FREEZE}","handoff_at_utc":"' || ts || 'Z",' AS a, '"protocol_sha256":"{PROTOCOL}","registered_at_utc":"' || reg || 'Z","schema":"eligibility.v1","session_id":"' || session_id || '","session_sha256":"' || sha256(CAST(session_id AS VARCHAR)) || '","trial_id":"t"' AS b
  FROM (SELECT *, replace(CAST(make_timestamp(handoff_micros) AS VARCHAR), ' ', 'T') AS ts, replace(CAST(make_timestamp(handoff_micros + CASE WHEN session_id % 11 = 0 THEN {2 * _HOUR * 1_000_000} ELSE 60000000 END) AS VARCHAR), ' ', 'T') AS reg FROM newest)
), fold AS (
  SELECT i, '"eligibility_index":1,' || a || '"previous_eligibility_hash":null,' || b AS body, sha256('{{"eligibility_index":1,' || a || '"previous_eligibility_hash":null,' || b || '}}') AS h FROM parts WHERE i = 1
  UNION ALL SELECT p.i, '"eligibility_index":' || p.i || ',' || p.a || '"previous_eligibility_hash":"' || sha256({_TEXT.replace('h ||', 'f.h ||').replace('body', 'f.body')}) || '",' || p.b,
    sha256('{{"eligibility_index":' || p.i || ',' || p.a || '"previous_eligibility_hash":"' || sha256({_TEXT.replace('h ||', 'f.h ||').replace('body', 'f.body')}) || '",' || p.b || '}}') FROM fold f JOIN parts p ON p.i = f.i + 1
) SELECT count(*) AS n, sha256('[' || string_agg({_TEXT}, ',' ORDER BY i) || ']') AS sha256, arg_max(sha256({_TEXT}), i) AS tail FROM fold""")
def eligibility_seal(spark, sf_dir):
    return trial.sealed(_eligibility(spark, sf_dir), "eligibility_hash")


@query(f"{_NEWEST} SELECT 'unlock_sample_incomplete' AS early, CAST(NULL AS VARCHAR) AS full_, CAST(NULL AS VARCHAR) AS fault, 'unlock_binding_mismatch' AS other, count(*) AS n FROM newest")
def outcome_unlock(spark, sf_dir):
    """Refused while predictions are missing; given for both whole ledgers; void for any other."""
    e = _eligibility(spark, sf_dir)
    p = _predictions(spark, sf_dir, e)
    n = e.count()
    args = ("t", PROTOCOL, FREEZE, n)
    early = trial.unlock(e, p.filter(F.col("index") < n), *args, "2024-12-31T00:00:00Z").select(F.col("refused").alias("early"))
    made = trial.unlock(e, p, *args, "2024-12-31T00:00:00Z").first()
    fault = trial.unlock_fault(made.unlock, e, p, *args)
    other = trial.unlock_fault(made.unlock, e, p.withColumn("row", F.replace("row", F.lit(PROFILE), F.lit("ee" * 32))), *args).select(F.col("fault").alias("other"))
    return early.crossJoin(fault).crossJoin(other).crossJoin(e.agg(F.count("*").alias("n"))).withColumn("full_", F.lit(made.refused).cast("string"))


@query("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id),
j AS (SELECT *, conv_id % 2 = 0 AS positive, conv_id % 4 AS k, len(list_filter(roles, lambda x: x = 'assistant')) AS every, len(list_filter(roles[1:conv_id % 4], lambda x: x = 'assistant')) AS before FROM c)
SELECT conv_id AS session_id, CAST(CASE WHEN positive THEN before ELSE least(3, every) END AS INTEGER) AS observed_turns, CASE WHEN conv_id % 13 = 0 THEN 'label_without_prediction' WHEN conv_id % 17 = 0 THEN 'label_prediction_after_start' WHEN conv_id % 19 = 0 THEN 'label_before_unlock'
  WHEN positive AND k >= len(roles) THEN 'outcome_correction_index_invalid' WHEN positive AND roles[k + 1] <> 'user' THEN 'outcome_correction_not_by_user' WHEN NOT positive AND every < 3 AND conv_id % 3 <> 0 THEN 'outcome_window_incomplete' END AS refused FROM j""")
def outcome_labels(spark, sf_dir):
    i = F.col("session_id")
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("events"))
    start = F.when(i % 17 == 0, "2024-01-01T00:00:00Z").otherwise("2024-01-03T00:00:00Z")
    continuations = rows.select("session_id", start.alias("started_at_utc"), "events", (i % 3 == 0).alias("ended"), F.sha2(i.cast("string"), 256).alias("sha256"))
    predictions = rows.filter("session_id % 13 != 0").select("session_id", F.lit("2024-01-02T00:00:00Z").alias("predicted_at_utc"))
    positive = i % 2 == 0
    judged = rows.select("session_id", positive.cast("int").alias("outcome"), F.when(positive, "fix").alias("kind"), F.when(positive, i % 4).alias("correction_index"), F.lit("").alias("notes"), F.when(i % 19 == 0, "2024-01-04T00:00:00Z").otherwise("2024-01-06T00:00:00Z").alias("labeled_at_utc"))
    return trial.label(judged, continuations, predictions, "ff" * 32, 1_704_412_800_000_000, 3).select("session_id", "observed_turns", "refused")


@query("""SELECT doc_id AS session_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'predictions' END, CASE WHEN doc_id % 3 = 0 THEN 'continuations' END], lambda x: x IS NOT NULL), ';') AS missing FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def trial_alignment(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id")).distinct()
    return trial.alignment_faults(s, s.filter("session_id % 2 != 0"), s, s.filter("session_id % 3 != 0"), s).select("session_id", F.array_join("missing", ";").alias("missing"))


def _document(spark, sf_dir, schema, at, turns, **more):
    """(conv_id, raw): JSON documents of conversations; every thirteenth has a foreign field in its events."""
    turn = F.struct(F.col("turn").alias("index"), "role", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("tool_name"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias(turns))
    c = F.col("conv_id")
    time = F.when(c % 7 == 0, "2024-01-01T00:00:00+02:00").otherwise("2024-01-01T00:00:00Z").alias(at)
    made = F.to_json(F.struct(F.lit(schema).alias("schema"), c.cast("string").alias("session_id"), time, turns, *(v.alias(k) for k, v in more.items())), {"ignoreNullFields": "false"})
    return rows.select("conv_id", F.when(c % 13 == 0, F.replace(made, F.lit('"tool_name":null'), F.lit('"tool_name":null,"late":1'))).otherwise(made).alias("raw"))


_TURNS = "WITH turns AS (SELECT conv_id, bool_and(turn = r) AS contiguous, bool_or(role NOT IN ('user', 'assistant', 'tool')) AS other FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations) GROUP BY conv_id)"
_HEAD_ERRORS = "WHEN conv_id IS NULL THEN '{0}_identity_invalid' WHEN conv_id % 7 = 0 THEN '{0}_time_invalid'"
_EVENT_ERRORS = "WHEN conv_id % 13 = 0 THEN '{0}_event_fields_invalid' WHEN NOT contiguous THEN 'transcript_index_not_contiguous' WHEN other THEN 'transcript_role_invalid'"


@query(f"""{_TURNS} SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN 'session_fields_invalid' {_HEAD_ERRORS.format('session')} {_EVENT_ERRORS.format('session')}
  WHEN conv_id % 5 = 0 THEN 'signal_invalid' WHEN conv_id % 5 = 1 THEN 'graph_relation_dangling' END AS error FROM turns""")
def session_document_errors(spark, sf_dir):
    c = F.col("conv_id")
    digest = F.sha2(c.cast("string"), 256)
    node = lambda name, flag: F.array(F.struct(F.lit(name).alias("id"), digest.alias("content_hash"), F.lit(True).alias(flag)))
    link = F.struct(F.lit("e").alias("src"), F.when(c % 5 == 1, "x").otherwise("c").alias("dst"), F.lit("supports").alias("relation_type"))
    graph = F.struct(node("c", "material").alias("claims"), node("e", "observed").alias("evidence"), F.array(link).alias("relations"))
    measured = F.struct(F.lit(sessions.ALGORITHM).alias("algorithm_id"), F.array(F.lit(1), F.lit(1_000_000)).alias("signal_points_micros"), graph.alias("previous_graph"), graph.alias("current_graph"))
    docs = _document(spark, sf_dir, sessions.SESSION, "handoff_at_utc", "transcript", measurement_input=measured)
    raw = F.when(c % 5 == 0, F.replace("raw", F.lit("[1,1000000]"), F.lit("[1.5]"))).otherwise(F.col("raw"))
    # An outcome has no place in a session.
    docs = docs.withColumn("raw", F.when(c % 11 == 0, F.replace(raw, F.lit('{"schema"'), F.lit('{"outcome":1,"schema"'))).otherwise(raw))
    return docs.select("conv_id", sessions.session_error(F.col("raw")).alias("error"))


@query(f"{_TURNS} SELECT conv_id, CASE {_HEAD_ERRORS.format('continuation')} WHEN conv_id % 11 = 0 THEN 'continuation_ended_invalid' {_EVENT_ERRORS.format('continuation')} END AS error FROM turns")
def continuation_document_errors(spark, sf_dir):
    docs = _document(spark, sf_dir, sessions.CONTINUATION, "started_at_utc", "events", ended=F.lit(True))
    raw = F.when(F.col("conv_id") % 11 == 0, F.replace("raw", F.lit('"ended":true'), F.lit('"ended":1'))).otherwise(F.col("raw"))
    return docs.select("conv_id", sessions.continuation_error(raw).alias("error"))


_KINDS, _UNLOCKED = ("corrected",), "ee" * 32
_PLANTED = ["outcome_fields_invalid", "outcome_phase_invalid", "outcome_phase_mismatch", "outcome_unlock_invalid", "outcome_value_invalid", "outcome_time_invalid", "outcome_continuation_hash_invalid", "outcome_window_invalid", "outcome_metadata_invalid", "outcome_negative_with_correction", "outcome_unlock_mismatch", "outcome_continuation_missing", "outcome_continuation_mismatch", "outcome_label_before_start", "outcome_ended_mismatch", "outcome_correction_not_by_user"]


@query(f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id AS line, CAST(conv_id AS VARCHAR) AS session_id, CASE conv_id % 18 {' '.join(f"WHEN {i} THEN '{code}'" for i, code in enumerate(_PLANTED))} END AS fault FROM c WHERE conv_id % 18 < {len(_PLANTED)}
UNION ALL SELECT conv_id + 1000000000, CAST(conv_id AS VARCHAR), 'outcome_session_duplicate' FROM c WHERE conv_id % 18 = 16""")
def outcome_documents(spark, sf_dir):
    """An outcome row of every conversation; each rule is broken by one kind of them."""
    turn = F.struct(F.col("turn").alias("index"), "role")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("events"))
    c = F.col("conv_id")
    at, began = F.lit("2024-02-01T00:00:00Z"), F.lit("2024-01-01T00:00:00Z")
    rows = talks.select("conv_id", c.cast("string").alias("session_id"), began.alias("started_at_utc"), "events", (c % 18 != 14).alias("ended"), F.sha2(c.cast("string"), 256).alias("sha256"), (c % 18).alias("k"))
    k = F.col("k")
    observed = F.least(F.size(F.filter("events", lambda e: e["role"] == "assistant")), F.lit(3)).cast("long")
    is_ = lambda *n: k.isin(*n)
    made = F.struct(
        F.lit(trial.OUTCOME).alias("schema"), F.when(is_(1), "later").when(is_(2), "calibration").otherwise("prospective").alias("phase"), "session_id", F.when(is_(4), 2).when(is_(15), 1).otherwise(0).alias("outcome"),
        F.when(is_(9, 15), "corrected").alias("kind"), F.when(is_(15), 1_000_000).alias("correction_message_index"), F.when(is_(6), F.upper("sha256")).when(is_(12), F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("continuation_sha256"),
        F.when(is_(7), 99).otherwise(observed).alias("window_observed_assistant_turns"), F.lit(True).alias("continuation_ended"), F.when(is_(5), "2024-02-01T00:00:00+00:00").when(is_(13), "2023-12-31T23:59:59Z").otherwise(at).alias("labeled_at_utc"),
        F.when(is_(3), "ee").when(is_(10), "dd" * 32).when(~is_(2), _UNLOCKED).alias("outcome_unlock_sha256"), F.lit("n").alias("notes"),
    )
    told = rows.select("conv_id", "k", F.to_json(made, {"ignoreNullFields": "false"}).alias("raw"))
    text = F.col("raw")
    text = F.when(is_(0), F.replace(text, F.lit('{"schema"'), F.lit('{"late":1,"schema"'))).when(is_(8), F.replace(text, F.lit('"continuation_ended":true'), F.lit('"continuation_ended":"true"'))).otherwise(text)
    lines = told.select(F.explode(F.when(is_(16), F.array(c, c + 1_000_000_000)).otherwise(F.array(c))).alias("line"), text.alias("raw"))
    return outcomes.outcome_faults(lines, rows.filter("k <> 11"), _KINDS, 3, "prospective", _UNLOCKED)


_HEAD = {"trial_id": "t", "protocol_sha256": PROTOCOL, "generated_at_utc": "2024-01-16T00:00:00Z", "measurement_contract_sha256": "cc" * 32, "receiver_profile_sha256": PROFILE}


def _calibration(spark, sf_dir):
    """Sessions before the newest, with their hashes and outcomes."""
    every = d.outcomes(spark, sf_dir)
    newest = evaluation.most_recent(every, N).select("session_id")
    sid = F.col("session_id").cast("string")
    return every.join(newest, "session_id", "left_anti").select(sid.alias("session_id"), _iso(F.col("handoff_micros")).alias("handoff_at_utc"), F.sha2(sid, 256).alias("session_sha256"), F.sha2(F.concat(sid, F.lit("c")), 256).alias("continuation_sha256"), F.col("y").alias("outcome"))


_FIT = """'"accuracy_micros":' || accuracy_micros || ',"balanced_accuracy_micros":' || balanced_accuracy_micros || ',"direction":"high","fn":' || fn || ',"fp":' || fp"""
_FITTED = """',"sensitivity_micros":' || sensitivity_micros || ',"specificity_micros":' || specificity_micros || ',"threshold":' || threshold || ',"tn":' || tn || ',"tp":' || tp"""


@query(f"""{_LABELLED}, newest AS (SELECT session_id FROM outcomes ORDER BY handoff_micros DESC, session_id DESC LIMIT {N}), train AS (SELECT * FROM labelled WHERE session_id NOT IN (SELECT session_id FROM newest)),
cand AS (SELECT metric, value AS threshold FROM train UNION SELECT metric, min(value) - 1 FROM train GROUP BY metric UNION SELECT metric, max(value) + 1 FROM train GROUP BY metric),
c AS (SELECT metric, threshold, count(*) FILTER (y = 1 AND value >= threshold) AS tp, count(*) FILTER (y = 0 AND value < threshold) AS tn, count(*) FILTER (y = 0 AND value >= threshold) AS fp, count(*) FILTER (y = 1 AND value < threshold) AS fn FROM cand JOIN train USING (metric) GROUP BY metric, threshold),
r AS (SELECT *, {_COUNTED} FROM c), s AS (SELECT metric, threshold, {_RATES} FROM r), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY metric ORDER BY balanced_accuracy_micros DESC, specificity_micros DESC, sensitivity_micros DESC, threshold) = 1),
cal AS (SELECT CAST(session_id AS VARCHAR) AS sid, replace(CAST(make_timestamp(handoff_micros) AS VARCHAR), ' ', 'T') || 'Z' AS handoff, y FROM outcomes WHERE session_id NOT IN (SELECT session_id FROM newest)),
told AS (SELECT count(*) AS n, max(handoff) AS last, string_agg('"' || sid || '"', ',' ORDER BY handoff, sid) AS ids, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg,
  sha256('[' || string_agg('{{"continuation_sha256":"' || sha256(sid || 'c') || '","outcome":' || y || ',"session_id":"' || sid || '","session_sha256":"' || sha256(sid) || '"}}', ',' ORDER BY handoff, sid) || ']') AS manifest FROM cal),
fit AS (SELECT metric, {_FIT} AS a, {_FITTED} AS b FROM best),
safe AS (SELECT *, CASE WHEN neg = 0 THEN 0 ELSE 1000000 END AS spec FROM told WHERE n > 0)
SELECT t, sha256(t) AS sha256 FROM (SELECT '{{"calibration_manifest_sha256":"' || manifest || '","calibration_max_handoff_at_utc":"' || last || '","calibration_n":' || n || ',"calibration_selection":{{"input_session_count":{N},"rule":"most_recent_pre_freeze","selected_session_ids":[' || ids || ']}},"comparators":{{'
  || '"always_safe":{{"accuracy_micros":' || (neg * 1000000 // n) || ',"balanced_accuracy_micros":' || (spec // 2) || ',"fn":' || pos || ',"fp":0,"prediction":0,"sensitivity_micros":0,"specificity_micros":' || spec || ',"tn":' || neg || ',"tp":0,"type":"fixed"}},"n_points":{{' || (SELECT a || b FROM fit WHERE metric = 'n_points') || ',"type":"threshold"}}}}'
  || ',"generated_at_utc":"2024-01-16T00:00:00Z","measurement_contract_sha256":"{"cc" * 32}","primary":{{' || (SELECT a || ',"metric":"peak"' || b FROM fit WHERE metric = 'peak') || '}},"protocol_sha256":"{PROTOCOL}","receiver_profile_sha256":"{PROFILE}","schema":"freeze.v1","secondary":{{"absent":{{"fit":null,"status":"unavailable"}},"level":{{"fit":{{'
  || (SELECT a || b FROM fit WHERE metric = 'level') || '}},"status":"frozen"}}}},"trial_id":"t"}}' AS t FROM safe) x""".replace("SELECT t, sha256(t)", "SELECT t AS document, sha256(t)"))
def freeze_document(spark, sf_dir):
    """The freeze of all sessions before the newest: fits, manifest, selection."""
    values = d.predictors(spark, sf_dir).withColumn("session_id", F.col("session_id").cast("string"))
    return documents.freeze(_calibration(spark, sf_dir), values, ("peak", "high"), {"level": "high", "absent": "low"}, {"n_points": "high"}, _HEAD, N)


@query()
def evaluation_document(spark, sf_dir):
    """The evaluation of the newest sessions, predicted by the rules of the freeze above; without earlier sessions, which give none, by fixed cuts."""
    rules = staged(documents.frozen_rules(freeze_document(spark, sf_dir)), "rules")
    frozen = rules.select("sha256").first()  # one hash, bound by the document
    pairs = d.paired(spark, sf_dir) if frozen is None else documents.frozen_pairs(rules, evaluation.most_recent(d.outcomes(spark, sf_dir), N), d.predictors(spark, sf_dir))
    return documents.evaluate(pairs, {"trial_id": "t", "freeze_sha256": frozen.sha256 if frozen else "", "protocol_sha256": PROTOCOL}, "peak", 50_000, 950_000, 3)
