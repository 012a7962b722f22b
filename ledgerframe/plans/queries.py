"""Every operator as a query over the supplied tables, and SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import status, text, tokens
from ..functions import strict_json as sj
from ..operators import chain, costs, evaluation, gate, handoff, integrity, metrics, replay
from ..sources.stages import staged
from . import derived as d
from .derived import MEMBERS, NOW, OUTCOMES, PAIRED, POINTS, POLICY, PREDICTORS, RECEIPTS, STRICT, decisions_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PROFILE = metrics.Profile(smoothing_window=2)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_GATE = f"WITH {RECEIPTS}, {decisions_sql('gate', POLICY)}"
_BOTH = f"{_GATE}, {decisions_sql('strict', STRICT)}"
_DECISION = "CASE worst WHEN 2 THEN 'DENY' WHEN 1 THEN 'QUARANTINE' ELSE 'COMMIT' END"
_VERDICT = "CASE worst WHEN 2 THEN 'REJECTED' WHEN 1 THEN 'UNDECIDABLE' ELSE 'VERIFIED' END"
_REASONS = "array_to_string(list_sort(list_filter([r1, r2, r3, r4], lambda x: x IS NOT NULL)), ';')"


def decided(spark: SparkSession, sf_dir: str, policy: gate.Policy = POLICY, side_effect=None) -> DataFrame:
    return gate.decide(d.receipts(spark, sf_dir), d.checks(policy), policy, side_effect)


@query(f"{_GATE} SELECT event_id, {_VERDICT} AS verdict, {_DECISION} AS decision, {_REASONS} AS reasons FROM gate")
def gate_disposition(spark, sf_dir):
    return decided(spark, sf_dir).select("event_id", "verdict", "decision", F.array_join("reason_codes", ";").alias("reasons"))


@query(f"{_GATE} SELECT verdict, decision, count(*) AS n FROM (SELECT {_VERDICT} AS verdict, {_DECISION} AS decision FROM gate) GROUP BY ALL")
def disposition_counts(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("verdict", "decision").agg(F.count("*").alias("n"))


@query(f"""WITH {RECEIPTS}, {decisions_sql('strict', STRICT)}
SELECT event_id, CASE worst WHEN 2 THEN CASE WHEN action = 'purchase' THEN 'ROLLBACK_REQUEST' ELSE 'DENY' END WHEN 1 THEN 'NO_BADGE' ELSE 'COMMIT' END AS decision FROM strict""")
def rollback_variant(spark, sf_dir):
    return decided(spark, sf_dir, STRICT, F.col("action") == "purchase").select("event_id", "decision")


@query(f"{_GATE} SELECT run_id, {_REASONS} AS reasons, count(*) AS n FROM gate GROUP BY ALL")
def reason_codes_sorted(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("run_id", F.array_join("reason_codes", ";").alias("reasons")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE greatest(a, b, c) WHEN 2 THEN 'fail' WHEN 1 THEN 'unavailable' ELSE 'pass' END AS combined
FROM (SELECT event_id, event_id % 7 // 3 AS a, CASE WHEN value > 40 THEN 2 ELSE 0 END AS b, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS c FROM events)""")
def status_rank_combine(spark, sf_dir):
    name = lambda n: status.name(n.cast("int"))
    a, b, c = name(F.call_function("div", F.col("event_id") % 7, F.lit(3))), name(F.when(F.col("value") > 40, 2).otherwise(0)), name(F.when(F.col("event_type") == "error", 1).otherwise(0))
    return table(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b"), c.alias("c")).select("event_id", status.name(status.worst(F.col("a"), F.col("b"), F.col("c"))).alias("combined"))


def _one_check(spark, sf_dir, check):
    return d.receipts(spark, sf_dir).select("event_id", check.alias("c")).select("event_id", "c.status", F.array_join("c.reason_codes", ";").alias("reasons"))


@query(f"WITH {RECEIPTS} SELECT event_id, CASE WHEN action IN ('view', 'click', 'purchase') THEN 'pass' ELSE 'fail' END AS status, CASE WHEN action IN ('view', 'click', 'purchase') THEN '' ELSE 'action_not_allowed' END AS reasons FROM receipts")
def action_allowlist(spark, sf_dir):
    return _one_check(spark, sf_dir, gate.action_check(F.col("action"), POLICY))


@query(f"""WITH {RECEIPTS}, a AS (SELECT event_id, ({NOW} - issued) // 1000000 AS age FROM receipts)
SELECT event_id, CASE WHEN age < 0 THEN 'fail' WHEN age > {POLICY.max_age_seconds} THEN 'unavailable' ELSE 'pass' END AS status,
  CASE WHEN age < 0 THEN 'receipt_from_future' WHEN age > {POLICY.max_age_seconds} THEN 'receipt_expired' ELSE '' END AS reasons FROM a""")
def freshness_status(spark, sf_dir):
    return _one_check(spark, sf_dir, gate.freshness_check(F.col("issued"), NOW, POLICY))


_ARTIFACTS = f"""WITH {RECEIPTS}, artifacts AS (SELECT event_id, artifact FROM receipts WHERE artifact IS NOT NULL), commitments AS (SELECT event_id, commitment FROM receipts WHERE event_id % 19 <> 0)"""


@query(f"""{_ARTIFACTS}
SELECT r.event_id, CASE WHEN c.commitment IS NULL OR a.artifact IS NULL THEN 'unavailable' WHEN sha256(a.artifact) <> c.commitment THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN c.commitment IS NULL THEN 'commitment_missing:props' WHEN a.artifact IS NULL THEN 'artifact_missing:props' WHEN sha256(a.artifact) <> c.commitment THEN 'artifact_hash_mismatch:props' ELSE '' END AS reasons
FROM receipts r LEFT JOIN commitments c USING (event_id) LEFT JOIN artifacts a ON a.event_id = r.event_id""")
def evidence_commitment_join(spark, sf_dir):
    r = d.receipts(spark, sf_dir)
    artifacts, commitments = r.filter("artifact IS NOT NULL").select("event_id", "artifact"), r.filter("event_id % 19 <> 0").select("event_id", "commitment")
    joined = r.select("event_id").join(commitments, "event_id", "left").join(artifacts, "event_id", "left")
    return joined.select("event_id", gate.evidence_check("props", F.col("commitment"), F.col("artifact")).alias("c")).select("event_id", "c.status", F.array_join("c.reason_codes", ";").alias("reasons"))


@query(f"""WITH {RECEIPTS} SELECT event_id, CASE WHEN artifact IS NULL THEN 'unavailable' WHEN json_extract_string(artifact, '$.ok') = '1' THEN 'pass' ELSE 'fail' END AS status,
  CASE WHEN artifact IS NULL THEN 'claim_artifact_missing:ok' WHEN json_extract_string(artifact, '$.ok') = '1' THEN '' ELSE 'claim_fact_mismatch:ok' END AS reasons FROM receipts""")
def claim_pointer_equality(spark, sf_dir):
    return _one_check(spark, sf_dir, d.claims(POLICY, F.col("artifact")))


@query("""WITH trust AS (SELECT 'agent-' || i AS key_id, CASE WHEN i = 3 THEN sha256('other') ELSE sha256('key-' || i) END AS trusted FROM range(0, 4) t(i))
SELECT event_id, CASE WHEN trusted IS NULL THEN 'unavailable' WHEN trusted <> public_key THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN trusted IS NULL THEN 'source_key_untrusted' WHEN trusted <> public_key THEN 'source_key_mismatch' ELSE '' END AS reasons
FROM (SELECT event_id, 'agent-' || (user_id % 5) AS key_id, sha256('key-' || (user_id % 5)) AS public_key FROM events) LEFT JOIN trust USING (key_id)""")
def trust_provenance_join(spark, sf_dir):
    i = (F.col("user_id") % 5).cast("string")
    receipts = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("agent-"), i).alias("key_id"), F.sha2(F.concat(F.lit("key-"), i), 256).alias("public_key"))
    n = F.col("id").cast("string")
    trust = spark.range(4).select(F.concat(F.lit("agent-"), n).alias("key_id"), F.sha2(F.when(F.col("id") == 3, F.lit("other")).otherwise(F.concat(F.lit("key-"), n)), 256).alias("trusted"))
    # Four pinned keys: a bounded side.
    return receipts.join(F.broadcast(trust), "key_id", "left").select("event_id", gate.provenance_check(F.col("public_key"), F.col("trusted")).alias("c")).select("event_id", "c.status", F.array_join("c.reason_codes", ";").alias("reasons"))


_CHAIN = f"""WITH {RECEIPTS}, kept AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sequence) - 1 AS idx FROM receipts WHERE event_id % 31 <> 0
), linked AS (
  SELECT run_id AS chain_id, idx, sequence, source_sha256 AS envelope_hash,
    CASE WHEN idx = 0 THEN CASE WHEN event_id % 13 = 0 THEN 'x' END WHEN event_id % 29 = 0 THEN 'wrong' ELSE lag(source_sha256) OVER (PARTITION BY run_id ORDER BY idx) END AS parent_hash,
    CASE WHEN event_id % 41 = 0 THEN 'agent-b' ELSE 'agent-a' END AS issuer FROM kept
), reasons AS (
  SELECT *, [CASE WHEN idx = 0 AND sequence <> 0 THEN 'chain:first_sequence_not_zero' END, CASE WHEN idx = 0 AND parent_hash IS NOT NULL THEN 'chain:first_parent_present' END,
    CASE WHEN idx > 0 AND sequence <> lag(sequence) OVER w + 1 THEN 'chain:sequence_gap:' || idx END, CASE WHEN idx > 0 AND parent_hash IS DISTINCT FROM lag(envelope_hash) OVER w THEN 'chain:parent_mismatch:' || idx END,
    CASE WHEN idx > 0 AND issuer <> lag(issuer) OVER w THEN 'chain:issuer_changed:' || idx END] AS rs
  FROM linked WINDOW w AS (PARTITION BY chain_id ORDER BY idx)
)"""


def _linked(spark, sf_dir):
    w = Window.partitionBy("run_id").orderBy("sequence")
    kept = d.receipts(spark, sf_dir).filter("event_id % 31 <> 0").withColumn("index", F.row_number().over(w) - 1)
    parent = F.when(F.col("index") == 0, F.when(F.col("event_id") % 13 == 0, "x")).when(F.col("event_id") % 29 == 0, "wrong").otherwise(F.lag("source_sha256").over(w))
    items = kept.select(F.col("run_id").alias("chain_id"), "index", "run_id", "sequence", F.col("source_sha256").alias("envelope_hash"), parent.alias("parent_hash"), F.when(F.col("event_id") % 41 == 0, "agent-b").otherwise("agent-a").alias("issuer"))
    return chain.links(items)


@query(f"{_CHAIN} SELECT chain_id, CAST(idx AS INTEGER) AS index, array_to_string(list_filter(rs, lambda x: x IS NOT NULL), ';') AS reasons FROM reasons")
def chain_links(spark, sf_dir):
    return _linked(spark, sf_dir).select("chain_id", "index", F.array_join("link_reasons", ";").alias("reasons"))


@query(f"{_CHAIN} SELECT chain_id, array_to_string(list_filter(rs, lambda x: x IS NOT NULL), ';') AS reasons FROM reasons WHERE idx = 0")
def chain_first_row(spark, sf_dir):
    return _linked(spark, sf_dir).filter("index = 0").select("chain_id", F.array_join("link_reasons", ";").alias("reasons"))


@query(f"""{_CHAIN}, flat AS (SELECT chain_id, unnest(list_filter(rs, lambda x: x IS NOT NULL)) AS r FROM reasons), agg AS (SELECT chain_id, string_agg(DISTINCT r, ';' ORDER BY r) AS rs FROM flat GROUP BY chain_id),
n AS (SELECT chain_id, count(*) AS items FROM linked GROUP BY chain_id)
SELECT chain_id, items, CASE WHEN items > 60 OR rs IS NOT NULL THEN 'fail' ELSE 'pass' END AS status, CASE WHEN items > 60 THEN 'chain_item_limit_exceeded' ELSE coalesce(rs, '') END AS reasons FROM n LEFT JOIN agg USING (chain_id)""")
def chain_status(spark, sf_dir):
    return chain.chain_results(_linked(spark, sf_dir), max_items=60).select("chain_id", "items", "status", F.array_join("reason_codes", ";").alias("reasons"))


@query(f"""WITH RECURSIVE {RECEIPTS.strip()}, fold AS (
  SELECT run_id, sequence, sha256('|' || source_sha256) AS h FROM receipts WHERE sequence = 0
  UNION ALL SELECT r.run_id, r.sequence, sha256(f.h || '|' || r.source_sha256) FROM fold f JOIN receipts r ON r.run_id = f.run_id AND r.sequence = f.sequence + 1
) SELECT run_id, max(sequence) + 1 AS n, max_by(h, sequence) AS tip_hash FROM fold GROUP BY run_id""")
def chain_hash_fold(spark, sf_dir):
    return chain.fold_hashes(d.receipts(spark, sf_dir), "run_id", "sequence", F.col("source_sha256"))


_ALLOWED = [POLICY.sha256]
_HANDOFF = f"""{_BOTH}, decisions AS (
  SELECT source_sha256, '{POLICY.sha256}' AS policy_sha256, {_VERDICT} AS verdict, {_DECISION} AS decision FROM gate WHERE event_id % 11 <> 0
  UNION ALL SELECT source_sha256, '{STRICT.sha256}', {_VERDICT}, {_DECISION} FROM strict
), admitted AS (
  SELECT r.*, CASE WHEN e.conflict IS NULL THEN 'no_allowed_policy_decision' WHEN e.conflict THEN 'eligible_non_commit_or_conflict' WHEN length(action) > 7 THEN 'action_too_large' END AS excluded
  FROM receipts r LEFT JOIN (SELECT source_sha256, bool_or(verdict <> 'VERIFIED' OR decision <> 'COMMIT') AS conflict FROM decisions WHERE policy_sha256 = '{POLICY.sha256}' GROUP BY source_sha256) e USING (source_sha256)
)"""


def _decisions(spark, sf_dir, allowed_only=False):
    """Decisions on every receipt from one pass over the receipts: of both policies, or of the allowed one."""
    if allowed_only:
        return decided(spark, sf_dir).filter("event_id % 11 != 0").select("source_sha256", F.lit(POLICY.sha256).alias("policy_sha256"), "verdict", "decision")
    both = d.receipts(spark, sf_dir)
    for name, policy in (("one", POLICY), ("two", STRICT)):
        both = gate.decide(both, d.checks(policy), policy)
        made = F.struct(F.lit(policy.sha256).alias("policy_sha256"), "verdict", "decision")
        both = both.withColumn(name, made).drop("verdict", "decision", "reason_codes")
    kept = F.array_compact(F.array(F.when(F.col("event_id") % 11 != 0, F.col("one")), F.col("two")))
    return both.select("source_sha256", F.explode(kept).alias("x")).select("source_sha256", "x.*")


def _admitted(spark, sf_dir):
    return handoff.admit(d.receipts(spark, sf_dir).withColumn("claim", F.col("props")), _decisions(spark, sf_dir, allowed_only=True), _ALLOWED, max_action=7)


@query(f"{_HANDOFF} SELECT run_id, sequence, coalesce(excluded, '') AS excluded FROM admitted")
def handoff_admission(spark, sf_dir):
    return _admitted(spark, sf_dir).select("run_id", "sequence", F.coalesce("excluded", F.lit("")).alias("excluded"))


@query(f"{_HANDOFF} SELECT run_id, excluded AS reason, count(*) AS n FROM admitted WHERE excluded IS NOT NULL GROUP BY ALL")
def handoff_excluded_by_reason(spark, sf_dir):
    return handoff.excluded_by_reason(_admitted(spark, sf_dir))


@query(f"{_HANDOFF} SELECT run_id, count(*) AS chain_length, count(*) FILTER (excluded IS NULL) AS accepted_count, count(*) FILTER (excluded IS NOT NULL) AS excluded_count, greatest(0, count(*) FILTER (excluded IS NULL) - 3) AS omitted_accepted_count FROM admitted GROUP BY run_id")
def handoff_summary(spark, sf_dir):
    return handoff.summary(_admitted(spark, sf_dir))


@query(f"{_HANDOFF} SELECT run_id, count(*) AS ignored FROM decisions JOIN receipts USING (source_sha256) WHERE policy_sha256 <> '{POLICY.sha256}' GROUP BY run_id")
def handoff_ignored_policy(spark, sf_dir):
    ignored = _decisions(spark, sf_dir).filter(~F.col("policy_sha256").isin(_ALLOWED))
    return ignored.join(d.receipts(spark, sf_dir).select("source_sha256", "run_id"), "source_sha256").groupBy("run_id").agg(F.count("*").alias("ignored"))


@query(f"{_HANDOFF} SELECT source_sha256, policy_sha256 FROM decisions WHERE source_sha256 NOT IN (SELECT source_sha256 FROM receipts WHERE event_id % 37 <> 0)")
def handoff_outside_chain(spark, sf_dir):
    return handoff.outside_chain(d.receipts(spark, sf_dir).filter("event_id % 37 <> 0"), _decisions(spark, sf_dir)).select("source_sha256", "policy_sha256")


@query(f"""{_HANDOFF}, rules AS (SELECT '{POLICY.sha256}' AS policy_sha256, unnest(['a:1', 'b:2', 'a:1']) AS fact UNION ALL SELECT '{STRICT.sha256}', unnest(['b:2', 'B:3']))
SELECT source_sha256, string_agg(fact, ';' ORDER BY fact) AS facts FROM (SELECT DISTINCT source_sha256, fact FROM decisions JOIN rules USING (policy_sha256)) GROUP BY source_sha256""")
def handoff_fact_dedup(spark, sf_dir):
    rules = spark.createDataFrame([(POLICY.sha256, x) for x in ("a:1", "b:2", "a:1")] + [(STRICT.sha256, x) for x in ("b:2", "B:3")], "policy_sha256 string, fact string")
    return handoff.facts(d.receipts(spark, sf_dir), _decisions(spark, sf_dir), rules).select("source_sha256", F.array_join("facts", ";").alias("facts"))


@query(f"{_HANDOFF} SELECT run_id, sequence, action FROM admitted WHERE excluded IS NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC) <= 3")
def handoff_last_k(spark, sf_dir):
    return handoff.last_accepted(_admitted(spark, sf_dir)).select("run_id", "sequence", "action")


@query(f"""{_HANDOFF}, shown AS (SELECT * FROM admitted WHERE excluded IS NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC) <= 3)
SELECT run_id, string_agg(sequence || ':' || action || ':' || substr(source_sha256, 1, 16), chr(10) ORDER BY sequence) || chr(10) AS prompt FROM shown GROUP BY run_id""")
def handoff_render(spark, sf_dir):
    shown = handoff.last_accepted(_admitted(spark, sf_dir)).withColumn("line", F.concat_ws(":", F.col("sequence").cast("string"), "action", F.substring("source_sha256", 1, 16)))
    return handoff.render(shown)


_TOKENS = r"coalesce(len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]')), 0)"


@query(f"SELECT doc_id, CAST({_TOKENS.format('text')} AS INTEGER) AS n_tokens FROM documents")
def lexical_token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.lexical_tokens(F.col("text")), F.lit(0)).alias("n_tokens"))


def _half_even(x: str) -> str:
    """One place of a double by its exact value, an exact half to even, as SQL: fractions in units of 2**-60."""
    unit = "1152921504606846976::HUGEINT"
    parts = f"(CAST((abs({x}) - floor(abs({x}))) * 1152921504606846976::DOUBLE AS HUGEINT) * 10)"
    low = f"(CAST(floor(abs({x})) AS HUGEINT) * 10 + {parts} // {unit})"
    rest = f"({parts} % {unit} * 2)"
    return f"sign({x}) * ({low} + CASE WHEN {rest} > {unit} THEN 1 WHEN {rest} < {unit} THEN 0 ELSE {low} % 2 END)::DOUBLE / 10.0::DOUBLE"


_STEP = "'STEP ' || sequence || chr(10) || action || ': ' || props"
_HEADER = f"""'{{"drop":' || n - ok || ',"k":"h","n":' || n || ',"ok":' || ok || ',"pn":1,"ps":"{sj.object_hash(_ALLOWED)[:16]}","run":"' || run_id || '","s":"handoff.v1","show":' || len(ls) || ',"tip":"' || source_sha256[1:16] || '"}}' || chr(10)"""


@query(f"""{_HANDOFF}, taken AS (SELECT run_id, sequence, list('{{"a":"' || action || '","facts":[["props","/ok",1]],"k":"i","seq":' || sequence || '}}' || chr(10)) OVER (PARTITION BY run_id ORDER BY sequence ROWS 2 PRECEDING) AS ls FROM admitted WHERE excluded IS NULL
), prefixes AS (SELECT a.*, count(*) OVER w AS n, count(*) FILTER (excluded IS NULL) OVER w AS ok, coalesce(last_value(ls IGNORE NULLS) OVER w, []) AS ls FROM admitted a LEFT JOIN taken USING (run_id, sequence) WINDOW w AS (PARTITION BY run_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)
), texts AS (SELECT run_id, sequence, n, ok, {_STEP} AS step, {_HEADER} || array_to_string(ls, '') AS prompt, '{{"k":"h","ok":' || ok || ',"s":"unsigned.compact.v1","show":' || len(ls) || '}}' || chr(10) || array_to_string(ls, '') AS unsigned FROM prefixes
), counted AS (SELECT *, sum(CAST({_TOKENS.format('step')} AS BIGINT)) OVER (PARTITION BY run_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS full_t, CAST({_TOKENS.format('unsigned')} AS BIGINT) AS unsigned_t, CAST({_TOKENS.format('prompt')} AS BIGINT) AS handoff_t FROM texts
), added AS (SELECT *, sum(full_t) OVER w AS cf, sum(unsigned_t) OVER w AS cu, sum(handoff_t) OVER w AS ch FROM counted WINDOW w AS (PARTITION BY run_id ORDER BY sequence ROWS UNBOUNDED PRECEDING))
SELECT run_id AS chain_id, sequence AS index, ok AS accepted_count, CAST(full_t AS BIGINT) AS full_tokens, unsigned_t AS unsigned_tokens, handoff_t AS handoff_tokens, CAST(cf AS BIGINT) AS cumulative_full, CAST(cu AS BIGINT) AS cumulative_unsigned, CAST(ch AS BIGINT) AS cumulative_handoff, sha256(prompt) AS prompt_sha256 FROM added""")
def prefix_replay(spark, sf_dir):
    """The handoff of every prefix of every run, and its cost beside the whole transcript's."""
    handoffs, steps = _prefixes(spark, sf_dir)
    costs_ = replay.prefix_costs(handoffs, steps, tokens.token_counter("lexical"))
    return costs_.join(handoffs.select("chain_id", "index", F.sha2("prompt", 256).alias("prompt_sha256")), ["chain_id", "index"]).drop("chain_length")


def _prefixes(spark, sf_dir):
    rows = _admitted(spark, sf_dir).select(F.col("run_id").alias("chain_id"), F.col("run_id").cast("string").alias("run_id"), F.col("sequence").alias("index"), "sequence", F.col("source_sha256").alias("envelope_hash"), "action", "props", "excluded")
    rows = staged(rows, "admitted").repartition(d.tasks(spark, sf_dir), "chain_id")
    fact = sj.dumps({"rule_id": "ok", "evidence_id": "props", "pointer": "/ok", "expected": 1}).decode()
    steps = rows.select("chain_id", "index", F.concat(F.lit("STEP "), F.col("sequence").cast("string"), F.lit("\n"), "action", F.lit(": "), "props").alias("step"))
    return staged(replay.prefix_handoffs(rows.withColumn("facts", F.array(F.lit(fact))), _ALLOWED), "prefixes"), steps


@query()
def prefix_cost_rows_byte_pair(spark, sf_dir):
    """A row of costs per run by a byte-pair vocabulary."""
    from public_tokenizers import path

    return replay.cost_rows(replay.prefix_costs(*_prefixes(spark, sf_dir), tokens.token_counter(f"byte_pair:{path('byte_bpe_50k.tiktoken')}")))


_COSTS = f"WITH t AS (SELECT conv_id, turn, CAST({_TOKENS.format('text')} AS BIGINT) AS full_cost, least(CAST({_TOKENS.format('text')} AS BIGINT), 40) + 12 AS short_cost FROM conversations)"


def _costs(spark, sf_dir):
    n = F.coalesce(text.lexical_tokens(F.col("text")), F.lit(0)).cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("full_cost"), (F.least(n, F.lit(40)) + 12).alias("short_cost"))


@query(f"""{_COSTS}, s AS (SELECT conv_id, CAST(sum(full_cost) AS BIGINT) AS full_tokens, CAST(sum(short_cost) AS BIGINT) AS short_tokens FROM t GROUP BY conv_id)
SELECT full_tokens, short_tokens, conv_id, CASE WHEN full_tokens = 0 THEN 0.0::DOUBLE ELSE {_half_even('(full_tokens - short_tokens) * 100.0::DOUBLE / full_tokens')} END AS reduction_percent FROM s""")
def token_cost_tracks(spark, sf_dir):
    s = _costs(spark, sf_dir).groupBy("conv_id").agg(F.sum("full_cost").alias("full_tokens"), F.sum("short_cost").alias("short_tokens"))
    return s.withColumn("reduction_percent", costs.percent_reduction(F.col("full_tokens"), F.col("short_tokens")))


@query(f"""{_COSTS}, p AS (SELECT *, CAST(sum(full_cost) OVER w AS BIGINT) AS prefix_cost FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, prefix_cost, CAST(sum(prefix_cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS replay_cost FROM p""")
def cumulative_prefix_cost(spark, sf_dir):
    return costs.cumulative(_costs(spark, sf_dir), "conv_id", "turn", "full_cost").select("conv_id", "turn", "prefix_cost", "replay_cost")


@query(f"""{_COSTS}, p AS (SELECT conv_id, turn, short_cost, sum(full_cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prefix_cost FROM t)
SELECT conv_id, min(turn) FILTER (short_cost <= prefix_cost) AS break_even_depth FROM p GROUP BY conv_id""")
def break_even_depth(spark, sf_dir):
    return costs.break_even(costs.cumulative(_costs(spark, sf_dir), "conv_id", "turn", "full_cost"), "conv_id", "turn", "short_cost", "prefix_cost")


@query("""SELECT event_type, round(list_sort(list(value))[CAST(least(count(*) - 1, greatest(0, floor((count(*) - 1) * 0.95::DOUBLE + 0.999999::DOUBLE))) AS BIGINT) + 1], 3) AS percentile_value FROM events GROUP BY event_type""")
def nearest_rank_percentile(spark, sf_dir):
    return costs.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", 0.95)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median_value FROM events GROUP BY event_type")
def median_latency(spark, sf_dir):
    return costs.medians(table(spark, sf_dir, "events"), "event_type", "value")


_SMOOTH = f"WITH {POINTS}, smoothed AS (SELECT *, CAST(sum(x) OVER w // count(x) OVER w AS BIGINT) AS s FROM points WINDOW w AS (PARTITION BY session_id ORDER BY i ROWS 1 PRECEDING))"
_CURVE = f"""{_SMOOTH}, c AS (SELECT session_id, abs(s - 2 * lag(s) OVER w + lag(s, 2) OVER w)::HUGEINT AS num, lag(s) OVER w - lag(s, 2) OVER w AS dx FROM smoothed WINDOW w AS (PARTITION BY session_id ORDER BY i)),
b AS (SELECT session_id, num, 1000000000000::HUGEINT + dx::HUGEINT * dx AS base FROM c),
kappa AS (SELECT session_id, CAST(max(num * 1000000000000000000::HUGEINT // (base * CAST(floor(sqrt(base::DOUBLE)) AS HUGEINT))) AS BIGINT) AS kappa_micros FROM b GROUP BY session_id)"""
_EPS = """eps AS (SELECT session_id, max(CASE WHEN n = 4 THEN v END) AS epsilon_micros FROM (
  SELECT session_id, count(s) OVER w AS n, CAST(floor(sqrt(greatest(0, 4 * sum(s::HUGEINT * s) OVER w - (sum(s) OVER w) * (sum(s) OVER w))::DOUBLE)) AS BIGINT) // 4 AS v FROM smoothed WINDOW w AS (PARTITION BY session_id ORDER BY i ROWS 3 PRECEDING)) GROUP BY session_id)"""
_DRIFT = f"{MEMBERS}, dhol AS (SELECT session_id, CAST(floor(sqrt(CAST(sum(CASE kind WHEN 'claim' THEN 333334 ELSE 333333 END * drift_micros::HUGEINT * drift_micros) // 1000000 AS DOUBLE))) AS BIGINT) AS delta_hol_micros FROM drifts GROUP BY session_id)"


@query(f"{_SMOOTH} SELECT session_id, i, s AS smoothed FROM smoothed")
def smooth_signal(spark, sf_dir):
    return metrics.smooth(d.points(spark, sf_dir), 2).select("session_id", "i", "smoothed")


@query(f"{_CURVE} SELECT * FROM kappa")
def curvature(spark, sf_dir):
    return metrics.curvature_micros(d.points(spark, sf_dir), PROFILE)


@query(f"{_SMOOTH}, {_EPS} SELECT * FROM eps")
def epsilon_rolling(spark, sf_dir):
    return metrics.epsilon_micros(d.points(spark, sf_dir), PROFILE)


@query(f"WITH {MEMBERS} SELECT * FROM drifts")
def set_drift(spark, sf_dir):
    return metrics.set_drift(d.members(spark, sf_dir))


@query(f"WITH {_DRIFT} SELECT * FROM dhol")
def graph_drift(spark, sf_dir):
    return metrics.graph_drift(metrics.set_drift(d.members(spark, sf_dir)), PROFILE)


@query(f"""{_CURVE}, {_EPS}, {_DRIFT}, m AS (SELECT * FROM kappa JOIN eps USING (session_id) JOIN dhol USING (session_id)),
p AS (SELECT *, CASE WHEN kappa_micros IS NOT NULL AND epsilon_micros IS NOT NULL THEN CAST(1000000000000::HUGEINT // (1010000 + 500000::HUGEINT * kappa_micros // 1000000 + 300000::HUGEINT * epsilon_micros // 1000000) AS BIGINT) END AS phi_star_micros FROM m)
SELECT *, CASE WHEN phi_star_micros IS NOT NULL THEN least(850000 - kappa_micros, phi_star_micros - 200000) END AS vkd_micros FROM p""")
def phi_vkd(spark, sf_dir):
    p = d.points(spark, sf_dir)
    joined = metrics.curvature_micros(p, PROFILE).join(metrics.epsilon_micros(p, PROFILE), "session_id").join(metrics.graph_drift(metrics.set_drift(d.members(spark, sf_dir)), PROFILE), "session_id")
    return metrics.phi_vkd(joined, PROFILE)


_TERMS = " OR ".join(f"contains(lower(last_text), '{t}')" for t in metrics.TERMS)


@query(f"""SELECT conv_id, session_length, tool_call_count, CAST(coalesce({_TERMS}, false) AS INTEGER) AS keyword_heuristic FROM (
  SELECT conv_id, count(*) FILTER (role IN ('user', 'assistant')) AS session_length, count(*) FILTER (role = 'system') AS tool_call_count, arg_max(text, turn) FILTER (role = 'assistant') AS last_text FROM conversations GROUP BY conv_id)""")
def transcript_features(spark, sf_dir):
    return metrics.transcript_features(table(spark, sf_dir, "conversations"), tool="system")


_LABELLED = f"WITH {POINTS}, {OUTCOMES}, {PREDICTORS}"
_RATES = """tp, tn, fp, fn, sensitivity_micros, specificity_micros, CAST((sensitivity_micros + specificity_micros) // 2 AS BIGINT) AS balanced_accuracy_micros, accuracy_micros"""
_COUNTED = """CAST(CASE WHEN tp + fn = 0 THEN 0 ELSE tp * 1000000 // (tp + fn) END AS BIGINT) AS sensitivity_micros, CAST(CASE WHEN tn + fp = 0 THEN 0 ELSE tn * 1000000 // (tn + fp) END AS BIGINT) AS specificity_micros,
  CAST((tp + tn) * 1000000 // (tp + tn + fp + fn) AS BIGINT) AS accuracy_micros"""


@query(f"WITH {OUTCOMES} SELECT session_id, handoff_micros FROM outcomes ORDER BY handoff_micros DESC, session_id DESC LIMIT 20")
def most_recent_n(spark, sf_dir):
    return evaluation.most_recent(d.outcomes(spark, sf_dir), 20).select("session_id", "handoff_micros")


@query("SELECT doc_id, d.doc_id IS NOT NULL AS in_left, l.doc_id IS NOT NULL AS in_right FROM (SELECT DISTINCT doc_id FROM documents) d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def alignment_check(spark, sf_dir):
    return integrity.unaligned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return integrity.duplicates(table(spark, sf_dir, "conversations"), "conv_id")


@query(f"{_LABELLED} SELECT metric, value AS threshold FROM labelled UNION SELECT metric, min(value) - 1 FROM labelled GROUP BY metric UNION SELECT metric, max(value) + 1 FROM labelled GROUP BY metric")
def candidate_thresholds(spark, sf_dir):
    return evaluation.candidate_thresholds(d.labelled(spark, sf_dir))


_CONF = f"""{_LABELLED}, c AS (SELECT metric, count(*) FILTER (y = 1 AND p) AS tp, count(*) FILTER (y = 0 AND NOT p) AS tn, count(*) FILTER (y = 0 AND p) AS fp, count(*) FILTER (y = 1 AND NOT p) AS fn
  FROM (SELECT *, value >= CASE metric WHEN 'peak' THEN {d.CUTS['peak']} WHEN 'level' THEN {d.CUTS['level']} ELSE {d.CUTS['n_points']} END AS p FROM labelled) GROUP BY metric), r AS (SELECT *, {_COUNTED} FROM c)"""


def _confusion(spark, sf_dir):
    cut = F.when(F.col("metric") == "peak", d.CUTS["peak"]).when(F.col("metric") == "level", d.CUTS["level"]).otherwise(d.CUTS["n_points"])
    return evaluation.confusion(d.labelled(spark, sf_dir).withColumn("pred", (F.col("value") >= cut).cast("int")), ["metric"])


@query(f"{_CONF} SELECT metric, {_RATES} FROM r")
def confusion_stats(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query(f"{_CONF}, s AS (SELECT metric, {_RATES} FROM r) SELECT * FROM s ORDER BY balanced_accuracy_micros DESC, metric LIMIT 1")
def best_comparator(spark, sf_dir):
    return evaluation.best_comparator(_confusion(spark, sf_dir), "metric")


def _fit_sql(op: str, order: str) -> str:
    return f"""{_LABELLED}, cand AS (SELECT metric, value AS threshold FROM labelled UNION SELECT metric, min(value) - 1 FROM labelled GROUP BY metric UNION SELECT metric, max(value) + 1 FROM labelled GROUP BY metric),
c AS (SELECT metric, threshold, count(*) FILTER (y = 1 AND value {op} threshold) AS tp, count(*) FILTER (y = 0 AND NOT value {op} threshold) AS tn, count(*) FILTER (y = 0 AND value {op} threshold) AS fp, count(*) FILTER (y = 1 AND NOT value {op} threshold) AS fn
  FROM cand JOIN labelled USING (metric) GROUP BY metric, threshold), r AS (SELECT *, {_COUNTED} FROM c), s AS (SELECT metric, threshold, {_RATES} FROM r)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY metric ORDER BY balanced_accuracy_micros DESC, specificity_micros DESC, sensitivity_micros DESC, threshold {order}) = 1"""


@query(_fit_sql(">=", "ASC"))
def fit_threshold_high(spark, sf_dir):
    return evaluation.fit_threshold(d.labelled(spark, sf_dir), "high")


@query(_fit_sql("<=", "DESC"))
def fit_threshold_low(spark, sf_dir):
    return evaluation.fit_threshold(d.labelled(spark, sf_dir), "low")


_PAIRS = f"{_LABELLED}, {PAIRED}"
_DELTA = """cls AS (SELECT comparator, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, count(*) FILTER (y = 1 AND (primary_ = y) <> (other = y)) AS dp, count(*) FILTER (y = 0 AND (primary_ = y) <> (other = y)) AS dn FROM paired GROUP BY comparator),
delta AS (SELECT comparator, CAST(sum(CASE WHEN y = 1 THEN neg ELSE pos END * (CAST(primary_ = y AS INTEGER) - CAST(other = y AS INTEGER))) AS BIGINT) AS numerator, any_value(pos) AS pos, any_value(neg) AS neg, any_value(dp) AS dp, any_value(dn) AS dn FROM paired JOIN cls USING (comparator) GROUP BY comparator)"""


@query(f"{_PAIRS}, c AS (SELECT comparator, count(*) FILTER (y = 1 AND other = 1) AS tp, count(*) FILTER (y = 0 AND other = 0) AS tn, count(*) FILTER (y = 0 AND other = 1) AS fp, count(*) FILTER (y = 1 AND other = 0) AS fn FROM paired GROUP BY comparator), r AS (SELECT *, {_COUNTED} FROM c) SELECT comparator, {_RATES} FROM r")
def comparator_table(spark, sf_dir):
    return evaluation.confusion(d.paired(spark, sf_dir), ["comparator"], pred="other")


@query(f"{_PAIRS}, {_DELTA} SELECT comparator, numerator, 2 * pos * neg AS denominator FROM delta")
def delta_ba(spark, sf_dir):
    return evaluation.delta_ba(d.paired(spark, sf_dir))


@query(f"""{_PAIRS}, {_DELTA}, grid AS (SELECT delta.*, i, j FROM delta, range(0, 21) a(i), range(0, 21) b(j) WHERE i <= dp AND j <= dn),
w AS (SELECT comparator, numerator, neg * (2 * i - dp) + pos * (2 * j - dn) AS v, factorial(CAST(dp AS INTEGER)) // factorial(CAST(i AS INTEGER)) // factorial(CAST(dp - i AS INTEGER)) * (factorial(CAST(dn AS INTEGER)) // factorial(CAST(j AS INTEGER)) // factorial(CAST(dn - j AS INTEGER))) AS c FROM grid),
t AS (SELECT comparator, numerator, sum(CASE WHEN v >= numerator THEN c ELSE 0 END)::HUGEINT AS hits, sum(c)::HUGEINT AS total FROM w GROUP BY ALL)
SELECT comparator, numerator AS observed, CAST((hits * 1000000 + total - 1) // total AS BIGINT) AS p_micros, numerator > 0 AND (hits * 1000000 + total - 1) // total <= 50000 AS significant FROM t""")
def permutation_p(spark, sf_dir):
    return evaluation.permutation_test(d.paired(spark, sf_dir)).select("comparator", "observed", "p_micros", "significant")


# Binomials by their recurrence; 127 bits hold up to 106 discordant pairs.
@query(f"""{_PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)}, every AS (
  SELECT s.session_id, y, CAST(peak >= {d.CUTS["peak"]} AS INTEGER) AS p, CAST(level >= {d.CUTS["level"]} AS INTEGER) AS o1, CAST(n_points >= {d.CUTS["n_points"]} AS INTEGER) AS o2 FROM stats s JOIN outcomes USING (session_id)
), pairs AS (SELECT y, p, 'level' AS comparator, o1 AS other FROM every UNION ALL SELECT y, p, 'n_points', o2 FROM every
), k AS (SELECT comparator, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, count(*) FILTER (y = 1 AND p <> other) AS dp, count(*) FILTER (y = 0 AND p <> other) AS dn FROM pairs GROUP BY comparator
), o AS (SELECT comparator, CAST(sum(CASE WHEN y = 1 THEN neg ELSE pos END * (CAST(p = y AS INTEGER) - CAST(other = y AS INTEGER))) AS BIGINT) AS numerator FROM pairs JOIN k USING (comparator) GROUP BY comparator
), b AS (SELECT n, 0 AS i, 1::HUGEINT AS c FROM (SELECT dp AS n FROM k UNION SELECT dn FROM k) UNION ALL SELECT n, i + 1, c * (n - i) // (i + 1) FROM b WHERE i < n
), t AS (SELECT comparator, numerator, dp + dn AS m, sum(CASE WHEN neg * (2 * x.i - dp) + pos * (2 * z.i - dn) >= numerator THEN x.c * z.c ELSE 0 END)::HUGEINT AS hits, sum(x.c * z.c)::HUGEINT AS total FROM k JOIN o USING (comparator) JOIN b x ON x.n = dp JOIN b z ON z.n = dn GROUP BY ALL)
SELECT comparator, m AS discordant_n, numerator AS observed, CAST(hits AS VARCHAR) AS p_numerator, CAST(total AS VARCHAR) AS p_denominator, CAST((hits * 1000000 + total - 1) // total AS BIGINT) AS p_micros FROM t""")
def permutation_all_sessions(spark, sf_dir):
    """The paired test over every session, not the newest twenty."""
    return evaluation.permutation_test(d.paired(spark, sf_dir, None)).select("comparator", "discordant_n", "observed", "p_numerator", "p_denominator", "p_micros")


_POW = "CASE WHEN {1} = 0 THEN 1::HUGEINT ELSE list_reduce(list_transform(range(0, {1}), lambda q: CAST({0} AS HUGEINT)), lambda x, y: x * y) END"


@query(f"""{_PAIRS}, st AS (SELECT comparator, y, count(*) FILTER (x = -1) AS a, count(*) FILTER (x = 0) AS b, count(*) FILTER (x = 1) AS c, count(*) AS n FROM (SELECT *, CAST(primary_ = y AS INTEGER) - CAST(other = y AS INTEGER) AS x FROM paired) GROUP BY ALL),
cells AS (SELECT st.*, i, k, n - i - k AS m FROM st, range(0, 21) s(i), range(0, 21) t(k) WHERE i + k <= n),
ways AS (SELECT comparator, y, n, k - i AS s, CAST(factorial(CAST(n AS INTEGER)) // factorial(CAST(i AS INTEGER)) // factorial(CAST(k AS INTEGER)) // factorial(CAST(m AS INTEGER)) AS HUGEINT) * {_POW.format('a', 'i')} * {_POW.format('b', 'm')} * {_POW.format('c', 'k')} AS w FROM cells),
sums AS (SELECT comparator, y, n, s, sum(w)::HUGEINT AS w FROM ways GROUP BY ALL HAVING sum(w) > 0),
dist AS (SELECT p.comparator, p.n AS pos, q.n AS neg, p.s * q.n + q.s * p.n AS v, sum(p.w * q.w)::HUGEINT AS w FROM sums p JOIN sums q ON p.comparator = q.comparator AND p.y = 1 AND q.y = 0 GROUP BY ALL),
cum AS (SELECT *, sum(w) OVER (PARTITION BY comparator ORDER BY v)::HUGEINT AS c, sum(w) OVER (PARTITION BY comparator)::HUGEINT AS t FROM dist),
q AS (SELECT comparator, pos, neg, min(CASE WHEN c >= greatest(1, (t * 25 + 999) // 1000) THEN v END) AS lo, min(CASE WHEN c >= greatest(1, (t * 975 + 999) // 1000) THEN v END) AS hi FROM cum GROUP BY ALL)
SELECT comparator, CAST(floor(lo * 1000000 / (2.0::DOUBLE * pos * neg)) AS BIGINT) AS lower_micros, CAST(ceil(hi * 1000000 / (2.0::DOUBLE * pos * neg)) AS BIGINT) AS upper_micros FROM q""")
def bootstrap_ci(spark, sf_dir):
    return evaluation.bootstrap_interval(d.paired(spark, sf_dir)).select("comparator", "lower_micros", "upper_micros")


@query("""SELECT user_id, event_id, gap, disordered FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY idx, event_id) <> idx AS gap, coalesce(lag({'ts': ts, 'id': event_id}) OVER (PARTITION BY user_id ORDER BY idx, event_id) >= {'ts': ts, 'id': event_id}, false) AS disordered
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS idx FROM events)) WHERE gap OR disordered""")
def ledger_monotone(spark, sf_dir):
    # Every event is a ledger row; some have the index of the row after them.
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)
    return chain.monotone_ledger(table(spark, sf_dir, "events").withColumn("idx", index), "user_id", ["idx", "event_id"], ["ts", "event_id"]).select("user_id", "event_id", "gap", "disordered")


@query("SELECT event_id, late BETWEEN 0 AND 600000000 AS in_time FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS late FROM events) WHERE late IS NOT NULL")
def lag_deadline(spark, sf_dir):
    at = d.micros(F.col("ts"))
    e = table(spark, sf_dir, "events").withColumn("late", at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.filter("late IS NOT NULL").select("event_id", F.col("late").between(0, 600_000_000).alias("in_time"))


@query("""SELECT conv_id, turn, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS assistant_turns,
  least(count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 8) AS observed_turns FROM conversations""")
def outcome_window(spark, sf_dir):
    n = F.count_if(F.col("role") == "assistant").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("assistant_turns"), F.least(n, F.lit(8)).alias("observed_turns"))


@query("""SELECT source, n_items, n_bytes, CASE WHEN n_items > 100 THEN 'item_limit_exceeded' WHEN n_bytes > 200000 THEN 'total_size_limit_exceeded' WHEN largest > 30000 THEN 'file_size_limit_exceeded' END AS violation
FROM (SELECT source, count(*) AS n_items, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, max(octet_length(encode(text))) AS largest FROM documents GROUP BY source)""")
def file_caps(spark, sf_dir):
    return integrity.within_caps(table(spark, sf_dir, "documents").withColumn("size", F.octet_length("text")), "source", "size", 100, 200_000, 30_000)


@query("""SELECT event_id, regexp_full_match(h, '[0-9A-Fa-f]{64}') AS is_digest, regexp_full_match(h, '[0-9a-f]{64}') AS is_lower FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN upper(sha256(props)) WHEN 1 THEN substr(sha256(props), 2) WHEN 2 THEN 'z' || substr(sha256(props), 2) ELSE sha256(props) END AS h FROM events)""")
def hex_digest_predicate(spark, sf_dir):
    s, k = F.sha2("props", 256), F.col("event_id") % 4
    h = F.when(k == 0, F.upper(s)).when(k == 1, F.substring(s, 2, 64)).when(k == 2, F.concat(F.lit("z"), F.substring(s, 2, 64))).otherwise(s)
    return table(spark, sf_dir, "events").select("event_id", text.is_sha256(h).alias("is_digest"), text.is_lower_sha256(h).alias("is_lower"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events")
def canonical_json_strict(spark, sf_dir):
    from ..functions.strict_json import canonical

    return table(spark, sf_dir, "events").select("event_id", canonical("props").alias("c")).select("event_id", "c.canonical")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS found, CASE WHEN event_id % 2 = 1 THEN 'json_pointer_missing' END AS error FROM events")
def json_pointer(spark, sf_dir):
    from ..functions.strict_json import pointed

    pointer = F.when(F.col("event_id") % 2 == 0, "/k").otherwise("/a~1b")
    return table(spark, sf_dir, "events").select("event_id", pointed("props", pointer).alias("p")).select("event_id", "p.*")


_SEED, _OTHER = "33" * 32, "44" * 32


def _signed(spark, sf_dir):
    """An envelope for each receipt; some changed after signing, some by another key."""
    from ..operators.envelopes import sign_column

    r = d.receipts(spark, sf_dir).select("event_id", "run_id", "action").repartition(d.tasks(spark, sf_dir), "event_id")
    payload = F.to_json(F.struct(F.col("action"), F.col("event_id"), F.col("run_id")))
    return r.select("event_id", sign_column(payload, F.when(F.col("event_id") % 5 == 0, _OTHER).otherwise(_SEED)).alias("raw")).withColumn("raw", F.when(F.col("event_id") % 7 == 0, F.replace("raw", F.lit('"run_id"'), F.lit('"run_iD"'))).otherwise(F.col("raw")))


@query(f"WITH {RECEIPTS} SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'payload_hash_mismatch;signature_invalid' ELSE '' END AS errors FROM receipts")
def envelope_inspection(spark, sf_dir):
    from ..operators.envelopes import inspected

    return _signed(spark, sf_dir).select("event_id", inspected("raw").alias("i")).select("event_id", F.array_join("i.errors", ";").alias("errors"))


@query(f"WITH {RECEIPTS} SELECT event_id, event_id % 7 <> 0 AS valid FROM receipts")
def ed25519_verify(spark, sf_dir):
    from ..functions.ed25519 import verified
    from ..functions.strict_json import pointed

    parts = {c: pointed("raw", F.lit(p))["found"] for c, p in (("key", "/proof/public_key"), ("sig", "/proof/signature"), ("message", "/payload"))}
    bare = lambda c: F.replace(c, F.lit('"'), F.lit(""))
    rows = _signed(spark, sf_dir).withColumns(parts)
    return rows.select("event_id", verified(bare(F.col("key")), bare(F.col("sig")), F.col("message")).alias("valid"))


_LEDGER = f"""WITH RECURSIVE {OUTCOMES.strip()}, newest AS (
  SELECT *, row_number() OVER (ORDER BY handoff_micros, session_id) AS i FROM (SELECT * FROM outcomes ORDER BY handoff_micros DESC, session_id DESC LIMIT 20)
), fold AS (
  SELECT i, '{{"at":' || handoff_micros || ',"session":' || session_id || '}}' AS content, '' AS previous_hash, sha256('{{"at":' || handoff_micros || ',"session":' || session_id || '}}|') AS row_hash FROM newest WHERE i = 1
  UNION ALL SELECT n.i, '{{"at":' || handoff_micros || ',"session":' || session_id || '}}', f.row_hash, sha256('{{"at":' || handoff_micros || ',"session":' || session_id || '}}|' || f.row_hash) FROM fold f JOIN newest n ON n.i = f.i + 1
)"""


def _ledger(spark, sf_dir):
    from ..operators import ledger

    newest = evaluation.most_recent(d.outcomes(spark, sf_dir), 20)
    content = F.to_json(F.struct(F.col("handoff_micros").alias("at"), F.col("session_id").alias("session")))
    return ledger.build(newest, ["handoff_micros", "session_id"], content)


@query(f"{_LEDGER} SELECT CAST(i AS INTEGER) AS index, content, previous_hash, row_hash FROM fold")
def ledger_hash_chain(spark, sf_dir):
    return _ledger(spark, sf_dir)


@query(f"{_LEDGER} SELECT count(*) AS n, sha256(string_agg(row_hash, ',' ORDER BY i)) AS seal FROM fold")
def ledger_seal(spark, sf_dir):
    from ..operators import ledger

    return ledger.seal(_ledger(spark, sf_dir))


@query(f"{_LEDGER} SELECT CAST(i AS INTEGER) AS index, i % 5 = 0 AS bad_hash, i % 5 = 1 AND i > 1 AS bad_link FROM fold WHERE i % 5 = 0 OR (i % 5 = 1 AND i > 1)")
def ledger_faults(spark, sf_dir):
    from ..operators import ledger

    changed = _ledger(spark, sf_dir).withColumn("row_hash", F.when(F.col("index") % 5 == 0, F.sha2(F.col("row_hash"), 256)).otherwise(F.col("row_hash")))
    return ledger.faults(changed).select("index", "bad_hash", "bad_link")


@query(f"""{_LABELLED}, newest AS (SELECT session_id FROM outcomes ORDER BY handoff_micros DESC, session_id DESC LIMIT 20), train AS (SELECT * FROM labelled WHERE session_id NOT IN (SELECT session_id FROM newest)),
cand AS (SELECT metric, value AS threshold FROM train UNION SELECT metric, min(value) - 1 FROM train GROUP BY metric UNION SELECT metric, max(value) + 1 FROM train GROUP BY metric),
c AS (SELECT metric, threshold, count(*) FILTER (y = 1 AND value >= threshold) AS tp, count(*) FILTER (y = 0 AND value < threshold) AS tn, count(*) FILTER (y = 0 AND value >= threshold) AS fp, count(*) FILTER (y = 1 AND value < threshold) AS fn FROM cand JOIN train USING (metric) GROUP BY metric, threshold),
r AS (SELECT *, {_COUNTED} FROM c), s AS (SELECT metric, threshold, {_RATES} FROM r), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY metric ORDER BY balanced_accuracy_micros DESC, specificity_micros DESC, sensitivity_micros DESC, threshold) = 1)
SELECT session_id, metric, value, threshold, CAST(value >= threshold AS INTEGER) AS pred FROM labelled JOIN newest USING (session_id) JOIN best USING (metric)""")
def frozen_predictions(spark, sf_dir):
    from ..operators import ledger

    rows = d.labelled(spark, sf_dir)
    newest = evaluation.most_recent(d.outcomes(spark, sf_dir), 20).select("session_id")
    frozen = evaluation.fit_threshold(rows.join(newest, "session_id", "left_anti"), "high")
    return ledger.predict(rows.join(newest, "session_id", "left_semi"), frozen, "high").select("session_id", "metric", "value", "threshold", "pred")


@query(f"""{_GATE} SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 13 = 0 AND worst <> 0 THEN 'decision_recompute_mismatch' END, CASE WHEN event_id % 19 = 0 THEN 'reason_codes_recompute_mismatch' END], lambda x: x IS NOT NULL), ';') AS errors FROM gate""")
def decision_recompute(spark, sf_dir):
    from ..operators import ledger

    rows = decided(spark, sf_dir)
    claimed = F.when(F.col("event_id") % 13 == 0, "COMMIT").otherwise(F.col("decision"))
    reasons = F.when(F.col("event_id") % 19 == 0, F.concat("reason_codes", F.array(F.lit("x:y")))).otherwise(F.col("reason_codes"))
    return rows.select("event_id", F.array_join(ledger.recompute_errors(claimed, F.col("decision"), reasons, F.col("reason_codes")), ";").alias("errors"))


@query(f"""{_PAIRS}, {_DELTA}, grid AS (SELECT delta.*, i, j FROM delta, range(0, 21) a(i), range(0, 21) b(j) WHERE i <= dp AND j <= dn),
w AS (SELECT comparator, numerator, neg * (2 * i - dp) + pos * (2 * j - dn) AS v, factorial(CAST(dp AS INTEGER)) // factorial(CAST(i AS INTEGER)) // factorial(CAST(dp - i AS INTEGER)) * (factorial(CAST(dn AS INTEGER)) // factorial(CAST(j AS INTEGER)) // factorial(CAST(dn - j AS INTEGER))) AS c FROM grid),
t AS (SELECT comparator, numerator, sum(CASE WHEN v >= numerator THEN c ELSE 0 END)::HUGEINT AS hits, sum(c)::HUGEINT AS total FROM w GROUP BY ALL),
ba AS (SELECT comparator, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, count(*) FILTER (y = 1 AND primary_ = 1) AS tp, count(*) FILTER (y = 0 AND primary_ = 0) AS tn, count(*) FILTER (y = 1 AND other = 1) AS tp2, count(*) FILTER (y = 0 AND other = 0) AS tn2 FROM paired GROUP BY comparator),
m AS (SELECT comparator, pos, neg, (tp * 1000000 // greatest(pos, 1) + tn * 1000000 // greatest(neg, 1)) // 2 > (tp2 * 1000000 // greatest(pos, 1) + tn2 * 1000000 // greatest(neg, 1)) // 2 AS beats FROM ba),
n AS (SELECT min(pos) AS pos, min(neg) AS neg, bool_and(beats) AS beats_all FROM m),
g AS (SELECT bool_and(numerator > 0 AND (hits * 1000000 + total - 1) // total <= 50000) AND any_value(pos >= 5 AND neg >= 3) AS significant_against_all FROM t, n)
SELECT beats_all, significant_against_all, CASE WHEN pos < 5 OR neg < 3 THEN 'INSUFFICIENT_SAMPLE' WHEN beats_all AND significant_against_all THEN 'PRIMARY_SIGNAL_CLEARS_PREREGISTERED_GATE' ELSE 'DOES_NOT_CLEAR_PREREGISTERED_GATE' END AS disposition FROM g, n""")
def trial_disposition(spark, sf_dir):
    pairs = d.paired(spark, sf_dir)
    return evaluation.disposition(pairs, evaluation.permutation_test(pairs))


@query(f"""WITH {RECEIPTS} SELECT event_id, CASE WHEN event_id % 37 = 0 THEN 'source_schema_unsupported' WHEN event_id % 13 = 0 THEN 'source_issuer_invalid' WHEN event_id % 41 = 0 THEN 'source_sequence_invalid'
  WHEN sequence > 0 AND event_id % 17 = 0 THEN 'source_parent_hash_invalid' WHEN event_id % 43 = 0 THEN 'source_action_invalid' WHEN event_id % 19 = 0 THEN 'source_evidence_id_invalid' WHEN event_id % 23 = 0 THEN 'source_evidence_hash_invalid' END AS error FROM receipts""")
def source_payload_errors(spark, sf_dir):
    from ..operators import validate

    e = F.col("event_id")
    one = F.struct(F.lit("props").alias("id"), F.when(e % 23 == 0, "beef").otherwise(F.upper("commitment")).alias("sha256"))
    payload = F.struct(
        F.when(e % 37 == 0, "source.v0").otherwise(validate.SOURCE_SCHEMA).alias("schema"), F.when(e % 13 == 0, "").otherwise("agent").alias("issuer"), F.col("issued").cast("string").alias("issued_at"), F.col("run_id").cast("string").alias("run_id"),
        F.when(e % 41 == 0, -1).otherwise(F.col("sequence")).alias("sequence"), F.when(F.col("sequence") > 0, F.when(e % 17 == 0, "x").otherwise(F.col("source_sha256"))).alias("parent_hash"),
        F.struct(F.col("action").alias("type"), F.when(e % 43 != 0, "lookup").alias("name")).alias("action"), F.lit("c").alias("claim"), F.when(e % 19 == 0, F.array(one, one)).otherwise(F.array(one)).alias("evidence"),
    )
    return d.receipts(spark, sf_dir).select("event_id", validate.source_payload(payload).alias("error"))


@query("""SELECT conv_id, CASE WHEN NOT contiguous THEN 'transcript_index_not_contiguous' WHEN other THEN 'transcript_role_invalid' END AS error FROM (
  SELECT conv_id, bool_and(turn = r) AS contiguous, bool_or(role NOT IN ('user', 'assistant', 'tool')) AS other FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations) GROUP BY conv_id)""")
def transcript_errors(spark, sf_dir):
    from ..operators import validate

    turn = F.struct(F.col("turn").alias("index"), "role", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("tool_name"))
    # A conversation is one document; its turns come together as they do in a session file.
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", validate.transcript(F.col("turns")).alias("error"))


@query(f"WITH {POINTS} SELECT session_id, CASE WHEN bool_or(x > 200000 OR x < 0) THEN 'signal_out_of_range' END AS error FROM points GROUP BY session_id")
def signal_errors(spark, sf_dir):
    from ..operators import validate

    scaled = F.when(F.col("x") > 200_000, F.lit(1_000_001)).otherwise(F.col("x"))
    return d.points(spark, sf_dir).groupBy("session_id").agg(F.collect_list(scaled).alias("s")).select("session_id", validate.signal(F.col("s")).alias("error"))


@query(f"""WITH {MEMBERS}, u AS (SELECT DISTINCT session_id FROM members)
SELECT session_id, CASE session_id % 6 WHEN 1 THEN 'graph_node_hash_invalid' WHEN 2 THEN 'graph_nodes_not_sorted' WHEN 3 THEN 'graph_relation_dangling' WHEN 4 THEN 'graph_supports_invalid' WHEN 5 THEN 'graph_relations_not_sorted' END AS error FROM u""")
def graph_errors(spark, sf_dir):
    from ..operators import validate

    k = F.col("session_id") % 6
    node = lambda i, h: F.struct(i.alias("id"), h.alias("content_hash"))
    hashed = lambda x: F.when(k == 1, F.upper(F.sha2(x, 256))).otherwise(F.sha2(x, 256))
    m = d.members(spark, sf_dir)
    kinds = {n: m.filter(F.col("kind") == n).groupBy("session_id").agg(F.array_sort(F.collect_set("element")).alias(n)) for n in ("claim", "evidence")}
    g = kinds["claim"].join(kinds["evidence"], "session_id")
    claims = F.transform("claim", lambda x: node(F.concat(F.lit("c-"), x), hashed(x)))
    evidence = F.transform("evidence", lambda x: node(F.concat(F.lit("e-"), F.substring(F.sha2(x, 256), 1, 12)), hashed(x)))
    evidence = F.array_sort(evidence)
    relations = F.transform(evidence, lambda x: F.struct(x["id"].alias("src"), F.concat(F.lit("c-"), F.get("claim", F.lit(0))).alias("dst"), F.lit("supports").alias("relation_type")))
    relations = F.when(k == 3, F.transform(relations, lambda r: r.withField("dst", F.lit("nowhere")))).when(k == 4, F.transform(relations, lambda r: r.withField("src", r["dst"]))).when(k == 5, F.concat(relations, F.slice(relations, 1, 1))).otherwise(relations)
    claims = F.when(k == 2, F.concat(F.array(node(F.lit("z"), F.sha2(F.lit("z"), 256))), claims)).otherwise(claims)
    return g.select("session_id", claims.alias("c"), evidence.alias("e"), relations.alias("r")).select("session_id", validate.graph(F.col("c"), F.col("e"), F.col("r")).alias("error"))


_CONV = """WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id),
o AS (SELECT *, conv_id % 2 = 0 AS positive, len(list_filter(roles, lambda x: x = 'assistant')) AS total, CASE WHEN conv_id % 2 = 0 THEN len(list_filter(roles[1:conv_id % 4], lambda x: x = 'assistant')) + CASE WHEN conv_id % 10 = 0 THEN 1 ELSE 0 END END AS seen, conv_id % 3 = 0 AS ended FROM c)"""


@query(f"""{_CONV} SELECT conv_id, CASE WHEN positive AND coalesce(roles[conv_id % 4 + 1], '') <> 'user' THEN 'outcome_correction_not_by_user'
  WHEN positive AND conv_id % 10 = 0 THEN 'outcome_turn_count_mismatch' WHEN NOT positive AND total < 3 AND NOT ended THEN 'outcome_window_incomplete' WHEN NOT positive AND least(total, 3) <> 1 THEN 'outcome_turn_count_mismatch' END AS error FROM o""")
def outcome_errors(spark, sf_dir):
    from ..operators import validate

    k = F.col("conv_id") % 4
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("events"))
    seen = F.size(F.filter(F.slice("events", F.lit(1), k.cast("int")), lambda e: e["role"] == "assistant")) + F.when(F.col("conv_id") % 10 == 0, 1).otherwise(0)
    positive, ended = F.col("conv_id") % 2 == 0, F.col("conv_id") % 3 == 0
    o = F.struct(positive.cast("int").alias("outcome"), F.when(positive, k).alias("correction_index"), F.when(positive, seen).otherwise(1).alias("observed_turns"), ended.alias("ended"))
    return rows.select("conv_id", validate.outcome_against(o, F.col("events"), ended, 3).alias("error"))
