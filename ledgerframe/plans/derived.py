"""Receipts, sessions and predictions derived from the supplied tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.gate import Policy, Rule

#: 2024-01-25, 2024-01-16 and 2024-01-08 in microseconds since 1970.
NOW, HANDOFF, MIDDLE = 1_706_140_800_000_000, 1_705_363_200_000_000, 1_704_672_000_000_000
POLICY = Policy("ops", "1", ("view", "click", "purchase"), ("props",), (Rule("ok", "props", "/ok", 1),), 14 * 86_400)
STRICT = Policy("ops", "2", ("view", "click"), ("props",), (Rule("ok", "props", "/ok", 1),), 10 * 86_400, "NO_BADGE", True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task signs, verifies or renders: Python's work on a row is worth many of its bytes.
ROWS_PER_TASK = 50_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for work on every event: as many as there are cores, more as the table grows, so that no task's share does."""
    rows = table(spark, sf_dir, "events").count()  # from the files' footers
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def micros(ts: Column) -> Column:
    """Of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receipt per event: a run per user, an artifact from its properties, some missing or changed."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    made = F.concat(F.lit('{"k":'), k.cast("string"), F.lit(',"ok":'), F.when(k < 80, "1").otherwise("0"), F.lit("}"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        "event_id", F.col("user_id").alias("run_id"), (F.row_number().over(w) - 1).cast("long").alias("sequence"),
        F.col("event_type").alias("action"), micros(F.col("ts")).alias("issued"), "props", "value",
        F.sha2(made, 256).alias("commitment"),
        F.when(F.col("event_id") % 17 != 0, F.when(F.col("event_id") % 23 == 0, F.concat(made, F.lit(" "))).otherwise(made)).alias("artifact"),
        F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "props"), 256).alias("source_sha256"),
    )


RECEIPTS = """
base AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), made AS (
  SELECT *, '{"k":' || k || ',"ok":' || CASE WHEN k < 80 THEN '1' ELSE '0' END || '}' AS m FROM base
), receipts AS (
  SELECT event_id, user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence, event_type AS action,
    epoch_us(ts) AS issued, props, value, sha256(m) AS commitment,
    CASE WHEN event_id % 17 <> 0 THEN CASE WHEN event_id % 23 = 0 THEN m || ' ' ELSE m END END AS artifact,
    sha256(event_id || '|' || props) AS source_sha256
  FROM made
)"""


def checks(policy: Policy) -> dict[str, Column]:
    from ..operators import gate

    return {
        "policy": gate.action_check(F.col("action"), policy),
        "freshness": gate.freshness_check(F.col("issued"), NOW, policy),
        "evidence": gate.evidence_check("props", F.col("commitment"), F.col("artifact")),
        "claim_support": claims(policy, F.col("artifact")),
    }


def claims(policy: Policy, artifact: Column) -> Column:
    """All claim rules on the one artifact of a receipt."""
    from ..operators.gateway import claim_support

    return claim_support(policy)(F.when(artifact.isNotNull(), F.create_map(F.lit("props"), artifact)))


def decisions_sql(name: str, policy: Policy) -> str:
    actions = ", ".join(f"'{a}'" for a in policy.allowed_actions)
    return f"""
{name}_codes AS (
  SELECT *, ({NOW} - issued) // 1000000 AS age FROM receipts
), {name}_reasons AS (
  SELECT *, CASE WHEN action NOT IN ({actions}) THEN 'policy:action_not_allowed' END AS r1,
    CASE WHEN age < 0 THEN 'freshness:receipt_from_future' WHEN age > {policy.max_age_seconds} THEN 'freshness:receipt_expired' END AS r2,
    CASE WHEN artifact IS NULL THEN 'evidence:artifact_missing:props' WHEN sha256(artifact) <> commitment THEN 'evidence:artifact_hash_mismatch:props' END AS r3,
    CASE WHEN artifact IS NULL THEN 'claim_support:claim_artifact_missing:ok' WHEN json_extract_string(artifact, '$.ok') <> '1' THEN 'claim_support:claim_fact_mismatch:ok' END AS r4
  FROM {name}_codes
), {name} AS (
  SELECT *, CASE WHEN r1 IS NOT NULL OR r2 LIKE '%future' OR r3 LIKE '%mismatch%' OR r4 LIKE '%mismatch%' THEN 2
    WHEN r2 IS NOT NULL OR r3 IS NOT NULL OR r4 IS NOT NULL THEN 1 ELSE 0 END AS worst FROM {name}_reasons
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal points of each session before the handoff."""
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts"))).filter(F.col("at") < HANDOFF)
    x = F.least(F.lit(1_000_000), F.round(F.col("value") * 2000)).cast("long")
    return e.select(F.col("user_id").alias("session_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"), x.alias("x"))


POINTS = f"""
points AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
    CAST(least(1000000, round(value * 2000)) AS BIGINT) AS x FROM events WHERE epoch_us(ts) < {HANDOFF}
)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph elements of each session before the middle date, and between it and the handoff."""
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts"))).filter(F.col("at") < HANDOFF)
    kinds = F.array(F.struct(F.lit("claim").alias("kind"), F.col("event_type").alias("element")), F.struct(F.lit("evidence").alias("kind"), F.col("props").alias("element")), F.struct(F.lit("relation").alias("kind"), F.concat_ws("|", "event_type", "props").alias("element")))
    return e.select(F.col("user_id").alias("session_id"), F.explode(kinds).alias("m"), (F.col("at") < MIDDLE).alias("before"), (F.col("at") >= MIDDLE).alias("now")).select("session_id", "m.*", "before", "now")


MEMBERS = f"""
elements AS (
  SELECT user_id AS session_id, unnest([{{'kind': 'claim', 'element': event_type}}, {{'kind': 'evidence', 'element': props}}, {{'kind': 'relation', 'element': event_type || '|' || props}}]) AS m, epoch_us(ts) AS us
  FROM events WHERE epoch_us(ts) < {HANDOFF}
), members AS (
  SELECT session_id, m.kind AS kind, m.element AS element, bool_or(us < {MIDDLE}) AS before, bool_or(us >= {MIDDLE}) AS now FROM elements GROUP BY ALL
), drifts AS (
  SELECT session_id, kind, CAST((count(*) - count(*) FILTER (before AND now)) * 1000000 // count(*) AS BIGINT) AS drift_micros FROM members GROUP BY ALL
)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 if one of a session's first three events from the handoff on is an error."""
    e = table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts"))).filter(F.col("at") >= HANDOFF)
    r = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("r <= 3")
    return r.groupBy(F.col("user_id").alias("session_id")).agg(F.max((F.col("event_type") == "error").cast("int")).alias("y"), F.min("at").alias("handoff_micros"))


OUTCOMES = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE epoch_us(ts) >= {HANDOFF}
), outcomes AS (
  SELECT user_id AS session_id, CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INTEGER) AS y, min(epoch_us(ts)) AS handoff_micros FROM ranked WHERE r <= 3 GROUP BY user_id
)"""


def predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, metric, value): integer inputs of threshold rules, from before the handoff."""
    p = points(spark, sf_dir)
    g = p.groupBy("session_id").agg(F.count("*").alias("n_points"), F.max("x").alias("peak"), F.call_function("div", F.sum("x"), F.count("x")).alias("level"))
    return g.select("session_id", F.stack(F.lit(3), F.lit("n_points"), F.col("n_points"), F.lit("peak"), F.col("peak"), F.lit("level"), F.col("level")).alias("metric", "value"))


PREDICTORS = """
stats AS (
  SELECT session_id, count(*) AS n_points, max(x) AS peak, CAST(sum(x) // count(x) AS BIGINT) AS level FROM points GROUP BY session_id
), predictors AS (
  SELECT session_id, unnest([{'metric': 'n_points', 'value': n_points}, {'metric': 'peak', 'value': peak}, {'metric': 'level', 'value': level}], recursive := true) FROM stats
), labelled AS (
  SELECT p.*, y, handoff_micros FROM predictors p JOIN outcomes USING (session_id)
)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors(spark, sf_dir).join(outcomes(spark, sf_dir), "session_id")


#: Paired predictions of the newest twenty sessions: a peak rule against two others.
CUTS = {"peak": 190_000, "level": 95_000, "n_points": 30}


def paired(spark: SparkSession, sf_dir: str, newest_n: int | None = 20) -> DataFrame:
    from ..operators.evaluation import most_recent

    newest = outcomes(spark, sf_dir) if newest_n is None else most_recent(outcomes(spark, sf_dir), newest_n)
    wide = predictors(spark, sf_dir).join(newest, "session_id").groupBy("session_id", "y").agg(*(F.max(F.when(F.col("metric") == m, (F.col("value") >= c).cast("int"))).alias(m) for m, c in CUTS.items()))
    return wide.select("session_id", "y", F.col("peak").alias("primary"), F.stack(F.lit(2), F.lit("level"), F.col("level"), F.lit("n_points"), F.col("n_points")).alias("comparator", "other"))


PAIRED = f"""
newest AS (
  SELECT * FROM outcomes ORDER BY handoff_micros DESC, session_id DESC LIMIT 20
), wide AS (
  SELECT s.session_id, y, CAST(peak >= {CUTS["peak"]} AS INTEGER) AS primary_, CAST(level >= {CUTS["level"]} AS INTEGER) AS p_level, CAST(n_points >= {CUTS["n_points"]} AS INTEGER) AS p_n
  FROM stats s JOIN newest USING (session_id)
), paired AS (
  SELECT session_id, y, primary_, 'level' AS comparator, p_level AS other FROM wide UNION ALL SELECT session_id, y, primary_, 'n_points', p_n FROM wide
)"""
