"""Exact integer metrics of sessions: signals, graphs, transcripts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integers import SCALE, div, isqrt
from ..functions.text import mentions


@dataclass(frozen=True)
class Profile:
    """Weights and windows of a receiver; micros are millionths."""

    alpha_k: int = 500_000
    alpha_e: int = 300_000
    claim_weight: int = 333_334
    evidence_weight: int = 333_333
    relation_weight: int = 333_333
    epsilon_window: int = 4
    smoothing_window: int = 1
    i_c: int = 1_000_000
    kappa_critical: int = 850_000
    phi_min: int = 200_000
    stability_delta: int = 10_000

    def __post_init__(self) -> None:
        values = [*vars(self).values()]
        if any(type(v) is not int or not 0 <= v < 2**53 for v in values):
            raise ValueError("profile_value_invalid")
        if self.claim_weight + self.evidence_weight + self.relation_weight != SCALE:
            raise ValueError("profile_weights_invalid")
        if self.epsilon_window < 2 or self.smoothing_window < 1 or self.i_c < 1:
            raise ValueError("profile_window_invalid")


def smooth(points: DataFrame, window: int, key: str = "session_id", order: str = "i", value: str = "x") -> DataFrame:
    """Adds ``smoothed``: the floor of the trailing mean."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - window, 0)
    return points.withColumn("smoothed", div(F.sum(value).over(w), F.count(value).over(w)))


def curvature(points: DataFrame, profile: Profile, key: str = "session_id", order: str = "i") -> DataFrame:
    """Second difference and slope of three consecutive smoothed points, at the last of them."""
    w = Window.partitionBy(key).orderBy(order)
    rows = smooth(points, profile.smoothing_window, key, order).withColumns({"x0": F.lag("smoothed", 2).over(w), "x1": F.lag("smoothed", 1).over(w)})
    second = F.abs(F.col("smoothed") - 2 * F.col("x1") + F.col("x0")).cast("decimal(38,0)")
    return rows.withColumns({"second": second, "slope": F.col("x1") - F.col("x0")})


def curvature_micros(points: DataFrame, profile: Profile, key: str = "session_id", order: str = "i") -> DataFrame:
    """(key, kappa_micros): the largest curvature of a session; null for fewer than three points."""
    rows = curvature(points, profile, key, order)
    base = F.lit(SCALE * SCALE).cast("long") + F.col("slope") * F.col("slope")
    bottom = (base.cast("decimal(38,0)") * isqrt(base)).cast("decimal(38,0)")
    point = div((F.col("second") * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)"), bottom)
    return rows.groupBy(key).agg(F.max(F.when(F.col("x0").isNotNull(), point)).cast("long").alias("kappa_micros"))


def epsilon_micros(points: DataFrame, profile: Profile, key: str = "session_id", order: str = "i") -> DataFrame:
    """(key, epsilon_micros): the largest rolling standard deviation over full windows."""
    n = profile.epsilon_window
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)
    rows = smooth(points, profile.smoothing_window, key, order)
    rows = rows.withColumns({"n": F.count("smoothed").over(w), "s": F.sum("smoothed").over(w), "q": F.sum(F.col("smoothed") * F.col("smoothed")).over(w)})
    value = div(isqrt(F.greatest(F.lit(0).cast("long"), n * F.col("q") - F.col("s") * F.col("s"))), F.lit(n))
    return rows.groupBy(key).agg(F.max(F.when(F.col("n") == n, value)).alias("epsilon_micros"))


def set_drift(members: DataFrame, key: str = "session_id") -> DataFrame:
    """Drift of each session's sets: symmetric difference over union, in micros.

    ``members`` has key, kind, element and two booleans, before and now.
    """
    flat = members.groupBy(key, "kind", "element").agg(F.max("before").alias("before"), F.max("now").alias("now"))
    union, both = F.count_if(F.col("before") | F.col("now")), F.count_if(F.col("before") & F.col("now"))
    return flat.groupBy(key, "kind").agg(F.when(union == 0, F.lit(0)).otherwise(div((union - both) * SCALE, union)).cast("long").alias("drift_micros"))


def graph_drift(drifts: DataFrame, profile: Profile, key: str = "session_id") -> DataFrame:
    """(key, delta_hol_micros): the weighted root of squared drifts of claims, evidence and relations."""
    weight = F.when(F.col("kind") == "claim", profile.claim_weight).when(F.col("kind") == "evidence", profile.evidence_weight).otherwise(profile.relation_weight).cast("long")
    total = drifts.groupBy(key).agg(F.sum(weight * F.col("drift_micros") * F.col("drift_micros")).alias("w"))
    return total.select(key, isqrt(div(F.col("w"), F.lit(SCALE))).alias("delta_hol_micros"))


def phi_vkd(metrics: DataFrame, profile: Profile) -> DataFrame:
    """Adds phi_star_micros and vkd_micros to rows with kappa and epsilon; null if either is."""
    d = lambda x: F.lit(x).cast("decimal(20,0)")
    part = lambda alpha, c: div((d(alpha) * F.col(c)).cast("decimal(38,0)"), F.lit(SCALE))
    bottom = F.lit(SCALE + profile.stability_delta) + part(profile.alpha_k, "kappa_micros") + part(profile.alpha_e, "epsilon_micros")
    phi = div((d(profile.i_c) * F.lit(SCALE)).cast("decimal(38,0)"), bottom.cast("decimal(38,0)")).cast("long")
    both = F.col("kappa_micros").isNotNull() & F.col("epsilon_micros").isNotNull()
    out = metrics.withColumn("phi_star_micros", F.when(both, phi))
    return out.withColumn("vkd_micros", F.when(both, F.least(profile.kappa_critical - F.col("kappa_micros"), F.col("phi_star_micros") - profile.phi_min)))


TERMS = ["todo", "fixme", "uncertain", "unknown", "blocked", "not verified", "needs verification", "pending"]


def transcript_features(turns: DataFrame, key: str = "conv_id", order: str = "turn", tool: str = "tool", terms: list[str] | None = None) -> DataFrame:
    """Turns by users and assistants, tool calls, and a keyword in the last assistant text."""
    last = F.max_by("text", F.when(F.col("role") == "assistant", F.col(order)))
    out = turns.groupBy(key).agg(F.count_if(F.col("role").isin("user", "assistant")).alias("session_length"), F.count_if(F.col("role") == tool).alias("tool_call_count"), last.alias("last"))
    return out.select(key, "session_length", "tool_call_count", F.coalesce(mentions(F.col("last"), terms or TERMS), F.lit(False)).cast("int").alias("keyword_heuristic"))
