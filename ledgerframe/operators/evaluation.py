"""Exact evaluation of binary predictors: confusion, thresholds, paired tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import Resampled, digits, flips_reaching
from ..functions.integers import SCALE, ceil_div, div, floor_div


def _micros(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0)).otherwise(div(part * SCALE, whole)).cast("long")


def rates(counts: DataFrame) -> DataFrame:
    """Adds sensitivity, specificity, balanced accuracy and accuracy to tp, tn, fp, fn."""
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    out = counts.withColumns({"sensitivity_micros": _micros(F.col("tp"), pos), "specificity_micros": _micros(F.col("tn"), neg)})
    return out.withColumns({"balanced_accuracy_micros": div(F.col("sensitivity_micros") + F.col("specificity_micros"), F.lit(2)), "accuracy_micros": _micros(F.col("tp") + F.col("tn"), pos + neg)})


def confusion(rows: DataFrame, by: list[str], label: str = "y", pred: str = "pred") -> DataFrame:
    """Confusion counts and rates of each predictor."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    return rates(rows.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn")))


def candidate_thresholds(rows: DataFrame, by: str = "metric", value: str = "value") -> DataFrame:
    """Distinct values of each metric, and one below and one above them all."""
    edges = rows.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return rows.select(by, F.col(value).alias("threshold")).unionByName(edges.select(by, F.explode(F.array(F.col("low") - 1, F.col("high") + 1)).alias("threshold"))).distinct()


def fit_threshold(rows: DataFrame, direction: str, by: str = "metric", value: str = "value", label: str = "y") -> DataFrame:
    """The best threshold of each metric by balanced accuracy, specificity, sensitivity, then the least (high) or largest (low).

    Counts of each distinct value are summed once along the values, instead of
    scoring every candidate against every row; a metric's distinct values come
    together, of which there are at most a million or so (micros).
    """
    counts = rows.groupBy(by, F.col(value).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    edges = counts.groupBy(by).agg(F.min("threshold").alias("low"), F.max("threshold").alias("high"))
    both = counts.unionByName(edges.select(by, F.explode(F.array(F.col("low") - 1, F.col("high") + 1)).alias("threshold"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n")))
    order = Window.partitionBy(by).orderBy(F.desc("threshold") if direction == "high" else F.col("threshold"))
    upto, every = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    t = both.withColumns({"tp": F.sum("p").over(upto), "fp": F.sum("n").over(upto), "pos": F.sum("p").over(every), "neg": F.sum("n").over(every)})
    t = rates(t.select(by, "threshold", "tp", (F.col("neg") - F.col("fp")).alias("tn"), "fp", (F.col("pos") - F.col("tp")).alias("fn")))
    tie = -F.col("threshold") if direction == "high" else F.col("threshold")
    best = t.groupBy(by).agg(F.max_by(F.struct(*[c for c in t.columns if c != by]), F.struct("balanced_accuracy_micros", "specificity_micros", "sensitivity_micros", tie.alias("tie"))).alias("b"))
    return best.select(by, "b.*")


def _classes(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def delta_ba(rows: DataFrame, by: str = "comparator") -> DataFrame:
    """The balanced-accuracy difference of a primary over each comparator, as a fraction over 2*pos*neg.

    ``rows`` has the comparator, y, primary and other (predictions of 0 or 1).
    """
    ok = lambda c: (F.col(c) == F.col("y")).cast("long")
    signed = rows.join(_classes(rows, by), by).withColumn("d", F.when(F.col("y") == 1, F.col("neg")).otherwise(F.col("pos")) * (ok("primary") - ok("other")))
    return signed.groupBy(by).agg(F.sum("d").alias("numerator"), F.first("pos").alias("pos"), F.first("neg").alias("neg")).select(by, "numerator", (2 * F.col("pos") * F.col("neg")).alias("denominator"))


def permutation_test(rows: DataFrame, by: str = "comparator", alpha_micros: int = 50_000) -> DataFrame:
    """Exact paired randomisation: the share of sign flips that reach the observed difference.

    Spark counts the discordant pairs of each class; the exact shares of any number of
    them follow from these counts.  Returns per comparator observed (the numerator over
    2*pos*neg), p_micros (rounded up), significant, discordant_n, and the share's
    p_numerator and p_denominator as digits.
    """
    odd = (F.col("primary") == F.col("y")) != (F.col("other") == F.col("y"))
    seen = rows.groupBy(by).agg(F.count_if(odd & (F.col("y") == 1)).alias("dp"), F.count_if(odd & (F.col("y") == 0)).alias("dn"))
    counts = delta_ba(rows, by).join(seen, by).join(_classes(rows, by), by)

    def one(r) -> tuple[int, bool, str, str]:
        hits, total = flips_reaching(int(r.pos), int(r.neg), int(r.dp), int(r.dn), int(r.numerator)), 1 << int(r.dp + r.dn)
        return -(-hits * SCALE // total), r.numerator > 0 and hits * SCALE <= alpha_micros * total, digits(hits), digits(total)

    def exact(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([one(r) for r in rows.itertuples()], columns=["p_micros", "significant", "p_numerator", "p_denominator"])

    told = F.pandas_udf(exact, "p_micros long, significant boolean, p_numerator string, p_denominator string")(F.struct("numerator", "pos", "neg", "dp", "dn"))
    out = counts.withColumn("t", told)
    return out.select(by, F.col("numerator").alias("observed"), "t.p_micros", "t.significant", (F.col("dp") + F.col("dn")).alias("discordant_n"), "t.p_numerator", "t.p_denominator")


def bootstrap_interval(rows: DataFrame, by: str = "comparator", low: tuple[int, int] = (25, 1000), high: tuple[int, int] = (975, 1000)) -> DataFrame:
    """Exact stratified bootstrap interval of the balanced-accuracy difference, in micros.

    Spark counts the differences -1, 0 and 1 of each stratum; all resamples of any number
    of rows follow from these counts.  A quantile is the smallest value with at least its
    share of the resamples at or below it.  Returns per comparator lower_micros (floor),
    upper_micros (ceiling), the numerators over 2*pos*neg, and resample_space (digits); a
    comparator without one of the classes has no row.
    """
    ok = lambda c: (F.col(c) == F.col("y")).cast("int")
    d = ok("primary") - ok("other")
    parts = [(f"{name}{k + 1}", F.count_if((F.col("y") == y) & (d == k))) for name, y in (("p", 1), ("n", 0)) for k in (-1, 0, 1)]
    counts = rows.groupBy(by).agg(*(c.alias(name) for name, c in parts), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).filter("pos > 0 AND neg > 0")

    def one(r) -> tuple[int, int, str]:
        dist = Resampled((int(r.p0), int(r.p1), int(r.p2)), (int(r.n0), int(r.n1), int(r.n2)))
        return dist.quantile(*low), dist.quantile(*high), digits(dist.total)

    def exact(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([one(r) for r in rows.itertuples()], columns=["lo", "hi", "space"])

    told = F.pandas_udf(exact, "lo long, hi long, space string")(F.struct(*(name for name, _ in parts)))
    out, bottom = counts.withColumn("t", told), (2 * F.col("pos") * F.col("neg")).cast("long")
    return out.select(
        by, floor_div(F.col("t.lo") * SCALE, bottom).alias("lower_micros"), ceil_div(F.col("t.hi") * SCALE, bottom).alias("upper_micros"),
        F.col("t.lo").alias("lower_numerator"), F.col("t.hi").alias("upper_numerator"), F.col("t.space").alias("resample_space"),
    )


def best_comparator(stats: DataFrame, by: str = "comparator") -> DataFrame:
    return stats.orderBy(F.desc("balanced_accuracy_micros"), by).limit(1)


def most_recent(sessions: DataFrame, n: int, at: str = "handoff_micros", key: str = "session_id") -> DataFrame:
    return sessions.orderBy(F.desc(at), F.desc(key)).limit(n)


def disposition(rows: DataFrame, tests: DataFrame, by: str = "comparator", least_pos: int = 5, least_neg: int = 3) -> DataFrame:
    """One row: whether the primary strictly and significantly beats every comparator.

    ``rows`` are paired predictions, ``tests`` the permutation tests.  Balanced
    accuracies are compared as floored micros; a sample with too few of a class is not
    significant against anything.
    """
    ba = "balanced_accuracy_micros"
    ours = confusion(rows, [by], pred="primary").select(by, F.col(ba).alias("ours"), (F.col("tp") + F.col("fn")).alias("pos"), (F.col("tn") + F.col("fp")).alias("neg"))
    theirs = confusion(rows, [by], pred="other").select(by, F.col(ba).alias("theirs"))
    g = ours.join(theirs, by).join(tests.select(by, "significant"), by)
    g = g.agg(F.bool_and(F.col("ours") > F.col("theirs")).alias("beats_all"), F.bool_and("significant").alias("all"), ((F.min("pos") >= least_pos) & (F.min("neg") >= least_neg)).alias("enough"))
    significant = F.col("enough") & F.col("all")
    code = F.when(~F.col("enough"), "INSUFFICIENT_SAMPLE").when(F.col("beats_all") & significant, "PRIMARY_SIGNAL_CLEARS_PREREGISTERED_GATE").otherwise("DOES_NOT_CLEAR_PREREGISTERED_GATE")
    return g.select("beats_all", significant.alias("significant_against_all"), code.alias("disposition"))


def classes(rows: DataFrame, by: str = "comparator") -> DataFrame:
    return _classes(rows, by)


def accuracy_percent(rows: DataFrame, by: str, hit: str) -> DataFrame:
    """(by, n, correct, accuracy_percent): the share of rows that hit, to one place."""
    from .costs import round_half_even

    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(hit).alias("correct"))
    return out.withColumn("accuracy_percent", round_half_even(F.col("correct") * 100.0 / F.col("n"), 1))
