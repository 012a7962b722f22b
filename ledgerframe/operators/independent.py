"""A second way to an evaluation: Spark SQL over the raw rows, sharing nothing with the first but the comparison.

Where the first way sums counts, this one convolves: the randomisation's distribution
is the product of one two-point step per discordant pair.  Where the first parses and
re-serialises rows, this one hashes the texts as they stand, which a canonical ledger allows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import staged
from .documents import differences

#: A ledger's rows against their predecessors, by the texts alone.
_CHAIN = """
SELECT index, CASE WHEN index <> place THEN 'index_gap'
  WHEN NOT get_json_object(row, '$.{previous}') <=> sha2(before, 256) THEN 'chain_mismatch'
  WHEN get_json_object(row, '$.{own}') <> sha2(replace(row, '"{own}":"' || get_json_object(row, '$.{own}') || '",', ''), 256) THEN 'hash_mismatch' END AS fault
FROM (SELECT *, lag(row) OVER (ORDER BY index) AS before, row_number() OVER (ORDER BY index) AS place FROM {{ledger}})
"""

_PAIRS = """
WITH p AS (
  SELECT get_json_object(row, '$.session_id') AS sid, CAST(get_json_object(row, '$.primary_prediction') AS INT) AS ours, comparator, theirs
  FROM {predictions} LATERAL VIEW explode(from_json(get_json_object(row, '$.comparator_predictions'), 'map<string,int>')) e AS comparator, theirs
), o AS (
  SELECT get_json_object(raw, '$.session_id') AS sid, CAST(get_json_object(raw, '$.outcome') AS INT) AS y FROM {outcomes}
)
SELECT comparator, p.sid, y, ours, theirs FROM p FULL JOIN o ON p.sid = o.sid
"""

_RATED = """
named_struct('tp', tp, 'tn', tn, 'fp', fp, 'fn', fn, 'sensitivity_micros', sens, 'specificity_micros', spec, 'balanced_accuracy_micros', (sens + spec) div 2, 'accuracy_micros', (tp + tn) * 1000000 div n)
"""

_STATS = f"""
WITH long AS (
  SELECT comparator, y, ours AS pred, 'ours' AS side FROM {{pairs}} UNION ALL SELECT comparator, y, theirs, 'theirs' FROM {{pairs}}
), c AS (
  SELECT comparator, side, count(*) AS n, count_if(y = 1 AND pred = 1) AS tp, count_if(y = 0 AND pred = 0) AS tn, count_if(y = 0 AND pred = 1) AS fp, count_if(y = 1 AND pred = 0) AS fn FROM long GROUP BY comparator, side
), r AS (
  SELECT *, coalesce(try_divide(tp * 1000000 - tp * 1000000 % nullif(tp + fn, 0), tp + fn), 0) AS s, coalesce(try_divide(tn * 1000000 - tn * 1000000 % nullif(tn + fp, 0), tn + fp), 0) AS t FROM c
)
SELECT comparator, side, {_RATED} AS rates FROM (SELECT *, CAST(s AS BIGINT) AS sens, CAST(t AS BIGINT) AS spec FROM r)
"""

_RANDOMISED = """
WITH k AS (
  SELECT *, count_if(y = 1) OVER (PARTITION BY comparator) AS pos, count_if(y = 0) OVER (PARTITION BY comparator) AS neg FROM {pairs}
), g AS (
  SELECT comparator, sum(if(y = 1, neg, pos) * (int(ours = y) - int(theirs = y))) AS observed, collect_list(if((ours = y) <> (theirs = y), int(if(y = 1, neg, pos)), NULL)) AS weights FROM k GROUP BY comparator
), d AS (
  SELECT *, aggregate(weights, array(CAST(1 AS DECIMAL(38,0))), (a, w) -> zip_with(concat(array_repeat(CAST(0 AS DECIMAL(38,0)), 2 * w), a), concat(a, array_repeat(CAST(0 AS DECIMAL(38,0)), 2 * w)), (x, y) -> CAST(x + y AS DECIMAL(38,0)))) AS ways,
    aggregate(weights, 0, (s, w) -> s + w) AS reach FROM g
)
SELECT comparator, observed, size(weights) AS discordant_n, CAST(aggregate(slice(ways, greatest(1, int(observed + reach + 1)), size(ways)), CAST(0 AS DECIMAL(38,0)), (s, x) -> CAST(s + x AS DECIMAL(38,0))) AS STRING) AS p_numerator,
  CAST(aggregate(ways, CAST(0 AS DECIMAL(38,0)), (s, x) -> CAST(s + x AS DECIMAL(38,0))) AS STRING) AS p_denominator FROM d
"""


def ledger_faults(ledger: DataFrame, previous: str, own: str) -> DataFrame:
    """(index, fault) of a ledger's rows (index, row) whose number, link or own hash is wrong, by the canonical texts as they stand.

    The own hash's field must not be the text's last.
    """
    return ledger.sparkSession.sql(_CHAIN.format(previous=previous, own=own), ledger=ledger).filter("fault IS NOT NULL")


def verify_evaluation(claimed: str, predictions: DataFrame, outcomes: DataFrame, least_per_class: int) -> DataFrame:
    """(pointer): where an evaluation document differs from what the raw rows give; no row: it holds.

    ``predictions`` are a ledger's (index, row), ``outcomes`` the file's (line, raw).
    Recomputed are the size, the classes, all classifications, the best comparator and
    the distance to it, the randomisation of every comparator and the disposition; a
    session of one side only shows as a difference of the sizes.  Up to 126 discordant
    pairs a comparator; more fail the job.
    """
    spark = predictions.sparkSession
    pairs = staged(spark.sql(_PAIRS, predictions=predictions, outcomes=outcomes), "pairs")
    stats, tests = spark.sql(_STATS, pairs=pairs), spark.sql(_RANDOMISED, pairs=pairs)
    every = spark.sql(
        """
        SELECT s.comparator, ours, theirs, named_struct('observed', t.observed, 'discordant_n', t.discordant_n, 'p_numerator', p_numerator, 'p_denominator', p_denominator) AS exact
        FROM (SELECT comparator, any_value(rates) FILTER (WHERE side = 'ours') AS ours, any_value(rates) FILTER (WHERE side = 'theirs') AS theirs FROM {stats} GROUP BY comparator) s JOIN {tests} t ON s.comparator = t.comparator
        """,
        stats=stats, tests=tests,
    )
    document = json.loads(claimed)
    alpha = int(document.get("primary_gate", {}).get("alpha_micros", 0))
    made = spark.sql(
        """
        WITH a AS (SELECT array_sort(collect_list(struct(comparator, ours, theirs, exact))) AS e FROM {every}
        ), b AS (SELECT e, e[0].ours AS o, e[0].ours.tp + e[0].ours.fn AS pos, e[0].ours.tn + e[0].ours.fp AS neg, array_min(transform(e, x -> struct(-x.theirs.balanced_accuracy_micros AS ba, x.comparator AS name))) AS best FROM a
        ), g AS (SELECT *, pos >= {least} AND neg >= {least} AS enough, forall(e, x -> x.ours.balanced_accuracy_micros > x.theirs.balanced_accuracy_micros) AS beats,
          forall(e, x -> x.exact.observed > 0 AND CAST(x.exact.p_numerator AS DECIMAL(38,0)) / CAST(x.exact.p_denominator AS DECIMAL(38,0)) <= {alpha} / 1e6BD) AS significant FROM b)
        SELECT to_json(named_struct('test_n', pos + neg, 'class_counts', named_struct('correction', pos, 'no_correction', neg), 'eligible_for_primary_verdict', enough, 'primary', o, 'comparators', map_from_entries(transform(e, x -> struct(x.comparator, x.theirs))),
          'exact', if(enough, map_from_entries(transform(e, x -> struct(x.comparator, x.exact))), NULL), 'best_comparator', best.name, 'primary_minus_best_comparator_balanced_accuracy_micros', o.balanced_accuracy_micros + best.ba,
          'disposition', CASE WHEN NOT enough THEN 'INSUFFICIENT_SAMPLE' WHEN beats AND significant THEN 'PRIMARY_SIGNAL_CLEARS_PREREGISTERED_GATE' ELSE 'DOES_NOT_CLEAR_PREREGISTERED_GATE' END), map('ignoreNullFields', 'false')) AS document
        FROM g
        """,
        every=every, least=int(least_per_class), alpha=alpha,
    )
    told = {k: document.get(k) for k in ("test_n", "class_counts", "eligible_for_primary_verdict", "comparators", "best_comparator", "primary_minus_best_comparator_balanced_accuracy_micros", "disposition")}
    told["primary"] = {k: v for k, v in (document.get("primary") or {}).items() if k != "metric"}
    inference = document.get("inference")
    kept = ("observed", "discordant_n", "p_numerator", "p_denominator")
    told["exact"] = None if inference is None else {c: {k: x["exact_randomization"].get(k) for k in kept} for c, x in inference.items()}
    return made.select(F.explode(differences(F.lit(json.dumps(told)), "document")).alias("pointer"))
