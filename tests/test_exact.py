"""Exact tests beyond the sizes that fixed-width numbers hold, against plain integers."""

import math
import random
from collections import defaultdict

import pytest

from ledgerframe.functions.exact import Resampled, binomials, digits, flips_reaching, resample_sums
from ledgerframe.operators import evaluation


def plain_flips(weights, observed):
    dist = {0: 1}
    for w in weights:
        now = defaultdict(int)
        for v, n in dist.items():
            now[v + w] += n
            now[v - w] += n
        dist = now
    return sum(n for v, n in dist.items() if v >= observed)


def plain_sums(values):
    dist = {0: 1}
    for _ in values:
        now = defaultdict(int)
        for s, n in dist.items():
            for v in values:
                now[s + v] += n
        dist = now
    return dist


@pytest.mark.parametrize("pos,neg,dp,dn", [(3, 4, 2, 3), (150, 90, 140, 80), (1, 1, 0, 0), (0, 5, 0, 3), (5, 0, 4, 0), (130, 120, 100, 100)])
def test_flips(pos, neg, dp, dn):
    assert [*binomials(dp)] == [math.comb(dp, k) for k in range(dp + 1)]
    weights = [neg] * dp + [pos] * dn
    for observed in {0, 1, -5, sum(weights), sum(weights) + 1, -sum(weights), pos * 3 - neg, sum(weights) // 3}:
        assert flips_reaching(pos, neg, dp, dn, observed) == plain_flips(weights, observed)


@pytest.mark.parametrize("p,n", [((1, 2, 3), (2, 0, 1)), ((9, 12, 14), (11, 8, 6)), ((0, 3, 0), (0, 0, 2)), ((0, 1, 0), (1, 0, 0))])
def test_resamples(p, n):
    values = [[-1] * a + [0] * b + [1] * c for a, b, c in (p, n)]
    sums = [plain_sums(v) for v in values]
    assert resample_sums(p) == [sums[0].get(s, 0) for s in range(-sum(p), sum(p) + 1)]
    dist = defaultdict(int)
    for s, a in sums[0].items():
        for t, b in sums[1].items():
            dist[s * sum(n) + t * sum(p)] += a * b
    got = Resampled(p, n)
    assert got.total == sum(dist.values()) == sum(p) ** sum(p) * sum(n) ** sum(n)
    for share in (0, 1, 25, 500, 975, 1000):
        rank, cum = max(1, -(-share * got.total // 1000)), 0
        for v in sorted(dist):
            cum += dist[v]
            if cum >= rank:
                break
        assert got.quantile(share, 1000) == v


def test_rows_of_many_sessions(spark):
    """Over 200 discordant pairs and 300 sessions; one comparator equals the primary, one has a class alone."""
    r = random.Random(8)
    rows = [("noisy", r.random() < 0.5, r.random() < 0.8, r.random() < 0.4) for _ in range(400)]
    rows = [(c, int(y), int(p == y), int(o == y)) for c, y, p, o in rows] + [("same", k % 2, 1, 1) for k in range(30)] + [("single", 1, 1, 0)] * 3
    df = spark.createDataFrame(rows, "comparator string, y int, primary int, other int")
    got = {x.comparator: x for x in evaluation.permutation_test(df).collect()}
    noisy = [x for x in rows if x[0] == "noisy"]
    pos = sum(y for _, y, _, _ in noisy)
    neg = len(noisy) - pos
    weights = [neg if y else pos for _, y, p, o in noisy if p != o]
    observed = sum((neg if y else pos) * (int(p == y) - int(o == y)) for _, y, p, o in noisy)
    hits = plain_flips(weights, observed)
    x = got["noisy"]
    assert x.discordant_n == len(weights) > 200
    assert (x.observed, int(x.p_numerator), int(x.p_denominator)) == (observed, hits, 2 ** len(weights))
    assert (x.p_micros, x.significant) == (-(-hits * 10**6 // 2 ** len(weights)), observed > 0 and hits * 10**6 <= 50_000 * 2 ** len(weights))
    assert (got["same"].p_micros, got["same"].significant, got["same"].p_denominator) == (10**6, False, "1")
    intervals = {x.comparator: x for x in evaluation.bootstrap_interval(df).collect()}
    assert {*intervals} == {"noisy", "same"}
    assert (intervals["same"].lower_micros, intervals["same"].upper_micros) == (0, 0)
    x = intervals["noisy"]
    assert int(x.resample_space) == pos**pos * neg**neg
    bottom = 2 * pos * neg
    assert (x.lower_micros, x.upper_micros) == (x.lower_numerator * 10**6 // bottom, -(-x.upper_numerator * 10**6 // bottom))
    assert x.lower_numerator <= observed <= x.upper_numerator


def test_no_rows(spark):
    none = spark.createDataFrame([], "comparator string, y int, primary int, other int")
    assert evaluation.permutation_test(none).collect() == evaluation.bootstrap_interval(none).collect() == []


def test_more_discordant_pairs_than_a_text_of_an_integer_holds(spark):
    """16,000 pairs: the share has over 4300 digits."""
    n, won = 16_000, 8_100
    pairs = spark.range(n).selectExpr("'a' AS comparator", "CAST(id % 2 AS INT) AS y", f"CAST(IF(id < {won}, id % 2, 1 - id % 2) AS INT) AS primary", f"CAST(IF(id < {won}, 1 - id % 2, id % 2) AS INT) AS other")
    r = evaluation.permutation_test(pairs).collect()[0]
    # Classes of one size weigh alike: the flips that suffice are those with as many upward ones.
    ways = [*binomials(n)]
    hits, half = sum(ways[won:]), n // 2
    assert (r.discordant_n, r.observed, len(r.p_numerator)) == (n, half * (2 * won - n), len(digits(hits))) and len(r.p_numerator) > 4300
    assert (r.p_numerator, r.p_denominator, r.p_micros) == (digits(hits), digits(2**n), -(-hits * 1_000_000 // 2**n))
