"""Exact distributions of paired tests, of any size, from the few counts that Spark has summed.

Python's integers have no limit, so nothing is approximated and no size is refused; a
comparator costs as many steps as it has discordant pairs or sessions, whatever the
number of rows behind the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import accumulate


def binomials(n: int) -> Iterator[int]:
    """C(n, 0) to C(n, n)."""
    return accumulate(range(1, n + 1), lambda c, k: c * (n - k + 1) // k, initial=1)


def digits(n: int) -> str:
    """A whole number of any size in decimal digits; ``str`` refuses more than 4300."""
    return format(Decimal(n), "f")


def flips_reaching(positive: int, negative: int, dp: int, dn: int, observed: int) -> int:
    """How many of the 2 ** (dp + dn) sign flips give at least the observed numerator.

    A discordant pair weighs ``negative`` if its label is 1 (dp of them), else
    ``positive``.  For each number of upward flips of the one kind, those of the other
    that suffice are a tail, which grows with it: the sum is one walk along both, whose
    steps are linear and are multiplied as a balanced tree.
    """
    steps, j = [], dn  # the largest number of upward flips that is not in the tail yet
    for i in range(dp + 1):
        lacking = observed - negative * (2 * i - dp) + positive * dn
        least = max(0, -(-lacking // (2 * positive))) if positive else 0 if lacking <= 0 else dn + 1
        while j >= least:
            steps.append((False, j, dn - j + 1))
            j -= 1
        steps.append((True, dp - i, i + 1))
    *_, hits, _, whole = _walk(steps, 0, len(steps))
    return hits // whole


def _walk(steps: list[tuple[bool, int, int]], start: int, end: int) -> tuple[int, ...]:
    """What steps make of (x, y, hits) over a common denominator: x is the product of the two next binomials, y that of the one and the other's tail."""
    if end - start > 1:
        middle = (start + end) // 2
        xx, yx, yy, hx, hy, d = _walk(steps, start, middle)
        xx2, yx2, yy2, hx2, hy2, d2 = _walk(steps, middle, end)
        return xx2 * xx, yx2 * xx + yy2 * yx, yy2 * yy, hx2 * xx + hy2 * yx + d2 * hx, hy2 * yy + d2 * hy, d2 * d
    counted, up, down = steps[start]
    return (up, 0, up, 0, down, down) if counted else (up, down, down, 0, 0, down)


def resample_sums(counts: tuple[int, int, int]) -> list[int]:
    """How many of the n ** n resamples of n differences, of which ``counts`` are -1, 0 and 1, sum to -n, ..., n.

    They are the coefficients of a power of a trinomial, taken as one power of a number
    whose digits are wide enough to hold each.
    """
    n = sum(counts)
    width = n * n.bit_length() + 1
    power = sum(c << width * k for k, c in enumerate(counts)) ** n
    digit = (1 << width) - 1
    return [power >> width * k & digit for k in range(2 * n + 1)]


class Resampled:
    """The distribution of both strata's resampled difference, over 2 * pos * neg."""

    def __init__(self, positive: tuple[int, int, int], negative: tuple[int, int, int]):
        self.pos, self.neg = sum(positive), sum(negative)
        self.ways, self.below = resample_sums(positive), [*accumulate(resample_sums(negative))]
        self.total = self.pos**self.pos * self.neg**self.neg

    def upto(self, v: int) -> int:
        """Resamples with a numerator of at most v."""
        out = 0
        for k, ways in enumerate(self.ways):
            last = (v - (k - self.pos) * self.neg) // self.pos + self.neg
            if last >= 0:
                out += ways * self.below[min(last, 2 * self.neg)]
        return out

    def quantile(self, share: int, whole: int) -> int:
        """The smallest numerator with at least max(1, ceil(share * total / whole)) resamples at or below it."""
        rank = max(1, -(-share * self.total // whole))
        low, high = -2 * self.pos * self.neg, 2 * self.pos * self.neg
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.upto(middle) >= rank else (middle + 1, high)
        return low
