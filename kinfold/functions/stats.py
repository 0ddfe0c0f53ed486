"""Tests on counts and samples."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np


def phred(p: float) -> float:
    """0 of 1, never negative zero."""
    return -10 * math.log10(p) + 0.0


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of a 2x2 table; from 512 observations the G test."""
    rows, cols, total = (a + b, c + d), (a + c, b + d), a + b + c + d
    if total >= 512:
        return g_test(a, b, c, d)
    fact = lambda n: math.lgamma(n + 1)
    weight = lambda x: -(fact(x) + fact(rows[0] - x) + fact(cols[0] - x) + fact(rows[1] - cols[0] + x))
    lo, hi = max(0, cols[0] - rows[1]), min(rows[0], cols[0])
    all_ = [weight(x) for x in range(lo, hi + 1)]
    top = max(all_)
    limit = weight(a) + 1e-9
    scaled = [math.exp(w - top) for w in all_]
    return min(1.0, math.fsum(s for s, w in zip(scaled, all_, strict=True) if w <= limit) / math.fsum(scaled))


def g_test(a: int, b: int, c: int, d: int) -> float:
    x = lambda v: v * math.log(v) if v > 0 else 0.0
    g = 2 * (x(a) + x(b) + x(c) + x(d) - x(a + b) - x(c + d) - x(a + c) - x(b + d) + x(a + b + c + d))
    return math.erfc(math.sqrt(g / 2)) if g > 0 else 1.0


def anderson_darling(first: list[float], second: list[float]) -> float:
    """Standardised two-sample statistic with midranks (Scholz and Stephens, 1987); nan if a sample is empty or there are fewer than 4 values."""
    both = sorted([*first, *second])
    n, k = len(both), 2
    if n < 4 or not first or not second:
        return math.nan
    values = np.unique(np.array(both))
    own = [sorted(first), sorted(second)]
    total = 0.0
    for sample in own:
        part = 0.0
        for v in values.tolist():
            ties = bisect_right(both, v) - bisect_left(both, v)
            below = bisect_left(both, v) + ties / 2
            mine = bisect_left(sample, v) + (bisect_right(sample, v) - bisect_left(sample, v)) / 2
            spread = below * (n - below) - n * ties / 4
            if spread > 0:
                part += ties / n * (n * mine - len(sample) * below) ** 2 / spread
        total += part / len(sample)
    a2 = total * (n - 1) / n
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n))])
    h, big = float(sum(1 / len(s) for s in own)), float(harmonic[-1])
    g = float(sum((harmonic[n - 1] - harmonic[i]) / (n - i) for i in range(1, n - 1)))
    ca = (4 * g - 6) * (k - 1) + (10 - 6 * g) * h
    cb = (2 * g - 4) * k**2 + 8 * big * k + (2 * g - 14 * big - 4) * h - 8 * big + 4 * g - 6
    cc = (6 * big + 2 * g - 2) * k**2 + (4 * big - 4 * g + 6) * k + (2 * big - 6) * h + 4 * big
    cd = (2 * big + 6) * k**2 - 4 * big * k
    var = (ca * n**3 + cb * n**2 + cc * n + cd) / ((n - 1) * (n - 2) * (n - 3))
    return (a2 - (k - 1)) / math.sqrt(var)
