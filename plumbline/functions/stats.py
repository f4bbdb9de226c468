"""Distributions and tests on a handful of moments.

Spark computes counts, means and variances; these scalar functions turn them into p-values on the driver. Only the
standard library is used. Tail probabilities come from continued fractions and erfc.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist, median

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else _NORMAL.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf(t: float, df: float) -> float:
    half = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return half if t > 0 else 1 - half


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return gammainc_upper(df / 2, x / 2)


@dataclass(frozen=True)
class Moments:
    """Count, mean and sample variance: all that mergeable aggregates need to hand over."""

    n: float
    mean: float
    var: float

    @staticmethod
    def of(x: Sequence[float]) -> Moments:
        n = len(x)
        m = sum(x) / n if n else 0.0
        return Moments(n, m, sum((v - m) ** 2 for v in x) / (n - 1) if n > 1 else 0.0)


@dataclass(frozen=True)
class Test:
    statistic: float
    p: float
    effect: float
    low: float = math.nan
    high: float = math.nan
    df: float = math.nan


def t_quantile(p: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, df) < p else (low, mid)
    return (low + high) / 2


def welch(a: Moments, b: Moments, alpha: float = 0.05) -> Test:
    """Difference a - b; Satterthwaite degrees of freedom, Hedges' g. Without variance: p is 0 if the means differ, else 1."""
    if min(a.n, b.n) < 2:
        return Test(0.0, 1.0, 0.0)
    va, vb = a.var / a.n, b.var / b.n
    gap, se2 = a.mean - b.mean, va + vb
    if se2 == 0:
        return Test(0.0 if gap == 0 else math.copysign(math.inf, gap), 1.0 if gap == 0 else 0.0, 0.0)
    df = se2**2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
    t = gap / math.sqrt(se2)
    pooled = math.sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2))
    g = gap / pooled * (1 - 3 / (4 * (a.n + b.n) - 9)) if pooled else 0.0
    half = t_quantile(1 - alpha / 2, df) * math.sqrt(se2)
    return Test(t, min(1.0, 2 * t_sf(abs(t), df)), g, gap - half, gap + half, df)


def cohens_d(a: Moments, b: Moments) -> float:
    pooled = math.sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2))
    return (a.mean - b.mean) / pooled if pooled else 0.0


def two_proportions(x1: float, n1: float, x2: float, n2: float, alpha: float = 0.05) -> Test:
    """Pooled z, Cohen's h, unpooled interval of the difference."""
    if not n1 or not n2:
        return Test(0.0, 1.0, 0.0)
    p1, p2, p = x1 / n1, x2 / n2, (x1 + x2) / (n1 + n2)
    se = math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    z = (p1 - p2) / se if se else 0.0
    h = 2 * math.asin(math.sqrt(p1)) - 2 * math.asin(math.sqrt(p2))
    half = norm_ppf(1 - alpha / 2) * math.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    return Test(z, min(1.0, 2 * norm_sf(abs(z))) if se else 1.0, h, p1 - p2 - half, p1 - p2 + half)


def poisson_rates(a: float, b: float, exposure_a: float = 1.0, exposure_b: float = 1.0) -> Test:
    """Square-root (Anscombe) test of two counts."""
    r = math.sqrt(a + 0.375) / math.sqrt(exposure_a) - math.sqrt(b + 0.375) / math.sqrt(exposure_b)
    z = 2 * r / math.sqrt(1 / exposure_a + 1 / exposure_b)
    return Test(z, min(1.0, 2 * norm_sf(abs(z))), r)


def chi_square(table: Sequence[Sequence[float]]) -> Test:
    """Independence of a contingency table; the effect is Cramér's V."""
    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table)]
    total = sum(rows)
    stat = sum((v - r * c / total) ** 2 / (r * c / total) for r, line in zip(rows, table) for c, v in zip(cols, line) if r and c)
    live = (sum(r > 0 for r in rows), sum(c > 0 for c in cols))
    df = (live[0] - 1) * (live[1] - 1)
    return Test(stat, chi2_sf(stat, df) if df else 1.0, math.sqrt(stat / (total * (min(live) - 1))) if df else 0.0, df=df)


def goodness_of_fit(seen: Sequence[float], expected: Sequence[float]) -> Test:
    total, weight = sum(seen), sum(expected)
    stat = sum((s - e * total / weight) ** 2 / (e * total / weight) for s, e in zip(seen, expected))
    return Test(stat, chi2_sf(stat, len(seen) - 1), 0.0, df=len(seen) - 1)


def correlation(r: float, n: int, alpha: float = 0.05) -> Test:
    """Test of a correlation from its value and count: t as statistic, Fisher interval."""
    if n < 4 or math.isnan(r):
        return Test(0.0, 1.0, r)
    if abs(r) >= 1:
        return Test(math.copysign(math.inf, r), 0.0, r, r, r)
    t = r * math.sqrt((n - 2) / (1 - r * r))
    z, half = math.atanh(r), norm_ppf(1 - alpha / 2) / math.sqrt(n - 3)
    return Test(t, min(1.0, 2 * t_sf(abs(t), n - 2)), r, math.tanh(z - half), math.tanh(z + half), n - 2)


def mann_whitney(rank_sum: float, n1: int, n2: int, tie_term: float = 0.0) -> Test:
    """From the first group's rank sum and sum(t**3 - t) over ties; the effect is Cliff's delta."""
    u, n = rank_sum - n1 * (n1 + 1) / 2, n1 + n2
    var = n1 * n2 / 12 * (n + 1 - tie_term / (n * (n - 1))) if n > 1 else 0.0
    z = (u - n1 * n2 / 2) / math.sqrt(var) if var > 0 else 0.0
    return Test(u, min(1.0, 2 * norm_sf(abs(z))) if var > 0 else 1.0, 2 * u / (n1 * n2) - 1 if n1 and n2 else 0.0)


def anova(groups: Sequence[Moments]) -> Test:
    """One-way analysis of variance from moments; the effect is eta squared."""
    n, k = sum(g.n for g in groups), len(groups)
    grand = sum(g.n * g.mean for g in groups) / n
    between, within = sum(g.n * (g.mean - grand) ** 2 for g in groups), sum((g.n - 1) * g.var for g in groups)
    if k < 2 or n <= k or within == 0:
        return Test(math.inf if within == 0 and between else 0.0, 0.0 if within == 0 and between else 1.0, 0.0)
    f = between / (k - 1) / (within / (n - k))
    return Test(f, f_sf(f, k - 1, n - k), between / (between + within), df=n - k)


def benjamini_hochberg(p: Sequence[float], rate: float = 0.10) -> list[bool]:
    order = sorted(range(len(p)), key=lambda i: p[i])
    last = max((k for k, i in enumerate(order, 1) if p[i] <= rate * k / len(p)), default=0)
    out = [False] * len(p)
    for i in order[:last]:
        out[i] = True
    return out


def bootstrap(x: Sequence[float], statistic: str = "mean", rounds: int = 2000, alpha: float = 0.05, seed: int = 7) -> tuple[float, float]:
    """Percentile interval of the mean or median of a small sample."""
    rng, of = random.Random(seed), (median if statistic == "median" else lambda s: sum(s) / len(s))
    draws = sorted(of(rng.choices(x, k=len(x))) for _ in range(rounds))
    at = lambda q: draws[min(rounds - 1, max(0, int(q * rounds)))]
    return at(alpha / 2), at(1 - alpha / 2)


def cliffs_delta(rank_sum: float, n: int, others: int) -> float:
    """How far a group lies above the others, -1 to 1, from the sum of its average ranks among all."""
    return 2 * (rank_sum - n * (n + 1) / 2) / (n * others) - 1 if n and others else 0.0
