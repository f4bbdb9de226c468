"""Short time series: trend, season, decomposition, change points, anomalies, forecasts.

A series has one value for each reporting period, so it fits a list; Spark hands each one over as an Arrow group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations
from statistics import mean, median, pstdev, stdev

from plumbline.functions.stats import Moments, norm_ppf, norm_sf, welch


def theil_sen(y: Sequence[float]) -> float:
    slopes = [(y[j] - y[i]) / (j - i) for i, j in combinations(range(len(y)), 2)]
    return median(slopes) if slopes else 0.0


def mann_kendall(y: Sequence[float], alpha: float = 0.05) -> dict:
    """Trend by concordant pairs, with the variance corrected for ties, and the Theil-Sen slope."""
    n = len(y)
    if n < 4:
        return {"trend": "flat", "p": 1.0, "tau": 0.0, "slope": 0.0, "slope_pct": 0.0}
    s = sum((b > a) - (b < a) for a, b in combinations(y, 2))
    ties = [list(y).count(v) for v in set(y)]
    var = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18
    z = (s - (s > 0) + (s < 0)) / math.sqrt(var) if var > 0 else 0.0
    p, slope = 2 * norm_sf(abs(z)), theil_sen(y)
    scale = mean(map(abs, y))
    trend = "flat" if p >= alpha else "increasing" if s > 0 else "decreasing"
    return {"trend": trend, "p": min(1.0, p), "tau": s / (n * (n - 1) / 2), "slope": slope, "slope_pct": 100 * slope / scale if scale else 0.0}


def autocorrelation(y: Sequence[float], lag: int) -> float:
    m = mean(y)
    total = sum((v - m) ** 2 for v in y)
    return sum((a - m) * (b - m) for a, b in zip(y, y[lag:])) / total if total else 0.0


def moving_average(y: Sequence[float], width: int) -> list[float]:
    """Centred; an even width gives its outer values half weight. The ends repeat the nearest value."""
    h = width // 2
    weights = [1.0] * width if width % 2 else [0.5, *[1.0] * (width - 1), 0.5]
    inner = [sum(w * v for w, v in zip(weights, y[i - h : i + h + 1])) / sum(weights) for i in range(h, len(y) - h)]
    return [inner[0]] * h + inner + [inner[-1]] * h if inner else list(y)


def decompose(y: Sequence[float], cycle: int, multiplicative: bool = False) -> dict[str, list[float]]:
    trend = moving_average(y, cycle)
    part = [v / t if multiplicative and t else v - t for v, t in zip(y, trend)]
    phase = [mean(part[i::cycle]) for i in range(cycle)]
    centre = mean(phase)
    phase = [p / centre if multiplicative and centre else p - centre for p in phase]
    season = [phase[i % cycle] for i in range(len(y))]
    rest = [v / (t * s) if multiplicative and t * s else v - t - s for v, t, s in zip(y, trend, season)]
    return {"trend": trend, "seasonal": season, "residual": rest}


def season(y: Sequence[float], cycles: Sequence[int]) -> tuple[int | None, float]:
    """Cycle with the best autocorrelation and its strength; None if there is none to speak of."""
    fits = [(autocorrelation(y, c) - 0.01 * math.log(c), c) for c in cycles if 1 < c <= len(y) // 2]
    best = max(fits, default=(0.0, 0))
    if best[0] < 0.25:
        return None, 0.0
    parts = decompose(y, best[1])
    both = pstdev([s + r for s, r in zip(parts["seasonal"], parts["residual"])]) ** 2
    strength = max(0.0, 1 - pstdev(parts["residual"]) ** 2 / both) if both else 0.0
    return (best[1], strength) if strength >= 0.3 else (None, strength)


def change_points(y: Sequence[float], least: int = 4, alpha: float = 0.01, depth: int = 3) -> list[int]:
    """Binary segmentation: the split with the largest gain in squared error is kept if the two means differ."""

    def split(a: int, b: int, level: int) -> list[int]:
        if b - a < 2 * least or level >= depth:
            return []
        cost = lambda x: sum((v - mean(x)) ** 2 for v in x)
        k = min(range(a + least, b - least + 1), key=lambda i: cost(y[a:i]) + cost(y[i:b]))
        if welch(Moments.of(y[a:k]), Moments.of(y[k:b])).p >= alpha:
            return []
        return [*split(a, k, level + 1), k, *split(k, b, level + 1)]

    return split(0, len(y), 0)


def mad(x: Sequence[float]) -> float:
    m = median(x)
    return 1.4826 * median(abs(v - m) for v in x)


def robust_z(y: Sequence[float], floor: float = 0.0) -> list[float]:
    m = median(y)
    scale = max(mad(y) or (stdev(y) if len(y) > 1 else 0.0), floor)
    return [(v - m) / scale if scale else 0.0 for v in y]


def rolling_z(y: Sequence[float], window: int = 12) -> list[float]:
    """Each value against the median and spread of those before it; a flat window uses a small share of its level."""
    out = []
    for i, v in enumerate(y):
        past = y[max(0, i - window) : i]
        if len(past) < 3:
            out.append(0.0)
            continue
        m = median(past)
        scale = mad(past) or pstdev(past) or max(abs(m), 1.0) * 1e-3
        out.append(max(-1e6, min(1e6, (v - m) / scale)))
    return out


def cusum(y: Sequence[float], threshold: float = 5.0, drift: float = 0.5) -> list[int]:
    """Places where the two-sided cumulative sum of standardised values passes the threshold; it restarts there."""
    if len(y) < 3:
        return []
    m, s, up, down, out = mean(y), pstdev(y) or 1.0, 0.0, 0.0, []
    for i, v in enumerate(y):
        z = (v - m) / s
        up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
        if max(up, down) > threshold:
            out.append(i)
            up = down = 0.0
    return out


def anomalies(y: Sequence[float], labels: Sequence[str], cycle: int | None = None, z: float = 3.0, window: int = 12) -> list[dict]:
    """Level shifts first, then points beyond `z` of the seasonal residual or 3.5 of the trailing window."""
    if len(y) < 6:
        return []
    base = list(y)
    if cycle and len(y) >= 2 * cycle:
        d = decompose(y, cycle)
        base = [v - s for v, s in zip(y, d["seasonal"])]
    floor = 0.005 * abs(median(y))
    point, roll, out = robust_z(base, floor), rolling_z(base, window), {}
    cuts = change_points(base)
    shifts = {}
    for a, k, b in zip([0, *cuts], cuts, [*cuts[1:], len(y)]):
        gap = mean(base[k:b]) - mean(base[a:k])
        shifts[k] = gap
        scale = max(mad(base[a:k]), floor, 1e-9)
        out[k] = {"index": k, "label": labels[k], "kind": "level_shift", "value": y[k], "expected": mean(base[a:k]), "z": gap / scale, "delta_pct": 100 * gap / abs(mean(base[a:k])) if mean(base[a:k]) else 0.0}
    for i, v in enumerate(y):
        score = point[i] if abs(point[i]) >= z else roll[i] if abs(roll[i]) >= 3.5 else 0.0
        if not score or i in out or any(k <= i and (g > 0) == (score > 0) for k, g in shifts.items()):
            continue
        m = median(base)
        out[i] = {"index": i, "label": labels[i], "kind": "point", "value": v, "expected": m, "z": score, "delta_pct": 100 * (base[i] - m) / abs(m) if m else 0.0}
    rows = [out[i] for i in sorted(out)]
    for r in rows:
        r["severity"] = severity(r["z"], r["delta_pct"])
    return rows


LEVELS = ("info", "low", "medium", "high")


def severity(z: float, pct: float) -> str:
    """The lower of the statistical and the material tier."""
    tier = lambda x, steps: sum(abs(x) >= s for s in steps)
    return LEVELS[min(tier(z, (3, 3.5, 4.5)), tier(pct, (4, 10, 25)))]


# -- forecasts ----------------------------------------------------------------------------------------


def _naive(y, h, c):
    return [y[-1]] * h


def _seasonal_naive(y, h, c):
    return [y[-c + i % c] for i in range(h)] if c and len(y) >= c else [y[-1]] * h


def _drift(y, h, c):
    step = (y[-1] - y[0]) / (len(y) - 1) if len(y) > 1 else 0.0
    return [y[-1] + step * (i + 1) for i in range(h)]


def _ses(y, h, c, a=0.3):
    level = y[0]
    for v in y[1:]:
        level = a * v + (1 - a) * level
    return [level] * h


def _holt(y, h, c, a=0.3, b=0.1, phi=0.92):
    level, slope = y[0], (y[1] - y[0]) if len(y) > 1 else 0.0
    for v in y[1:]:
        before = level
        level = a * v + (1 - a) * (level + phi * slope)
        slope = b * (level - before) + (1 - b) * phi * slope
    damp, out = 0.0, []
    for i in range(h):
        damp += phi ** (i + 1)
        out.append(level + damp * slope)
    return out


def _holt_winters(y, h, c, a=0.3, b=0.08, g=0.3, phi=0.95):
    if not c or len(y) < 2 * c:
        return _holt(y, h, c)
    level, slope = mean(y[:c]), (mean(y[c : 2 * c]) - mean(y[:c])) / c
    cycles = [y[k : k + c] for k in range(0, len(y) - c + 1, c)]
    parts = [mean(x[i] - mean(x) for x in cycles) for i in range(c)]
    for i, v in enumerate(y):
        before, s = level, parts[i % c]
        level = a * (v - s) + (1 - a) * (level + phi * slope)
        slope = b * (level - before) + (1 - b) * phi * slope
        parts[i % c] = g * (v - level) + (1 - g) * s
    damp, out = 0.0, []
    for i in range(h):
        damp += phi ** (i + 1)
        out.append(level + damp * slope + parts[(len(y) + i) % c])
    return out


MODELS: dict[str, Callable] = {"naive": _naive, "seasonal_naive": _seasonal_naive, "drift": _drift, "ses": _ses, "holt": _holt, "holt_winters": _holt_winters}


def backtest(y: Sequence[float], model: str, horizon: int, cycle: int | None, folds: int = 4) -> dict:
    """Rolling origins: errors of forecasts from the last `folds` starting points."""
    lag = cycle if cycle and len(y) > cycle else 1
    scale = mean(abs(a - b) for a, b in zip(y[lag:], y)) or 1e-9
    errors, truth = [], []
    for k in range(folds, 0, -1):
        cut = len(y) - horizon - k + 1
        if cut < max(4, len(y) // 3):
            continue
        ahead = MODELS[model](list(y[:cut]), horizon, cycle)
        errors += [v - f for v, f in zip(y[cut : cut + horizon], ahead)]
        truth += y[cut : cut + horizon]
    if not errors:
        return {"mase": math.inf, "mape": math.inf, "rmse": math.inf, "errors": []}
    pct = [abs(e / v) for e, v in zip(errors, truth) if v]
    return {"mase": mean(map(abs, errors)) / scale, "mape": 100 * mean(pct) if pct else math.inf, "rmse": math.sqrt(mean(e * e for e in errors)), "errors": errors}


def forecast(y: Sequence[float], horizon: int = 3, cycle: int | None = None, level: float = 0.8) -> list[dict]:
    """The model with the least back-tested error, with a band that widens with the root of the step. Needs 8 values."""
    y = [float(v) for v in y]
    if len(y) < 8:
        return []
    horizon = max(1, min(horizon, len(y) // 3))
    tests = {m: backtest(y, m, horizon, cycle) for m in MODELS if m not in ("seasonal_naive", "holt_winters") or (cycle and len(y) >= 2 * cycle)}
    best = min(tests, key=lambda m: tests[m]["mase"])
    errors = tests[best]["errors"]
    spread = (stdev(errors) if len(errors) > 1 else 0.0) * norm_ppf(0.5 + level / 2)
    return [{"step": k, "model": best, "value": v, "low": v - spread * math.sqrt(k), "high": v + spread * math.sqrt(k), "mase": tests[best]["mase"], "beats_naive": tests[best]["mase"] < 1} for k, v in enumerate(MODELS[best](y, horizon, cycle), 1)]
