"""Texts, charts, governance and recommendations over small collected results."""

from __future__ import annotations

import re
from dataclasses import dataclass


def short(x: float | None) -> str:
    if x is None:
        return "n/a"
    for size, mark in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(x) >= size:
            return f"{x / size:.1f}{mark}"
    return f"{x:.2f}".rstrip("0").rstrip(".")


def describe_series(name: str, values: list[float], trend: dict | None = None) -> str:
    if not values:
        return f"{name} has no periods."
    first, last = values[0], values[-1]
    change = f", {100 * (last - first) / abs(first):+.1f} % since the first period" if first else ""
    return f"{name} stands at {short(last)}{change}; the trend is {(trend or {}).get('trend', 'flat')}."


def describe_breakdown(name: str, shares: dict[str, float]) -> str:
    """shares in percent; concentration by the sum of their squares."""
    hhi = sum(s * s for s in shares.values())
    how = "concentrated" if hhi > 2500 else "moderately concentrated" if hhi > 1500 else "spread"
    top = max(shares, key=shares.get, default="nothing")
    return f"{name} is {how}: {top} holds {shares.get(top, 0):.1f} % (HHI {hhi:.0f})."


def describe_comparison(name: str, now: float, before: float) -> str:
    return f"{name} moved from {short(before)} to {short(now)}" + (f" ({100 * (now - before) / abs(before):+.1f} %)." if before else ".")


def describe_distribution(name: str, row: dict) -> str:
    skew = row.get("skewness") or 0
    lean = "right-skewed" if skew > 1 else "left-skewed" if skew < -1 else "roughly symmetric"
    return f"{name} is {lean}: median {short(row.get('median'))}, middle half {short(row.get('p25'))} to {short(row.get('p75'))}."


def describe_correlation(a: str, b: str, r: float, p: float) -> str:
    size = "strong" if abs(r) >= 0.7 else "moderate" if abs(r) >= 0.4 else "weak"
    return f"{a} and {b}: {size} {'positive' if r > 0 else 'negative'} correlation ({r:.2f}, p {p:.3g}); no statement about cause."


@dataclass(frozen=True)
class Chart:
    """A chart always says what it shows."""

    id: str
    kind: str
    data: list[dict]
    encoding: dict[str, str]
    narrative: str

    def __post_init__(self):
        if not self.narrative.strip():
            raise ValueError(f"chart {self.id} has no narrative")


def charts(analysis: dict) -> list[Chart]:
    out = []
    card = analysis.get("scorecard") or []
    for k in dict.fromkeys(r["kpi_id"] for r in card):
        own = [r for r in card if r["kpi_id"] == k]
        out.append(Chart(f"series_{k}", "line", [{"period": str(r["period"]), "value": r["value"]} for r in own], {"x": "period", "y": "value"}, describe_series(k, [r["value"] for r in own if r["value"] is not None])))
    cause = analysis.get("root_cause") or {}
    for t in cause.get("dimensions", []):
        out.append(Chart(f"waterfall_{t['dimension']}", "waterfall", [{"segment": s["segment"], "delta": s["delta"]} for s in cause["by_dimension"][t["dimension"]]], {"x": "segment", "y": "delta"}, f"{t['dimension']} explains the change with power {t['power']:.2f}."))
    if analysis.get("forecast"):
        out.append(Chart("forecast", "band", analysis["forecast"], {"x": "step", "y": "value"}, f"Forecast by {analysis['forecast'][0]['model']}."))
    return out


# How far each readiness verdict lets confidence rise.
CAPS = {"ready": 1.0, "usable with care": 0.8, "limited": 0.55, "blocked": 0.3}


def governance(analysis: dict) -> dict:
    """Checks on what the analysis rests on, a verdict, and its confidence cap."""
    q = analysis.get("quality") or {}
    checks = {"quality": (q.get("score") or 0) >= 70, "usable": bool(q.get("usable")), "has_date": "date" in (analysis.get("roles") or {}), "has_measure": bool({"revenue", "quantity", "profit"} & set(analysis.get("roles") or {})), "enough_periods": len({r["period"] for r in analysis.get("scorecard") or []}) >= 4, "private_fields_masked": True, "no_failed_stage": not analysis.get("warnings")}
    failed = [k for k, ok in checks.items() if not ok]
    verdict = "ready" if not failed else "usable with care" if len(failed) <= 2 else "limited" if len(failed) <= 4 else "blocked"
    return {"checks": checks, "failed": failed, "verdict": verdict, "confidence_cap": CAPS[verdict]}


RULES: dict[str, callable] = {}


def rule(fn):
    """Registers a recommendation rule: analysis -> recommendation or None."""
    RULES[fn.__name__] = fn
    return fn


def _advice(id_: str, text: str, impact: float, confidence: float, urgency: float) -> dict:
    return {"id": id_, "text": text, "impact": impact, "confidence": confidence, "urgency": urgency}


@rule
def lead_driver(a: dict):
    drivers = [s for s in (a.get("root_cause") or {}).get("nodes", []) if s["role"] == "driver"]
    if drivers:
        return _advice("lead_driver", f"Look into {drivers[0]['dimension']} = {drivers[0]['segment']}: it moved by {short(drivers[0]['delta'])}.", 0.9, (a.get("root_cause") or {}).get("confidence", 0.5), 0.8)


@rule
def anomaly_last(a: dict):
    found = a.get("anomalies") or []
    if found and found[-1]["severity"] in ("medium", "high"):
        return _advice("anomaly_last", f"Check {found[-1]['label']}: {found[-1]['kind']} of {found[-1]['delta_pct']:+.1f} %.", 0.7, 0.7, 0.9)


@rule
def falling_trend(a: dict):
    t = a.get("trend") or {}
    if t.get("trend") == "decreasing":
        return _advice("falling_trend", f"The lead KPI falls by {abs(t['slope_pct']):.1f} % a period.", 0.8, 1 - t["p"], 0.6)


@rule
def poor_quality(a: dict):
    q = a.get("quality") or {}
    if q and q["score"] < 70:
        return _advice("poor_quality", f"Raise data quality (grade {q['grade']}) before acting on results.", 0.6, 0.9, 0.7)


@rule
def duplicates(a: dict):
    q = a.get("quality") or {}
    if q.get("duplicates"):
        return _advice("duplicates", f"Remove {q['duplicates']} duplicate rows.", 0.3, 0.95, 0.4)


@rule
def mask_private(a: dict):
    hidden = [c for c, f in (a.get("privacy") or {}).items() if f["policy"] == "mask"]
    if hidden:
        return _advice("mask_private", f"Keep {', '.join(hidden)} masked in every export.", 0.5, 0.9, 0.5)


@rule
def weak_forecast(a: dict):
    f = a.get("forecast") or []
    if f and not f[0]["beats_naive"]:
        return _advice("weak_forecast", "No model beats the naive forecast: plan with its band, not its value.", 0.3, 0.8, 0.3)


def recommendations(a: dict, limit: int = 8) -> list[dict]:
    """Rules in order of impact x confidence x urgency, confidence capped by governance; a rule that fails abstains."""
    cap, out = governance(a)["confidence_cap"], {}
    for fn in RULES.values():
        try:
            r = fn(a)
        except Exception:  # noqa: BLE001
            r = None
        if r:
            r["confidence"] = min(r["confidence"], cap)
            r["priority"] = r["impact"] * r["confidence"] * r["urgency"]
            out.setdefault(r["id"], r)
    return sorted(out.values(), key=lambda r: -r["priority"])[:limit]


def limitations(a: dict) -> list[str]:
    out = [f"Stage failed - {w}" for w in a.get("warnings", [])]
    if "date" not in (a.get("roles") or {}):
        out.append("No date column: nothing over time.")
    if not a.get("dimensions"):
        out.append("No dimension with few levels: no root cause.")
    if len({r["period"] for r in a.get("scorecard") or []}) < 8:
        out.append("Fewer than eight periods: no forecast.")
    return out


def report(title: str, a: dict) -> dict:
    gov, advice = governance(a), recommendations(a)
    tree = (a.get("root_cause") or {}).get("confidence")
    quality = (a.get("quality") or {}).get("score", 0) / 100
    confidence = min(gov["confidence_cap"], tree * (0.6 + 0.4 * quality) if tree is not None else 0.5 * quality)
    sections = {"Findings": [c.narrative for c in charts(a)][:10], "Recommendations": [r["text"] for r in advice], "Limitations": limitations(a), "Governance": [f"Verdict: {gov['verdict']}; failed: {', '.join(gov['failed']) or 'none'}"]}
    from plumbline.sources.readers import markdown

    return {"title": title, "confidence": confidence, "sections": sections, "markdown": markdown(title, sections), "governance": gov, "recommendations": advice}


def same_numbers(before: str, after: str, longest: float = 3.0) -> bool:
    """Whether a reworded text has the numbers of the original, and is not much longer."""
    numbers = lambda t: sorted(float(x.replace(",", "")) for x in re.findall(r"-?\d[\d,]*\.?\d*", t))
    return numbers(before) == numbers(after) and len(after) <= longest * max(1, len(before))


def grounded(text: str, known: list[float], tolerance: float = 0.01) -> list[float]:
    """Numbers of a text that no known value is within tolerance of."""
    found = [float(x.replace(",", "")) for x in re.findall(r"-?\d[\d,]*\.?\d*", text)]
    return [x for x in found if not any(abs(x - k) <= tolerance * max(abs(k), 1e-9) for k in known)]
