"""Experiments: sample sizes, health checks, readouts and incremental effects.

Arms are reduced to counts and moments by Spark; decisions are taken on those few rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import ratio
from plumbline.functions.stats import Moments, benjamini_hochberg, goodness_of_fit, norm_cdf, norm_ppf, two_proportions, welch


def assign(df: DataFrame, entity: str, arms: list[str], salt: str = "") -> Column:
    """A stable arm for each entity, by hash."""
    return F.array(*[F.lit(a) for a in arms])[F.pmod(F.crc32(F.concat(F.lit(salt), F.col(entity).cast("string")).cast("binary")), F.lit(len(arms))).cast("int")]


def arm_moments(df: DataFrame, arm: str | Column, value: Column, success: Column | None = None) -> DataFrame:
    """(arm, n, mean, variance[, successes])."""
    a = F.col(arm) if isinstance(arm, str) else arm
    return df.groupBy(a.alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), *([F.count_if(success).alias("successes")] if success is not None else []))


def cuped(df: DataFrame, post: Column, pre: Column) -> DataFrame:
    """`df` with `adjusted`: the outcome less what its past explains. theta = cov / var, in one aggregation."""
    base = df.select("*", post.cast("double").alias("_y"), pre.cast("double").alias("_x"))
    one = base.agg(F.covar_samp("_y", "_x").alias("_c"), F.var_samp("_x").alias("_v"), F.avg("_x").alias("_m"))
    theta = F.coalesce(ratio(F.col("_c"), F.col("_v")), F.lit(0.0))
    return base.crossJoin(F.broadcast(one)).withColumn("theta", theta).withColumn("adjusted", F.col("_y") - F.col("theta") * (F.col("_x") - F.col("_m"))).drop("_c", "_v", "_m", "_x", "_y")


def did_moments(df: DataFrame, group: Column, phase: Column, value: Column) -> DataFrame:
    """(treated, after, n, mean, variance): what a difference in differences needs."""
    return df.groupBy(group.alias("treated"), phase.alias("after")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def sample_size_proportion(base: float, lift: float, alpha: float = 0.05, power: float = 0.8, variants: int = 2) -> int:
    """Per arm, for a relative lift; alpha is shared by the comparisons with control."""
    p1, p2 = base, base * (1 + lift)
    za, zb, p = norm_ppf(1 - alpha / (variants - 1) / 2), norm_ppf(power), (base + base * (1 + lift)) / 2
    return math.ceil((za * math.sqrt(2 * p * (1 - p)) + zb * math.sqrt(p1 * (1 - p1) + p2 * (1 - p2))) ** 2 / (p1 - p2) ** 2)


def sample_size_mean(std: float, difference: float, alpha: float = 0.05, power: float = 0.8, variants: int = 2) -> int:
    return math.ceil(2 * (std * (norm_ppf(1 - alpha / (variants - 1) / 2) + norm_ppf(power)) / difference) ** 2)


def power_proportion(base: float, lift: float, n: int, alpha: float = 0.05) -> float:
    p1, p2 = base, base * (1 + lift)
    p = (p1 + p2) / 2
    z = (abs(p1 - p2) * math.sqrt(n) - norm_ppf(1 - alpha / 2) * math.sqrt(2 * p * (1 - p))) / math.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return norm_cdf(z)


def power_mean(std: float, difference: float, n: int, alpha: float = 0.05) -> float:
    return norm_cdf(abs(difference) / (std * math.sqrt(2 / n)) - norm_ppf(1 - alpha / 2))


def detectable_lift(base: float, n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """The smallest relative lift that reaches the power, by bisection."""
    low, high = 0.0, max(1e-9, min(10.0, (1 - base) / base))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if power_proportion(base, mid, n, alpha) >= power else (mid, high)
    return high


def ratio_mismatch(counts: list[int], planned: list[float] | None = None, alpha: float = 0.001) -> tuple[float, bool]:
    p = goodness_of_fit(counts, planned or [1.0] * len(counts)).p
    return p, p < alpha


def sequential_alpha(look: int, looks: int, alpha: float = 0.05) -> float:
    """O'Brien-Fleming boundary for an interim look."""
    return 2 * (1 - norm_cdf(norm_ppf(1 - alpha / 2) / math.sqrt(look / looks)))


def decide(arms: list[dict], control: str, kind: str = "conversion", alpha: float = 0.05, planned: list[float] | None = None, needed: int | None = None) -> dict:
    """Readout of (arm, n, successes | mean, variance) rows against control."""
    base = next(a for a in arms if a["arm"] == control)
    others = [a for a in arms if a["arm"] != control]
    p_ratio, mismatch = ratio_mismatch([a["n"] for a in arms], planned)
    if kind == "conversion":
        tests = [two_proportions(a["successes"], a["n"], base["successes"], base["n"], alpha) for a in others]
    else:
        tests = [welch(Moments(a["n"], a["mean"], a["variance"]), Moments(base["n"], base["mean"], base["variance"]), alpha) for a in others]
    rows = [{"arm": a["arm"], "p": t.p, "effect": t.effect, "low": t.low, "high": t.high, "significant": s} for a, t, s in zip(others, tests, benjamini_hochberg([t.p for t in tests], alpha))]
    if mismatch:
        verdict = "invalid"
    elif any(r["significant"] and r["low"] > 0 for r in rows):
        verdict = "ship"
    elif any(r["significant"] and r["high"] < 0 for r in rows):
        verdict = "do not ship"
    elif needed and min(a["n"] for a in arms) < needed:
        verdict = "keep running"
    else:
        verdict = "no difference"
    return {"decision": verdict, "sample_ratio_p": p_ratio, "arms": rows}


def difference_in_differences(cells: dict[tuple[bool, bool], Moments]) -> tuple[float, float, float]:
    """(effect, standard error, p) from moments by (treated, after)."""
    effect = (cells[True, True].mean - cells[True, False].mean) - (cells[False, True].mean - cells[False, False].mean)
    se = math.sqrt(sum(m.var / m.n for m in cells.values()))
    return effect, se, 2 * (1 - norm_cdf(abs(effect) / se)) if se else (0.0 if effect else 1.0)


def holdout_lift(treated: Moments, holdout: Moments) -> dict:
    t = welch(treated, holdout)
    return {"lift": treated.mean - holdout.mean, "lift_pct": 100 * (treated.mean / holdout.mean - 1) if holdout.mean else None, "p": t.p, "low": t.low, "high": t.high, "incremental": (treated.mean - holdout.mean) * treated.n}


def incremental_roas(incremental_revenue: float, spend: float) -> float | None:
    return incremental_revenue / spend if spend else None


def payback_days(cost: float, margin_per_day: float) -> float | None:
    return cost / margin_per_day if margin_per_day > 0 else None
