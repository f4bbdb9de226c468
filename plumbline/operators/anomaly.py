"""Anomalies of segments in DataFrame functions; anomalies and forecasts of series as Arrow groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import series as S


def segment_scores(df: DataFrame, dim: str, value: Column, z: float = 2.5, least_rows: int = 1, least_segments: int = 4) -> DataFrame:
    """(segment, total, median, mad, z, is_anomaly): each segment's total against the others'. Null is a segment."""
    sums = df.groupBy(F.coalesce(F.col(dim).cast("string"), F.lit("None")).alias("segment")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_rows)
    mid = sums.agg(F.median("total").alias("median"), F.count(F.lit(1)).alias("_k"))
    near = sums.crossJoin(F.broadcast(mid))
    dev = near.agg((1.4826 * F.median(F.abs(F.col("total") - F.col("median")))).alias("mad"))
    scale = F.greatest("mad", F.abs("median") * 0.02)
    score = F.when((F.col("_k") >= least_segments) & (scale > 0), (F.col("total") - F.col("median")) / scale).otherwise(0.0)
    return near.crossJoin(F.broadcast(dev)).select("segment", "total", "median", "mad", score.alias("z"), (F.abs(score) >= z).alias("is_anomaly"))


def temporal_scores(series: DataFrame, z: float = 3.0) -> DataFrame:
    """(period, value, median, mad, z, is_anomaly) over a series (period, value); its last period is marked, not dropped."""
    mid = series.agg(F.median("value").alias("median"))
    near = series.crossJoin(F.broadcast(mid))
    dev = near.agg((1.4826 * F.median(F.abs(F.col("value") - F.col("median")))).alias("mad"))
    score = F.when(F.col("mad") > 0, (F.col("value") - F.col("median")) / F.col("mad")).otherwise(0.0)
    return near.crossJoin(F.broadcast(dev)).select("period", "value", "median", "mad", score.alias("z"), (F.abs(score) >= z).alias("is_anomaly"))


def temporal_exceptions(long: DataFrame, partial: bool = False, z: float = 3.0, least: int = 8, keep: tuple[int, int] = (30, 10)) -> DataFrame:
    """(kpi_id, period, value, median, mad, z, kind, suppressed) of the values in (kpi_id, period, value) beyond `z`.

    Series with fewer than `least` values or next to no spread are left out. With `partial`, a dip in a series' last
    period is suppressed, as the data end inside it. The strongest are reported, up to `keep` of either sort.
    """
    own = Window.partitionBy("kpi_id")  # a row for each reporting period
    s = long.where("value is not null").withColumn("n", F.count(F.lit(1)).over(own)).withColumn("median", F.percentile("value", F.lit(0.5)).over(own)).withColumn("_last", F.max("period").over(own))
    s = s.withColumn("mad", 1.4826 * F.percentile(F.abs(F.col("value") - F.col("median")), F.lit(0.5)).over(own))
    s = s.where((F.col("n") >= least) & (F.col("mad") > 0) & (F.col("mad") >= F.abs("median") * 1e-6)).withColumn("z", (F.col("value") - F.col("median")) / F.col("mad")).where(F.abs("z") >= z)
    s = s.withColumn("kind", F.when(F.col("z") > 0, "spike").otherwise("dip"))
    s = s.withColumn("suppressed", F.lit(partial) & (F.col("period") == F.col("_last")) & (F.col("kind") == "dip"))
    cols = ["kpi_id", "period", "value", "median", "mad", "z", "kind", "suppressed"]
    top = lambda sort, k: s.where(F.col("suppressed") == sort).select(*cols).orderBy(F.desc(F.abs("z")), "kpi_id", "period").limit(k)
    return top(False, keep[0]).unionByName(top(True, keep[1]))


def slots(long: DataFrame, cycle: int) -> DataFrame:
    """(kpi_id, slot, n, mean, relative): means of a series' places in a cycle, also relative to its level."""
    own = Window.partitionBy("kpi_id")  # a row for each reporting period
    at = long.where("value is not null").withColumn("slot", ((F.row_number().over(own.orderBy("period")) - 1) % cycle).cast("long")).withColumn("_level", F.avg("value").over(own))
    return at.groupBy("kpi_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("_level").alias("_level")).select("kpi_id", "slot", "n", "mean", (F.col("mean") / F.col("_level")).alias("relative"))


def rule_exceptions(counts: dict[str, int], rows: int) -> list[dict]:
    """Exceptions of a ledger's rules (rule -> rows it concerns): its share of all rows and a level, 20 % high, 5 % medium."""
    share = lambda n: 100 * n / rows if rows else 0.0
    return [{"rule": r, "rows": n, "pct": round(share(n), 4), "severity": "high" if share(n) >= 20 else "medium" if share(n) >= 5 else "low"} for r, n in counts.items() if n]


def _ordered(p: pd.DataFrame) -> tuple[list[float], list[str]]:
    p = p.dropna(subset=["value"]).sort_values("period")
    return p["value"].astype(float).tolist(), p["period"].astype(str).tolist()


def series_anomalies(long: DataFrame, cycle: int | None = None) -> DataFrame:
    """Anomalies of each series in (kpi_id, period, value)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y, labels = _ordered(p)
        rows = S.anomalies(y, labels, cycle)
        return pd.DataFrame([(p["kpi_id"].iloc[0], r["label"], r["kind"], r["value"], r["expected"], r["z"], r["delta_pct"], r["severity"]) for r in rows], columns=["kpi_id", "period", "kind", "value", "expected", "z", "delta_pct", "severity"])

    return long.groupBy("kpi_id").applyInPandas(run, "kpi_id string, period string, kind string, value double, expected double, z double, delta_pct double, severity string")


def forecasts(long: DataFrame, horizon: int = 3, cycle: int | None = None) -> DataFrame:
    """(kpi_id, step, model, value, low, high, mase, beats_naive) for each series."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y, _ = _ordered(p)
        rows = S.forecast(y, horizon, cycle)
        return pd.DataFrame([(p["kpi_id"].iloc[0], r["step"], r["model"], r["value"], r["low"], r["high"], r["mase"], r["beats_naive"]) for r in rows], columns=["kpi_id", "step", "model", "value", "low", "high", "mase", "beats_naive"])

    return long.groupBy("kpi_id").applyInPandas(run, "kpi_id string, step int, model string, value double, low double, high double, mase double, beats_naive boolean")


def trends(long: DataFrame, cycles: tuple[int, ...] = (4, 7, 12)) -> DataFrame:
    """(kpi_id, trend, p, tau, slope, slope_pct, cycle, strength, change_points, alarms) for each series."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y, _ = _ordered(p)
        t, (cycle, strength) = S.mann_kendall(y), S.season(y, cycles)
        return pd.DataFrame([(p["kpi_id"].iloc[0], t["trend"], t["p"], t["tau"], t["slope"], t["slope_pct"], cycle or 0, strength, S.change_points(y), S.cusum(y))], columns=["kpi_id", "trend", "p", "tau", "slope", "slope_pct", "cycle", "strength", "change_points", "alarms"])

    return long.groupBy("kpi_id").applyInPandas(run, "kpi_id string, trend string, p double, tau double, slope double, slope_pct double, cycle int, strength double, change_points array<int>, alarms array<int>")


def decomposition(long: DataFrame, cycle: int = 12, multiplicative: bool = False) -> DataFrame:
    """(kpi_id, period, trend, seasonal, residual) of each series with two cycles at least."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y, labels = _ordered(p)
        if len(y) < 2 * cycle:
            return pd.DataFrame(columns=["kpi_id", "period", "trend", "seasonal", "residual"])
        return pd.DataFrame({"kpi_id": p["kpi_id"].iloc[0], "period": labels, **S.decompose(y, cycle, multiplicative)})

    return long.groupBy("kpi_id").applyInPandas(run, "kpi_id string, period string, trend double, seasonal double, residual double")
