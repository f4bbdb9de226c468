"""Seasons, one-step tests and forecasts of KPI series as plain DataFrame plans, by the SQL profile.

A series has a row for each KPI and reporting period. Models that carry a state from period to period fold the array of a series'
values inside Spark; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import period_label, ratio

# Reporting periods of a full cycle, the least swing of a season, the smoothing of the models, the width of an 80 % band.
CYCLES = {"day": 7, "week": 52, "month": 12, "quarter": 4}
SWING = 0.15
LEVEL = 0.35
ALPHA, BETA, PHI = 0.4, 0.15, 0.9
BAND = 1.2816
#: Models in the order in which ties go.
MODELS = ("naive", "ses", "holt")


def _own():
    return Window.partitionBy("kpi_id")


def _numbered(long: DataFrame) -> DataFrame:
    own = long.where("value IS NOT NULL").withColumn("value", F.col("value").cast("double"))
    return own.withColumns({"i": F.row_number().over(_own().orderBy("period")) - 1, "n": F.count(F.lit(1)).over(_own())})


def seasons(long: DataFrame, cycle: int) -> DataFrame:
    """(kpi_id, detected, cycle, strength, peak, trough): the means of a cycle's slots differ by 15 % of the level, over two cycles at least.

    peak and trough are the first periods of the slots with the largest and smallest mean.
    """
    at = _numbered(long).withColumn("_level", F.avg("value").over(_own()))
    slots = at.groupBy("kpi_id", (F.col("i") % cycle).alias("slot")).agg(F.avg("value").alias("m"), F.min_by("period", "i").alias("label"), F.first("n").alias("n"), F.first("_level").alias("level"))
    out = slots.groupBy("kpi_id").agg(F.min(F.struct(-F.col("m"), "slot", "label")).alias("_top"), F.min(F.struct("m", "slot", "label")).alias("_low"), F.max("m").alias("high"), F.min("m").alias("low"), F.first("n").alias("n"), F.first("level").alias("level"))
    swing = ratio(F.col("high") - F.col("low"), F.abs("level"))
    real = (F.col("n") >= 2 * cycle) & F.coalesce(swing >= SWING, F.lit(False))
    return out.select("kpi_id", real.alias("detected"), F.when(real, F.lit(cycle)).alias("cycle"), F.when(real, F.round(F.least(F.lit(1.0), swing), 2)).otherwise(0.0).alias("strength"), F.when(real, F.col("_top.label")).alias("peak"), F.when(real, F.col("_low.label")).alias("trough"))


def _states(y: Column) -> Column:
    """After each value: the smoothed level, and level and slope of a damped trend."""
    first = F.struct(y[0].alias("ses"), y[0].alias("level"), (F.coalesce(F.get(y, 1), y[0]) - y[0]).alias("slope"))

    def step(done: Column, v: Column) -> Column:
        last = F.element_at(done, -1)
        level = ALPHA * v + (1 - ALPHA) * (last["level"] + PHI * last["slope"])
        slope = BETA * (level - last["level"]) + (1 - BETA) * PHI * last["slope"]
        return F.concat(done, F.array(F.struct((last["ses"] + LEVEL * (v - last["ses"])).alias("ses"), level.alias("level"), slope.alias("slope"))))

    return F.aggregate(F.slice(y, 2, F.size(y)), F.array(first), step)


def _ahead(state: Column, last: Column, steps: int) -> dict[str, Column]:
    return {"naive": last, "ses": state["ses"], "holt": state["level"] + state["slope"] * sum(PHI**k for k in range(1, steps + 1))}


def _series(long: DataFrame) -> DataFrame:
    """(kpi_id, y, s): a series' values in order and the states after them; a series' length is its number of reporting periods."""
    rows = long.where("value IS NOT NULL").groupBy("kpi_id").agg(F.array_sort(F.collect_list(F.struct("period", F.col("value").cast("double").alias("v")))).alias("r"))
    return rows.withColumn("y", F.col("r.v")).withColumn("s", _states(F.col("y"))).drop("r")


def backtests(long: DataFrame) -> DataFrame:
    """(kpi_id, model, mase, mape, rmse, folds): one step ahead from every origin behind the first half (four values at least); three origins are needed."""
    at = _series(long).select("kpi_id", "y", "s", F.explode(F.sequence(F.greatest(F.lit(4), F.floor(F.size("y") / 2).cast("int")), F.size("y") - 1)).alias("k")).where("k < size(y)")
    y, before = F.get("y", F.col("k")), F.get("y", F.col("k") - 1)
    models = _ahead(F.get("s", F.col("k") - 1), before, 1)
    rows = at.select("kpi_id", y.alias("v"), F.abs(y - before).alias("step"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (y - f).alias("e")) for m, f in models.items()])).alias("x")).select("kpi_id", "v", "step", "x.*")
    scale = F.avg("step")
    pct = F.avg(F.when(F.abs("v") > 1e-9, 100 * F.abs(F.col("e") / F.col("v"))))
    out = rows.groupBy("kpi_id", "model").agg(F.round(F.avg(F.abs("e")) / F.when(scale == 0, 1e-9).otherwise(scale), 4).alias("mase"), F.round(F.coalesce(pct, F.lit(0.0)), 4).alias("mape"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 4).alias("rmse"), F.count(F.lit(1)).alias("folds"))
    return out.where("folds >= 3")


def outlook(long: DataFrame, horizon: int = 3) -> DataFrame:
    """(kpi_id, step, model, value, low, high, mase, beats_naive): the model with the least MASE, an 80 % band from the changes between periods.

    Nothing for series of fewer than eight values, flat ones, and those without three origins.
    """
    rank = F.when(F.col("model") == "naive", 0).when(F.col("model") == "ses", 1).otherwise(2)
    tested = backtests(long).withColumn("_r", rank)
    best = tested.groupBy("kpi_id").agg(F.min(F.struct("mase", "_r", "model")).alias("b"), F.min(F.when(F.col("model") == "naive", F.col("mase"))).alias("naive"))
    s = _series(long).where((F.size("y") >= 8) & (F.array_max("y") - F.array_min("y") >= 1e-12)).join(best, "kpi_id")
    changes = F.expr("zip_with(slice(y, 2, size(y) - 1), slice(y, 1, size(y) - 1), (b, a) -> b - a)")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / F.size(a)
    s = s.withColumn("_c", changes).withColumn("_m", mean(F.col("_c")))
    spread = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda t, v: t + (v - F.col("_m")) * (v - F.col("_m"))) / (F.size("_c") - 1))
    s = s.withColumn("_w", BAND * F.when(spread == 0, 0.05 * F.abs(mean(F.col("y")))).otherwise(spread))
    last, state = F.element_at("y", -1), F.element_at("s", -1)
    steps = [F.struct(F.lit(k).alias("step"), *[f.alias(m) for m, f in _ahead(state, last, k).items()]) for k in range(1, horizon + 1)]
    rows = s.select("kpi_id", "b", "naive", "_w", F.explode(F.array(*steps)).alias("x"))
    model = F.col("b.model")
    value = F.when(model == "naive", F.col("x.naive")).when(model == "ses", F.col("x.ses")).otherwise(F.col("x.holt"))
    half = F.col("_w") * F.sqrt(F.col("x.step").cast("double"))
    return rows.select("kpi_id", F.col("x.step").alias("step"), model.alias("model"), F.round(value, 4).alias("value"), F.round(value - half, 4).alias("low"), F.round(value + half, 4).alias("high"), F.col("b.mase").alias("mase"), ((model != "naive") & (F.col("b.mase") < 0.98 * F.col("naive"))).alias("beats_naive"))


_STEPS = {"day": "make_dt_interval({k})", "week": "make_dt_interval(7 * {k})", "month": "make_ym_interval(0, {k})", "quarter": "make_ym_interval(0, 3 * {k})", "year": "make_ym_interval({k})"}


def grain_of(long: DataFrame) -> DataFrame:
    """(kpi_id, grain): the reporting period by the days between the last two; a month where there is one only."""
    last = long.select("kpi_id", F.col("period").cast("date").alias("period")).distinct().withColumn("_k", F.row_number().over(_own().orderBy(F.desc("period")))).where("_k <= 2")
    gap = F.datediff(F.max("period"), F.min("period"))
    return last.groupBy("kpi_id").agg(F.when(F.count(F.lit(1)) < 2, "month").when(gap <= 2, "day").when(gap <= 10, "week").when(gap <= 45, "month").otherwise("quarter").alias("grain"))


def future_periods(long: DataFrame, horizon: int = 3, grain: str | None = None) -> DataFrame:
    """(kpi_id, step, start, label): the periods after each series' last."""
    last = long.groupBy("kpi_id").agg(F.max(F.col("period").cast("date")).alias("last"))
    last = last.withColumn("grain", F.lit(grain)) if grain else last.join(grain_of(long), "kpi_id")
    ahead = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    start = label = F.lit(None)
    for g, step in _STEPS.items():
        at = (F.col("last").cast("timestamp_ntz") + F.expr(step.format(k="step"))).cast("date")
        start = F.when(F.col("grain") == g, at).otherwise(start)
    ahead = ahead.withColumn("start", start.cast("date"))
    for g in _STEPS:
        name = F.date_format("start", "yyyy-MM-dd") if g == "day" else F.date_format("start", "yyyy") if g == "year" else F.format_string("W%02d %d", F.weekofyear("start"), F.year("start")) if g == "week" else F.concat(F.lit("Q"), F.quarter("start"), F.lit(" "), F.year("start")) if g == "quarter" else period_label(F.col("start"), "month")
        label = F.when(F.col("grain") == g, name).otherwise(label)
    return ahead.select("kpi_id", "step", "start", label.cast("string").alias("label"))


def two_sided(z: Column) -> Column:
    """Two-sided p of a normal statistic by the rational approximation the SQL profile uses (Abramowitz and Stegun 26.2.17)."""
    # Fixed values of the approximation.
    a, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    k = 1 / (1 + a * F.abs(z))
    tail = F.exp(-z * z / 2) / F.sqrt(2 * F.lit(3.141592653589793)) * sum((c * F.pow(k, F.lit(i)) for i, c in enumerate(b, 1)), F.lit(0.0))
    return F.when(z.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * tail)))


def proportions(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """(z, p) of two shares against their pooled one; nothing is said below five on a side."""
    pooled = ratio(a + b, n_a + n_b)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n_a + 1 / n_b))
    z = F.when((F.least(n_a, n_b) >= 5) & (error > 0), (a / n_a - b / n_b) / error)
    return F.struct(F.round(F.coalesce(z, F.lit(0.0)), 3).alias("z"), F.round(F.coalesce(two_sided(z), F.lit(1.0)), 4).alias("p"))


def welch(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    """(t, p, d) of two means from moments, with a normal tail; nothing is said below two on a side or without spread."""
    error = F.sqrt(s1 * s1 / n1 + s2 * s2 / n2)
    pooled = F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / F.greatest(F.lit(1), n1 + n2 - 2))
    some = (F.least(n1, n2) >= 2) & (error > 0)
    t = F.when(some, (m1 - m2) / error)
    return F.struct(F.round(F.coalesce(t, F.lit(0.0)), 3).alias("t"), F.round(F.coalesce(two_sided(t), F.lit(1.0)), 4).alias("p"), F.round(F.when(some & (pooled > 0), (m1 - m2) / pooled).otherwise(0.0), 3).alias("d"))


def mann_kendall(long: DataFrame) -> DataFrame:
    """(kpi_id, direction, slope, slope_pct, p, tau, significant, n): trend by concordant pairs of periods with the Theil-Sen slope.

    Pairs are of reporting periods, n (n - 1) / 2 of them in a series. Significant from six values and p below 0.05; nothing below four.
    """
    at = _numbered(long)
    right = at.select("kpi_id", F.col("i").alias("j"), F.col("value").alias("later"))
    pairs = at.join(right, "kpi_id").where("i < j")
    sums = pairs.groupBy("kpi_id").agg(F.sum(F.signum(F.col("later") - F.col("value"))).alias("s"), F.median((F.col("later") - F.col("value")) / (F.col("j") - F.col("i"))).alias("slope"), F.first("n").alias("n"))
    ties = at.groupBy("kpi_id", "value").agg(F.count(F.lit(1)).alias("c")).groupBy("kpi_id").agg(F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("ties"))
    level = at.groupBy("kpi_id").agg(F.abs(F.avg("value")).alias("level"))
    x = sums.join(ties, "kpi_id").join(level, "kpi_id").where("n >= 4")
    variance = (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("ties")) / 18
    z = F.when(variance > 0, (F.col("s") - F.signum("s")) / F.sqrt(variance)).otherwise(0.0)
    x = x.withColumn("p", two_sided(z))
    real = (F.col("p") < 0.05) & (F.col("n") >= 6)
    direction = F.when(~real, "flat").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return x.select("kpi_id", direction.alias("direction"), F.round("slope", 4).alias("slope"), F.round(F.coalesce(ratio(F.col("slope"), F.col("level"), 100), F.lit(0.0)), 2).alias("slope_pct"), F.round("p", 4).alias("p"), F.round(2 * F.col("s") / (F.col("n") * (F.col("n") - 1)), 3).alias("tau"), real.alias("significant"), "n")


def month_labels(spark: SparkSession, last: str, horizon: int, grain: str) -> list[str]:
    """Names of the periods after the one that starts on `last` (a date)."""
    one = spark.range(1).select(F.lit("k").alias("kpi_id"), F.lit(last).cast("date").alias("period"))
    return [r["label"] for r in future_periods(one, horizon, grain).orderBy("step").collect()]
