"""Why a KPI moved between two periods: one scan for all dimensions, segments and both periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import in_period, ratio


def segment_moments(df: DataFrame, dims: list[str], date: str, baseline: str, current: str, end: str, value: Column, weight: Column | None = None) -> DataFrame:
    """(dimension, segment, and for both periods: rows n0 n1, sums s0 s1, squares q0 q1, weights w0 w1).

    Rows of other periods never leave the scan; dimensions are unpivoted after a first aggregation by all of them
    where that shrinks the data, which partial aggregation does by itself.
    """
    ts = F.col(date)
    now = in_period(ts, current, end)
    rows = df.where(in_period(ts, baseline, end)).select(*dims, now.alias("_now"), value.cast("double").alias("_v"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w"))
    tall = rows.select("_now", "_v", "_w", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dims])).alias("_s")).select("_now", "_v", "_w", "_s.*")
    aggs = []
    for k, side in (("1", F.col("_now")), ("0", ~F.col("_now"))):
        aggs += [F.count_if(side).alias(f"n{k}"), F.coalesce(F.sum(F.when(side, F.col("_v"))), F.lit(0.0)).alias(f"s{k}"), F.coalesce(F.sum(F.when(side, F.col("_v") * F.col("_v"))), F.lit(0.0)).alias(f"q{k}"), F.coalesce(F.sum(F.when(side, F.col("_w"))), F.lit(0.0)).alias(f"w{k}")]
    return tall.groupBy("dimension", "segment").agg(*aggs)


def additive(m: DataFrame) -> DataFrame:
    """Adds delta, contribution (percent of the dimension's change), shares, mix shift, expected and excess."""
    w = Window.partitionBy("dimension")
    out = m.withColumn("delta", F.col("s1") - F.col("s0")).withColumn("_d", F.sum("delta").over(w)).withColumn("_s0", F.sum("s0").over(w)).withColumn("_s1", F.sum("s1").over(w)).withColumn("_a", F.sum(F.abs("s0")).over(w))
    out = out.withColumn("contribution", ratio(F.col("delta"), F.col("_d"), 100)).withColumn("share0", ratio(F.col("s0"), F.col("_s0"), 100)).withColumn("share1", ratio(F.col("s1"), F.col("_s1"), 100))
    out = out.withColumn("mix_shift", F.col("share1") - F.col("share0")).withColumn("expected", ratio(F.abs("s0"), F.col("_a")) * F.col("_d")).withColumn("excess", F.col("delta") - F.col("expected"))
    growth = ratio(F.col("_d"), F.col("_s0"), 100)
    return out.withColumn("growth_gap", F.when((F.col("s0") != 0) & (F.col("s1") != 0), ratio(F.col("delta"), F.col("s0"), 100) - growth)).drop("_d", "_s0", "_s1", "_a")


def mix_rate(m: DataFrame) -> DataFrame:
    """For ratios (s over w): rate effect w1 * (r1 - r0), mix effect (w1 - w0) * (r0 - overall r0), in shares of weight."""
    w = Window.partitionBy("dimension")
    out = m.withColumn("_w0", F.sum("w0").over(w)).withColumn("_w1", F.sum("w1").over(w)).withColumn("_r", ratio(F.sum("s0").over(w), F.sum("w0").over(w)))
    out = out.withColumn("r0", ratio(F.col("s0"), F.col("w0"))).withColumn("r1", ratio(F.col("s1"), F.col("w1"))).withColumn("weight0", ratio(F.col("w0"), F.col("_w0"))).withColumn("weight1", ratio(F.col("w1"), F.col("_w1")))
    r0 = F.coalesce("r0", F.col("_r"))
    return out.withColumn("rate_effect", F.col("weight1") * (F.coalesce("r1", r0) - r0)).withColumn("mix_effect", (F.col("weight1") - F.col("weight0")) * (r0 - F.col("_r"))).drop("_w0", "_w1", "_r")


def power(decomposed: DataFrame) -> DataFrame:
    """(dimension, segments, dispersion, concentration, coverage): how well a dimension explains the change."""
    a = decomposed.groupBy("dimension").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.abs("excess")).alias("_e"), F.sum(F.abs("delta")).alias("_d"), F.max(F.abs("excess")).alias("_m"), F.abs(F.sum("delta")).alias("_t"))
    return a.select("dimension", "segments", F.least(F.lit(1.0), F.coalesce(ratio(F.col("_e"), F.col("_d")), F.lit(0.0))).alias("dispersion"), F.coalesce(ratio(F.col("_m"), F.col("_e")), F.lit(0.0)).alias("concentration"), F.coalesce(ratio(F.col("_t"), F.col("_d")), F.lit(0.0)).alias("coverage"))


def full_outer(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of either period, with zero where one lacks them: (keys..., current, baseline, delta)."""
    c, b = current.alias("c"), baseline.alias("b")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    value = lambda s: F.coalesce(F.col(f"{s}.value"), F.lit(0))
    j = c.join(b, on, "full")
    return j.select(*[F.coalesce(F.col(f"c.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], value("c").alias("current"), value("b").alias("baseline"), (value("c") - value("b")).alias("delta"))


def drill(df: DataFrame, dim: str, segments: list[str], sub: str, date: str, baseline: str, current: str, end: str, value: Column) -> DataFrame:
    """The second level: moments by (parent, child) of a few chosen segments, in one query."""
    few = df.where(F.col(dim).cast("string").isin(*segments))
    ts = F.col(date)
    now = in_period(ts, current, end)
    return few.where(in_period(ts, baseline, end)).groupBy(F.col(dim).cast("string").alias("parent"), F.col(sub).cast("string").alias("child")).agg(F.coalesce(F.sum(F.when(now, value)), F.lit(0)).alias("s1"), F.coalesce(F.sum(F.when(~now, value)), F.lit(0)).alias("s0"), F.count(F.lit(1)).alias("n"))
