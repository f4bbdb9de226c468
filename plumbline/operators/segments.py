"""Rankings, shares and roll-ups by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import period, ratio


def top_per_period(df: DataFrame, date: str, grain: str, dim: str, value: Column, k: int = 3) -> DataFrame:
    """(period, segment, total, position): the k largest segments of each period."""
    sums = df.groupBy(period(date, grain).alias("period"), F.col(dim).alias("segment")).agg(F.sum(value).alias("total"))
    w = Window.partitionBy("period").orderBy(F.desc("total"), "segment")
    return sums.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= k)


def pareto(df: DataFrame, entity: str, value: Column, cut: float = 80.0, keep: int = 15) -> dict:
    """Ranked entities with running shares, and how many make `cut` percent.

    Ranks over all entities need one order. Totals are range-partitioned and counted by partition first, so only
    the k largest go through a window; the number that makes the cut comes from a grouped histogram of values.
    """
    totals = df.groupBy(F.col(entity).alias("entity")).agg(F.sum(value).alias("total")).where("total > 0")
    whole = totals.agg(F.sum("total").alias("w"), F.count(F.lit(1)).alias("n")).first()
    if (whole["n"] or 0) < 3:
        return {"entities": whole["n"], "for_cut": None, "top": []}
    top = totals.orderBy(F.desc("total"), "entity").limit(keep).collect()
    run, rows = 0.0, []
    for i, r in enumerate(top, 1):
        run += float(r["total"])
        rows.append({"entity": r["entity"], "rank": i, "total": float(r["total"]), "share": 100 * float(r["total"]) / float(whole["w"]), "cumulative": 100 * run / float(whole["w"])})
    return {"entities": whole["n"], "for_cut": cumulative(totals).where(F.col("cumulative_share") >= cut).agg(F.min("position")).first()[0], "top": rows}


def cumulative(totals: DataFrame, buckets: int = 64) -> DataFrame:
    """(entity, total, position, cumulative_share) for all entities, by a two-level prefix sum.

    Entities are cut into ranges of their total; ranks and sums run inside a range, and each range is shifted by
    what stands above it.
    """
    bounds = totals.agg(F.percentile_approx("total", [i / buckets for i in range(1, buckets)], 10_000).alias("b"))
    placed = totals.crossJoin(F.broadcast(bounds)).withColumn("_r", F.size(F.filter("b", lambda x: x < F.col("total")))).drop("b")
    own = Window.partitionBy("_r").orderBy(F.desc("total"), "entity")
    inner = placed.withColumn("_p", F.row_number().over(own)).withColumn("_s", F.sum("total").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    sums = placed.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"), F.sum("total").alias("_t"))
    above = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    shift = sums.select("_r", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_t0"), F.sum("_t").over(Window.partitionBy(F.lit(1))).alias("_w"))
    return inner.join(F.broadcast(shift), "_r").select("entity", "total", (F.col("_p") + F.col("_n0")).cast("long").alias("position"), ratio(F.col("_s") + F.col("_t0"), F.col("_w"), 100).alias("cumulative_share"))


def with_other(df: DataFrame, dim: str, value: Column, k: int) -> DataFrame:
    """(segment, total): the k - 1 largest segments and `Other (n)`."""
    sums = df.groupBy(F.col(dim).cast("string").alias("segment")).agg(F.sum(value).alias("total"))
    names = sums.orderBy(F.desc("total"), "segment").limit(k - 1).select(F.col("segment").alias("_top"))
    marked = sums.join(F.broadcast(names), F.col("segment").eqNullSafe(F.col("_top")), "left").withColumn("_rest", F.col("_top").isNull() & F.col("segment").isNotNull())
    return marked.groupBy(F.when(F.col("_rest"), F.lit("Other")).otherwise(F.col("segment")).alias("name"), "_rest").agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("members")).select(F.when(F.col("_rest"), F.concat(F.lit("Other ("), F.col("members"), F.lit(")"))).otherwise(F.col("name")).alias("segment"), "total")


def slices(df: DataFrame, dim: str, value: Column, date: Column, current, baseline, end, k: int = 12) -> DataFrame:
    """(segment, total, share, delta): the k largest segments, their share of what is shown, and their change."""
    now, then = (date >= F.lit(current)) & (date < F.lit(end)), (date >= F.lit(baseline)) & (date < F.lit(current))
    sums = df.groupBy(F.col(dim).alias("segment")).agg(F.sum(value).alias("total"), F.sum(F.when(now, value)).alias("_c"), F.sum(F.when(then, value)).alias("_b"))
    top = sums.orderBy(F.desc_nulls_last("total"), "segment").limit(k)
    return top.withColumn("share", ratio(F.col("total"), F.sum("total").over(Window.partitionBy(F.lit(1))), 100)).withColumn("delta", F.coalesce("_c", F.lit(0)) - F.coalesce("_b", F.lit(0))).drop("_c", "_b")


def nested(df: DataFrame, dim: str, sub: str, value: Column, groups: int = 7, children: int = 6, date: Column | None = None, spans: tuple | None = None) -> DataFrame:
    """(segment, child, total): the largest children of the largest segments.

    With a date and three times (a, b, c) also share, the child's percentage of its segment, and delta, its change between [a, b) and [b, c).
    """
    top = df.groupBy(F.col(dim).alias("segment")).agg(F.sum(value).alias("_t")).orderBy(F.desc("_t"), "segment").limit(groups).select("segment")
    more = []
    if date is not None:
        a, b, c = (F.lit(x) for x in spans)
        part = lambda low, high: F.coalesce(F.sum(F.when((date >= low) & (date < high), value)), F.lit(0))
        more = [(part(b, c) - part(a, b)).alias("delta")]
    pairs = df.groupBy(F.col(dim).alias("segment"), F.col(sub).alias("child")).agg(F.sum(value).alias("total"), *more).join(F.broadcast(top), "segment", "left_semi")
    if date is not None:
        pairs = pairs.withColumn("share", ratio(F.col("total"), F.sum("total").over(Window.partitionBy("segment")), 100))
    return pairs.withColumn("_k", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("total"), "child"))).where(F.col("_k") <= children).drop("_k")
