"""What a ledger and its findings ask for: rules as rows over aggregated facts, demoted where data quality is poor.

Every rule is a condition, a score, a confidence and an impact over the columns of one input: the ledger's facts (a row), its customer
bands, trends, outlying segments or drivers of a change. Inputs are small aggregates of the data; nothing else is read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import ratio
from plumbline.operators import ledger, segments

#: Column names that show that marketing can be observed; without any, what needs it is a hypothesis.
CAMPAIGN = "(?i)campaign|channel|utm|exposure|impression|spend|cost|cpa|roas"
# Recommendations are critical, high or medium from these scores on; below a quality of 80 data come first, below 70 all else is demoted to 70 %.
PRIORITIES = (("critical", 80.0), ("high", 60.0), ("medium", 40.0))
GATE, POOR, DEMOTED, MOST = 80.0, 70.0, 0.7, 10
_SCHEMA = ("rule", "category", "metric", "segment", "score", "confidence", "impact", "hypothesis")


def facts(df: DataFrame, c: dict[str, str], value: Column) -> DataFrame:
    """One row: revenue, customers with one and with more invoices, what cannot be attributed, cancellations, how many customers make 80 %."""
    sale = df.where(ledger.in_scope(c))
    customer, invoice = F.col(c["customer"]), F.col(c["invoice"]).cast("string")
    per = sale.groupBy(customer.alias("entity")).agg(F.count_distinct(invoice).alias("orders"), F.sum(value).cast("double").alias("total"), F.count(F.lit(1)).alias("lines"))
    known, many = F.col("entity").isNotNull(), F.col("orders") > 1
    money = lambda when: F.coalesce(F.sum(F.when(when, F.col("total"))), F.lit(0.0))
    out = per.agg(money(F.lit(True)).alias("revenue"), F.count_if(known).alias("identified"), F.count_if(known & many).alias("repeat_customers"), money(known & many).alias("repeat_revenue"), money(~known).alias("anonymous_revenue"), F.coalesce(F.sum(F.when(~known, F.col("lines"))), F.lit(0)).alias("_anonymous"), F.coalesce(F.sum("lines"), F.lit(0)).alias("_lines"))
    ranked = segments.cumulative(per.where(known & (F.col("total") > 0)).select("entity", "total"))
    top = ranked.agg(F.count(F.lit(1)).alias("entities"), F.min(F.when(F.col("cumulative_share") >= 80, F.col("position"))).alias("for_80"), F.sum("total").alias("ranked_total"))
    gone = df.agg(F.count_distinct(F.when(ledger.cancelled(c), invoice)).alias("cancelled"), F.count_distinct(invoice).alias("invoices"))
    out = out.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(gone))
    seen = any(re.search(CAMPAIGN, name) for name in df.columns)
    return out.select("revenue", "identified", "repeat_customers", (F.col("identified") - F.col("repeat_customers")).alias("one_time"), ratio(F.col("repeat_customers"), F.col("identified"), 100).alias("repeat_rate"), "repeat_revenue", "anonymous_revenue", ratio(F.col("_anonymous"), F.col("_lines"), 100).alias("anonymous_pct"), "entities", ratio(F.col("for_80"), F.col("entities"), 100).alias("share_80"), "ranked_total", ratio(F.col("cancelled"), F.col("invoices"), 100).alias("cancellation_rate"), F.lit(not seen).alias("hypothesis"))


def _rows(df: DataFrame, when: Column, rule: str, category: str, metric, segment, score: Column, confidence, impact=None, hypothesis=None) -> DataFrame:
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    made = (F.lit(rule), F.lit(category), text(metric), text(segment), score.cast("double"), number(confidence), number(impact), F.lit(False) if hypothesis is None else hypothesis)
    return df.where(when).select(*[x.alias(n) for n, x in zip(_SCHEMA, made)])


def _of_facts(f: DataFrame, bands: DataFrame | None) -> list[DataFrame]:
    c = F.col
    guess = lambda yes, no: F.when(c("hypothesis"), yes).otherwise(no)
    repeat_value, once_value = F.coalesce(ratio(c("repeat_revenue"), c("repeat_customers")), F.lit(0.0)), ratio(F.greatest(F.lit(0.0), c("revenue") - c("repeat_revenue")), c("one_time"))
    rescue = c("ranked_total") * 0.02
    if bands is not None:
        risk = bands.where(c("segment").isin("At risk", "Lost high value")).agg(F.min_by("value", "segment").cast("double").alias("_risk"))
        f = f.crossJoin(F.broadcast(risk))
        rescue = F.coalesce(c("_risk") * 0.25, rescue)
    out = [
        _rows(f, (c("one_time") >= 20), "activation", "growth", "repeat_rate", "One-time customers", F.least(F.lit(92.0), 45 + (100 - c("repeat_rate")) * 0.4), guess(0.55, 0.72), F.greatest(F.lit(0.0), repeat_value - once_value) * c("one_time") * 0.05, c("hypothesis")),
        _rows(f, (c("entities") >= 20) & (c("share_80") <= 45), "retention", "retention", "revenue", "Top customers", F.least(F.lit(95.0), 105 - c("share_80")), 0.78, rescue, c("hypothesis")),
        _rows(f, c("cancellation_rate") >= 1, "cancellations", "operations", "cancellation_rate", "Cancelled invoices", F.least(F.lit(88.0), 40 + c("cancellation_rate") * 6), 0.8),
        _rows(f, c("anonymous_pct") >= 10, "identity", "data", "customers", "Unidentified transactions", F.least(F.lit(90.0), 40 + c("anonymous_pct")), 0.85, c("anonymous_revenue")),
    ]
    if bands is not None:
        one = Window.partitionBy(F.lit(0))  # a row for each band
        b = bands.withColumns({"_n": F.count(F.lit(1)).over(one), "_mean": ratio(F.sum("value").over(one), F.sum("customers").over(one))}).withColumn("lift", ratio(ratio(c("value"), c("customers")), c("_mean")))
        b = b.where((c("_n") >= 3) & (c("customers") >= 10) & (c("segment") != "Champions")).withColumn("_k", F.row_number().over(one.orderBy(F.desc("lift"), "segment"))).where("_k = 1").crossJoin(F.broadcast(f.select("hypothesis")))
        out.append(_rows(b, c("lift") >= 1.2, "targeting", "growth", "revenue", c("segment"), F.least(F.lit(85.0), 40 + (c("lift") - 1) * 30), guess(0.5, 0.68), c("value") * 0.03, c("hypothesis")))
    return out


def advise(ledger_facts: DataFrame, bands: DataFrame | None = None, quality: float | None = None, trends: DataFrame | None = None, outliers: DataFrame | None = None, drivers: DataFrame | None = None, falling_is_bad: tuple[str, ...] = ("revenue",)) -> DataFrame:
    """(rule, category, metric, segment, score, priority, confidence, impact, hypothesis, act): at most ten recommendations, the strongest first by score.

    bands: (segment, customers, value); trends: as `outlook.mann_kendall`; outliers: (dimension, segment, metric, z); drivers: (metric, segment, change,
    contribution, confidence, excess) of unfavourable changes. Of poor data everything but their repair is to be looked into, not acted on.
    """
    c = F.col
    parts = _of_facts(ledger_facts, bands)
    if quality is not None and quality < GATE:
        parts.append(_rows(ledger_facts, F.lit(True), "quality_gate", "data-quality", None, None, F.lit(min(100.0, (GATE - quality) * 2 + 45)), 0.9))
    if trends is not None:
        bad = F.when(c("kpi_id").isin(*falling_is_bad), c("slope") < 0).otherwise(c("slope") > 0)
        parts.append(_rows(trends, c("significant") & bad, "adverse_trend", "monitoring", c("kpi_id"), None, F.least(F.lit(100.0), 45 + F.abs("tau") * 40), F.round(1 - F.least(c("p"), F.lit(0.2)), 2), c("slope") * 3))
    if outliers is not None:
        top = outliers.orderBy(F.desc(F.abs("z")), "segment").limit(3)
        parts.append(_rows(top, F.lit(True), "segment_anomaly", "investigation", c("metric"), c("segment"), F.least(F.lit(100.0), 35 + F.abs("z") * 10), 0.7))
    if drivers is not None:
        parts.append(_rows(drivers, F.lit(True), "concentrated_driver", "investigation", c("metric"), c("segment"), F.least(F.lit(100.0), 40 + F.abs("change") * 1.5 + c("contribution") * 0.3), F.least(F.lit(0.95), c("confidence")), c("excess")))
    rows = reduce(DataFrame.unionAll, parts)
    poor = F.lit(quality is not None and quality < POOR) & (c("rule") != "quality_gate")
    level = F.lit("low")
    for name, least in reversed(PRIORITIES):
        level = F.when(c("score") >= least, name).otherwise(level)
    rows = rows.withColumn("priority", level).withColumn("confidence", F.round(F.when(poor, c("confidence") * DEMOTED).otherwise(c("confidence")), 2)).withColumn("act", ~poor)
    return rows.withColumn("score", F.round("score", 1)).withColumn("impact", F.round("impact", 2)).orderBy(F.desc("score"), "rule", "segment").limit(MOST).select("rule", "category", "metric", "segment", "score", "priority", "confidence", "impact", "hypothesis", "act")
