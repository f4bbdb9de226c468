"""A star schema over call blocks: staging, monthly funnel, pool health, campaign performance, and what reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import ratio, surrogate_key

MEASURES = ("dials", "connects", "qualified_leads", "conversions")


def staging(raw: DataFrame) -> DataFrame:
    """Typed call blocks; the month column is the date as stored."""
    return raw.withColumn("call_month", F.col("call_date").cast("date")).withColumns({m: F.col(m).cast("int") for m in MEASURES}).withColumns({c: F.round(F.col(c).cast("decimal(18,4)"), 2) for c in ("talk_time_minutes", "qa_score", "campaign_spend", "revenue") if c in raw.columns})


def monthly_funnel(stg: DataFrame) -> DataFrame:
    return stg.groupBy("call_month", "campaign", "caller_id_pool", "agent_type").agg(*[F.sum(m).alias(m) for m in MEASURES], F.sum("campaign_spend").alias("campaign_spend"), F.sum("revenue").alias("revenue"), F.avg("qa_score").alias("avg_qa_score"), F.count(F.lit(1)).alias("call_blocks"))


def month_over_month(df: DataFrame, key: str, month: str, top: str, bottom: str) -> DataFrame:
    """(key, month, top, bottom, rate, previous_rate, change): a rate of each key's months against the month before."""
    g = df.groupBy(key, month).agg(F.sum(top).alias(top), F.sum(bottom).alias(bottom)).withColumn("rate", ratio(F.col(top), F.col(bottom)))
    w = Window.partitionBy(key).orderBy(month)
    return g.withColumn("previous_rate", F.lag("rate").over(w)).withColumn("change", ratio(F.col("rate") - F.col("previous_rate"), F.col("previous_rate")))


def pool_health(funnel: DataFrame, limit: float = -0.30) -> DataFrame:
    m = month_over_month(funnel, "caller_id_pool", "call_month", "connects", "dials")
    return m.withColumn("pool_key", surrogate_key(F.date_format("call_month", "yyyy-MM-dd"), F.col("caller_id_pool"))).withColumn("spam_flag_risk", F.coalesce(F.col("change") < limit, F.lit(False)))


def share(top: str, bottom: str, places: int = 4) -> Column:
    """A rate of whole numbers, rounded half up in decimals, so that a tie does not depend on how a double is stored."""
    exact = F.col(top).cast("decimal(20, 0)") / F.col(bottom).cast("decimal(20, 0)")
    return F.when(F.col(bottom) != 0, F.round(exact, places).cast("double"))


def campaign_performance(funnel: DataFrame) -> DataFrame:
    g = funnel.groupBy("call_month", "campaign").agg(*[F.sum(m).alias(m) for m in MEASURES], F.sum("campaign_spend").alias("campaign_spend"), F.sum("revenue").alias("revenue"))
    rate = lambda a, b, k: F.round(ratio(F.col(a), F.col(b)), k)
    return g.withColumns({"campaign_key": surrogate_key(F.date_format("call_month", "yyyy-MM-dd"), F.col("campaign")), "connect_rate": share("connects", "dials"), "qualification_rate": share("qualified_leads", "connects"), "conversion_rate": share("conversions", "qualified_leads"), "cost_per_acquisition": rate("campaign_spend", "conversions", 2), "roas": rate("revenue", "campaign_spend", 2), "revenue_per_connect": rate("revenue", "connects", 2)})


def latest(df: DataFrame, month: str = "call_month") -> DataFrame:
    """Rows of the last month, by a one-row join."""
    last = df.agg(F.max(month).alias("_m"))
    return df.join(F.broadcast(last), F.col(month) == F.col("_m"), "left_semi")


def trailing(df: DataFrame, months: int, month: str = "call_month") -> DataFrame:
    last = df.agg(F.add_months(F.max(month), 1 - months).alias("_m"))
    return df.crossJoin(F.broadcast(last)).where(F.col(month) >= F.col("_m")).drop("_m")


def with_dim(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Facts with a dimension's columns; Spark broadcasts the dimension if it is small."""
    return facts.join(dim, key, "left")


def summary(funnel: DataFrame) -> DataFrame:
    last = latest(funnel)
    return last.agg(*[F.sum(m).alias(m) for m in MEASURES], F.sum("revenue").alias("revenue"), F.sum("campaign_spend").alias("campaign_spend")).withColumn("connect_rate", ratio(F.col("connects"), F.col("dials"))).withColumn("close_rate", ratio(F.col("conversions"), F.col("connects"))).withColumn("roas", ratio(F.col("revenue"), F.col("campaign_spend")))


def trends(funnel: DataFrame, months: int = 12) -> DataFrame:
    """(call_month, dials, connects, conversions, connect_rate, close_rate) of the last months."""
    g = trailing(funnel, months).groupBy("call_month").agg(*[F.sum(m).alias(m) for m in ("dials", "connects", "conversions")])
    return g.withColumn("connect_rate", ratio(F.col("connects"), F.col("dials"))).withColumn("close_rate", ratio(F.col("conversions"), F.col("connects")))


def health(funnel: DataFrame) -> DataFrame:
    """(months, first_month, last_month, broken_rows): what the mart covers, and rows that break the funnel."""
    broken = F.coalesce((F.col("connects") > F.col("dials")) | (F.col("qualified_leads") > F.col("connects")) | (F.col("conversions") > F.col("qualified_leads")), F.lit(False))
    months = funnel.groupBy("call_month").agg(F.count_if(broken).alias("b"))
    return months.agg(F.count(F.lit(1)).alias("months"), F.min("call_month").alias("first_month"), F.max("call_month").alias("last_month"), F.coalesce(F.sum("b"), F.lit(0)).alias("broken_rows"))


def funnel_is_monotonic(stg: DataFrame) -> DataFrame:
    """Rows that break the funnel; a sound table has none."""
    return stg.where((F.col("connects") > F.col("dials")) | (F.col("qualified_leads") > F.col("connects")) | (F.col("conversions") > F.col("qualified_leads")))


# The rows of the two dimensions.
POOLS = (("Pool A", "Primary outbound DID pool"), ("Pool B", "Secondary outbound DID pool"), ("Pool C", "Overflow outbound DID pool"), ("Pool D", "Regional outbound DID pool"))
CAMPAIGNS = (
    ("Lending - Personal Loans", "Lending", "Personal loan disbursal", 5200),
    ("Broking - Account Activation", "Broking", "Demat account activation", 1450),
    ("Insurance - Policy Renewals", "Insurance", "Policy renewal", 3100),
    ("EdTech - Admissions", "EdTech", "Admissions counselling", 6400),
    ("E-commerce - Order Confirmation", "E-commerce", "Order confirmation", 850),
)


def seeds(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The campaign and caller-pool dimensions."""
    return spark.createDataFrame(CAMPAIGNS, "campaign string, business_line string, offering string, avg_ticket_inr int"), spark.createDataFrame(POOLS, "caller_id_pool string, pool_description string")
