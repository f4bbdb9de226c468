"""Demo tables with a planted cause, drawn by Spark from row numbers by inverse distributions, so they can be of any size.

Every value is a function of the row's number and a seed: tables repeat exactly, whatever the partitions. The planted level's measure changes in the last
month only. Some values are missing and some rows repeat, as in real extracts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Draw = Callable[[int], Column]


def _uniform(seed: int) -> Draw:
    """Numbers strictly between 0 and 1, one stream for each k."""
    return lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def _choice(u: Column, levels: tuple[str, ...], weights: tuple[float, ...] = ()) -> Column:
    """A level by its share: the first whose cumulative weight passes u."""
    weights = weights or (1.0,) * len(levels)
    out, run = F.lit(levels[-1]), sum(weights)
    for level, w in reversed(list(zip(levels, weights))[:-1]):
        run -= weights[levels.index(level) + 1]
        out = F.when(u < run / sum(weights), level).otherwise(out)
    return out


def _normal(u: Draw, k: int) -> Column:
    return F.sqrt(-2 * F.log(u(k))) * F.cos(2 * math.pi * u(k + 500))


def _lognormal(u: Draw, k: int, median: float, spread: float) -> Column:
    return F.exp(math.log(median) + spread * _normal(u, k))


def _exponential(u: Draw, k: int, mean: float) -> Column:
    return -mean * F.log(u(k))


def _count(x: Column) -> Column:
    return F.greatest(F.lit(0), F.round(x)).cast("int")


def _key(prefix: str, x: Column, width: int = 7) -> Column:
    return F.concat(F.lit(prefix), F.lpad(x.cast("string"), width, "0"))


def _bucket(u: Column, n: int) -> Column:
    return F.floor(u * n).cast("long")


def _banking(u: Draw, f: Column, rows: int) -> dict[str, Column]:
    segment = {"Premium": 140.0, "Business": 210.0, "Standard": 60.0, "Student": 25.0}
    middle = F.lit(60.0)
    for name, value in segment.items():
        middle = F.when(F.col("customer_segment") == name, value).otherwise(middle)
    amount = F.round(middle * F.exp(0.35 * _normal(u, 1)) * f, 2)
    return {"transaction_id": _key("T", F.col("id"), 9), "customer_id": _key("C", _bucket(u(2), max(10, rows // 25))), "channel": _choice(u(3), ("Online", "Branch", "ATM", "Mobile", "Phone"), (4, 1, 2, 4, 1)), "merchant_category": _choice(u(4), ("Grocery", "Fuel", "Travel", "Dining", "Health", "Fashion", "Electronics", "Utilities", "Other")), "card_type": _choice(u(5), ("Debit", "Credit", "Prepaid", "Virtual"), (5, 4, 1, 1)), "customer_tenure": _choice(u(6), ("<1y", "1-3y", "3-5y", "5-10y", "10y+")), "transaction_amount": amount, "interchange_revenue": F.round(amount * 0.012, 4), "is_fraud": u(7) < F.when(F.col("channel") == "Online", 0.012).otherwise(0.003), "is_declined": u(8) < 0.02, "merchant_id": _key("M", _bucket(u(9), max(10, rows // 100)), 5), "acquirer": _choice(u(10), ("Acquirer A", "Acquirer B", "Acquirer C"))}


def _ecommerce(u: Draw, f: Column, rows: int) -> dict[str, Column]:
    n, price, discount = _count(1 + _exponential(u, 1, 0.9)), F.round(_lognormal(u, 2, 35, 0.4), 2), F.round(0.3 * u(3) * u(4), 3)
    revenue = F.round(F.greatest(F.lit(1), n) * price * (1 - discount) * f, 2)
    cost = F.round(revenue * (0.52 + 0.08 * u(5)), 2)
    shipping = F.round(3 + 4 * u(6), 2)
    return {"order_id": _key("O", F.col("id"), 9), "customer_id": _key("C", _bucket(u(7), max(10, rows // 12))), "marketing_channel": _choice(u(8), ("Organic", "Paid search", "Email", "Social", "Affiliate", "Direct")), "product_category": _choice(u(9), ("Apparel", "Home", "Beauty", "Sports", "Toys", "Books")), "quantity": F.greatest(F.lit(1), n), "unit_price": price, "discount_rate": discount, "revenue": revenue, "cost_of_goods": cost, "shipping_cost": shipping, "profit": F.round(revenue - cost - shipping, 2), "is_returned": u(10) < 0.06}


def _marketing(u: Draw, f: Column, rows: int) -> dict[str, Column]:
    spend = F.round(_lognormal(u, 1, 400, 0.3), 2)
    impressions = _count(spend * (90 + 40 * u(2)))
    clicks = _count(impressions * (0.012 + 0.01 * u(3)))
    conversions = _count(clicks * (0.03 + 0.02 * u(4)) * f)
    return {"campaign_id": _key("K", _bucket(u(5), 40), 3), "objective": _choice(u(6), ("Awareness", "Traffic", "Leads", "Sales")), "region": _choice(u(7), ("North", "South", "East", "West")), "marketing_spend": spend, "impressions": impressions, "clicks": clicks, "conversions": conversions, "revenue": F.round(conversions * (45 + 20 * u(8)), 2)}


def _retail(u: Draw, f: Column, rows: int) -> dict[str, Column]:
    n, price, discount = _count(1 + _exponential(u, 1, 1.5)), F.round(_lognormal(u, 2, 18, 0.4), 2), F.round(0.2 * u(3), 3)
    revenue = F.round(F.greatest(F.lit(1), n) * price * (1 - discount), 2)
    return {"order_id": _key("R", F.floor(F.col("id") / 3), 8), "customer_id": _key("C", _bucket(u(4), max(10, rows // 15))), "quantity": F.greatest(F.lit(1), n), "unit_price": price, "discount_rate": discount, "revenue": revenue, "gross_profit": F.round(revenue * (0.34 + 0.06 * u(5)) * f, 2), "cost_of_goods": F.round(revenue - revenue * (0.34 + 0.06 * u(5)) * f, 2), "return_flag": (u(6) < 0.05).cast("int")}


def _healthcare(u: Draw, f: Column, rows: int) -> dict[str, Column]:
    stay = F.round(1 + _exponential(u, 1, 3.2), 1)
    return {"encounter_id": _key("E", F.col("id"), 8), "patient_id": _key("P", _bucket(u(2), max(10, rows // 3))), "length_of_stay": stay, "readmission_flag": (u(3) < 0.1 * f).cast("int"), "treatment_cost": F.round(900 + 640 * stay * F.exp(0.2 * _normal(u, 4)), 2), "satisfaction_score": F.round(F.least(F.lit(10.0), F.greatest(F.lit(1.0), 7.8 + 1.1 * _normal(u, 5))), 1), "staffed_beds": (180 + _bucket(u(6), 60)).cast("int")}


def _hr(u: Draw, f: Column, rows: int) -> dict[str, Column]:
    return {"employee_id": _key("S", _bucket(u(1), max(10, rows // 15)), 5), "tenure_years": F.round(_exponential(u, 2, 4.5), 1), "salary": F.round(_lognormal(u, 3, 52_000, 0.25), -2), "engagement_score": F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 68 + 12 * _normal(u, 4))), 1), "training_hours": F.round(_exponential(u, 5, 6), 1), "churn_flag": (u(6) < 0.1 * f).cast("int"), "headcount": F.lit(1)}


def _manufacturing(u: Draw, f: Column, rows: int) -> dict[str, Column]:
    planned = _count(480 + 60 * _normal(u, 1))
    return {"batch_id": _key("B", F.col("id"), 7), "region": _choice(u(2), ("Plant A", "Plant B", "Plant C")), "planned_units": planned, "downtime_minutes": F.round(F.greatest(F.lit(1.0), 38 + 7 * _normal(u, 3)) * f, 1), "output_units": _count(planned * (0.9 + 0.08 * u(4))), "scrap_rate": F.round(0.01 + 0.03 * u(5), 4), "defect_flag": (u(6) < 0.04).cast("int"), "unit_cost": F.round(11 + 2 * u(7), 2)}


def _telesales(u: Draw, f: Column, rows: int) -> dict[str, Column]:
    dials = _count(110 + 20 * u(1))
    connects = _count(dials * (0.42 + 0.06 * u(2)) * f)
    leads = _count(connects * (0.3 + 0.1 * u(3)))
    conversions = _count(leads * (0.25 + 0.1 * u(4)))
    return {"call_block_id": _key("L", F.col("id"), 8), "region": _choice(u(5), ("North", "South", "East", "West", "Central")), "lead_source": _choice(u(6), ("Web", "Referral", "List", "Partner")), "dials": dials, "connects": connects, "qualified_leads": leads, "conversions": conversions, "talk_time_minutes": F.round(connects * (1.5 + u(7)), 2), "qa_score": F.round(60 + 40 * u(8), 1), "campaign_spend": F.round(40 + 20 * u(9), 2), "revenue": F.round(conversions * (260 + 80 * u(10)), 2)}


#: kind: column of time, dimensions with their levels, the measure, what is planted (dimension, level, factor in the last month), the other columns,
#: a column with missing values and their share, the share of rows that repeat.
KINDS: dict[str, dict] = {
    "banking": {"time": "transaction_date", "dims": {"region": ("North", "South", "East", "West", "Central"), "customer_segment": ("Premium", "Standard", "Student", "Business")}, "measure": "transaction_amount", "planted": ("region", "East", 0.45), "columns": _banking, "nulls": ("merchant_category", 0.012), "repeats": 0.004},
    "ecommerce": {"time": "order_date", "dims": {"customer_type": ("New", "Returning"), "country": ("DE", "FR", "UK", "US", "ES", "IT"), "device": ("mobile", "desktop", "tablet")}, "measure": "revenue", "planted": ("customer_type", "Returning", 0.5), "columns": _ecommerce, "nulls": ("device", 0.008)},
    "marketing": {"time": "date", "dims": {"platform": ("Meta", "Search", "Video", "Display", "Email"), "audience": ("A", "B", "C", "D", "E"), "creative": ("c1", "c2", "c3", "c4", "c5", "c6")}, "measure": "revenue", "planted": ("platform", "Meta", 0.4), "columns": _marketing},
    "retail": {"time": "order_date", "dims": {"category": ("Home", "Food", "Garden", "Toys"), "region": ("N", "S", "E", "W"), "channel": ("store", "web", "app")}, "measure": "gross_profit", "planted": ("category", "Home", 0.4), "columns": _retail},
    "healthcare": {"time": "admission_date", "dims": {"department": ("Cardiology", "Surgery", "Oncology", "General"), "payer": ("p1", "p2", "p3", "p4"), "region": ("a", "b", "c")}, "measure": "readmission_flag", "planted": ("department", "Cardiology", 2.2), "columns": _healthcare},
    "hr": {"time": "period", "dims": {"department": ("Engineering", "Sales", "Support", "Finance", "Legal"), "level": ("L1", "L2", "L3", "L4"), "region": ("a", "b", "c")}, "measure": "churn_flag", "planted": ("department", "Engineering", 2.5), "columns": _hr},
    "manufacturing": {"time": "production_date", "dims": {"line": ("Line 1", "Line 2", "Line 3", "Line 4"), "shift": ("day", "night"), "supplier": ("s1", "s2", "s3")}, "measure": "downtime_minutes", "planted": ("line", "Line 3", 2.4), "columns": _manufacturing},
    "telesales": {"time": "call_date", "dims": {"caller_id_pool": ("Pool A", "Pool B", "Pool C", "Pool D"), "campaign": ("Lending - Personal Loans", "Broking - Account Activation", "Insurance - Policy Renewals", "EdTech - Admissions", "E-commerce - Order Confirmation"), "agent_type": ("human", "bot")}, "measure": "connects", "planted": ("caller_id_pool", "Pool C", 0.35), "columns": _telesales},
}


def generate(spark: SparkSession, kind: str, rows: int = 20_000, months: int = 18, seed: int = 7) -> DataFrame:
    """A table of `kind` over so many months of thirty days from 2023 on; call blocks are dated by the month's last day."""
    spec, u, days = KINDS[kind], _uniform(seed), months * 30
    df = spark.range(rows).withColumn("_day", _bucket(u(900), days).cast("int")).withColumn(spec["time"], F.date_add(F.lit("2023-01-01").cast("date"), F.col("_day")).cast("timestamp"))
    for i, (c, levels) in enumerate(spec["dims"].items()):
        df = df.withColumn(c, _choice(u(800 + i), levels))
    dim, level, factor = spec["planted"]
    change = F.when((F.col(dim) == level) & (F.col("_day") >= days - 30), factor).otherwise(1.0)
    made = spec["columns"](u, change, rows)
    for name, column in made.items():  # later ones may read earlier ones
        df = df.withColumn(name, column)
    if "nulls" in spec:
        name, share = spec["nulls"]
        df = df.withColumn(name, F.when(u(950) >= share, F.col(name)))
    if kind == "telesales":
        df = df.withColumn(spec["time"], F.last_day(spec["time"]).cast("timestamp"))
    if "repeats" in spec:
        df = df.unionAll(df.where(u(960) < spec["repeats"]))
    first = [c for c in made if c.endswith("_id")][:1]
    return df.select(spec["time"], *first, *spec["dims"], *[c for c in made if c not in first])
