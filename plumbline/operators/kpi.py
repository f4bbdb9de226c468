"""KPI definitions as mergeable aggregates, and the scorecard they make in one grouped pass.

A definition turns roles (role -> column) into aggregate columns; the same ones serve cards, series, segments and
root cause. KPIs that need an entity level first (repeat rate, concentration) are functions of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import series as S
from plumbline.functions.columns import col, period, ratio, truthy, zero_sum

Roles = dict[str, str]
GRAINS = ("day", "week", "month", "quarter", "year")
# Cycles looked for in a series of a grain.
CYCLES = {"day": (7, 30), "week": (4, 13, 52), "month": (12, 4)}


@dataclass(frozen=True)
class Kpi:
    """id, the roles it needs, how to aggregate, and whether more is better and segments add up."""

    id: str
    requires: tuple[str, ...]
    build: Callable[[Roles], Column]
    higher_is_better: bool = True
    additive: bool = False
    domains: tuple[str, ...] = ()
    priority: int = 50


REGISTRY: dict[str, Kpi] = {}


def register(kpi: Kpi) -> Kpi:
    """Later definitions of an id replace earlier ones."""
    REGISTRY[kpi.id] = kpi
    return kpi


def from_sql(id: str, expression: str, higher_is_better: bool = True, additive: bool = False, domains: tuple[str, ...] = (), priority: int = 50) -> Kpi:
    """A definition from an aggregate in SQL with roles in braces, as plugins write them: sum({revenue}) / count(DISTINCT {order_id}).

    The roles it names are those it needs; each becomes the bound column's quoted name, and the rest is Spark SQL. Registered like any other.
    """
    needs = tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", expression)))

    def build(roles: Roles) -> Column:
        return F.expr(re.sub(r"\{(\w+)\}", lambda m: "`" + roles[m[1]].replace("`", "``") + "`", expression))

    return register(Kpi(id, needs, build, higher_is_better, additive, domains, priority))


def _sum(role: str) -> Callable[[Roles], Column]:
    return lambda r: zero_sum(col(r[role]))


def _mean(role: str) -> Callable[[Roles], Column]:
    return lambda r: F.avg(col(r[role]))


def _distinct(role: str) -> Callable[[Roles], Column]:
    return lambda r: F.count_distinct(col(r[role]))


def _ratio(top: str, bottom: str, scale: float = 1.0) -> Callable[[Roles], Column]:
    return lambda r: ratio(F.sum(col(r[top])), F.sum(col(r[bottom])), scale)


def _per(top: str, entity: str) -> Callable[[Roles], Column]:
    return lambda r: ratio(F.sum(col(r[top])), F.count_distinct(col(r[entity])))


def _flag(role: str) -> Callable[[Roles], Column]:
    return lambda r: F.avg(truthy(r[role]).cast("double")) * 100


def _orders(r: Roles) -> Column:
    return F.count_distinct(col(r["order_id"])) if "order_id" in r else F.count(F.lit(1))


def _discount(r: Roles) -> Column:
    d = col(r["discount"])
    return F.when(F.max(d) <= 1.5, F.avg(d) * 100).otherwise(ratio(F.sum(d), F.sum(col(r["revenue"])) + F.sum(d), 100))


def _margin(r: Roles) -> Column:
    profit = F.sum(col(r["profit"])) if "profit" in r else F.sum(col(r["revenue"]) - col(r["cost"]))
    return ratio(profit, F.sum(col(r["revenue"])), 100)


for _id, _role in (("revenue", "revenue"), ("units_sold", "quantity"), ("gross_profit", "profit"), ("impressions", "impressions"), ("clicks", "clicks"), ("marketing_spend", "marketing_spend"), ("output_units", "output"), ("downtime", "downtime")):
    register(Kpi(_id, (_role,), _sum(_role), _id not in ("marketing_spend", "downtime"), True))
for _id, _role in (("average_spend", "revenue"), ("average_salary", "salary"), ("average_tenure", "tenure"), ("avg_length_of_stay", "length_of_stay"), ("satisfaction", "satisfaction"), ("average_downtime", "downtime")):
    register(Kpi(_id, (_role,), _mean(_role), _id not in ("avg_length_of_stay", "average_downtime")))
for _id, _role in (("customers", "customer_id"), ("headcount", "employee_id"), ("merchant_reach", "merchant_id"), ("patients_treated", "customer_id")):
    register(Kpi(_id, (_role,), _distinct(_role)))
for _id, _role in (("fraud_rate", "fraud_flag"), ("churn_rate", "churn_flag"), ("return_rate", "return_flag"), ("attrition_rate", "churn_flag"), ("readmission_rate", "readmission_flag"), ("defect_rate", "defect_flag")):
    register(Kpi(_id, (_role,), _flag(_role), False))
for _id, _top, _bottom, _scale in (("ctr", "clicks", "impressions", 100), ("conversion_rate", "conversions", "clicks", 100), ("cpa", "marketing_spend", "conversions", 1), ("cpc", "marketing_spend", "clicks", 1), ("cpm", "marketing_spend", "impressions", 1000), ("roas", "revenue", "marketing_spend", 1)):
    register(Kpi(_id, (_top, _bottom), _ratio(_top, _bottom, _scale), not _id.startswith("cp")))
for _id, _top, _entity in (("revenue_per_customer", "revenue", "customer_id"), ("revenue_per_employee", "revenue", "employee_id"), ("spend_per_cardholder", "revenue", "customer_id"), ("revenue_per_account", "revenue", "customer_id")):
    register(Kpi(_id, (_top, _entity), _per(_top, _entity)))
register(Kpi("orders", (), _orders, additive=True))
register(Kpi("record_count", (), lambda r: F.count(F.lit(1)), additive=True))
register(Kpi("transaction_volume", (), lambda r: F.count(F.lit(1)), additive=True))
register(Kpi("aov", ("revenue",), lambda r: ratio(F.sum(col(r["revenue"])), _orders(r))))
register(Kpi("gross_margin_pct", ("revenue",), _margin))
register(Kpi("discount_depth", ("discount", "revenue"), _discount, False))
register(Kpi("purchase_frequency", ("customer_id",), lambda r: ratio(_orders(r), F.count_distinct(col(r["customer_id"])))))
register(Kpi("clv", ("revenue", "customer_id"), lambda r: ratio(F.sum(col(r["revenue"])), F.count_distinct(col(r["customer_id"])), 3)))
register(Kpi("fraud_value_rate", ("revenue", "fraud_flag"), lambda r: ratio(F.sum(F.when(truthy(r["fraud_flag"], "fraud_value"), col(r["revenue"])).otherwise(0)), F.sum(col(r["revenue"])), 100), False))


# How far up a domain's scorecard a definition stands (the smallest first), and the domains it is shown in.
PLACES = """
revenue 1 sales ecommerce finance banking marketing saas generic
orders 5 sales ecommerce banking generic
transaction_volume 4 banking
units_sold 12 sales ecommerce manufacturing
aov 6 sales ecommerce banking
gross_profit 3 sales finance ecommerce
customers 8 sales ecommerce banking saas
purchase_frequency 14 sales ecommerce banking
clv 15 sales ecommerce saas banking
impressions 4 marketing
clicks 5 marketing
ctr 2 marketing
conversion_rate 3 marketing ecommerce
marketing_spend 6 marketing
cpa 7 marketing
cpc 11 marketing
cpm 13 marketing
roas 1 marketing
average_spend 6 banking finance
fraud_value_rate 3 banking
churn_rate 4 saas banking ecommerce sales
revenue_per_employee 8 hr finance
avg_length_of_stay 2 healthcare
output_units 1 manufacturing
downtime 3 manufacturing
satisfaction 25 sales ecommerce saas healthcare generic
record_count 90 generic
fraud_rate 14 banking
spend_per_cardholder 22 banking
merchant_reach 34 banking
return_rate 26 ecommerce
discount_depth 28 ecommerce
revenue_per_customer 20 ecommerce
cost_per_click 24 marketing
click_to_conversion 18 marketing
gross_margin_pct 12 sales
revenue_per_account 21 sales
readmission_rate 12 healthcare
average_length_of_stay 18 healthcare
patients_treated 26 healthcare
attrition_rate 12 hr
headcount 16 hr
average_tenure 24 hr
average_salary 30 hr
defect_rate 12 manufacturing
total_output 14 manufacturing
average_downtime 20 manufacturing
"""
# The definitions an executive looks at first.
NORTH_STARS = ("revenue", "roas")
for _id, _like in (("cost_per_click", "cpc"), ("click_to_conversion", "conversion_rate"), ("average_length_of_stay", "avg_length_of_stay"), ("total_output", "output_units")):
    register(replace(REGISTRY[_like], id=_id))
for _id, _place, *_domains in (x.split() for x in PLACES.split("\n") if x):
    register(replace(REGISTRY[_id], domains=tuple(_domains), priority=int(_place)))


def for_domain(domain: str, roles: Roles, limit: int = 12) -> list[Kpi]:
    """The domain's definitions that can be computed; with fewer than three of them all others that can be follow, `limit` at most."""
    order = lambda some: sorted(some, key=lambda k: (k.priority, k.id))
    own = [k for k in available(roles) if domain in k.domains]
    if len(own) >= 3:
        return order(own)
    rest = [k for k in available(roles) if k not in own and k.id != "record_count"]
    return (own + order(rest) or [REGISTRY["record_count"]])[:limit]


def primary(kpis: list[Kpi]) -> Kpi | None:
    """A north star if there is one, else the first."""
    return next((k for k in kpis if k.id in NORTH_STARS), kpis[0] if kpis else None)


def available(roles: Roles, ids: list[str] | None = None) -> list[Kpi]:
    """Definitions whose roles are bound; `gross_margin_pct` needs profit or cost besides."""
    some = [REGISTRY[i] for i in ids] if ids else list(REGISTRY.values())
    return [k for k in some if all(x in roles for x in k.requires) and (k.id != "gross_margin_pct" or {"profit", "cost"} & set(roles))]


def aggregate(df: DataFrame, roles: Roles, ids: list[str] | None = None, by: list[Column] | None = None) -> DataFrame:
    """All KPIs of the groups `by`, in one aggregation."""
    return df.groupBy(*(by or [])).agg(*[k.build(roles).alias(k.id) for k in available(roles, ids)])


def choose_grain(df: DataFrame, date: str, periods: int = 4, rows: int = 3) -> str:
    """The finest grain with enough periods and rows in each on average; one aggregation for all grains."""
    r = df.agg(F.count(date).alias("n"), *[F.count_distinct(period(date, g)).alias(g) for g in GRAINS]).first()
    return next((g for g in GRAINS if r[g] >= periods and r["n"] / max(r[g], 1) >= rows), next((g for g in GRAINS if r[g] >= 2), "day"))


def grain_for_span(df: DataFrame, date: str, target: int = 26) -> str:
    """The finest grain that cuts the covered span into at most 1.6 times `target` periods."""
    r = df.agg(F.datediff(F.max(date), F.min(date)).alias("d")).first()
    days = {"day": 1, "week": 7, "month": 30.44, "quarter": 91.3, "year": 365.25}
    return next((g for g, n in days.items() if (r["d"] or 0) / n <= 1.6 * target), "year")


def series(df: DataFrame, date: str, grain: str, roles: Roles, ids: list[str] | None = None) -> DataFrame:
    """(period, one column for each KPI)."""
    return aggregate(df.where(F.col(date).isNotNull()), roles, ids, [period(date, grain).alias("period")])


def long_series(wide: DataFrame) -> DataFrame:
    """(kpi_id, period, value)."""
    return wide.unpivot(["period"], [c for c in wide.columns if c != "period"], "kpi_id", "value") if len(set(dict(wide.dtypes).values())) <= 2 else wide.select("period", *[F.col(c).cast("double") for c in wide.columns if c != "period"]).unpivot(["period"], [c for c in wide.columns if c != "period"], "kpi_id", "value")


def scorecard(df: DataFrame, date: str, grain: str, roles: Roles, ids: list[str] | None = None, profile: str = "core") -> DataFrame:
    """(kpi_id, period, value, previous, delta, delta_pct, direction, favourable): every period against the one before.

    A change below 0.5 % is flat in the core profile, one below 1e-9 in the SQL profile; a flat one is neither favourable
    nor not.
    """
    wide = series(df, date, grain, roles, ids)
    kpis = [c for c in wide.columns if c != "period"]
    tall = wide.select("period", *[F.col(c).cast("double").alias(c) for c in kpis]).unpivot(["period"], kpis, "kpi_id", "value")
    w = Window.partitionBy("kpi_id").orderBy("period")
    out = tall.withColumn("previous", F.lag("value").over(w)).withColumn("delta", F.col("value") - F.col("previous"))
    out = out.withColumn("delta_pct", ratio(F.col("delta"), F.abs("previous"), 100))
    flat = F.abs("delta") < 1e-9 if profile == "sql" else F.coalesce(F.abs("delta_pct"), F.lit(0.0)) < 0.5
    out = out.withColumn("direction", F.when(flat, "flat").when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("flat"))
    better = F.col("kpi_id").isin(*[k for k in kpis if REGISTRY[k].higher_is_better])
    return out.withColumn("favourable", F.when(F.col("direction") != "flat", (F.col("direction") == "up") == better))


def cards(rows: list[dict], grain: str, last: int = 24) -> list[dict]:
    """One card for each KPI from the collected rows of a scorecard: its latest row, a sparkline, the trend from four values on, a season."""
    out = []
    for k in dict.fromkeys(r["kpi_id"] for r in rows):
        own = sorted((r for r in rows if r["kpi_id"] == k), key=lambda r: str(r["period"]))
        y = [r["value"] for r in own if r["value"] is not None]
        cycle, strength = S.season(y, CYCLES.get(grain, (7, 12)))
        out.append({**own[-1], "higher_is_better": REGISTRY[k].higher_is_better, "additive": REGISTRY[k].additive, "sparkline": y[-last:], "trend": S.mann_kendall(y) if len(y) >= 4 else None, "cycle": cycle, "strength": strength})
    return out


def by_entity(df: DataFrame, entity: str, value: str | None = None, order: str | None = None, by: list[str] | None = None) -> DataFrame:
    """First level of two-level KPIs: (by..., entity, total, orders)."""
    return df.groupBy(*(by or []), F.col(entity).alias("entity")).agg(*([F.sum(value).alias("total")] if value else []), *([F.count_distinct(order).alias("orders")] if order else []), F.count(F.lit(1)).alias("rows"))


def repeat_rate(df: DataFrame, customer: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Share of customers with more than one order, in percent."""
    return by_entity(df.where(F.col(customer).isNotNull()), customer, None, order, by).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("customers"), (F.avg((F.col("orders") > 1).cast("double")) * 100).alias("repeat_rate"))


def top_share(df: DataFrame, entity: str, value: str, k: int | None = None, decile: bool = False) -> DataFrame:
    """Share of the k largest entities (or the top tenth, one at least) in the total.

    The cut-off comes from a take-ordered over the totals, not from a window over all entities in one task.
    """
    totals = by_entity(df, entity, value)
    n = k if not decile else max(1, totals.count() // 10)
    top = totals.orderBy(F.desc("total"), "entity").limit(n).agg(F.sum("total").alias("top"))
    return totals.agg(F.sum("total").alias("whole"), F.count(F.lit(1)).alias("entities")).crossJoin(F.broadcast(top)).select("entities", ratio(F.col("top"), F.col("whole"), 100).alias("share"))


def concentration(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Herfindahl-Hirschman index times 10,000: the sum of squared shares."""
    return by_entity(df, entity, value).agg(ratio(F.sum(F.col("total") * F.col("total")), F.sum("total") * F.sum("total"), 10_000).alias("hhi"))
