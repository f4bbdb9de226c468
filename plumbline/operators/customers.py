"""Recency, frequency and value of customers; cohorts, retention, lifetime value and concentration."""

from __future__ import annotations

from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import calendar_index, elapsed_days, ratio
from plumbline.operators import ordered


def activity(df: DataFrame, customer: str, date: str, value: Column, order: str | None = None) -> DataFrame:
    """(customer, first_at, last_at, frequency, monetary): orders are distinct ids if given, else rows."""
    n = F.count_distinct(order) if order else F.count(F.lit(1))
    return df.where(F.col(customer).isNotNull()).groupBy(F.col(customer).alias("customer")).agg(F.min(date).alias("first_at"), F.max(date).alias("last_at"), n.alias("frequency"), F.sum(value).alias("monetary"))


def ranks(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """Adds `<column>_rank` for each column -> downwards: the average percentile rank, from distinct values.

    Distinct values with their counts are far fewer than customers for recency and frequency; ranks come from a
    running count over them, and customers join on the value.
    """
    total, out = df.agg(F.count(F.lit(1)).alias("_total")), df
    for column, down in columns.items():
        values = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        places = ordered.running(values, column, "_n", down=down).crossJoin(F.broadcast(total))
        out = out.join(places.select(column, ((F.col("_before") + (F.col("_n") + 1) / 2) / F.col("_total")).alias(f"{column}_rank")), column)
    return out


def ranked(df: DataFrame, column: str, down: bool = False) -> DataFrame:
    return ranks(df, {column: down})


def _band(rank: str, bins: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.round(F.col(rank) * bins, 9)))).cast("long")


def rfm(df: DataFrame, customer: str, date: str, value: Column, as_of: str | None = None, bins: int = 5) -> DataFrame:
    """(customer, recency, frequency, monetary, r, f, m, segment): scores from average percentile ranks.

    Without `as_of`, days count from the day after the last activity.
    """
    a = activity(df, customer, date, value)
    end = F.lit(as_of).cast("timestamp_ntz") if as_of else None
    if end is None:
        last = a.agg((F.max("last_at") + F.expr("interval 1 day")).alias("_end"))
        a, end = a.crossJoin(F.broadcast(last)), F.col("_end")
    a = a.withColumn("recency", elapsed_days(end, F.col("last_at")))
    out = ranks(a, {"recency": True, "frequency": False, "monetary": False})
    out = out.select("customer", "recency", "frequency", "monetary", _band("recency_rank", bins).alias("r"), _band("frequency_rank", bins).alias("f"), _band("monetary_rank", bins).alias("m"))
    return out.withColumn("segment", rfm_segment(bins))


def rfm_segment(bins: int = 5) -> Column:
    """One label for each customer. The grid below is fixed: labels and limits in order, the first that holds wins."""
    r, f, m, hi, mid = F.col("r"), F.col("f"), F.col("m"), bins - 1, (bins + 1) / 2
    grid = (
        ("Champions", (r >= hi) & (f >= hi)),
        ("Loyal customers", (r >= mid) & (f >= hi)),
        ("Cannot lose them", (r <= 2) & (f >= hi) & (m >= hi)),
        ("Potential loyalists", (r >= hi) & (f >= mid)),
        ("New customers", (r >= hi) & (f <= 2)),
        ("Promising", (r >= mid) & (f <= 2)),
        ("Needs attention", r >= mid),
        ("At risk", f >= mid),
        ("Lost", (r <= 1) & (f <= 1)),
    )
    out = F
    for name, holds in grid:
        out = out.when(holds, F.lit(name))
    return out.otherwise("Hibernating")


def rfm_summary(scored: DataFrame) -> DataFrame:
    """(segment, customers, value, customer_share, value_share, median_recency, median_frequency, median_monetary)."""
    total = scored.agg(F.count(F.lit(1)).alias("_c"), F.sum("monetary").alias("_v"))
    g = scored.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("value"), F.median("recency").alias("median_recency"), F.median("frequency").alias("median_frequency"), F.median("monetary").alias("median_monetary"))
    return g.crossJoin(F.broadcast(total)).select("segment", "customers", "value", ratio(F.col("customers"), F.col("_c"), 100).alias("customer_share"), ratio(F.col("value"), F.col("_v"), 100).alias("value_share"), "median_recency", "median_frequency", "median_monetary")


def rfm_percent_rank(df: DataFrame, customer: str, date: str, value: Column, order: str) -> DataFrame:
    """(customer, r, f, m, segment) by percent_rank; the largest value falls into band 6, as in the SQL profile."""
    a = activity(df, customer, date, value, order)
    last = a.agg(F.max("last_at").alias("_end"))
    a = a.crossJoin(F.broadcast(last)).withColumn("recency", F.datediff("_end", "last_at"))
    total, out = a.agg(F.count(F.lit(1)).alias("_total")), a
    for name, c, down in (("r", "recency", True), ("f", "frequency", False), ("m", "monetary", False)):
        places = ordered.running(a.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), c, "_n", down=down).crossJoin(F.broadcast(total))
        share = F.when(F.col("_total") > 1, F.col("_before") / (F.col("_total") - 1)).otherwise(0.0)
        out = out.join(places.select(F.col(c).alias("_v"), (F.floor(share * 5) + 1).cast("long").alias(name)), F.col(c).eqNullSafe(F.col("_v"))).drop("_v")
    out = out.select("customer", "r", "f", "m")
    r, f, m = F.col("r"), F.col("f"), F.col("m")
    label = F
    for name, holds in (("Champions", (r >= 4) & (f >= 4) & (m >= 4)), ("Loyal", (r >= 3) & (f >= 3)), ("New / promising", (r >= 4) & (f <= 2)), ("Big spenders", (r >= 3) & (m >= 4)), ("At risk", (r == 2) & (f >= 3)), ("Cooling", r == 2), ("Lost high value", (r == 1) & (m >= 4))):
        label = label.when(holds, F.lit(name))
    return out.withColumn("segment", label.otherwise("Dormant"))


# Labels of the ntile profile and the scores they stand for, the first that holds wins.
NTILE_SEGMENTS = (
    ("champion", lambda r, f, m: (r >= 4) & (f >= 4)),
    ("new", lambda r, f, m: (r >= 4) & (f <= 2)),
    ("at risk", lambda r, f, m: (r <= 2) & (f >= 4)),
    ("lapsed", lambda r, f, m: (r <= 2) & (f <= 2)),
)


def rfm_ntile(df: DataFrame, customer: str, date: str, value: Column) -> DataFrame:
    """(customer, r, f, m, segment) by ntile(5), ties in order of customer; the first rows of each order get the larger bands."""
    a = activity(df, customer, date, value)
    wide = a.select("customer").crossJoin(F.broadcast(a.agg(F.count(F.lit(1)).alias("_total"))))
    for name, c in (("r", "last_at"), ("f", "frequency"), ("m", "monetary")):
        wide = wide.join(ordered.numbered(a.select("customer", c), c, "customer").select("customer", F.col("_place").alias(f"_{name}")), "customer")
    small, extra = F.floor(F.col("_total") / 5), F.col("_total") % 5

    def tile(place: Column) -> Column:
        long = extra * (small + 1)
        return (F.when(place <= long, F.floor((place - 1) / (small + 1))).otherwise(extra + F.floor((place - 1 - long) / F.greatest(small, F.lit(1)))) + 1).cast("long")

    out = wide.select("customer", *[tile(F.col(f"_{c}")).alias(c) for c in "rfm"])
    r, f, m = F.col("r"), F.col("f"), F.col("m")
    label = F
    for name, holds in NTILE_SEGMENTS:
        label = label.when(holds(r, f, m), F.lit(name))
    return out.withColumn("segment", label.otherwise("core"))


def cohorts(df: DataFrame, customer: str, date: str, freq: str = "M", last: int = 12) -> DataFrame:
    """(cohort, step, customers, size, retention): cells that lie beyond the last observed period are absent."""
    seen = df.where(F.col(customer).isNotNull()).select(F.col(customer).alias("c"), calendar_index(F.col(date), freq).alias("i")).distinct()
    first = seen.groupBy("c").agg(F.min("i").alias("cohort"))
    cells = seen.join(first, "c").groupBy("cohort", (F.col("i") - F.col("cohort")).alias("step")).agg(F.count(F.lit(1)).alias("customers")).where(F.col("step") <= last)
    sizes = first.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"))
    end = seen.agg(F.max("i").alias("_end"))
    grid = sizes.crossJoin(F.broadcast(end)).select("cohort", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(last).cast("long"), F.col("_end") - F.col("cohort")))).alias("step"))
    return grid.join(cells, ["cohort", "step"], "left").select("cohort", "step", F.coalesce("customers", F.lit(0)).alias("customers"), "size", ratio(F.coalesce("customers", F.lit(0)), F.col("size")).alias("retention"))


def retention_curve(cells: DataFrame) -> DataFrame:
    """(step, customers, size, retention): weighted by cohort size over cohorts that were observed that long."""
    return cells.groupBy("step").agg(F.sum("customers").alias("customers"), F.sum("size").alias("size")).withColumn("retention", ratio(F.col("customers"), F.col("size")))


def alive(a: DataFrame, as_of: Column) -> DataFrame:
    """(customer, probability_alive) = (time between first and last / time since first) ** (frequency - 1)."""
    age = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("first_at").cast("timestamp"))) / 86400
    active = (F.unix_timestamp(F.col("last_at").cast("timestamp")) - F.unix_timestamp(F.col("first_at").cast("timestamp"))) / 86400
    return a.select("customer", F.when((age > 0) & (F.col("frequency") > 1), F.pow(active / age, F.col("frequency") - 1)).otherwise(1.0).alias("probability_alive"))


def gini(a: DataFrame, value: str = "monetary") -> DataFrame:
    """(customers, gini) from distinct values and their counts: sum of value times the ranks it spans."""
    v = a.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    r = ordered.running(v, "v", "n").withColumn("ranks", F.col("n") * (2 * F.col("_before") + F.col("n") + 1) / 2)
    n, total = F.sum("n"), F.sum(F.col("v") * F.col("n"))
    return r.agg(n.cast("long").alias("customers"), (2 * F.sum(F.col("v") * F.col("ranks")) / (n * total) - (n + 1) / n).alias("gini"))


def clv_inputs(df: DataFrame, customer: str, date: str, value: Column, segment: str) -> DataFrame:
    """(segment, customers, revenue, orders, aov, frequency, value_per_customer); a customer's segment is that of the first activity."""
    per = df.where(F.col(customer).isNotNull()).groupBy(F.col(customer).alias("c")).agg(F.min_by(segment, F.struct(F.col(date), F.col(segment))).alias("segment"), F.sum(value).alias("v"), F.count(F.lit(1)).alias("n"))
    g = per.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), F.sum("v").alias("revenue"), F.sum("n").alias("orders"))
    return g.withColumn("aov", ratio(F.col("revenue"), F.col("orders"))).withColumn("frequency", ratio(F.col("orders"), F.col("customers"))).withColumn("value_per_customer", ratio(F.col("revenue"), F.col("customers")))


def value_concentration(a: DataFrame, value: str = "monetary", share: float = 0.1) -> DataFrame:
    """(customers, top, share_of_value): the top tenth, rounded up and one at least, from value counts in order."""
    v = a.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    whole = v.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("customers"), F.sum(F.col("v") * F.col("n")).alias("whole"))
    k = F.greatest(F.ceil(F.round(F.col("customers") * share, 9)), F.lit(1)).cast("long")
    taken = F.least(F.col("n"), F.greatest(k - F.col("_before"), F.lit(0)))
    top = ordered.running(v, "v", "n", down=True).crossJoin(F.broadcast(whole)).agg(F.sum(taken * F.col("v")).alias("part"))
    return whole.crossJoin(F.broadcast(top)).select("customers", k.alias("top"), F.when((F.col("customers") > 0) & (F.col("whole") > 0), F.col("part") / F.col("whole")).otherwise(0.0).alias("share_of_value"))


def steady_retention(curve: list[float]) -> float | None:
    """The median ratio of neighbouring points of a retention curve, from its second point on, below one."""
    steps = [b / a for a, b in zip(curve[1:], curve[2:]) if a > 0]
    return min(median(steps), 0.999999) if steps else None


# Days of a period.
PERIOD_DAYS = {"D": 1.0, "W": 7.0, "M": 30.4375, "Q": 91.3125, "Y": 365.25}


def clv_segments(df: DataFrame, customer: str, date: str, value: Column, segment: str | None = None, freq: str = "M", retention: float | None = None, margin: float = 0.3, discount: float = 0.01, horizon: int | None = None) -> DataFrame:
    """(segment, customers, average_order_value, purchases_per_period, predicted_clv, historic_clv): by the segment of a customer's first row.

    Without `segment` one row, `all`. Retention is that given, else the steady one of the cohort curve (a few numbers reach
    the driver), else the share of customers with a second row, 0.95 at most.
    """
    used = df.where(F.col(customer).isNotNull() & F.col(date).isNotNull() & value.isNotNull())
    group = F.min_by(F.col(segment).cast("string"), F.struct(F.col(date), F.col(segment))) if segment else F.lit("all")
    per = used.groupBy(F.col(customer).alias("c")).agg(group.alias("segment"), F.sum(value).cast("double").alias("v"), F.count(F.lit(1)).alias("n"))
    if retention is None:
        curve = [r["retention"] for r in retention_curve(cohorts(used, customer, date, freq)).orderBy("step").collect()]
        retention = steady_retention([float(x) for x in curve])
    if retention is None:
        retention = min(per.agg(F.avg((F.col("n") > 1).cast("double")).alias("r")).first()["r"] or 0.0, 0.95)
    r = F.lit(min(max(float(retention), 0.0), 0.99))
    span = used.agg(((F.floor((F.unix_timestamp(F.max(date).cast("timestamp")) - F.unix_timestamp(F.min(date).cast("timestamp"))) / 86400) + 1) / PERIOD_DAYS[freq]).alias("_span"))
    g = per.where("segment is not null").groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), F.sum("v").alias("v"), F.sum("n").alias("n")).crossJoin(F.broadcast(span))
    order, often = F.col("v") / F.col("n"), F.col("n") / (F.col("customers") * F.greatest("_span", F.lit(1.0)))
    step = r / (1 + discount)
    reach = step / (1 - step) if horizon is None else step * (1 - F.pow(step, F.lit(horizon))) / (1 - step)
    return g.select("segment", "customers", order.alias("average_order_value"), often.alias("purchases_per_period"), (order * often * margin * reach).alias("predicted_clv"), (F.col("v") / F.col("customers") * margin).alias("historic_clv"))


def predicted_clv(margin: float, retention: float, discount: float = 0.0, horizon: int | None = None) -> float:
    """Value of the periods to come, the present one not included; the closed form without a horizon."""
    step = min(retention, 0.999999) / (1 + discount)
    return margin * step / (1 - step) if horizon is None else margin * step * (1 - step**horizon) / (1 - step)


def expected_lifetime(retention: float) -> float:
    return 1 / (1 - min(retention, 0.999999))


def funnel(df: DataFrame, entity: str, event: str, ts: str, steps: list[str]) -> DataFrame:
    """(step, position, entities): entities whose steps came in order, from each step's first time."""
    first = df.where(F.col(event).isin(*steps)).groupBy(entity).agg(*[F.min(F.when(F.col(event) == s, F.col(ts))).alias(f"_t{i}") for i, s in enumerate(steps)])
    reached, conditions = F.col("_t0").isNotNull(), []
    for i in range(len(steps)):
        if i:
            reached = reached & (F.col(f"_t{i}") >= F.col(f"_t{i - 1}"))
        conditions.append(F.count_if(F.coalesce(reached, F.lit(False))).alias(f"_n{i}"))
    rows = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(i + 1).cast("long").alias("position"), F.col(f"_n{i}").alias("entities")) for i, s in enumerate(steps)])
    return first.agg(*conditions).select(F.explode(rows).alias("r")).select("r.*")
