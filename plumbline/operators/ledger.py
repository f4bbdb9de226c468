"""Transaction ledgers: census, scopes, reconciliation, trends and repeat purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import period, ratio


def sales_scope(invoice: str, quantity: str, price: str) -> Column:
    """Rows that are sales: the invoice is no cancellation, and quantity and price are positive."""
    return ~F.upper(F.col(invoice).cast("string")).like("C%") & (F.col(quantity) > 0) & (F.col(price) > 0)


def revenue(df: DataFrame, name: str | None, quantity: str | None = None, price: str | None = None) -> Column:
    return F.col(name).cast("double") if name and name in df.columns else F.col(quantity).cast("double") * F.col(price).cast("double")


def census(df: DataFrame, invoice: str, customer: str, product: str, quantity: str, price: str) -> DataFrame:
    """Row, entity and problem counts in one scan."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(invoice).alias("invoices"), F.count_distinct(customer).alias("customers"), F.count_distinct(product).alias("products"), F.count_if(F.col(customer).isNull()).alias("no_customer"), F.count_if(F.col(quantity) <= 0).alias("non_positive_quantity"), F.count_if(F.col(price) <= 0).alias("non_positive_price"), F.count_distinct(F.when(F.upper(F.col(invoice).cast("string")).like("C%"), F.col(invoice))).alias("cancelled_invoices"))


def reconciliation(df: DataFrame, value: Column, scopes: dict[str, Column]) -> DataFrame:
    """(scope, row_count, total) of nested scopes, in one scan."""
    names = list(scopes)
    one = df.agg(*[F.count_if(F.coalesce(scopes[s], F.lit(False))).alias(f"n{i}") for i, s in enumerate(names)], *[F.coalesce(F.sum(F.when(scopes[s], value)), F.lit(0)).alias(f"v{i}") for i, s in enumerate(names)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(f"n{i}").alias("row_count"), F.col(f"v{i}").alias("total")) for i, s in enumerate(names)])).alias("r")).select("r.*")


def trend(df: DataFrame, date: str, grain: str, value: Column, order: str, customer: str) -> DataFrame:
    """(period, revenue, orders, customers, is_partial): the last period is partial if the data end before it does."""
    ends = df.agg(F.max(date).alias("_last"))
    step = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}[grain]
    g = df.groupBy(period(date, grain).alias("period")).agg(F.sum(value).alias("revenue"), F.count_distinct(order).alias("orders"), F.count_distinct(customer).alias("customers"))
    last_day = F.expr(f"cast(period + interval {step} as date)")
    return g.crossJoin(F.broadcast(ends)).select("period", "revenue", "orders", "customers", (F.col("_last").cast("date") < F.date_sub(last_day, 1)).alias("is_partial"))


def repeat_block(df: DataFrame, customer: str, order: str, value: Column) -> DataFrame:
    """(customers, repeat_customers, repeat_rate, repeat_revenue_share)."""
    per = df.where(F.col(customer).isNotNull()).groupBy(customer).agg(F.count_distinct(order).alias("_o"), F.sum(value).alias("_v"))
    return per.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("_o") > 1).alias("repeat_customers"), ratio(F.count_if(F.col("_o") > 1), F.count(F.lit(1)), 100).alias("repeat_rate"), ratio(F.sum(F.when(F.col("_o") > 1, F.col("_v")).otherwise(0)), F.sum("_v"), 100).alias("repeat_revenue_share"))


# -- audit: a table of rules in one aggregation ----------------------------------------------------------


def cancelled(c: dict[str, str]) -> Column:
    return F.coalesce(F.upper(F.col(c["invoice"]).cast("string")).like("C%"), F.lit(False))


def _number(c: dict[str, str], role: str) -> Column:
    return F.col(c[role]).cast("double")


#: (rule, columns it needs, rows it concerns, what is done with them), in the order of a report.
RULES = (
    ("cancelled", ("invoice",), lambda c: cancelled(c), "held out"),
    ("negative_quantity", ("invoice", "quantity"), lambda c: (_number(c, "quantity") < 0) & ~cancelled(c), "excluded"),
    ("zero_quantity", ("quantity",), lambda c: _number(c, "quantity") == 0, "excluded"),
    ("non_positive_price", ("price",), lambda c: _number(c, "price") <= 0, "excluded"),
    ("missing_customer", ("customer",), lambda c: F.col(c["customer"]).isNull(), "kept for revenue"),
    ("missing_description", ("description",), lambda c: F.col(c["description"]).isNull(), "kept"),
)


def in_scope(c: dict[str, str]) -> Column:
    """Completed sales: no cancellation, and a positive quantity and price where the ledger has them."""
    out = ~cancelled(c)
    for role in ("quantity", "price"):
        if role in c:
            out &= F.coalesce(_number(c, role) > 0, F.lit(False))
    return out


def quality_rules(df: DataFrame, c: dict[str, str], duplicates: bool = True) -> DataFrame:
    """(rule, rows, pct, treatment, severity) of the rules that concern any row, in one scan; equal rows by one shuffle of row hashes beside it.

    Severity by share of all rows: 20 % high, 5 % medium, else low.
    """
    some = [(name, when(c), what) for name, needs, when, what in RULES if all(n in c for n in needs)]
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(when, F.lit(False))).alias(f"r{i}") for i, (_, when, _) in enumerate(some)])
    rows = [F.struct(F.lit(i).alias("place"), F.lit(name).alias("rule"), F.col(f"r{i}").alias("rows"), F.lit(what).alias("treatment")) for i, (name, _, what) in enumerate(some)]
    if duplicates:
        twice = df.groupBy(F.xxhash64(*[F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("\x00")) for x in df.columns]), F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("\x00")) for x in df.columns]))).agg((F.count(F.lit(1)) - 1).alias("_again"))
        one = one.crossJoin(F.broadcast(twice.agg(F.coalesce(F.sum("_again"), F.lit(0)).alias("again"))))
        rows.append(F.struct(F.lit(len(some)).alias("place"), F.lit("duplicates").alias("rule"), F.col("again").alias("rows"), F.lit("reported").alias("treatment")))
    out = one.select("total", F.explode(F.array(*rows)).alias("x")).select("total", "x.*").where("rows > 0")
    pct = 100 * F.col("rows") / F.col("total")
    return out.select("rule", "rows", F.round(pct, 4).alias("pct"), "treatment", F.when(pct >= 20, "high").when(pct >= 5, "medium").otherwise("low").alias("severity"))


def kpis(df: DataFrame, c: dict[str, str], value: Column) -> DataFrame:
    """(kpi, scope, value, numerator, denominator): revenue, orders, units, customers, order value, repeat and cancellation rates.

    All but the repeat rate come from one scan: figures of completed sales and of the whole ledger side by side. A ratio has its parts beside it.
    """
    sale = in_scope(c)
    of = lambda x: F.when(sale, x)
    invoice = F.col(c["invoice"]).cast("string")
    none = F.lit(None).cast("double")
    one = df.agg(F.sum(of(value)).cast("double").alias("revenue"), F.count_distinct(of(invoice)).cast("double").alias("orders"), (F.sum(of(_number(c, "quantity"))) if "quantity" in c else F.max(none)).alias("units"), (F.count_distinct(of(F.col(c["customer"]))) if "customer" in c else F.max(none)).cast("double").alias("customers"), F.count_distinct(F.when(cancelled(c), invoice)).cast("double").alias("cancelled"), F.count_distinct(invoice).cast("double").alias("invoices"))
    if "customer" in c:
        repeat = repeat_block(df.where(sale), c["customer"], c["invoice"], value).select(F.col("customers").cast("double").alias("_identified"), F.col("repeat_customers").cast("double").alias("_repeat"))
        one = one.crossJoin(F.broadcast(repeat))
    else:
        one = one.withColumns({"_identified": none, "_repeat": none})
    rows = [(k, "sales", F.col(k), none, none) for k in ("revenue", "orders", "units", "customers")]
    rows.append(("aov", "sales", ratio(F.col("revenue"), F.col("orders")), F.col("revenue"), F.col("orders")))
    rows.append(("repeat_rate", "identified customers", ratio(F.col("_repeat"), F.col("_identified"), 100), F.col("_repeat"), F.col("_identified")))
    rows.append(("cancellation_rate", "all", ratio(F.col("cancelled"), F.col("invoices"), 100), F.col("cancelled"), F.col("invoices")))
    made = [F.struct(F.lit(k).alias("kpi"), F.lit(scope).alias("scope"), v.alias("value"), a.alias("numerator"), b.alias("denominator")) for k, scope, v, a, b in rows]
    return one.select(F.explode(F.array(*made)).alias("x")).select("x.*").where("value IS NOT NULL")


def coverage(df: DataFrame, c: dict[str, str]) -> DataFrame:
    """(rows, in_scope, first, last, partial): what completed sales cover; the last day is partial where its last sale is before 23 o'clock."""
    date = F.col(c["date"]).cast("timestamp")
    sale = in_scope(c)
    a = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(sale).alias("in_scope"), F.min(F.when(sale, date)).alias("first"), F.max(F.when(sale, date)).alias("last"))
    return a.withColumn("partial", F.coalesce(F.hour("last") < 23, F.lit(False)))


def detect(columns: list[str]) -> dict[str, str]:
    """Which columns play invoice, product, quantity, price, customer and date, by common names."""
    wanted = {"invoice": ("invoice", "order", "receipt"), "product": ("stock", "sku", "product", "item", "part"), "quantity": ("quantity", "qty", "units"), "price": ("price",), "customer": ("customer", "cust", "client"), "date": ("date", "time")}
    out: dict[str, str] = {}
    for role, words in wanted.items():
        hit = next((c for w in words for c in columns if w in c.lower() and c not in out.values()), None)
        if hit:
            out[role] = hit
    return out
