"""Registered queries and their SQL twins.

Each query applies operators of this package to the driver tables; each twin says the same in SQL for DuckDB. Money is
summed as decimals and averages are rounded, so that digits do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import calendar_index, fnv1a, masked, month_steps, period, period_label, pseudonym, ratio, redacted, row_key, surrogate_key, truthy
from plumbline.operators import anomaly, customers, experiment, kpi, ledger, privacy, profile, quality, rootcause, segments, warehouse
from plumbline.plans import dialect, domains, recipes
from plumbline.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = " ".join(sql.split())
        return fn

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


ROLES = {"revenue": "v", "date": "o_orderdate", "order_id": "o_orderkey", "customer_id": "o_custkey"}


def orders(spark, d) -> DataFrame:
    return t(spark, d, "orders").withColumn("v", money("o_totalprice"))


def items(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").withColumn("v", money("l_extendedprice"))


_ORD = "(SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)"
_ITM = "(SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem)"

# -- KPIs ---------------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT c_mktsegment AS segment, coalesce(sum(v) FILTER (WHERE o_orderdate >= '2000-01-01'), 0) AS cur, coalesce(sum(v) FILTER (WHERE o_orderdate < '2000-01-01'), 0) AS base
  FROM {_ORD} o JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= '1999-01-01' AND o_orderdate < '2001-01-01' GROUP BY 1),
  x AS (SELECT *, cur - base AS delta, sum(cur) OVER () AS tc, sum(base) OVER () AS tb FROM s)
  SELECT segment, cur, base, delta, round(100 * CAST(delta AS DOUBLE) / CAST(tc - tb AS DOUBLE), 6) AS contribution, round(100 * CAST(cur AS DOUBLE) / CAST(tc AS DOUBLE) - 100 * CAST(base AS DOUBLE) / CAST(tb AS DOUBLE), 6) AS mix_shift,
  round(CAST(base AS DOUBLE) * CAST(tc - tb AS DOUBLE) / CAST(tb AS DOUBLE), 4) AS expected FROM x""")
def mix_shift_segments(spark, d):
    """Which customer segments explain the change in order value, 2000 against 1999: one scan, window totals."""
    o = orders(spark, d).where((F.col("o_orderdate") >= "1999-01-01") & (F.col("o_orderdate") < "2001-01-01"))
    now = F.col("o_orderdate") >= "2000-01-01"
    s = o.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.coalesce(F.sum(F.when(now, F.col("v"))), F.lit(0)).alias("cur"), F.coalesce(F.sum(F.when(~now, F.col("v"))), F.lit(0)).alias("base"))
    w = Window.partitionBy(F.lit(1))
    x = s.withColumn("delta", F.col("cur") - F.col("base")).withColumn("tc", F.sum("cur").over(w)).withColumn("tb", F.sum("base").over(w))
    return x.select("segment", "cur", "base", "delta", r6(ratio(F.col("delta"), F.col("tc") - F.col("tb"), 100)).alias("contribution"), r6(ratio(F.col("cur"), F.col("tc"), 100) - ratio(F.col("base"), F.col("tb"), 100)).alias("mix_shift"), F.round(F.col("base").cast("double") * (F.col("tc") - F.col("tb")).cast("double") / F.col("tb").cast("double"), 4).alias("expected"))


@query("""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, count(*) AS record_count,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT o_orderkey), 6) AS aov, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT o_custkey), 6) AS revenue_per_customer,
  round(CAST(count(DISTINCT o_orderkey) AS DOUBLE) / count(DISTINCT o_custkey), 6) AS purchase_frequency FROM orders GROUP BY 1""")
def kpi_series_month(spark, d):
    s = kpi.series(orders(spark, d), "o_orderdate", "month", ROLES, ["revenue", "orders", "customers", "record_count", "aov", "revenue_per_customer", "purchase_frequency"])
    return rounded(s, "aov", "revenue_per_customer", "purchase_frequency")


@query(f"""WITH s AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, CAST(sum(v) AS DOUBLE) AS revenue, CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS orders FROM {_ORD} GROUP BY 1),
  u AS (SELECT 'revenue' AS kpi_id, period, revenue AS value FROM s UNION ALL SELECT 'orders', period, orders FROM s), w AS (SELECT *, lag(value) OVER (PARTITION BY kpi_id ORDER BY period) AS previous FROM u)
  SELECT kpi_id, period, value, previous, round(value - previous, 4) AS delta, round((value - previous) / abs(previous) * 100, 6) AS delta_pct,
  CASE WHEN abs((value - previous) / abs(previous) * 100) < 0.5 THEN 'flat' WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'flat' END AS direction,
  CASE WHEN abs((value - previous) / abs(previous) * 100) >= 0.5 THEN value > previous END AS favourable FROM w""")
def kpi_scorecard_quarter(spark, d):
    return kpi.scorecard(orders(spark, d), "o_orderdate", "quarter", ROLES, ["revenue", "orders"]).withColumn("delta", F.round("delta", 4)).withColumn("delta_pct", r6("delta_pct"))


@query("""WITH g AS (SELECT count(o_orderdate) AS n, count(DISTINCT date_trunc('day', o_orderdate)) AS day, count(DISTINCT date_trunc('week', o_orderdate)) AS week, count(DISTINCT date_trunc('month', o_orderdate)) AS month, count(DISTINCT date_trunc('quarter', o_orderdate)) AS quarter, count(DISTINCT date_trunc('year', o_orderdate)) AS year FROM orders)
  SELECT day, week, month, quarter, year, CASE WHEN day >= 4 AND n >= 3 * day THEN 'day' WHEN week >= 4 AND n >= 3 * week THEN 'week' WHEN month >= 4 AND n >= 3 * month THEN 'month' WHEN quarter >= 4 AND n >= 3 * quarter THEN 'quarter' WHEN year >= 4 AND n >= 3 * year THEN 'year' WHEN day >= 2 THEN 'day' WHEN week >= 2 THEN 'week' WHEN month >= 2 THEN 'month' WHEN quarter >= 2 THEN 'quarter' WHEN year >= 2 THEN 'year' ELSE 'day' END AS grain FROM g""")
def grain_choice(spark, d):
    o = orders(spark, d)
    return o.agg(*[F.count_distinct(period("o_orderdate", g)).alias(g) for g in kpi.GRAINS]).withColumn("grain", F.lit(kpi.choose_grain(o, "o_orderdate")))


@query("""WITH p AS (SELECT year(o_orderdate) AS yr, o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1, 2) SELECT CAST(yr AS BIGINT) AS yr, count(*) AS customers, round(100 * avg(CASE WHEN n > 1 THEN 1.0 ELSE 0 END), 6) AS repeat_rate FROM p GROUP BY 1""")
def kpi_repeat_rate(spark, d):
    o = orders(spark, d).withColumn("yr", F.year("o_orderdate").cast("long"))
    return rounded(kpi.repeat_rate(o, "o_custkey", "o_orderkey", ["yr"]), "repeat_rate")


@query(f"""WITH c AS (SELECT o_custkey, sum(v) AS total FROM {_ORD} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, o_custkey) AS k, count(*) OVER () AS n FROM c)
  SELECT max(n) AS entities, round(100 * CAST(sum(CASE WHEN k <= greatest(1, floor(0.1 * n)) THEN total END) AS DOUBLE) / CAST(sum(total) AS DOUBLE), 6) AS share FROM r""")
def kpi_top_decile_share(spark, d):
    return rounded(kpi.top_share(orders(spark, d), "o_custkey", "v", decile=True), "share")


@query(f"""WITH c AS (SELECT l_suppkey, sum(v) AS total FROM {_ITM} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, l_suppkey) AS k FROM c)
  SELECT count(*) AS entities, round(100 * CAST(sum(CASE WHEN k <= 5 THEN total END) AS DOUBLE) / CAST(sum(total) AS DOUBLE), 6) AS share FROM r""")
def kpi_top5_concentration(spark, d):
    return rounded(kpi.top_share(items(spark, d), "l_suppkey", "v", 5), "share")


@query(f"WITH c AS (SELECT l_suppkey, CAST(sum(v) AS DOUBLE) AS total FROM {_ITM} GROUP BY 1) SELECT round(10000 * sum(total * total) / (sum(total) * sum(total)), 4) AS hhi FROM c")
def kpi_hhi(spark, d):
    return kpi.concentration(items(spark, d).withColumn("v", F.col("v").cast("double")), "l_suppkey", "v").select(F.round("hhi", 4).alias("hhi"))


@query("SELECT l_linestatus, round(avg(l_discount) * 100, 6) AS discount_depth FROM lineitem GROUP BY 1")
def kpi_discount_depth(spark, d):
    i = items(spark, d)
    return rounded(kpi.aggregate(i, {"discount": "l_discount", "revenue": "v"}, ["discount_depth"], [F.col("l_linestatus")]), "discount_depth")


@query("SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS period, round(100 * avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END), 6) AS return_rate, round(100 * CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 6) AS fraud_value_rate FROM lineitem GROUP BY 1")
def kpi_flag_rates(spark, d):
    i = items(spark, d).withColumn("flag", F.when(F.col("l_returnflag") == "R", "yes").otherwise("no"))
    return rounded(kpi.series(i, "l_shipdate", "year", {"return_flag": "flag", "fraud_flag": "flag", "revenue": "v"}, ["return_rate", "fraud_value_rate"]), "return_rate", "fraud_value_rate")


@query("""SELECT o_orderstatus, round(100 * CAST(sum(m) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 6) AS gross_margin_pct, sum(v) AS revenue, round(CAST(sum(v) AS DOUBLE) / CAST(sum(c) AS DOUBLE), 6) AS roas FROM (SELECT o_orderstatus, CAST(l_extendedprice AS DECIMAL(18,2)) AS v, CAST(l_extendedprice * l_discount AS DECIMAL(18,2)) AS c, CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_extendedprice * l_discount AS DECIMAL(18,2)) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def kpi_ratios(spark, d):
    i = items(spark, d).withColumn("c", (F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(18,2)")).join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(kpi.aggregate(i, {"revenue": "v", "cost": "c", "marketing_spend": "c"}, ["gross_margin_pct", "revenue", "roas"], [F.col("o_orderstatus")]), "gross_margin_pct", "roas")


# -- segments, windows, grouping ----------------------------------------------------------------------


def _recipe(name: str):
    def run(spark, d, name=name):
        orders(spark, d).select("o_orderdate", "o_totalprice", "o_orderpriority", "o_custkey", "o_orderkey").createOrReplaceTempView("plumbline_orders")
        return spark.sql(recipes.recipes("plumbline_orders", "o_orderdate", "o_totalprice", "o_orderpriority", "o_custkey", "o_orderkey")[name])

    QUERIES[f"recipe_{name}"] = run
    ORACLES[f"recipe_{name}"] = recipes.recipes("orders", "o_orderdate", "o_totalprice", "o_orderpriority", "o_custkey", "o_orderkey")[name]


for _name in recipes.recipes("", "", "", "", "", ""):
    _recipe(_name)


@query(recipes.quantiles("orders", "o_totalprice", "o_orderpriority")[1])
def recipe_quantiles(spark, d):
    t(spark, d, "orders").createOrReplaceTempView("plumbline_quantiles")
    return spark.sql(recipes.quantiles("plumbline_quantiles", "o_totalprice", "o_orderpriority")[0])


@query(f"""WITH s AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, o_orderpriority AS segment, sum(v) AS total FROM {_ORD} GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY total DESC, segment) AS position FROM s) WHERE position <= 3""")
def topn_per_period(spark, d):
    return segments.top_per_period(orders(spark, d), "o_orderdate", "quarter", "o_orderpriority", F.col("v"))


@query(f"""WITH c AS (SELECT o_custkey AS entity, sum(v) AS total FROM {_ORD} GROUP BY 1) SELECT entity, total, row_number() OVER (ORDER BY total DESC, entity) AS position, round(100 * CAST(sum(total) OVER (ORDER BY total DESC, entity ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE), 6) AS cumulative_share FROM c""")
def pareto_customers(spark, d):
    totals = orders(spark, d).groupBy(F.col("o_custkey").alias("entity")).agg(F.sum("v").alias("total"))
    return rounded(segments.cumulative(totals), "cumulative_share")


@query(f"""WITH s AS (SELECT p_brand AS segment, sum(v) AS total FROM {_ITM} JOIN part ON l_partkey = p_partkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, segment) AS k FROM s)
  SELECT CASE WHEN k <= 7 THEN segment ELSE 'Other (' || (SELECT count(*) FROM r WHERE k > 7) || ')' END AS segment, sum(total) AS total FROM r GROUP BY 1""")
def top_k_other(spark, d):
    i = items(spark, d).join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return segments.with_other(i, "p_brand", F.col("v"), 8)


@query(f"""WITH s AS (SELECT o_orderpriority AS segment, sum(v) AS total, coalesce(sum(v) FILTER (WHERE o_orderdate >= '2000-01-01' AND o_orderdate < '2001-01-01'), 0) - coalesce(sum(v) FILTER (WHERE o_orderdate >= '1999-01-01' AND o_orderdate < '2000-01-01'), 0) AS delta FROM {_ORD} GROUP BY 1)
  SELECT segment, total, round(100 * CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE), 6) AS share, delta FROM s ORDER BY total DESC, segment LIMIT 12""")
def segment_slices(spark, d):
    return rounded(segments.slices(orders(spark, d), "o_orderpriority", F.col("v"), F.col("o_orderdate"), "2000-01-01", "1999-01-01", "2001-01-01"), "share")


@query("""WITH s AS (SELECT r_name AS segment, n_name AS child, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
  g AS (SELECT segment FROM s GROUP BY 1 ORDER BY sum(total) DESC, segment LIMIT 3), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY total DESC, child) AS k FROM s WHERE segment IN (SELECT segment FROM g)) SELECT segment, child, total FROM r WHERE k <= 4""")
def nested_breakdown(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return segments.nested(c, "r_name", "n_name", money("c_acctbal"), 3, 4)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(money("l_quantity")).alias("quantity"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query()
def approx_aggregates(spark, d):
    """Approximate distinct counts and quantiles: sketches differ between engines, so rows only."""
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.9).alias("p90"))


@query("""SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous_order, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) AS BIGINT) AS rank_year, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) AS BIGINT) AS dense_year, first_value(o_orderkey) OVER w AS first_order, CAST(ntile(4) OVER w AS BIGINT) AS quartile FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_functions(spark, d):
    w, y = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy(F.year("o_orderdate"))
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("previous_order"), F.rank().over(y).cast("long").alias("rank_year"), F.dense_rank().over(y).cast("long").alias("dense_year"), F.first("o_orderkey").over(w).alias("first_order"), F.ntile(4).over(w).cast("long").alias("quartile"))


@query("""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT period, n, list(n) OVER (ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS past FROM m) SELECT period, n, CAST(list_aggregate(past, 'median') AS DOUBLE) AS trailing_median FROM w""")
def rolling_median(spark, d):
    m = t(spark, d, "orders").groupBy(period("o_orderdate", "month").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("period").rowsBetween(-12, -1)  # one row for each month
    return m.withColumn("_p", F.array_sort(F.collect_list("n").over(w))).select("period", "n", F.when(F.size("_p") > 0, (F.get("_p", F.floor((F.size("_p") - 1) / 2).cast("int")) + F.get("_p", F.floor(F.size("_p") / 2).cast("int"))) / 2.0).alias("trailing_median"))


# -- profile and quality ------------------------------------------------------------------------------


def _unpivot_counts(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 4) AS missing_pct, count(DISTINCT {c}) AS distinct_values, round(100.0 * count(DISTINCT {c}) / count({c}), 4) AS unique_pct, count(DISTINCT {c}) = count({c}) AS is_unique, count(DISTINCT {c}) <= 1 AS is_constant FROM {table}" for c in cols)


@query(_unpivot_counts("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def profile_counts(spark, d):
    return profile.counts(t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


def _numeric(table: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", n, low, high, round(mean, 6) AS mean, median, round(std, 6) AS std, p05, p25, p75, p95, zeros, negatives,
      round((s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean) / (std * std * std), 4) AS skewness FROM (SELECT count({c}) AS n, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, avg({c}) AS mean, CAST(median({c}) AS DOUBLE) AS median, stddev_samp({c}) AS std,
      CAST(quantile_cont({c}, 0.05) AS DOUBLE) AS p05, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS p25, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS p75, CAST(quantile_cont({c}, 0.95) AS DOUBLE) AS p95, count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives, sum(CAST({c} AS DOUBLE) * {c} * {c}) AS s3, sum(CAST({c} AS DOUBLE) * {c}) AS s2 FROM {table})"""


@query(" UNION ALL ".join(_numeric("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def profile_numeric(spark, d):
    p = profile.numeric_summary(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return p.select("column", "n", "low", "high", r6("mean").alias("mean"), "median", r6("std").alias("std"), "p05", "p25", "p75", "p95", "zeros", "negatives", F.round("skewness", 4).alias("skewness"))


@query("""WITH v AS (SELECT source AS x, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), s AS (SELECT CAST(n AS DOUBLE) / sum(n) OVER () AS p FROM v) SELECT count(*) AS levels, round(-sum(p * log2(p)), 6) AS entropy, round(sum(p * p), 6) AS hhi FROM s""")
def entropy_hhi(spark, d):
    return rounded(profile.entropy(t(spark, d, "documents"), "source"), "entropy", "hhi")


@query("SELECT lang AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(lang) FROM documents), 4) AS pct FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def profile_top_values(spark, d):
    return profile.top_values(t(spark, d, "documents"), "lang")


_UNIT = "CASE WHEN dates < 3 THEN NULL " + " ".join(f"WHEN median_gap <= 1.35 * {s} THEN {{{i}}}" for i, s in enumerate(profile.UNITS.values())) + " ELSE {last} END"


@query(f"""WITH x AS (SELECT DISTINCT epoch(o_orderdate) AS s FROM orders), g AS (SELECT s - lag(s) OVER (ORDER BY s) AS gap FROM x), m AS (SELECT count(*) AS dates, median(gap) AS median_gap FROM g),
  u AS (SELECT dates, median_gap, {_UNIT.format(*[f"'{k}'" for k in profile.UNITS], last="'irregular'")} AS granularity, {_UNIT.format(*profile.UNITS.values(), last="NULL")} AS unit FROM m)
  SELECT dates, median_gap, granularity, CASE WHEN unit IS NOT NULL THEN (SELECT count(*) FROM g WHERE gap > 1.6 * unit) END AS gaps FROM u""")
def date_granularity(spark, d):
    return profile.date_granularity(t(spark, d, "orders"), "o_orderdate").withColumn("median_gap", F.col("median_gap").cast("double"))


@query("""SELECT 'l_orderkey' AS first, 'l_linenumber' AS second, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_pairs, count(DISTINCT (l_orderkey, l_linenumber)) = count(*) AS is_key FROM lineitem UNION ALL SELECT 'l_orderkey', 'l_partkey', count(DISTINCT (l_orderkey, l_partkey)), count(DISTINCT (l_orderkey, l_partkey)) = count(*) FROM lineitem UNION ALL SELECT 'l_linenumber', 'l_partkey', count(DISTINCT (l_linenumber, l_partkey)), count(DISTINCT (l_linenumber, l_partkey)) = count(*) FROM lineitem""")
def primary_key_pairs(spark, d):
    return profile.key_pairs(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"])


@query("SELECT count(DISTINCT o_custkey) AS child_values, count(DISTINCT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey END) AS contained, CAST(count(DISTINCT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey END) AS DOUBLE) / count(DISTINCT o_custkey) AS ratio FROM orders")
def foreign_keys(spark, d):
    return profile.inclusion(t(spark, d, "orders"), "o_custkey", t(spark, d, "customer"), "c_custkey")


@query("SELECT count(*) * 3 AS cells, (count(*) - count(text)) + (count(*) - count(lang)) + (count(*) - count(source)) AS missing_cells, round(100 - 100.0 * ((count(*) - count(text)) + (count(*) - count(lang)) + (count(*) - count(source))) / (count(*) * 3), 6) AS completeness FROM documents")
def q_missing(spark, d):
    return rounded(quality.missing(t(spark, d, "documents").select("text", "lang", "source")), "completeness")


@query("WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang, source) SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_rows, CAST(sum(n) AS BIGINT) - count(*) AS duplicates FROM g")
def q_exact_duplicates(spark, d):
    return quality.exact_duplicates(t(spark, d, "documents").select("text", "lang", "source"))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_key_duplicates(spark, d):
    return quality.key_duplicates(t(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT count(*) FILTER (WHERE l_quantity < 0) AS negative_quantity, count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.08) AS discount_range, count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2001-01-02' OR l_shipdate < TIMESTAMP '1970-01-01') AS date_range, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS flag_values FROM lineitem")
def q_validity(spark, d):
    return quality.validity(t(spark, d, "lineitem"), {"negative_quantity": quality.negative("l_quantity"), "discount_range": quality.outside_percentage("l_discount", 0.08), "date_range": quality.implausible_date("l_shipdate", "2001-01-01"), "flag_values": ~F.col("l_returnflag").isin("A", "N")})


@query("""WITH s AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 11 = 0 THEN c_mktsegment || ' ' ELSE c_mktsegment END AS v FROM customer), g AS (SELECT v, count(*) AS n FROM s GROUP BY 1), f AS (SELECT lower(trim(v)) AS l, count(DISTINCT trim(v)) AS forms FROM g GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(CASE WHEN v <> trim(v) OR forms > 1 THEN n ELSE 0 END) AS BIGINT) AS inconsistent FROM g JOIN f ON lower(trim(v)) = l""")
def q_casing(spark, d):
    c = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.lower("c_mktsegment")).when(F.col("c_custkey") % 11 == 0, F.concat("c_mktsegment", F.lit(" "))).otherwise(F.col("c_mktsegment")).alias("v"))
    return quality.casing(c, "v")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT round(max(a - 1.5 * (b - a)), 6) AS low_fence, round(max(b + 1.5 * (b - a)), 6) AS high_fence, count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers, round(100 * coalesce(sum(abs(value)) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)), 0) / sum(abs(value)), 6) AS share_of_total FROM events, q""")
def q_outliers_tukey(spark, d):
    return rounded(quality.tukey(t(spark, d, "events"), "value"), "low_fence", "high_fence", "share_of_total")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, median(value) AS m, quantile_cont(value, 0.75) AS b, mad(value) AS d FROM events) SELECT count(value) AS n, round(max(m), 6) AS median, round(max(d), 6) AS mad, count(*) FILTER (WHERE (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AND abs(value - m) / (1.4826 * d) > 3.5) AS outliers FROM events, q""")
def q_outliers_iqr_mad(spark, d):
    return rounded(quality.robust_outliers(t(spark, d, "events"), "value"), "median", "mad")


@query("SELECT CAST(max(o_orderdate) AS DATE) AS latest, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-01') AS age_days, greatest(0.0, 100 - 1.5 * greatest(0, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-01') - 45)) :: DOUBLE AS core_score, CAST(CASE WHEN date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-01') <= 7 THEN 100 WHEN date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-01') <= 31 THEN 92 WHEN date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-01') <= 93 THEN 80 WHEN date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-01') <= 366 THEN 62 ELSE 40 END AS BIGINT) AS sql_score FROM orders")
def q_timeliness(spark, d):
    return quality.timeliness(t(spark, d, "orders"), "o_orderdate", "2001-12-01")


@query("SELECT count(*) AS violations FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def q_accepted_values(spark, d):
    return quality.accepted(t(spark, d, "orders"), "o_orderstatus", ["F", "O"])


@query("SELECT count(*) AS violations FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def q_relationships(spark, d):
    return quality.orphans(t(spark, d, "lineitem"), "l_orderkey", t(spark, d, "orders").where("o_orderstatus = 'F'"), "o_orderkey")


# -- root cause ---------------------------------------------------------------------------------------

_RC = ("1999-01-01", "2000-01-01", "2001-01-01")


def _rc_sql(dims: list[str]) -> str:
    side = lambda k, cond: f"count(*) FILTER (WHERE {cond}) AS n{k}, round(coalesce(sum(CAST(v AS DOUBLE)) FILTER (WHERE {cond}), 0), 2) AS s{k}, CAST(coalesce(sum(1.0) FILTER (WHERE {cond}), 0) AS DOUBLE) AS w{k}"
    one = "SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS segment, " + side(1, "o_orderdate >= '2000-01-01'") + ", " + side(0, "o_orderdate < '2000-01-01'") + f" FROM {_ORD} WHERE o_orderdate >= '1999-01-01' AND o_orderdate < '2001-01-01' GROUP BY 2"
    return " UNION ALL ".join(one.replace("{d}", x) for x in dims)


def _rc(spark, d) -> DataFrame:
    return rootcause.segment_moments(orders(spark, d), ["o_orderstatus", "o_orderpriority"], "o_orderdate", *_RC, F.col("v"))


@query(_rc_sql(["o_orderstatus", "o_orderpriority"]))
def rc_moments(spark, d):
    return _rc(spark, d).select("dimension", "segment", "n1", F.round("s1", 2).alias("s1"), "w1", "n0", F.round("s0", 2).alias("s0"), "w0")


@query(f"""WITH m AS ({_rc_sql(["o_orderstatus", "o_orderpriority"])}), x AS (SELECT *, s1 - s0 AS delta, sum(s1 - s0) OVER w AS td, sum(s0) OVER w AS t0, sum(s1) OVER w AS t1, sum(abs(s0)) OVER w AS ta FROM m WINDOW w AS (PARTITION BY dimension))
  SELECT dimension, segment, round(delta, 2) AS delta, round(100 * delta / td, 5) AS contribution, round(100 * s1 / t1 - 100 * s0 / t0, 5) AS mix_shift, round(abs(s0) / ta * td, 2) AS expected, round(delta - abs(s0) / ta * td, 2) AS excess FROM x""")
def rc_additive(spark, d):
    a = rootcause.additive(_rc(spark, d))
    return a.select("dimension", "segment", F.round("delta", 2).alias("delta"), F.round("contribution", 5).alias("contribution"), F.round("mix_shift", 5).alias("mix_shift"), F.round("expected", 2).alias("expected"), F.round("excess", 2).alias("excess"))


@query(f"""WITH m AS ({_rc_sql(["o_orderstatus", "o_orderpriority"])}), x AS (SELECT *, w0 / sum(w0) OVER p AS a0, w1 / sum(w1) OVER p AS a1, s0 / w0 AS r0, s1 / w1 AS r1, sum(s0) OVER p / sum(w0) OVER p AS r FROM m WINDOW p AS (PARTITION BY dimension))
  SELECT dimension, segment, round(a1 * (r1 - r0), 4) AS rate_effect, round((a1 - a0) * (r0 - r), 4) AS mix_effect FROM x""")
def rc_mix_rate(spark, d):
    return rootcause.mix_rate(_rc(spark, d)).select("dimension", "segment", F.round("rate_effect", 4).alias("rate_effect"), F.round("mix_effect", 4).alias("mix_effect"))


@query(f"""WITH c AS (SELECT o_orderpriority AS segment, sum(v) AS value FROM {_ORD} WHERE o_orderdate >= '2000-01-01' AND o_orderdate < '2000-02-01' GROUP BY 1), b AS (SELECT o_orderpriority AS segment, sum(v) AS value FROM {_ORD} WHERE o_orderdate >= '1999-12-01' AND o_orderdate < '2000-01-01' AND o_orderpriority <> '1-URGENT' GROUP BY 1)
  SELECT coalesce(c.segment, b.segment) AS segment, coalesce(c.value, 0) AS current, coalesce(b.value, 0) AS baseline, coalesce(c.value, 0) - coalesce(b.value, 0) AS delta FROM c FULL JOIN b ON c.segment IS NOT DISTINCT FROM b.segment""")
def rc_full_outer_segments(spark, d):
    g = lambda df: df.groupBy(F.col("o_orderpriority").alias("segment")).agg(F.sum("v").alias("value"))
    o = orders(spark, d)
    c = g(o.where((F.col("o_orderdate") >= "2000-01-01") & (F.col("o_orderdate") < "2000-02-01")))
    b = g(o.where((F.col("o_orderdate") >= "1999-12-01") & (F.col("o_orderdate") < "2000-01-01") & (F.col("o_orderpriority") != "1-URGENT")))
    return rootcause.full_outer(c, b, ["segment"])


@query(f"""SELECT o_orderpriority AS parent, o_orderstatus AS child, coalesce(sum(v) FILTER (WHERE o_orderdate >= '2000-01-01'), 0) AS s1, coalesce(sum(v) FILTER (WHERE o_orderdate < '2000-01-01'), 0) AS s0, count(*) AS n FROM {_ORD} WHERE o_orderdate >= '1999-01-01' AND o_orderdate < '2001-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2""")
def rc_drilldown(spark, d):
    return rootcause.drill(orders(spark, d), "o_orderpriority", ["1-URGENT", "2-HIGH"], "o_orderstatus", "o_orderdate", *_RC, F.col("v"))


@query(f"""WITH m AS ({_rc_sql(["o_orderstatus", "o_orderpriority"])}), x AS (SELECT dimension, s1 - s0 AS delta, s1 - s0 - abs(s0) / (sum(abs(s0)) OVER w) * (sum(s1 - s0) OVER w) AS excess FROM m WINDOW w AS (PARTITION BY dimension))
  SELECT dimension, count(*) AS segments, round(least(1.0, sum(abs(excess)) / sum(abs(delta))), 5) AS dispersion, round(max(abs(excess)) / sum(abs(excess)), 5) AS concentration, round(abs(sum(delta)) / sum(abs(delta)), 5) AS coverage FROM x GROUP BY 1""")
def rc_power(spark, d):
    p = rootcause.power(rootcause.additive(_rc(spark, d)))
    return p.withColumns({c: F.round(c, 5) for c in ("dispersion", "concentration", "coverage")})


# -- anomalies, series --------------------------------------------------------------------------------


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS segment, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1), m AS (SELECT median(total) AS med, 1.4826 * mad(total) AS d FROM s) SELECT segment, round(total, 4) AS total, round(med, 4) AS median, round(d, 4) AS mad, round((total - med) / greatest(d, abs(med) * 0.02), 4) AS z, abs((total - med) / greatest(d, abs(med) * 0.02)) >= 2.5 AS is_anomaly FROM s, m""")
def segment_mad_z(spark, d):
    a = anomaly.segment_scores(t(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,4)")).groupBy("user_id").agg(F.sum("value").cast("double").alias("value")), "user_id", F.col("value"))
    return a.withColumns({c: F.round(F.col(c), 4) for c in ("total", "median", "mad", "z")})


@query("""WITH s AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS period, count(*) AS value FROM events GROUP BY 1), m AS (SELECT median(value) AS med, 1.4826 * mad(value) AS d FROM s) SELECT period, value, CAST(med AS DOUBLE) AS median, round(d, 6) AS mad, round(CASE WHEN d > 0 THEN (value - med) / d ELSE 0 END, 6) AS z, CASE WHEN d > 0 THEN abs((value - med) / d) >= 3 ELSE false END AS is_anomaly FROM s, m""")
def temporal_mad_z(spark, d):
    s = t(spark, d, "events").groupBy(period("ts", "day").alias("period")).agg(F.count(F.lit(1)).alias("value"))
    return rounded(anomaly.temporal_scores(s), "mad", "z")


def _monthly(spark, d) -> DataFrame:
    return kpi.scorecard(orders(spark, d), "o_orderdate", "month", ROLES, ["revenue", "orders", "customers"]).select("kpi_id", F.col("period").cast("string").alias("period"), "value")


@query()
def series_anomalies(spark, d):
    return anomaly.series_anomalies(_monthly(spark, d), 12)


@query()
def series_forecasts(spark, d):
    return anomaly.forecasts(_monthly(spark, d), 6, 12)


@query()
def series_trends(spark, d):
    return anomaly.trends(_monthly(spark, d))


@query(f"""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(v) AS DOUBLE) AS v FROM {_ORD} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM m),
  c AS (SELECT *, (0.5 * lag(v, 6) OVER w + lag(v, 5) OVER w + lag(v, 4) OVER w + lag(v, 3) OVER w + lag(v, 2) OVER w + lag(v, 1) OVER w + v + lead(v, 1) OVER w + lead(v, 2) OVER w + lead(v, 3) OVER w + lead(v, 4) OVER w + lead(v, 5) OVER w + 0.5 * lead(v, 6) OVER w) / 12 AS t FROM r WINDOW w AS (ORDER BY period)),
  e AS (SELECT a.period, a.i, a.v, b.t AS trend FROM c a JOIN c b ON b.i = least(greatest(a.i, 6), a.n - 7) WHERE a.n >= 24), p AS (SELECT i % 12 AS slot, avg(v - trend) AS phase FROM e GROUP BY 1), q AS (SELECT slot, phase - avg(phase) OVER () AS seasonal FROM p)
  SELECT 'revenue' AS kpi_id, CAST(period AS VARCHAR) AS period, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(v - trend - seasonal, 3) AS residual FROM e JOIN q ON q.slot = e.i % 12""")
def series_decomposition(spark, d):
    x = anomaly.decomposition(_monthly(spark, d).where("kpi_id = 'revenue'"))
    return x.withColumns({c: F.round(c, 3) for c in ("trend", "seasonal", "residual")})


# -- customers ----------------------------------------------------------------------------------------

_ACT = f"(SELECT o_custkey AS customer, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, count(*) AS frequency, sum(v) AS monetary FROM {_ORD} GROUP BY 1)"


@query(f"""WITH a AS (SELECT *, CAST(floor((epoch_us((SELECT max(o_orderdate) FROM orders) + INTERVAL 1 DAY) - epoch_us(last_at)) / 86400000000) AS BIGINT) AS recency FROM {_ACT}),
  k AS (SELECT *, (rank() OVER (ORDER BY recency DESC) + (count(*) OVER (PARTITION BY recency) - 1) / 2.0) / count(*) OVER () AS rr, (rank() OVER (ORDER BY frequency) + (count(*) OVER (PARTITION BY frequency) - 1) / 2.0) / count(*) OVER () AS rf, (rank() OVER (ORDER BY monetary) + (count(*) OVER (PARTITION BY monetary) - 1) / 2.0) / count(*) OVER () AS rm FROM a),
  s AS (SELECT customer, recency, frequency, monetary, CAST(greatest(1, least(5, ceil(round(rr * 5, 9)))) AS BIGINT) AS r, CAST(greatest(1, least(5, ceil(round(rf * 5, 9)))) AS BIGINT) AS f, CAST(greatest(1, least(5, ceil(round(rm * 5, 9)))) AS BIGINT) AS m FROM k)
  SELECT *, CASE WHEN r >= 4 AND f >= 4 THEN 'Champions' WHEN r >= 3 AND f >= 4 THEN 'Loyal customers' WHEN r <= 2 AND f >= 4 AND m >= 4 THEN 'Cannot lose them' WHEN r >= 4 AND f >= 3 THEN 'Potential loyalists' WHEN r >= 4 AND f <= 2 THEN 'New customers' WHEN r >= 3 AND f <= 2 THEN 'Promising' WHEN r >= 3 THEN 'Needs attention' WHEN f >= 3 THEN 'At risk' WHEN r <= 1 AND f <= 1 THEN 'Lost' ELSE 'Hibernating' END AS segment FROM s""")
def rfm_rank(spark, d):
    return customers.rfm(orders(spark, d), "o_custkey", "o_orderdate", F.col("v"))


@query(f"""WITH s AS ({ORACLES["rfm_rank"]}) SELECT segment, count(*) AS customers, sum(monetary) AS value, round(100.0 * count(*) / (SELECT count(*) FROM s), 5) AS customer_share, round(100 * CAST(sum(monetary) AS DOUBLE) / (SELECT CAST(sum(monetary) AS DOUBLE) FROM s), 5) AS value_share,
  median(recency) AS median_recency, median(frequency) AS median_frequency, round(CAST(median(CAST(monetary AS DOUBLE)) AS DOUBLE), 3) AS median_monetary FROM s GROUP BY 1""")
def rfm_summary(spark, d):
    s = customers.rfm_summary(rfm_rank(spark, d))
    return s.withColumns({"customer_share": F.round("customer_share", 5), "value_share": F.round("value_share", 5), "median_monetary": F.round(F.col("median_monetary").cast("double"), 3)})


@query("""WITH p AS (SELECT 100.0 * count(*) / sum(count(*)) OVER () AS share FROM lineitem GROUP BY l_returnflag) SELECT count(*) AS levels, round(sum(share * share), 4) AS hhi FROM p""")
def breakdown_hhi(spark, d):
    """Concentration of a breakdown's shares in percent, as texts use it."""
    v = profile.entropy(t(spark, d, "lineitem"), "l_returnflag")
    return v.select("levels", F.round(F.col("hhi") * 10_000, 4).alias("hhi"))


@query("""SELECT 'order_date' AS "column", count(*) AS n, 'd/M/yyyy' AS format, count(*) AS parsed FROM orders""")
def date_format_choice(spark, d):
    """Text dates are read by the format that reads most values, all formats scored in one scan."""
    from plumbline.operators import repair

    text = t(spark, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"))
    return repair.date_formats(text, ["order_date"]).where("parsed = n").select("column", "n", "format", "parsed")


@query("SELECT o_orderkey, v AS value, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS k FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)")
def top_rows(spark, d):
    top = orders(spark, d).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    return top.select("o_orderkey", F.col("v").alias("value"), F.row_number().over(Window.orderBy("o_orderkey")).cast("long").alias("k"))


@query(f"""WITH a AS (SELECT *, date_diff('day', CAST(last_at AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) AS recency FROM {_ACT}), b AS (SELECT customer, CAST(floor(percent_rank() OVER (ORDER BY recency DESC) * 5) + 1 AS BIGINT) AS r, CAST(floor(percent_rank() OVER (ORDER BY frequency) * 5) + 1 AS BIGINT) AS f, CAST(floor(percent_rank() OVER (ORDER BY monetary) * 5) + 1 AS BIGINT) AS m FROM a)
  SELECT *, CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champions' WHEN r >= 3 AND f >= 3 THEN 'Loyal' WHEN r >= 4 AND f <= 2 THEN 'New / promising' WHEN r >= 3 AND m >= 4 THEN 'Big spenders' WHEN r = 2 AND f >= 3 THEN 'At risk' WHEN r = 2 THEN 'Cooling' WHEN r = 1 AND m >= 4 THEN 'Lost high value' ELSE 'Dormant' END AS segment FROM b""")
def rfm_percent_rank(spark, d):
    return customers.rfm_percent_rank(orders(spark, d), "o_custkey", "o_orderdate", F.col("v"), "o_orderkey")


@query(f"""WITH s AS (SELECT customer, CAST(ntile(5) OVER (ORDER BY last_at, customer) AS BIGINT) AS r, CAST(ntile(5) OVER (ORDER BY frequency, customer) AS BIGINT) AS f, CAST(ntile(5) OVER (ORDER BY monetary, customer) AS BIGINT) AS m FROM {_ACT}) SELECT *, CASE WHEN r >= 4 AND f >= 4 THEN 'champion' WHEN r >= 4 AND f <= 2 THEN 'new' WHEN r <= 2 AND f >= 4 THEN 'at risk' WHEN r <= 2 AND f <= 2 THEN 'lapsed' ELSE 'core' END AS segment FROM s""")
def rfm_ntile(spark, d):
    return customers.rfm_ntile(orders(spark, d), "o_custkey", "o_orderdate", F.col("v"))


_COHORT = """WITH s AS (SELECT DISTINCT o_custkey AS c, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS i FROM orders), f AS (SELECT c, min(i) AS cohort FROM s GROUP BY 1), z AS (SELECT cohort, count(*) AS size FROM f GROUP BY 1), e AS (SELECT max(i) AS e FROM s),
  grid AS (SELECT cohort, size, unnest(range(0, least(12, e - cohort) + 1)) AS step FROM z, e), x AS (SELECT cohort, i - cohort AS step, count(*) AS n FROM s JOIN f USING (c) GROUP BY 1, 2), cells AS (SELECT grid.cohort, grid.step, coalesce(n, 0) AS customers, size FROM grid LEFT JOIN x ON x.cohort = grid.cohort AND x.step = grid.step)"""


@query(f"{_COHORT} SELECT cohort, step, customers, size, round(customers / CAST(size AS DOUBLE), 6) AS retention FROM cells")
def cohort_matrix(spark, d):
    return rounded(customers.cohorts(t(spark, d, "orders"), "o_custkey", "o_orderdate"), "retention")


@query(f"{_COHORT} SELECT step, CAST(sum(customers) AS BIGINT) AS customers, CAST(sum(size) AS BIGINT) AS size, round(CAST(sum(customers) AS DOUBLE) / CAST(sum(size) AS DOUBLE), 6) AS retention FROM cells GROUP BY 1")
def cohort_curve(spark, d):
    return rounded(customers.retention_curve(customers.cohorts(t(spark, d, "orders"), "o_custkey", "o_orderdate")), "retention")


@query(f"""SELECT customer, round(CASE WHEN epoch(TIMESTAMP '2002-01-01' - first_at) > 0 AND frequency > 1 THEN power(epoch(last_at - first_at) / epoch(TIMESTAMP '2002-01-01' - first_at), frequency - 1) ELSE 1.0 END, 8) AS probability_alive FROM {_ACT}""")
def prob_alive(spark, d):
    a = customers.activity(orders(spark, d), "o_custkey", "o_orderdate", F.col("v"))
    return customers.alive(a, F.lit("2002-01-01").cast("timestamp_ntz")).withColumn("probability_alive", F.round("probability_alive", 8))


@query(f"""WITH r AS (SELECT CAST(monetary AS DOUBLE) AS v, row_number() OVER (ORDER BY monetary) AS k, count(*) OVER () AS n FROM {_ACT}) SELECT count(*) AS customers, round(2 * sum(v * k) / (max(n) * sum(v)) - (max(n) + 1.0) / max(n), 6) AS gini FROM r""")
def gini(spark, d):
    return rounded(customers.gini(customers.activity(orders(spark, d), "o_custkey", "o_orderdate", F.col("v"))), "gini")


@query(f"""WITH p AS (SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderpriority)) AS segment, sum(v) AS v, count(*) AS n FROM {_ORD} GROUP BY 1) SELECT segment, count(*) AS customers, sum(v) AS revenue, CAST(sum(n) AS BIGINT) AS orders, round(CAST(sum(v) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS aov, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS frequency, round(CAST(sum(v) AS DOUBLE) / count(*), 6) AS value_per_customer FROM p GROUP BY 1""")
def clv_inputs(spark, d):
    return rounded(customers.clv_inputs(orders(spark, d), "o_custkey", "o_orderdate", F.col("v"), "o_orderpriority"), "aov", "frequency", "value_per_customer")


@query("""WITH f AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS a, min(ts) FILTER (WHERE event_type = 'click') AS b, min(ts) FILTER (WHERE event_type = 'purchase') AS c FROM events GROUP BY 1)
  SELECT 'view' AS step, CAST(1 AS BIGINT) AS position, count(*) FILTER (WHERE a IS NOT NULL) AS entities FROM f UNION ALL SELECT 'click', 2, count(*) FILTER (WHERE b >= a) FROM f UNION ALL SELECT 'purchase', 3, count(*) FILTER (WHERE b >= a AND c >= b) FROM f""")
def funnel(spark, d):
    return customers.funnel(t(spark, d, "events"), "user_id", "event_type", "ts", ["view", "click", "purchase"])


# -- ledger -------------------------------------------------------------------------------------------


@query("""SELECT count(*) AS row_count, count(DISTINCT l_orderkey) AS invoices, count(DISTINCT l_suppkey) AS customers, count(DISTINCT l_partkey) AS products, count(*) FILTER (WHERE l_suppkey IS NULL) AS no_customer, count(*) FILTER (WHERE l_quantity <= 0) AS non_positive_quantity, count(*) FILTER (WHERE l_extendedprice <= 0) AS non_positive_price, count(DISTINCT CASE WHEN upper(CAST(l_orderkey AS VARCHAR)) LIKE 'C%' THEN l_orderkey END) AS cancelled_invoices FROM lineitem""")
def ledger_census(spark, d):
    return ledger.census(t(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")


@query(f"""SELECT 'all' AS scope, count(*) AS row_count, sum(v) AS total FROM {_ITM} UNION ALL SELECT 'sales', count(*), sum(v) FROM {_ITM} WHERE NOT upper(CAST(l_orderkey AS VARCHAR)) LIKE 'C%' AND l_quantity > 0 AND l_extendedprice > 0 UNION ALL SELECT 'kept', count(*), sum(v) FROM {_ITM} WHERE l_returnflag <> 'R'""")
def ledger_reconciliation(spark, d):
    i = items(spark, d)
    return ledger.reconciliation(i, F.col("v"), {"all": F.lit(True), "sales": ledger.sales_scope("l_orderkey", "l_quantity", "l_extendedprice"), "kept": F.col("l_returnflag") != "R"})


@query(f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(v) AS revenue, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, CAST((SELECT max(o_orderdate) FROM orders) AS DATE) < CAST(date_trunc('month', o_orderdate) AS DATE) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS is_partial FROM {_ORD} GROUP BY 1, 5""")
def ledger_trends(spark, d):
    return ledger.trend(orders(spark, d), "o_orderdate", "month", F.col("v"), "o_orderkey", "o_custkey")


@query(f"""WITH p AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS o, sum(v) AS v FROM {_ORD} GROUP BY 1) SELECT count(*) AS customers, count(*) FILTER (WHERE o > 1) AS repeat_customers, round(100.0 * count(*) FILTER (WHERE o > 1) / count(*), 6) AS repeat_rate, round(100 * CAST(sum(CASE WHEN o > 1 THEN v ELSE 0 END) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 6) AS repeat_revenue_share FROM p""")
def repeat_block(spark, d):
    return rounded(ledger.repeat_block(orders(spark, d), "o_custkey", "o_orderkey", F.col("v")), "repeat_rate", "repeat_revenue_share")


# -- experiments and tests ----------------------------------------------------------------------------

_ARM = "CASE o_custkey % 2 WHEN 0 THEN 'control' ELSE 'offer' END"


def _arm() -> Column:
    return F.when(F.col("o_custkey") % 2 == 0, "control").otherwise("offer")


@query(f"SELECT {_ARM} AS arm, count(*) AS n, round(avg(CAST(o_totalprice AS DOUBLE)), 4) AS mean, round(var_samp(o_totalprice), 2) AS variance, count(*) FILTER (WHERE o_orderstatus = 'F') AS successes FROM orders GROUP BY 1")
def ab_arm_moments(spark, d):
    return experiment.arm_moments(t(spark, d, "orders"), _arm(), F.col("o_totalprice"), F.col("o_orderstatus") == "F").withColumn("mean", F.round("mean", 4)).withColumn("variance", F.round("variance", 2))


@query(f"""WITH b AS (SELECT o_custkey, {_ARM} AS arm, CAST(sum(CASE WHEN o_orderdate >= '2000-01-01' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS y, CAST(sum(CASE WHEN o_orderdate < '2000-01-01' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS x FROM orders GROUP BY 1, 2), q AS (SELECT covar_samp(y, x) / var_samp(x) AS theta, avg(x) AS m FROM b)
  SELECT arm, count(*) AS n, round(avg(y - theta * (x - m)), 3) AS adjusted_mean, round(max(theta), 8) AS theta FROM b, q GROUP BY 1""")
def cuped(spark, d):
    late = F.col("o_orderdate") >= "2000-01-01"
    b = orders(spark, d).groupBy("o_custkey").agg(F.sum(F.when(late, F.col("v")).otherwise(0)).alias("y"), F.sum(F.when(~late, F.col("v")).otherwise(0)).alias("x"))
    return experiment.cuped(b, F.col("y"), F.col("x")).groupBy(_arm().alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("adjusted"), 3).alias("adjusted_mean"), F.round(F.max("theta"), 8).alias("theta"))


@query("SELECT o_custkey % 2 = 1 AS treated, o_orderdate >= '2000-01-01' AS after, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(var_samp(o_totalprice), 2) AS variance FROM orders GROUP BY 1, 2")
def did_moments(spark, d):
    return experiment.did_moments(t(spark, d, "orders"), F.col("o_custkey") % 2 == 1, F.col("o_orderdate") >= "2000-01-01", F.col("o_totalprice")).withColumn("mean", F.round("mean", 4)).withColumn("variance", F.round("variance", 2))


@query()
def srm_counts(spark, d):
    """Arm sizes of a hash split; crc32 is Spark's, so rows only."""
    c = t(spark, d, "customer")
    return c.groupBy(experiment.assign(c, "c_custkey", ["control", "offer"], "s1").alias("arm")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 8) AS pearson, count(*) AS n FROM lineitem")
def corr_pearson(spark, d):
    return t(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("pearson"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM orders) SELECT round(corr(a, b), 8) AS spearman, count(*) AS n FROM r""")
def corr_spearman(spark, d):
    o = t(spark, d, "orders").select("o_totalprice", "o_custkey")
    return customers.ranks(o, {"o_totalprice": False, "o_custkey": False}).agg(F.round(F.corr("o_totalprice_rank", "o_custkey_rank"), 8).alias("spearman"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS grp, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(var_samp(o_totalprice), 2) AS variance FROM orders GROUP BY 1")
def anova_components(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.var_samp("o_totalprice"), 2).alias("variance"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def chi2_table(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT l_returnflag = 'R' AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS k FROM lineitem) SELECT g AS returned, count(*) AS n, CAST(sum(k) AS DOUBLE) AS rank_sum FROM r GROUP BY 1""")
def mann_whitney_ranks(spark, d):
    i = t(spark, d, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").alias("returned"))
    n = i.agg(F.count(F.lit(1)).alias("_t"))
    return customers.ranked(i, "l_quantity").crossJoin(F.broadcast(n)).groupBy("returned").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_quantity_rank") * F.col("_t")), 1).alias("rank_sum"))


@query("""WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 1000) / 10000.0 AS p FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM p), c AS (SELECT coalesce(max(k) FILTER (WHERE p <= 0.10 * k / m), 0) AS last FROM r) SELECT id, p :: DOUBLE AS p, k <= last AS significant FROM r, c""")
def bh_flags(spark, d):
    p = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 37 % 1000) / 10000.0).cast("double").alias("p"))
    r = p.withColumn("k", F.row_number().over(Window.orderBy("p", "id")))  # one row for each hypothesis
    m = r.agg(F.count(F.lit(1)).alias("m"))
    last = r.crossJoin(F.broadcast(m)).agg(F.coalesce(F.max(F.when(F.col("p") <= 0.10 * F.col("k") / F.col("m"), F.col("k"))), F.lit(0)).alias("last"))
    return r.crossJoin(F.broadcast(last)).select("id", "p", (F.col("k") <= F.col("last")).alias("significant"))


# -- privacy ------------------------------------------------------------------------------------------


@query("""SELECT 'c_name' AS "column", count(c_name) AS n, CAST(0 AS DOUBLE) AS payment_card, avg(CASE WHEN regexp_full_match(c_name, '[^@\\s]+@[^@\\s]+\\.[A-Za-z]{2,}') THEN 1.0 ELSE 0 END) :: DOUBLE AS email FROM customer""")
def pii_rates(spark, d):
    return privacy.value_shares(t(spark, d, "customer"), ["c_name"]).select("column", "n", "payment_card", "email")


@query("""WITH e AS (SELECT c_custkey, lower(c_mktsegment) || c_custkey || '@mail.example.com' AS email, '4539 5787 6362 1' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS card, '10.1.' || (c_custkey % 200) || '.7' AS ip, c_name FROM customer)
  SELECT c_custkey, left(split_part(email, '@', 1), 1) || repeat('*', greatest(3, length(split_part(email, '@', 1)) - 1)) || '@mail.example.com' AS email, '**** **** **** ' || right(regexp_replace(card, '[^0-9]', '', 'g'), 4) AS card, '10.1.x.x' AS ip, substr(sha256(c_name), 1, 6) AS token FROM e""")
def mask_values(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.col("c_custkey"), F.lit("@mail.example.com")).alias("email"), F.concat(F.lit("4539 5787 6362 1"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")).alias("card"), F.concat(F.lit("10.1."), F.col("c_custkey") % 200, F.lit(".7")).alias("ip"), "c_name")
    return c.select("c_custkey", masked("email", "email").alias("email"), masked("card", "payment_card").alias("card"), masked("ip", "ip_address").alias("ip"), pseudonym(F.col("c_name")).alias("token"))


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({c}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


@query(f"""SELECT n_name, {_FNV.format(c="n_name")} AS h FROM nation""")
def fnv_pseudonyms(spark, d):
    return t(spark, d, "nation").select("n_name", fnv1a(F.col("n_name")).alias("h"))


@query(f"""WITH e AS (SELECT c_custkey, c_name, lower(c_mktsegment) || '@mail.example.com' AS email FROM customer)
  SELECT c_custkey, repeat('•', least(length(c_name), 10)) AS gone, left(email, 1) || '•••@mail.example.com' AS mail, '••••' || right(c_name, 4) AS part, upper(left(c_name, 2)) || '•••' AS kind, 'ID-' || lpad(to_base({_FNV.format(c="c_name")}, 36), 7, '0') AS token FROM e""")
def sql_masks(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", F.concat(F.lower("c_mktsegment"), F.lit("@mail.example.com")).alias("email"))
    return c.select("c_custkey", redacted("c_name", "redact").alias("gone"), redacted("email", "partial").alias("mail"), redacted("c_name", "partial").alias("part"), redacted("c_name", "bucket").alias("kind"), redacted("c_name", "hash").alias("token"))


@query("""WITH o AS (SELECT *, date_trunc('day', o_orderdate) AS d FROM orders), b AS (SELECT count(*) AS n, count(*) * 6 AS cells, count_if(o_totalprice < 0) + count_if(o_orderdate > TIMESTAMP '1998-10-02' OR o_orderdate < TIMESTAMP '1970-01-01') AS invalid, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, stddev_samp(o_totalprice) AS sd, max(o_orderdate) AS latest,
  6 * count(*) - count(o_orderkey) - count(o_custkey) - count(o_orderstatus) - count(o_totalprice) - count(o_orderdate) - count(o_orderpriority) AS missing FROM orders),
  c AS (SELECT CAST(count(DISTINCT o_orderkey) <= 1 AS INT) + CAST(count(DISTINCT o_custkey) <= 1 AS INT) + CAST(count(DISTINCT o_orderstatus) <= 1 AS INT) + CAST(count(DISTINCT o_totalprice) <= 1 AS INT) + CAST(count(DISTINCT o_orderdate) <= 1 AS INT) + CAST(count(DISTINCT o_orderpriority) <= 1 AS INT) AS constant FROM orders),
  m AS (SELECT 1.4826 * median(abs(o_totalprice - med)) AS scale FROM orders, b), u AS (SELECT count(*) AS outliers FROM orders, b, m WHERE (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AND abs(o_totalprice - med) / CASE WHEN scale > 0 THEN scale ELSE sd END > 3.5),
  x AS (SELECT count(*) AS kinds FROM (SELECT DISTINCT * FROM orders)), s AS (SELECT coalesce(sum(n) FILTER (WHERE v <> trim(v) OR forms > 1), 0) AS spelt FROM (SELECT v, n, count(DISTINCT trim(v)) OVER (PARTITION BY k, lower(trim(v))) AS forms FROM (SELECT 1 AS k, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 2, o_orderpriority, count(*) FROM orders GROUP BY 2))),
  g AS (SELECT median(gap) AS gap FROM (SELECT epoch(o_orderdate) - lag(epoch(o_orderdate)) OVER (ORDER BY o_orderdate) AS gap FROM (SELECT DISTINCT o_orderdate FROM orders))), l AS (SELECT CASE WHEN gap <= 81 THEN 30 WHEN gap <= 4860 THEN 2 WHEN gap <= 116640 THEN 7 WHEN gap <= 816480 THEN 21 WHEN gap <= 3499200 THEN 75 WHEN gap <= 10497600 THEN 200 WHEN gap <= 42573600 THEN 500 ELSE 30 END AS tolerance FROM g),
  p AS (SELECT round(100 - 100.0 * missing / cells, 2) AS completeness, round(100 - least(200.0 * (n - kinds) / n, 100), 2) AS uniqueness, round(100 - least(400.0 * (invalid + spelt) / cells, 100), 2) AS validity, round(100 - least(100.0 * constant / 6, 40), 2) AS consistency, round(100 - least(150.0 * outliers / n, 100), 2) AS accuracy,
  round(greatest(0, least(100, 100 - 1.5 * greatest(0, date_diff('day', CAST(latest AS DATE), DATE '1998-10-01') - tolerance))), 2) AS timeliness FROM b, c, u, x, s, l)
  SELECT CAST(completeness AS DOUBLE) AS completeness, CAST(uniqueness AS DOUBLE) AS uniqueness, CAST(validity AS DOUBLE) AS validity, CAST(consistency AS DOUBLE) AS consistency, CAST(accuracy AS DOUBLE) AS accuracy, CAST(timeliness AS DOUBLE) AS timeliness, CAST(round(0.30 * completeness + 0.15 * uniqueness + 0.20 * validity + 0.10 * consistency + 0.15 * accuracy + 0.10 * timeliness, 2) AS DOUBLE) AS score FROM p""")
def quality_score(spark, d):
    return quality.dimensions(t(spark, d, "orders"), "1998-10-01", "o_orderdate", amounts=("o_totalprice",), categories=("o_orderstatus", "o_orderpriority"), measures=("o_totalprice",)).drop("critical")


# -- joins, sets, scalars -----------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= '2001-01-01'")
def join_inner(spark, d):
    return t(spark, d, "orders").where(F.col("o_orderdate") >= "2001-01-01").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def join_left_dim(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_semi(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= '2001-01-01')")
def join_anti(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where(F.col("o_orderdate") >= "2001-01-01"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders)")
def scalar_subquery(spark, d):
    o = t(spark, d, "orders")
    return o.crossJoin(F.broadcast(o.agg((F.avg("o_totalprice") * 2).alias("_m")))).where("o_totalprice > _m").select("o_orderkey", "o_totalprice")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_rows(spark, d):
    return t(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@query("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT CAST(n AS BIGINT) AS n FROM r")
def recursive_cte(spark, d):
    return spark.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT CAST(n AS BIGINT) AS n FROM r")


@query("""SELECT o_orderkey, CAST(date_diff('month', TIMESTAMP '1995-01-31', o_orderdate) AS BIGINT) AS months, date_diff('day', TIMESTAMP '1995-01-31', o_orderdate) AS days, md5(strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority) AS key, strftime(date_trunc('month', o_orderdate), '%b %Y') AS label, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS quarter_index, upper(trim(o_orderpriority)) AS up, lower(o_orderstatus) IN ('f') AS done FROM orders""")
def scalar_functions(spark, d):
    o = t(spark, d, "orders")
    start = F.lit("1995-01-31").cast("timestamp_ntz")
    return o.select("o_orderkey", month_steps(start, F.col("o_orderdate")).alias("months"), F.datediff("o_orderdate", start).cast("long").alias("days"), surrogate_key(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority")).alias("key"), period_label(F.date_trunc("month", "o_orderdate"), "month").alias("label"), calendar_index(F.col("o_orderdate"), "Q").alias("quarter_index"), F.upper(F.trim("o_orderpriority")).alias("up"), (F.lower("o_orderstatus") == "f").alias("done"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE lower(event_type) IN ('1', 'true', 'yes', 'y', 't')) AS truthy, count(DISTINCT json_extract_string(props, '$.k')) AS k FROM events GROUP BY 1")
def json_and_flags(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(truthy("event_type", "plugin")).alias("truthy"), F.count_distinct(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT count(DISTINCT concat_ws(chr(31), CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR))) AS row_keys FROM nation")
def row_keys(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.agg(F.count_distinct(row_key(n)).alias("row_keys"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i IN (SELECT CAST(floor(k * (SELECT count(*) FROM orders) / 100.0) AS BIGINT) FROM range(0, 100) x(k))")
def systematic_sample(spark, d):
    return readers.systematic_sample(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


# -- warehouse, dialect, demo -------------------------------------------------------------------------


@query("""WITH g AS (SELECT event_type AS pool, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) FILTER (WHERE value > 50) AS good, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, good / CAST(n AS DOUBLE) AS rate FROM g), w AS (SELECT *, lag(rate) OVER (PARTITION BY pool ORDER BY week) AS previous_rate FROM r)
  SELECT pool, week, good, n, round(rate, 6) AS rate, round(previous_rate, 6) AS previous_rate, round((rate - previous_rate) / nullif(previous_rate, 0), 6) AS change FROM w""")
def pool_mom_change(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("pool"), period("ts", "week").alias("week"), (F.col("value") > 50).cast("long").alias("good"), F.lit(1).cast("long").alias("n"))
    return rounded(warehouse.month_over_month(e, "pool", "week", "good", "n"), "rate", "previous_rate", "change")


@query("SELECT o_orderpriority, o_orderkey, date_diff('month', TIMESTAMP '1995-01-01', o_orderdate) AS m FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def console_qualify(spark, d):
    """A console statement in DuckDB's dialect, translated."""
    t(spark, d, "orders").createOrReplaceTempView("plumbline_console")
    sql = "SELECT \"o_orderpriority\", o_orderkey, date_diff('month', CAST('1995-01-01' AS TIMESTAMP), o_orderdate) AS m FROM plumbline_console QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 2"
    return spark.sql(dialect.translate(sql, "spark")[0]).withColumn("m", F.col("m").cast("long"))


@query(f"""WITH u AS (SELECT l_shipdate >= '2000-01-01' AS cur, CAST(v AS DOUBLE) AS v, unnest(['l_returnflag', 'l_linestatus', 'l_linenumber']) AS dimension, unnest([l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)]) AS segment FROM {_ITM} WHERE l_shipdate >= '1999-01-01' AND l_shipdate < '2001-01-01'),
  m AS (SELECT dimension, segment, coalesce(sum(v) FILTER (WHERE cur), 0) AS s1, coalesce(sum(v) FILTER (WHERE NOT cur), 0) AS s0 FROM u GROUP BY 1, 2), d AS (SELECT *, s1 - s0 AS delta, s1 - s0 - abs(s0) / sum(abs(s0)) OVER w * (sum(s1) OVER w - sum(s0) OVER w) AS excess FROM m WINDOW w AS (PARTITION BY dimension))
  SELECT dimension, count(*) AS segments, round(least(1.0, coalesce(sum(abs(excess)) / nullif(sum(abs(delta)), 0), 0)), 6) AS dispersion, round(coalesce(max(abs(excess)) / nullif(sum(abs(excess)), 0), 0), 6) AS concentration, round(coalesce(abs(sum(delta)) / nullif(sum(abs(delta)), 0), 0), 6) AS coverage FROM d GROUP BY 1""")
def demo_root_cause(spark, d):
    """How well three dimensions of the order lines explain the change of a year."""
    m = rootcause.segment_moments(items(spark, d), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_shipdate", "1999-01-01", "2000-01-01", "2001-01-01", F.col("v"))
    return rounded(rootcause.power(rootcause.additive(m)), "dispersion", "concentration", "coverage")


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_window_kpis(spark, d):
    """The streaming roll-up, applied to the table as a batch."""
    from plumbline.streaming.windows import window_kpis

    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return window_kpis(e, "ts", "value", ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# -- domains, profiles and exceptions -------------------------------------------------------------------


@query(f"""WITH s AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS period, CAST(sum(v) AS DOUBLE) AS revenue, CAST(sum(v) AS DOUBLE) / count(DISTINCT o_custkey) AS revenue_per_customer FROM {_ORD} GROUP BY 1),
  u AS (SELECT 'revenue' AS kpi_id, period, revenue AS value FROM s UNION ALL SELECT 'revenue_per_customer', period, revenue_per_customer FROM s), w AS (SELECT *, lag(value) OVER (PARTITION BY kpi_id ORDER BY period) AS previous FROM u)
  SELECT kpi_id, period, round(value, 4) AS value, round(value - previous, 4) AS delta, CASE WHEN abs(value - previous) < 1e-9 THEN 'flat' WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'flat' END AS direction, CASE WHEN abs(value - previous) >= 1e-9 THEN value > previous END AS favourable FROM w""")
def kpi_scorecard_sql(spark, d):
    s = kpi.scorecard(orders(spark, d), "o_orderdate", "year", ROLES, ["revenue", "revenue_per_customer"], "sql")
    return s.select("kpi_id", "period", F.round("value", 4).alias("value"), F.round("delta", 4).alias("delta"), "direction", "favourable")


@query(f"""SELECT o_orderstatus, round(CAST(sum(v) AS DOUBLE), 2) AS revenue, count(DISTINCT o_orderkey) AS orders, round(CAST(sum(v) AS DOUBLE) / count(DISTINCT o_orderkey), 6) AS aov, count(DISTINCT o_custkey) AS customers, round(CAST(count(DISTINCT o_orderkey) AS DOUBLE) / count(DISTINCT o_custkey), 6) AS purchase_frequency,
  round(3 * CAST(sum(v) AS DOUBLE) / count(DISTINCT o_custkey), 6) AS clv, round(CAST(sum(v) AS DOUBLE) / count(DISTINCT o_custkey), 6) AS revenue_per_customer FROM {_ORD} GROUP BY 1""")
def domain_kpis(spark, d):
    """The scorecard of a domain: the definitions its plugin names and the roles allow."""
    ids, first = domains.choose_kpis("ecommerce", ROLES)
    k = kpi.aggregate(orders(spark, d), ROLES, ids, [F.col("o_orderstatus")])
    return rounded(k.withColumn(first, F.round(F.col(first).cast("double"), 2)), *[i for i in ids if i not in ("orders", "customers", first)])


@query("""SELECT l_returnflag, round(CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 8) AS cost_per_click, round(100 * CAST(sum(l_linenumber) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 6) AS click_to_conversion, round(avg(l_linenumber), 6) AS average_length_of_stay,
  round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT l_suppkey), 4) AS revenue_per_account, count(DISTINCT l_partkey) AS merchant_reach, count(DISTINCT l_suppkey) AS patients_treated, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 2) AS total_output, round(avg(CAST(l_linenumber AS DOUBLE)), 6) AS average_downtime FROM lineitem GROUP BY 1""")
def plugin_kpis(spark, d):
    i = t(spark, d, "lineitem").withColumns({"tax": F.col("l_tax").cast("decimal(18,4)"), "qty": money("l_quantity"), "v": money("l_extendedprice")})
    roles = {"marketing_spend": "tax", "clicks": "qty", "conversions": "l_linenumber", "length_of_stay": "l_linenumber", "revenue": "v", "customer_id": "l_suppkey", "merchant_id": "l_partkey", "output": "qty", "downtime": "l_linenumber"}
    k = kpi.aggregate(i, roles, ["cost_per_click", "click_to_conversion", "average_length_of_stay", "revenue_per_account", "merchant_reach", "patients_treated", "total_output", "average_downtime"], [F.col("l_returnflag")])
    places = {"cost_per_click": 8, "click_to_conversion": 6, "average_length_of_stay": 6, "revenue_per_account": 4, "total_output": 2, "average_downtime": 6}
    return k.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in places.items()})


@query(f"""WITH r AS (SELECT CAST(monetary AS DOUBLE) AS v, row_number() OVER (ORDER BY monetary DESC) AS k, count(*) OVER () AS n FROM {_ACT}) SELECT max(n) AS customers, CAST(max(ceil(n * 0.1)) AS BIGINT) AS top, round(sum(v) FILTER (WHERE k <= ceil(n * 0.1)) / sum(v), 6) AS share_of_value FROM r""")
def value_concentration(spark, d):
    return customers.value_concentration(customers.activity(orders(spark, d), "o_custkey", "o_orderdate", F.col("v"))).withColumn("share_of_value", r6("share_of_value"))


@query(f"""WITH p AS (SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderpriority)) AS segment, CAST(sum(v) AS DOUBLE) AS v, count(*) AS n FROM {_ORD} GROUP BY 1), s AS (SELECT (floor((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400) + 1) / 30.4375 AS span FROM orders),
  g AS (SELECT segment, count(*) AS customers, sum(v) / sum(n) AS a, sum(n) / (count(*) * max(span)) AS f, sum(v) / count(*) AS h FROM p, s GROUP BY 1) SELECT segment, customers, round(a, 4) AS average_order_value, round(f, 8) AS purchases_per_period, round(a * f * 0.3 * (0.8 / 1.01) * (1 - power(0.8 / 1.01, 12)) / (1 - 0.8 / 1.01), 4) AS predicted_clv, round(h * 0.3, 4) AS historic_clv FROM g""")
def clv_segments(spark, d):
    c = customers.clv_segments(orders(spark, d), "o_custkey", "o_orderdate", F.col("v"), "o_orderpriority", retention=0.8, horizon=12)
    return c.withColumns({n: F.round(n, 8 if n == "purchases_per_period" else 4) for n in ("average_order_value", "purchases_per_period", "predicted_clv", "historic_clv")})


@query("""WITH v AS (SELECT DISTINCT 'lang' AS "column", lang AS x FROM documents WHERE lang IS NOT NULL UNION SELECT 'source', source FROM documents WHERE source IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY x) AS k FROM v) SELECT "column", string_agg(x, '|' ORDER BY x) AS samples FROM r WHERE k <= 5 GROUP BY 1""")
def sample_values(spark, d):
    return profile.sample_values(t(spark, d, "documents"), ["lang", "source"]).withColumn("samples", F.array_join("samples", "|"))


@query("SELECT bool_and(o_orderdate = date_trunc('day', o_orderdate)) AS all_midnight FROM orders")
def date_is_midnight(spark, d):
    return profile.midnight(t(spark, d, "orders"), "o_orderdate")


@query("""WITH c AS (SELECT 'one' AS "column", 1 AS distinct_values, count(*) AS n FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name), count(*) FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(*) FROM customer)
  SELECT * FROM (SELECT "column", CASE WHEN distinct_values <= 1 THEN 'constant' WHEN distinct_values > greatest(50, 0.5 * n) THEN 'cardinality' END AS issue, CASE WHEN distinct_values <= 1 THEN n ELSE distinct_values END AS affected FROM c) WHERE issue IS NOT NULL""")
def q_cardinality(spark, d):
    c = t(spark, d, "customer").select(F.lit(1).alias("one"), "c_name", "c_mktsegment")
    return profile.cardinality_issues(profile.counts(c), ["c_name", "c_mktsegment"])


@query("""WITH x AS (SELECT DISTINCT epoch(date_trunc('month', o_orderdate)) AS s FROM orders WHERE month(o_orderdate) NOT IN (4, 5)), g AS (SELECT s - lag(s) OVER (ORDER BY s) AS gap FROM x) SELECT 'monthly' AS granularity, count(*) FILTER (WHERE gap > 1.6 * 2592000) AS gaps FROM g HAVING count(*) FILTER (WHERE gap > 1.6 * 2592000) > 0""")
def q_gaps(spark, d):
    """Months without April and May: one gap a year, found from the steps between dates."""
    o = t(spark, d, "orders").where(~F.month("o_orderdate").isin(4, 5)).select(F.date_trunc("month", "o_orderdate").alias("m"))
    return profile.gap_issue(profile.date_granularity(o, "m"))


@query("""WITH s AS (SELECT event_type AS kpi_id, CAST(CAST(date_trunc('hour', ts) AS TIMESTAMP) AS VARCHAR) AS period, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2), m AS (SELECT kpi_id, median(value) AS med, 1.4826 * mad(value) AS d, count(*) AS n, max(period) AS last FROM s GROUP BY 1),
  z AS (SELECT kpi_id, period, value, med AS median, round(d, 6) AS mad, (value - med) / d AS zz, period = last AND value < med AS suppressed FROM s JOIN m USING (kpi_id) WHERE n >= 8 AND d > 0 AND d >= abs(med) * 1e-6), k AS (SELECT *, row_number() OVER (PARTITION BY suppressed ORDER BY abs(zz) DESC, kpi_id, period) AS place FROM z WHERE abs(zz) >= 3)
  SELECT kpi_id, period, value, median, mad, round(zz, 6) AS z, CASE WHEN zz > 0 THEN 'spike' ELSE 'dip' END AS kind, suppressed FROM k WHERE place <= CASE WHEN suppressed THEN 10 ELSE 30 END""")
def temporal_exceptions(spark, d):
    e = t(spark, d, "events").groupBy(F.col("event_type").alias("kpi_id"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("period")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return anomaly.temporal_exceptions(e, True).withColumn("mad", r6("mad")).withColumn("z", r6("z"))


@query("""SELECT 'email' AS "column", count(*) AS n, CAST(0 AS DOUBLE) AS dates, CAST(1 AS DOUBLE) AS email, CAST(0 AS DOUBLE) AS phone, CAST(0 AS DOUBLE) AS payment_card, CAST(0 AS DOUBLE) AS national_id FROM customer UNION ALL SELECT 'card', count(*), 0, 0, 0, 1, 0 FROM customer UNION ALL
  SELECT 'id', count(*), 0, 0, round(avg(CASE WHEN c_custkey % 4 > 0 THEN 1.0 ELSE 0 END), 6), 0, round(avg(CASE WHEN c_custkey % 4 > 0 THEN 1.0 ELSE 0 END), 6) FROM customer UNION ALL SELECT 'day', count(*), 1, 0, round(avg(1.0), 6), 0, 0 FROM customer""")
def pii_shares_sql(spark, d):
    """Shares of values by rule on columns made for the purpose; a date and an id of digits look like a telephone number to the rules."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer").select(F.concat(F.lit("u"), k, F.lit("@mail.example.com")).alias("email"), F.concat(F.lit("4539 5787 6362 1"), F.lpad((k % 1000).cast("string"), 3, "0")).alias("card"), F.when(k % 4 > 0, F.concat(F.lit("123-45-6"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise("none").alias("id"), F.concat(F.lit("2001-02-1"), k % 10).alias("day"))
    return rounded(privacy.sql_shares(c), "dates", "email", "phone", "payment_card", "national_id")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY sha256(concat(o_orderkey, ':7')), o_orderkey LIMIT 200")
def random_sample(spark, d):
    """A sampling operator: 200 rows, repeatable."""
    return readers.random_sample(t(spark, d, "orders"), "o_orderkey", 200).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE CAST(concat('0x', substr(sha256(concat(o_orderkey, ':7')), 1, 8)) AS BIGINT) < 429496729")
def share_sample(spark, d):
    """A sampling operator: one row in ten, repeatable."""
    return readers.share_sample(t(spark, d, "orders"), "o_orderkey", 10).select("o_orderkey", "o_custkey")


_NAMED = "SELECT o_orderkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS running, CAST(row_number() OVER w AS BIGINT) AS place FROM {o} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(_NAMED.format(o="orders"))
def named_window(spark, d):
    return spark.sql(_NAMED.format(o="{o}"), o=t(spark, d, "orders"))


@query(f"""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(v) AS DOUBLE) AS value FROM {_ORD} GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i, avg(value) OVER () AS level FROM m) SELECT CAST(i % 12 AS BIGINT) AS slot, count(*) AS n, round(avg(value), 4) AS mean, round(avg(value) / max(level), 6) AS relative FROM i GROUP BY 1""")
def season_slots(spark, d):
    return rounded(anomaly.slots(kpi.scorecard(orders(spark, d), "o_orderdate", "month", ROLES, ["revenue"]), 12), "relative").select("slot", "n", F.round("mean", 4).alias("mean"), "relative")


@query("""WITH r AS (SELECT l_returnflag = 'R' AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS k FROM lineitem), s AS (SELECT CAST(sum(k) FILTER (WHERE g) AS DOUBLE) AS rs, count(*) FILTER (WHERE g) AS n, count(*) FILTER (WHERE NOT g) AS m FROM r)
  SELECT n, m AS others, round(rs - n * (n + 1) / 2.0, 1) AS u, round(2 * (rs - n * (n + 1) / 2.0) / (CAST(n AS DOUBLE) * m) - 1, 8) AS cliffs_delta FROM s""")
def cliffs_delta(spark, d):
    """Quantity of returned lines against the others, from average ranks."""
    i = t(spark, d, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").alias("g"))
    total = i.agg(F.count(F.lit(1)).alias("_t"))
    s = customers.ranked(i, "l_quantity").crossJoin(F.broadcast(total)).agg(F.sum(F.when(F.col("g"), F.col("l_quantity_rank") * F.col("_t"))).alias("rs"), F.count_if("g").alias("n"), F.count_if(~F.col("g")).alias("others"))
    u = F.col("rs") - F.col("n") * (F.col("n") + 1) / 2
    return s.select("n", "others", F.round(u, 1).alias("u"), F.round(2 * u / (F.col("n").cast("double") * F.col("others")) - 1, 8).alias("cliffs_delta"))


@query("SELECT l_returnflag, true AS parts_close, true AS p90_close FROM lineitem GROUP BY 1")
def approx_within_bounds(spark, d):
    """Sketches against exact numbers: distinct parts within 15 %, the 90 % quantile between the exact 89 % and 91 % ones."""
    x = F.col("l_extendedprice")
    g = t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("a"), F.count_distinct("l_partkey").alias("e"), F.percentile_approx(x, 0.9).alias("p"), F.percentile(x, F.array(F.lit(0.89), F.lit(0.91))).alias("q"))
    return g.select("l_returnflag", (F.abs(F.col("a") - F.col("e")) <= 0.15 * F.col("e")).alias("parts_close"), F.col("p").between(F.col("q")[0], F.col("q")[1]).alias("p90_close"))


# -- a star schema over the order lines: a line is a block of calls ---------------------------------------

_CALLS = """(SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS call_month, l_returnflag AS campaign, l_linestatus AS pool, CAST(l_linenumber * 40 AS BIGINT) AS dials, CAST(l_linenumber * (4 + l_partkey % 9) AS BIGINT) AS connects, CAST(l_linenumber * 3 AS BIGINT) AS qualified_leads, CAST(l_linenumber AS BIGINT) AS conversions, CAST(l_linenumber AS DECIMAL(18,2)) AS campaign_spend, CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue FROM lineitem)"""


def _rate4(top: str, bottom: str) -> str:
    """A rate at four places, half up in whole numbers: a tie does not depend on how a double is stored."""
    return f"CAST((20000 * CAST(sum({top}) AS HUGEINT) + sum({bottom})) // (2 * sum({bottom})) AS DOUBLE) / 10000"


def _calls(spark, d) -> DataFrame:
    i, n = t(spark, d, "lineitem"), F.col("l_linenumber")
    raw = i.select(F.date_trunc("month", "l_shipdate").alias("call_date"), F.col("l_returnflag").alias("campaign"), F.col("l_linestatus").alias("caller_id_pool"), F.lit("human").alias("agent_type"), (n * 40).alias("dials"), (n * (4 + F.col("l_partkey") % 9)).alias("connects"), (n * 3).alias("qualified_leads"), n.alias("conversions"), F.lit(90.0).alias("qa_score"), n.alias("campaign_spend"), money("l_extendedprice").alias("revenue"))
    return warehouse.monthly_funnel(warehouse.staging(raw))


@query(f"""WITH g AS (SELECT pool, call_month, sum(connects) AS connects, sum(dials) AS dials, CAST(sum(connects) AS DOUBLE) / CAST(sum(dials) AS DOUBLE) AS rate FROM {_CALLS} GROUP BY 1, 2), m AS (SELECT *, lag(rate) OVER (PARTITION BY pool ORDER BY call_month) AS previous FROM g)
  SELECT pool AS caller_id_pool, call_month, CAST(connects AS BIGINT) AS connects, CAST(dials AS BIGINT) AS dials, round(rate, 6) AS rate, round(previous, 6) AS previous_rate, round((rate - previous) / previous, 6) AS change, md5(strftime(call_month, '%Y-%m-%d') || '|' || pool) AS pool_key, coalesce((rate - previous) / previous < -0.05, false) AS spam_flag_risk FROM m""")
def warehouse_pool_rates(spark, d):
    return rounded(warehouse.pool_health(_calls(spark, d), -0.05), "rate", "previous_rate", "change")


@query(f"""SELECT call_month, campaign, CAST(sum(dials) AS BIGINT) AS dials, CAST(sum(connects) AS BIGINT) AS connects, CAST(sum(qualified_leads) AS BIGINT) AS qualified_leads, CAST(sum(conversions) AS BIGINT) AS conversions, round(CAST(sum(campaign_spend) AS DOUBLE), 2) AS campaign_spend, round(CAST(sum(revenue) AS DOUBLE), 2) AS revenue, md5(strftime(call_month, '%Y-%m-%d') || '|' || campaign) AS campaign_key,
  {_rate4('connects', 'dials')} AS connect_rate, {_rate4('qualified_leads', 'connects')} AS qualification_rate, {_rate4('conversions', 'qualified_leads')} AS conversion_rate FROM {_CALLS} GROUP BY 1, 2""")
def warehouse_campaign_rates(spark, d):
    c = warehouse.campaign_performance(_calls(spark, d)).drop("cost_per_acquisition", "roas", "revenue_per_connect")
    return c.withColumns({n: F.round(F.col(n).cast("double"), 2) for n in ("campaign_spend", "revenue")})


@query(f"""SELECT CAST(sum(dials) AS BIGINT) AS dials, CAST(sum(connects) AS BIGINT) AS connects, CAST(sum(qualified_leads) AS BIGINT) AS qualified_leads, CAST(sum(conversions) AS BIGINT) AS conversions, round(CAST(sum(revenue) AS DOUBLE), 2) AS revenue, round(CAST(sum(campaign_spend) AS DOUBLE), 2) AS campaign_spend, round(CAST(sum(connects) AS DOUBLE) / sum(dials), 6) AS connect_rate, round(CAST(sum(conversions) AS DOUBLE) / sum(connects), 6) AS close_rate, round(CAST(sum(revenue) AS DOUBLE) / CAST(sum(campaign_spend) AS DOUBLE), 4) AS roas FROM {_CALLS} WHERE call_month = (SELECT CAST(date_trunc('month', max(l_shipdate)) AS DATE) FROM lineitem)""")
def warehouse_last_month(spark, d):
    s = rounded(warehouse.summary(_calls(spark, d)), "connect_rate", "close_rate")
    return s.withColumns({"revenue": F.round(F.col("revenue").cast("double"), 2), "campaign_spend": F.round(F.col("campaign_spend").cast("double"), 2), "roas": F.round(F.col("roas").cast("double"), 4)})


@query(f"""WITH m AS (SELECT call_month, sum(dials) AS dials, sum(connects) AS connects, sum(conversions) AS conversions FROM {_CALLS} GROUP BY 1), l AS (SELECT max(call_month) AS last FROM m)
  SELECT call_month, CAST(dials AS BIGINT) AS dials, CAST(connects AS BIGINT) AS connects, CAST(conversions AS BIGINT) AS conversions, round(CAST(connects AS DOUBLE) / dials, 6) AS connect_rate, round(CAST(conversions AS DOUBLE) / connects, 6) AS close_rate FROM m, l WHERE call_month >= last - INTERVAL 11 MONTH""")
def warehouse_trends(spark, d):
    return rounded(warehouse.trends(_calls(spark, d), 12), "connect_rate", "close_rate")


@query(f"SELECT count(*) AS months, min(call_month) AS first_month, max(call_month) AS last_month, CAST(0 AS BIGINT) AS broken_rows FROM (SELECT DISTINCT call_month FROM {_CALLS})")
def warehouse_health(spark, d):
    return warehouse.health(_calls(spark, d))


@query(f"""WITH g AS (SELECT pool, call_month, sum(connects) AS connects, sum(dials) AS dials, CAST(sum(connects) AS DOUBLE) / CAST(sum(dials) AS DOUBLE) AS rate FROM {_CALLS} GROUP BY 1, 2), m AS (SELECT *, lag(rate) OVER (PARTITION BY pool ORDER BY call_month) AS previous FROM g)
  SELECT pool AS caller_id_pool, call_month, CAST(connects AS BIGINT) AS connects, CAST(dials AS BIGINT) AS dials, round(rate, 6) AS rate, round(previous, 6) AS previous_rate, round((rate - previous) / previous, 6) AS change, md5(strftime(call_month, '%Y-%m-%d') || '|' || pool) AS pool_key, coalesce((rate - previous) / previous < -0.3, false) AS spam_flag_risk FROM m""")
def warehouse_pool_health(spark, d):
    return rounded(warehouse.pool_health(_calls(spark, d)), "rate", "previous_rate", "change")


@query(f"""WITH c AS (SELECT call_month, campaign, CAST(sum(conversions) AS BIGINT) AS conversions, CAST(sum(campaign_spend) AS DOUBLE) AS spend, md5(strftime(call_month, '%Y-%m-%d') || '|' || campaign) AS campaign_key FROM {_CALLS} GROUP BY 1, 2), k AS (SELECT l_returnflag AS campaign, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
  SELECT call_month, campaign, conversions, campaign_key, round(spend / conversions, 2) AS cost_per_acquisition, parts FROM c LEFT JOIN k USING (campaign)""")
def warehouse_campaigns(spark, d):
    """Campaigns with the columns of their dimension, a missing one null."""
    parts = t(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_returnflag").alias("campaign")).agg(F.count_distinct("l_partkey").alias("parts"))
    c = warehouse.campaign_performance(_calls(spark, d)).select("call_month", "campaign", "conversions", "campaign_key", F.col("cost_per_acquisition").cast("double").alias("cost_per_acquisition"))
    return warehouse.with_dim(c, parts, "campaign")


@query(f"""WITH c AS (SELECT * FROM {_CALLS} WHERE pool = 'F') SELECT CAST(sum(dials) AS BIGINT) AS dials, CAST(sum(connects) AS BIGINT) AS connects, CAST(sum(qualified_leads) AS BIGINT) AS qualified_leads, CAST(sum(conversions) AS BIGINT) AS conversions, round(CAST(sum(revenue) AS DOUBLE), 2) AS revenue, round(CAST(sum(campaign_spend) AS DOUBLE), 2) AS campaign_spend, round(CAST(sum(connects) AS DOUBLE) / sum(dials), 6) AS connect_rate, round(CAST(sum(conversions) AS DOUBLE) / sum(connects), 6) AS close_rate, round(CAST(sum(revenue) AS DOUBLE) / CAST(sum(campaign_spend) AS DOUBLE), 3) AS roas FROM c WHERE call_month = (SELECT max(call_month) FROM c)""")
def warehouse_summary(spark, d):
    """The last month of one pool."""
    s = rounded(warehouse.summary(_calls(spark, d).where("caller_id_pool = 'F'")), "connect_rate", "close_rate")
    return s.withColumns({"revenue": F.round(F.col("revenue").cast("double"), 2), "campaign_spend": F.round(F.col("campaign_spend").cast("double"), 2), "roas": F.round(F.col("roas").cast("double"), 3)})


# -- definitions and checks without a query of their own so far --------------------------------------------

_SUMS = {"revenue": "l_extendedprice", "units_sold": "l_quantity", "gross_profit": "l_tax", "impressions": "l_orderkey", "clicks": "l_partkey", "marketing_spend": "l_discount", "output_units": "l_quantity", "downtime": "l_linenumber"}
_MEANS = {"average_spend": "l_extendedprice", "average_salary": "l_suppkey", "average_tenure": "l_linenumber", "satisfaction": "l_tax", "avg_length_of_stay": "l_quantity"}
_RATIOS = {"ctr": ("l_partkey", "l_orderkey", 100), "conversion_rate": ("l_linenumber", "l_partkey", 100), "cpa": ("l_discount", "l_linenumber", 1), "cpc": ("l_discount", "l_partkey", 1), "cpm": ("l_discount", "l_orderkey", 1000)}
_PER = {"revenue_per_customer": 1, "revenue_per_employee": 1, "spend_per_cardholder": 1, "clv": 3}
_KPI_ROLES = {"revenue": "l_extendedprice", "quantity": "l_quantity", "profit": "l_tax", "impressions": "l_orderkey", "clicks": "l_partkey", "marketing_spend": "l_discount", "output": "l_quantity", "downtime": "l_linenumber", "salary": "l_suppkey", "tenure": "l_linenumber", "satisfaction": "l_tax", "length_of_stay": "l_quantity", "conversions": "l_linenumber", "customer_id": "l_suppkey", "employee_id": "l_suppkey", "order_id": "l_orderkey"}


@query("SELECT l_returnflag, " + ", ".join([*[f"round(sum(CAST({c} AS DOUBLE)), 2) AS {k}" for k, c in _SUMS.items()], *[f"round(avg(CAST({c} AS DOUBLE)), 6) AS {k}" for k, c in _MEANS.items()], *[f"round(sum(CAST({a} AS DOUBLE)) / sum(CAST({b} AS DOUBLE)) * {f}, 6) AS {k}" for k, (a, b, f) in _RATIOS.items()], *[f"round(sum(l_extendedprice) / count(DISTINCT l_suppkey) * {f}, 4) AS {k}" for k, f in _PER.items()], "CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS customers", "CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS headcount", "CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS orders", "CAST(count(*) AS DOUBLE) AS transaction_volume"]) + " FROM lineitem GROUP BY 1")
def kpi_definitions(spark, d):
    """Twenty-six definitions over one set of roles, in one aggregation."""
    ids = [*_SUMS, *_MEANS, *_RATIOS, *_PER, "customers", "headcount", "orders", "transaction_volume"]
    k = kpi.aggregate(t(spark, d, "lineitem"), _KPI_ROLES, ids, [F.col("l_returnflag")])
    places = {**dict.fromkeys(_SUMS, 2), **dict.fromkeys(_PER, 4)}
    return k.select("l_returnflag", *[F.round(F.col(c).cast("double"), places.get(c, 6)).alias(c) for c in ids])


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg(pow(({c} - m), 4)) / pow(var_pop({c}), 2) * pow((count(*) - 1.0) / count(*), 2) - 3, 6) AS kurtosis, round(avg(pow(({c} - m), 3)) / pow(var_pop({c}), 1.5) * pow((count(*) - 1.0) / count(*), 1.5), 6) AS skewness FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)""" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def profile_shape(spark, d):
    """Skewness and excess kurtosis by the sample deviation."""
    s = profile.numeric_summary(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(s, "kurtosis", "skewness").select("column", "kurtosis", "skewness")


@query("""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1), w AS (SELECT period, n, list(n) OVER (ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS past FROM m), x AS (SELECT *, list_aggregate(past, 'median') AS med FROM w)
  SELECT period, n, CAST(med AS DOUBLE) AS median, round(1.4826 * list_aggregate(list_transform(past, lambda v: abs(v - med)), 'median'), 6) AS mad FROM x""")
def rolling_mad(spark, d):
    """Median and median deviation of the twelve months before each."""
    m = t(spark, d, "orders").groupBy(period("o_orderdate", "month").alias("period")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    m = m.withColumn("past", F.collect_list("n").over(Window.orderBy("period").rowsBetween(-12, -1)))  # one row for each month
    mid = lambda a: F.when(F.size(a) > 0, (F.get(F.array_sort(a), F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))) / 2.0)
    m = m.withColumn("median", mid(F.col("past")))
    return m.select("period", "n", "median", F.round(1.4826 * mid(F.transform("past", lambda v: F.abs(v - F.col("median")))), 6).alias("mad"))


@query("""WITH s AS (SELECT r_name AS segment, n_name AS child, sum(v) AS total, sum(v) FILTER (WHERE yr = 2000) AS c, sum(v) FILTER (WHERE yr = 1999) AS b FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS v, year(o_orderdate) AS yr FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
  g AS (SELECT segment FROM s GROUP BY 1 ORDER BY sum(total) DESC, segment LIMIT 3), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY total DESC, child) AS k, sum(total) OVER (PARTITION BY segment) AS whole FROM s WHERE segment IN (SELECT segment FROM g))
  SELECT segment, child, total, round(CAST(total AS DOUBLE) / CAST(whole AS DOUBLE) * 100, 6) AS share, CAST(coalesce(c, 0) - coalesce(b, 0) AS DECIMAL(29,2)) AS delta FROM r WHERE k <= 4""")
def nested_changes(spark, d):
    """The largest nations of the largest regions: share of their region, change between two years."""
    o = orders(spark, d).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = segments.nested(o, "r_name", "n_name", F.col("v"), 3, 4, F.col("o_orderdate"), ("1999-01-01", "2000-01-01", "2001-01-01"))
    return rounded(n, "share").withColumn("delta", F.col("delta").cast("decimal(29,2)"))


@query("""SELECT c_mktsegment, count(*) FILTER (WHERE CAST(c_custkey % 3 AS VARCHAR) IN ('1', 'true', 'True', 'TRUE', 'yes', 'Yes', 'Y')) AS flagged, count(*) AS n FROM customer GROUP BY 1""")
def sql_flags(spark, d):
    """Rows whose value counts as true in the SQL profile."""
    from plumbline.functions.columns import sql_flag

    c = t(spark, d, "customer")
    return c.groupBy("c_mktsegment").agg(F.count_if(sql_flag((F.col("c_custkey") % 3).cast("string"))).alias("flagged"), F.count(F.lit(1)).alias("n"))
