"""Queries of root cause, keys and sketches, registered beside those of the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import causes, keys, kpi, ledger, sketches
from plumbline.plans import ledger_advice
from plumbline.plans.catalogue import ROLES, items, orders, query, r6, rounded, t

_SIDES = "sum(CASE WHEN {side} THEN 1 ELSE 0 END)"


@query("""WITH u AS (SELECT date_trunc('hour', ts) AS period, CAST(value AS DECIMAL(18,2)) AS v, unnest(['event_type', 'bucket']) AS dimension, unnest([event_type, CAST(user_id % 4 AS VARCHAR)]) AS segment FROM events),
  a AS (SELECT period, dimension, segment, sum(v) AS v FROM u GROUP BY 1, 2, 3),
  j AS (SELECT coalesce(c.period, b.period + INTERVAL 168 HOUR) AS period, coalesce(c.dimension, b.dimension) AS dimension, coalesce(c.segment, b.segment) AS segment, c.v AS cv, b.v AS bv FROM a c FULL JOIN a b ON c.period = b.period + INTERVAL 168 HOUR AND c.dimension = b.dimension AND c.segment = b.segment),
  k AS (SELECT *, count(cv) OVER w AS n1, count(bv) OVER w AS n0, coalesce(sum(cv) OVER w, 0) - coalesce(sum(bv) OVER w, 0) AS total, sum(abs(bv)) OVER w AS size FROM j WINDOW w AS (PARTITION BY period, dimension)),
  x AS (SELECT *, coalesce(cv, 0) - coalesce(bv, 0) AS delta, coalesce(CAST(abs(coalesce(bv, 0)) AS DOUBLE) / nullif(CAST(size AS DOUBLE), 0), 0) * CAST(total AS DOUBLE) AS expected FROM k WHERE n1 > 0 AND n0 > 0)
  SELECT strftime(period, '%Y-%m-%d %H') AS hour, dimension, segment, CAST(coalesce(bv, 0) AS DECIMAL(28,2)) AS baseline, CAST(coalesce(cv, 0) AS DECIMAL(28,2)) AS current, CAST(delta AS DECIMAL(28,2)) AS delta, round(expected, 6) AS expected, round(CAST(delta AS DOUBLE) - expected, 6) AS excess,
  round(CASE WHEN total <> 0 THEN CAST(delta AS DOUBLE) / CAST(total AS DOUBLE) * 100 END, 6) AS contribution FROM x""")
def rc_hour_of_week(spark, d):
    """Every hour of the events against the same hour of the week before, by type and group of users."""
    e = t(spark, d, "events").withColumn("bucket", (F.col("user_id") % 4).cast("string"))
    m = causes.seasonal_moves(e, ["event_type", "bucket"], "ts", "hour", 168, F.col("value").cast("decimal(18,2)"))
    cast = {c: F.col(c).cast("decimal(28,2)") for c in ("baseline", "current", "delta")}
    return rounded(m.withColumns(cast), "expected", "excess", "contribution").select(F.date_format("period", "yyyy-MM-dd HH").alias("hour"), "dimension", "segment", "baseline", "current", "delta", "expected", "excess", "contribution")


_ORD = "(SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)"
_SPAN = """p AS (SELECT date_trunc('{g}', {c}) AS a, row_number() OVER (ORDER BY date_trunc('{g}', {c}) DESC) AS i FROM {t} GROUP BY 1),
  s AS (SELECT max(CASE WHEN i = 1 THEN a END) AS now, coalesce(max(CASE WHEN i = {n} THEN a END), max(CASE WHEN i = 2 THEN a END)) AS was FROM p)"""
_DECOMPOSED = """x AS (SELECT *, s1 - s0 AS delta, CAST(sum(s1 - s0) OVER w AS DOUBLE) AS total, CAST(sum(abs(s0)) OVER w AS DOUBLE) AS size, CAST(sum(s1) OVER w AS DOUBLE) AS t1, CAST(sum(s0) OVER w AS DOUBLE) AS t0 FROM m WHERE n0 + n1 >= 15 WINDOW w AS (PARTITION BY dimension))"""


@query(f"""WITH {_SPAN.format(g="quarter", c="o_orderdate", t="orders", n=5)},
  u AS (SELECT date_trunc('quarter', o_orderdate) = now AS cur, CAST(v AS DOUBLE) AS v, unnest(['o_orderpriority', 'o_orderstatus', 'c_mktsegment']) AS dimension, unnest([o_orderpriority, o_orderstatus, c_mktsegment]) AS segment FROM {_ORD} JOIN customer ON o_custkey = c_custkey, s WHERE date_trunc('quarter', o_orderdate) IN (now, was)),
  m AS (SELECT dimension, segment, count(*) FILTER (WHERE NOT cur) AS n0, count(*) FILTER (WHERE cur) AS n1, coalesce(sum(v) FILTER (WHERE NOT cur), 0) AS s0, coalesce(sum(v) FILTER (WHERE cur), 0) AS s1 FROM u GROUP BY 1, 2), {_DECOMPOSED}
  SELECT dimension, segment, n0, n1, round(s0, 2) AS baseline, round(s1, 2) AS current, round(delta, 2) AS delta, round(delta / nullif(total, 0) * 100, 6) AS contribution, round(abs(s0) / nullif(size, 0) * total, 2) AS expected, round(delta - abs(s0) / nullif(size, 0) * total, 2) AS excess,
  round(CASE WHEN s0 <> 0 AND n1 > 0 THEN (s1 / s0 - t1 / t0) * 100 END, 6) AS growth_gap FROM x""")
def rc_seasonal_base(spark, d):
    """Order value of the last quarter against the same quarter a year before: what each segment brought, and what it would have brought."""
    o = orders(spark, d).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    spans = causes.compared(t(spark, d, "orders"), "o_orderdate", "quarter", 4)
    x = causes.decompose(causes.moments(o, ["o_orderpriority", "o_orderstatus", "c_mktsegment"], "o_orderdate", spans, F.col("v")))
    two = {c: F.round(F.col(c), 2) for c in ("delta", "expected", "excess")}
    return rounded(x.withColumns(two), "contribution", "growth_gap").select("dimension", "segment", "n0", "n1", F.round("s0", 2).alias("baseline"), F.round("s1", 2).alias("current"), "delta", "contribution", "expected", "excess", "growth_gap")


@query(f"""WITH {_SPAN.format(g="year", c="l_shipdate", t="lineitem", n=2)},
  u AS (SELECT date_trunc('year', l_shipdate) = now AS cur, l_extendedprice * l_discount AS v, l_extendedprice AS w, unnest(['l_returnflag', 'l_linestatus', 'l_linenumber']) AS dimension, unnest([l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)]) AS segment FROM lineitem, s WHERE date_trunc('year', l_shipdate) IN (now, was)),
  m AS (SELECT dimension, segment, count(*) AS n, coalesce(sum(v) FILTER (WHERE NOT cur), 0) AS s0, coalesce(sum(v) FILTER (WHERE cur), 0) AS s1, coalesce(sum(w) FILTER (WHERE NOT cur), 0) AS w0, coalesce(sum(w) FILTER (WHERE cur), 0) AS w1 FROM u GROUP BY 1, 2),
  y AS (SELECT *, s0 / nullif(w0, 0) AS r0, s1 / nullif(w1, 0) AS r1, coalesce(w0 / nullif(sum(w0) OVER d, 0), 0) AS b, coalesce(w1 / nullif(sum(w1) OVER d, 0), 0) AS a, sum(s0) OVER d / nullif(sum(w0) OVER d, 0) AS r FROM m WINDOW d AS (PARTITION BY dimension)),
  e AS (SELECT *, a * (r1 - r0) AS rate_effect, (a - b) * (r0 - r) AS mix_effect FROM y WHERE n >= 15), f AS (SELECT *, coalesce(rate_effect + mix_effect, coalesce(r1, 0) - coalesce(r0, 0)) AS delta FROM e)
  SELECT dimension, segment, round(r0, 8) AS baseline, round(r1, 8) AS current, round(rate_effect, 8) AS rate_effect, round(mix_effect, 8) AS mix_effect, round(b * sum(delta) OVER w, 8) AS expected, round(delta - b * sum(delta) OVER w, 8) AS excess FROM f WINDOW w AS (PARTITION BY dimension)""")
def rc_ratio_expected(spark, d):
    """The discount rate of the last year against the year before: rate and mix of each segment against its share of weight."""
    li = t(spark, d, "lineitem")
    spans = causes.compared(li, "l_shipdate", "year")
    x = causes.decompose(causes.moments(li, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_shipdate", spans, F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice")), False)
    eight = lambda c, name=None: F.round(F.col(c), 8).alias(name or c)
    return x.select("dimension", "segment", eight("value0", "baseline"), eight("value1", "current"), eight("rate_effect"), eight("mix_effect"), eight("expected"), eight("excess"))


@query(f"""WITH o AS (SELECT o_orderstatus, o_orderpriority, CASE WHEN v < 100000 THEN 'small' WHEN v < 200000 THEN 'middle' ELSE 'large' END AS size, CAST(v >= 150000 AS VARCHAR) AS big, v FROM {_ORD}),
  u AS (SELECT v, unnest(['o_orderstatus', 'o_orderpriority', 'size', 'big']) AS dimension, unnest([o_orderstatus, o_orderpriority, size, big]) AS segment FROM o),
  r AS (SELECT dimension, segment, min(v) AS low, max(v) AS high FROM u WHERE segment IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, low > lag(high) OVER (PARTITION BY dimension ORDER BY low, high) AS apart FROM r)
  SELECT dimension, count(*) AS segments, bool_and(coalesce(apart, true)) AND count(*) > 1 AS circular FROM n GROUP BY 1""")
def rc_circular_dimensions(spark, d):
    """Dimensions that only restate the order value cannot explain it; status and priority can."""
    o = orders(spark, d).withColumn("size", F.when(F.col("v") < 100000, "small").when(F.col("v") < 200000, "middle").otherwise("large")).withColumn("big", (F.col("v") >= 150000).cast("string"))
    return causes.circular(o, ["o_orderstatus", "o_orderpriority", "size", "big"], [F.col("v")])


@query(f"""WITH {_SPAN.format(g="quarter", c="o_orderdate", t="orders", n=5)},
  k AS (SELECT date_trunc('quarter', o_orderdate) = now AS cur, CAST(sum(v) AS DOUBLE) AS revenue, CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS orders, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS customers, CAST(sum(v) AS DOUBLE) / count(DISTINCT o_orderkey) AS aov FROM {_ORD}, s WHERE date_trunc('quarter', o_orderdate) IN (now, was) GROUP BY 1),
  l AS (UNPIVOT k ON revenue, orders, customers, aov INTO NAME kpi_id VALUE v), c AS (SELECT kpi_id, max(CASE WHEN cur THEN v END) AS current, max(CASE WHEN NOT cur THEN v END) AS baseline FROM l GROUP BY 1)
  SELECT kpi_id, round(current, 4) AS current, round(baseline, 4) AS baseline, round((current - baseline) / abs(baseline) * 100, 6) AS change, abs((current - baseline) / abs(baseline) * 100) < 3 AS exonerated FROM c WHERE kpi_id <> 'revenue' AND current IS NOT NULL AND baseline <> 0""")
def rc_companions(spark, d):
    """KPIs beside revenue that did not move with it between a quarter and the one a year before."""
    o = orders(spark, d)
    spans = causes.compared(o, "o_orderdate", "quarter", 4)
    sides = kpi.aggregate(o.where(spans.now("o_orderdate") | spans.then("o_orderdate")), ROLES, ["revenue", "orders", "customers", "aov"], [spans.now("o_orderdate").alias("_now")])
    tall = sides.select("_now", *[F.col(c).cast("double") for c in ("revenue", "orders", "customers", "aov")]).unpivot(["_now"], ["revenue", "orders", "customers", "aov"], "kpi_id", "v")
    values = tall.groupBy("kpi_id").agg(F.max(F.when(F.col("_now"), F.col("v"))).alias("current"), F.max(F.when(~F.col("_now"), F.col("v"))).alias("baseline"))
    four = {c: F.round(F.col(c), 4) for c in ("current", "baseline")}
    return causes.companions(values, "revenue").withColumn("change", r6("change")).withColumns(four)


def _drill_level(level: int) -> str:
    dims = ("l_returnflag", "l_linestatus", "bundle")
    keys = [f"p{i}" for i in range(1, level)]
    at = "".join(f"{k}, " for k in keys)
    joined = "" if level == 1 else f" JOIN o{level - 1} ON " + " AND ".join(f"{dims[i]} = p{i + 1}" for i in range(level - 1))
    least = 15 if level == 1 else 7
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    child = "" if level == 1 else " WHERE abs(contribution) >= 8 AND place <= 4"
    go = "place <= 3 AND " if level == 1 else ""
    return f"""m{level} AS (SELECT {at}{dims[level - 1]} AS segment, count(*) AS n, coalesce(sum(v) FILTER (WHERE NOT cur), 0) AS s0, coalesce(sum(v) FILTER (WHERE cur), 0) AS s1, count(*) FILTER (WHERE NOT cur) AS n0, count(*) FILTER (WHERE cur) AS n1 FROM r{joined} GROUP BY ALL),
    x{level} AS (SELECT *, s1 - s0 AS delta, (s1 - s0) / nullif(sum(s1 - s0) OVER w, 0) * 100 AS contribution, abs(s0) / nullif(sum(abs(s0)) OVER w, 0) * sum(s1 - s0) OVER w AS expected FROM m{level} WHERE n >= {least} WINDOW w AS ({part})),
    q{level} AS (SELECT *, row_number() OVER ({part} ORDER BY round(abs(contribution), 6) DESC, segment) AS place FROM x{level}), k{level} AS (SELECT * FROM q{level}{child}), o{level} AS (SELECT {at}segment AS p{level} FROM k{level} WHERE {go}abs(contribution) >= 10)"""


@query(f"""WITH {_SPAN.format(g="year", c="l_shipdate", t="lineitem", n=2)},
  r AS (SELECT l_returnflag, l_linestatus, CAST(l_linenumber % 4 AS VARCHAR) AS bundle, date_trunc('year', l_shipdate) = now AS cur, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS v FROM lineitem, s WHERE date_trunc('year', l_shipdate) IN (now, was)),
  {_drill_level(1)}, {_drill_level(2)}, {_drill_level(3)}, z AS (SELECT 1 AS level, NULL AS p1, NULL AS p2, segment, n0, n1, s0, s1, delta, contribution, expected FROM k1 UNION ALL SELECT 2, p1, NULL, segment, n0, n1, s0, s1, delta, contribution, expected FROM k2 UNION ALL SELECT 3, p1, p2, segment, n0, n1, s0, s1, delta, contribution, expected FROM k3)
  SELECT CAST(level AS INTEGER) AS level, CAST(p1 AS VARCHAR) AS p1, CAST(p2 AS VARCHAR) AS p2, segment, round(CASE WHEN n0 > 0 THEN s0 END, 2) AS value0, round(CASE WHEN n1 > 0 THEN s1 END, 2) AS value1, round(delta, 2) AS delta, round(contribution, 6) AS contribution, round(coalesce(expected, 0), 2) AS expected, round(delta - coalesce(expected, 0), 2) AS excess FROM z""")
def rc_drill_depth3(spark, d):
    """Three levels below the change of a year's order lines: only nodes in question are opened, a scan for each level."""
    li = items(spark, d).withColumn("bundle", (F.col("l_linenumber") % 4).cast("string"))
    spans = causes.compared(li, "l_shipdate", "year")
    x = causes.drill_down(li, ["l_returnflag", "l_linestatus", "bundle"], "l_shipdate", spans, F.col("v"))
    return rounded(x.withColumns({c: F.round(F.col(c), 2) for c in ("value0", "value1", "delta", "expected", "excess")}), "contribution")


_SQL_NODES = f"""{_SPAN.format(g="quarter", c="o_orderdate", t="orders", n=2)},
  u AS (SELECT date_trunc('quarter', o_orderdate) = now AS cur, CAST(v AS DOUBLE) AS v, unnest(['o_orderpriority', 'o_orderstatus', 'c_mktsegment', 'weekday']) AS dimension, unnest([o_orderpriority, o_orderstatus, c_mktsegment, CAST(isodow(o_orderdate) AS VARCHAR)]) AS segment FROM {_ORD} JOIN customer ON o_custkey = c_custkey, s WHERE date_trunc('quarter', o_orderdate) IN (now, was)),
  m AS (SELECT dimension, segment, count(*) FILTER (WHERE NOT cur) AS n0, count(*) FILTER (WHERE cur) AS n1, coalesce(sum(v) FILTER (WHERE NOT cur), 0) AS s0, coalesce(sum(v) FILTER (WHERE cur), 0) AS s1 FROM u GROUP BY 1, 2),
  w AS (SELECT *, sum(s1) OVER d AS c, sum(s0) OVER d AS b, count(*) OVER d AS k FROM m WINDOW d AS (PARTITION BY dimension)), tot AS (SELECT sum(s1) - sum(s0) AS total FROM m WHERE dimension = 'o_orderpriority'),
  n AS (SELECT dimension, segment, n1 AS rows_current, n0 AS rows_baseline, round(s1 - s0, 4) AS delta, round((s1 - s0) / nullif(total, 0) * 100, 2) AS contribution, (s1 - s0) / nullif(total, 0) * 100 AS raw, s1 - s0 AS d, total, round(coalesce(s1 / nullif(c, 0) * 100, 0), 2) AS share_current, round(coalesce(s0 / nullif(b, 0) * 100, 0), 2) AS share_baseline,
    round(s0 * coalesce(c / nullif(b, 0) - 1, 0), 4) AS expected, round(s1 - s0 - s0 * coalesce(c / nullif(b, 0) - 1, 0), 4) AS excess, round((s1 / nullif(s0, 0) - 1 - coalesce(c / nullif(b, 0) - 1, 0)) * 100, 2) AS growth_gap FROM w, tot WHERE k BETWEEN 2 AND 40),
  y AS (SELECT * EXCLUDE (raw, d, total), CASE WHEN abs(raw) >= 10 AND total <> 0 AND sign(d) = sign(total) THEN 'driver' WHEN abs(raw) >= 10 THEN 'offset' ELSE 'stable' END AS role FROM n)"""


def _sql_nodes(spark, d):
    o = orders(spark, d).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("weekday", (F.weekday("o_orderdate") + 1).cast("string"))
    spans = causes.compared(t(spark, d, "orders"), "o_orderdate", "quarter")
    m = causes.moments(o, ["o_orderpriority", "o_orderstatus", "c_mktsegment", "weekday"], "o_orderdate", spans, F.col("v"))
    whole = m.where("dimension = 'o_orderpriority'").agg(F.sum("s1") - F.sum("s0")).first()[0]
    return causes.sql_nodes(m, whole), whole


@query(f"WITH {_SQL_NODES} SELECT * FROM y")
def rc_sql_nodes(spark, d):
    """Segments of a quarter's change by the SQL profile: growth-scaled expectation, driver, offset or stable."""
    return _sql_nodes(spark, d)[0]


@query(f"""WITH {_SQL_NODES}, h AS (SELECT *, abs(delta) / nullif(sum(abs(delta)) OVER (PARTITION BY dimension), 0) AS s FROM y),
  g AS (SELECT dimension, coalesce(coalesce(sum(delta) FILTER (WHERE role = 'driver'), 0) / nullif((SELECT total FROM tot), 0) * 100, 0) AS net, round(sum(coalesce(s, 0) * coalesce(s, 0)), 4) AS concentration, round(max(coalesce(growth_gap, 0)) - min(coalesce(growth_gap, 0)), 2) AS dispersion, count(*) AS segments FROM h GROUP BY 1),
  o AS (SELECT *, least(1.0, greatest(0.0, abs(net) / 100 * 0.6 + concentration * 0.4)) AS p FROM g)
  SELECT dimension, round(p, 3) AS power, concentration, dispersion, round(net, 2) AS net_coverage, segments, CASE WHEN p >= 0.55 THEN 'most' WHEN p >= 0.3 THEN 'partly' ELSE 'not' END AS verdict FROM o""")
def rc_sql_powers(spark, d):
    """How well each dimension explains a quarter's change by the SQL profile: coverage by drivers and concentration."""
    nodes, whole = _sql_nodes(spark, d)
    return causes.sql_powers(nodes, whole)


# -- keys, sketches and order of arrival --------------------------------------------------------------

_FK = {"region": "r_regionkey n r_name s", "nation": "n_nationkey n n_name s n_regionkey n", "customer": "c_custkey n c_name s c_nationkey n c_acctbal n c_mktsegment s", "supplier": "s_suppkey n s_name s s_nationkey n s_acctbal n", "part": "p_partkey n p_name s p_brand s p_type s p_size n p_retailprice n", "orders": "o_orderkey n o_custkey n o_orderstatus s o_totalprice n o_orderpriority s", "lineitem": "l_orderkey n l_partkey n l_suppkey n l_linenumber n l_quantity n l_extendedprice n l_discount n l_tax n l_returnflag s l_linestatus s", "documents": "doc_id n lang s source s n_chars n", "labels": "doc_id n quality n toxic n", "benchmark": "item_id n"}
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id", "benchmark": "item_id"}


def _fk_values() -> str:
    out = []
    for table, cols in _FK.items():
        names = cols.split()
        for c, k in zip(names[::2], names[1::2]):
            value = f"CASE WHEN {c} = round({c}) THEN 'n' || CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE 'n' || CAST(CAST({c} AS DOUBLE) AS VARCHAR) END" if k == "n" else f"'s' || {c}"
            out.append(f"SELECT DISTINCT '{table}.{c}' AS c, {value} AS v FROM {table} WHERE {c} IS NOT NULL")
    return " UNION ALL ".join(out)


_PARENTS = ", ".join(f"'{name}.{c}'" for name, c in _KEYS.items())


@query(f"""WITH v AS ({_fk_values()}), n AS (SELECT c, count(*) AS n FROM v GROUP BY 1), p AS (SELECT a.c AS child, b.c AS parent, count(*) AS matched FROM v a JOIN v b ON a.v = b.v WHERE b.c IN ({_PARENTS}) AND split_part(a.c, '.', 1) <> split_part(b.c, '.', 1) GROUP BY 1, 2),
  r AS (SELECT child, parent, matched, CAST(matched AS DOUBLE) / x.n AS ratio, split_part(child, '.', 2) AS cn, split_part(parent, '.', 2) AS pn FROM p JOIN n x ON x.c = child JOIN n y ON y.c = parent WHERE x.n >= 2 AND x.n <= y.n),
  s AS (SELECT child, parent, matched, ratio, round(least(1.0, ratio + CASE WHEN cn = pn THEN 0.05 WHEN regexp_matches(cn, '{keys.KEY_NAME}') THEN 0.02 ELSE -0.10 END), 4) AS confidence FROM r WHERE ratio >= 0.95) SELECT child, parent, matched, round(ratio, 4) AS ratio, confidence FROM s WHERE confidence >= 0.95""")
def foreign_key_candidates(spark, d):
    """References between ten tables by the values their columns share: one inverted index for all pairs of columns."""
    tables = {name: t(spark, d, name).select(*cols.split()[::2]) for name, cols in _FK.items()}
    return keys.foreign_keys(tables, _KEYS)


_SKETCHED = ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, " + (f"CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std" if c != "l_returnflag" else "NULL AS low, NULL AS high, NULL AS mean, NULL AS std") + ", true AS distinct_close, true AS quantiles_close FROM lineitem" for c in _SKETCHED))
def profile_sketches(spark, d):
    """Lines sketched by month and merged, as a store of daily sketches would be; counts and moments are exact, estimates are held against exact numbers."""
    li = t(spark, d, "lineitem")
    parts = sketches.column_sketches(li.select(F.date_trunc("month", "l_shipdate").alias("month"), *_SKETCHED), ["month"])
    cuts = (0.25, 0.5, 0.75)
    e = sketches.ranks(li, sketches.estimates(sketches.merge(parts), cuts), [c for c in _SKETCHED if c != "l_returnflag"], len(cuts))
    exact = reduce(DataFrame.unionAll, [li.agg(F.count_distinct(c).alias("u")).select(F.lit(c).alias("column"), "u") for c in _SKETCHED])  # a shuffle of one column each
    close = F.abs(F.col("distinct_values") - F.col("u")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_ERROR * F.col("u"))
    place = lambda p: F.lit(p) * (F.col("n") - 1)  # noqa: E731  of the exact quantile; an estimate is a value of the column, so it is held against both by its rank
    low, high = ([place(p + s * sketches.RANK_ERROR) for p in cuts] for s in (-1, 1))
    inside = F.col("quantiles").isNull() | reduce(Column.__and__, [(F.col("upto")[i] > F.ceil(low[i])) & (F.col("below")[i] <= F.floor(high[i])) for i in range(len(cuts))])
    return rounded(e.join(F.broadcast(exact), "column"), "mean", "std").select("column", "n", "missing", "low", "high", "mean", "std", close.alias("distinct_close"), inside.alias("quantiles_close"))


@query("""WITH x AS (SELECT 'event' AS of, CAST(ts AS TIMESTAMP) < lag(CAST(ts AS TIMESTAMP)) OVER (ORDER BY event_id) AS fell FROM events UNION ALL SELECT 'value', value < lag(value) OVER (ORDER BY event_id) FROM events UNION ALL SELECT 'order', o_orderdate < lag(o_orderdate) OVER (ORDER BY o_orderkey) FROM orders)
  SELECT of, count(*) AS rows, count(*) FILTER (WHERE fell) AS breaks, count(*) FILTER (WHERE fell) = 0 AS monotonic FROM x GROUP BY 1""")
def monotonic_columns(spark, d):
    """Whether times and values rise with the numbers in which rows arrived."""
    e, o = t(spark, d, "events"), t(spark, d, "orders")
    made = [keys.monotonic(e, "ts", "event_id").withColumn("of", F.lit("event")), keys.monotonic(e, "value", "event_id").withColumn("of", F.lit("value")), keys.monotonic(o, "o_orderdate", "o_orderkey").withColumn("of", F.lit("order"))]
    return made[0].unionAll(made[1]).unionAll(made[2]).select("of", "rows", "breaks", "monotonic")


# -- a ledger made of the order lines -------------------------------------------------------------------

_LEDGER = """l AS (SELECT CASE WHEN l_returnflag = 'R' AND l_orderkey % 3 = 0 THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice, CASE WHEN l_suppkey % 10 > 0 THEN l_suppkey END AS customer, CASE WHEN l_returnflag = 'R' AND l_orderkey % 3 = 0 OR l_linenumber = 7 THEN -l_quantity WHEN l_quantity = 50 THEN 0 ELSE l_quantity END AS quantity,
  CASE WHEN l_discount > 0.09 THEN 0 ELSE l_extendedprice END AS price, CASE WHEN l_tax > 0.01 THEN 'part' END AS description, l_shipdate AS date FROM lineitem)"""
_ROLES = {"invoice": "invoice", "customer": "customer", "quantity": "quantity", "price": "price", "description": "description", "date": "date"}
_SALE = "invoice NOT LIKE 'C%' AND quantity > 0 AND price > 0"


def _ledger(spark, d):
    back = (F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 3 == 0)
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").select(F.concat(F.when(back, "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("invoice"), F.when(F.col("l_suppkey") % 10 > 0, F.col("l_suppkey")).alias("customer"), F.when(back | (F.col("l_linenumber") == 7), -q).when(q == 50, 0).otherwise(q).alias("quantity"), F.when(F.col("l_discount") > 0.09, 0).otherwise(F.col("l_extendedprice")).alias("price"), F.when(F.col("l_tax") > 0.01, "part").alias("description"), F.col("l_shipdate").alias("date"))


_COUNTED = " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {when}) AS rows, '{what}' AS treatment FROM l" for name, when, what in (("cancelled", "invoice LIKE 'C%'", "held out"), ("negative_quantity", "quantity < 0 AND invoice NOT LIKE 'C%'", "excluded"), ("zero_quantity", "quantity = 0", "excluded"), ("non_positive_price", "price <= 0", "excluded"), ("missing_customer", "customer IS NULL", "kept for revenue"), ("missing_description", "description IS NULL", "kept")))


@query(f"""WITH {_LEDGER}, r AS ({_COUNTED} UNION ALL SELECT 'duplicates', (SELECT count(*) FROM l) - (SELECT count(*) FROM (SELECT DISTINCT * FROM l)), 'reported'), p AS (SELECT *, 100.0 * rows / (SELECT count(*) FROM l) AS pct FROM r WHERE rows > 0)
  SELECT rule, rows, round(pct, 4) AS pct, treatment, CASE WHEN pct >= 20 THEN 'high' WHEN pct >= 5 THEN 'medium' ELSE 'low' END AS severity FROM p""")
def ledger_quality_rules(spark, d):
    """What the rules of a ledger find among order lines written as invoices: one scan, one table of rules."""
    return ledger.quality_rules(_ledger(spark, d), _ROLES)


@query(f"""WITH {_LEDGER}, s AS (SELECT *, CAST(quantity * 100 AS BIGINT) * CAST(round(price * 100) AS BIGINT) AS cents FROM l WHERE {_SALE}), a AS (SELECT CAST(sum(cents) AS DOUBLE) / 10000 AS revenue, CAST(count(DISTINCT invoice) AS DOUBLE) AS orders, CAST(sum(quantity) AS DOUBLE) AS units, CAST(count(DISTINCT customer) AS DOUBLE) AS customers FROM s),
  c AS (SELECT CAST(count(DISTINCT invoice) FILTER (WHERE invoice LIKE 'C%') AS DOUBLE) AS x, CAST(count(DISTINCT invoice) AS DOUBLE) AS y FROM l), p AS (SELECT customer, count(DISTINCT invoice) AS n FROM s WHERE customer IS NOT NULL GROUP BY 1), r AS (SELECT CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM p),
  u AS (SELECT 'revenue' AS kpi, 'sales' AS scope, revenue AS value, NULL AS numerator, NULL AS denominator FROM a UNION ALL SELECT 'orders', 'sales', orders, NULL, NULL FROM a UNION ALL SELECT 'units', 'sales', units, NULL, NULL FROM a UNION ALL SELECT 'customers', 'sales', customers, NULL, NULL FROM a UNION ALL SELECT 'aov', 'sales', revenue / orders, revenue, orders FROM a UNION ALL SELECT 'repeat_rate', 'identified customers', x / y * 100, x, y FROM r UNION ALL SELECT 'cancellation_rate', 'all', x / y * 100, x, y FROM c)
  SELECT kpi, scope, round(value, 2) AS value, round(CAST(numerator AS DOUBLE), 2) AS numerator, round(CAST(denominator AS DOUBLE), 2) AS denominator FROM u""")
def ledger_kpis(spark, d):
    """A ledger's figures: completed sales, identified customers and all invoices, each with its parts."""
    value = F.col("quantity").cast("decimal(12,2)") * F.round("price", 2).cast("decimal(14,2)")
    k = ledger.kpis(_ledger(spark, d), _ROLES, value)
    return k.withColumns({c: F.round(c, 2) for c in ("value", "numerator", "denominator")})


@query(f"""WITH {_LEDGER} SELECT count(*) AS rows, count(*) FILTER (WHERE {_SALE}) AS in_scope, strftime(min(date) FILTER (WHERE {_SALE}), '%Y-%m-%d %H') AS first, strftime(max(date) FILTER (WHERE {_SALE}), '%Y-%m-%d %H') AS last, hour(max(date) FILTER (WHERE {_SALE})) < 23 AS partial FROM l""")
def ledger_coverage(spark, d):
    """What completed sales cover, and whether their last day is cut short."""
    c = ledger.coverage(_ledger(spark, d), _ROLES)
    return c.withColumns({x: F.date_format(x, "yyyy-MM-dd HH") for x in ("first", "last")})


_SQL_KPIS = {"order_value_sql": "sum({revenue}) / count(DISTINCT {order_id})", "large_share_sql": "100.0 * count_if({revenue} > 200000) / count(*)", "net_sql": "sum({revenue} * (1 - coalesce({discount}, 0)))"}


@query("""SELECT l_returnflag, round(sum(l_extendedprice) / count(DISTINCT l_orderkey), 4) AS order_value_sql, round(100.0 * count(*) FILTER (WHERE l_extendedprice > 200000) / count(*), 6) AS large_share_sql, round(sum(l_extendedprice * (1 - coalesce(l_discount, 0))), 2) AS net_sql FROM lineitem GROUP BY 1""")
def kpi_sql_templates(spark, d):
    """Definitions written as SQL over roles, beside the built-in ones, in one aggregation."""
    for name, text in _SQL_KPIS.items():
        kpi.from_sql(name, text)
    try:
        k = kpi.aggregate(t(spark, d, "lineitem"), {"revenue": "l_extendedprice", "order_id": "l_orderkey", "discount": "l_discount"}, list(_SQL_KPIS), [F.col("l_returnflag")])
    finally:
        for name in _SQL_KPIS:
            kpi.REGISTRY.pop(name)
    return k.withColumns({c: F.round(c, n) for c, n in zip(_SQL_KPIS, (4, 6, 2))})


@query(f"""WITH {_LEDGER}, s AS (SELECT *, CAST(quantity * 100 AS BIGINT) * CAST(round(price * 100) AS BIGINT) / 10000.0 AS v FROM l WHERE {_SALE}), p AS (SELECT customer, count(DISTINCT invoice) AS n, sum(v) AS v, count(*) AS lines FROM s GROUP BY 1),
  k AS (SELECT customer, v, row_number() OVER (ORDER BY v DESC, customer) AS pos, sum(v) OVER (ORDER BY v DESC, customer ROWS UNBOUNDED PRECEDING) / sum(v) OVER () * 100 AS cum FROM p WHERE customer IS NOT NULL AND v > 0), t AS (SELECT count(*) AS entities, min(pos) FILTER (WHERE cum >= 80) AS for80, sum(v) AS total FROM k),
  f AS (SELECT sum(v) AS revenue, count(*) FILTER (WHERE customer IS NOT NULL) AS known, count(*) FILTER (WHERE customer IS NOT NULL AND n > 1) AS many, coalesce(sum(v) FILTER (WHERE customer IS NOT NULL AND n > 1), 0) AS mv, coalesce(sum(v) FILTER (WHERE customer IS NULL), 0) AS av, 100.0 * coalesce(sum(lines) FILTER (WHERE customer IS NULL), 0) / sum(lines) AS apct FROM p),
  g AS (SELECT 100.0 * count(DISTINCT invoice) FILTER (WHERE invoice LIKE 'C%') / count(DISTINCT invoice) AS rate FROM l), b AS (SELECT CASE WHEN n <= 2 THEN 'Few' WHEN n <= 40 THEN 'Some' ELSE 'Many' END AS segment, count(*) AS customers, sum(v) AS value FROM p WHERE customer IS NOT NULL GROUP BY 1),
  c AS (SELECT segment, value, value / customers / (sum(value) OVER () / sum(customers) OVER ()) AS lift, customers, count(*) OVER () AS bands FROM b), d AS (SELECT * FROM c WHERE bands >= 3 AND customers >= 10 ORDER BY lift DESC, segment LIMIT 1),
  r AS (SELECT 'activation' AS rule, 'growth' AS category, 'repeat_rate' AS metric, 'One-time customers' AS segment, least(92, 45 + (100 - 100.0 * many / known) * 0.4) AS score, 0.55 AS confidence, greatest(0, coalesce(mv / nullif(many, 0), 0) - greatest(0, revenue - mv) / nullif(known - many, 0)) * (known - many) * 0.05 AS impact, true AS hypothesis FROM f WHERE known - many >= 20
    UNION ALL SELECT 'retention', 'retention', 'revenue', 'Top customers', least(95, 105 - 100.0 * for80 / entities), 0.78, total * 0.02, true FROM t WHERE entities >= 20 AND 100.0 * for80 / entities <= 45 UNION ALL SELECT 'cancellations', 'operations', 'cancellation_rate', 'Cancelled invoices', least(88, 40 + rate * 6), 0.8, NULL, false FROM g WHERE rate >= 1
    UNION ALL SELECT 'identity', 'data', 'customers', 'Unidentified transactions', least(90, 40 + apct), 0.85, av, false FROM f WHERE apct >= 10 UNION ALL SELECT 'targeting', 'growth', 'revenue', segment, least(85, 40 + (lift - 1) * 30), 0.5, value * 0.03, true FROM d WHERE lift >= 1.2 UNION ALL SELECT 'quality_gate', 'data-quality', NULL, NULL, 75, 0.9, NULL, false)
  SELECT rule, category, metric, segment, round(CAST(score AS DOUBLE), 1) AS score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS priority, round(CASE WHEN rule = 'quality_gate' THEN confidence ELSE CAST(confidence AS DOUBLE) * 0.7 END, 2) AS confidence, round(CAST(impact AS DOUBLE), 2) AS impact, hypothesis, rule = 'quality_gate' AS act FROM r""")
def ledger_recommendations(spark, d):
    """What the made ledger asks for where data quality is poor: all but its repair are to be looked into."""
    df = _ledger(spark, d)
    value = F.col("quantity").cast("decimal(12,2)") * F.round("price", 2).cast("decimal(14,2)")
    sale = df.where(ledger.in_scope(_ROLES)).where("customer IS NOT NULL").groupBy("customer").agg(F.count_distinct("invoice").alias("n"), F.sum(value).cast("double").alias("v"))
    bands = sale.groupBy(F.when(F.col("n") <= 2, "Few").when(F.col("n") <= 40, "Some").otherwise("Many").alias("segment")).agg(F.count(F.lit(1)).alias("customers"), F.sum("v").alias("value"))
    return ledger_advice.advise(ledger_advice.facts(df, _ROLES, value), bands, 65.0)
