"""Queries of series, kinds of columns, domains and governance, registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.columns import period
from plumbline.operators import outlook
from plumbline.plans import governance, kinds
from plumbline.plans import vocabulary as V
from plumbline.plans.catalogue import money, orders, query, r6, t

_LONG = """m AS (SELECT o_orderpriority AS kpi_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY kpi_id) AS n, lead(value) OVER w AS following FROM m WINDOW w AS (PARTITION BY kpi_id ORDER BY period))"""
_STATES = f"""{_LONG}, st AS (SELECT kpi_id, i, n, value AS y, value AS ses, value AS lvl, coalesce(following, value) - value AS slope FROM r WHERE i = 0 UNION ALL
  SELECT r.kpi_id, r.i, r.n, r.value, st.ses + 0.35 * (r.value - st.ses), 0.4 * r.value + 0.6 * (st.lvl + 0.9 * st.slope), 0.15 * ((0.4 * r.value + 0.6 * (st.lvl + 0.9 * st.slope)) - st.lvl) + 0.85 * 0.9 * st.slope FROM st JOIN r ON r.kpi_id = st.kpi_id AND r.i = st.i + 1),
  e AS (SELECT b.kpi_id, b.y, abs(b.y - a.y) AS step, unnest(['naive', 'ses', 'holt']) AS model, unnest([b.y - a.y, b.y - a.ses, b.y - (a.lvl + 0.9 * a.slope)]) AS e FROM st a JOIN st b ON a.kpi_id = b.kpi_id AND b.i = a.i + 1 WHERE b.i >= greatest(4, b.n // 2)),
  bt AS (SELECT kpi_id, model, round(avg(abs(e)) / CASE WHEN avg(step) = 0 THEN 1e-9 ELSE avg(step) END, 4) AS mase, round(coalesce(avg(100 * abs(e / y)) FILTER (WHERE abs(y) > 1e-9), 0), 4) AS mape, round(sqrt(avg(e * e)), 4) AS rmse, count(*) AS folds FROM e GROUP BY 1, 2 HAVING count(*) >= 3)"""


def _long(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kpi_id"), period("o_orderdate", "month").alias("period")).agg(F.sum(money("o_totalprice")).cast("double").alias("value"))


@query(f"""WITH {_LONG}, s AS (SELECT kpi_id, i % 12 AS slot, avg(value) AS mean, min_by(period, i) AS label, any_value(n) AS n FROM r GROUP BY 1, 2), l AS (SELECT kpi_id, avg(value) AS level FROM r GROUP BY 1),
  g AS (SELECT kpi_id, any_value(n) AS n, max(mean) AS high, min(mean) AS low, arg_min(label, {{'m': -mean, 's': slot}}) AS top, arg_min(label, {{'m': mean, 's': slot}}) AS bottom FROM s GROUP BY 1), x AS (SELECT *, (high - low) / abs(level) AS swing, n >= 24 AND (high - low) / abs(level) >= 0.15 AS detected FROM g JOIN l USING (kpi_id))
  SELECT kpi_id, detected, CASE WHEN detected THEN 12 END AS cycle, CASE WHEN detected THEN round(least(1.0, swing), 2) ELSE 0.0 END AS strength, CASE WHEN detected THEN top END AS peak, CASE WHEN detected THEN bottom END AS trough FROM x""")
def series_seasons(spark, d):
    """The yearly season of order value by priority, from the means of twelve slots."""
    return outlook.seasons(_long(spark, d), 12)


@query(f"WITH RECURSIVE {_STATES} SELECT * FROM bt")
def series_backtests(spark, d):
    """One-step errors of three models on monthly order value by priority."""
    return outlook.backtests(_long(spark, d))


@query(f"""WITH RECURSIVE {_STATES}, b AS (SELECT kpi_id, arg_min(model, {{'m': mase, 'r': CASE model WHEN 'naive' THEN 0 WHEN 'ses' THEN 1 ELSE 2 END}}) AS model, min(mase) AS mase, min(mase) FILTER (WHERE model = 'naive') AS naive FROM bt GROUP BY 1),
  c AS (SELECT kpi_id, stddev_samp(following - value) AS sd, 0.05 * abs(avg(value)) AS alt, max(value) - min(value) AS span FROM r GROUP BY 1), k AS (SELECT unnest([1, 2, 3]) AS step), z AS (SELECT * FROM st WHERE i = n - 1),
  f AS (SELECT z.kpi_id, step, b.model, CASE b.model WHEN 'naive' THEN y WHEN 'ses' THEN ses ELSE lvl + slope * (CASE step WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 + 0.9 * 0.9 ELSE 0.9 + 0.9 * 0.9 + 0.9 * 0.9 * 0.9 END) END AS v, 1.2816 * CASE WHEN sd = 0 THEN alt ELSE sd END * sqrt(step) AS half, b.mase, b.model <> 'naive' AND b.mase < 0.98 * b.naive AS beats_naive FROM z JOIN b USING (kpi_id) JOIN c USING (kpi_id), k WHERE z.n >= 8 AND span >= 1e-12)
  SELECT kpi_id, step, model, round(v, 4) AS value, round(v - half, 4) AS low, round(v + half, 4) AS high, mase, beats_naive FROM f""")
def series_outlook(spark, d):
    """Three months ahead of order value by priority, by the model that tested best."""
    return outlook.outlook(_long(spark, d), 3)


@query(f"""WITH {_LONG}, l AS (SELECT kpi_id, max(period) AS last FROM m GROUP BY 1), f AS (SELECT kpi_id, unnest([1, 2, 3, 4]) AS step, last FROM l) SELECT kpi_id, step, CAST(last + to_months(step) AS DATE) AS start, strftime(last + to_months(step), '%b %Y') AS label FROM f""")
def series_future_periods(spark, d):
    """The four months after each series' last, their grain taken from its last two periods."""
    return outlook.future_periods(_long(spark, d), 4)


# Fixed values of the approximation, as in `outlook.two_sided`.
_P = "least(1.0, greatest(0.0, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * (0.319381530 * k - 0.356563782 * pow(k, 2) + 1.781477937 * pow(k, 3) - 1.821255978 * pow(k, 4) + 1.330274429 * pow(k, 5))))"


@query(f"""WITH {_LONG}, q AS (SELECT a.kpi_id, CAST(sum(sign(b.value - a.value)) AS DOUBLE) AS s, median((b.value - a.value) / (b.i - a.i)) AS slope, any_value(a.n) AS n FROM r a JOIN r b ON a.kpi_id = b.kpi_id AND a.i < b.i GROUP BY 1), c AS (SELECT kpi_id, value, count(*) AS c FROM m GROUP BY 1, 2),
  ti AS (SELECT kpi_id, CAST(sum(c * (c - 1) * (2 * c + 5)) AS DOUBLE) AS ties FROM c GROUP BY 1), v AS (SELECT kpi_id, abs(avg(value)) AS level FROM m GROUP BY 1), w AS (SELECT *, (CAST(n AS DOUBLE) * (n - 1) * (2 * n + 5) - ties) / 18 AS variance FROM q JOIN ti USING (kpi_id) JOIN v USING (kpi_id) WHERE n >= 4),
  z AS (SELECT *, CASE WHEN variance > 0 THEN (s - sign(s)) / sqrt(variance) ELSE 0 END AS z FROM w), y AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS k FROM z), p AS (SELECT *, {_P} AS p FROM y)
  SELECT kpi_id, CASE WHEN NOT (p < 0.05 AND n >= 6) THEN 'flat' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, round(slope, 4) AS slope, round(coalesce(slope / nullif(level, 0) * 100, 0), 2) AS slope_pct, round(p, 4) AS p, round(2 * s / (CAST(n AS DOUBLE) * (n - 1)), 3) AS tau, p < 0.05 AND n >= 6 AS significant, n FROM p""")
def series_trend_sql(spark, d):
    """The trend of monthly order value by priority: concordant pairs, Theil-Sen slope, p by the SQL profile's normal tail."""
    return outlook.mann_kendall(_long(spark, d))


@query(f"""WITH g AS (SELECT l_linestatus, l_returnflag = 'R' AS back, l_discount, l_quantity FROM lineitem), a AS (SELECT CAST(count(*) FILTER (WHERE back AND l_linestatus = 'F') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE back AND l_linestatus <> 'F') AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE l_linestatus <> 'F') AS DOUBLE) AS nb,
  avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS m1, stddev_samp(l_quantity) FILTER (WHERE l_linestatus = 'F') AS s1, avg(l_quantity) FILTER (WHERE l_linestatus <> 'F') AS m2, stddev_samp(l_quantity) FILTER (WHERE l_linestatus <> 'F') AS s2 FROM g),
  u AS (SELECT 'share' AS test, (a / na - b / nb) / sqrt((a + b) / (na + nb) * (1 - (a + b) / (na + nb)) * (1 / na + 1 / nb)) AS z, 0.0 AS d FROM a UNION ALL SELECT 'mean', (m1 - m2) / sqrt(s1 * s1 / na + s2 * s2 / nb), (m1 - m2) / sqrt(((na - 1) * s1 * s1 + (nb - 1) * s2 * s2) / (na + nb - 2)) FROM a), y AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS k FROM u)
  SELECT test, round(z, 3) AS statistic, round({_P}, 4) AS p, round(d, 3) AS effect FROM y""")
def sql_profile_tests(spark, d):
    """Returned lines by status (shares) and their quantities (means), tested by the SQL profile's rules in one scan."""
    f, back, q = F.col("l_linestatus") == "F", F.col("l_returnflag") == "R", F.col("l_quantity")
    n = lambda c: F.count_if(c).cast("double")
    a = t(spark, d, "lineitem").agg(n(back & f).alias("a"), n(f).alias("na"), n(back & ~f).alias("b"), n(~f).alias("nb"), *[g(F.when(s, q)).alias(f"{x}{i}") for i, s in ((1, f), (2, ~f)) for x, g in (("m", F.avg), ("s", F.stddev_samp))])
    share = outlook.proportions(*[F.col(c) for c in ("a", "na", "b", "nb")])
    mean = outlook.welch(*[F.col(c) for c in ("m1", "s1", "na", "m2", "s2", "nb")])
    rows = [F.struct(F.lit("share").alias("test"), share["z"].alias("statistic"), share["p"].alias("p"), F.lit(0.0).alias("effect")), F.struct(F.lit("mean").alias("test"), mean["t"].alias("statistic"), mean["p"].alias("p"), mean["d"].alias("effect"))]
    return a.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


# -- kinds and domains --------------------------------------------------------------------------------

_TABLES = ("orders", "customer", "lineitem", "part", "events")


def _facts_sql(table: str) -> str:
    """A profile row for each column by DuckDB's own names of types."""
    cols = {"orders": "o_orderkey n o_custkey n o_orderstatus s o_totalprice n o_orderdate t o_orderpriority s", "customer": "c_custkey n c_name s c_nationkey n c_acctbal n c_mktsegment s", "lineitem": "l_orderkey n l_partkey n l_suppkey n l_linenumber n l_quantity n l_extendedprice n l_discount n l_tax n l_returnflag s l_linestatus s l_shipdate t", "part": "p_partkey n p_name s p_brand s p_type s p_size n p_retailprice n", "events": "event_id n ts t user_id n event_type s value n props s"}[table].split()
    number = lambda c, k: f"CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE)" if k == "n" else "NULL, NULL"
    return " UNION ALL ".join(f"SELECT '{table}', '{c}', '{k}', count(*), count(DISTINCT {c}), {number(c, k)} FROM {table}" for c, k in zip(cols[::2], cols[1::2]))


_KIND = f"""CASE WHEN k = 't' THEN 'datetime' WHEN k = 'n' AND u <= 2 AND coalesce(low, 0) >= 0 AND coalesce(high, 1) <= 1 THEN 'boolean' WHEN k = 'n' AND regexp_matches(c, '{V.PERCENT}') THEN 'percentage' WHEN k = 'n' AND regexp_matches(c, '{V.MONEY}') THEN 'currency' WHEN k = 'n' AND regexp_matches(c, '{V.COUNT}') THEN 'count'
  WHEN regexp_matches(c, '{V.KEY}') AND u > 0.5 * n THEN 'identifier' WHEN k = 'n' THEN 'numeric' WHEN u > 0.6 * n AND u > 200 THEN 'text' WHEN u <= greatest(60, 0.05 * n) THEN 'categorical' ELSE 'text' END"""


@query(f"WITH f(t, c, k, n, u, low, high) AS ({' UNION ALL '.join(map(_facts_sql, _TABLES))}) SELECT t AS \"table\", c AS \"column\", n AS rows, u AS distinct_values, {_KIND} AS kind FROM f")
def column_kinds(spark, d):
    """What the columns of five tables mean, by name, type and counts: one scan a table, one table of rules."""
    out = None
    for name in _TABLES:
        k = kinds.kinds(kinds.facts(t(spark, d, name))).select(F.lit(name).alias("table"), "column", "rows", "distinct_values", "kind")
        out = k if out is None else out.unionAll(k)
    return out


_WORDS = ", ".join(f"('{w}', '{dom}', {p}, {i})" for i, (w, dom, p) in enumerate(V.SQL_NAME_POINTS))


@query(f"""WITH c AS (SELECT column_name AS c, row_number() OVER () AS i FROM (DESCRIBE lineitem) UNION ALL SELECT column_name, 100 + row_number() OVER () FROM (DESCRIBE part)), w(words, domain, points, place) AS (VALUES {_WORDS}),
  s AS (SELECT domain, sum(points) AS points, min({{'i': i, 'p': place}}) AS f FROM c JOIN w ON regexp_matches(lower(c), words) GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY points DESC, f) AS place, CAST(points AS DOUBLE) / sum(points) OVER () AS share FROM s)
  SELECT domain, CAST(points AS BIGINT) AS points, CAST(place AS INTEGER) AS place, CASE WHEN place = 1 THEN round(least(0.97, 0.45 + 0.5 * share), 2) END AS confidence FROM o""")
def domain_by_names_sql(spark, d):
    """The domain of lines with their parts, by the SQL profile's words in column names."""
    names = [(c, i) for name, base in (("lineitem", 1), ("part", 101)) for i, c in enumerate(t(spark, d, name).columns, base)]
    return kinds.sql_domains(spark.createDataFrame(names, "column string, position int"))


_NAME_ROWS = ", ".join(f"('{dom}', '{w}', {p})" for dom, own in V.NAME_POINTS.items() for w, p in own.items())
_VALUE_ROWS = ", ".join(f"('{dom}', '{w}')" for dom, own in V.VALUES.items() for w in own)
_EVERY = ", ".join(f"('{dom}', {i})" for i, dom in enumerate(V.NAME_POINTS))


@query(f"""WITH c AS (SELECT trim(regexp_replace(lower(column_name), '[^a-z0-9]+', '_', 'g'), '_') AS c FROM (DESCRIBE orders) UNION ALL SELECT 'k'), w(domain, token, points) AS (VALUES {_NAME_ROWS}), x(domain, token) AS (VALUES {_VALUE_ROWS}), a(domain, i) AS (VALUES {_EVERY}),
  tall AS (SELECT DISTINCT unnest(['s', 'p', 'k']) AS c, trim(lower(unnest([o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'Returned' WHEN o_orderkey % 3 = 1 THEN 'Shipped' ELSE ' delivered ' END]))) AS v FROM orders), few AS (SELECT * FROM tall WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c ORDER BY v) <= 60),
  f AS (SELECT domain, points FROM c JOIN w ON contains(c, token) UNION ALL SELECT 'sales', 2.0 UNION ALL SELECT 'finance', 0.5 UNION ALL SELECT 'sales', 1.5 UNION ALL SELECT 'banking', 0.5 UNION ALL SELECT domain, 1.5 FROM (SELECT DISTINCT domain, token FROM few JOIN x ON contains(v, token))),
  s AS (SELECT a.domain, i, CAST(coalesce(sum(points), 0) AS DOUBLE) AS points FROM a LEFT JOIN f ON f.domain = a.domain GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY points DESC, i) AS place, points / sum(points) OVER () AS share FROM s),
  g AS (SELECT *, max(points) OVER () AS top, max(points) FILTER (WHERE place > 1) OVER () AS second FROM o)
  SELECT domain, points, CAST(place AS INTEGER) AS place, CASE WHEN place = 1 AND top >= 4 THEN round(least(0.99, 0.45 * 2.2 * share + 0.55 * (top - second) / top + 0.15), 3) END AS confidence FROM g UNION ALL SELECT 'generic', 0, 0, 0.35 FROM g WHERE place = 1 AND top < 4""")
def domain_by_evidence(spark, d):
    """The domain of the orders by names, roles and what their text values say, in one scan."""
    o = t(spark, d, "orders").withColumn("fulfil", F.when(F.col("o_orderkey") % 3 == 0, "Returned").when(F.col("o_orderkey") % 3 == 1, "Shipped").otherwise(" delivered "))
    named = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", F.col("fulfil").alias("k"))
    return kinds.domains(named, {"revenue": "o_totalprice", "order_id": "o_orderkey"}, ["o_orderstatus", "o_orderpriority", "k"])


_PRIORITY = "CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END"


@query(f"""WITH s AS (SELECT c_mktsegment AS segment, sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderdate >= '2000-01-01') - sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderdate < '2000-01-01') AS delta FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= '1999-01-01' AND o_orderdate < '2001-01-01' GROUP BY 1),
  a AS (SELECT segment, CAST(delta AS DOUBLE) AS amount, CASE WHEN delta < 0 THEN 'margin' ELSE 'growth' END AS category, abs(CAST(delta AS DOUBLE)) / sum(abs(CAST(delta AS DOUBLE))) OVER () AS impact FROM s), h AS (SELECT *, 100 * impact * 0.6 * 1.0 AS score FROM a)
  SELECT segment, category, round(amount, 2) AS amount, round(score, 6) AS score, {_PRIORITY} AS priority, CASE WHEN category = 'margin' THEN 'Head of Merchandising' ELSE 'Head of E-commerce' END AS owner, category = 'margin' OR abs(amount) >= 200000 AS approval, CASE WHEN category = 'margin' OR abs(amount) >= 200000 THEN 'Commercial Director' ELSE '' END AS authority,
  0.6 AS confidence, CASE WHEN category = 'margin' OR abs(amount) >= 200000 THEN 'fired,evidence,readiness,cap,owner,approval' ELSE 'fired,evidence,readiness,cap,owner' END AS rules FROM h""")
def governed_actions(spark, d):
    """What to do about each customer segment's change in order value, and who decides it in retail."""
    o = orders(spark, d).where((F.col("o_orderdate") >= "1999-01-01") & (F.col("o_orderdate") < "2001-01-01"))
    now = F.col("o_orderdate") >= "2000-01-01"
    s = o.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg((F.sum(F.when(now, F.col("v"))) - F.sum(F.when(~now, F.col("v")))).cast("double").alias("amount"))
    total = s.agg(F.sum(F.abs("amount")).alias("_t"))
    a = s.crossJoin(F.broadcast(total)).select(F.concat(F.lit("segment "), "segment").alias("id"), F.when(F.col("amount") < 0, "margin").otherwise("growth").alias("category"), (F.abs("amount") / F.col("_t")).alias("impact"), F.lit(0.9).alias("confidence"), F.lit(1.0).alias("urgency"), "amount", F.lit("revenue").alias("metric"), "segment", F.array(F.struct(F.lit("additive").alias("method"), F.lit(None).cast("double").alias("p"))).alias("evidence"))
    g = governance.decide(a, "ecommerce", "usable with care", 0.6)
    return g.select("segment", "category", F.round("amount", 2).alias("amount"), r6("score").alias("score"), "priority", "owner", "approval", "authority", "confidence", F.array_join("trail.rule", ",").alias("rules"))


