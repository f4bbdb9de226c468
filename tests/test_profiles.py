"""Ordered ranks, SQL-profile statistics, domains, governance, schemas: closed forms and small tables."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import series as S
from plumbline.operators import anomaly, customers, kpi, ordered, outlook, privacy, profile, quality
from plumbline.plans import domains, governance, kinds, roles
from plumbline.sources import readers

AWKWARD = [None, 0.0, -0.0, -3.5, -3.5, 1e-300, 2.0, 2.0, 2.0, 1024.0, 1023.9999999, 1e300, -1e300, 7.25]


def test_running_over_awkward_values(spark):
    df = spark.createDataFrame([(v, 1) for v in AWKWARD], "v double, k int").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    for down in (False, True):
        rows = ordered.running(df, "v", "n", down=down).collect()
        rank = lambda v: -math.inf if v is None else v
        for r in rows:
            earlier = [x for x in AWKWARD if (rank(x) > rank(r["v"]) if down else rank(x) < rank(r["v"]))]
            assert r["_before"] == len(earlier), (down, r)


def test_running_of_nan_and_infinity(spark):
    df = spark.createDataFrame([(float("inf"), 1), (float("-inf"), 2), (float("nan"), 4), (5.0, 8)], "v double, n int")
    got = {str(r["v"]): r["_before"] for r in ordered.running(df, "v", "n").collect()}
    assert got == {"-inf": 0, "5.0": 2, "inf": 10, "nan": 11}


@pytest.mark.parametrize("kind", ["int", "string", "date", "timestamp", "decimal(18,2)"])
def test_numbered_places_by_any_type_of_key(spark, kind):
    keys = {"int": "id - 150", "string": "concat('Customer#', lpad(id * 7919 % 300, 6, '0'))", "date": "date_add(date'1990-01-01', cast(id as int))", "timestamp": "timestamp_seconds(id * 90000 - 5000000)", "decimal(18,2)": "id * 1.37 - 100"}
    df = spark.range(300).select(F.expr(f"cast({keys[kind]} as {kind})").alias("key"), (F.col("id") % 3).alias("v"))
    rows = ordered.numbered(df, "v", "key").collect()
    want = sorted(((r["v"], r["key"]) for r in rows))
    assert [(r["v"], r["key"]) for r in sorted(rows, key=lambda r: r["_place"])] == want
    assert sorted(r["_place"] for r in rows) == list(range(1, 301))


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.lognormal(3, 2, 500), -rng.lognormal(1, 1, 300), np.zeros(200), np.full(400, 17.5)])
    df = spark.createDataFrame([(float(v), None) for v in x], "a double, b double")
    p = (0.0, 0.05, 0.25, 0.5, 0.9, 1.0)
    rows = ordered.quantiles(df, ["a", "b"], p).collect()
    assert [r["column"] for r in rows] == ["a"] and rows[0]["n"] == len(x)  # a column without values has no row
    assert np.allclose(rows[0]["quantiles"], np.quantile(x, p), rtol=1e-12)
    assert ordered.quantiles(df.limit(0), ["a"], p).count() == 0


def test_empty_tables_in_outlier_checks(spark):
    df = spark.createDataFrame([], "v double")
    assert quality.robust_outliers(df, "v").first().asDict() == {"n": 0, "median": None, "mad": None, "outliers": 0}
    one = profile.numeric_summary(spark.createDataFrame([(None,)], "v double")).first()
    assert one["n"] == 0 and one["median"] is None


def test_value_concentration_rounds_up(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 90)], "monetary double")
    r = customers.value_concentration(df).first()
    assert (r["customers"], r["top"]) == (11, 2) and math.isclose(r["share_of_value"], 0.91)
    assert customers.value_concentration(df.limit(0)).first()["share_of_value"] == 0.0


def test_retention_and_value_of_customers(spark):
    assert customers.steady_retention([1.0, 0.5, 0.4, 0.36]) == pytest.approx(0.85)
    assert customers.steady_retention([1.0, 0.5]) is None
    df = spark.createDataFrame([(1, "2024-01-05", 10.0, "a"), (1, "2024-01-06", 30.0, "b"), (2, "2024-01-05", 20.0, "b")], "c int, d string, v double, s string").withColumn("d", F.col("d").cast("timestamp"))
    rows = {r["segment"]: r for r in customers.clv_segments(df, "c", "d", F.col("v"), "s", discount=0.0).collect()}
    assert rows["a"]["average_order_value"] == 20.0 and rows["a"]["purchases_per_period"] == 2.0  # of the first row's segment
    assert rows["a"]["predicted_clv"] == pytest.approx(20 * 2 * 0.3 * 0.5 / 0.5)  # too short for a curve: half the customers came again


def _series(spark, **named):
    rows = [(k, date(2020 + i // 12, i % 12 + 1, 1), float(v)) for k, y in named.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "kpi_id string, period date, value double")


def test_normal_tail_and_tests(spark):
    zs = (-3.0, -1.0, 0.0, 0.5, 1.96, 4.0)
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", outlook.two_sided(F.col("z")).alias("p")).collect():
        assert math.isclose(r["p"], math.erfc(abs(r["z"]) / math.sqrt(2)), abs_tol=2e-7)
    share = lambda *v: spark.range(1).select(outlook.proportions(*[F.lit(float(x)) for x in v]).alias("x")).first()["x"].asDict()
    assert share(30, 100, 10, 100) == {"z": 3.536, "p": 0.0004} and share(3, 4, 10, 100) == {"z": 0.0, "p": 1.0}
    mean = spark.range(1).select(outlook.welch(*[F.lit(float(x)) for x in (10, 2, 50, 9, 2, 50)]).alias("x")).first()["x"].asDict()
    assert mean == {"t": 2.5, "p": 0.0124, "d": 0.5}
    got = {r["kpi_id"]: r for r in outlook.mann_kendall(_series(spark, up=[1, 2, 3, 4, 5, 6], five=[1, 2, 3, 4, 5], short=[1, 2, 3])).collect()}
    assert (got["up"]["direction"], got["up"]["slope"], got["up"]["tau"]) == ("increasing", 1.0, 1.0)
    assert got["five"]["direction"] == "flat" and "short" not in got  # five values never are significant


def test_sql_forecast(spark):
    y = [5.0, 9.0] * 6
    rows = outlook.outlook(_series(spark, saw=y, flat=[1.0] * 12, short=[1, 2, 3])).orderBy("kpi_id", "step").collect()
    assert {r["kpi_id"] for r in rows} == {"saw"} and rows[0]["model"] != "naive" and rows[0]["beats_naive"] and rows[0]["mase"] < 0.98  # a level between the two is nearer
    tests = {r["model"]: r.asDict() for r in outlook.backtests(_series(spark, saw=y)).collect()}
    assert tests["naive"] == {"kpi_id": "saw", "model": "naive", "mase": 1.0, "mape": round((4 / 5 + 4 / 9) / 2 * 100, 4), "rmse": 4.0, "folds": 6}
    wide = [r["high"] - r["low"] for r in rows]
    assert wide[1] / wide[0] == pytest.approx(math.sqrt(2), rel=1e-3) and wide[2] / wide[0] == pytest.approx(math.sqrt(3), rel=1e-3)
    last = outlook._series(_series(spark, a=[0.0, 10.0, 20.0], b=[10.0, 20.0])).select("kpi_id", F.element_at("s", -1).alias("s")).collect()
    last = {r["kpi_id"]: r["s"] for r in last}
    assert last["a"]["level"] + 0.9 * last["a"]["slope"] == pytest.approx(26.003084) and last["b"]["ses"] == 13.5  # by hand


def test_sql_season(spark):
    y = [10.0, 20.0, 30.0, 20.0] * 3
    got = {r["kpi_id"]: r.asDict() for r in outlook.seasons(_series(spark, wave=y, small=[10.0, 10.1, 10.0, 10.1] * 3, short=y[:7]), 4).collect()}
    assert got["wave"] == {"kpi_id": "wave", "detected": True, "cycle": 4, "strength": 1.0, "peak": date(2020, 3, 1), "trough": date(2020, 1, 1)}
    assert not got["small"]["detected"] and not got["short"]["detected"]


def test_future_periods(spark):
    rows = [("m", date(2024, 11, 1)), ("m", date(2024, 12, 1)), ("q", date(2024, 7, 1)), ("q", date(2024, 10, 1)), ("w", date(2024, 12, 16)), ("w", date(2024, 12, 23)), ("one", date(2024, 2, 1))]
    long = spark.createDataFrame(rows, "kpi_id string, period date")
    got = {r["kpi_id"]: (r["start"], r["label"]) for r in outlook.future_periods(long, 1).collect()}
    assert got == {"m": (date(2025, 1, 1), "Jan 2025"), "q": (date(2025, 1, 1), "Q1 2025"), "w": (date(2024, 12, 30), "W01 2024"), "one": (date(2024, 3, 1), "Mar 2024")}
    assert outlook.month_labels(spark, "2024-02-28", 1, "day") == ["2024-02-29"] and outlook.future_periods(long.limit(0)).count() == 0


def test_kinds_and_domains(spark):
    rows = [("is_new", "int", 100, 2, 0.0, 1.0), ("order_id", "bigint", 100, 90, 1.0, 99.0), ("revenue", "double", 100, 90, 0.0, 9.0), ("click_rate", "double", 100, 9, 0.0, 9.0), ("note", "string", 1000, 900, None, None), ("town", "string", 1000, 40, None, None), ("at", "timestamp_ntz", 9, 9, None, None), ("odd", "array<int>", 9, 9, None, None)]
    got = {r["column"]: r["kind"] for r in kinds.kinds(spark.createDataFrame(rows, "column string, type string, rows long, distinct_values long, low double, high double")).collect()}
    assert got == {"is_new": "boolean", "order_id": "identifier", "revenue": "currency", "click_rate": "percentage", "note": "text", "town": "categorical", "at": "datetime", "odd": "categorical"}
    names = spark.createDataFrame([("patient_id",), ("ward",), ("length_of_stay",), ("region",)], "column string")
    found = kinds.sql_domains(names).orderBy("place").collect()
    assert [(r["domain"], r["points"], r["confidence"]) for r in found] == [("healthcare", 12, 0.91), ("sales", 1, None)]
    assert kinds.sql_domains(spark.createDataFrame([("x",)], "column string")).count() == 0
    df = spark.createDataFrame([("Visa ",), ("ATM withdrawal",), (None,)], "k string")
    lead = kinds.domains(df, {"merchant_id": "m"}).where("confidence IS NOT NULL").collect()
    assert [(r["domain"], r["points"]) for r in lead] == [("banking", 6.0)]
    assert kinds.domains(df.select(F.lit("q").alias("k"))).where("confidence IS NOT NULL").first()["domain"] == "generic"
    f = {r["column"]: (r["distinct_values"], r["low"]) for r in kinds.facts(spark.range(50).select("id", (F.col("id") % 3).cast("string").alias("s")), exact=False).collect()}
    assert abs(f["id"][0] - 50) <= 2 and f["id"][1] == 0.0 and f["s"] == (3, None)


def test_domains():
    bound = {"revenue": "v", "date": "d", "order_id": "o", "customer_id": "c", "segment": "seg", "product_id": "p"}
    ids, first = domains.choose_kpis("ecommerce", bound)
    assert ids[:3] == ["revenue", "orders", "aov"] and first == "revenue" and "transaction_volume" not in ids
    few = [k.id for k in kpi.for_domain("hr", {"employee_id": "e", "revenue": "v"})]  # two of its own, so others follow
    assert few[:2] == ["headcount", "revenue_per_employee"] and "revenue" in few and len(few) <= 12
    assert domains.ordered_dimensions("ecommerce", "revenue", {**bound, "return_flag": "back"}, ["back", "x", "seg", "p"]) == ["p", "seg", "x", "back"]
    assert domains.ordered_dimensions("none", "revenue", bound, ["a", "b"], 1) == ["a"]


def test_governance(spark):
    rows = [("a", "margin", 0.9, 0.95, 1.0, None, "revenue", [("welch", 0.01), ("welch", 0.2)]), ("b", None, 0.5, 0.5, 1.0, -300_000.0, None, None)]
    advice = spark.createDataFrame(rows, "id string, category string, impact double, confidence double, urgency double, amount double, metric string, evidence array<struct<method: string, p: double>>")
    a, b = governance.decide(advice, "ecommerce", "usable with care", 0.6).orderBy("id").collect()
    assert (a["confidence"], a["confidence_before"], a["priority"], a["owner"], a["approval"]) == (0.6, 0.95, "medium", "Head of Merchandising", True)
    assert a["tests"] == ["welch"] and a["significance"] == 0.01
    assert [(t["rule"], t["before"], t["after"]) for t in a["trail"]] == [("fired", "", "a"), ("evidence", "", "2"), ("readiness", "", ""), ("cap", "0.95", "0.60"), ("owner", "", "Head of Merchandising"), ("approval", "", "Commercial Director")]
    assert b["approval"] and b["authority"] == "Commercial Director" and b["priority"] == "low" and b["category"] == "growth"
    free = governance.decide(advice, "none", "ready").orderBy("id").collect()
    assert [(r["approval"], r["authority"], r["confidence"]) for r in free] == [(True, "Analytics Lead", 0.95), (False, "", 0.5)]
    assert governance.decide(advice.limit(0), "hr", "ready").count() == 0


def test_cards_and_exceptions(spark):
    rows = [{"kpi_id": "revenue", "period": f"2024-{m:02d}", "value": float(m)} for m in range(1, 9)]
    card = kpi.cards(rows, "month")[0]
    assert card["period"] == "2024-08" and card["sparkline"] == [float(m) for m in range(1, 9)] and card["trend"]["trend"] == "increasing" and card["additive"]
    y = [10.0, 11.0, 10.0, 12.0, 11.0, 10.0, 40.0, 11.0, 0.0]
    long = spark.createDataFrame([("k", f"p{i}", v) for i, v in enumerate(y)] + [("short", f"p{i}", v) for i, v in enumerate(y[:7])] + [("flat", f"p{i}", 5.0) for i in range(9)], "kpi_id string, period string, value double")
    got = {(r["kpi_id"], r["period"], r["kind"], r["suppressed"]) for r in anomaly.temporal_exceptions(long, True).collect()}
    assert got == {("k", "p6", "spike", False), ("k", "p8", "dip", True)}
    assert [(r["rule"], r["severity"]) for r in anomaly.rule_exceptions({"a": 20, "b": 5, "c": 1, "d": 0}, 100)] == [("a", "high"), ("b", "medium"), ("c", "low")]


def test_schema_and_keys(spark):
    df = spark.range(40).select(F.concat(F.lit("m"), "id", F.lit("@x.de")).alias("email"), F.col("id").alias("order_id"), (F.col("id") % 4).cast("string").alias("kind"), F.expr("timestamp_seconds(id * 86400)").alias("at"), (F.col("id") * 1.5).cast("double").alias("amount"))
    s = profile.table_schema(df, "orders")
    assert s["primary_key"] == ["order_id"] and s["times"] == ["at"] and "amount" in s["measures"] and "kind" in s["dimensions"]
    assert profile.midnight(df, "at").first()[0] and not profile.midnight(df.withColumn("at", F.expr("at + interval 1 hour")), "at").first()[0]
    pair = spark.createDataFrame([(a, b) for a in "xyz" for b in "uvw"], "region string, city string")
    assert profile.primary_key(pair) == ["region", "city"] and profile.primary_key(pair.union(pair)) == []


def test_privacy_by_the_sql_profile(spark):
    df = spark.createDataFrame([(f"a{i}@b.de", f"2024-01-0{i}", f"a{i}@c.de", str(i)) for i in range(1, 6)], "email string, stamp string, note string, customer_id string")
    got = privacy.detect_sql(df)
    assert {c: (f["category"], f["evidence"], f["confidence"], f["mode"]) for c, f in got.items()} == {"email": ("email", "name+value", 0.98, "partial"), "note": ("email", "value", 0.92, "partial"), "customer_id": ("account_id", "name", 0.78, "hash")}


def test_samples_repeat(spark):
    df = spark.range(2000)
    once, again = (sorted(r["id"] for r in readers.random_sample(d, "id", 50).collect()) for d in (df, df.repartition(7)))
    assert once == again and len(set(once)) == 50
    assert 130 < readers.share_sample(df, "id", 10).count() < 270


def test_analysis_of_a_domain(spark):
    df = spark.range(600).select(F.expr("timestamp_seconds(1704067200 + (id % 300) * 86400)").alias("order_date"), F.col("id").alias("order_id"), (F.col("id") % 50).alias("customer_id"), (F.col("id") % 3).cast("string").alias("channel"), (F.col("id") % 17 + 1.0).alias("revenue"))
    r = roles.analyse(df, grain="month")
    assert not r["warnings"], r["warnings"]
    assert r["primary"] == "revenue" and {c["kpi_id"] for c in r["cards"]} <= {"revenue", "orders", "aov", "customers", "purchase_frequency", "clv", "revenue_per_customer", "units_sold"} | set(kpi.REGISTRY)
    assert r["future"] == ["Nov 2024", "Dec 2024", "Jan 2025"]


def test_preamble_of_each_file_goes(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part{i}.csv").write_text("made by a tool\n# of files\nname,amount\n" + "".join(f"n{i}_{k},{k}\n" for k in range(50)))
    rows = readers.load_csv(spark, str(tmp_path), skip=2, header=True).collect()
    assert sorted(r["name"] for r in rows) == sorted(f"n{i}_{k}" for i in range(3) for k in range(50))


def test_quoted_line_breaks_are_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\nx,"one\ntwo"\ny,plain\n')
    assert {r["note"] for r in readers.load_csv(spark, str(tmp_path / "a.csv")).collect()} == {"one\ntwo", "plain"}
    (tmp_path / "b.csv").write_text('name,note\n' + 'x,"one, two"\n' * 300)
    assert readers.load_csv(spark, str(tmp_path / "b.csv")).where("note = 'one, two'").count() == 300


def test_quoted_line_breaks_behind_a_preamble(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"p{i}.csv").write_text(f'made by a tool\nname,note\nx{i},"one\ntwo, ""three"""\ny,plain\nz\n')
    want = sorted([("x0", 'one\ntwo, "three"'), ("x1", 'one\ntwo, "three"'), ("y", "plain"), ("y", "plain"), ("z", None), ("z", None)], key=str)
    for multiline in (None, True):
        rows = readers.load_csv(spark, str(tmp_path), skip=1, header=True, multiline=multiline).collect()
        assert sorted([tuple(r) for r in rows], key=str) == want
    with pytest.raises(Exception, match="runs over lines"):
        readers.load_csv(spark, str(tmp_path), skip=1, header=True, multiline=False).collect()


def test_a_late_quoted_line_break_fails_loudly(spark, tmp_path):
    (tmp_path / "late.csv").write_text("name,note\n" + "a,b\n" * 500 + 'x,"one\ntwo"\n')
    with pytest.raises(Exception, match="runs over lines"):
        readers.load_csv(spark, str(tmp_path / "late.csv")).select("note").collect()
    assert readers.load_csv(spark, str(tmp_path / "late.csv"), multiline=True).count() == 501


def test_holt_winters_starts_from_all_cycles():
    y = [1.0, 5.0, 3.0, 7.0]  # two cycles of two; their mean season is (-2, 2)
    level, slope, parts = 3.0, 1.0, [-2.0, 2.0]
    for i, v in enumerate(y):
        before, s = level, parts[i % 2]
        level = 0.3 * (v - s) + 0.7 * (level + 0.95 * slope)
        slope = 0.08 * (level - before) + 0.92 * 0.95 * slope
        parts[i % 2] = 0.3 * (v - level) + 0.7 * s
    assert S.MODELS["holt_winters"](y, 1, 2)[0] == pytest.approx(level + 0.95 * slope + parts[0])
    uneven = [10.0, 20.0, 10.0, 40.0]
    assert S.MODELS["holt_winters"](uneven, 2, 2) != S.MODELS["holt_winters"]([10.0, 20.0, 10.0, 20.0], 2, 2)


def test_dialect_rules():
    from plumbline.plans.dialect import translate

    cases = [
        ("bigquery", "DATE_TRUNC('month', MIN(order_date))", "DATE_TRUNC(MIN(order_date), MONTH)"), ("bigquery", "DATE_TRUNC('week', d)", "DATE_TRUNC(d, WEEK(MONDAY))"),
        ("hive", "DATE_TRUNC('month', order_date)", "TRUNC(order_date, 'MM')"), ("hive", "DATE_TRUNC('week', d)", "DATE_SUB(d, PMOD(DATEDIFF(d, '1970-01-05'), 7))"), ("hive", "date_trunc('day', d)", "TO_DATE(d)"),
        ("bigquery", "DATE_DIFF('month', cohort, period)", "DATE_DIFF(period, cohort, MONTH)"), ("hive", "DATE_DIFF('day', a, b)", "DATEDIFF(b, a)"), ("hive", "DATE_DIFF('month', a, b)", "CAST(MONTHS_BETWEEN(b, a) AS INT)"), ("hive", "DATE_DIFF('year', a, b)", "CAST(MONTHS_BETWEEN(b, a) / 12 AS INT)"),
        ("bigquery", "QUANTILE_CONT(amount, 0.5)", "PERCENTILE_CONT(amount, 0.5) OVER ()"), ("bigquery", "APPROX_QUANTILE(amount, 0.9)", "APPROX_QUANTILES(amount, 100)[OFFSET(90)]"), ("hive", "QUANTILE_CONT(amount, 0.5)", "percentile_approx(amount, 0.5)"),
        ("bigquery", "CAST(x AS DOUBLE) + TRY_CAST(y AS INTEGER)", "CAST(x AS FLOAT64) + SAFE_CAST(y AS INT64)"), ("hive", "TRY_CAST(x AS VARCHAR)", "CAST(x AS STRING)"), ("hive", "APPROX_COUNT_DISTINCT(id)", "COUNT(DISTINCT id)"), ("hive", "STRING_AGG(x, ', ')", "concat_ws(', ', collect_list(x))"),
        ("bigquery", 'SELECT "order date" FROM "my table"', "SELECT `order date` FROM `my table`"), ("bigquery", "SELECT '(all segments)' AS s", "SELECT '(all segments)' AS s"), ("hive", "SELECT 'a \"b\" c'", "SELECT 'a \"b\" c'"), ("bigquery", "SELECT * EXCLUDE (a) FROM t", "SELECT * EXCEPT (a) FROM t"), ("duckdb", "SELECT 1;", "SELECT 1;"),
        ("hive", "SELECT 'AS VARCHAR' AS s, my_date_trunc('month', d)", "SELECT 'AS VARCHAR' AS s, my_date_trunc('month', d)"),
    ]
    for dialect, sql, want in cases:
        assert translate(sql, dialect)[0] == want, (dialect, sql)
    notes = lambda sql, dialect: " ".join(translate(sql, dialect)[1])
    assert "QUALIFY" in notes("SELECT * FROM t QUALIFY rn <= 3", "hive") and "approximate" in notes("SELECT QUANTILE_CONT(a, 0.5) FROM t", "hive")
    assert all("FILTER" in notes("SELECT SUM(x) FILTER (WHERE c) FROM t", d) for d in ("bigquery", "hive"))
    assert "GROUPING__ID" in notes("SELECT GROUPING(region) FROM t GROUP BY ROLLUP(region)", "hive") and "partition" in notes("SELECT region FROM orders", "bigquery")
    assert translate("SELECT 1", "bigquery")[1] == [] and translate("SELECT * FROM orders LIMIT 20", "hive")[1] == []
    with pytest.raises(ValueError, match="unknown dialect"):
        translate("SELECT 1", "oracle")
