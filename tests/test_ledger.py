"""Ledger audit and advice, KPI definitions in SQL."""

from datetime import datetime

from pyspark.sql import functions as F

from plumbline.operators import kpi, ledger
from plumbline.plans import ledger_advice

C = {"invoice": "invoice", "customer": "customer", "quantity": "quantity", "price": "price", "description": "description", "date": "date"}
ROWS = [
    ("1", "a", 2.0, 5.0, "x", datetime(2024, 1, 1, 9)), ("1", "a", 2.0, 5.0, "x", datetime(2024, 1, 1, 9)), ("2", "a", 1.0, 10.0, None, datetime(2024, 1, 2, 9)), ("3", None, 4.0, 1.0, "x", datetime(2024, 1, 3, 22)),
    ("C1", "a", -2.0, 5.0, "x", datetime(2024, 1, 4, 23)), ("4", "b", -1.0, 3.0, "x", datetime(2024, 1, 2, 9)), ("5", "b", 0.0, 3.0, "x", datetime(2024, 1, 2, 9)), ("6", "b", 1.0, 0.0, "x", datetime(2024, 1, 2, 9)), ("c7", None, 1.0, 1.0, "x", None), (None, "b", 1.0, 7.0, "x", None),
]
SCHEMA = "invoice string, customer string, quantity double, price double, description string, date timestamp"


def test_rules_figures_and_coverage(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["rule"]: (r["rows"], r["severity"]) for r in ledger.quality_rules(df, C).collect()}
    assert got == {"cancelled": (2, "high"), "negative_quantity": (1, "medium"), "zero_quantity": (1, "medium"), "non_positive_price": (1, "medium"), "missing_customer": (2, "high"), "missing_description": (1, "medium"), "duplicates": (1, "medium")}
    k = {r["kpi"]: (r["value"], r["numerator"], r["denominator"]) for r in ledger.kpis(df, C, F.col("quantity") * F.col("price")).collect()}
    assert k["revenue"][0] == 41.0 and k["orders"][0] == 3 and k["units"][0] == 10.0 and k["customers"][0] == 2
    assert k["cancellation_rate"] == (25.0, 2.0, 8.0) and k["repeat_rate"] == (50.0, 1.0, 2.0)
    assert tuple(ledger.coverage(df, C).first()) == (10, 5, datetime(2024, 1, 1, 9), datetime(2024, 1, 3, 22), True)
    few = {"invoice": "invoice"}
    assert {r["rule"] for r in ledger.quality_rules(df.select("invoice"), few, duplicates=False).collect()} == {"cancelled"}
    empty = df.limit(0)
    assert ledger.quality_rules(empty, C).count() == 0 and not ledger.coverage(empty, C).first()["partial"]
    assert {r["kpi"] for r in ledger.kpis(empty, C, F.col("price")).collect()} == {"orders", "customers"}


def test_advice_from_all_inputs(spark):
    f = ledger_advice.facts(spark.createDataFrame(ROWS, SCHEMA), C, F.col("quantity") * F.col("price"))
    row = f.first()
    assert (row["identified"], row["one_time"], row["anonymous_revenue"], row["hypothesis"]) == (2, 1, 4.0, True)
    trends = spark.createDataFrame([("revenue", True, -3.0, -0.8, 0.01), ("cost", True, 2.0, 0.5, 0.04), ("units", False, -9.0, -0.9, 0.5), ("orders", True, -1.0, -0.4, 0.02)], "kpi_id string, significant boolean, slope double, tau double, p double")
    outliers = spark.createDataFrame([("region", f"r{i}", "revenue", float(i)) for i in range(5)], "dimension string, segment string, metric string, z double")
    drivers = spark.createDataFrame([("revenue", "East", -12.0, 80.0, 0.99, -500.0)], "metric string, segment string, change double, contribution double, confidence double, excess double")
    rows = [r.asDict() for r in ledger_advice.advise(f, None, 75.0, trends, outliers, drivers).collect()]
    assert len(rows) == 9 and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True) and all(r["act"] for r in rows)
    by = {(r["rule"], r["metric"], r["segment"]): r for r in rows}
    assert by["concentrated_driver", "revenue", "East"]["score"] == 82.0 and by["concentrated_driver", "revenue", "East"]["confidence"] == 0.95
    assert by["adverse_trend", "revenue", None]["confidence"] == 0.99 and ("adverse_trend", "cost", None) in by and ("adverse_trend", "orders", None) not in by
    assert {r["segment"] for r in rows if r["rule"] == "segment_anomaly"} == {"r2", "r3", "r4"}
    poor = ledger_advice.advise(f, None, 50.0).collect()
    assert [r["act"] for r in poor if r["rule"] == "quality_gate"] == [True] and not any(r["act"] for r in poor if r["rule"] != "quality_gate")
    assert [r["priority"] for r in poor if r["rule"] == "quality_gate"] == ["critical"]
    assert ledger_advice.advise(ledger_advice.facts(spark.createDataFrame([], SCHEMA), C, F.col("price"))).count() == 0


def test_definitions_in_sql(spark):
    k = kpi.from_sql("spread_sql", "max({revenue}) - min({revenue})", domains=("sales",))
    try:
        assert k.requires == ("revenue",) and [x.id for x in kpi.available({"price": "p"}, ["spread_sql"])] == []
        df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0)], "g string, `odd ``name` double")
        got = {r["g"]: r["spread_sql"] for r in kpi.aggregate(df, {"revenue": "odd `name"}, ["spread_sql"], [F.col("g")]).collect()}
        assert got == {"a": 3.0, "b": 0.0}
    finally:
        kpi.REGISTRY.pop("spread_sql")
