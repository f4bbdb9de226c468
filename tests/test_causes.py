"""Root cause: planted causes, seasonal baselines, circular dimensions, companions, depth."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import causes, warehouse
from plumbline.sources import demo


@pytest.mark.parametrize("kind", sorted(demo.KINDS))
def test_planted_causes_are_recovered(spark, kind):
    spec = demo.KINDS[kind]
    dim, level, factor = spec["planted"]
    df = demo.generate(spark, kind, 30_000)
    spans = causes.Spans((datetime(2024, 5, 25), datetime(2024, 6, 24)), (datetime(2024, 4, 25), datetime(2024, 5, 25)), "given")
    if kind == "telesales":  # dated by the ends of months
        spans = causes.Spans((datetime(2024, 6, 1), datetime(2024, 7, 1)), (datetime(2024, 5, 1), datetime(2024, 6, 1)), "given")
    flag = spec["measure"].endswith("_flag")
    r = causes.explain(df, list(spec["dims"]), spec["time"], spans, F.col(spec["measure"]).cast("double"), F.lit(1.0) if flag else None, flag=flag, depth=3)
    assert r["dimensions"][0]["dimension"] == dim and r["dimensions"][0]["verdict"] in ("most", "partly")
    lead = r["nodes"][0]
    assert lead["segment"] == level and lead["role"] == "driver" and lead["significant"] and lead["severity"] == "critical"
    assert math.copysign(1, r["delta"]) == math.copysign(1, factor - 1) and r["confidence"] > 0.75
    assert {x["name"] for x in r["ruled_out"]} <= set(spec["dims"]) - {dim}
    for n in r["nodes"]:
        assert math.isclose(n["excess"], n["delta"] - n["expected"], abs_tol=1e-6)
        for c in n.get("children", []):
            assert abs(c["contribution"]) >= causes.CHILD and c["dimension"] == r["dimensions"][1]["dimension"]
    assert len(lead.get("children", [])) <= causes.CHILDREN


def _calls(spark):
    """Weekdays differ by a factor of three; the last Monday lost half of one region."""
    rows = []
    for day in range(1, 30):  # 1 January 2024 is a Monday
        for k in range(40 if day % 7 == 1 else 120):
            region = ("N", "S", "E", "W")[k % 4]
            if day == 29 and region == "E" and k % 8 < 4:
                continue
            rows.append((datetime(2024, 1, day, k % 24), region, ("a", "b")[k % 2], 1.0))
    return spark.createDataFrame(rows, "at timestamp, region string, kind string, v double")


def test_a_season_is_compared_with_its_own_slot(spark):
    df = _calls(spark)
    before, slot = causes.compared(df, "at", "day"), causes.compared(df, "at", "day", 7)
    assert before.comparison == "the period before" and before.baseline[0] == datetime(2024, 1, 28)
    assert slot.comparison == "one cycle before" and slot.baseline == (datetime(2024, 1, 22), datetime(2024, 1, 23)) and slot.current[0] == datetime(2024, 1, 29)
    assert causes.compared(df, "at", "day", 365).comparison == "the period before" and causes.compared(df.limit(0), "at", "day") is None
    wrong = causes.explain(df, ["region", "kind"], "at", before, F.col("v"), support=5)
    right = causes.explain(df, ["region", "kind"], "at", slot, F.col("v"), support=5)
    assert wrong["change"] < -60 and -15 < right["change"] < -10
    assert right["nodes"][0]["segment"] == "E" and math.isclose(right["nodes"][0]["contribution"], 100.0)


def test_flags_and_bands_of_the_measure_are_circular(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("v"), (F.col("id") % 5).cast("string").alias("own")).withColumns({"band": F.when(F.col("v") < 30, "low").otherwise("high"), "flag": (F.col("v") > 50).cast("string"), "one": F.lit("x"), "none": F.lit(None).cast("string")})
    got = {r["dimension"]: (r["segments"], r["circular"]) for r in causes.circular(df, ["own", "band", "flag", "one", "none"], [F.col("v")]).collect()}
    assert got == {"own": (5, False), "band": (2, True), "flag": (2, True), "one": (1, False)}
    assert causes.circular(df.limit(0), ["own"], [F.col("v")]).count() == 0


def test_companions_and_missing_sides(spark):
    df = _calls(spark)
    spans = causes.compared(df, "at", "day", 7)
    others = spark.createDataFrame([("a", 100.0, 101.0), ("b", 50.0, 100.0), ("me", 1.0, 1.0), ("none", None, 1.0), ("zero", 1.0, 0.0)], "kpi_id string, current double, baseline double")
    r = causes.explain(df, ["region"], "at", spans, F.col("v"), others=others, kpi_id="me", support=5)
    assert [x["name"] for x in r["ruled_out"] if x["kind"] == "kpi"] == ["a"]
    empty = causes.Spans((datetime(2030, 1, 1), datetime(2030, 1, 2)), spans.baseline, "given")
    assert causes.explain(df, ["region"], "at", empty, F.col("v")) is None
    assert causes.explain(df, [], "at", spans, F.col("v"))["nodes"] == []


def test_segments_that_stop_have_no_growth_gap(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1 + d), s, 10.0) for d, s in [(0, "old")] * 20 + [(0, "both")] * 20 + [(1, "both")] * 20 + [(1, "new")] * 20], "at timestamp, s string, v double")
    m = causes.decompose(causes.moments(df, ["s"], "at", causes.compared(df, "at", "day"), F.col("v")))
    got = {r["segment"]: (r["value0"], r["value1"], r["delta"], r["growth_gap"]) for r in m.collect()}
    assert got == {"old": (200.0, None, -200.0, None), "both": (200.0, 200.0, 0.0, 0.0), "new": (None, 200.0, 200.0, None)}


def test_demo_tables_have_the_columns_and_flaws_of_extracts(spark):
    want = {
        "banking": "transaction_id transaction_date customer_id region customer_segment channel merchant_category card_type customer_tenure transaction_amount interchange_revenue is_fraud is_declined merchant_id acquirer",
        "ecommerce": "order_id order_date customer_id customer_type country marketing_channel product_category device quantity unit_price discount_rate revenue cost_of_goods shipping_cost profit is_returned",
        "marketing": "date campaign_id platform objective creative audience region marketing_spend impressions clicks conversions revenue",
        "retail": "order_date order_id customer_id region category channel quantity unit_price discount_rate revenue cost_of_goods gross_profit return_flag",
        "healthcare": "admission_date encounter_id patient_id region department payer length_of_stay readmission_flag treatment_cost satisfaction_score staffed_beds",
        "hr": "period employee_id region department level tenure_years salary engagement_score training_hours churn_flag headcount",
        "manufacturing": "production_date batch_id region line shift supplier planned_units output_units downtime_minutes scrap_rate defect_flag unit_cost",
        "telesales": "call_date call_block_id campaign agent_type caller_id_pool region lead_source dials connects qualified_leads conversions talk_time_minutes qa_score campaign_spend revenue",
    }
    for kind, columns in want.items():
        assert set(demo.generate(spark, kind, 10).columns) == set(columns.split()), kind
    b = demo.generate(spark, "banking", 20_000)
    r = b.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("transaction_id").alias("u"), F.avg(F.col("merchant_category").isNull().cast("int")).alias("missing"), F.avg(F.when(F.col("channel") == "Online", F.col("is_fraud").cast("int"))).alias("online"), F.avg(F.when(F.col("channel") != "Online", F.col("is_fraud").cast("int"))).alias("other")).first()
    assert r["u"] == 20_000 and 40 < r["n"] - r["u"] < 130 and 0.008 < r["missing"] < 0.017 and r["online"] > 2 * r["other"]
    again = demo.generate(spark, "banking", 20_000).repartition(3)
    assert b.exceptAll(again).count() == 0
    t = demo.generate(spark, "telesales", 5000)
    campaigns, pools = warehouse.seeds(spark)
    assert t.join(campaigns, "campaign", "left_anti").count() == 0 == t.join(pools, "caller_id_pool", "left_anti").count() and (campaigns.count(), pools.count()) == (5, 4)
    health = warehouse.pool_health(warehouse.monthly_funnel(warehouse.staging(t)))
    assert {r["caller_id_pool"] for r in warehouse.latest(health).where("spam_flag_risk").collect()} == {"Pool C"}
    assert t.where("connects > dials OR qualified_leads > connects OR conversions > qualified_leads").count() == 0
