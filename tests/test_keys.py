"""Foreign-key search, mergeable sketches, order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import keys, profile, sketches
from plumbline.plans import evidence


def test_references_are_found_across_number_types(spark):
    parent = spark.range(100).select(F.col("id").alias("shop_id"), F.concat(F.lit("shop "), "id").alias("name"))
    sales = spark.range(500).select((F.col("id") % 80).cast("double").alias("shop_id"), (F.col("id") % 90).cast("int").alias("store_key"), (F.col("id") % 70).alias("place"), (F.col("id") + 0.5).alias("amount"), F.lit(1).alias("one"), F.concat(F.lit("shop "), F.col("id") % 50).alias("label"), F.current_timestamp().alias("at"))
    got = {(r["child"], r["parent"]): (r["matched"], r["ratio"], r["confidence"]) for r in keys.foreign_keys({"shops": parent, "sales": sales}, {"shops": "shop_id"}).collect()}
    assert got == {("sales.shop_id", "shops.shop_id"): (80, 1.0, 1.0), ("sales.store_key", "shops.shop_id"): (90, 1.0, 1.0)}  # `place` has no name of a key, `one` one value
    assert {(r["child"], r["parent"]) for r in keys.foreign_keys({"shops": parent, "sales": sales}, min_match=0.9).collect()} >= {("sales.place", "shops.shop_id")}
    broken = sales.withColumn("shop_id", F.when(F.col("amount") > 490, F.col("amount")).otherwise(F.col("shop_id")))
    assert not [r for r in keys.foreign_keys({"shops": parent, "sales": broken}, {"shops": "shop_id"}).collect() if r["child"] == "sales.shop_id"]
    assert keys.foreign_keys({"shops": parent.limit(0), "sales": sales.limit(0)}, {"shops": "shop_id"}).count() == 0
    assert not keys.foreign_keys({"shops": parent, "sales": sales}, {"shops": "shop_id"}, but=("sales.shop_id", "sales.store_key")).collect()


def test_sketches_of_parts_are_those_of_the_whole(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("day"), (F.col("id") * 7919 % 10_007).alias("k"), F.sqrt("id").alias("x"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), F.col("id") % 40)).alias("s"), F.lit(None).cast("string").alias("none"))
    parts = sketches.column_sketches(df, ["day"])
    assert parts.count() == 7 * 4
    merged = {r["column"]: r for r in sketches.estimates(sketches.merge(parts)).collect()}
    whole = {r["column"]: r for r in sketches.estimates(sketches.column_sketches(df.drop("day"))).collect()}
    assert merged.keys() == whole.keys() == {"k", "x", "s", "none"}
    for c, m in merged.items():
        w = whole[c]
        assert (m["n"], m["missing"], m["low"], m["high"]) == (w["n"], w["missing"], w["low"], w["high"])
        assert m["mean"] == pytest.approx(w["mean"]) and m["std"] == pytest.approx(w["std"])
    assert abs(merged["k"]["distinct_values"] - 10_007) <= sketches.DISTINCT_ERROR * 10_007 and merged["s"]["distinct_values"] == 40
    assert merged["none"]["distinct_values"] == 0 and merged["none"]["quantiles"] is None and merged["s"]["std"] is None
    for q, got in zip((0.05, 0.25, 0.5, 0.75, 0.95), merged["x"]["quantiles"]):
        assert abs(got * got / 20_000 - q) <= sketches.RANK_ERROR
    stored = spark.createDataFrame(parts.collect(), parts.schema)  # as read from a table
    assert {r["column"]: r["n"] for r in sketches.merge(stored, ["day"]).where("day = 3").collect()} == {"k": 2857, "x": 2857, "s": 1904, "none": 0}


def test_ranks_of_estimates_are_exact(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, -0.0, 0.0, 1e300, -7.5, rng.random()]), "t") for _ in range(3000)]
    df = spark.createDataFrame(rows, "k int, `x.y` double, s string").repartition(5)
    found = spark.createDataFrame([("x.y", 1, [-7.5, 0.0, 0.5]), ("k", 2, [0.0, 12.0, 40.0]), ("s", 3, None)], "column string, tag int, quantiles array<double>")
    got = {r["column"]: r for r in sketches.ranks(df, found, ["k", "x.y"], 3).collect()}
    for i, c in enumerate(("k", "x.y")):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[c]["below"] == [sum(v < q for v in values) for q in got[c]["quantiles"]]
        assert got[c]["upto"] == [sum(v <= q for v in values) for q in got[c]["quantiles"]]
    assert [got[c]["tag"] for c in ("x.y", "k", "s")] == [1, 2, 3] and got["s"]["below"] is None and got["s"]["upto"] is None
    none = sketches.ranks(df.limit(0), found, ["k", "x.y"], 3).collect()
    assert {r["column"]: r["upto"] for r in none} == {"k": [0, 0, 0], "x.y": [0, 0, 0], "s": None}


def _largest_parts(plan) -> list[int]:
    """Bytes of the largest partition of each shuffle of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _largest_parts(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        own = [max(plan.mapStats().get().bytesByPartitionId())] if kind == "ShuffleQueryStageExec" and plan.mapStats().isDefined() else []
        return own + _largest_parts(plan.plan())
    return [x for i in range(plan.children().size()) for x in _largest_parts(plan.children().apply(i))]


def test_no_task_of_the_sketched_profile_gets_all_values(spark, tmp_path):
    lines = spark.range(200_000).select(F.col("id").alias("l_orderkey"), (F.col("id") * 7919 % 50_021).alias("l_partkey"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"), (F.sqrt("id") + 900).alias("l_extendedprice"), F.when(F.col("id") % 9 > 0, F.col("id").cast("string").substr(1, 1)).alias("l_returnflag"), F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast(id % 90 as int))").alias("l_shipdate"))
    lines.coalesce(2).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = evidence.profile_sketches(spark, str(tmp_path))
        got = {r["column"]: r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {c: (r["n"], r["missing"], r["low"], r["high"]) for c, r in got.items()} == {"l_orderkey": (200_000, 0, 0, 199_999), "l_partkey": (200_000, 0, 0, 50_020), "l_quantity": (200_000, 0, 1, 50), "l_extendedprice": (200_000, 0, 900, 900 + 199_999 ** 0.5), "l_returnflag": (177_777, 22_223, None, None)}
    assert all(r["distinct_close"] and r["quantiles_close"] for r in got.values())
    parts = _largest_parts(df._jdf.queryExecution().executedPlan())
    assert len(parts) > 2 and max(parts) < 300_000, parts  # a map of all values of four columns, for their percentiles, took megabytes


def test_keys_by_sketch_are_exact(spark):
    df = spark.range(3000).select((F.col("id") % 60).cast("string").alias("a"), (F.col("id") / 60).cast("int").cast("string").alias("b"), (F.col("id") % 2999).cast("string").alias("near"), F.lit("x").alias("c"))
    assert sketches.key_candidates(df, [("a", "c"), ("near", "c"), ("a", "b")]) == [("a", "b")]
    assert sketches.key_candidates(df, []) == [] and profile.primary_key(df.drop("near")) == ["a", "b"]
    few = {r["column"]: r for r in profile.counts(df, exact=False).collect()}
    assert few["near"]["is_unique"] and not few["a"]["is_unique"] and few["c"]["is_constant"]


def test_order_of_arrival_over_stretches(spark):
    rng = random.Random(4)
    rows = [(k * 9000, rng.random() if rng.random() < 0.2 else float(k)) for k in range(60)] + [(1, None), (None, 5.0)]
    real = sorted((k, v) for k, v in rows if k is not None and v is not None)
    breaks = sum(b[1] < a[1] for a, b in zip(real, real[1:]))
    r = keys.monotonic(spark.createDataFrame(rows, "k long, v double").repartition(4), "v", "k").first()
    assert breaks > 3 and (r["rows"], r["breaks"], r["monotonic"]) == (60, breaks, False)
    rising = spark.range(200_000).select("id", (F.col("id") / 3).cast("int").alias("v"))
    assert tuple(keys.monotonic(rising, "v", "id").first()) == (200_000, 0, True)
    assert tuple(keys.monotonic(rising.limit(0), "v", "id").first()) == (0, 0, True)


def test_samples_are_bounded_and_least(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), F.format_string("%04d", 4999 - F.col("id"))).alias("a"), F.when(F.col("id") % 2 == 0, "é").alias("b"), F.lit(None).cast("string").alias("c")).repartition(6)
    got = {r["column"]: r["samples"] for r in profile.sample_values(df, k=3).collect()}
    assert got == {"a": ["k0000", "k0001", "k0002"], "b": ["é"]}
