"""Mergeable column sketches: what a profile keeps of a partition, a day or a source, to be stored and merged instead of counted again.

A sketch row holds, for one column: rows, missing values, moments, extremes, a HyperLogLog sketch of the distinct values (lgK = 12: relative standard
error 1.04 / 64, 1.6 %) and, of numbers, a KLL sketch (k = 200: rank error about 1.65 %). State is bounded for any number of rows; merging is
associative, so sketches of parts give those of the whole. Exact forms stay in `profile` (`counts`, `numeric_summary`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import ratio

LG_K, KLL_K = 12, 200
#: Relative error of a distinct count and absolute error of a rank that hold in all but about one case in a thousand.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.0266
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_NUMBER = (*_WHOLE, "float", "double", "decimal")


def hashable(c: Column, kind: str) -> Column:
    """A value as one the HyperLogLog sketch takes: whole numbers as they are, all else as text."""
    return c.cast("bigint") if kind in _WHOLE else c.cast("string")


def column_sketches(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., column, n, missing, low, high, total, squares, distinct_sketch, rank_sketch): one scan for all columns, one row for each and group."""
    by = by or []
    parts, rows = [], []
    for i, (c, kind) in enumerate((c, k) for c, k in df.dtypes if c not in by):
        x = F.col(f"`{c}`")
        number = x.cast("double") if kind.split("(")[0] in _NUMBER else F.lit(None).cast("double")
        ranks = F.kll_sketch_agg_double(number, F.lit(KLL_K)) if kind.split("(")[0] in _NUMBER else F.first(F.lit(None).cast("binary"))
        parts += [F.count(x).alias(f"n{i}"), F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.sum(number).alias(f"t{i}"), F.sum(number * number).alias(f"q{i}"), F.hll_sketch_agg(hashable(x, kind.split("(")[0]), LG_K).alias(f"d{i}"), ranks.alias(f"r{i}")]
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), (F.col("_n") - F.col(f"n{i}")).alias("missing"), F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high"), F.col(f"t{i}").alias("total"), F.col(f"q{i}").alias("squares"), F.col(f"d{i}").alias("distinct_sketch"), F.col(f"r{i}").alias("rank_sketch")))
    one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *parts)
    return one.select(*by, F.explode(F.array(*rows)).alias("x")).select(*by, "x.*")


def merge(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketch rows of parts (of any number of runs, stored or not) as those of the whole, or of each group `by`."""
    return sketches.groupBy(*(by or []), "column").agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("rank_sketch", F.lit(KLL_K)).alias("rank_sketch"))


def estimates(sketches: DataFrame, quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(by..., column, n, missing, distinct_values, low, high, mean, std, quantiles): what sketch rows say of their columns."""
    some = F.col("high").isNotNull()
    q = F.when(some, F.kll_sketch_get_quantile_double("rank_sketch", F.array(*[F.lit(float(x)) for x in quantiles])))
    mean = ratio(F.col("total"), F.col("n"))
    std = F.when(some & (F.col("n") > 1), F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / (F.col("n") - 1))))
    keep = [c for c in sketches.columns if c not in ("n", "missing", "low", "high", "total", "squares", "distinct_sketch", "rank_sketch")]
    return sketches.select(*keep, "n", "missing", F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"), "low", "high", mean.alias("mean"), std.alias("std"), q.alias("quantiles"))


def ranks(df: DataFrame, found: DataFrame, columns: list[str], quantiles: int) -> DataFrame:
    """The rows of `found` (estimates of the columns of `df`, one row for each) with `below` and `upto`, null for others than `columns`: how many values
    lie under each of its `quantiles` quantiles, and how many up to it. One scan compares with them and counts; no value is kept or shuffled.

    Rank sketches are random, so estimates made twice may differ: the rows go through the scan instead of being joined to its result.
    """
    own = lambda c: F.get(F.filter("_found", lambda r: r["column"] == c), F.lit(0))["quantiles"]
    each = [(i, c, k) for i, c in enumerate(columns) for k in range(quantiles)]
    one = found.agg(F.collect_list(F.struct(*found.columns)).alias("_found")).select("_found", *[F.get(own(c), F.lit(k)).alias(f"_q{i}_{k}") for i, c, k in each])  # a row for each column
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    numbers = numbers.unionAll(df.sparkSession.range(0, 1, 1, 1).select(*[F.lit(None).cast("double")] * len(columns)))  # carries the rows past a table without any
    counts = [F.count_if(test).alias(f"{name}{i}_{k}") for i, _, k in each for name, test in (("below", F.col(f"_x{i}") < F.col(f"_q{i}_{k}")), ("upto", F.col(f"_x{i}") <= F.col(f"_q{i}_{k}")))]
    row = numbers.crossJoin(F.broadcast(one)).agg(F.first("_found").alias("_found"), *counts)
    of = lambda name: F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.array(*[F.col(f"{name}{i}_{k}") for k in range(quantiles)]))])
    rows = row.select(F.explode("_found").alias("_r"), of("below").alias("_b"), of("upto").alias("_u"))
    return rows.select("_r.*", F.col("_b")[F.col("_r.column")].alias("below"), F.col("_u")[F.col("_r.column")].alias("upto"))


def key_candidates(df: DataFrame, pairs: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Of some column combinations those that identify rows, in their order: sketches of all in one scan, exact counts of the few that may."""
    if not pairs:
        return []
    text = lambda p: F.concat_ws("\x01", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in p])
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.hll_sketch_estimate(F.hll_sketch_agg(text(p), LG_K)).alias(f"p{i}") for i, p in enumerate(pairs)]).first()
    near = [p for i, p in enumerate(pairs) if r[f"p{i}"] >= (1 - DISTINCT_ERROR) * r["n"]]
    if not near:
        return []
    exact = df.agg(*[F.count_distinct(text(p)).alias(f"p{i}") for i, p in enumerate(near)]).first()
    return [p for i, p in enumerate(near) if exact[f"p{i}"] == r["n"]]
