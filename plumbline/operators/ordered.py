"""Running sums, ranks and exact quantiles in an order over a whole table, without a window over all rows in one task.

The order is cut into ranges by a fixed function of the value: its power of two and the STEPS-th part of it. Sums run
inside a range; each range is then shifted by the total of those before it, a table of ranges, not of rows. The cut is the
same whenever a lost task is computed again, needs no pass of its own, and only spreads the work: results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges in which the values between two powers of two are cut.
STEPS = 4096
#: Above every power of two of a double, so that range numbers of positive values are positive.
OFFSET = 1100 * STEPS


def _number(df: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """A double that grows with the column (not strictly), and the table to take it from."""
    c, kind = F.col(column), dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return df, F.unix_micros(c.cast("timestamp")).cast("double") / 1e6
    if kind == "date":
        return df, F.unix_date(c).cast("double")
    if kind != "string":
        return df, c.cast("double")
    # six bytes behind the prefix that the least and the greatest text share
    ends = df.agg(F.coalesce(F.min(column), F.lit("")).alias("_lo"), F.coalesce(F.max(column), F.lit("")).alias("_hi"))
    shared = ends.select(F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("_lo"), F.lit(1))), lambda i: F.substring("_lo", F.lit(1), i) == F.substring("_hi", F.lit(1), i))).alias("_shared"))
    tail = F.rpad(F.substring(F.hex(F.substring(c, F.col("_shared") + 1, F.lit(6))), 1, 12), 12, "0")
    return df.crossJoin(F.broadcast(shared)), F.conv(tail, 16, 10).cast("double")


def _ranged(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds `name`, the number of the value's range; null lies below and NaN above all others."""
    wide, x = _number(df, column)
    size = F.abs(x)
    power = F.floor(F.log2(size))
    inside = power * STEPS + F.floor((size / F.pow(F.lit(2.0), power) - 1) * STEPS) + OFFSET
    top = 4 * OFFSET
    part = F.when(x.isNull(), -top - 1).when(F.isnan(x) | (x == float("inf")), top).when(x == float("-inf"), -top).when(x == 0, 0).when(x > 0, inside).otherwise(-inside)
    return wide.withColumn(name, part.cast("long")).drop("_shared")


def running(df: DataFrame, column: str, weight: str, by: list[str] | None = None, down: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds `_before`: the sum of `weight` over the rows that come earlier by (column, *ties), for each group of `by`.

    Rows with one value of `column` share a range, so hand over distinct values with their counts. Nulls come first
    upwards and last downwards.
    """
    by = by or []
    placed = _ranged(df, column, "_range")
    way: Column = F.desc(column) if down else F.asc(column)
    inside = Window.partitionBy(*by, "_range").orderBy(way, *ties).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_range").agg(F.sum(weight).alias("_sum"))
    above = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("_range") if down else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = totals.select(*by, "_range", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_shift"))
    out = placed.withColumn("_inner", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(shift, [*by, "_range"])
    return out.withColumn("_before", F.col("_inner") + F.col("_shift")).drop("_range", "_inner", "_shift")


def numbered(df: DataFrame, column: str, key: str) -> DataFrame:
    """Adds `_place`: 1 for the first row by (column, key), and so on. `key` is unique; rows that tie on `column` are spread by it."""
    cut = _ranged(df, key, "_stripe")
    cells = cut.groupBy(column, "_stripe").agg(F.count(F.lit(1)).alias("_n"))
    before = running(cells, column, "_n", ties=("_stripe",)).select(F.col(column).alias("_value"), F.col("_stripe").alias("_s"), "_before")
    own = Window.partitionBy(column, "_stripe").orderBy(key)
    rows = cut.withColumn("_own", F.row_number().over(own))
    joined = rows.join(before, F.col(column).eqNullSafe(F.col("_value")) & (F.col("_stripe") == F.col("_s")))
    return joined.withColumn("_place", F.col("_own") + F.col("_before")).drop("_own", "_before", "_value", "_s", "_stripe")


def quantiles(df: DataFrame, columns: list[str], probabilities: tuple[float, ...]) -> DataFrame:
    """(column, n, quantiles): exact, with linear interpolation; a column without values has no row.

    A first pass counts ranges (a table of ranges after partial counts). They tell which ranges hold the wanted places, at
    most two for each column and probability; a second pass shuffles the values of those alone.
    """
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c.strip('`')}`").cast("double").alias("value")) for c in columns])).alias("r")).select("r.*").where("value is not null")
    tall = _ranged(tall, "value", "_range")
    whole = Window.partitionBy("column")
    counts = tall.groupBy("column", "_range").agg(F.count(F.lit(1)).alias("_k"))
    ranges = counts.withColumn("n", F.sum("_k").over(whole)).withColumn("_start", F.sum("_k").over(whole.orderBy("_range")) - F.col("_k"))

    def places(p: float) -> tuple[Column, Column, Column]:
        at = F.lit(p) * (F.col("n") - 1)
        return F.floor(at), F.ceil(at), at

    holds = lambda place, first, size: (F.col(first) <= place) & (place < F.col(first) + F.col(size))
    wanted = F.lit(False)
    for p in probabilities:
        low, high, _ = places(p)
        wanted = wanted | holds(low, "_start", "_k") | holds(high, "_start", "_k")
    near = tall.join(F.broadcast(ranges.where(wanted).drop("_k")), ["column", "_range"])
    values = near.groupBy("column", "n", "_range", "_start", "value").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("column", "_range").orderBy("value")
    placed = values.withColumn("_before", F.col("_start") + F.sum("_n").over(own) - F.col("_n"))
    ends = []
    for i, p in enumerate(probabilities):
        low, high, _ = places(p)
        ends += [F.max(F.when(holds(low, "_before", "_n"), F.col("value"))).alias(f"a{i}"), F.max(F.when(holds(high, "_before", "_n"), F.col("value"))).alias(f"b{i}")]

    def mix(i: int, p: float) -> Column:
        low, high, at = places(p)
        return F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"a{i}")).otherwise((high - at) * F.col(f"a{i}") + (at - low) * F.col(f"b{i}"))

    return placed.groupBy("column", "n").agg(*ends).select("column", "n", F.array(*[mix(i, p) for i, p in enumerate(probabilities)]).alias("quantiles"))
