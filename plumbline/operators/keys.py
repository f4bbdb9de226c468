"""Keys and references across tables, found by the values their columns share, and order of arrival."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import profile

# Names that look like keys; what a name adds to a containment or takes off it.
KEY_NAME = r"(^|_)(id|key|code|number|no|uuid|guid)$|key$|id$"
SAME, KEYLIKE, OTHER = 0.05, 0.02, -0.10
_NUMBER = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _canonical(c: Column, kind: str) -> Column:
    """A value as text that is equal where values are equal across number types; numbers and texts never meet."""
    if kind.split("(")[0] in _NUMBER:
        whole = c.cast("decimal(38, 0)")
        return F.concat(F.lit("n"), F.when(c == whole, whole.cast("string")).otherwise(c.cast("double").cast("string")))
    return F.concat(F.lit("s"), c.cast("string"))


def shared_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(a, b, both): how many distinct values columns a and b share, for all pairs of columns of all tables (named table.column), a = b included.

    An inverted index from one shuffle: each value meets the set of columns that hold it. Sets are counted before they are
    taken apart into pairs, so pairs come from the few distinct sets, not from values.
    """
    parts = []
    for name, df in tables.items():
        cells = [F.struct(F.lit(f"{name}.{c}").alias("column"), _canonical(F.col(f"`{c}`"), k).alias("value")) for c, k in df.dtypes]
        parts.append(df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("value IS NOT NULL"))
    index = reduce(DataFrame.unionAll, parts).groupBy("value").agg(F.array_sort(F.collect_set("column")).alias("columns"))
    sets = index.groupBy("columns").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select(F.explode("columns").alias("a"), "columns", "n").select("a", F.explode("columns").alias("b"), "n")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("both"))


def foreign_keys(tables: dict[str, DataFrame], keys: dict[str, str] | None = None, min_match: float = 0.95, but: tuple[str, ...] = ()) -> DataFrame:
    """(child, parent, matched, ratio, confidence): columns whose distinct values nearly all stand in another table's key.

    keys: each table's key column; where not given, its complete and unique column that looks most like one. Dates and columns of one value only are
    no children, nor those named in `but` (table.column). The name settles close cases: the key's own name, one that looks like a key, another.
    """
    if keys is None:
        found = {name: profile.primary_key(df) for name, df in tables.items()}
        keys = {name: k[0] for name, k in found.items() if len(k) == 1}
    usable = {name: df.select(*[f"`{c}`" for c, k in df.dtypes if not k.startswith(("timestamp", "date", "array", "map", "struct", "binary", "boolean"))]) for name, df in tables.items()}
    shared = shared_values(usable)
    own = shared.where("a = b").select(F.col("a").alias("_c"), F.col("both").alias("values"))
    parents = [f"{t}.{c}" for t, c in keys.items()]
    x = shared.where(F.col("b").isin(parents) & ~F.col("a").isin(*but) & (F.substring_index("a", ".", 1) != F.substring_index("b", ".", 1)))
    x = x.join(F.broadcast(own.withColumnRenamed("_c", "a").withColumnRenamed("values", "child_values")), "a").join(F.broadcast(own.withColumnRenamed("_c", "b").withColumnRenamed("values", "parent_values")), "b")  # a row for each column
    x = x.where("child_values >= 2 AND child_values <= parent_values").withColumn("ratio", F.col("both") / F.col("child_values"))
    child, parent = F.lower(F.substring_index("a", ".", -1)), F.lower(F.substring_index("b", ".", -1))
    bonus = F.when(child == parent, SAME).when(child.rlike(KEY_NAME), KEYLIKE).otherwise(OTHER)
    x = x.where(F.col("ratio") >= min_match).withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("ratio") + bonus), 4))
    return x.where(F.col("confidence") >= min_match).select(F.col("a").alias("child"), F.col("b").alias("parent"), F.col("both").alias("matched"), F.round("ratio", 4).alias("ratio"), "confidence")


#: Rows that arrived next to each other are compared in stretches of so many arrival numbers.
STRETCH = 1 << 16


def monotonic(df: DataFrame, column: str, arrival: str) -> DataFrame:
    """(rows, breaks, monotonic): whether a column never falls in order of arrival (a whole number); null values are passed over.

    Rows are compared inside stretches of arrival numbers; only the last value of each stretch goes on to the next one.
    """
    x = df.select(F.col(column).alias("v"), F.col(arrival).cast("long").alias("k")).where("v IS NOT NULL AND k IS NOT NULL").withColumn("s", F.floor(F.col("k") / STRETCH))
    inside = x.withColumn("_before", F.lag("v").over(Window.partitionBy("s").orderBy("k", "v")))
    falls = inside.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("_before")).alias("falls"), F.min_by("v", F.struct("k", "v")).alias("first"), F.max_by("v", F.struct("k", "v")).alias("last"))
    edges = falls.withColumn("_before", F.lag("last").over(Window.orderBy("s")))  # a row for each stretch
    total = F.coalesce(F.sum(F.col("falls") + F.coalesce((F.col("first") < F.col("_before")).cast("long"), F.lit(0))), F.lit(0))
    return edges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), total.alias("breaks"), (total == 0).alias("monotonic"))
