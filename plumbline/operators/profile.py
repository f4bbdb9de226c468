"""Column profiles, keys and inclusion, each from as few passes as the numbers allow."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import ordered, sketches

NUMERIC = ("byte", "tinyint", "short", "smallint", "int", "bigint", "float", "double", "decimal")


def is_numeric(kind: str) -> bool:
    return kind.startswith(NUMERIC)


def counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, n, missing, missing_pct, distinct_values, unique_pct, is_unique, is_constant) in one aggregation.

    Exact distinct counts send every row once for each column; with `exact=False` sketches of bounded size are sent instead, distinct_values
    is within 5 % and a column counts as unique where it may be.
    """
    cols = df.columns
    if not exact:
        e = sketches.estimates(sketches.column_sketches(df)).select("column", "n", "missing", "distinct_values")
        near = (F.col("distinct_values") >= (1 - sketches.DISTINCT_ERROR) * F.col("n")) & (F.col("n") > 0)
        of = lambda a, b: F.when(b > 0, F.round(100 * a / b, 4)).otherwise(F.lit(0.0))
        return e.select("column", "n", "missing", of(F.col("missing"), F.col("n") + F.col("missing")).alias("missing_pct"), "distinct_values", of(F.least("distinct_values", "n"), F.col("n")).alias("unique_pct"), near.alias("is_unique"), (F.col("distinct_values") <= 1).alias("is_constant"))
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)], *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n"), (F.col("_n") - F.col(f"c{i}")).alias("missing"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(cols)]))
    r = one.select("_n", rows.alias("r")).select("_n", "r.*")
    pct = lambda a, b: F.when(b > 0, F.round(100 * a / b, 4)).otherwise(F.lit(0.0))
    return r.select("column", "n", "missing", pct(F.col("missing"), F.col("_n")).alias("missing_pct"), "distinct_values", pct(F.col("distinct_values"), F.col("n")).alias("unique_pct"), ((F.col("distinct_values") == F.col("n")) & (F.col("n") > 0)).alias("is_unique"), (F.col("distinct_values") <= 1).alias("is_constant"))


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, low, high, mean, median, std, p05, p25, p75, p95, zeros, negatives, skewness, kurtosis).

    Percentiles are exact, from ordered ranges of counted values. Skewness and excess kurtosis use the sample deviation.
    """
    cols = columns or [c for c, k in df.dtypes if is_numeric(k)]
    parts = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        parts += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.count_if(x == 0).alias(f"z{i}"), F.count_if(x < 0).alias(f"g{i}"), F.skewness(x).alias(f"k{i}"), F.kurtosis(x).alias(f"u{i}")]
    one = df.agg(*parts)
    rows = []
    for i, c in enumerate(cols):
        shrink = (F.col(f"n{i}") - 1) / F.col(f"n{i}")
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"z{i}").alias("zeros"), F.col(f"g{i}").alias("negatives"), (F.col(f"k{i}") * F.pow(shrink, F.lit(1.5))).alias("skewness"), ((F.col(f"u{i}") + 3) * F.pow(shrink, F.lit(2)) - 3).alias("kurtosis")))
    moments = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    q = F.broadcast(ordered.quantiles(df, cols, (0.05, 0.25, 0.5, 0.75, 0.95)).select("column", F.col("quantiles").alias("q")))  # a row for each column
    return moments.join(q, "column", "left").select("column", "n", "low", "high", "mean", F.col("q")[2].alias("median"), "std", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p25"), F.col("q")[3].alias("p75"), F.col("q")[4].alias("p95"), "zeros", "negatives", "skewness", "kurtosis")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """(levels, entropy, hhi): Shannon entropy in bits and the sum of squared shares, without a window over all values.

    With N = sum n: H = log2 N - sum(n log2 n) / N, and HHI = sum(n * n) / N**2.
    """
    v = value_counts(df, column)
    total = F.sum("n").cast("double")
    return v.agg(F.count(F.lit(1)).alias("levels"), (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"), (F.sum(F.col("n").cast("double") * F.col("n")) / (total * total)).alias("hhi"))


def top_values(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """(value, n, pct): the k most frequent values, ties by value."""
    n = df.agg(F.count(column).alias("_n"))
    return value_counts(df, column).orderBy(F.desc("n"), "value").limit(k).crossJoin(F.broadcast(n)).select("value", "n", F.round(100 * F.col("n") / F.col("_n"), 4).alias("pct"))


# Units of time steps in seconds, the first that a median step fits is the granularity.
UNITS = {"minute": 60, "hourly": 3600, "daily": 86400, "weekly": 604800, "monthly": 2592000, "quarterly": 7776000, "yearly": 31536000}
#: Seconds of the stretches in which neighbouring dates are looked for on their own (about twelve days).
STRETCH = 1 << 20


def date_granularity(df: DataFrame, column: str) -> DataFrame:
    """(dates, median_gap, granularity, gaps): from the distinct dates of a column; null below three dates, no gaps if irregular.

    Steps are taken inside stretches of time; only the last date of each stretch is carried to the next one. The
    median is weighted over distinct steps.
    """
    dates = df.select(F.unix_timestamp(F.col(column).cast("timestamp")).alias("t")).where("t is not null").distinct().withColumn("s", F.floor(F.col("t") / STRETCH))
    ends = dates.groupBy("s").agg(F.max("t").alias("end")).select("s", F.lag("end").over(Window.orderBy("s")).alias("before"))  # a row for each twelve days
    steps = dates.select("s", "t", F.lag("t").over(Window.partitionBy("s").orderBy("t")).alias("p")).join(ends, "s").select((F.col("t") - F.coalesce("p", "before")).alias("gap"))
    counts = steps.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dates"), F.percentile("gap", F.lit(0.5), F.expr("if(gap is null, 0, n)")).alias("median_gap"))
    name, unit = F.lit("irregular"), F.lit(None).cast("long")
    for label, seconds in reversed(UNITS.items()):
        fits = F.col("median_gap") <= 1.35 * seconds
        name, unit = F.when(fits, label).otherwise(name), F.when(fits, F.lit(seconds).cast("long")).otherwise(unit)
    enough = F.col("dates") >= 3
    stats = stats.select("dates", "median_gap", F.when(enough, name).alias("granularity"), F.when(enough, unit).alias("_unit"))
    over = F.sum(F.when(F.col("gap") > 1.6 * F.col("_unit"), F.col("n")).otherwise(0))
    same = [F.max(c).alias(c) for c in ("median_gap", "granularity", "_unit")]  # one value each
    out = counts.crossJoin(F.broadcast(stats)).agg(F.coalesce(F.max("dates"), F.lit(0)).alias("dates"), *same, over.alias("g"))
    return out.select("dates", "median_gap", "granularity", F.when(F.col("_unit").isNotNull(), F.col("g")).alias("gaps"))


def key_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(first, second, distinct_pairs, is_key) of all pairs of candidate columns, in one aggregation."""
    pairs = list(combinations(columns[:12], 2))
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_distinct(F.struct(F.coalesce(F.col(a).cast("string"), F.lit("\x00")), F.coalesce(F.col(b).cast("string"), F.lit("\x00")))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"p{i}").alias("distinct_pairs"), (F.col(f"p{i}") == F.col("_n")).alias("is_key")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def inclusion(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """(child_values, contained, ratio): how many distinct child values the parent column has."""
    values = child.select(F.col(child_column).alias("v")).where("v is not null").distinct()
    parents = parent.select(F.col(parent_column).alias("v")).where("v is not null").distinct().withColumn("_in", F.lit(1))
    return values.join(parents, "v", "left").agg(F.count(F.lit(1)).alias("child_values"), F.count("_in").alias("contained")).withColumn("ratio", F.when(F.col("child_values") > 0, F.col("contained") / F.col("child_values")))


def sample_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """(column, samples): the k least distinct values of each column, as text; no order of rows.

    A task keeps k values a column while it reads, so what is shuffled does not grow with the values.
    """
    cols = columns or df.columns

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[str]] = [[] for _ in cols]
        for batch in batches:
            for i in range(len(cols)):
                some = pc.unique(batch.column(i)).drop_null().to_pylist()
                kept[i] = heapq.nsmallest(k, {*kept[i], *some}, key=lambda v: v.encode())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, own in zip(cols, kept) for _ in own], pa.string()), pa.array([v for own in kept for v in own], pa.string())], names=["column", "value"])

    text = df.select(*[F.col(f"`{c}`").cast("string") for c in cols])
    few = text.mapInArrow(least, "column string, value string")
    return few.groupBy("column").agg(F.slice(F.array_sort(F.collect_set("value")), 1, k).alias("samples"))


def midnight(df: DataFrame, column: str) -> DataFrame:
    """(all_midnight): whether every time of a column stands at midnight, so that it is a date."""
    x = F.col(column).cast("timestamp")
    return df.agg(F.coalesce(F.every(x == F.date_trunc("day", x)), F.lit(False)).alias("all_midnight"))


def key_score(column: str, table: str, kind: str) -> float:
    """How much a unique, complete column looks like the table's key: by its name, what it means and the table's name."""
    named = column.lower() == "id" or column.lower().endswith(("_id", "id", "key", "code", "number", "uuid"))
    return 1.0 + 1.0 * named + 0.75 * (kind == "identifier") + 0.5 * column.lower().startswith(table.lower().rstrip("s"))


def primary_key(df: DataFrame, table: str = "dataset") -> list[str]:
    """The unique column that looks most like a key, else the first pair of candidates that is unique; [] if none."""
    kinds = dict(df.dtypes)
    rows = [r.asDict() for r in counts(df).collect()]
    means = {r["column"]: semantic_type(r["column"], kinds[r["column"]], r["n"], r["missing"], r["distinct_values"]) for r in rows}
    single = [r["column"] for r in rows if r["is_unique"] and not r["missing"]]
    if single:
        return [max(single, key=lambda c: key_score(c, table, means[c]))]
    whole = ("identifier", "categorical", "date", "datetime", "ordinal", "geo")
    some = [r["column"] for r in rows if r["n"] and not r["missing"] and not r["is_constant"] and means[r["column"]] in whole]
    if len(some) < 2:
        return []
    return list(next(iter(sketches.key_candidates(df, list(combinations(some[:12], 2)))), ()))


def table_schema(df: DataFrame, table: str = "dataset") -> dict:
    """Columns by what they are for: times, measures, dimensions, identifiers and the primary key."""
    kinds = dict(df.dtypes)
    means = {r["column"]: semantic_type(r["column"], kinds[r["column"]], r["n"], r["missing"], r["distinct_values"]) for r in counts(df).collect()}
    pick = lambda *what: [c for c, m in means.items() if m in what]
    return {"types": means, "times": pick("date", "datetime"), "measures": pick("numeric", "currency", "count", "percentage"), "dimensions": pick("boolean", "categorical", "ordinal", "geo"), "identifiers": pick("identifier"), "primary_key": primary_key(df, table)}


def cardinality_issues(profile: DataFrame, categories: list[str]) -> DataFrame:
    """(column, issue, affected): from `counts`, constant columns and categories with more than half of the rows (50 at least) as values."""
    rows = F.col("n") + F.col("missing")
    crowded = F.col("column").isin(*categories) & (F.col("distinct_values") > F.greatest(F.lit(50.0), 0.5 * rows))
    issue = F.when(F.col("is_constant") & (F.col("n") > 0), "constant").when(crowded, "cardinality")
    return profile.select("column", issue.alias("issue"), F.when(F.col("is_constant"), rows).otherwise(F.col("distinct_values")).alias("affected")).where("issue is not null")


def gap_issue(granularity: DataFrame) -> DataFrame:
    """(granularity, gaps): a row if periods are missing, from `date_granularity`."""
    return granularity.where("gaps > 0").select("granularity", "gaps")


def name_bonus(child: str, parent: str) -> float:
    """What a foreign-key candidate's name adds to its containment."""
    return 0.05 if child == parent else 0.02 if child.lower().endswith(("id", "key")) else -0.10


def semantic_type(name: str, kind: str, n: int, missing: int, distinct: int, low=None, high=None, shares: dict[str, float] | None = None) -> str:
    """What a column means, from its type and aggregates. shares: of values that look like e-mail, url, phone, and mean_length."""
    lower, shares = name.lower(), shares or {}
    unique = distinct / n if n else 0.0
    id_like = lower == "id" or lower.endswith(("_id", "id", "_key", "key", "_code", "uuid", "sku"))
    if n == 0:
        return "empty"
    if distinct <= 1:
        return "constant"
    if kind.startswith("timestamp"):
        return "datetime"
    if kind == "date":
        return "date"
    if kind == "boolean":
        return "boolean"
    if is_numeric(kind):
        if id_like and unique > 0.5:
            return "identifier"
        if any(w in lower for w in ("pct", "percent", "rate", "ratio", "share")):
            return "percentage"
        if any(w in lower for w in ("price", "amount", "revenue", "cost", "total", "balance", "salary", "spend", "profit")):
            return "currency"
        whole = not kind.startswith(("float", "double", "decimal"))
        if whole and distinct <= 2:
            return "boolean"
        if whole and any(w in lower for w in ("count", "qty", "quantity", "units", "num")):
            return "count"
        return "ordinal" if whole and distinct <= 12 else "numeric"
    for what, least in (("email", 0.8), ("url", 0.8)):
        if shares.get(what, 0) > least:
            return what
    if shares.get("phone", 0) > 0.9 and unique > 0.5:
        return "phone"
    if id_like and unique > 0.5:
        return "identifier"
    if any(w in lower for w in ("country", "region", "city", "state", "nation")):
        return "geo"
    return "text" if shares.get("mean_length", 0) > 45 or unique > 0.7 else "categorical"
