"""Data quality checks. Each returns counts; weights and grades are applied to the collected row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import blank, ratio
from plumbline.operators import ordered, profile

# Weights of the dimensions, by profile (completeness, uniqueness, validity, consistency, outliers/cardinality, timeliness).
WEIGHTS = {"core": (0.30, 0.15, 0.20, 0.10, 0.15, 0.10), "sql": (0.28, 0.18, 0.18, 0.14, 0.12, 0.10)}
EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"


def missing(df: DataFrame, tokens: bool = False) -> DataFrame:
    """(cells, missing_cells, completeness); with `tokens`, text that stands for nothing counts too."""
    kinds = dict(df.dtypes)
    gone = [F.count_if(blank(f"`{c}`") if tokens and kinds[c] == "string" else F.col(f"`{c}`").isNull()) for c in df.columns]
    one = df.agg((F.count(F.lit(1)) * len(df.columns)).alias("cells"), sum(gone[1:], gone[0]).alias("missing_cells"))
    return one.withColumn("completeness", 100 - ratio(F.col("missing_cells"), F.col("cells"), 100))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """(row_count, distinct_rows, duplicates): null equals null."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_rows"), (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates"))


def key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n): key values that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validity(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One column for each rule: how many rows break it. All rules share one scan."""
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])


def negative(c: str) -> Column:
    return F.col(c) < 0


def outside_percentage(c: str, scale: float) -> Column:
    return (F.col(c) < 0) | (F.col(c) > scale)


def implausible_date(c: str, as_of: str) -> Column:
    day = F.lit(as_of).cast("timestamp_ntz") + F.expr("interval 1 day")
    return (F.col(c) > day) | (F.col(c) < F.lit("1970-01-01").cast("timestamp_ntz"))


def bad_email(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).rlike(EMAIL)


def casing(df: DataFrame, c: str) -> DataFrame:
    """(row_count, inconsistent): values with outer blanks, or whose spelling differs from others only by case.

    Counted over distinct spellings, so the join is as small as the column's vocabulary.
    """
    spelling = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    spelling = spelling.withColumn("t", F.trim("v")).withColumn("l", F.lower("t"))
    words = spelling.groupBy("l").agg(F.count_distinct("t").alias("forms"))
    return spelling.join(words, "l").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.when((F.col("v") != F.col("t")) | (F.col("forms") > 1), F.col("n")).otherwise(0)), F.lit(0)).alias("inconsistent"))


def tukey(df: DataFrame, c: str, reach: float = 1.5) -> DataFrame:
    """(low_fence, high_fence, outliers, share_of_total)."""
    x = F.col(c).cast("double")
    q = ordered.quantiles(df.select(x.alias("x")), ["x"], (0.25, 0.75)).select(F.col("quantiles").alias("q")).select((F.col("q")[0] - reach * (F.col("q")[1] - F.col("q")[0])).alias("low_fence"), (F.col("q")[1] + reach * (F.col("q")[1] - F.col("q")[0])).alias("high_fence"))
    out = (x < F.col("low_fence")) | (x > F.col("high_fence"))
    return df.select(x.alias(c)).crossJoin(F.broadcast(q)).groupBy("low_fence", "high_fence").agg(F.count_if(out).alias("outliers"), ratio(F.sum(F.when(out, F.abs(x)).otherwise(0.0)), F.sum(F.abs(x)), 100).alias("share_of_total"))


def robust_outliers(df: DataFrame, c: str, reach: float = 1.5, z: float = 3.5) -> DataFrame:
    """(n, median, mad, outliers): beyond the fences and beyond `z` scaled median deviations."""
    x = F.col(c).cast("double")
    values = df.select(x.alias("x")).where("x is not null")
    row = ordered.quantiles(values, ["x"], (0.25, 0.5, 0.75)).first()  # three numbers; literals keep the passes apart
    low, middle, high = row["quantiles"] if row else (None, None, None)
    middle = F.lit(middle).cast("double")
    dev = ordered.quantiles(values.select(F.abs(F.col("x") - middle).alias("d")), ["d"], (0.5,)).first()
    dev = F.lit(dev["quantiles"][0] if dev else None).cast("double")
    spread = values.agg(F.stddev_samp("x").alias("_s"))
    scale = F.when(dev > 0, 1.4826 * dev).otherwise(F.col("_s"))
    width = reach * (F.lit(high).cast("double") - F.lit(low).cast("double"))
    out = ((F.col("x") < F.lit(low).cast("double") - width) | (F.col("x") > F.lit(high).cast("double") + width)) & (F.abs(F.col("x") - middle) / scale > z)
    return values.crossJoin(F.broadcast(spread)).agg(F.count(F.lit(1)).alias("n"), F.max(middle).alias("median"), F.max(dev).alias("mad"), F.count_if(out).alias("outliers"))


def timeliness(df: DataFrame, date: str, as_of: str, tolerance: int = 45) -> DataFrame:
    """(latest, age_days, core_score, sql_score)."""
    one = df.agg(F.max(date).cast("date").alias("latest")).withColumn("age_days", F.datediff(F.lit(as_of).cast("date"), F.col("latest")).cast("long"))
    core = F.greatest(F.lit(0.0), 100 - 1.5 * F.greatest(F.lit(0), F.col("age_days") - tolerance).cast("double"))
    steps = F.when(F.col("age_days") <= 7, 100).when(F.col("age_days") <= 31, 92).when(F.col("age_days") <= 93, 80).when(F.col("age_days") <= 366, 62).otherwise(40)
    return one.withColumn("core_score", core).withColumn("sql_score", steps.cast("long"))


def accepted(df: DataFrame, c: str, values: list[str]) -> DataFrame:
    """(violations): rows whose value is none of `values`."""
    return df.agg(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values)).alias("violations"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(violations): child rows whose key no parent has."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti").agg(F.count(F.lit(1)).alias("violations"))


# Share of rows from which an issue is critical; days that data of a granularity may be old.
CRITICAL = 30
TOLERANCE = {"hourly": 2, "daily": 7, "weekly": 21, "monthly": 75, "quarterly": 200, "yearly": 500}


def dimensions(df: DataFrame, as_of: str, date: str | None = None, amounts: tuple[str, ...] = (), shares: tuple[str, ...] = (), emails: tuple[str, ...] = (), categories: tuple[str, ...] = (), measures: tuple[str, ...] = ()) -> DataFrame:
    """One row: completeness, uniqueness, validity, consistency, accuracy, timeliness, each from 0 to 100, their weighted score, and
    whether an issue is critical: it touches CRITICAL percent of the rows (negative amounts never are, they may be refunds).

    amounts must not be negative; shares lie in 0..1, or 0..100 if any is beyond 1.5; categories are checked for
    spelling; measures of 20 values or more for outliers. A table without rows is complete and valid but for nothing.
    """
    q = lambda c: f"`{c}`"
    count = lambda c: F.coalesce(F.count_if(F.coalesce(c, F.lit(False))), F.lit(0))
    refunds = [count(negative(q(c))) for c in amounts]
    broken = [count(bad_email(q(c))) for c in emails]
    broken += [F.when(F.max(F.abs(F.col(q(c)))) > 1.5, count(outside_percentage(q(c), 100))).otherwise(count(outside_percentage(q(c), 1))) for c in shares]
    broken += [count(implausible_date(q(date), as_of))] if date else []
    constant = [F.when(F.coalesce(F.min(q(c)) == F.max(q(c)), F.lit(True)), 1).otherwise(0) for c in df.columns]
    gone = [count(F.col(q(c)).isNull()) for c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("n"), sum(gone, F.lit(0)).alias("missing"), sum(refunds + broken, F.lit(0)).alias("invalid"), F.greatest(F.lit(0), F.lit(0), *gone, *broken).alias("worst"), sum(constant, F.lit(0)).alias("constant"))
    one = one.crossJoin(F.broadcast(exact_duplicates(df).select("duplicates")))
    for i, c in enumerate(categories):
        one = one.crossJoin(F.broadcast(casing(df, q(c)).select(F.col("inconsistent").alias(f"c{i}"))))
    for i, c in enumerate(measures):
        one = one.crossJoin(F.broadcast(robust_outliers(df, q(c)).select(F.when(F.col("n") >= 20, F.col("outliers")).otherwise(0).alias(f"o{i}"))))
    late = F.lit(100.0)
    if date:
        one = one.crossJoin(F.broadcast(profile.date_granularity(df, date).select("granularity"))).crossJoin(F.broadcast(timeliness(df, date, as_of).select("age_days")))
        most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOLERANCE.items() for x in kv]), F.coalesce("granularity", F.lit("daily"))), F.lit(30))
        late = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 1.5 * F.greatest(F.lit(0), F.col("age_days") - most))), F.lit(100.0))
    cells, part = F.col("n") * len(df.columns), lambda a, b: F.when(b > 0, 100 * a / b).otherwise(0.0)
    total = lambda letter, names: sum((F.col(f"{letter}{i}") for i in range(len(names))), F.lit(0))
    parts = {
        "completeness": 100 - part(F.col("missing"), cells), "uniqueness": 100 - F.least(2 * part(F.col("duplicates"), F.col("n")), F.lit(100.0)),
        "validity": 100 - F.least(4 * part(F.col("invalid") + total("c", categories), cells), F.lit(100.0)), "consistency": 100 - F.least(100.0 * F.col("constant") / max(1, len(df.columns)), F.lit(40.0)),
        "accuracy": 100 - F.least(1.5 * part(total("o", measures), F.col("n")), F.lit(100.0)), "timeliness": late,
    }
    worst = F.greatest("worst", "duplicates", *[F.col(f"c{i}") for i in range(len(categories))])
    out = one.select(*[F.round(c.cast("double"), 2).alias(k) for k, c in parts.items()], (part(worst, F.col("n")) >= CRITICAL).alias("critical"))
    return out.withColumn("score", F.round(sum(w * F.col(k) for w, k in zip(WEIGHTS["core"], parts)), 2))


def score(parts: tuple[float, ...], profile: str = "core") -> float:
    return sum(w * p for w, p in zip(WEIGHTS[profile], parts))


def grade(total: float, profile: str = "core", critical: bool = False, rows: int = 30) -> tuple[str, bool]:
    """Letter, and whether the data may be used."""
    if profile == "core":
        letter = next((g for g, least in (("A+", 95), ("A", 90), ("B", 80), ("C", 70), ("D", 60)) if total >= least), "F")
        return letter, not critical and total >= 50
    return next((g for g, least in (("A", 90), ("B", 80), ("C", 70), ("D", 60)) if total >= least), "E"), total >= 60 and rows >= 30
