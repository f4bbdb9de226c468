"""Typing of text columns: dates by evidence, numbers, derived revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import clean_nulls

# Timestamp formats in order of preference (month before day on ties), as Spark patterns.
FORMATS = (
    "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy/M/d",
    "M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy", "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy",
    "d-M-yyyy H:m:s", "d-M-yyyy", "M-d-yyyy H:m:s", "M-d-yyyy", "d.M.yyyy H:m:s", "d.M.yyyy",
    "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "d-MMMM-yyyy", "yyyyMMdd",
)


def date_formats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, format, parsed): how many values each format reads, all columns and formats in one scan."""
    parts, rows = [], []
    for i, c in enumerate(columns):
        x = F.trim(F.col(f"`{c}`"))
        full = x.isNotNull() & (x != "")
        parts.append(F.count_if(full).alias(f"n{i}"))
        for j, form in enumerate(FORMATS):
            parts.append(F.count_if(full & F.try_to_timestamp(x, F.lit(form)).isNotNull()).alias(f"p{i}_{j}"))
            rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.lit(form).alias("format"), F.lit(j).alias("order"), F.col(f"p{i}_{j}").alias("parsed")))
    return df.agg(*parts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def coerce_dates(df: DataFrame, columns: list[str], least: float = 0.98) -> tuple[DataFrame, dict[str, str]]:
    """Columns whose best format reads enough values become timestamps; values it cannot read become null."""
    best: dict[str, tuple] = {}
    for r in date_formats(df, columns).collect():
        if r["n"] and r["parsed"] / r["n"] >= least and (r["column"] not in best or (-r["parsed"], r["order"]) < best[r["column"]][:2]):
            best[r["column"]] = (-r["parsed"], r["order"], r["format"])
    chosen = {c: b[2] for c, b in best.items()}
    return df.withColumns({c: F.try_to_timestamp(F.trim(F.col(f"`{c}`")), F.lit(f)) for c, f in chosen.items()}), chosen


def coerce_numbers(df: DataFrame, columns: list[str], least: float = 0.9) -> tuple[DataFrame, list[str]]:
    """Text columns that mostly hold numbers become doubles."""
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)], *[F.count(F.col(f"`{c}`").try_cast("double")).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    chosen = [c for i, c in enumerate(columns) if one[f"n{i}"] and one[f"d{i}"] / one[f"n{i}"] >= least]
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in chosen}), chosen


def derive_revenue(df: DataFrame, quantity: str, price: str, name: str = "Revenue") -> DataFrame:
    """Adds quantity times price unless a numeric column already looks like revenue."""
    from plumbline.operators.profile import is_numeric

    if any(is_numeric(k) and any(w in c.lower() for w in ("revenue", "sales", "amount", "total")) for c, k in df.dtypes):
        return df
    return df.withColumn(name, F.col(quantity).try_cast("double") * F.col(price).try_cast("double"))


def repair(df: DataFrame) -> tuple[DataFrame, dict]:
    """Missing tokens, then dates, then numbers, for all text columns."""
    df = clean_nulls(df)
    text = [c for c, k in df.dtypes if k == "string"]
    if not text:
        return df, {"dates": {}, "numbers": []}
    df, dates = coerce_dates(df, text)
    rest = [c for c in text if c not in dates]
    numbers: list[str] = []
    if rest:
        df, numbers = coerce_numbers(df, rest)
    return df, {"dates": dates, "numbers": numbers}
