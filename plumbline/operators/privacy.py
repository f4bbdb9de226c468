"""Which columns hold personal data, and display-safe copies of tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import masked, redacted

# What column names say, in order; the first that matches holds.
NAME_RULES = (
    ("email", r"(^|_)e?mail(_|$)|email_address"),
    ("phone", r"phone|mobile|msisdn|telephone|contact_number"),
    ("payment_card", r"card_?(number|no|pan)|credit_?card|pan$|cc_?num"),
    ("national_id", r"ssn|social_security|national_id|aadhaar|nino|passport|tax_?id|pan_?card"),
    ("account", r"iban|account_?(number|no)|sort_?code|routing"),
    ("identifier", r"(^|_)(customer|client|member|patient|employee|user|account|subscriber|merchant)_?id(_|$)"),
    ("person_name", r"(first|last|full|given|sur)_?name|customer_name|patient_name|employee_name"),
    ("address", r"address|street|postcode|post_code|zip_?code|addr_line"),
    ("date_of_birth", r"(date_of_birth|dob|birth_?date)"),
    ("ip_address", r"ip_?address|client_ip|remote_addr"),
    ("geo_precise", r"latitude|longitude|(^|_)lat(_|$)|(^|_)lon(g)?(_|$)|geo_point"),
    ("health", r"diagnosis|icd_?10|icd_?9|medical_record|mrn|treatment_code"),
)
# What values look like.
VALUE_RULES = (
    ("email", r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"),
    ("ip_address", r"^(\d{1,3}\.){3}\d{1,3}$"),
    ("national_id", r"^\d{3}-?\d{2}-?\d{4}$"),
    ("account", r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$"),
    ("phone", r"^\+?[\d][\d\s\-().]{6,17}\d$"),
)


def name_category(column: str) -> str | None:
    return next((c for c, rule in NAME_RULES if re.search(rule, column.lower())), None)


def value_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, one share for each value rule, payment_card): over all non-null values, in one aggregation."""
    cols = columns or [c for c, k in df.dtypes if k == "string"]
    parts, rows = [], []
    for i, c in enumerate(cols):
        x = F.trim(F.col(f"`{c}`"))
        digits = F.regexp_replace(x, r"[ -]", "")
        card = digits.rlike(r"^\d{12,19}$") & F.expr(f"coalesce(luhn_check(if(regexp_replace(trim(`{c}`), '[ -]', '') rlike '^[0-9]+$', regexp_replace(trim(`{c}`), '[ -]', ''), '1')), false)")
        parts += [F.count(x).alias(f"n{i}"), F.coalesce(F.avg(card.cast("double")), F.lit(0.0)).alias(f"card{i}"), *[F.coalesce(F.avg(x.rlike(rule).cast("double")), F.lit(0.0)).alias(f"{k}{i}") for k, rule in VALUE_RULES]]
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"card{i}").alias("payment_card"), *[F.col(f"{k}{i}").alias(k) for k, _ in VALUE_RULES]))
    return df.agg(*parts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def detect(df: DataFrame, majority: float = 0.8) -> dict[str, dict]:
    """column -> category, why, and policy (mask values, or show aggregates only)."""
    shares = {r["column"]: r.asDict() for r in value_shares(df).collect()} if any(k == "string" for _, k in df.dtypes) else {}
    out = {}
    for c in df.columns:
        by_value = next((k for k in ("payment_card", *[k for k, _ in VALUE_RULES]) if shares.get(c, {}).get(k, 0) >= majority), None)
        found = name_category(c) or by_value
        if found:
            out[c] = {"category": found, "evidence": "name" if name_category(c) else "values", "policy": "aggregate_only" if found == "identifier" else "mask"}
    return out


# The SQL profile's rules for names and values, with the way a category is hidden; the first that matches holds.
SQL_NAME_RULES = (
    ("email", r"e[-_]?mail", "partial"),
    ("phone", r"phone|mobile|msisdn|telephone|contact_no", "partial"),
    ("payment_card", r"card|pan|iban|acct_no|account_number|cvv", "partial"),
    ("national_id", r"ssn|nino|aadhaar|passport|national_id|tax_id|pan_no", "redact"),
    ("address", r"address|street|postcode|zip|city_line|geo_point|lat$|lon$|latitude|longitude", "bucket"),
    ("person_name", r"first_name|last_name|full_name|customer_name|patient_name|employee_name|^name$", "hash"),
    ("account_id", r"customer_id|member_id|patient_id|employee_id|user_id|account_id|merchant_id|client_id", "hash"),
    ("health", r"diagnosis|icd|condition|treatment|procedure_code|medication", "bucket"),
)
SQL_VALUE_RULES = (
    ("email", r"(?i)^[^@\s]+@[^@\s]+\.[a-z]{2,}$", "partial"),
    ("phone", r"^(\+?\d[\d\s-]{8,15})$", "partial"),
    ("payment_card", r"^(\d{4}[ -]?){3}\d{4}$", "partial"),
    ("national_id", r"^\d{3}-\d{2}-\d{4}$", "redact"),
)
DATE_SHAPE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([T ]|$)|^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"


def sql_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, dates, one share for each value rule) over all non-empty values, in one aggregation."""
    cols, rows, parts = columns or [c for c, k in df.dtypes if k == "string"], [], []
    for i, c in enumerate(cols):
        x = F.nullif(F.col(f"`{c}`"), F.lit(""))
        shares = {"dates": DATE_SHAPE, **{k: rule for k, rule, _ in SQL_VALUE_RULES}}
        parts += [F.count(x).alias(f"n{i}"), *[F.coalesce(F.avg(x.rlike(rule).cast("double")), F.lit(0.0)).alias(f"{k}{i}") for k, rule in shares.items()]]
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), *[F.col(f"{k}{i}").alias(k) for k in shares]))
    return df.agg(*parts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def detect_sql(df: DataFrame, majority: float = 0.6) -> dict[str, dict]:
    """column -> category, evidence, confidence and masking mode by the SQL profile; columns that hold a date shape are not judged by value."""
    texts = [c for c, k in df.dtypes if k == "string"]
    shares = {r["column"]: r.asDict() for r in sql_shares(df, texts).collect()} if texts else {}
    out = {}
    for c in df.columns:
        seen = shares.get(c, {"dates": 1.0})
        named = next(((k, mode) for k, rule, mode in SQL_NAME_RULES if re.search(rule, c, re.IGNORECASE)), None)
        valued = None if seen["dates"] else next(((k, mode) for k, _, mode in SQL_VALUE_RULES if seen[k] >= majority), None)
        if named or valued:
            (category, mode), evidence = valued or named, "name+value" if named and valued else "value" if valued else "name"
            out[c] = {"category": category, "evidence": evidence, "confidence": {"name+value": 0.98, "value": 0.92, "name": 0.78}[evidence], "mode": mode}
    return out


def mask_frame(df: DataFrame, fields: dict[str, dict], drill_down: bool = False) -> DataFrame:
    """A display-safe copy; computations go on over `df` itself."""
    return df.withColumns({c: masked(c, f["category"]) for c, f in fields.items() if c in df.columns and not (drill_down and f["policy"] == "aggregate_only")})


def redact_frame(df: DataFrame, modes: dict[str, str]) -> DataFrame:
    return df.withColumns({c: redacted(c, m) for c, m in modes.items()})
