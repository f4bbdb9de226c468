"""Column builders shared by the operators: coercion, flags, dates, keys, masks. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text that counts as missing in exported files.
NULL_TOKENS = (
    "", " ", "-", "--", "NA", "N/A", "n/a", "na", "NaN", "nan", "NULL", "null",
    "None", "none", "nil", "NIL", "?", "#N/A", "#NA", "#VALUE!", "#REF!", "#DIV/0!",
    "(blank)", "(null)", "unknown", "Unknown", "UNKNOWN", "undefined",
)
# Text that the SQL profile counts as missing.
BLANK_TOKENS = ("", "null", "NULL", "N/A", "n/a", "-", "NaN", "None", "unknown")
# What counts as true, by use.
TRUE_TOKENS = {
    "kpi": ("1", "true", "yes", "y", "t", "fraud", "churned", "returned", "defect"),
    "fraud_value": ("1", "true", "yes", "fraud"),
    "plugin": ("1", "true", "yes", "y", "t"),
    "rootcause": ("1", "true", "yes", "y", "fraud", "churned"),
}
SQL_FLAG = ("1", "true", "True", "TRUE", "Y", "Yes", "yes")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """As double; text that is no number becomes null."""
    return col(c).try_cast("double")


def truthy(c: str | Column, kind: str = "kpi", dtype: str = "string") -> Column:
    """Booleans as they are, numbers above zero, and text in the token set of `kind`."""
    if dtype == "boolean":
        return F.coalesce(col(c), F.lit(False))
    if dtype not in ("string", "varchar", "char"):
        return F.coalesce(col(c) > 0, F.lit(False))
    return F.coalesce(F.lower(F.trim(col(c))).isin(*TRUE_TOKENS[kind]), F.lit(False))


def sql_flag(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("string").isin(*SQL_FLAG), F.lit(False))


def blank(c: str | Column) -> Column:
    return col(c).isNull() | F.trim(col(c).cast("string")).isin(*BLANK_TOKENS)


def clean_nulls(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Text tokens for missing values and NaN become null, in one projection."""
    fix = {}
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "string":
            fix[name] = F.when(~F.trim(c).isin(*{t.strip() for t in tokens}), c)
        elif kind in ("double", "float"):
            fix[name] = F.when(~F.isnan(c), c)
    return df.withColumns(fix) if fix else df


def ratio(top: Column, bottom: Column, scale: float = 1.0) -> Column:
    """top / bottom * scale; null where bottom is zero or null."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double") * F.lit(scale))


def zero_sum(c: Column) -> Column:
    """A sum that is 0 for no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def period(ts: str | Column, grain: str) -> Column:
    """Start of the period as a date (weeks start on Monday)."""
    return F.date_trunc(grain, col(ts)).cast("date")


def in_period(ts: Column, start, end) -> Column:
    """Half-open range: prunes files and row groups, unlike a truncation compared for equality."""
    return (ts >= F.lit(start)) & (ts < F.lit(end))


def month_steps(a: Column, b: Column) -> Column:
    """Calendar months crossed from a to b."""
    return ((F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))).cast("long")


def calendar_index(ts: Column, freq: str) -> Column:
    """A number that grows by one with each calendar day, week, month, quarter or year."""
    if freq == "Y":
        return F.year(ts).cast("long")
    if freq == "Q":
        return (F.year(ts) * 4 + F.quarter(ts) - 1).cast("long")
    if freq == "M":
        return (F.year(ts) * 12 + F.month(ts) - 1).cast("long")
    days = F.datediff(F.date_trunc("week" if freq == "W" else "day", ts), F.lit("1970-01-05").cast("date"))
    return (F.floor(days / 7) if freq == "W" else days).cast("long")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days of 24 hours between two moments, rounded down."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")


def period_label(p: Column, grain: str) -> Column:
    forms = {"day": F.date_format(p, "d MMM yyyy"), "week": F.concat(F.lit("w/c "), F.date_format(p, "d MMM")), "month": F.date_format(p, "MMM yyyy"), "quarter": F.concat(F.lit("Q"), F.quarter(p), F.lit(" "), F.year(p)), "year": F.date_format(p, "yyyy")}
    return forms[grain]


def surrogate_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def pseudonym(c: Column, length: int = 6) -> Column:
    return F.substring(F.sha2(c.cast("string"), 256), 1, length)


def row_key(df: DataFrame) -> Column:
    """One string for all columns of a row; null differs from every text."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns])


def fnv1a(c: Column) -> Column:
    """FNV-1a of a text's UTF-16 units as 32-bit number, by higher-order functions (no Python)."""
    code = lambda x: F.ascii(x).cast("long")  # noqa: E731  the code point
    units = F.transform(F.split(c, ""), lambda x: F.when(code(x) < 65536, F.array(code(x))).otherwise(F.array(55296 + F.shiftright(code(x) - 65536, 10), 56320 + (code(x) - 65536).bitwiseAND(1023))))
    return F.aggregate(F.flatten(units), F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def short_id(c: Column) -> Column:
    """Seven characters in base 36 that stand for a text."""
    return F.lpad(F.conv(fnv1a(c).cast("string"), 10, 36), 7, "0")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def masked(c: str | Column, category: str) -> Column:
    """A display-safe form that keeps the format; null becomes empty."""
    x = col(c).cast("string")
    digits = F.regexp_replace(x, r"\D", "")
    last4 = F.when(F.length(digits) >= 4, F.right(digits, F.lit(4)))
    local, domain = F.substring_index(x, "@", 1), F.regexp_replace(x, r"^[^@]*@", "")
    tail = F.element_at(F.split(F.trim(x), r"\s+"), -1)
    forms = {
        "email": F.when(x.contains("@"), F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.lit(3), F.length(local) - 1)), F.lit("@"), domain)),
        "payment_card": F.coalesce(F.concat(F.lit("**** **** **** "), last4), F.lit("****")),
        "phone": F.coalesce(F.concat(F.lit("***-***-"), last4), F.lit("****")),
        "national_id": F.when(F.length(x) >= 4, F.concat(F.lit("***-**-"), F.right(x, F.lit(4)))).otherwise("****"),
        "ip_address": F.when(F.size(F.split(x, r"\.")) == 4, F.concat(F.substring_index(x, ".", 2), F.lit(".x.x"))).otherwise("x.x.x.x"),
        "person_name": F.concat_ws(" ", F.transform(F.filter(F.split(F.trim(x), r"\s+"), lambda p: p != ""), lambda p: F.concat(F.left(p, F.lit(1)), F.lit(".")))),
        "address": F.when(F.length(tail) <= 10, F.concat(F.lit("[address] "), tail)).otherwise("[address]"),
        "date_of_birth": F.when(F.length(x) >= 4, F.concat(F.left(x, F.lit(4)), F.lit("-**-**"))).otherwise("****"),
        "geo_precise": F.coalesce(F.format_string("%.1f", x.try_cast("double")), F.lit("***")),
    }
    other = F.when(F.length(x) > 4, F.concat(F.left(x, F.lit(2)), F.lit("…"), pseudonym(x))).otherwise(F.concat(F.lit("id-"), pseudonym(x)))
    form = F.coalesce(forms[category], other) if category == "email" else forms.get(category, other)
    return F.when(x.isNull() | (x == ""), F.lit("")).otherwise(form)


def redacted(c: str | Column, mode: str) -> Column:
    """redact, partial, bucket or hash, as the SQL profile shows masked values; null becomes empty."""
    x = col(c).cast("string")
    parts = F.split(x, "@")
    forms = {
        "redact": F.repeat(F.lit("•"), F.least(F.length(x), F.lit(10))),
        "partial": F.when(x.contains("@"), F.concat(F.left(parts[0], F.lit(1)), F.lit("•••@"), parts[1])).when(F.length(x) <= 4, F.lit("••••")).otherwise(F.concat(F.lit("••••"), F.right(x, F.lit(4)))),
        "bucket": F.concat(F.upper(F.left(x, F.lit(2))), F.lit("•••")),
        "hash": F.concat(F.lit("ID-"), short_id(x)),
    }
    return F.when(x.isNull() | (x == ""), F.lit("")).otherwise(forms[mode])
