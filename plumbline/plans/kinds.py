"""What columns mean and what a table is about: tables of rules and words, applied to profiles as DataFrames.

A profile has one row for each column; it comes from one scan of the data, however many rules there are. Evidence for a domain is a
join of names, roles and values with the words of `vocabulary`, summed by domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import ratio
from plumbline.plans import vocabulary as V

_NUMERIC = "type RLIKE '^(tinyint|smallint|int|bigint|float|double|decimal.*)$'"
#: (condition over name, type, distinct_values, rows, low, high; kind): the first that holds decides.
KIND_RULES: tuple[tuple[str, str], ...] = (
    ("type RLIKE '^(timestamp|date)'", "datetime"),
    ("type = 'boolean'", "boolean"),
    (f"{_NUMERIC} AND distinct_values <= 2 AND coalesce(low, 0) >= 0 AND coalesce(high, 1) <= 1", "boolean"),
    (f"{_NUMERIC} AND name RLIKE '{V.PERCENT}'", "percentage"),
    (f"{_NUMERIC} AND name RLIKE '{V.MONEY}'", "currency"),
    (f"{_NUMERIC} AND name RLIKE '{V.COUNT}'", "count"),
    (f"name RLIKE '{V.KEY}' AND distinct_values > 0.5 * rows", "identifier"),
    (_NUMERIC, "numeric"),
    ("distinct_values > 0.6 * rows AND distinct_values > 200", "text"),
    ("distinct_values <= greatest(60, 0.05 * rows)", "categorical"),
    ("true", "text"),
)


def facts(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, type, rows, distinct_values, low, high): one scan; `exact=False` counts distinct values by sketches (about 2 % off)."""
    kinds = dict(df.dtypes)
    distinct = (lambda c: F.count_distinct(c)) if exact else (lambda c: F.approx_count_distinct(c, 0.02))
    number = lambda c: F.col(f"`{c}`").cast("double") if kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") else F.lit(None).cast("double")
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.struct(F.lit(c).alias("column"), F.lit(k).alias("type"), F.count(F.lit(1)).alias("rows"), distinct(F.col(f"`{c}`")).alias("distinct_values"), F.min(number(c)).alias("low"), F.max(number(c)).alias("high")).alias(f"_c{i}") for i, (c, k) in enumerate(df.dtypes)])
    return row.select(F.explode(F.array(*[f"_c{i}" for i in range(len(df.columns))])).alias("x")).select("x.*")


def kinds(profile: DataFrame) -> DataFrame:
    """A profile (`facts`) with each column's kind."""
    named = profile.withColumn("name", F.lower("column"))
    return named.withColumn("kind", F.coalesce(*[F.when(F.expr(when), kind) for when, kind in KIND_RULES])).drop("name")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def sql_domains(columns: DataFrame) -> DataFrame:
    """(domain, points, place, confidence) of column names (column), by the SQL profile; a table without any evidence has no rows and is generic."""
    order = {d: i for i, (_, d, _) in reversed(list(enumerate(V.SQL_NAME_POINTS)))}
    words = _rows(columns.sparkSession, [(w, d, p, order[d]) for w, d, p in V.SQL_NAME_POINTS], "words string, domain string, points int, place int")
    hits = columns.join(words, F.expr("lower(column) RLIKE words"))
    first = F.min(F.struct(F.col("at"), F.col("place")))
    sums = hits.withColumn("at", F.col("position") if "position" in columns.columns else F.lit(0)).groupBy("domain").agg(F.sum("points").alias("points"), first.alias("_first"))
    return _ranked(sums, F.least(F.lit(0.97), 0.45 + 0.5 * F.col("share")), 2)


def _ranked(sums: DataFrame, confidence, places: int) -> DataFrame:
    w = Window.partitionBy(F.lit(0))  # a row for each domain
    out = sums.withColumn("place", F.row_number().over(w.orderBy(F.desc("points"), "_first")).cast("int"))
    out = out.withColumns({"share": ratio(F.col("points"), F.sum("points").over(w)), "_top": F.max("points").over(w), "_next": F.coalesce(F.max(F.when(F.col("place") > 1, F.col("points"))).over(w), F.lit(0.0))})
    return out.withColumn("confidence", F.when(F.col("place") == 1, F.round(confidence, places))).select("domain", "points", "place", "confidence")


def domains(df: DataFrame, roles: dict[str, str] | None = None, texts: list[str] | None = None, values: int = 60) -> DataFrame:
    """(domain, points, place, confidence) from names, roles and the values of text columns.

    Values: the `values` first distinct ones of each of `texts` (at most 12 columns; all text columns where not given), as lower-cased text, are held
    against the words in one scan; a word counts once. Below four points the table is generic (a row `generic` of confidence 0.35 leads).
    """
    spark = df.sparkSession
    names = [(c, F.regexp_replace(F.lower(F.lit(c)), "[^a-z0-9]+", "_")) for c in df.columns]
    base = spark.range(1)
    columns = base.select(F.explode(F.array(*[F.trim(n, F.lit("_")) for _, n in names])).alias("name"))
    name_words = _rows(spark, [(d, t, p) for d, own in V.NAME_POINTS.items() for t, p in own.items()], "domain string, token string, points double")
    found = columns.join(name_words, F.contains(F.col("name"), F.col("token"))).select("domain", "points")
    bound = [(d, p) for d, own in V.ROLE_POINTS.items() for r, p in own.items() if r in (roles or {})]
    if bound:
        found = found.unionAll(spark.createDataFrame(bound, "domain string, points double"))
    some = ([c for c, k in df.dtypes if k == "string"] if texts is None else texts)[:12]
    if some:
        value_words = _rows(spark, [(d, t) for d, own in V.VALUES.items() for t in own], "domain string, token string")
        tall = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.trim(F.lower(F.col(f"`{c}`"))).alias("v")) for i, c in enumerate(some)])).alias("x")).select("x.*").where("v IS NOT NULL")
        first = tall.distinct().withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("v"))).where(F.col("k") <= values)
        hits = first.join(value_words, F.contains(F.col("v"), F.col("token"))).select("domain", "token").distinct()
        found = found.unionAll(hits.select("domain", F.lit(V.VALUE_POINTS)))
    every = _rows(spark, [(d, i) for i, d in enumerate(V.NAME_POINTS)], "domain string, _first int")
    sums = every.join(found.groupBy("domain").agg(F.sum("points").alias("points")), "domain", "left").fillna(0.0, ["points"])
    ranked = _ranked(sums, F.least(F.lit(0.99), 0.45 * 2.2 * F.coalesce("share", F.lit(0.0)) + 0.55 * F.coalesce(ratio(F.col("_top") - F.col("_next"), F.col("_top")), F.lit(0.0)) + 0.15), 3)
    weak = F.max("points").over(Window.partitionBy(F.lit(0))) < 4
    ranked = ranked.withColumn("_weak", weak)
    generic = ranked.where("_weak AND place = 1").select(F.lit("generic").alias("domain"), F.lit(0.0).alias("points"), F.lit(0).alias("place"), F.lit(0.35).alias("confidence"))
    return ranked.select("domain", "points", "place", F.when(~F.col("_weak"), F.col("confidence")).alias("confidence")).unionAll(generic)
