"""Catalog and database tables, and a small cache of loaded data sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ident(name: str) -> str:
    """A quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def save(df: DataFrame, name: str, partition_by: list[str] | None = None, bucket_by: tuple[int, str] | None = None) -> None:
    """Drop and write a catalog table; bucketing lets later joins on its key skip the shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(*bucket_by).sortBy(bucket_by[1])
    writer.saveAsTable(name)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table; with a numeric key and its bounds, in parallel ranges. Decimals become doubles."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    df = reader.load()
    return df.withColumns({c: F.col(ident(c)).cast("double") for c, k in df.dtypes if k.startswith("decimal")})


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, truncate="true", **options).mode("overwrite").save()


def describe(spark: SparkSession, name: str) -> list[tuple[str, str, bool]]:
    """(column, type, nullable) of a table or view."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in spark.table(name).schema.fields]


class Datasets:
    """Named data sets, loaded once; their analyses too."""

    def __init__(self):
        self._load: dict[str, Callable[[], DataFrame]] = {}
        self._frames: dict[str, DataFrame] = {}
        self._results: dict[tuple, object] = {}

    def register(self, name: str, load: Callable[[], DataFrame]) -> None:
        self._load[name] = load

    def names(self) -> list[str]:
        return sorted(self._load)

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._load[name]().persist()
        return self._frames[name]

    def sample(self, name: str, limit: int = 25) -> list[dict]:
        df = self.frame(name)
        shown = df.withColumns({c: F.date_format(ident(c), "yyyy-MM-dd HH:mm:ss") for c, k in df.dtypes if k.startswith("timestamp")})
        return [r.asDict() for r in shown.limit(limit).collect()]

    def result(self, name: str, kind: str, work: Callable[[DataFrame], object]) -> object:
        key = (name, kind)
        if key not in self._results:
            self._results[key] = work(self.frame(name))
        return self._results[key]

    def reset(self) -> None:
        for df in self._frames.values():
            df.unpersist()
        self._frames.clear()
        self._results.clear()
