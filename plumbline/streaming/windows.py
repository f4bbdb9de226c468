"""KPIs over streams: tumbling, sliding and session windows with watermarks, and an alarm that keeps state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, ts: str = "ts", files_per_trigger: int = 4) -> DataFrame:
    """A folder of Parquet files as a stream; its time column becomes a proper timestamp, as watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def window_kpis(events: DataFrame, ts: str, value: str, by: list[str], size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, stop, by..., n, total); works on batches and streams alike."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n", "total")


def session_kpis(events: DataFrame, ts: str, entity: str, value: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), entity).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), entity, "n", "total")


def cusum_alarms(events: DataFrame, key: str, value: str, target: float, spread: float, threshold: float = 5.0, drift: float = 0.5) -> DataFrame:
    """(key, value, side) whenever a key's two-sided cumulative sum passes the threshold; it restarts there. State is two numbers."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down = state.get if state.exists else (0.0, 0.0)
        out = []
        for frame in frames:
            for v in frame[value].dropna():
                z = (float(v) - target) / spread
                up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
                if max(up, down) > threshold:
                    out.append((str(k[0]), float(v), "up" if up > down else "down"))
                    up = down = 0.0
        state.update((up, down))
        yield pd.DataFrame(out, columns=["key", "value", "side"])

    return events.groupBy(key).applyInPandasWithState(run, "key string, value double, side string", "up double, down double", "append", GroupStateTimeout.NoTimeout)
