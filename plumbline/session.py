"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "plumbline", master: str | None = None, **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes follow the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"} | {k.replace("__", "."): v for k, v in more.items()}
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
