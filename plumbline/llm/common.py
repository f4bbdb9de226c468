"""Shared plumbing of the training-data operators: table access, scratch tables, Arrow helpers.

Everything that leaves a task goes through Spark readers and writers, so inputs and scratch space may
sit in any store Spark can open, and any task can be run again on another executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Root of the repository; Python workers get it on their path.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Stands for a null id wherever ids are compared: it sorts before every real id.
NULL_ID = -(2**63)
#: White space of the contracts, as a regular expression class body (Java and Python).
WS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, with the package on the workers' path."""
    share_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_path(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset and Spark runs in one process (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf is None:
        conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return conf.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that scratch() made for `df`, once all that reads it is written."""
    jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs whose plans are out of use."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        time.sleep(0.2)  # dropped Python objects reach the JVM in the background
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def id_key(col: str | Column) -> Column:
    """The id as a non-null long for comparisons and joins; null sorts first."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID)).cast("long")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of `df` has, for columns that come and go inside an operator."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def carried(df: DataFrame, new) -> list[str]:
    """The columns of `df` that stay beside the columns `new`: Spark does not tell names apart by case."""
    taken = {c.lower() for c in new}
    return [c for c in df.columns if c.lower() not in taken]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 byte strings; null becomes empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of about `limit` bytes; a longer row has a range of its own."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def put(batch: pa.RecordBatch, new: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    """Columns `names` in order, from `new` where present, else from the batch."""
    return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)
