"""Files in and out: delimited text with sniffed options, JSON, Parquet, workbooks, and report sinks."""

from __future__ import annotations

import csv
import io
import json
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import clean_nulls
from plumbline.operators.repair import derive_revenue, repair
from plumbline.sources import preview

SUFFIXES = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson", ".xlsx": "xlsx", ".xlsm": "xlsx", ".orc": "orc"}


_TORN = "a quoted value runs over lines: read the file with multiline=True"


def load_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool | None = None, schema: str | None = None, skip: int = 0, multiline: bool | None = None) -> DataFrame:
    """Delimited text, every column a string unless a schema is given; tokens for missing values become null.

    Delimiter, header and quoted line breaks are sniffed from the first lines, read by Spark. `skip` leading lines of each file are dropped.
    Files are split among tasks unless quoted values run over lines (`multiline`, or seen in the first lines); a file is one task then.
    Where such a value turns up unannounced, the read fails instead of tearing the record.
    """
    head = [r["value"] for r in spark.read.text(path).limit(200 + skip).collect()][skip:]
    found = preview.sniff("\n".join(head))
    sep, header = sep or found["delimiter"], found["header"] if header is None else header
    if multiline is None:
        multiline = any(line.count('"') % 2 for line in head)
    first = next(csv.reader(io.StringIO("\n".join(head)), delimiter=sep), []) if head else []
    names = [n.strip() for n in first] if header else [f"_c{i}" for i in range(len(first))]
    if len(set(names)) < len(names) or not names or schema:  # Spark names what is doubled
        names = [c.strip() for c in (spark.read.schema(schema) if schema else spark.read.option("sep", sep).option("header", header).option("multiLine", multiline)).csv(path).columns]
    fields = schema or ", ".join(f"`{n}` string" for n in names)
    odd = lambda c: F.length(F.regexp_replace(c, '[^"]', "")) % 2 == 1
    whole = lambda bad: F.when(bad, F.raise_error(F.lit(_TORN)).cast("boolean")).otherwise(F.lit(True))
    if skip and multiline:
        out = _records(spark.read.text(path, wholetext=True), skip + bool(header), sep, len(names)).select(F.from_csv("value", fields, {"sep": ",", "escape": '"', "multiLine": "true"}).alias("r")).select("r.*")
    elif skip:
        lines = _without_head(spark.read.text(path), skip + bool(header)).where(whole(odd("value")))
        out = lines.select(F.from_csv("value", fields, {"sep": sep, "escape": '"'}).alias("r")).select("r.*")
    else:
        reader = spark.read.option("sep", sep).option("header", header).option("ignoreLeadingWhiteSpace", True).option("multiLine", multiline).option("escape", '"')
        torn = "_torn"
        while torn in names:
            torn += "_"
        out = reader.option("columnNameOfCorruptRecord", torn).option("columnPruning", multiline).schema(f"{fields}, `{torn}` string").csv(path)
        if not multiline:
            out = out.where(whole(F.coalesce(odd(torn), F.lit(False))))
        out = out.drop(torn)
    return clean_nulls(out.toDF(*names) if not schema else out)


def _records(files: DataFrame, n: int, sep: str, width: int) -> DataFrame:
    """Records of whole files (value) without their first n lines, as lines of plain CSV that may hold line breaks in quotes."""

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rest = io.StringIO(text, newline="")
                for _ in range(n):
                    rest.readline()
                out = []
                for row in csv.reader(rest, delimiter=sep):
                    if row:
                        line = io.StringIO()
                        csv.writer(line, lineterminator="", quoting=csv.QUOTE_MINIMAL).writerow((row + [""] * width)[:width])
                        out.append(line.getvalue())
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out = []
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return files.select("value").mapInArrow(run, "value string")


def _without_head(text: DataFrame, n: int) -> DataFrame:
    """Lines without the first n of each file: numbers run on inside a split, and only a file's first split holds its head."""
    lines = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))
    starts = lines.where(F.col("_block") == 0).groupBy("_file").agg(F.min("_n").alias("_first"))  # a row for each file
    late = (F.col("_block") > 0) | (F.col("_n") >= F.col("_first") + n)
    return lines.join(F.broadcast(starts), "_file").where(late).select("value")


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Any supported file or folder, by its suffix."""
    kind = SUFFIXES.get(PurePosixPath(path).suffix.lower())
    if kind is None:
        raise ValueError(f"unsupported file type: {path}")
    if kind == "csv":
        return load_csv(spark, path, **options)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind == "ndjson":
        return spark.read.json(path)
    if kind == "xlsx":
        from plumbline.sources import xlsx

        return xlsx.load(spark, path)
    return spark.read.format(kind).load(path)


def ingest(spark: SparkSession, path: str, quantity: str | None = None, price: str | None = None, **options) -> tuple[DataFrame, dict]:
    """Load, repair types, derive revenue. The report says what was changed."""
    df, report = repair(load(spark, path, **options))
    if quantity and price:
        before = df.columns
        df = derive_revenue(df, quantity, price)
        report["derived"] = [c for c in df.columns if c not in before]
    return df, report


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small table from JSON rows, repaired like a file."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    text = spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
    return repair(text)[0]


def random_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows at random, the same ones at every run: those whose hash of (key, seed) is least, by take-ordered."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256), key).limit(n)


def share_sample(df: DataFrame, key: str, percent: float, seed: int = 7) -> DataFrame:
    """Each row with a chance of `percent`, decided by a hash of (key, seed): repeatable, and no shuffle."""
    place = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256), 1, 8), 16, 10).cast("long")
    return df.where(place < int(percent / 100 * 2**32))


def systematic_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows at the places floor(i * N / n) of an order, i below n. The order is total, so ranks come from range partitions."""
    ranked = _ranked(df, order)
    total = df.count()
    wanted = F.floor(F.ceil(F.col("_at") * n / total) * total / n)
    return ranked.where((wanted == F.col("_at")) & (F.lit(total) > n) | (F.lit(total) <= n)).drop("_at")


def _ranked(df: DataFrame, order: str) -> DataFrame:
    """`_at`: the row's place, from counts of range partitions and places within them."""
    parts = df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")  # one row for each partition
    return local.join(F.broadcast(before), "_p").withColumn("_at", F.col("_k") + F.col("_b")).drop("_p", "_k", "_b")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A result as one CSV, JSON or Parquet data set."""
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()


def rows_to_csv(rows: list[dict]) -> str:
    """RFC 4180 text of a small result, with byte-order mark."""
    out = io.StringIO()
    if rows:
        w = csv.DictWriter(out, list(rows[0]), lineterminator="\r\n")
        w.writeheader()
        w.writerows(rows)
    return "﻿" + out.getvalue()


def analysis_rows(analysis: dict, section: str = "", scope: str = "") -> list[dict]:
    """A nested result in long form: section, item, scope, metric, value."""
    out = []
    for k, v in analysis.items():
        if isinstance(v, dict):
            out += analysis_rows(v, section or k, f"{scope}.{k}".strip("."))
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            for i, x in enumerate(v):
                out += analysis_rows(x, section or k, f"{scope}.{k}[{i}]".strip("."))
        else:
            out.append({"section": section or "summary", "item": k, "scope": scope, "metric": k, "value": json.dumps(v, default=str)})
    return out


def markdown(title: str, sections: dict[str, list[str]]) -> str:
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n" + "\n".join(f"- {x}" for x in lines) for name, lines in sections.items()]]) + "\n"
