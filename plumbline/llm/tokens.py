"""Token counts of documents in flat, unindexed token files.

A token file is nothing but identifiers, each document followed by an end-of-document identifier; no index
says where documents begin. Files are read in blocks of fixed size that ignore document bounds. Each block is
searched for the separator in one vectorised comparison; a scan over block summaries (tokens, separators, place
of the last separator) then gives every block its offset, its first document's number and the open document it
continues. The scan has two levels, so one very large file needs no single task over all its blocks.

Nulls: a null or empty text is a document of no tokens. Tokens behind a file's last separator form a last
document that is marked incomplete. Rows that repeat are documents of their own. Empty tables give no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import encoder

#: Tokens of a block.
BLOCK = 1 << 18
#: Blocks that one group of the scan's first level holds.
GROUP = 1024


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 50256, block: int = BLOCK) -> DataFrame:
    """Each partition of `docs` as one flat file in blocks: (file, block, data), and its manifest: (file, nth, doc_id).

    Identifiers are little-endian unsigned 16-bit numbers. A text's own end-of-document strings are plain text, so
    `end_id` never occurs inside a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, file = encoder(tokenizer, literal_specials=True).ids, TaskContext.get().partitionId()
        open_block, number, nth = array("H"), 0, 0
        for batch in batches:
            data, first = [], number
            for text in batch.column(1):
                open_block.frombytes(np.frombuffer(ids_of(text.as_py()), np.uint32).astype("<u2").tobytes())
                open_block.append(end_id)
                while len(open_block) >= block:
                    data.append(open_block[:block].tobytes())
                    del open_block[:block]
                    number += 1
            yield rows(file, first, data, nth, batch.column(0).to_pylist())
            nth += len(batch)
        if open_block:
            yield rows(file, number, [open_block.tobytes()], 0, [])

    def rows(file: int, first: int, data: list[bytes], nth: int, docs: list) -> pa.RecordBatch:
        n, m = len(data), len(docs)
        number, nths = [*range(first, first + n), *[None] * m], [*[None] * n, *range(nth, nth + m)]
        columns = [pa.array([file] * (n + m), pa.int32()), pa.array(number, pa.int64()), pa.array([*data, *[None] * m], pa.binary()), pa.array(nths, pa.int64()), pa.array([*[None] * n, *docs], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["file", "block", "data", "nth", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file int, block long, data binary, nth long, doc_id long")


def read_flat(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, data) of flat files that other writers left; a file is read by one task, up to 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer())
                cuts = range(0, len(data), width * block)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cuts)), pa.array(range(len(cuts)), pa.int64()), pa.array([data[i : i + width * block] for i in cuts], pa.binary())], names=["file", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, data binary")


def scan(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """(file, nth, start, n_tokens, complete): every document of every file."""
    kind = blocks.schema["file"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer() or b"", f"<u{width}")
                size.append(len(ids)), at.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(at, pa.list_(pa.int64()))], names=["file", "block", "size", "at"])

    found = blocks.select("file", "block", "data").mapInArrow(find, f"file {kind}, block long, size long, at array<long>")
    near = Window.partitionBy("file", "_group").orderBy("block")
    far = Window.partitionBy("file").orderBy("_group")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    group = found.withColumn("_group", F.floor(F.col("block") / GROUP))
    inner = (
        group.withColumn("_from", F.coalesce(F.sum("size").over(before(near)), F.lit(0)))
        .withColumn("_docs", F.coalesce(F.sum(F.size("at")).over(before(near)), F.lit(0)))
        .withColumn("_last", F.max(F.col("_from") + F.try_element_at("at", F.lit(-1))).over(before(near)))
    )
    sums = group.groupBy("file", "_group").agg(F.sum("size").alias("_n"), F.sum(F.size("at")).alias("_d"))
    ends = inner.groupBy("file", "_group").agg(F.max(F.coalesce(F.col("_from") + F.try_element_at("at", F.lit(-1)), F.col("_last"))).alias("_e"))
    outer = (
        sums.join(ends, ["file", "_group"])
        .withColumn("_from0", F.coalesce(F.sum("_n").over(before(far)), F.lit(0)))
        .withColumn("_docs0", F.coalesce(F.sum("_d").over(before(far)), F.lit(0)))
        .withColumn("_last0", F.max(F.col("_from0") + F.col("_e")).over(before(far)))
    )
    whole = inner.join(outer.select("file", "_group", "_from0", "_docs0", "_last0"), ["file", "_group"]).select(
        "file", "block", "size", "at",
        (F.col("_from") + F.col("_from0")).alias("_from"), (F.col("_docs") + F.col("_docs0")).alias("_docs"),
        F.coalesce(F.col("_last") + F.col("_from0"), F.col("_last0"), F.lit(-1)).alias("_last"),
    )
    each = whole.select("file", "_from", "_docs", "_last", "at", F.posexplode("at").alias("_k", "_end"))
    start = F.when(F.col("_k") == 0, F.col("_last") + 1).otherwise(F.col("_from") + F.get("at", F.col("_k") - 1) + 1)
    done = each.select("file", (F.col("_docs") + F.col("_k")).alias("nth"), start.alias("start"), (F.col("_from") + F.col("_end") - start).alias("n_tokens"), F.lit(True).alias("complete"))
    tail = outer.groupBy("file").agg(F.sum("_n").alias("_n"), F.sum("_d").alias("nth"), (F.max(F.coalesce(F.col("_from0") + F.col("_e"), F.lit(-1))) + 1).alias("start"))
    rest = tail.where("start < _n").select("file", "nth", "start", (F.col("_n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return done.unionAll(rest)
