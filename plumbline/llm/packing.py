"""Best-fit packing of tokenised documents into fixed-size sequences by large-item matching.

A sequence holds at most two pieces longer than a third of it, so those are paired greedily, largest with
the largest that still fits beside it; shorter pieces then go, in falling size, to the fullest sequence
with room. Pieces of one length are interchangeable, so the driver packs *counts by length* (at most
`capacity` of them, whatever the corpus size) and gets a plan: runs "these ranks of length x go to these
sequences at this offset". Executors rank the pieces of each length and look their place up in the plan.

Nulls and ties: a null text is an empty document (only the end-of-document id); rows that repeat are packed
as documents of their own; a null doc_id is allowed. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import encoder
from plumbline.llm.common import scratch

#: Rows of one length and rank block; bounds what a single window task sorts.
BLOCK_ROWS = 20_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and `end_id`, cut only beyond `capacity`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                every = ids_of(text.as_py())
                every.append(end_id)
                first = len(every) % capacity or min(len(every), capacity)
                bounds = [0, *range(first, len(every) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    packed = every[a:b].tobytes()
                    doc.append(d), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(packed))
                    if keep_ids:
                        ids.append(packed)
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Runs by length, and the number of sequences. A run (first rank, first sequence, offset) holds up to the next one.

    Sequences of a run are numbered on from its first; a run never leaves its group of equally filled sequences.
    """
    left = {n: c for n, c in counts.items() if c}
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # sequences (first, count) by the room they have left
    made = 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs[length].append((taken[length], first, offset))
        taken[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    large = sorted(n for n in left if 3 * n > capacity)
    while large:  # pair the largest with the largest that fits beside it
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        b = large[k] if k >= 0 else 0
        count = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        if b and not count:  # a single one of its length: its partner is shorter
            b = large[k - 1] if k >= 1 else 0
            count = 1
            if b:
                count = min(left[a], left[b])
        place(a, count, made, 0)
        if b:
            place(b, count, made, a)
        groups[capacity - a - b].append((made, count))
        made += count
        large = [n for n in large if n in left]
    rooms = sorted(groups)
    for n in sorted(left, reverse=True):  # at most a third: to the fullest sequence with room, else to new ones
        while n in left:
            k = bisect.bisect_left(rooms, n)
            if k == len(rooms):
                each = capacity // n
                full, rest = divmod(left[n], each)
                for count, held in ((full, each), (min(rest, 1), rest)):
                    if count:
                        for j in range(held):
                            place(n, count, made, j * n)
                        _add(groups, rooms, capacity - held * n, (made, count))
                        made += count
                continue
            room = rooms[k]
            first, count = groups[room].pop()
            if not groups[room]:
                rooms.pop(k)
            now = min(count, left[n])
            place(n, now, first, capacity - room)
            if now < count:
                _add(groups, rooms, room, (first + now, count - now))
            _add(groups, rooms, room - n, (first, now))
    return dict(runs), made


def _add(groups: dict, rooms: list[int], room: int, group: tuple[int, int]) -> None:
    if room not in rooms:
        bisect.insort(rooms, room)
    groups[room].append(group)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces that have doc_id, piece and length."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    total = sum(counts.values())
    blocks = max(1, -(-total // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32"), F.lit(blocks)).cast("int")
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    local = cut.withColumn("_block", block).withColumn("_at", F.row_number().over(Window.partitionBy("length", "_block").orderBy(*order)) - 1)
    sizes = cut.withColumn("_block", block).groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("length", "_block", (F.sum("_n").over(Window.partitionBy("length").orderBy("_block")) - F.col("_n")).alias("_before"))
    ranked = local.join(before, ["length", "_block"]).withColumn("_rank", F.col("_at") + F.col("_before"))
    shared = spark.sparkContext.broadcast({n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()})  # a few runs for each of at most `capacity` lengths
    names = [c for c in cut.columns]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                ranks, first, place = at[int(n)]
                k = np.searchsorted(ranks, rank[rows], "right") - 1
                sequence[rows] = first[k] + rank[rows] - ranks[k]
                offset[rows] = place[k]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*names, "_rank").mapInArrow(settle, f"{fields}, sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenise once, keep the pieces in a shared table, plan on counts by length, place every piece."""
    return pack(scratch(pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces"), capacity)


def brute_force(lengths: list[int], capacity: int) -> int:
    """Number of sequences that one-by-one best-fit decreasing makes: what tests hold the plan against."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)
