"""Line deduplication against a sharded minimal perfect hash.

Lines are counted by a 128-bit hash of their key. Hashes found in at least `min_docs` documents go to
shards by their first half; each shard is a minimal perfect hash (levels of collision-free bits) whose slots
index three compact arrays: a 32-bit fingerprint, the number of documents, and the largest document id that
holds the line. Documents do not join lines: their distinct hashes stream past the shard's arrays, a probe
that hits a slot with another fingerprint is no member. A third of all probes may want one shard: probes
are salted by document and the shard's arrays (not its lines) are repeated for each salt.

Keys: white space `[\\x20\\x09-\\x0D]` stripped at both ends, A-Z lower-cased; keys under `min_length` code
points never count. A null or empty text is one empty line. Each row counts as a document; among rows that
repeat the largest doc_id all keep the line; a null doc_id sorts below all others. Empty tables give no rows.
Extra columns pass through; an input column named like a result column gives way to it.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import carried as columns_beside
from plumbline.llm.common import as_bytes, id_key, partitions, scratch, spare

_STRIP = b" \t\n\x0b\x0c\r"
#: Hashes of one shard, about: 20 bytes each in a worker's memory.
SHARD_SIZE = 1 << 16
#: Ways in which the probes of one shard are dealt.
SALTS = 16
#: Bits a level of the perfect hash has for each hash that is left.
_GAMMA = 2


def key_of(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()  # bytes.lower() changes A-Z only


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _hash(key: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key))


# -- the perfect hash ---------------------------------------------------------------------------------


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h ^ np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build(h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits (as booleans) for distinct uint64 hashes, and each hash's slot below len(h)."""
    slot, left, levels, base = np.zeros(len(h), np.int64), np.arange(len(h)), [], 0
    while len(left):
        size = max(64, _GAMMA * len(left))
        at = (_mix(h[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        hit = alone[at]
        slot[left[hit]] = base + (np.cumsum(alone) - 1)[at[hit]]
        base += int(alone.sum())
        left = left[~hit]
    return levels, slot


def look_up(levels: list[np.ndarray], ranks: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """Slots of hashes; -1 where no level has one (those are no members for sure)."""
    slot, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for k, (alone, rank) in enumerate(zip(levels, ranks, strict=True)):
        at = (_mix(h[left], k) % np.uint64(len(alone))).astype(np.int64)
        hit = alone[at]
        slot[left[hit]] = base + rank[at[hit]]
        base += int(rank[-1]) + 1
        left = left[~hit]
    return slot


def _pack(h1: np.ndarray, h2: np.ndarray, n: np.ndarray, keeper: np.ndarray) -> bytes:
    levels, slot = build(h1.view(np.uint64))
    prints, counts, keepers = np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int64)
    prints[slot] = h2.view(np.uint64) & np.uint64(0xFFFFFFFF)
    counts[slot] = np.minimum(n, 2**32 - 1)
    keepers[slot] = keeper
    head = struct.pack("<II", len(h1), len(levels)) + b"".join(struct.pack("<I", len(x)) for x in levels)
    return head + b"".join(np.packbits(x).tobytes() for x in levels) + prints.tobytes() + counts.tobytes() + keepers.tobytes()


class Shard:
    """A shard's arrays, read from its packed form."""

    def __init__(self, blob: bytes):
        n, k = struct.unpack_from("<II", blob)
        sizes, at = struct.unpack_from(f"<{k}I", blob, 8), 8 + 4 * k
        self.levels = []
        for size in sizes:
            step = -(-size // 8)
            self.levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, step, at), count=size).astype(bool))
            at += step
        self.ranks = [np.cumsum(x) - 1 for x in self.levels]
        self.prints, at = np.frombuffer(blob, np.uint32, n, at), at + 4 * n
        self.counts, at = np.frombuffer(blob, np.uint32, n, at), at + 4 * n
        self.keepers = np.frombuffer(blob, np.int64, n, at)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slots of members, -1 for others. A stranger passes the fingerprint once in 2**32 hits at most."""
        slot = look_up(self.levels, self.ranks, h1.view(np.uint64))
        same = (slot >= 0) & (self.prints[slot] == (h2.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)) if len(self.prints) else np.zeros(len(h1), bool)
        return np.where(same, slot, -1)


# -- the stages ---------------------------------------------------------------------------------------


def line_hashes(docs: DataFrame, min_length: int) -> DataFrame:
    """(h1, h2, doc): the distinct hashes of each document's keys."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, doc = [], []
            for d, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                own = {_hash(k) for k in map(key_of, text.split(b"\n")) if _long_enough(k, min_length)}
                out.extend(own)
                doc.extend([d] * len(own))
            both = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(doc, pa.int64())], names=["h1", "h2", "doc"])

    return docs.select(id_key("doc_id").alias("doc"), "text").mapInArrow(hashes, "h1 long, h2 long, doc long")


def build_index(lines: DataFrame, min_docs: int, shard_size: int = SHARD_SIZE) -> tuple[DataFrame, int]:
    """(shard, blob) and the number of shards: hashes that at least `min_docs` documents hold."""
    common = scratch(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs), "common-lines")
    shards = max(1, math.ceil(common.count() / shard_size))

    def packed(table: pa.Table) -> pa.Table:
        h1, h2, n, keeper = (table.column(c).to_numpy() for c in ("h1", "h2", "n", "keeper"))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "blob": pa.array([_pack(h1, h2, n, keeper)], pa.binary())})

    by = common.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    # Two lines that share h1 but not h2 (once in 2**64 pairs) cannot both have a slot: the smaller h2 stays.
    by = by.groupBy("shard", "h1").agg(F.min(F.struct("h2", "n", "keeper")).alias("x")).select("shard", "h1", "x.*")
    return scratch(by.groupBy("shard").applyInArrow(packed, "shard int, blob binary"), "line-index"), shards


def probe(lines: DataFrame, index: DataFrame, shards: int, salts: int = SALTS) -> DataFrame:
    """(doc, h1): lines that the documents lose."""
    rows = lines.select(F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "h1", "h2", "doc", F.lit(None).cast("binary").alias("blob"))
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("doc"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            number, kind = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            h1, h2, doc = (batch.column(i).to_numpy() for i in (3, 4, 5))
            lost_doc, lost = [], []
            cuts = np.flatnonzero(np.diff(number) | (np.diff(kind) != 0) | (kind[1:] == 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(number)]):
                if a == b:
                    continue
                if kind[a] == 0:
                    at, shard = number[a], Shard(batch.column(6)[int(a)].as_py())
                elif at == number[a]:
                    slot = shard.probe(h1[a:b], h2[a:b])
                    member = np.flatnonzero(slot >= 0)
                    gone = member[shard.keepers[slot[member]] != doc[a:b][member]]
                    lost_doc.append(doc[a:b][gone])
                    lost.append(h1[a:b][gone])
            if lost:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lost_doc)), pa.array(np.concatenate(lost))], names=["doc", "h1"])

    both = rows.unionAll(arrays).repartition(partitions(lines.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return both.mapInArrow(run, "doc long, h1 long")


def dedup_lines(docs: DataFrame, min_length: int = 20, min_docs: int = 3, text_out: str = "kept_text") -> DataFrame:
    """Each row with n_lines, n_dropped, kept_sha256 and the text that stays (as column `text_out`; it may be "text")."""
    new = {"n_lines": T.LongType(), "n_dropped": T.LongType(), "kept_sha256": T.StringType(), text_out: T.StringType()}
    carried = columns_beside(docs, new)
    doc, gone, key = spare(docs, "_doc", "_lost", "_key")
    lines = scratch(line_hashes(docs, min_length), "lines")
    index, shards = build_index(lines, min_docs)
    lost = probe(lines, index, shards).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("h1").alias(gone))
    source = docs.select(*[F.col(f"`{c}`") for c in carried], *([F.col("text")] if "text" not in carried else []), id_key("doc_id").alias(key))
    joined = source.join(lost, source[key] == lost[doc], "left").drop(doc, key)
    names = [*carried, *new]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            n_lines, n_dropped, digest, kept_text = [], [], [], []
            for text, lost in zip(as_bytes(col["text"]), col[gone], strict=True):
                own = text.split(b"\n")
                kept = own
                if lost.is_valid:
                    away = set(lost.as_py())
                    kept = [x for x in own if not (_long_enough(k := key_of(x), min_length) and _hash(k)[0] in away)]
                n_lines.append(len(own)), n_dropped.append(len(own) - len(kept))
                body = b"\n".join(kept)
                kept_text.append(body.decode("utf-8", "replace")), digest.append(hashlib.sha256(body).hexdigest())
            made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())]
            yield pa.RecordBatch.from_arrays([*(col[c] for c in carried), *made], names=names)

    fields = T.StructType([*(docs.schema[c] for c in carried), *(T.StructField(n, t) for n, t in new.items())])
    return joined.mapInArrow(rewrite, fields)
