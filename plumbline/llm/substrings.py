"""Substring deduplication by super-k-mers.

A window is `size` consecutive words of one document. Its minimiser is the smallest hash among its `gram`-word
sub-sequences; neighbouring windows mostly share it, so each run of them (a super-k-mer) travels once, as one
packed string of its words, to the minimiser's bucket. Equal windows always meet there. A bucket's strings are
sorted by minimiser and origin, their windows are hashed to 128 bits (two independent hashes of their words) and
sorted, and every window but the earliest of its kind is marked; marks come back as word intervals and join their documents.

Most buckets would get a single string, which has no twin. A first pass counts strings by bucket; only those of
buckets with two or more travel (a bit map of bounded size says which).

Skew: a task forwards a string only once however often its documents repeat it (the later ones are marked on
the spot), so a passage in a third of all documents costs its bucket a row for each task. A bucket streams:
only the windows of the current minimiser stay in memory, `memory_windows` at most; windows beyond that are
counted exactly by a plain grouped minimum. No window is dropped.

Words are `[^\\x20\\x09-\\x0D]+`; a null or empty text has none. "Earlier" is strict in (doc_id, start): rows that
repeat a doc_id do not make each other's windows later. A null doc_id sorts first. Empty tables give no rows.
Extra columns pass through; those named like a result column give way to it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import carried as columns_beside
from plumbline.llm.common import as_bytes, free_shuffles, id_key, partitions, scratch, slices, spare

#: Bytes of text hashed at a time.
CHUNK = 1 << 20
#: Of two to the power of this many bits, at most, is the map of buckets that more than one string goes to (64 MB).
FILTER_BITS = 29
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: Places of a word whose bytes have their values in a table; those of later bytes are computed.
_PLACES = 64
_values: dict[int, np.ndarray] = {}


def _value(code: np.ndarray, seed: int) -> np.ndarray:
    """A random-looking value of each (place * 256 + byte)."""
    return _mix(_mix(code.astype(np.uint64) * np.uint64(_P) + np.uint64((2 * seed + 1) * _Q % 2**64)))


def word_hashes(buffer: bytes, seeds: int = 1) -> tuple[np.ndarray, ...]:
    """Start and end (exclusive) of each word of a buffer whose words are parted by single bytes 32 or 10, and `seeds` hashes.

    A hash sums a value of each byte and its place, all drawn anew (tabulation), so words that differ anywhere have
    unrelated hashes; those of two seeds are independent.
    """
    raw = np.frombuffer(buffer, np.uint8)
    stop = np.flatnonzero((raw == 32) | (raw == 10))
    starts, ends = np.concatenate([[0], stop + 1]), np.concatenate([stop, [len(raw)]])
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, ends - starts + 1)[: len(raw)]
    code = (place << 8) | raw
    far = np.flatnonzero(place >= _PLACES)
    near = np.where(place < _PLACES, code, 0) if len(far) else code
    out = []
    for seed in range(seeds):
        if seed not in _values:
            _values[seed] = _value(np.arange(_PLACES * 256), seed)
        value = _values[seed][near]
        value[far] = _value(code[far], seed)
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(value, out=sums[1:])
        out.append(_mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * np.uint64(_Q)))
    return starts, ends, *out


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    have, out = 1, x
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _grams(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each k neighbouring word hashes."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(base) + h[i : i + n]
    return _mix(out)


def _runs(docs: list[list[bytes]], size: int, gram: int):
    """Super-k-mers of the documents' words: (buffer, bucket, document, first window, windows, from byte, to byte)."""
    buffer = b"\n".join(b" ".join(words) for words in docs)
    starts, ends, h = word_hashes(buffer)
    grams = _grams(h, gram, _P)
    low = np.uint64(len(grams).bit_length())  # the low bits tell places apart: a run shares one occurrence of its minimiser
    least = _slide_min((grams >> low << low) | np.arange(len(grams), dtype=np.uint64), size - gram + 1)  # by window
    counts = np.array([len(x) for x in docs])
    base = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(docs)), counts)[: len(least)]
    at = np.arange(len(least)) - base[doc]
    valid = at <= counts[doc] - size
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(fresh & valid)
    after = np.flatnonzero(fresh | ~valid)
    tails = np.append(after, len(least))[np.searchsorted(after, heads, "right")]
    bucket = (least[heads] >> np.uint64(33)).astype(np.int32)
    return buffer, bucket, doc[heads], at[heads], tails - heads, starts[heads], ends[tails + size - 2]


def _bucket_counts(size: int, gram: int):
    """(bucket, n): how many super-k-mers each bucket would get, by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for first, last in slices([len(t) for t in texts], CHUNK):
                docs = [w for t in texts[first:last] if len(w := t.split()) >= size]
                if docs:
                    bucket, n = np.unique(_runs(docs, size, gram)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    return run


def _shared_buckets(docs: DataFrame, size: int, gram: int) -> np.ndarray:
    """A bit map of buckets that get two super-k-mers or more; only those can hold equal windows.

    Its size is bounded by FILTER_BITS: beyond that many shared buckets more strings travel than need to, and no
    result changes. Buckets fall on one bit by their low bits.
    """
    counts = docs.select("text").mapInArrow(_bucket_counts(size, gram), "bucket int, n long")
    shared = scratch(counts.groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").select("bucket"), "shared-buckets")
    bits = min(FILTER_BITS, max(20, math.ceil(math.log2(16 * max(1, shared.count())))))
    at = F.col("bucket").bitwiseAND((1 << bits) - 1).cast("long")
    parts = shared.groupBy((at / 32768).cast("int").alias("k")).agg(F.bitmap_construct_agg(at % 32768).alias("b")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(r["b"], np.uint8)
    return out


def _super_kmers(size: int, gram: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = as_bytes(batch.column(2))
            order = sorted(range(len(texts)), key=lambda i: keys[i])  # what comes first is the earliest
            seen: dict[bytes, tuple[int, int]] = {}
            for first, last in slices([len(texts[i]) for i in order], CHUNK):
                yield _strings([(keys[i], tags[i], texts[i].split()) for i in order[first:last]], seen, size, gram, shared.value)

    return run


def _strings(docs: list, seen: dict, size: int, gram: int, shared: np.ndarray) -> pa.RecordBatch:
    docs = [x for x in docs if len(x[2]) >= size]
    out: list[list] = [[], [], [], [], [], []]
    if docs:
        buffer, *columns = _runs([x[2] for x in docs], size, gram)
        bit = columns[0] & (8 * len(shared) - 1)
        some = np.flatnonzero((shared[bit >> 3] >> (bit & 7)) & 1)
        for b, d, s, n, a, z in zip(*(c[some].tolist() for c in columns)):
            text = buffer[a:z]
            key, tag, _ = docs[d]
            if seen.setdefault(text, (key, s)) < (key, s):  # marked here already; any bucket passes it on
                b, text = (key * 0x9E3779B1 + s) & 0x7FFFFFFF, None
            for column, x in zip(out, (b, key, tag, s, n, text)):
                column.append(x)
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["bucket", "doc", "tag", "start", "n", "words"])


_OUT = ["kind", "doc", "tag", "start", "n", "h1", "h2"]


def _mark(size: int, memory_windows: int):
    """Marks over rows sorted by (bucket, doc, start). kind 0: words that go; kind 1: a window that must be counted elsewhere."""

    def emit(kind, doc, tag, start, n, h1, h2) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc), pa.array(tag), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bucket, held = None, None  # windows of the bucket that the last batch ended in
        for big in batches:
            local = np.flatnonzero(big.column(5).is_null().to_numpy(zero_copy_only=False))
            if len(local):  # marked where they came from
                doc, tag, start, n = (big.column(i).to_numpy()[local] for i in (1, 2, 3, 4))
                none = np.zeros(len(local), np.uint64)
                yield emit(0, doc, tag, start, n + size - 1, none, none)
            rows = big.filter(big.column(5).is_valid())
            texts = rows.column(5).to_pylist()
            for a, b in slices([len(x) for x in texts], CHUNK):
                bucket, doc, tag, start, n = (rows.column(i).to_numpy()[a:b] for i in range(5))
                _, _, h, g = word_hashes(b"\n".join(texts[a:b]), 2)
                first = np.concatenate([[0], np.cumsum(n + size - 1)])[:-1]  # first word of each row
                row = np.repeat(np.arange(b - a), n)
                nth = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
                word = first[row] + nth
                w1, w2, wdoc, wat, wbucket = _grams(h, size, _P)[word], _grams(g, size, _Q)[word], doc[row], (start[row] + nth).astype(np.int64), bucket[row]
                k = 0
                if held_bucket is not None and held_bucket == bucket[0]:
                    k = len(held[0])
                    w1, w2, wdoc, wat, wbucket = (np.concatenate(x) for x in zip(held, (w1, w2, wdoc, wat, wbucket)))
                else:
                    held_bucket, held = None, None
                order = np.lexsort((np.arange(len(w1)), w2, w1))
                s1, s2 = w1[order], w2[order]
                new = np.ones(len(order), bool)
                new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
                lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]  # earliest of its kind
                later = np.zeros(len(order), bool)
                later[order] = (wdoc[lead] < wdoc[order]) | ((wdoc[lead] == wdoc[order]) & (wat[lead] < wat[order]))
                leads = np.sort(order[new])
                frozen = k >= memory_windows
                if frozen:  # the bucket's table is full: windows it lacks are counted by the plain way
                    lead_of = np.empty(len(order), np.int64)
                    lead_of[order] = lead
                    out = np.flatnonzero((lead_of >= k) & (np.arange(len(order)) >= k) & (wbucket == held_bucket))
                    later[out] = False
                    if len(out):
                        r = row[out - k]
                        yield emit(1, wdoc[out], tag[r], wat[out], np.zeros(len(out), np.int64), w1[out], w2[out])
                last = bucket[-1]
                stay = leads[wbucket[leads] == last]
                if frozen and last == held_bucket:
                    stay = np.arange(k)
                held_bucket, held = last, tuple(x[stay] for x in (w1, w2, wdoc, wat, wbucket))
                gone = later[k:]
                if gone.any():  # neighbouring marked windows of a row make one interval
                    edge = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1] & (row[1:] == row[:-1])]))
                    stop = np.flatnonzero(gone & ~np.concatenate([gone[1:] & (row[1:] == row[:-1]), [False]]))
                    r, none = row[edge], np.zeros(len(edge), np.uint64)
                    yield emit(0, doc[r], tag[r], wat[k:][edge], stop - edge + size, none, none)

    return run


def repeated_words(docs: DataFrame, size: int = 20, gram: int = 2, memory_windows: int = 1 << 20) -> DataFrame:
    """(doc, tag, start, n): intervals of words that a window with an earlier twin covers."""
    spark = docs.sparkSession
    source = docs.select(id_key("doc_id").alias("doc"), F.hash("text").alias("tag"), "text")
    shared = spark.sparkContext.broadcast(_shared_buckets(docs, size, gram))
    travel = source.mapInArrow(_super_kmers(size, gram, shared), "bucket int, doc long, tag int, start int, n int, words binary")
    dealt = travel.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "doc", "start")
    marks = scratch(dealt.mapInArrow(_mark(size, memory_windows), "kind int, doc long, tag int, start int, n int, h1 long, h2 long"), "marks")
    del travel, dealt
    free_shuffles(spark)
    rest = marks.where("kind = 1")
    lead = rest.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("lead"))
    late = rest.join(lead, ["h1", "h2"]).where(F.struct("doc", "start") > F.col("lead"))
    return marks.where("kind = 0").select("doc", "tag", "start", "n").unionAll(late.select("doc", "tag", "start", F.lit(size).alias("n")))


def dedup_substrings(docs: DataFrame, size: int = 20, text_out: str = "kept_text") -> DataFrame:
    """Each row with n_words, n_removed, kept_sha256 and the words that stay, joined by one blank (column `text_out`)."""
    new = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType(), text_out: T.StringType()}
    carried = columns_beside(docs, new)
    doc, mark, gone, key, tag = spare(docs, "_doc", "_mark", "_gone", "_key", "_tag")
    spans = repeated_words(docs, size).groupBy(F.col("doc").alias(doc), F.col("tag").alias(mark)).agg(F.collect_list(F.struct("start", "n")).alias(gone))
    source = docs.select(*[F.col(f"`{c}`") for c in carried], *([F.col("text")] if "text" not in carried else []), id_key("doc_id").alias(key), F.hash("text").alias(tag))
    joined = source.join(spans, (source[key] == spans[doc]) & (source[tag] == spans[mark]), "left").drop(doc, mark, key, tag)
    names = [*carried, *new]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            n_words, n_removed, digest, kept_text = [], [], [], []
            for text, spans in zip(as_bytes(col["text"]), col[gone], strict=True):
                words = text.split()
                kept = words
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans.as_py():
                        edge[s["start"]] += 1
                        edge[s["start"] + s["n"]] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                body = b" ".join(kept)
                n_words.append(len(words)), n_removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(body).hexdigest()), kept_text.append(body.decode("utf-8", "replace"))
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())]
            yield pa.RecordBatch.from_arrays([*(col[c] for c in carried), *made], names=names)

    return joined.mapInArrow(rewrite, T.StructType([*(docs.schema[c] for c in carried), *(T.StructField(n, t) for n, t in new.items())]))
