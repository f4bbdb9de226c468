"""Byte-exact deduplication by a distributed difference-cover suffix sort.

A byte goes if a string of `size` bytes that also starts elsewhere covers it. Strings that start at two places are equal
where the suffixes from there share `size` bytes, so suffixes are sorted as far as that and neighbours compared:

1. Strings that settle themselves are taken out first. Neighbouring windows (starts of `size` bytes) that share the least hash among
   their sub-strings travel as one row with a hash of their common text. Rows with equal text repeat as a whole; one of each kind stays to
   stand for them. A kind whose least hash no other kind has holds nothing that repeats elsewhere. This is done twice, with short and
   with long sub-strings (SCALES), and leaves the windows where copies begin, end or differ.
2. Sort the sampled triples. Of the starts that are left and those their names need, two of every three (the difference cover {1, 2} of 3)
   are sampled. A triple is three blocks of size / 9 bytes, each as a 64-bit fingerprint. Ranks among all triples, in ranges of
   one sorted order, are their names; a name that occurs once can be in no repeated string and goes.
3. Recurse on the names: triples of names, a block's width apart, are sorted and named again. Those names stand for all but the last bytes.
4. Merge the remaining suffixes: as in any difference-cover merge, a start is compared by at most two leading bytes and the name of the sampled
   start behind them. Starts of classes 0 and 1 meet in the order with one leading byte, 0 and 2 in that with two, 1 and 2 in that with none.
5. Compare adjacent prefixes: equal neighbours of an order (with a second, independent fingerprint of the whole string) repeat.

Order is that of fingerprints, not of the alphabet; equal prefixes are adjacent in either. Ranges are cut by key and place, so equal keys may fill several
tasks: no group meets in one. The edges of ranges (two keys each) are stitched on the driver. Documents are cut into pieces of at most PIECE starts.

Texts are UTF-8 bytes; a null or empty text has none, and matches never cross documents. Each row is a document: rows that repeat remove all
of each other, if they have `size` bytes. A null doc_id is an id like others. Extra columns pass through; an input column named like a result column, in any
case, gives way to it. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import as_bytes, carried, discard, id_key, partitions, scratch, slices, spare
from plumbline.llm.substrings import _mix, _slide_min

#: Bytes of text handled at a time (their hashes stay in a core's cache), and starts of a piece of a document, at most.
CHUNK, PIECE = 1 << 19, 1 << 16
#: Shares of `size` that the sub-strings of the two collapses have.
SCALES = (0.32, 0.84)
#: Low bits of a hash that give way to its place in a chunk, so that the leftmost of equal ones is the least.
_LOW = np.uint64(24)

# -- rolling fingerprints -----------------------------------------------------------------------------

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_VALUES = [_mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(b)) for b in _BASES]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64, for i below n."""
    out = _powers.get(base)
    if out is None or len(out) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out, have = np.ones(size, np.uint64), 1
        while have < size:
            out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, 2**64))
            have *= 2
        _powers[base] = out
    return out[:n]


class Rolling:
    """Fingerprints of the sub-strings of a buffer, by start and length."""

    def __init__(self, raw: np.ndarray, seed: int = 0):
        self.base, self.sums = _BASES[seed], np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[seed][raw] * _power(self.base, len(raw)), out=self.sums[1:])

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        back = _power(pow(self.base, -1, 2**64), len(self.sums))
        return _mix((self.sums[start + length] - self.sums[start]) * back[start] + np.uint64(length))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * _power(pow(self.base, -1, 2**64), n) + np.uint64(length)) if n > 0 else np.zeros(0, np.uint64)


# -- collapse -----------------------------------------------------------------------------------------


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places lie in an interval."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def _strings(texts: list[bytes], windows: list[list[tuple[int, int]]], size: int, gram: int):
    """Runs of neighbouring windows with one least sub-string: (text, start, windows, bucket, digest)."""
    buffer = b"".join(texts)
    raw = np.frombuffer(buffer, np.uint8)
    base = np.cumsum([0, *map(len, texts)])
    n = len(raw) - size + 1
    if n <= 0:
        return []
    valid = _covered(n, np.array([base[i] + s for i, own in enumerate(windows) for s, _ in own], np.int64), np.array([m for own in windows for _, m in own], np.int64))
    least = _slide_min((Rolling(raw).all(gram) >> _LOW << _LOW) | np.arange(len(raw) - gram + 1, dtype=np.uint64), size - gram + 1)
    fresh = np.ones(n, bool)
    fresh[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    fresh[base[:-1][base[:-1] < n]] = True
    heads = np.flatnonzero(fresh & valid)
    after = np.flatnonzero(fresh | ~valid)
    tails = np.append(after, n)[np.searchsorted(after, heads, "right")]
    item = np.searchsorted(base, heads, "right") - 1
    view = memoryview(buffer)
    digests = b"".join(xxhash.xxh3_128_digest(view[a : z + size - 1]) for a, z in zip(heads.tolist(), tails.tolist()))
    both = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return item, heads - base[item], tails - heads, (least[heads] >> _LOW).astype(np.int64), both[:, 0], both[:, 1]


def _blocks(length: int, size: int, chunk: int) -> list[tuple[int, int]]:
    """A text's windows in blocks of `chunk` starts: (first, windows)."""
    n = length - size + 1
    return [(a, min(chunk, n - a)) for a in range(0, max(0, n), chunk)]


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
_STRING = ["bucket", "h1", "h2", "key", "tag", "start", "n"]
_STRING_TYPE = "bucket long, h1 long, h2 long, key long, tag long, start int, n int"


def _rows(key: np.ndarray, tag: np.ndarray, shift: np.ndarray, found) -> pa.RecordBatch:
    item, start, n, bucket, h1, h2 = found
    columns = (bucket, h1, h2, key[item], tag[item], (start + shift[item]).astype(np.int32), n.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), k) for c, k in zip(columns, _KINDS)], names=_STRING)


def _of_documents(size: int, gram: int):
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), as_bytes(batch.column(2))
            parts = [(i, a, m) for i, t in enumerate(texts) for a, m in _blocks(len(t), size, chunk)]
            for first, last in slices([m + size for _, _, m in parts], chunk):
                some = parts[first:last]
                rows = np.array([i for i, _, _ in some])
                found = _strings([texts[i][a : a + m + size - 1] for i, a, m in some], [[(0, m)] for _, _, m in some], size, gram)
                if found:
                    yield _rows(keys[rows], tags[rows], np.array([a for _, a, _ in some]), found)

    return run


def _of_pieces(size: int, gram: int):
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, windows = batch.column(0).to_numpy(), as_bytes(batch.column(1)), batch.column(2).to_pylist()
            zero = np.zeros(len(keys), np.int64)
            for first, last in slices([len(t) for t in texts], chunk):
                found = _strings(texts[first:last], [[(w["start"], w["n"]) for w in own] for own in windows[first:last]], size, gram)
                if found:
                    yield _rows(keys[first:last], zero[first:last], zero[first:last], found)

    return run


def _collapse(strings: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(key, tag, start, n) of all windows of texts that occur twice; and of those of one text of each kind that shares its least sub-string with other kinds."""
    strings = scratch(strings, name)
    kinds = scratch(strings.groupBy("bucket", "h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "tag", "start", "n")).alias("lead")), name + "-kinds")
    copies = scratch(strings.join(kinds.where("times > 1").select("h1", "h2"), ["h1", "h2"]).select("key", "tag", "start", "n"), name + "-copies")
    shared = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("bucket")
    leads = scratch(kinds.join(shared, "bucket").select("lead.*"), name + "-leads")
    discard(strings)
    discard(kinds)
    return copies, leads


def _cut_pieces(size: int):
    """Rows (doc, tag, text, windows) as pieces: the windows' text without what lies between."""
    most = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, tag, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                own = sorted((w["start"] + a, min(most, w["n"] - a)) for w in own for a in range(0, w["n"], most))
                piece: list[tuple[int, int]] = []
                for s, n in [*own, (-1, 0)]:
                    if piece and (s < 0 or s > piece[-1][0] + piece[-1][1] + size or s + n - piece[0][0] > most):
                        first, last = piece[0][0], piece[-1][0] + piece[-1][1] + size - 1
                        for column, x in zip(out, (doc, tag, first, text[first:last], [{"start": a - first, "n": m} for a, m in piece])):
                            column.append(x)
                        piece = []
                    piece.append((s, n))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc", "tag", "base", "text", "windows"])

    return run


_WINDOWS = "windows array<struct<start int, n int>>"

# -- names by one sorted order ------------------------------------------------------------------------


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(piece, at, name) of the rows (long columns `keys`, piece, at) whose keys occur twice; a name is the keys' rank in the order of all."""
    k = len(keys)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, first, before, waiting = TaskContext.get().partitionId(), -1, None, None, None

        def out(nth, repeated, piece, at, edges=None) -> pa.RecordBatch:
            n = len(nth)
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(nth, pa.int64()), pa.array(repeated, pa.bool_()), pa.array(piece, pa.int64()), pa.array(at, pa.int32()), pa.array(edges or [None] * n, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "nth", "repeated", "piece", "at", "edges"])

        def lone(x):  # the only row of its run: the first and last runs may go on in the neighbouring ranges
            return out([x[0]], [None if x[0] == 0 or x[0] == nth else False], [x[1]], [x[2]])

        for batch in batches:
            n = len(batch)
            if not n:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(k)])
            piece, at = batch.column(k).to_numpy(), batch.column(k + 1).to_numpy()
            new = np.ones(n, bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            if first is None:
                first = key[:, 0]
            else:
                new[0] = bool((key[:, 0] != before).any())
            number = nth + np.cumsum(new)
            same_next = np.append(~new[1:], False)
            repeated = ~new | same_next
            if waiting is not None:
                if not new[0]:
                    yield out([waiting[0]], [True], [waiting[1]], [waiting[2]])
                else:
                    yield lone(waiting)
                waiting = None
            before, nth = key[:, -1], int(number[-1])
            stop = n
            if new[-1]:  # alone so far
                stop, waiting = n - 1, (nth, int(piece[-1]), int(at[-1]))
            some = np.flatnonzero(repeated[:stop] | (number[:stop] == 0))  # the others are of no use to anybody
            yield out(number[some], pa.array(repeated[some], mask=~repeated[some]), piece[some], at[some])
        if waiting is not None:
            yield lone(waiting)
        if first is not None:
            yield out([nth + 1], [None], [None], [None], [[*map(int, first), *map(int, before)]])

    n = partitions(rows.sparkSession)
    dealt = rows.select(*keys, "piece", "at").repartitionByRange(n, *keys, "piece", "at").sortWithinPartitions(*keys)
    done = scratch(dealt.mapInArrow(rank, "part int, nth long, repeated boolean, piece long, at int, edges array<long>"), name)
    ends = {r["part"]: (r["nth"], r["edges"][:k], r["edges"][k:]) for r in done.where("piece IS NULL").select("part", "nth", "edges").collect()}  # one row of each range
    order, offset, at = sorted(ends), {}, 0
    joined = {p: i > 0 and ends[order[i - 1]][2] == ends[p][1] for i, p in enumerate(order)}
    for i, p in enumerate(order):
        at -= joined[p]
        offset[p] = (at, joined[p], ends[p][0] - 1, i + 1 < len(order) and joined[order[i + 1]])
        at += ends[p][0]

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, nth = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            open_row = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            stays = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).copy()
            for i in np.flatnonzero(open_row):
                _, start, last, end = offset[int(part[i])]
                stays[i] = (nth[i] == 0 and start) or (nth[i] == last and end)
            stays = np.flatnonzero(stays)
            shift = np.zeros(max(offset, default=0) + 1, np.int64)
            for p, x in offset.items():
                shift[p] = x[0]
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(stays)), batch.column(4).take(pa.array(stays)), pa.array(nth[stays] + shift[part[stays]])], names=["piece", "at", "name"])

    return done.where("piece IS NOT NULL").select("part", "nth", "repeated", "piece", "at").mapInArrow(stitch, "piece long, at int, name long")


def _by_piece(rows: DataFrame, each: Callable, schema: str) -> DataFrame:
    """Rows (piece, at, ...) of each piece together and in order, in batches of whole pieces; `each` makes a batch of a table of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            piece = batch.column(0).to_numpy()
            cut = int(np.searchsorted(piece, piece[-1])) if len(piece) else 0
            if cut or (held and len(piece) and held[-1].column(0)[-1].as_py() != piece[0]):
                whole = [*held, batch.slice(0, cut)]
                held = []
                yield each(pa.Table.from_batches(whole))
            if len(batch) > cut:
                held.append(batch.slice(cut))
        if held:
            yield each(pa.Table.from_batches(held))

    return rows.repartition(partitions(rows.sparkSession), "piece").sortWithinPartitions("piece", "at").mapInArrow(run, schema)


# -- the suffix sort ----------------------------------------------------------------------------------


def _sampled(windows: np.ndarray) -> np.ndarray:
    """The sampled starts that the merge of these windows looks at: classes 1 and 2 of 3, at most two bytes on."""
    q = np.unique(np.concatenate([windows, windows + 1, windows + 2]))
    return q[q % 3 != 0]


def _starts(own: list[dict]) -> np.ndarray:
    return np.concatenate([np.arange(w["start"], w["start"] + w["n"]) for w in own])


def repeated_starts(pieces: DataFrame, size: int) -> DataFrame:
    """(piece, at): the starts, of those in `windows` of (piece, text, windows), of strings of `size` bytes that start at another of them too."""
    block = (size - 4) // 9
    step, rest = 3 * block, size - 9 * block

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for piece, text, own in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                q = _sampled(_starts(own))
                q = np.unique(np.concatenate([q, q + step, q + 2 * step]))
                rolling = Rolling(np.frombuffer(text, np.uint8))
                q = q[q + step <= len(text)]
                for i in range(3):
                    out[i].append(rolling.at(q + i * block, block).view(np.int64))
                out[3].append(np.full(len(q), piece, np.int64))
                out[4].append(q.astype(np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["k1", "k2", "k3", "piece", "at"])

    def again(table: pa.Table) -> pa.RecordBatch:
        piece, at, name = (table.column(i).to_numpy() for i in range(3))
        place = np.unique(piece, return_inverse=True)[1].astype(np.int64) << 32 | at
        second, third = np.searchsorted(place, place + step), np.searchsorted(place, place + 2 * step)
        second, third = np.minimum(second, len(place) - 1), np.minimum(third, len(place) - 1)
        some = np.flatnonzero((place[second] == place + step) & (place[third] == place + 2 * step))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (name[some], name[second[some]], name[third[some]], piece[some], at[some])], names=["k1", "k2", "k3", "piece", "at"])

    def merge(table: pa.Table) -> pa.RecordBatch:
        piece, at, name = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy()
        out: list[list] = [[] for _ in range(6)]
        heads = [*np.flatnonzero(at < 0).tolist(), len(at)]
        for a, z in zip(heads, heads[1:]):
            if z == a + 1:
                continue
            text = np.frombuffer(table.column(3)[a].as_py(), np.uint8)
            p = _starts(table.column(4)[a].as_py())
            own, names = at[a + 1 : z], name[a + 1 : z]
            check = Rolling(text, 1).at(p, size)
            for lead in range(3):
                found = np.minimum(np.searchsorted(own, p + lead), len(own) - 1)
                some = np.flatnonzero(((p + lead) % 3 != 0) & (own[found] == p + lead))
                s = p[some]
                ends = np.full(len(s), lead, np.uint64)
                for i in [*range(lead), *range(lead + 9 * block, size)]:
                    ends = ends * np.uint64(256) + text[s + i]
                for column, x in zip(out, (ends.view(np.int64), names[found[some]], check[some].view(np.int64), np.full(len(s), lead, np.int64), np.full(len(s), piece[a], np.int64), s.astype(np.int32))):
                    column.append(x)
        kinds = (np.int64,) * 5 + (np.int32,)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, k)) for x, k in zip(out, kinds)], names=["ends", "name", "check", "lead", "piece", "at"])

    key_type = "k1 long, k2 long, k3 long, piece long, at int"
    first = _ranked(pieces.select("piece", "text", "windows").mapInArrow(triples, key_type), ["k1", "k2", "k3"], "names")
    second = _ranked(_by_piece(first, again, key_type), ["k1", "k2", "k3"], "long-names")
    texts = pieces.select("piece", F.lit(-1).cast("int").alias("at"), F.lit(0).cast("long").alias("name"), "text", "windows")
    named = second.select("piece", "at", "name", F.lit(None).cast("binary").alias("text"), F.lit(None).cast(texts.schema["windows"].dataType).alias("windows"))
    orders = _by_piece(texts.unionAll(named), merge, "ends long, name long, check long, lead long, piece long, at int")
    return _ranked(orders, ["lead", "ends", "name", "check"], "neighbours").select("piece", "at")


def _intervals(table: pa.Table) -> pa.RecordBatch:
    """Neighbouring starts as (piece, start, n)."""
    piece, at = table.column(0).to_numpy(), table.column(1).to_numpy()
    first = np.ones(len(at), bool)
    first[1:] = (piece[1:] != piece[:-1]) | (at[1:] > at[:-1] + 1)
    cut = np.flatnonzero(first)
    last = np.append(cut[1:], len(at)) - 1
    return pa.RecordBatch.from_arrays([pa.array(piece[cut]), pa.array(at[cut]), pa.array((at[last] - at[cut] + 1).astype(np.int32))], names=["key", "start", "n"])


def repeated_spans(docs: DataFrame, size: int = 400) -> DataFrame:
    """(key, tag, start, n): intervals of starts of strings that also start elsewhere; key and tag are id_key and xxhash64 of the text."""
    source = docs.select(id_key("doc_id").alias("key"), F.xxhash64("text").alias("tag"), "text").where(F.octet_length("text") >= size)
    short, long = (max(1, int(size * x)) for x in SCALES)
    copies, leads = _collapse(source.mapInArrow(_of_documents(size, short), _STRING_TYPE), "strings")
    own = leads.groupBy("key", "tag").agg(F.collect_list(F.struct("start", "n")).alias("windows"))
    cut = source.join(own, ["key", "tag"]).select("key", "tag", "text", "windows").mapInArrow(_cut_pieces(size), f"doc long, tag long, base int, text binary, {_WINDOWS}")
    pieces = scratch(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    twice, leads = _collapse(pieces.select("piece", "text", "windows").mapInArrow(_of_pieces(size, long), _STRING_TYPE), "piece-strings")
    own = leads.groupBy(F.col("key").alias("piece")).agg(F.collect_list(F.struct("start", "n")).alias("windows"))
    left = scratch(pieces.select("piece", "text").join(own, "piece"), "suffixes")
    marks = _by_piece(repeated_starts(left, size), _intervals, "key long, start int, n int").unionAll(twice.select("key", "start", "n"))
    places = pieces.select(F.col("piece").alias("key"), "doc", "tag", "base")
    marks = marks.join(places, "key").select(F.col("doc").alias("key"), "tag", (F.col("start") + F.col("base")).alias("start"), "n")
    return copies.select("key", "tag", "start", "n").unionAll(marks)


def dedup_bytes(docs: DataFrame, size: int = 400, bytes_out: str | None = "kept_bytes") -> DataFrame:
    """Each row with n_bytes, n_removed, n_spans, kept_sha256 and, unless `bytes_out` is None, the bytes that stay; without the text then."""
    new = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()} | ({bytes_out: T.BinaryType()} if bytes_out else {})
    names = [c for c in carried(docs, new) if bytes_out or c != "text"]
    key, tag, gone = spare(docs, "_key", "_tag", "_gone")
    spans = repeated_spans(docs, size).groupBy(F.col("key").alias("_k"), F.col("tag").alias("_t")).agg(F.collect_list(F.struct("start", "n")).alias(gone))
    source = docs.select(*[F.col(f"`{c}`") for c in names], *([] if "text" in names else ["text"]), id_key("doc_id").alias(key), F.xxhash64("text").alias(tag))
    joined = source.join(spans, (source[key] == spans["_k"]) & (source[tag] == spans["_t"]), "left").drop(spans["_k"], spans["_t"]).drop(key, tag)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            out: list[list] = [[] for _ in new]
            for text, own in zip(as_bytes(col["text"]), col[gone], strict=True):
                kept, removed, runs = text, 0, 0
                if own.is_valid:
                    own = own.as_py()
                    away = _covered(len(text), np.array([w["start"] for w in own]), np.array([w["n"] + size - 1 for w in own]))
                    removed, runs = int(away.sum()), int((np.diff(away.astype(np.int8), prepend=0) == 1).sum())
                    kept = np.frombuffer(text, np.uint8)[~away].tobytes()
                for column, x in zip(out, (len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(col[c] for c in names), *(pa.array(x, k) for x, k in zip(out, kinds))], names=[*names, *new])

    return joined.mapInArrow(rewrite, T.StructType([*(docs.schema[c] for c in names), *(T.StructField(n, t) for n, t in new.items())]))
