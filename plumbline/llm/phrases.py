"""Collocations: frequent phrases by Misra-Gries summaries, scored at their weakest cut.

Texts are lower-cased (A-Z), split at punctuation and line breaks into pieces and those at blanks into words; a phrase
lies within one piece, and everything is counted by language (null: `und`). Orders are mined in turn (one word,
two, three, then four and five): an n-gram counts only where the shorter ones in it survived. Tasks send the counts of
the n-grams of their documents, packed, to the hash partition of each. A partition merges them into one
Misra-Gries summary whose capacity exceeds the partition's mass divided by the threshold (SLACK times), so it takes less than a
SLACK-th of the threshold off any count, and every n-gram that reaches it survives. Survivors go back as a bit map of bounded size
(FILTER_BITS; where it is too full, more n-grams travel and no result changes). Another pass over the texts counts them
exactly, packed again, by 96-bit hashes. What is frequent is then read as text in one of its documents, that with the smallest
32-bit hash, in a last pass.

Memory: a summary holds SLACK * mass / threshold counters; more texts want more partitions (SUMMARIES for each shuffle
partition), not larger ones. A frequent n-gram is one counter of each task, so no key is hot. A task keeps HELD
distinct n-grams before it sends them.

Cuts, scores, covered phrases and ranks are joins and windows over the frequent phrases; scores are exact (decimals of 38 digits).

Nulls: a null or empty text has no words. Rows that repeat count each. doc_id is not used, nor are other columns. Ties of a score go to
the more frequent phrase, then to the smaller in byte order. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import partitions, scratch
from plumbline.llm.jaccard import bit_map, has
from plumbline.llm.substrings import _P, _mix, word_hashes

#: Bytes of text handled at a time; a piece is never cut.
CHUNK = 1 << 22
#: Distinct n-grams a task holds before it sends them.
HELD = 1 << 22
#: Summaries of each shuffle partition.
SUMMARIES = 4
#: How far a summary's capacity exceeds its mass divided by the threshold.
SLACK = 8
#: Fixed: orders that are mined together, each after the survivors of those before it.
LEVELS = ((1,), (2,), (3,), (4, 5))

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(_BREAKS) + b" ")
_LINES, _BLANKS = re.compile(rb" *\n[ \n]*"), re.compile(rb"  +")


class Grams:
    """The words of documents of one language and the hashes of their n-grams."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.buffer = b"\n".join(texts)
        self.starts, self.ends, *words = word_hashes(self.buffer, 2)
        self.size = len(self.starts)
        self.joined = np.frombuffer(self.buffer, np.uint8)[self.ends[:-1]] == 32  # the next word is of the same piece
        lang_hash = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        self.hashes = [{1: _mix(w ^ lang_hash)} for w in words]
        self.valid = {1: np.ones(self.size, bool)}
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        owner = np.array([xxhash.xxh32_intdigest(t) for t in texts], np.uint32)
        self.owner = owner[np.searchsorted(first, self.starts, "right") - 1]  # of each word's document

    def order(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n-gram at each word, and whether it is one."""
        made = self.hashes[seed]
        if n not in made:
            h, ok = self.order(n - 1, seed)
            rest = made[1][n - 1 :]
            made[n] = _mix(h[: len(rest)] * np.uint64(_P) + rest)
            self.valid[n] = ok[: len(rest)] & self.joined[n - 2 :][: len(rest)]
        return made[n], self.valid[n]

    def kept(self, n: int, maps: dict[int, np.ndarray], below: int, shift: int) -> np.ndarray:
        """Places of the n-grams all of whose n-grams of order `below` are in the map."""
        h, ok = self.order(n)
        at = np.flatnonzero(ok)
        if below:
            inner = (self.order(below)[0] >> np.uint64(shift)).view(np.int64)
            for k in range(n - below + 1):
                at = at[has(maps[below], inner[at + k])]
        return at

    def phrase(self, at: int, n: int) -> str:
        return self.buffer[self.starts[at] : self.ends[at + n - 1]].decode("utf-8", "replace")


def _pieces_of(text: bytes, chunk: int) -> Iterator[bytes]:
    """A text as lines of pieces whose words are parted by one blank, in parts of about `chunk` bytes."""
    first = 0
    while first < len(text):
        last = first + chunk
        if last < len(text):
            last = text.rfind(b"\n", first + 1, last)
            if last < 0:
                last = text.find(b"\n", first + chunk)
        last = len(text) if last < 0 else last
        words = _BLANKS.sub(b" ", _LINES.sub(b"\n", text[first:last])).strip(b" \n")
        if words:
            yield words
        first = last + 1


def _grams_of(batch: pa.RecordBatch, chunk: int) -> Iterator[tuple[str, Grams]]:
    """The batch's texts (columns lang, text) by language, in chunks."""
    by_lang: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        raw = text.as_buffer() if text.is_valid else None
        if raw is None or not raw.size:
            continue
        lang = "und" if lang is None else lang
        for part in _pieces_of(raw.to_pybytes().translate(_TABLE), chunk):
            by_lang.setdefault(lang, []).append(part)
            sizes[lang] = sizes.get(lang, 0) + len(part)
            if sizes[lang] >= chunk:
                yield lang, Grams(lang, by_lang.pop(lang))
                sizes.pop(lang)
    for lang, texts in by_lang.items():
        yield lang, Grams(lang, texts)


def _add(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys as one."""
    h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(first) else c


def _shift(parts: int) -> int:
    """Hashes lose so many low bits that a key, without its partition, has 32."""
    return 32 - (parts.bit_length() - 1)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(0, np.int64)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist()))


def _packed(source: DataFrame, orders: tuple[int, ...], below: int, maps, parts: int) -> DataFrame:
    """(part, mass, data): what each task's documents hold of the orders, by hash partition: a row with the mass, and one with keys and counts."""
    most, chunk, shift = HELD, CHUNK, _shift(parts)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [none], 0
        for batch in batches:
            for _, grams in _grams_of(batch, chunk):
                for n in orders:
                    h, c = np.unique(grams.order(n)[0][grams.kept(n, maps.value, below, shift)] >> np.uint64(shift), return_counts=True)
                    held.append((h, c.astype(np.int64)))
                    waiting += len(h)
                if waiting > most // 2:
                    held, waiting = [_add(held)], 0
                    if len(held[0][0]) > most:
                        yield send(*held[0])
                        held = [none]
        yield send(*_add(held))

    def send(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        times = -(-c // 255)  # a count of over a byte takes several entries
        low = np.repeat(c // times, times)
        more = np.repeat(c - c // times * times, times)
        low += (np.arange(len(low)) - np.repeat(np.cumsum(times) - times, times)) < more
        h = np.repeat(h, times)
        part = (h % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, rest, low = part[order], (h // np.uint64(parts)).astype("<u4")[order], low.astype(np.uint8)[order]
        rows = _runs(part)
        own = [int(part[a]) for a, _ in rows]
        data = [rest[a:z].tobytes() + low[a:z].tobytes() for a, z in rows]
        columns = [pa.array(own + own, pa.int32()), pa.array([int(low[a:z].sum(dtype=np.int64)) for a, z in rows] + [None] * len(rows), pa.int64()), pa.array([None] * len(rows) + data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "mass", "data"])

    return source.mapInArrow(run, "part int, mass long, data binary")


class Summary:
    """Misra-Gries counters, merged from counts: `lost` bounds what any of them lacks."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.h, self.c = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.h, self.c = _add([(self.h, self.c), *held])
        if len(self.h) > self.capacity:
            at = len(self.h) - self.capacity - 1
            off = np.partition(self.c, at)[at]  # the largest counter that has no room
            self.lost += int(off)
            left = self.c > off
            self.h, self.c = self.h[left], self.c[left] - off

    def survivors(self, threshold: int) -> np.ndarray:
        """Hashes whose count may reach the threshold; none that does is missing."""
        return self.h[self.c + self.lost >= threshold]


def _by_part(packed: DataFrame, each, schema: str) -> DataFrame:
    """Rows (part, mass, data) dealt by part, masses first; `each` makes batches of a part's number, mass and data as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, made = None, 0, None
        for batch in batches:
            for p, m, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if p != part:
                    if made is not None:
                        yield made.done()
                    part, mass, made = p, 0, None
                if m is not None:
                    mass += m
                    continue
                if made is None:
                    made = each(part, mass)
                made.take(data.as_buffer())
        if made is not None:
            yield made.done()

    dealt = packed.repartition(partitions(packed.sparkSession), "part").sortWithinPartitions("part", F.col("mass").isNull())
    return dealt.mapInArrow(run, schema)


class _Surviving:
    """A part's summary as its packed counts arrive."""

    def __init__(self, part: int, mass: int, parts: int, threshold: int):
        self.part, self.parts, self.threshold = part, parts, threshold
        self.summary, self.held, self.waiting = Summary(SLACK * (mass // threshold + 1)), [], 0

    def take(self, data) -> None:
        n = data.size // 5
        self.held.append((np.frombuffer(data, "<u4", n).astype(np.uint64), np.frombuffer(data, np.uint8, n, 4 * n).astype(np.int64)))
        self.waiting += n
        if self.waiting > max(self.summary.capacity, 1 << 16):
            self.summary.merge(self.held)
            self.held, self.waiting = [], 0

    def done(self) -> pa.RecordBatch:
        self.summary.merge(self.held)
        found = self.summary.survivors(self.threshold) * np.uint64(self.parts) + np.uint64(self.part)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])


#: What the exact count sends of an n-gram in a task: 96 bits of hash, its count, the least hash of its documents.
_EXACT = np.dtype([("h", "<u8"), ("g", "<u4"), ("n", "<u4"), ("owner", "<u4")])


def _merged(x: np.ndarray) -> np.ndarray:
    """Entries of equal hashes as one: counts added, the least owner."""
    x = x[np.lexsort((x["g"], x["h"]))]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), (x["h"][1:] != x["h"][:-1]) | (x["g"][1:] != x["g"][:-1])]))
    out = x[first]
    if len(first):
        out["n"], out["owner"] = np.add.reduceat(x["n"], first), np.minimum.reduceat(x["owner"], first)
    return out


class _Exact:
    """A part's exact counts as they arrive."""

    def __init__(self, threshold: int):
        self.threshold, self.sum = threshold, np.zeros(0, np.int64)
        self.all, self.held = np.zeros(0, _EXACT), []

    def take(self, data) -> None:
        self.held.append(np.frombuffer(data, _EXACT))
        if sum(map(len, self.held)) > max(len(self.all), 1 << 16):
            self._merge()

    def _merge(self) -> None:
        both = np.concatenate([self.all, *self.held])
        order = np.lexsort((both["g"], both["h"]))
        wide = np.concatenate([self.sum, *(x["n"].astype(np.int64) for x in self.held)])[order]
        both = both[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(both)), bool), (both["h"][1:] != both["h"][:-1]) | (both["g"][1:] != both["g"][:-1])]))
        self.all, self.sum, self.held = both[first], np.add.reduceat(wide, first) if len(first) else wide, []
        if len(first):
            self.all["owner"] = np.minimum.reduceat(both["owner"], first)

    def done(self) -> pa.RecordBatch:
        self._merge()
        some = self.sum >= self.threshold
        x = self.all[some]
        return pa.RecordBatch.from_arrays([pa.array(x["h"].view(np.int64)), pa.array(x["g"].astype(np.int64)), pa.array(x["owner"].astype(np.int64)), pa.array(self.sum[some])], names=["h", "g", "owner", "f"])


def _owned(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A key of an n-gram in the documents that are to give its words."""
    return _mix(h ^ (owner.astype(np.uint64) * np.uint64(_P))).view(np.int64)


def frequent(docs: DataFrame, threshold: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f): n-grams of one to five words found at least `threshold` times; (lang, n): words by language."""
    spark = docs.sparkSession
    source = docs.select("lang", "text")
    parts = SUMMARIES * partitions(spark)
    shift, most, chunk = _shift(parts), HELD // 4, CHUNK
    maps: dict[int, np.ndarray] = {}
    below = 0
    for orders in LEVELS:
        packed = _packed(source, orders, below, spark.sparkContext.broadcast(dict(maps)), parts)
        found = scratch(_by_part(packed, lambda part, mass: _Surviving(part, mass, parts, threshold), "h long"), "surviving")
        for n in orders:
            maps[n] = bit_map(found, "h")
        below = orders[-1]
    shared = spark.sparkContext.broadcast(maps)

    def surviving(grams: Grams, n: int) -> np.ndarray:
        h, ok = grams.order(n)
        at = np.flatnonzero(ok)
        return at[has(shared.value[n], (h[at] >> np.uint64(shift)).view(np.int64))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [np.zeros(0, _EXACT)], 0
        for batch in batches:
            for _, grams in _grams_of(batch, chunk):
                for n in shared.value:
                    at = surviving(grams, n)
                    x = np.ones(len(at), _EXACT)
                    x["h"], x["g"], x["owner"] = grams.order(n)[0][at], grams.order(n, 1)[0][at] >> np.uint64(32), grams.owner[at]
                    held.append(_merged(x))
                    waiting += len(held[-1])
                if waiting > most:
                    held, waiting = [_merged(np.concatenate(held))], 0
                    if len(held[0]) > most:
                        yield send(held[0])
                        held = [np.zeros(0, _EXACT)]
        yield send(_merged(np.concatenate(held)))

    def send(x: np.ndarray) -> pa.RecordBatch:
        part = (x["h"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rows = _runs(part[order])
        columns = [pa.array([int(part[order[a]]) for a, _ in rows], pa.int32()), pa.array([None] * len(rows), pa.int64()), pa.array([x[order[a:z]].tobytes() for a, z in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "mass", "data"])

    exact = _by_part(source.mapInArrow(count, "part int, mass long, data binary"), lambda part, mass: _Exact(threshold), "h long, g long, owner long, f long")
    exact = scratch(exact, "counted")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_owned(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))], names=["k"])

    wanted = spark.sparkContext.broadcast(bit_map(exact.select("h", "owner").mapInArrow(keys, "k long"), "k", 64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for lang, grams in _grams_of(batch, chunk):
                totals[lang] = totals.get(lang, 0) + grams.size
                for n in shared.value:
                    at = surviving(grams, n)
                    at = at[has(wanted.value, _owned(grams.order(n)[0][at], grams.owner[at]))]
                    at = at[np.unique(grams.order(n)[0][at], return_index=True)[1]]
                    for column, x in zip(out, ([lang] * len(at), [n] * len(at), [grams.phrase(i, n) for i in at.tolist()], grams.order(n)[0][at].view(np.int64).tolist(), (grams.order(n, 1)[0][at] >> np.uint64(32)).tolist())):
                        column += x
            yield rows(out)
        yield rows([list(totals), [0] * len(totals), [None] * len(totals), list(totals.values()), [0] * len(totals)])

    def rows(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["lang", "words", "phrase", "h", "g"])

    texts = scratch(source.mapInArrow(read, "lang string, words int, phrase string, h long, g long"), "phrase-texts")
    named = texts.where("words > 0").groupBy("h", "g").agg(F.min(F.struct("lang", "words", "phrase")).alias("x"))
    counts = scratch(exact.join(named, ["h", "g"]).select("x.*", "f"), "phrases")
    return counts, texts.where("words = 0").groupBy("lang").agg(F.sum("h").alias("n"))


def collocations(docs: DataFrame, threshold: int = 100, top: int = 2000, percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases.

    A phrase inside a longer one that has at least `percent` of its occurrences goes.
    """
    counts, totals = frequent(docs, threshold)
    phrases = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "words", "f", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("right"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    scored = scored.withColumn("score", F.expr("CAST(1000 AS DECIMAL(4, 0)) * a * n div (CAST(l AS DECIMAL(19, 0)) * r)"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inner = phrases.where("words > 2").select("lang", "f", F.explode(F.expr("flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1), i -> array_join(slice(w, i, s), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = weakest.join(inner, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(percent) * F.col("a"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
