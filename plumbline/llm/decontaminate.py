"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are lower-cased and every run of ASCII marks and white space becomes one blank. An item of n bytes that
occurs with at most e = rate * n edits shares at least n + 1 - q - e * q of its q-grams with the region, all of them
on diagonals (place in the document less place in the item) at most e apart from where it starts. So: (1) mark
the document's q-grams that any item has, in one table look-up per byte; (2) keep windows with enough marks;
(3) count shared q-grams in overlapping diagonal bands, so wide that one band holds all of a true occurrence;
(4) verify bands that meet the bound by alignment inside the band, many at once. Nothing within the edit budget is missed.

Items are broadcast in blocks of at most `BLOCK` bytes of text; a larger benchmark takes several blocks, each a
narrow step over all documents. Items so short that the bound for q falls below one are looked for by shorter q-grams, and
those shorter than q as whole words without edits; only items without a letter or digit are not. Nulls: a null text holds nothing; null items are ignored. Repeated rows are searched each.
An empty table gives no rows, an empty benchmark finds nothing. Extra columns pass through; those named like a result
column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import carried, slices

#: Bytes of item text that one broadcast holds at most.
BLOCK = 8 << 20
#: Bytes of documents searched at a time.
CHUNK = 1 << 20
_TABLE_BITS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split())


def grams(buffer: bytes, q: int) -> np.ndarray:
    """Every q bytes in a row (q <= 16) as a 64-bit number: exact up to 8 bytes, a hash beyond."""
    n = len(buffer) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.frombuffer(buffer + b"\0" * 16, np.uint8)
    head = np.ndarray(n, "<u8", padded, strides=(1,))
    if q <= 8:
        return head & np.uint64(2 ** (8 * q) - 1)
    tail = np.ndarray(n, "<u8", padded, offset=8, strides=(1,)) & np.uint64(2 ** (8 * (q - 8)) - 1)
    mixed = (head ^ (head >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + tail * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(32))


class Items:
    """Normalised items, indexed by q-gram."""

    def __init__(self, rows: list[tuple[int, bytes]], q: int, rate: float):
        self.q, self.ids, self.texts = q, [r[0] for r in rows], [r[1] for r in rows]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.budget = (self.sizes * rate).astype(np.int64)
        self.need = np.maximum(1, self.sizes + 1 - q - self.budget * q)
        each = [grams(t, q) for t in self.texts]
        every = np.concatenate(each) if each else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.item = np.repeat(np.arange(len(each)), [len(x) for x in each])[order]
        self.at = (np.concatenate([np.arange(len(x)) for x in each]) if each else np.zeros(0, np.int64))[order]
        self.gram, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._slot(self.gram)] = True
        self.classes = []  # (window, marks it must have) for items of like size
        done = 0
        for n in np.unique(self.sizes):
            if n > done:
                done = int(n * 1.2) + 1
                same = (self.sizes >= n) & (self.sizes <= done)
                self.classes.append((int((self.sizes + self.budget)[same].max()), int(self.need[same].min())))

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * _MULTIPLIER) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """For each normalised text, (item's place, edits) of the items in it."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not self.ids:
            return out
        buffer = b"\0".join(texts)
        g = grams(buffer, self.q)
        mark = self.table[self._slot(g)]
        sums = np.zeros(len(mark) + 1, np.int32)
        np.cumsum(mark, out=sums[1:])
        live = np.zeros(len(mark) + 1, np.int32)
        for window, least in self.classes:
            w = min(window, len(mark))
            if not w:
                continue
            good = np.flatnonzero(sums[w:] - sums[:-w] >= least)
            if len(good):  # neighbouring windows make one stretch
                cut = np.flatnonzero(np.diff(good) > 1)
                np.add.at(live, good[np.concatenate([[0], cut + 1])], 1)
                np.add.at(live, good[np.concatenate([cut, [len(good) - 1]])] + w, -1)
        places = np.flatnonzero(mark & (np.cumsum(live[:-1]) > 0))
        k = np.searchsorted(self.gram, g[places])
        k[k == len(self.gram)] = 0
        real = self.gram[k] == g[places]
        places, k = places[real], k[real]
        if not len(places):
            return out
        counts = self.first[k + 1] - self.first[k]
        place = np.repeat(places, counts)
        entry = np.repeat(self.first[k], counts) + np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
        item = self.item[entry]
        diagonal = place - self.at[entry]
        step = self.budget[item] + 1
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        doc = np.searchsorted(starts, place, "right") - 1  # an occurrence lies in one document
        whole = np.concatenate([doc * len(self.ids) + item] * 3)
        band = np.concatenate([diagonal // step - b for b in range(3)])
        order = np.lexsort((band, whole))
        whole, band = whole[order], band[order]
        edge = np.flatnonzero(np.concatenate([[True], (whole[1:] != whole[:-1]) | (band[1:] != band[:-1]), [True]]))
        whole, band, n = whole[edge[:-1]], band[edge[:-1]], np.diff(edge)
        doc, item = np.divmod(whole, len(self.ids))
        enough = n >= self.need[item]
        doc, item, band, n = doc[enough], item[enough], band[enough], n[enough]
        if not len(item):
            return out
        # Several bands see one occurrence, and a text may hold an item more than once: the least edits of all bands count.
        found: dict[tuple[int, int], int] = {}
        edits = self.align(buffer, item, band, starts[doc], starts[doc + 1] - 1)
        for d, i, e in zip(doc.tolist(), item.tolist(), edits.tolist()):
            if e <= self.budget[i]:
                found[d, i] = min(e, found.get((d, i), e))
        for (d, i), e in sorted(found.items()):
            out[d].append((i, e))
        return out

    def align(self, buffer: bytes, item: np.ndarray, band: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least edits of each item against bytes low to high of the buffer, by dynamic programming over the diagonals of its band only."""
        raw = np.frombuffer(buffer, np.uint8)
        result = np.zeros(len(item), np.int64)
        order = np.lexsort((self.sizes[item], self.budget[item]))
        widths = self.budget[item[order]]  # bands of one width together: what an item is given does not depend on its neighbours
        cuts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(order)]
        for at, to in ((a, min(a + 256, z)) for first, z in zip(cuts, cuts[1:]) for a in range(first, z, 256)):
            some = order[at:to]
            sizes, step = self.sizes[item[some]], self.budget[item[some]] + 1
            width, rows = int(3 * step[0]) + 1, int(sizes.max())
            text = np.zeros((len(some), rows), np.uint8)
            for r, i in enumerate(item[some]):
                text[r, : self.sizes[i]] = np.frombuffer(self.texts[i], np.uint8)
            where = (band[some] * step)[:, None] + np.arange(rows + width)[None, :]
            inside = (where >= low[some, None]) & (where < high[some, None])
            region = np.where(inside, raw[np.clip(where, 0, len(raw) - 1)], 0)
            slope = np.arange(width)
            row = np.zeros((len(some), width), np.int32)  # an occurrence may start on any diagonal of the band
            final = row.min(axis=1)
            for j in range(rows):
                new = row + (region[:, j : j + width] != text[:, j : j + 1])
                new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # an item's byte is missing
                row = np.minimum.accumulate(new - slope, axis=1) + slope  # bytes are put in between
                ends = sizes == j + 1
                if ends.any():
                    final[ends] = row[ends].min(axis=1)
            result[some] = final
        return result


class Words:
    """Items found without edits only, at word bounds, by their number of words."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids: dict[bytes, list[int]] = {}
        for i, text in rows:
            self.ids.setdefault(text, []).append(i)
        self.lengths = sorted({t.count(b" ") + 1 for t in self.ids})

    def search(self, text: bytes) -> list[int]:
        words, found = text.split(), set()
        for n in self.lengths:
            found |= self.ids.keys() & (words if n == 1 else map(b" ".join, zip(*(words[k:] for k in range(n)))))
        return [i for t in found for i in self.ids[t]]


class Benchmark:
    """Items of any length: by q-grams, by shorter ones where their bound would fall below one, and as whole words."""

    def __init__(self, rows: list[tuple[int, bytes]], q: int, rate: float):
        edits = lambda r: int(len(r[1]) * rate)
        short = [r for r in rows if len(r[1]) + 1 - q - edits(r) * q < 1]
        near = [r for r in short if edits(r)]
        self.parts = [Items([r for r in rows if len(r[1]) + 1 - q - edits(r) * q >= 1], q, rate)]
        if near:
            self.parts.append(Items(near, max(1, min(len(r[1]) // (edits(r) + 1) for r in near)), rate))
        self.words = Words([r for r in short if not edits(r)])

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """For each normalised text, (item's id, edits) of the items in it."""
        out = [[(i, 0) for i in self.words.search(t)] if self.words.ids else [] for t in texts]
        for part in self.parts:
            for own, found in zip(out, part.search(texts)):
                own += [(part.ids[i], e) for i, e in found]
        return out


def find(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, least: int = 1) -> DataFrame:
    """`docs` with contaminated, item_ids (array, ascending) and edits (array, in their order)."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK))
    new = {"contaminated": T.BooleanType(), "item_ids": T.ArrayType(T.LongType()), "edits": T.ArrayType(T.LongType())}
    out = docs.select(*[F.col(f"`{c}`") for c in carried(docs, new)])
    for b in range(blocks):
        rows = [(r["item_id"], t) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() if len(t := normalise(r["text"])) >= least]
        shared = spark.sparkContext.broadcast(Benchmark(sorted(rows), q, rate))
        out = out.mapInArrow(_step(shared, out.columns), T.StructType([f for f in out.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in new.items()]))
    return out


def _step(shared, columns: list[str]):
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            texts = [normalise(t) for t in batch.column(at).to_pylist()]
            hits: list[dict[int, int]] = [{} for _ in texts]
            if "item_ids" in columns:  # what earlier blocks found
                before = zip(batch.column(columns.index("item_ids")).to_pylist(), batch.column(columns.index("edits")).to_pylist())
                hits = [dict(zip(i, e)) for i, e in before]
            for a, b in slices([len(t) for t in texts], CHUNK):
                for h, found in zip(hits[a:b], items.search(texts[a:b])):
                    for i, e in found:
                        h[i] = min(e, h.get(i, e))
            ids = [sorted(h) for h in hits]
            made = [pa.array([bool(h) for h in hits], pa.bool_()), pa.array(ids, pa.list_(pa.int64())), pa.array([[h[i] for i in x] for h, x in zip(hits, ids)], pa.list_(pa.int64()))]
            kept = [c for c in columns if c not in ("contaminated", "item_ids", "edits")]
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in kept), *made], names=[*kept, "contaminated", "item_ids", "edits"])

    return run
