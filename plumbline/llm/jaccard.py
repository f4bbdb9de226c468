"""Exact Jaccard self-join of documents on word shingles, and the groups its links make.

Texts with the same shingle set are one node. Sizes fall into bands of one octave; a node belongs to its own band
and, near the upper edge, to the next one too, so any two sizes that can reach the threshold share a band. In a
band the hash space is cut into parts, more of them than elements in which two linked sets can differ by d; so among
the first d + 1 parts in which a node has any hash, one is the same in both. A tile is such a part with what it
holds: (band, part, content). Nodes meet only in tiles.

A tile's nodes carry hashed parity bitmaps: the bits in which two differ bound their overlap from above. The first
sweep emits of the pairs that pass a forest only, closest pairs first: never more pairs than nodes, however dense
the tile. What it emits is verified by intersecting the sorted hash arrays exactly. Where a pair of the forest fails and
others were left out of it, the tile is swept again with longer bitmaps: of the nodes that still have a pair to pass between two
components, the arrays themselves come to the tile, once each, and all overlaps are counted there at once (elements that many nodes
hold by a product of matrices, others by the pairs that hold them). Only links leave the tile, a forest of them. So no
link between components is lost, no pair that fails is sent anywhere, and no group is expanded into all its pairs.

A tile of more than CHUNK nodes is dealt in chunks, each swept for itself; what lies in different components after
that meets in the second sweep, chunk by chunk: the tile's largest component is not crossed with itself. No task
holds more than two chunks.

One pass over the texts keeps of each set its digest, its tiles' keys and a short bitmap. The arrays of nodes that
are in emitted pairs or in large tiles are computed anew from the texts. Bit maps of bounded size tell which
keys and documents are worth sending: beyond FILTER_BITS more rows travel than need to, and no result changes.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; a text of fewer words than a shingle is one shingle; a null
or empty text has none and links with nothing. Sets are compared by 64-bit hashes of their shingles. Rows with the same
doc_id are one document for linking. A null doc_id sorts first and gets component null. Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import NULL_ID, as_bytes, discard, id_key, partitions, scratch, slices
from plumbline.llm.components import components
from plumbline.llm.substrings import _P, _Q, _grams, _mix, word_hashes

CHUNK_BYTES = 1 << 20
#: Nodes of a tile that one task compares with each other.
CHUNK = 1024
#: Elements that count as much as a node where tiles are cut into chunks for the second sweep.
WEIGHT = 2048
#: Elements whose overlaps are counted at a time.
ELEMENTS = 1 << 21
#: Bits of the bitmaps of the first sweep; those of the second have four for each hash of a set, in these bounds.
SHORT_BITS, LONG_BITS = 2048, 1 << 16
#: Bit maps have at most two to the power of this many bits (64 MB).
FILTER_BITS = 29
#: Keys that are counted together, about.
BUCKET_KEYS = 1 << 17
#: Tables of at most so many rows of two numbers are broadcast, larger ones joined by shuffle.
SMALL_TABLE = 1 << 16
_NEVER = np.int32(1 << 30)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each lower-cased text."""
    words = [t.lower().split() for t in texts]
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    some = [i for i, w in enumerate(words) if len(w) >= k]
    if some:
        _, _, h = word_hashes(b"\n".join(b" ".join(words[i]) for i in some))
        g, at = _grams(h, k, _P), 0
        for i in some:
            out[i] = np.unique(g[at : at + len(words[i]) - k + 1])
            at += len(words[i])
    for i, w in enumerate(words):
        if 0 < len(w) < k:
            out[i] = np.array([xxhash.xxh3_64_intdigest(b" ".join(w))], np.uint64)
    return out


def _each(batches: Iterator[pa.RecordBatch], k: int, wanted: np.ndarray | None = None):
    """(keys, sets) by chunk of documents (doc, text); with a bit map, of the documents it may hold only."""
    for batch in batches:
        if wanted is not None:
            batch = batch.filter(pa.array(has(wanted, batch.column(0).to_numpy())))
        doc, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
        for a, b in slices([len(t) for t in texts], CHUNK_BYTES):
            yield doc[a:b], shingle_sets(texts[a:b], k)


def _digest(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


# -- tiles of a set -----------------------------------------------------------------------------------


def most_different(n: int, percent: int) -> int:
    """Elements in which a set of n and any it can link with differ at most."""
    return (100 - percent) * (n + 100 * n // percent) // (100 + percent)


def _parts(band: int, percent: int) -> int:
    """Parts of the hash space in a band: some of them may be empty, so there are 15 % more than any set needs."""
    return most_different((2 << band) - 1, percent) * 23 // 20 + 4


def tile_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the tiles of a sorted set; two sets that reach the threshold and are not equal share one at least.

    Of two linked sets a and b, let a's list end at the lower part. It names d + 1 parts that hold something in a, with
    d at least the number of elements in which they differ, so one of these parts is the same in b, which names it
    too. A set with fewer parts that hold something names all parts, empty ones included, and the same count holds.
    """
    n, keys = len(s), []
    need = most_different(n, percent) + 1
    if need == 1:
        return np.zeros(0, np.uint64)
    own = n.bit_length() - 1
    for band in (own, own + 1) if 100 * n >= percent * (2 << own) else (own,):
        parts = _parts(band, percent)
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        held = np.add.reduceat(s, first)
        if len(first) >= need:
            at, content = part[first[:need]], held[:need]
        else:
            at, content = np.arange(parts, dtype=np.uint64), np.zeros(parts, np.uint64)
            content[part[first].astype(np.int64)] = held
        keys.append(_mix(content + at * np.uint64(_P) + np.uint64(band * _Q % 2**64)))
    return np.concatenate(keys)


def bitmap(s: np.ndarray, bits: int) -> bytes:
    """Parity bitmap: bit i is odd if an odd number of hashes is i modulo `bits`."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _long_bits(n: int) -> int:
    return min(LONG_BITS, max(SHORT_BITS, 1 << (4 * n - 1).bit_length()))


def _words(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the shortest."""
    least = min(len(x) for x in bitmaps) // 8
    out = np.empty((len(bitmaps), least), np.uint64)
    for i, x in enumerate(bitmaps):
        row = np.frombuffer(x, np.uint64)
        while len(row) > least:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out


def _may_link(na, nb, differ, percent: int):
    """Whether sets of sizes na and nb can reach the threshold when their bitmaps differ in so many bits."""
    return (differ * (100 + percent) <= (100 - percent) * (na + nb)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _costs(n: np.ndarray, label: np.ndarray, side: np.ndarray | None, words: np.ndarray, percent: int) -> np.ndarray:
    """Bits in which the bitmaps of each two nodes differ; _NEVER for those that cannot link or need not be compared."""
    m, step = len(n), max(1, (1 << 20) // words.size)
    out = np.empty((m, m), np.int32)
    for a in range(0, m, step):
        z = min(m, a + step)
        differ = np.bitwise_count(words[a:z, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.int32)
        good = _may_link(n[a:z, None], n[None, :], differ, percent) & (label[a:z, None] != label[None, :])
        if side is not None:
            good &= (side[a:z, None] != side[None, :]) | (side[a:z, None] == 2)
        out[a:z] = np.where(good, differ, _NEVER)
    return out


def forest(cost: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs below _NEVER, of least total cost (Boruvka), over groups of nodes with one label."""
    label, out = np.unique(label, return_inverse=True)[1], []
    while True:
        open_ = np.where(label[:, None] == label[None, :], _NEVER, cost)
        to = open_.argmin(axis=1)
        least = open_[np.arange(len(to)), to]
        rows = np.flatnonzero(least < _NEVER)
        if not len(rows):
            return out
        low, high = np.minimum(rows, to[rows]), np.maximum(rows, to[rows])
        order = np.lexsort((high, low, least[rows]))
        best = order[np.unique(label[rows[order]], return_index=True)[1]]  # the first of each group
        for i, j in sorted(set(zip(low[best].tolist(), high[best].tolist()))):
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)
                out.append((i, j))


# -- bit maps of keys ---------------------------------------------------------------------------------


def bit_map(keys: DataFrame, column: str, spread: int = 16) -> np.ndarray:
    """A bit map of the low bits of distinct long keys; its size follows their number up to FILTER_BITS."""
    bits = min(FILTER_BITS, max(20, math.ceil(math.log2(spread * max(1, keys.count())))))
    at = F.col(column).bitwiseAND((1 << bits) - 1)
    parts = keys.groupBy((at / 32768).cast("int").alias("k")).agg(F.bitmap_construct_agg(at % 32768).alias("b")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(r["b"], np.uint8)
    return out


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (8 * len(bits) - 1)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])), [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _repeated(nodes: DataFrame) -> DataFrame:
    """(key): the upper halves of tile keys that two nodes or more have. They travel packed by bucket, at most two of a kind from a batch."""
    total = nodes.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    shift = max(0, 32 - max(4, math.ceil(math.log2(max(1, total // 8) / BUCKET_KEYS + 1))))

    def pack(batches):
        for batch in batches:
            if len(batch):
                kept, times = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64) >> np.uint64(32), return_counts=True)
                kept = np.repeat(kept, np.minimum(times, 2)).astype(np.uint32)
                cut = _runs(kept >> np.uint32(shift))
                yield pa.RecordBatch.from_arrays([pa.array((kept[cut[:-1]] >> np.uint32(shift)).astype(np.int32) if len(kept) else np.zeros(0, np.int32)), pa.array([kept[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary())], names=["bucket", "keys"])

    def count(batches):
        bucket, held = None, []

        def done():
            kept, times = np.unique(np.frombuffer(b"".join(held), np.uint32), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(kept[times > 1].astype(np.int64))], names=["key"])

        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != bucket and held:
                    yield done()
                    held = []
                bucket = b
                held.append(x)
        if held:
            yield done()

    packed = nodes.select("keys").where(F.octet_length("keys") > 0).mapInArrow(pack, "bucket int, keys binary")
    return packed.repartition(partitions(nodes.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(count, "key long")


# -- passes over the texts ----------------------------------------------------------------------------


def _sets_of(docs: DataFrame) -> DataFrame:
    return docs.select(id_key("doc_id").alias("doc"), "text")


def _meta(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc, h1, h2, n, keys, bits): each document's set; keys and bitmap once for each set of a chunk."""

    def run(batches):
        for doc, sets in _each(batches, k):
            digests = [_digest(s) for s in sets]
            d = np.array(digests, np.int64).reshape(-1, 2)
            first = {x: i for i, x in reversed(list(enumerate(digests)))}
            new = [first[x] == i and len(s) > 0 for i, (x, s) in enumerate(zip(digests, sets))]
            keys = [tile_keys(s, percent).tobytes() if x else None for s, x in zip(sets, new)]
            bits = [bitmap(s, SHORT_BITS) if x else None for s, x in zip(sets, new)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary())], names=["doc", "h1", "h2", "n", "keys", "bits"])

    return _sets_of(docs).mapInArrow(run, "doc long, h1 long, h2 long, n long, keys binary, bits binary")


def _arrays(docs: DataFrame, k: int, wanted) -> DataFrame:
    """(node, n, hashes, bits): sorted arrays and long bitmaps of the documents wanted."""

    def run(batches):
        for doc, sets in _each(batches, k, wanted.value):
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s, _long_bits(len(s))) for s in sets], pa.binary())], names=["node", "n", "hashes", "bits"])

    return _sets_of(docs).mapInArrow(run, "node long, n long, hashes binary, bits binary").where("n > 0")


# -- sweeps -------------------------------------------------------------------------------------------


def _tile_rows(nodes: DataFrame, shared) -> DataFrame:
    """(key, n, node): a row for each tile of a node that another node may be in."""

    def run(batches):
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column(2).to_pylist()], np.int64)
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            some = has(shared.value, (keys >> np.uint64(32)).astype(np.int64)) if len(keys) else np.zeros(0, bool)
            row = pa.array(row[some])
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), *(batch.column(i).take(row) for i in (0, 1))], names=["key", "n", "node"])

    return nodes.select("n", "node", "keys").mapInArrow(run, "key long, n long, node long")


def _unlike(rows: DataFrame) -> DataFrame:
    """(key): of tiles that hold the same two or more nodes, by two hashes of all of them, one."""
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    return held.where("c > 1").groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key")


def _of_keys(rows: DataFrame, keys) -> DataFrame:
    """The rows whose keys a bit map may hold."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(has(keys.value, batch.column(0).to_numpy())))

    return rows.select("key", "n", "node").mapInArrow(run, "key long, n long, node long")


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (key, sub), cut where a tile ends."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0] if len(batch) else rest
        if len(batch):
            key, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            other = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
            cut = other[-1] + 1 if len(other) else 0
            if cut:
                yield batch.slice(0, cut)
            rest = batch.slice(cut)
    if rest is not None and len(rest):
        yield rest


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of some sorted sets share, exactly.

    An element that f of N sets hold counts for f * f pairs; from N / 10 on it goes through a product of matrices instead. One that a
    single set holds counts for nothing.
    """
    m = len(sets)
    total = sum(map(len, sets))
    if total > ELEMENTS:  # by ranges of the hash space
        out = np.zeros((m, m), np.int64)
        cuts = [np.concatenate([[0], np.searchsorted(x, np.arange(1, total // ELEMENTS + 1, dtype=np.uint64) * np.uint64(2**64 // (total // ELEMENTS + 1))), [len(x)]]) for x in sets]
        for k in range(total // ELEMENTS + 1):
            out += _counted([x[c[k] : c[k + 1]] for x, c in zip(sets, cuts)])
        return out
    return _counted(sets)


def _counted(sets: list[np.ndarray]) -> np.ndarray:
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    everything, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], everything[1:] != everything[:-1], [True]])) if len(everything) else np.zeros(1, np.int64)
    first, held = edge[:-1], np.diff(edge)
    for f in np.unique(held[(held > 1) & (held < max(8, m // 10))]).tolist():
        starts = first[held == f]
        for k in range(0, len(starts), step := max(1, (1 << 20) // (f * f))):
            own = owner[starts[k : k + step, None] + np.arange(f)]
            out += np.bincount((own[:, :, None] * m + own[:, None, :]).ravel(), minlength=m * m).reshape(m, m) if len(own) * f * f > m * m // 8 else _scattered(own, m)
    many = np.flatnonzero(held >= max(8, m // 10))
    for k in range(0, len(many), 2048):
        some = many[k : k + 2048]
        at = np.repeat(first[some] - np.concatenate([[0], np.cumsum(held[some])[:-1]]), held[some]) + np.arange(held[some].sum())
        dense = np.zeros((m, len(some)), np.float32)
        dense[owner[at], np.repeat(np.arange(len(some)), held[some])] = 1
        out += (dense @ dense.T).astype(np.int64)  # whole numbers below 2 ** 24 are exact
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def _scattered(own: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros((m, m), np.int64)
    np.add.at(out, (own[:, :, None], own[:, None, :]), 1)
    return out


def _exact_sweep(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of the links between different labels in each tile; rows: (key, sub, n, node, label, side, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_tiles(batches):
            key, sub, n, node, label, side = (batch.column(i).to_numpy() for i in range(6))
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]), [True]]))
            out_a, out_b = [], []
            for i, to in zip(edge.tolist(), edge[1:].tolist()):
                if (label[i:to] == label[i]).all():
                    continue
                both = overlaps([np.frombuffer(x, np.uint64) for x in batch.column(6).slice(i, to - i).to_pylist()])
                union = n[i:to, None] + n[None, i:to] - both
                good = (100 * both >= percent * union) & (label[i:to, None] != label[None, i:to])
                if (side[i:to] < 2).any():
                    good &= (side[i:to, None] != side[None, i:to]) | (side[i:to, None] == 2)
                for x, y in forest(np.where(good, (union - both).astype(np.int32), _NEVER), label[i:to]):
                    out_a.append(i + x), out_b.append(i + y)
            a, b = node[np.array(out_a, np.int64)], node[np.array(out_b, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = rows.select("key", "sub", "n", "node", "label", "side", "hashes").repartition(partitions(rows.sparkSession), "key", "sub").sortWithinPartitions("key", "sub", "n", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _in_question(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (key, sub, n, node, label, side) of nodes whose bitmaps let them link with another label's in their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_tiles(batches):
            key, sub, n, _, label, side = (batch.column(i).to_numpy() for i in range(6))
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]), [True]]))
            stays = np.zeros(len(key), bool)
            for i, to in zip(edge.tolist(), edge[1:].tolist()):
                if not (label[i:to] == label[i]).all():
                    cost = _costs(n[i:to], label[i:to], side[i:to] if (side[i:to] < 2).any() else None, _words(batch.column(6).slice(i, to - i).to_pylist()), percent)
                    stays[i:to] = (cost < _NEVER).any(axis=1)
            yield batch.select(list(range(6))).filter(pa.array(stays))

    dealt = rows.select("key", "sub", "n", "node", "label", "side", "bits").repartition(partitions(rows.sparkSession), "key", "sub").sortWithinPartitions("key", "sub", "n", "node")
    return dealt.mapInArrow(run, "key long, sub int, n long, node long, label long, side int")


def _sweep(rows: DataFrame, percent: int) -> DataFrame:
    """(key, a, b, more): candidate pairs of nodes with different labels, a forest of each tile, and whether it leaves others out.

    rows: (key, sub, n, node, label, side, bits); sides 0 and 1 are compared with each other only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_tiles(batches):
            key, sub, n, node, label, side = (batch.column(i).to_numpy() for i in range(6))
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]), [True]]))
            first, size = edge[:-1], np.diff(edge)
            two = first[size == 2]  # most tiles: compared all at once
            bits = batch.column(6)
            out_a, out_b, more = [], [], []
            if len(two):
                x, y = (np.frombuffer(b"".join(bits.take(pa.array(i)).to_pylist()), np.uint64).reshape(len(two), -1) for i in (two, two + 1))
                differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                good = _may_link(n[two], n[two + 1], differ, percent) & (label[two] != label[two + 1]) & ((side[two] != side[two + 1]) | (side[two] == 2))
                out_a.append(two[good]), out_b.append(two[good] + 1), more.append(np.zeros(good.sum(), bool))
            for i, m in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                to = i + m
                if (label[i:to] == label[i]).all():
                    continue
                cost = _costs(n[i:to], label[i:to], side[i:to] if (side[i:to] < 2).any() else None, _words(bits.slice(i, m).to_pylist()), percent)
                pairs = forest(cost, label[i:to])
                a, b = (np.array([p[x] for p in pairs], np.int64) for x in (0, 1))
                out_a.append(a + i), out_b.append(b + i), more.append(np.full(len(a), 2 * len(a) < np.count_nonzero(cost < _NEVER)))
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
            left = np.concatenate(more) if more else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b])), pa.array(left)], names=["key", "a", "b", "more"])

    dealt = rows.select("key", "sub", "n", "node", "label", "side", "bits").repartition(partitions(rows.sparkSession), "key", "sub").sortWithinPartitions("key", "sub", "n", "node")
    return dealt.mapInArrow(run, "key long, a long, b long, more boolean")


def _with_small(rows: DataFrame, small: DataFrame, on: str, how: str = "left") -> DataFrame:
    """A join that broadcasts `small` only after its rows are counted."""
    return rows.join(F.broadcast(small) if small.count() <= SMALL_TABLE else small, on, how)


def _first_tiles(tiles: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of the first sweep: large tiles in chunks, other chunks in each tile."""
    rows = _with_small(tiles, large, "key").withColumn("chunks", F.coalesce(F.ceil(F.col("nodes") / CHUNK), F.lit(1)))
    return rows.select("key", F.pmod(F.xxhash64("node", "key"), "chunks").cast("int").alias("sub"), "n", "node", F.col("node").alias("label"), F.lit(2).alias("side"), "bits")


def _second_tiles(tiles: DataFrame, keys: DataFrame, labels: DataFrame, arrays: DataFrame) -> DataFrame:
    """Rows of the second sweep: tiles that still hold several components. Chunks of large ones meet in pairs.

    The chunks of a tile's largest component (side 0) meet those of all others (side 1), which also meet each other
    (side 2). Its rows are repeated for each chunk of the others, and theirs for each of all chunks.
    """
    rows = _with_small(tiles.select("key", "node", "n"), keys, "key", "left_semi").join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("label"))
    weight = 1 + F.col("n") / WEIGHT  # arrays of large sets fill a chunk with fewer nodes
    counts = rows.groupBy("key", "label").agg(F.sum(weight).alias("c"))
    tile = counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    rows = rows.drop("n").join(tile, "key").withColumn("k", F.ceil(F.col("most") / CHUNK).cast("int")).withColumn("r", F.ceil((F.col("all") - F.col("most")) / CHUNK).cast("int"))
    at = lambda n: F.pmod(F.xxhash64("node", "key"), F.col(n)).cast("int")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda sub, side: F.struct(sub.cast("int").alias("sub"), F.lit(side).alias("side"))
    r, major, minor = F.col("r"), at("k"), at("r")
    places = (
        F.when(F.col("all") <= CHUNK, F.array(place(F.lit(0), 2)))
        .when(F.col("label") == F.col("major"), F.transform(to("r"), lambda j: place(major * r + j, 0)))
        .otherwise(F.concat(F.transform(to("k"), lambda i: place(i * r + minor, 1)), F.transform(to("r"), lambda j: place(-1 - (F.least(minor, j) * r + F.greatest(minor, j)), 2))))
    )
    rows = rows.select("key", "node", "label", F.explode(places).alias("at")).select("key", "node", "label", "at.sub", "at.side")
    return rows.join(arrays.select("node", "n", "bits"), "node")


def _verify(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs whose sets reach the threshold, by intersecting sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = scratch(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
    arrays = _with_small(arrays, ends, "node", "left_semi")  # only these travel
    left = arrays.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = arrays.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between nodes (node, n, keys, bits) that connect all nodes that any links connect."""
    share = docs.sparkSession.sparkContext.broadcast
    shared = share(bit_map(scratch(_repeated(nodes), "repeated"), "key", 64))
    rows = scratch(_tile_rows(nodes, shared), "tile-rows")
    shared.unpersist()
    unlike = share(bit_map(scratch(_unlike(rows), "unlike"), "key"))
    tiles = scratch(_of_keys(rows, unlike).join(nodes.select("node", "n", "bits"), ["node", "n"]), "tiles")
    unlike.unpersist()
    large = scratch(tiles.groupBy("key").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") > CHUNK), "large")
    found = scratch(_sweep(_first_tiles(tiles, large), percent), "found")
    pairs = scratch(found.select("a", "b").distinct(), "pairs")
    crowd = _with_small(tiles.select("key", "node"), large.select("key"), "key", "left_semi").select("node")
    wanted = scratch(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd).distinct(), "wanted")
    named = share(bit_map(wanted, "node"))
    arrays = scratch(_arrays(docs, k, named), "arrays")
    named.unpersist()
    sure = scratch(_verify(pairs, arrays, percent), "links")
    again = scratch(found.where("more").join(sure, ["a", "b"], "left_anti").select("key").union(large.select("key")).distinct(), "again")
    if not again.isEmpty():
        asked = scratch(_in_question(_second_tiles(tiles, again, components(sure), arrays), percent), "in-question")
        more = _exact_sweep(asked.join(arrays.select("node", "hashes"), "node"), percent)
        sure = scratch(sure.unionAll(more), "links")
    for table in (rows, tiles, found, arrays):
        discard(table)
    return sure


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`; links are exact: 100 * overlap >= percent * union."""
    full = scratch(_meta(docs, k, percent), "sets")
    nodes = scratch(full.where("n > 0").groupBy("h1", "h2").agg(F.min("doc").alias("node"), F.max("n").alias("n"), F.any_value("keys", F.lit(True)).alias("keys"), F.any_value("bits", F.lit(True)).alias("bits")), "nodes")
    meta = scratch(full.join(nodes.select("h1", "h2", "node"), ["h1", "h2"], "left").select("doc", "n", "node"), "members")
    discard(full)
    several = meta.where("n > 0").groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc")
    same = meta.where("n > 0").join(several, "doc", "left_semi").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    groups = components(links(docs, nodes, k, percent).unionAll(same))
    discard(nodes)
    out = meta.join(groups, "node", "left").select("doc", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("doc")).alias("c"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real("c").alias("component_id"))
