"""Alignment of two tokenizers' tokens over the same bytes: byte-level BPE (A, `tokenizers`) and pieces with byte fallback (B, `sentencepiece`).

Texts are encoded by both with one blank in front. Both libraries are asked for the spans of all tokens (A: character offsets; B: byte
spans). These are the coarse cuts: a span that is not empty and that the next one does not overlap ends at a character's end. Tokens that end
inside a character share its span in A and have an empty one in B, so between two coarse cuts the ends are refined by the tokens'
decoded bytes. In words of ASCII every byte is a character and no token can end inside one: their tokens' bytes are the spans, A's ids come from
the faster encoder of `bpe`. Offsets at which a token of A and one of B both end cut the tokens into groups; the two tokens that end there
are linked. The corpus's links are counted by pair of ids, and every document's links are looked up in those counts.

A blank or line feed behind a character that is no white space always starts a token of both (A's words start there, and no piece of B has a
blank behind another character or a line feed beside one; `Both` looks that up), so texts are cut there and each word of a portion is encoded once, many in
one call. Words that come again are remembered, up to WORDS. With other tokenizers texts are encoded whole, with spans.

Documents are encoded once; their links are kept as packed ids in the shared folder and read twice. The counts have a row
for each pair of ids seen: up to BROADCAST_PAIRS of them are sent to every task, more are joined.

Nulls: a null or empty text has no tokens, nor has one whose tokens' bytes do not give the text back (B cannot say
U+2581 itself): all counts are 0 and the groups are ''. Rows that repeat count each. A null doc_id is an id like any other.
Extra columns pass through; an input column named like a result column, in any case, gives way to it. Empty tables give
no rows. A text is handled whole, by one task.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bpe import Encoder, _byte_of
from plumbline.llm.common import carried, scratch, slices, spare

#: Pairs of ids (20 bytes each) that are sent to every task; more of them are joined instead.
BROADCAST_PAIRS = 2_000_000
#: Words that a worker remembers, their characters at most, and those encoded in one call.
WORDS, LONGEST, CALL = 80_000, 64, 1024
#: Bytes of texts or links handled at a time.
CHUNK = 1 << 20
_CUT = re.compile(r"(?<=\S)(?=\n| [\s\S])")
_WIDE = re.compile(r"\s[ \n]| $")  # where _CUT and a plain cut before each blank and line feed differ
#: Of a word: its groups as text (each with a mark behind), its links, and its tokens of A times 2**32 and of B.
Word = tuple[bytes, bytes, int]


class Both:
    """The two tokenizers, with the bytes of every token."""

    def __init__(self, tokenizer: str, model: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(tokenizer)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        getattr(self.a.model, "_resize_cache", int)(0)  # what is worth remembering is in `known`
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        self.known: dict[str, Word | None] = {}
        self.met = bytearray(1 << 22)  # hashes of words that were encoded before
        byte_of = _byte_of()
        words = {i: t.encode() for t, i in ((x["content"], x["id"]) for x in spec.get("added_tokens", []))}
        words |= {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in words}
        self.a_bytes = [words.get(i, b"") for i in range(max(words) + 1)]
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(n))]
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.by_word = _byte_level(spec) and _identity(model) and not any(re.search("[^▁]▁", p) or ("\n" in p and p != "\n") for p in pieces)
        self.fast = Encoder(tokenizer, literal_specials=True).whole if self.by_word else None
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # "a1,a2|b1;": every id with either of the marks that may follow it
        self.marked = [f"{i}{m}".encode() for m in ",|" for i in range(len(words))] + [f"{i}{m}".encode() for m in ",;" for i in range(n)]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of A's and of B's tokens of blank + text; None where their bytes differ from it."""
        spaced = " " + text
        raw = spaced.encode()
        if self.by_word and text.isascii():
            a, b = np.array(self.fast(spaced), np.int64), self.b.encode(text, return_type="numpy").astype(np.int64)
            if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
                return None
            return a, np.cumsum(self.a_size[a]), b, np.cumsum(self.b_size[b])
        own, other = self.a.encode(spaced, add_special_tokens=False), self.b.encode(text, return_type="offset_mapping", return_bytes=True)
        a_ids, b_ids = own.ids, other["ids"]
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw:
            return None
        a_span = np.fromiter(chain.from_iterable(own.offsets), np.int64, 2 * len(a_ids))
        if len(raw) != len(spaced):
            a_span = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))[a_span]
        b_span = np.fromiter(chain.from_iterable(other["offsets"]), np.int64, 2 * len(b_ids)) + 1
        b_span[0] = 0  # the blank that B adds itself
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        return a, refine(a_span.reshape(-1, 2), self.a_size[a]), b, refine(b_span.reshape(-1, 2), self.b_size[b])

    def split(self, text: str) -> list[str]:
        """Blank + text cut into words."""
        spaced = " " + text
        if not self.by_word:
            return [spaced]
        if "\0" in text or _WIDE.search(spaced):
            return _CUT.split(spaced)
        return spaced.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]

    def encode(self, texts: list[str]) -> list[list[Word] | None]:
        """The words of each text; None for a text whose tokens' bytes differ from it."""
        gc.disable()  # else it looks through all words, which hold no cycles, again and again
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[list[Word] | None]:
        known, cut = self.known, [self.split(t) for t in texts]
        new = Counter(filterfalse(known.__contains__, chain.from_iterable(cut)))
        last = [w for w in new if not self.by_word or w[-1].isspace()]  # only at the end of a text: no other can follow it
        rest = [w for w in new if self.by_word and not w[-1].isspace()]
        kinds = [w for w in rest if w.isascii()], [w for w in rest if not w.isascii()]
        for some in [*([w] for w in last), *(kind[i : i + CALL] for kind in kinds for i in range(0, len(kind), CALL))]:
            known.update(zip(some, self._words(some)))
        out = [list(map(known.__getitem__, words)) for words in cut]
        full = len(known) - len(new) >= WORDS
        for w, times in new.items():
            at = hash(w) & 0x3FFFFF
            if full or not (times > 1 or self.met[at]) or len(w) > LONGEST or w[-1].isspace():
                del known[w]
                self.met[at] = 1
        if full and 3 * new.total() > sum(map(len, cut)):  # other words than those before
            known.clear()
            self.met = bytearray(len(self.met))
        return [None if None in words else words for words in out]

    def _words(self, words: list[str]) -> list[Word | None]:
        """Each word as if alone, from the tokens of all together."""
        parts = words if words[0][0] == " " else [" x", *words]  # B puts a blank before the first
        found = self.tokens("".join(parts)[1:])
        if found is not None:
            a, a_end, b, b_end = found
            at_a, at_b, marks = self.groups(a, a_end, b, b_end)
            bounds = np.cumsum([len(p.encode()) for p in parts])
            link = np.searchsorted(a_end[at_a], bounds)
        if found is None or not np.array_equal(a_end[at_a[link]], bounds):  # a word's end is an end of both
            half = len(words) // 2
            return [*self._words(words[:half]), *self._words(words[half:])] if half else [None]
        links = (b[at_b] << 32 | a[at_a]).astype("<i8").tobytes()
        out, since, n_a, n_b = [], 0, 0, 0
        for k, i, j in zip((8 * link + 8).tolist(), (at_a[link] + 1).tolist(), (at_b[link] + 1).tolist()):
            out.append((b"".join(marks[n_a + n_b : i + j]), links[since:k], ((i - n_a) << 32) + j - n_b))
            since, n_a, n_b = k, i, j
        return out[len(parts) - len(words) :]

    def groups(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places of the linked tokens in A and B, and the tokens of all groups, each with its mark, as text."""
        both = np.zeros(int(a_end[-1]) + 1, np.int8)
        both[a_end] = 1
        both[b_end] += 1
        at_a, at_b = np.flatnonzero(both[a_end] == 2), np.flatnonzero(both[b_end] == 2)
        n_a, n_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        codes = np.empty(len(a) + len(b), np.int64)
        group_a, group_b = np.repeat(np.arange(len(at_a)), n_a), np.repeat(np.arange(len(at_b)), n_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a], last_b[at_b] = 1, 1
        codes[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = a + last_a * len(self.a_bytes)
        codes[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = b + last_b * len(self.b_bytes) + 2 * len(self.a_bytes)
        return at_a, at_b, list(map(self.marked.__getitem__, codes.tolist()))


def _byte_level(spec: dict) -> bool:
    """Whether the tokenizer is byte-level BPE of words that begin at white space, without a normaliser or ordinary added tokens."""
    words, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
    return plain and spec.get("normalizer") is None and spec.get("truncation") is None and all(t["special"] for t in spec.get("added_tokens", []))


def _identity(model: str) -> bool:
    """Whether the model's normaliser changes blanks to U+2581 and nothing else."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    n = proto.normalizer_spec
    return n.name == "identity" and not n.precompiled_charsmap and not n.remove_extra_whitespaces and n.escape_whitespaces and n.add_dummy_prefix and not proto.trainer_spec.treat_whitespace_as_suffix


def refine(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse spans (start, end) and decoded sizes: a span that is not empty and that the next does not overlap gives its token's end; from there to the next such end the sizes are added up."""
    start, end = spans[:, 0], spans[:, 1]
    cut = end > start
    cut[:-1] &= start[1:] >= end[:-1]
    sums = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(cut, np.arange(len(cut)), -1))
    return np.where(last < 0, sums, end[last] + sums - sums[last])


_both: dict[tuple[str, str], Both] = {}


def both(tokenizer: str, model: str) -> Both:
    """One pair of tokenizers for each worker process."""
    if (tokenizer, model) not in _both:
        _both[tokenizer, model] = Both(tokenizer, model)
    return _both[tokenizer, model]


def _portions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut to about CHUNK bytes of a column."""
    for batch in batches:
        sizes = [x or 0 for x in pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()]
        for first, last in slices(sizes, CHUNK):
            yield batch.slice(first, last - first)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def encode(docs: DataFrame, tokenizer: str, model: str, links: str = "links") -> DataFrame:
    """`docs` with n_a, n_b, n_groups, n_links, groups_sha256 and the links packed (B's id * 2**32 + A's id, 64-bit each), null without tokens."""
    new = {**{c: T.LongType() for c in _COUNTS}, "groups_sha256": T.StringType(), links: T.BinaryType()}
    names = carried(docs, new)
    source = docs.select(*[F.col(f"`{c}`") for c in names], *([] if "text" in names else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = both(tokenizer, model)
        for batch in _portions(batches, "text"):
            out: list[list] = [[] for _ in new]
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = iter(pair.encode([t for t in texts if t]))
            for text in texts:
                words = next(found) if text else None
                if words is None:
                    row = (0, 0, 0, 0, "", None)
                else:
                    groups, codes, n = zip(*words)
                    codes, n = b"".join(codes), sum(n)
                    row = (n >> 32, n & 0xFFFFFFFF, len(codes) // 8, len(codes) // 8, hashlib.sha256(b"".join(groups)[:-1]).hexdigest(), codes)
                for column, x in zip(out, row):
                    column.append(x)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *(pa.array(x, k) for x, k in zip(out, kinds))], names=[*names, *new])

    return source.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), *(T.StructField(n, t) for n, t in new.items())]))


def _codes(blob: bytes) -> np.ndarray:
    """Links as B's id * 2**32 + A's id."""
    return np.frombuffer(blob, "<i8")


def pair_counts(encoded: DataFrame, links: str = "links") -> DataFrame:
    """(code, n, best): how often each pair of ids is linked, and whether its B id has no more frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [_codes(x) for x in batch.column(0).to_pylist() if x is not None]
            code, n = np.unique(np.concatenate(some), return_counts=True) if some else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    counts = encoded.select(F.col(f"`{links}`")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = scratch(counts, "pair-counts")
    most = counts.groupBy(F.shiftright("code", 32).alias("b")).agg(F.max("n").alias("most"))
    joined = counts.join(most, F.shiftright("code", 32) == F.col("b"))
    return joined.select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, tokenizer: str, model: str, broadcast_pairs: int = BROADCAST_PAIRS, keep_text: bool = True) -> DataFrame:
    """`docs` (without its text where `keep_text` is false) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark = docs.sparkSession
    new = [*_COUNTS, "n_best", "count_sum", "groups_sha256"]
    names = carried(docs, new)
    links, row = spare(docs, "_links", "_row")
    encoded = encode(docs.select(*[F.col(f"`{c}`") for c in names], *([] if "text" in names else ["text"])), tokenizer, model, links)
    names = [c for c in names if keep_text or c != "text"]
    encoded = scratch(encoded.select(*[f"`{c}`" for c in names], *_COUNTS, "groups_sha256", f"`{links}`").withColumn(row, F.monotonically_increasing_id()), "token-links")
    counts = scratch(pair_counts(encoded, links), "pairs")
    if counts.count() <= broadcast_pairs:
        table = counts.toPandas().sort_values("code")
        shared = spark.sparkContext.broadcast((table["code"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()))
        out_names = [c for c in encoded.columns if c not in (links, row)] + ["n_best", "count_sum"]

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, n, best = shared.value
            for batch in _portions(batches, links):
                sums = [(0, 0)] * len(batch)
                for i, x in enumerate(batch.column(batch.schema.get_field_index(links)).to_pylist()):
                    if x is not None:
                        at = np.searchsorted(code, _codes(x))
                        sums[i] = int(best[at].sum()), int(n[at].sum())
                col = [batch.column(batch.schema.get_field_index(c)) for c in out_names[:-2]]
                yield pa.RecordBatch.from_arrays([*col, *(pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1))], names=out_names)

        fields = [encoded.schema[c] for c in out_names[:-2]] + [T.StructField(c, T.LongType()) for c in out_names[-2:]]
        found = encoded.drop(row).mapInArrow(look_up, T.StructType(fields))
    else:

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if x is not None:
                        code, n = np.unique(_codes(x), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), r)), pa.array(code), pa.array(n.astype(np.int64))], names=["r", "code", "times"])

        sums = encoded.select(row, links).mapInArrow(single, "r long, code long, times long").join(counts, "code")
        sums = sums.groupBy("r").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        found = encoded.drop(links).join(sums, F.col(row) == sums["r"], "left").drop(row, "r").fillna(0, ["n_best", "count_sum"])
    return found.select(*[f"`{c}`" for c in names], *new)
