"""Tokenizer alignment against a token-by-token brute force."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from plumbline.llm import align, queries
from plumbline.llm.bpe import _byte_of

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    (1, "plain words, and plain words again"), (2, None), (3, ""), (4, "é 漢字 😀b <0xE6> <s> \tq"), (5, "holds ▁ itself"), (6, "<|endoftext|></s><unk>"),
    (7, " "), (7, "\n\n  two  blanks "), (None, "a null id"), (8, "nul \x00 byte and ﻿ mark, é combining, \U0001f1e9\U0001f1ea"), (9, "x" * 5000 + " ü" * 3000), (1, "plain words, and plain words again"),
    (10, "".join(chr(c) for c in range(0x2580, 0x2600))), (11, "ﬁ ½ １２ Ａ"), (12, "नमस्ते 안녕 привет"),
]


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of, words = _byte_of(), {i: t for t, i in json.load(open(A))["model"]["vocab"].items()}
    per, counts = [], Counter()
    for d, text in rows:
        groups, links = [], []
        if text:
            raw = (" " + text).encode()
            own = [(i, bytes(byte_of[c] for c in words[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
            other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if b"".join(x for _, x in own) == raw == b"".join(x for _, x in other):
                ends = [{}, {}]
                for k, tokens in enumerate((own, other)):
                    at = 0
                    for n, (i, x) in enumerate(tokens):
                        at += len(x)
                        ends[k][at] = n
                since = (0, 0)
                for at in sorted(ends[0].keys() & ends[1].keys()):
                    i, j = ends[0][at] + 1, ends[1][at] + 1
                    groups.append(",".join(str(x) for x, _ in own[since[0] : i]) + "|" + ",".join(str(x) for x, _ in other[since[1] : j]))
                    links.append((own[i - 1][0], other[j - 1][0]))
                    since = i, j
                counts.update(links)
                per.append((d, len(own), len(other), groups, links))
                continue
        per.append((d, 0, 0, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return sorted(((d, n, m, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n, m, g, k in per), key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_awkward_texts_both_ways(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "5 as N_A", "6 as links", "7 as _links", "8 as _row", "9 as code")
    want = brute(TEXTS)
    assert sum(x[1] > 0 for x in want) >= 10
    for most in (align.BROADCAST_PAIRS, 0):  # sent to every task, or joined
        got = align.align(df, A, B, most)
        assert {tuple(r) for r in got.select("links", "_links", "_row", "code").collect()} == {(6, 7, 8, 9)} and "N_A" not in got.columns
        assert sorted([tuple(r) for r in got.select(*COLUMNS).collect()], key=repr) == want
    assert align.align(df.limit(0), A, B).count() == 0


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_tokenizer_alignment(spark, SF)
    assert got.columns == COLUMNS[:5] + ["n_best", "count_sum", "groups_sha256"]
    assert sorted([tuple(r) for r in got.select(*COLUMNS).collect()], key=repr) == brute(rows)


def test_coarse_cuts_are_refined():
    both = align.Both(A, B)
    odd = ["naïve façade 漢字 x\u3000 y", "ŵ ŷ\u00a0z \u00a0é", "é  é\né \té 😀😀 ñañ", "\u2003ü ü\u2003 ü ü", "ð" * 50 + " ð ð"]
    for text in odd:
        ids, ends = both.tokens(text)[:2]
        assert ids.tolist() == both.a.encode(" " + text, add_special_tokens=False).ids
    for text in [*odd, *(t for _, t in TEXTS if t)]:
        found = both.tokens(text)
        if found is not None:
            raw = (" " + text).encode()
            for ids, ends, words in ((found[0], found[1], both.a_bytes), (found[2], found[3], both.b_bytes)):
                start = 0
                for i, end in zip(ids.tolist(), ends.tolist()):
                    assert raw[start:end] == words[i]
                    start = end
                assert start == len(raw)


def test_coarse_cuts_give_the_ends():
    """The libraries' spans count: characters' ends come from them, decoded sizes only fill up between two of them."""
    spans = np.array([(0, 4), (1, 4), (4, 6), (6, 6), (6, 6), (6, 9), (9, 11)])  # two tokens share a character (A), two have an empty span (B)
    assert align.refine(spans, np.array([3, 1, 2, 1, 1, 1, 2])).tolist() == [3, 4, 6, 7, 8, 9, 11]
    assert align.refine(spans, np.array([3, 1, 9, 1, 1, 9, 9])).tolist() == [3, 4, 6, 7, 8, 9, 11]  # a cut of the library is kept


def test_words_as_in_whole_texts():
    """Words encoded many at once, remembered or not, give what the whole text's tokens give."""
    both = align.Both(A, B)
    assert both.by_word
    rng = random.Random(3)
    pool = [" ", " ", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", " ", "　", "\x1c", "\x00", "'s", "The", "foo.", "é", "ñañ", "漢字", "😀", "▁", "<s>", "<|endoftext|>", "1", "!!", "́", "a" * 70]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(300)] + [t for _, t in TEXTS if t]
    whole = []
    for text in texts:
        found = both.tokens(text)
        if found is not None:
            assert np.array_equal(found[1], np.cumsum(both.a_size[found[0]])) and np.array_equal(found[3], np.cumsum(both.b_size[found[2]]))
            at_a, at_b, marks = both.groups(*found)
            found = b"".join(marks), (found[2][at_b] << 32 | found[0][at_a]).tobytes(), (len(found[0]) << 32) + len(found[2])
        whole.append(found)
    assert any(x is None for x in whole) and sum(x is not None for x in whole) > 150
    for many in (1, 50, 400, 400):
        got = [x for i in range(0, len(texts), many) for x in both.encode(texts[i : i + many])]
        assert [None if x is None else (b"".join(w[0] for w in x), b"".join(w[1] for w in x), sum(w[2] for w in x)) for x in got] == whole
    both.by_word = False
    assert [None if x is None else x[0] for x in both.encode(texts)] == whole
