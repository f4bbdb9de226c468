"""Phrase mining against brute force and SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from plumbline.llm import oracles, phrases, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + n])) for n in range(1, 6) for i in range(len(w) - n + 1))
    good = {k: v for k, v in counts.items() if v >= least}
    covered = Counter()
    for (lang, w), v in good.items():
        for z in range(2, len(w)):
            for i in range(len(w) - z + 1):
                covered[lang, w[i : i + z]] = max(v, covered[lang, w[i : i + z]])
    out = []
    for lang in totals:
        own = []
        for (x, w), a in good.items():
            if x == lang and len(w) > 1 and covered[lang, w] < a:
                score, _, left, right = min((1000 * a * totals[lang] // (good[lang, w[:k]] * good[lang, w[k:]]), k, good[lang, w[:k]], good[lang, w[k:]]) for k in range(1, len(w)))
                own.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"W{i}é" if i % 5 else f"w{i}" for i in range(60)]
    fixed = ["alpha Beta gamma delta epsilon", "new  york\tcity", "x y x y x y"]
    texts = []
    for _ in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            own.insert(rng.randint(0, len(own)), rng.choice(fixed))
        texts.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", " ", ", ", "\n", ".", "\x0b", "\x85 "]) for w in own)))
    return texts + [("en", None), (None, ""), ("fr", " \n."), ("en", "q " * 3000), ("en", "q " * 3000), ("de", "." * 5000 + "z" * 30000)]


@pytest.mark.parametrize("least,top,held,chunk", [(5, 2000, 1 << 22, 1 << 22), (3, 7, 50, 300)])
def test_against_brute_force(spark, monkeypatch, least, top, held, chunk):
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = corpus(least)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as doc_id", "2 as phrase", "3 as f").repartition(4)
    got = phrases.collocations(df, least, top)
    assert got.columns == COLUMNS
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows, least, top)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(2)
    for _ in range(20):
        threshold = int(rng.integers(3, 60))
        items = np.minimum(rng.zipf(1.3, 6000), 10**6).astype(np.uint64)
        summary, true = phrases.Summary(len(items) // threshold + 1), Counter(items.tolist())  # without slack
        for part in np.array_split(items, 17):
            h, c = np.unique(part, return_counts=True)
            summary.merge([(h, c.astype(np.int64))])
            assert len(summary.h) <= summary.capacity
        assert summary.lost < threshold
        assert {x for x, n in true.items() if n >= threshold} <= set(summary.survivors(threshold).tolist())
        assert all(true[x] - summary.lost <= n <= true[x] for x, n in zip(summary.h.tolist(), summary.c.tolist()))


def test_table_against_sql(spark):
    own = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{own}/documents.parquet'")
    want = con.sql(oracles.OP11)
    rows = sorted(map(repr, con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({oracles.OP11})").fetchall()))
    assert sorted(want.columns) == sorted(COLUMNS) and len(rows) > 50
    assert sorted(repr(tuple(r)) for r in queries.op11_phrase_mining(spark, own).select(*COLUMNS).collect()) == rows
