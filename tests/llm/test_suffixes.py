"""Byte-exact deduplication against brute force."""

import hashlib
import random

import pytest

from plumbline.llm import queries, suffixes

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows, size):
    seen, out = {}, []
    raw = [(t or "").encode() for _, t in rows]
    for x in raw:
        for i in range(len(x) - size + 1):
            seen[x[i : i + size]] = seen.get(x[i : i + size], 0) + 1
    for (d, _), x in zip(rows, raw):
        away = [False] * len(x)
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] > 1:
                away[i : i + size] = [True] * size
        kept = bytes(b for b, a in zip(x, away) if not a)
        runs = sum(a and not (i and away[i - 1]) for i, a in enumerate(away))
        out.append((d, len(x), sum(away), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, size):
    rng = random.Random(seed)
    new = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [new(size + d) for d in (-1, 0, 1, 2, 7, size, 3 * size)]
    texts = [None, "", "x", shared[1], shared[1], "ab" * size, "a" * (size - 1), "a" * (2 * size), "abc" * size]
    for _ in range(60):
        own = new(rng.randint(0, size))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            if rng.random() < 0.4:  # one character differs
                i = rng.randrange(len(s))
                s = s[:i] + "Z" + s[i + 1 :]
            own += s + new(rng.choice([0, 0, 1, 5]))
        texts.append(own)
    texts += texts[20:24]
    return [(None if i % 11 == 5 else i // 2, t) for i, t in enumerate(texts)] + [(500, "y"), (500, "y")]


@pytest.mark.parametrize("size,piece,chunk,parts", [(40, 1 << 16, 1 << 22, 5), (49, 30, 200, 1), (40, 7, 64, 9)])
def test_against_brute_force(spark, monkeypatch, size, piece, chunk, parts):
    monkeypatch.setattr(suffixes, "PIECE", piece)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rows = corpus(size + piece, size)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as N_BYTES", "2 as key", "3 as tag", "4 as _key", "5 as _k", "6 as piece").repartition(parts)
    got = suffixes.dedup_bytes(df, size)
    assert {tuple(r) for r in got.select("key", "tag", "_key", "_k", "piece").collect()} == {(2, 3, 4, 5, 6)} and "N_BYTES" not in got.columns
    assert sorted([tuple(r) for r in got.select(*COLUMNS).collect()], key=repr) == brute(rows, size)


@pytest.mark.parametrize("size", [40, 400])
def test_the_sort_alone(spark, size):
    """All starts of all texts, without the collapses before it."""
    rows = [t for _, t in corpus(size, size) if t and len(t.encode()) >= size]
    pieces = [(i, bytearray(t.encode()), [(0, len(t.encode()) - size + 1)]) for i, t in enumerate(rows)]
    df = spark.createDataFrame(pieces, f"piece long, text binary, {suffixes._WINDOWS}").repartition(6)
    got = {tuple(r) for r in suffixes.repeated_starts(df, size).collect()}
    seen = {}
    for i, t, _ in pieces:
        for at in range(len(t) - size + 1):
            seen.setdefault(bytes(t[at : at + size]), []).append((i, at))
    assert got == {x for own in seen.values() if len(own) > 1 for x in own}


def test_empty(spark):
    for rows in ([], [(1, None), (2, "short")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted([tuple(r) for r in suffixes.dedup_bytes(df).select(*COLUMNS).collect()], key=repr) == brute(rows, 400)


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 400)
    assert sum(x[2] > 0 for x in want) > 5
    assert sorted([tuple(r) for r in queries.op13_suffix_dedup(spark, SF).select(*COLUMNS).collect()], key=repr) == want


def test_only_repeated_names_are_written(spark, monkeypatch):
    """Rows that occur once are not written for the next step, but for those at the edges of ranges, which may go on in the next one."""
    written = []
    monkeypatch.setattr(suffixes, "scratch", lambda df, name: written.append(df.localCheckpoint()) or written[-1])
    rows = [(i % 7 if i % 10 == 0 else 1000 + i, i, i) for i in range(5000)] + [(3, 9000, 1), (-5, 9001, 1), (-5, 9002, 1)]
    got = suffixes._ranked(spark.createDataFrame(rows, "k1 long, piece long, at int").repartition(5), ["k1"], "x").collect()
    keys = [k for k, _, _ in rows]
    assert sorted((r.piece, r["at"]) for r in got) == sorted((p, a) for k, p, a in rows if keys.count(k) > 1)
    order = {k: n for n, k in enumerate(sorted(set(keys)))}
    assert all(r.name == order[k] for r in got for k, p, _ in rows if p == r.piece)
    ranges = suffixes.partitions(spark)
    assert written[0].count() <= len(got) + ranges * 8
