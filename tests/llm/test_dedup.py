"""Line and substring deduplication against brute force on small tables."""

import hashlib
import re
from collections import defaultdict

import pytest

from plumbline.llm import lines, substrings

WS = r"[\x20\x09-\x0D]"


def brute_lines(rows, least=20, docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(rf"^{WS}+|{WS}+$", "", x))
    held = defaultdict(set)
    for i, (_, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    out = []
    for i, (d, t) in enumerate(rows):
        own = (t or "").split("\n")
        low = lambda x: -(2**63) if x is None else x
        kept = [x for x in own if len(key(x)) < least or len(held[key(x)]) < docs or low(d) == max(low(rows[j][0]) for j in held[key(x)])]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_windows(rows, size=20):
    first = {}
    low = lambda x: -(2**63) if x is None else x
    words = [(low(d), d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for k, _, w in words:
        for i in range(len(w) - size + 1):
            s = tuple(w[i : i + size])
            first[s] = min(first.get(s, (k, i)), (k, i))
    out = []
    for k, d, w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (k, i):
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


P = " ".join(f"w{i}" for i in range(45))
ROWS = [
    (1, f"a shared line of some length\nx\n {P} "),
    (2, "  A SHARED line of some LENGTH\x0b\n\n" + P + " tail"),
    (3, "a shared line of some length\nown line that is quite long"),
    (4, None), (5, ""), (6, "é" * 20 + "\nÉé short"), (7, "é" * 20), (8, "É" * 19 + "é\n" + "é" * 20),
    (9, " ".join(["again"] * 70)), (10, f"z {P}\t{P}\x1c{P}"), (None, f"{P}\na shared line of some length"),
    (11, P), (11, P), (12, "n" * 30000 + "\n" + " ".join(f"v{i % 50}" for i in range(4000))),
]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_small(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as doc", "1 as shard", "2 as n_lines", "3 as tag", "4 as _key", "5 as _tag", "6 as _lost", "7 as _gone", "8 as _doc", "9 as _mark")
    got = lines.dedup_lines(df)
    assert {"shard", "tag", "text", "kept_text"} <= set(got.columns)
    own = ["_key", "_tag", "_lost", "_gone", "_doc", "_mark"]
    for out in (got, substrings.dedup_substrings(df)):
        assert {tuple(r) for r in out.select(*own).collect()} <= {(4, 5, 6, 7, 8, 9)}
    assert sorted([tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()], key=repr) == brute_lines(rows)
    got = substrings.dedup_substrings(df).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_windows(rows)


def test_full_bucket_counts_the_rest_exactly(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    spans = substrings.repeated_words(df, memory_windows=0)
    want = substrings.repeated_words(df)
    cover = lambda x: {(r["doc"], i) for r in x.collect() for i in range(r["start"], r["start"] + r["n"])}
    assert cover(spans) == cover(want)


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in lines.dedup_lines(df, text_out="text").select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()], key=repr) == brute_lines(rows)
    got = substrings.dedup_substrings(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_windows(rows)


def test_perfect_hash_has_one_slot_each():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 2**64, 20_000, np.uint64)
    levels, slot = lines.build(h)
    assert sorted(slot) == list(range(len(h)))
    assert (lines.look_up(levels, [np.cumsum(x) - 1 for x in levels], h) == slot).all()


def test_overlaps_are_exact():
    import numpy as np

    from plumbline.llm import jaccard

    rng = np.random.default_rng(3)
    for m, universe in ((2, 30), (9, 200), (120, 400), (60, 100_000)):
        sets = [np.unique(np.concatenate([rng.integers(0, universe, rng.integers(0, 80)), np.arange(15)])).astype(np.uint64) for _ in range(m)]
        sets[0] = np.zeros(0, np.uint64)
        assert (jaccard.overlaps(sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


def test_a_group_just_below_the_threshold_sends_no_pairs(spark, monkeypatch):
    """Texts of 200 shingles, 183 in all of them, link with nobody; two of them link with a near copy each."""
    from plumbline.llm import jaccard

    common = " ".join(f"c{i}" for i in range(186))
    rows = [(i, f"{common} " + " ".join(f"u{i}x{j}" for j in range(17))) for i in range(400)]
    rows += [(1000, rows[7][1] + " more"), (1001, rows[300][1] + " other words")]
    seen = []
    real = jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85).collect()}
    assert got == {**{i: i for i in range(400)}, 1000: 7, 1001: 300}
    assert sum(seen) < 8 * len(rows)  # a forest of each tile, not its pairs
