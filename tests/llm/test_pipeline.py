"""Every stage of the pipeline on its own input, against brute force."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from plumbline.llm import decontaminate  # noqa: E402

from .test_dedup import brute_lines  # noqa: E402
from .test_operators import _check_packing, brute_groups  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, out := spark.read.parquet(str(tmp_path / name)))
        docs = out
    names = [n for n, _ in corpus_pipeline.STAGES]
    for n in names[:-1]:
        assert kept[n][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = kept["language_id"]
    assert after.count() >= 0.97 * before.where("text rlike '[a-z]'").count() and after.join(before, "doc_id", "left_anti").count() == 0
    before, after = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in kept["line_dedup"])
    import hashlib

    want = {(d, h) for d, _, _, h in brute_lines(before)}
    assert {(d, hashlib.sha256(x.encode()).hexdigest()) for d, x in after} == want
    before, after = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in kept["jaccard_join"])
    assert {d for d, _ in after} == {d for d, _, c in brute_groups(before, 5, 80) if d == c}
    before, after = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in kept["decontaminate"])
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, x in before if any(i in decontaminate.normalise(x) for i in items)}
    assert not leaked & {d for d, _ in after} and len(after) >= len(before) - len(leaked) - 2
    before, after = kept["best_fit_packing"]
    _check_packing(after.collect(), [(r["doc_id"], r["text"]) for r in before.collect()])


def test_documents_without_a_leading_language_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    words = {}
    for r in docs.where("text is not null").collect():
        words.setdefault(r["lang"], []).extend(w for w in r["text"].split() if w.isalpha())
    three = sorted(words)[:3]
    even = " ".join(" ".join(words[lang][:384]) for lang in three)  # whole sequences of each
    mostly = " ".join(words[three[0]][:640]) + " " + " ".join(words[three[1]][:128])
    more = spark.createDataFrame([(-5, even, three[0], "s", len(even)), (-6, mostly, three[0], "s", len(mostly))], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionAll(more), SF).select("doc_id").collect()}
    assert -5 not in kept and -6 in kept


def test_stages_take_awkward_rows(spark):
    """Null ids, texts and languages, empty and very long texts, repeated rows, other columns, no rows at all."""
    long = " ".join(f"word{(i * i) % 911}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the cat and the dog of that house with the garden", "en", None, 9), (4, long, "en", "s", 1), (5, "the same short text of the house", "en", "s", 1), (5, "the same short text of the house", "en", "s", 1), (5, "another text of that man", "en", "s", 1), (6, "12345 !!", "en", "s", 1)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.selectExpr("*", "1 as node", "2 as _lead", "3 as score", "4 as contaminated", "5 as _key", "6 as piece")
    by = dict(corpus_pipeline.STAGES)
    out = {name: [(r["doc_id"], r["text"]) for r in by[name](spark, docs, SF).collect()] for name in list(by)[:-1]}
    texts = [(r[0], r[1]) for r in rows]
    assert sorted(out["line_dedup"], key=repr) == sorted(((d, x or "") for d, x in texts), key=repr)
    assert sorted(out["jaccard_join"], key=repr) == sorted(set(texts), key=repr)
    assert sorted(out["decontaminate"], key=repr) == sorted(texts, key=repr)
    _check_packing(by["best_fit_packing"](spark, docs, SF).collect(), texts)
    known = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    stay = by["language_id"](spark, known.unionAll(plain), SF).where("doc_id is null or doc_id < 7").collect()
    assert all(r["text"] not in (None, "", "12345 !!") for r in stay) and any(r["doc_id"] is None for r in stay)
    for name, stage in by.items():
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "best_fit_packing"]
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
