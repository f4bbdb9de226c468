"""Quality rules whose cut-offs come from the corpus, in DataFrame functions only.

Each document is measured once. Its ratios, as integers, go to log-linear histogram sketches by language and
source: counts by bucket, where a bucket keeps the value's leading bits (relative error 1/32). Sketches merge by
adding counts into those of a language and of the corpus. A group's fences lie around its median, as many spreads
away as the metric's reach; the spread is the way from the median to a quantile that tells something about the
metric: the quartiles of symbols and word length, where junk may fill the tail; the 99th percentile of repeats, which
most texts have none of. A group of n documents takes n parts of its own quantiles and PRIOR parts of its language's, that
likewise of the corpus's, so fences change smoothly with a group's size. They are joined to the documents; the join is
salted, as one source may hold a third of them.

Nulls: a null text has no words and fails; null languages and sources are groups of their own. Rows that repeat
are measured each. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WS, scratch

#: Leading bits that a sketch bucket keeps.
BITS = 6
#: A group's quantiles count as its documents, those of the group above it as so many.
PRIOR = 20
#: Ways in which the documents of one group are dealt in the join.
SALTS = 32
#: By ratio: percentile whose way from the median is the spread, reach in spreads, least spread (in the ratio's integer
#: unit, for groups in which nearly all documents are alike), whether there is a lower fence too.
METRICS = {"symbols": (75, 8, 5, False), "dup_lines": (99, 3, 5, False), "repeats": (99, 3, 5, False), "word_length": (75, 12, 5, True)}


def _let(value: Column, use) -> Column:
    """Evaluate `value` once and hand it to `use`."""
    return F.transform(F.array(value), use)[0]


def _repeats(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), p + 3) - p))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        hit = F.transform(s, lambda e, i: F.when((F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["p"]))
        return _let(F.array_sort(F.array_compact(hit)), covered)

    ranked = lambda h: _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), twice)
    some = _let(grams, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(ranked(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeats(w).cast("long").alias("n_repeat_words")))
    out = docs.select("doc_id", "lang", "source", of_words.alias("_w"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(lines).cast("long").alias("n_lines"))
    out = out.select("doc_id", "lang", "source", "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words", "n_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ratios() -> Column:
    """By metric, in the order of METRICS: per mille of the words or lines, or hundredths of a character."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    whole = lambda n, d: F.floor(n / d)
    return F.array(whole(1000 * F.col("n_symbols"), words), whole(1000 * F.col("n_dup_lines"), lines), whole(1000 * F.col("n_repeat_words"), words), whole(100 * F.col("word_chars"), words))


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): mergeable sketches of the documents that pass the base rules."""
    ratio = measured.where(~F.col("base_failed")).select("lang", "source", F.posexplode(_ratios()).alias("metric", "v"))
    low_bits = f"greatest(length(bin(v)) - {BITS}, 0)"
    bucket = F.expr(f"shiftleft(shiftright(v, {low_bits}), {low_bits})")
    return ratio.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _quantiles(keyed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, metric, total, q0, q1, q2): lower percentile, median and upper percentile of merged sketches."""
    merged = keyed.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))  # merging is adding counts
    sums = merged.groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("total"))
    upper = "case metric " + " ".join(f"when {k} then {m[0]}" for k, m in enumerate(METRICS.values())) + " end"
    at = lambda p: F.expr(f"aggregate(b, named_struct('c', 0L, 'v', cast(null as bigint)), (a, x) -> named_struct('c', a.c + x.n, 'v', coalesce(a.v, if(100 * (a.c + x.n) >= ({p}) * total, x.bucket, null)))).v")
    return sums.select(*keys, "metric", "total", at(f"100 - ({upper})").alias("q0"), at("50").alias("q1"), at(upper).alias("q2"))


def fences(sketches: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, low, high): arrays by metric, from the group's quantiles drawn towards its language's and the corpus's."""
    keyed = sketches.select(F.struct("lang").alias("l"), F.struct("source").alias("s"), "lang", "source", "metric", "bucket", "n").withColumns({"l": F.to_json("l"), "s": F.to_json("s")})
    own, lang, everything = (_quantiles(keyed, keys) for keys in (("l", "s"), ("l",), ()))
    names = ("total", "q0", "q1", "q2")
    lang = lang.withColumnsRenamed({n: f"{n}b" for n in names})
    everything = everything.withColumnsRenamed({n: f"{n}c" for n in names})
    j = own.join(lang, ["l", "metric"]).join(F.broadcast(everything), "metric")  # a row for each metric
    drawn = lambda n, q, above: F.floor((F.col(n).cast("double") * F.col(q) + F.lit(float(prior)) * above) / (F.col(n) + F.lit(float(prior))))
    for q in names[1:]:
        j = j.withColumn(q, drawn("total", q, drawn("totalb", f"{q}b", F.col(f"{q}c"))))
    of = lambda i: F.expr("case metric " + " ".join(f"when {k} then {m[i]}" for k, m in enumerate(METRICS.values())) + " end")
    width = lambda spread: of(1) * F.greatest(spread, of(2))
    low = F.when(of(3), F.col("q1") - width(F.col("q1") - F.col("q0"))).otherwise(F.lit(-1))
    j = j.select("l", "s", "metric", low.cast("long").alias("low"), (F.col("q1") + width(F.col("q2") - F.col("q1"))).cast("long").alias("high"))
    by = j.groupBy("l", "s").agg(F.sort_array(F.collect_list(F.struct("metric", "low", "high"))).alias("f"))
    groups = keyed.select("l", "s", "lang", "source").distinct()
    return groups.join(by, ["l", "s"]).select("lang", "source", F.col("f.low").alias("low"), F.col("f.high").alias("high"))


def judge(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The measures with base_failed and kept."""
    measured = scratch(measure(docs), "quality")
    limits = fences(sketch(measured), prior).withColumnsRenamed({"lang": "_l", "source": "_s"}).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    j = salted.join(limits, salted["lang"].eqNullSafe(limits["_l"]) & salted["source"].eqNullSafe(limits["_s"]) & (salted["_salt"] == limits["_salt"]), "left")
    inside = F.coalesce(F.forall(F.zip_with(_ratios(), F.zip_with("low", "high", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda v, f: (v >= f["a"]) & (v <= f["b"])), lambda x: x), F.lit(True))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"))
