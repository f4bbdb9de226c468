"""A training-data pipeline over `documents`: five stages, each one of the operators in plumbline.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents; other columns of the input are left out.

Nulls: a null or empty text has no language and goes in the first stage; a stage given one by itself keeps it, a text
without words being linked with nothing and holding no item, and packs it as a sequence of one separator. Null ids
are kept and sort below all others. Rows that repeat stay, but for those that repeat the id and the text of a document
that stands for its group of near copies. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard, language, lines, packing
from plumbline.llm.common import id_key, scratch, share_path, table
from plumbline.llm.queries import _tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No single language has this share of a rejected document's words.
LEAST_SHARE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, null text) or without any leading one go."""
    share_path(spark)
    model = language.train(docs, ~language.held_out())
    predicted = language.predict(docs.select(*COLUMNS), model)
    return predicted.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them."""
    share_path(spark)
    kept = lines.dedup_lines(docs.select(*COLUMNS), text_out="text")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: the one with the smallest id.

    Rows with that id and other texts stay beside it; of those with the same text one does.
    """
    share_path(spark)
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"))
    leads = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(id_key("doc_id").alias("_lead")).distinct()
    docs = docs.select(*COLUMNS)
    kept = docs.join(leads, id_key("doc_id") == F.col("_lead"), "left_semi")
    twice = scratch(docs.groupBy(id_key("doc_id").alias("_twice")).count().where("count > 1").select("_twice"), "repeated-ids")
    if twice.isEmpty():
        return kept
    repeated = id_key("doc_id") == F.col("_twice")
    return kept.join(twice, repeated, "left_anti").unionAll(kept.join(twice, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.find(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece, with its place."""
    share_path(spark)
    return packing.best_fit(docs, _tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_near),
    ("decontaminate", decontaminate_benchmark),
    ("best_fit_packing", pack_sequences),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch(docs, name)
    return docs
