"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Stages but the last return the columns they were given. Each decides by its own input: what an earlier stage dropped is
in none of its counts.

A document is a row, whatever its id: rows with no id, or with one that other rows have too, pass every stage by their own
text. A null or empty text has no language and goes at the first stage; a null language or source is a group of its own.
Rows that are alike in all columns are judged alike, and one of them stays as near duplicates go. Very long texts are
read whole by each stage. An empty table gives no rows. Other columns may have any names: what a stage adds for itself has a
name that its documents do not have. Where no document has a language to learn from, none is rejected for its language.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import language, packing, quality, secrets, similarity
from sievelake.llm.common import documents, fresh, small_batches, written

#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is not told, go. With no labelled document to learn from there is no verdict, and all stay."""
    small_batches(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = language.train(docs, path, "doc_id", "text", "lang", ~language.held_out())
    if not model:
        return docs
    found = fresh(docs, "found")
    judged = docs.withColumn(found, language.identify(docs, model, path))
    return judged.where((F.col(found)["lang_pred"] != "und") & (F.col(found)["score"] >= LEAST_SCORE)).drop(found)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    small_batches(spark)
    return quality.kept_rows(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays, the one with the least id, null ids last. Classes are of texts: different texts of one id both stay, documents without an id take part, and those without words are linked with nothing, so all stay."""
    small_batches(spark)
    return similarity.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, and n_chars follows the text."""
    small_batches(spark)
    clean = docs.withColumn("text", secrets.redact(docs, "text"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, and the sequences that hold them."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: SQL can express neither trained models nor the packing; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
