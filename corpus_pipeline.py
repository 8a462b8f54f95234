"""The corpus pipeline: five stages over ``documents``, each over all that the one before it kept.

Quality rules (rejected documents go; lines above the limits are removed from the others), SimHash
near-duplicates (of each component the document of the smallest id stays), benchmark decontamination
(words inside occurrences of benchmark windows are removed; a document of which nothing else is left
goes), personal data (spans become their kind in angle brackets) and best-fit packing (a row per piece).
``n_chars`` follows the text. Nulls, ties, repeated rows and empty tables are as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontamination, packing, pii, quality, simhash
from brindle.llm.common import settle, table

#: SQL cannot express the tokenizer, the field or the index; tests/llm hold the stages to brute force.
ORACLE_SQL = None

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The columns of documents, with a new text."""
    return docs.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(quality.quality_rules(docs.select(*COLUMNS)).where("q_kept"), F.col("q_clean_text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return _with_text(found.where((F.col("d_n_hit") == 0) | (F.col("d_n_hit") < F.col("d_n_words"))), F.col("d_clean_text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return _with_text(pii.find_pii(docs, pii.train(docs)), F.col("p_redacted"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select(*COLUMNS))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
