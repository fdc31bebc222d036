"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes what its predecessor kept and returns rows with the columns of ``documents``; the last returns the
packed pieces. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import cotraining, ngram_join, packing, quality_rules, secret_ledger
from granary.llm.common import shared_folder, stored, table


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or an adaptive threshold go."""
    return quality_rules.filtered(docs, shared_folder(spark))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half go. The fit takes labelled rows of the whole table, junk included."""
    model = cotraining.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return cotraining.filtered(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8, the smallest doc_id stays."""
    return ngram_join.one_of_each(docs, shared_folder(spark))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return secret_ledger.without_secrets(docs, shared_folder(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(docs, shared_folder(spark))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rule_stage),
    ("quality classifier", quality_classifier_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: Sketch thresholds, a trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, shared_folder(spark), "documents")
    return docs
