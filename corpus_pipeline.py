"""The corpus pipeline: five stages over ``documents``, each on all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of
documents.  Stages that filter keep every clean document as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Scratch, table
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.exact_dedup import drop_exact_copies
from tessera.llm.packing import pack_documents
from tessera.llm.simhash import drop_near_copies
from tessera.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that score as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts the smallest doc_id stays."""
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each component of near copies the smallest doc_id stays."""
    return drop_near_copies(docs)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold benchmark passages beyond the limit go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one row per piece of each document, with its place in a sequence."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_exact_copies),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_contaminated),
    ("best_fit_packing", packed),
]

#: The stages hold a trained network, a tokenizer and a packing order: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
