"""The corpus pipeline: five stages over ``documents``, each one operator of ``assaykit.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and reads it again as the next stage's docs.
Stages 1 to 4 return the columns they got; the last adds the sampled pieces.

Defined results: a table without rows passes all stages; documents without a
letter are rejected by the first; repeated rows are near copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import decontaminate, lang_id, ngram_join, pieces, secret_scan
from assaykit.llm.common import table
from assaykit.llm.queries import PIECE_BPE
from assaykit.session import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are too far from all languages, or have no letter, go."""
    return lang_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id."""
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay."""
    return secret_scan.redact(docs, secret_scan.fit(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become sampled segmentations, seeded by doc_id: ids and lossless are added."""
    return pieces.encode(docs, PIECE_BPE, key=["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", sentencepiece),
]

#: Centroids, sampled paths, forests and sampled pieces aren't expressible in SQL: tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
