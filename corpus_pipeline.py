"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and rereads as the next
stage's docs. All but the last return the columns of ``documents``:

1. quality: documents that importance resampling rejects go;
2. near_duplicates: of each near-duplicate component, the document with the smallest doc_id stays;
3. decontamination: documents that hold a benchmark window go;
4. secrets: documents that hold a secret go;
5. bpe: doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left.

The filtering stages decide by doc_id: rows without one are never dropped. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, decontam, neardup, quality, secrets
from skein.llm._common import read, scratch, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without labels, or if none is good or none bad, all stay. Null and empty texts have log weight 0."""
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without words stay; rows that repeat a doc_id stay or go together."""
    return neardup.keep_one(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without words hold nothing and stay."""
    return decontam.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts hold nothing and stay."""
    return secrets.remove_documents(docs)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row; a null text counts as empty."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("secrets", stage_secrets),
    ("bpe", stage_bpe),
]

#: SQL can't express the first and the last stage; tests/llm/test_pipeline.py compares with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    at, docs = scratch(spark), read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), at, name)
    return docs
