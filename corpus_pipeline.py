"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes the documents that its predecessor kept, decides on its own input, and returns the columns of
documents; the last returns the pieces of packed sequences. Every stage takes null ids, null, empty and very long
texts, repeated rows, empty tables and further columns of any name; what comes of them is told at the function that
it calls.
"""

from __future__ import annotations

from docstrata.llm.decontaminate import drop_contaminated
from docstrata.llm.near_dup import dedup_documents
from docstrata.llm.packing import pack
from docstrata.llm.quality import keep_good
from docstrata.llm.substring_dedup import dedup_passages


def quality_classifier(spark, docs, sf_dir: str):
    """Documents that the classifier does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark, docs, sf_dir: str):
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more); null and empty
    texts all stay."""
    return dedup_documents(docs)


def substring_dedup(spark, docs, sf_dir: str):
    """Documents without passages of 50 words or more that an earlier document has."""
    return dedup_passages(docs)


def benchmark_decontamination(spark, docs, sf_dir: str):
    """Documents without any window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark, docs, sf_dir: str):
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Tokenisation and the fitted models have no SQL form; tests/llm/test_pipeline.py compares with a direct count of what the stages keep.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
