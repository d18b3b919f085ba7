"""Corpus pipeline: language ID, near-duplicate join, PII, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; all but the last have the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seekloom.llm import bpe, jaccard_join, langid, mixing, pii
from seekloom.llm.common import save


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that nearest-centroid identification rejects; lang becomes the language found."""
    found = langid.identify(docs, langid.fit(docs)).where("not rejected")
    return found.select(*[found["lang_pred"].alias("lang") if c == "lang" else found[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave one document of each class of five-word shingle sets linked at a Jaccard similarity of 0.8."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data and the terms that disclose it."""
    return pii.sanitize(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents towards the sources' target weights."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids again and keep digests of both."""
    return bpe.tokenized(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Language ID and encoding have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
