"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the
columns of documents; the last one returns the pieces of the packed sequences.

A stage's result reads tables in the shared folder. Write it before the next stage is called: that
one begins by deleting the tables of the stages before it in the same thread, but for those that its docs read.

Nulls and ties: a null or empty text has no words, so the quality rules drop it; a null doc_id is a
row like any other; equal rows are near duplicates, of which one stays; an empty table gives no rows.
Columns of other names, also those that operators use inside, come along unchanged up to packing.
"""

from __future__ import annotations

import functools
import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import near_dup, packing, pii, quality, scratch, suffix_dedup

_made = threading.local()


def stage(function):
    """The tables of earlier stages go when the next one begins."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        paths = _made.__dict__.setdefault("paths", [])
        scratch.release(paths, docs)
        with scratch.noted(paths):
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the posterior reject go."""
    return quality.kept_documents(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8."""
    return near_dup.kept_documents(docs, k=5, p=80)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each byte of a 100-byte string that occurs before goes, with what is left of a character cut in two."""
    return suffix_dedup.cleaned_documents(docs)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.redacted(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.digest(packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("packing", packed),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and read again."""
    docs, results = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            with scratch.noted(results):
                docs = scratch.stored(docs, name.replace(" ", "-"))
            scratch.release(results, docs)
    return docs
