"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

A stage's intermediate tables are deleted when the next stage begins, as its rows have been written by then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import op4_jaccard_join, op5_quality_rules, op6_quality_classifier, op8_mixing, op10_sentencepiece
from lexmill.llm.shared import discard, scratch, shared_dir, table

#: The classifier and the draws have no counterpart in SQL; tests/llm/test_pipeline.py compares run() with a plain version of each stage.
ORACLE_SQL = None


_LEFT: list[str] = []


def stage(function: Callable) -> Callable:
    """``function`` as a stage: what earlier stages left goes first."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _LEFT)
        _LEFT.clear()
        with scratch() as made:
            out = function(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    return run_stage


@stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    return op6_quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the fences of their language and source."""
    return op5_quality_rules.keep_good(docs)


@stage
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are linked at similarity 0.8."""
    return op4_jaccard_join.keep_one(docs, num=80, den=100, width=5)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in shard order."""
    return op8_mixing.mixed(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with SentencePiece ids in place of their text."""
    return op10_sentencepiece.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", deduplicate),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents of ``sf_dir``."""
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, function) in enumerate(STAGES):
        function(spark, docs, sf_dir).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
    return docs
