"""Corpus pipeline: the stages that a training corpus goes through, in order.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Filtering stages return the rows
they keep with all their columns; the last returns the pieces of each text.

In every stage a null text counts as an empty one and stays null where it stays; empty texts stay, as one of their group of
near-duplicates; rows with a null doc_id are rows like others; repeated rows are near-duplicates of each other; ties go to
the smallest doc_id; an empty table stays empty; columns besides doc_id and text may have any names and stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventide.llm.common import materialize, table
from eventide.llm.fmindex import uncontaminated
from eventide.llm.pieces import sampled_pieces
from eventide.llm.pii import pseudonymise
from eventide.llm.queries import PII_KEY
from eventide.llm.simhash import one_of_each
from eventide.llm.toxicity import without_toxic


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id."""
    return one_of_each(docs, k=3, seed=42, distance=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if benchmark passages cover at least one word in 20."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"), window=13, one_in=20)


def pseudonymise_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes pseudonyms; all other columns stay, n_chars too (a date may be written a digit shorter or longer)."""
    return pseudonymise(docs, PII_KEY, kinds=None)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each text, and the text that it decodes to."""
    return sampled_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), theta=0.3, seed=4)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontaminate),
    ("pii", pseudonymise_pii),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express trained scores, fingerprint components or sampled segmentations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
