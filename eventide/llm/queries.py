"""The registered queries: each operator over its whole table, with production parameters.

What nulls, empty and long texts, ties, repeated rows, empty tables and further columns give is stated by the operators that
they call; a query only names the table and its columns. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import table
from .fmindex import contamination
from .labelled import bare_pages, labelled_pages
from .licences import licences
from .mainhtml import fit, main_text
from .oracle import ORACLE_SQL  # noqa: F401  what the registry reads
from .pieces import sampled_pieces
from .pii import pseudonymise
from .ppm import language_model_scores
from .simhash import near_duplicates
from .suffixdedup import remove_repeats
from .tokenids import token_ids
from .toxicity import toxicity
from .whitening import whitened
from .winnowing import edited_fingerprints


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"), order=6, folds=7, fold=2)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampled_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), theta=0.3, seed=4)
    return found.select("doc_id", "n_pieces", "log_probability", "ids_crc32", "decoded")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, one_in=20)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), fit([*labelled_pages(600, seed=6), *bare_pages(80, seed=7)]))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, seed=42, distance=3)


#: A key of the caller's own would come from a secret store; the query's is fixed, so that its results can be held against others.
PII_KEY = "op8"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    return found.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_replaced"), F.concat_ws(",", "pii_kinds").alias("kinds"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=50, k=20).drop("kept")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"), k=12, window=24)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), top=32, scale=64, offset=1_000_000)


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_ids": op2_token_ids,
    "op3_ppm": op3_ppm,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontamination": op5_decontamination,
    "op6_html": op6_html,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_winnowing": op10_winnowing,
    "op11_whitening": op11_whitening,
    "op12_licences": op12_licences,
    "op13_collocations": op13_collocations,
}
