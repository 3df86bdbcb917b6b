"""A training corpus from ``documents``: language, near copies, secrets, mixture, tokens.

Each stage takes what the one before it kept, as a table with the columns of ``documents``; the last
returns the tokens of every text that is left.  ``run`` writes each result to the shared folder and
reads it back, so a lost executor costs no more than the stage it was lost in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from proseforge.llm import bpe, crf, mixing, secret_scan, superminhash
from proseforge.llm.common import table
from proseforge.session import cut_lineage

#: Texts of which a smaller share than this is in one language are rejected.
LEAST_SHARE = 0.5
#: Near copies share 80 % of their runs of five words.
COPIES = superminhash.Settings(shingle=5)
MIXTURE = mixing.Settings()
VOCABULARY = "byte_bpe_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is told; null texts, texts without letters and even mixtures go."""
    return crf.known_only(docs, crf.train(docs), LEAST_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest number."""
    return superminhash.keep_one(docs, settings=COPIES)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts, with secrets replaced by a mark and their length brought up to date."""
    return secret_scan.redact(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the temperature mixture of their sources takes them."""
    return mixing.resample(docs, MIXTURE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text, and of what decoding gives back."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Language models, token counts and redaction are not stated in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
