"""From raw documents to token ids: language, near duplicates, contamination, mix, tokens.

Each stage takes all that the one before it kept, and its own result is written
as Parquet before the next begins.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import common, decontaminate, language, mixing, simhash, tokens
from tidegauge.sources import scratch

TOKENIZER = "word_bpe_49k.json"
# Languages that stay, all learned ones if None, and the least score of a document's language.
WANTED_LANGUAGES: list[str] | None = None
LEAST_LANGUAGE_SCORE = 0.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents in no wanted language, or in none at all, and name the language where it was not given."""
    model = language.fit(docs.where(common.outside_fold(0)))
    return language.accept(docs, model, WANTED_LANGUAGES, LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near copies."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents a twentieth or more of which is benchmark text."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document comes once per copy taken of it."""
    return mixing.deal(mixing.mix(docs)).select(docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in document order, and where each document's begin."""
    path = scratch(spark).path("tokens")
    tokens.write_tokens(docs, path, public_tokenizers.path(TOKENIZER))
    return tokens.offsets(tokens.read_tokens(spark, path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

# Trained models, XXH64 fingerprints and a tokenizer's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return docs
