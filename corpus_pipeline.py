"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, tokenisation.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. Every stage but the last returns the columns of
``documents``. ``run`` applies them one after the other, each written as Parquet
in the shared folder and read again, so a lost executor repeats one stage's
tasks at most.

* ``language_id`` drops documents whose language cannot be identified: no
  letter, or a score below ``language_id.LEAST_SCORE``. The model is learned
  from the stage's own input.
* ``exact_dedup`` keeps of equal texts the row with the largest id.
* ``minhash_near_dedup`` keeps of each near-duplicate class the smallest id.
* ``mix_sources`` returns each document as often as the mix takes it.
* ``sentencepiece`` returns the tokens of each remaining row.

The operators' docstrings state the result for nulls, empty texts, ties,
repeated rows and empty tables; the stages add no rule of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskflow.llm import exact_dedup, language_id, mixing, order_minhash, sentencepiece_codec
from riskflow.llm.common import documents, stash

__all__ = ["STAGES", "ORACLE_SQL", "run"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", tokenise),
]

# A language model, sketches and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, f"pipeline-{name}")
    return docs
