"""From raw documents to token ids: language, repeated lines, near duplicates, leaks, encoding.

Each stage takes ``(spark, docs, sf_dir)``, with ``docs`` what the stage before it kept, and
returns a DataFrame that is written as Parquet and read again by the next one. All but the last
return the columns of ``documents``; the last has a row per document left.

Null texts go in the first stage; repeated rows, ties and clashing columns follow each operator's
own docstring; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfkin.lineage import materialise
from shelfkin.llm import bpe, decontaminate, jaccard, language, templates

# Near copies share so many percent of their shingles of so many words; op4's figures are its own.
SHARE, WORDS = 80, 5
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it learns from the rows at hand."""
    return language.accepted(docs, language.fit(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; ``n_chars``, if there, follows the text."""
    left = templates.keep_first(docs)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near duplicates."""
    return jaccard.keep_one(docs, SHARE, WORDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, bpe.read_source(VOCABULARY), keep_ids=True)


STAGES = [
    ("language", keep_language),
    ("line_dedup", drop_lines),
    ("near_duplicates", keep_one),
    ("decontaminate", drop_leaks),
    ("encode", encode),
]
#: The language model and the encoder have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
