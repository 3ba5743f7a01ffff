"""The operators on the given tables, as registered queries, and the SQL of those it can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfkin.lineage import shared_folder
from shelfkin.llm import (
    audit,
    bpe,
    decontaminate,
    importance,
    jaccard,
    language,
    licenses,
    quality,
    secrets,
    sql,
    templates,
    toxicity,
    urls,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and whether it is kept."""
    return quality.judged(_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by the model that the documents themselves train."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    named = language.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out.alias("held_out"), "language.*")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded from its ids."""
    source = bpe.read_source(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(_table(spark, sf_dir, "documents"), source)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives in the shared folder and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template an earlier document holds."""
    done = templates.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "lines.n_lines", "lines.n_dropped", "text")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    return secrets.report(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences."""
    return licenses.report(_table(spark, sf_dir, "documents"))


# The rules of the contract.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(_table(spark, sf_dir, "pages"), rules)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, its score, and its rank if it is drawn."""
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return importance.ranked(importance.scored(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every source, order of the filters and step."""
    masks = audit.masks(_table(spark, sf_dir, "documents"))
    return audit.interactions(audit.mask_counts(masks, _table(spark, sf_dir, "labels")))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by the model that the labels train."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    scored = toxicity.scored(docs, model, "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_jaccard": op4_jaccard,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_secrets": op8_secrets,
    "op9_licenses": op9_licenses,
    "op10_urls": op10_urls,
    "op11_importance": op11_importance,
    "op12_filter_audit": op12_filter_audit,
    "op13_toxicity": op13_toxicity,
}

ORACLE = {
    "op6_warc": sql.WARC,
    "op7_line_dedup": sql.LINE_DEDUP,
    "op10_urls": sql.URLS,
    "op11_importance": sql.IMPORTANCE,
    "op12_filter_audit": sql.FILTER_AUDIT,
}
