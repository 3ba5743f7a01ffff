"""The test tables in the shapes the jobs take.

Two catalogs: ``retail`` has part as products and lineitem as reviews, ``text`` has documents
as products with ratings from labels.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfkin.lineage import materialise, shared_folder, task_count
from shelfkin.operators import catalog as c
from shelfkin.operators import neighbours, tfidf
from shelfkin.plans.prepare import catalog_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The test tables are single small files of one row group: deal their rows out to the cores
    before work on text. A table whose scan has a split for every core is read as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")


# ---------------------------------------------------------------- retail


def retail_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"
    )
    part = table(spark, sf_dir, "part")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    amount = F.col("p_retailprice").cast("decimal(10,2)").cast("string")
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(order, line.l_orderkey == order.o_orderkey)
        .select(
            F.col("l_partkey").alias("id"),
            F.col("l_partkey").cast("string").alias("asins"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("categories"),
            F.col("p_name").alias("name"),
            F.concat(F.lit('[{"amountMax":'), amount, F.lit("}]")).alias("prices"),
            F.col("p_brand").alias("manufacturer"),
            F.concat(
                F.lit("<p>"), F.col("o_orderpriority"), F.lit("</p> returned: "), F.col("l_returnflag"),
                F.lit("/"), F.col("l_linestatus"),
            ).alias("review_text"),
            F.col("o_orderpriority").alias("review_title"),
            F.concat(F.ceil(F.col("l_quantity") / 10).cast("string"), F.lit(".0 of 5")).alias("review_rating"),
            F.col("o_custkey").cast("string").alias("username"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        )
    )


def retail_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.catalog_build(materialise(retail_reviews(spark, sf_dir)))


# ---------------------------------------------------------------- sales layout


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as products that repeat once per turn of the conversation of the same number."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    talk = table(spark, sf_dir, "conversations").withColumnRenamed("text", "said")
    count = F.format_number("n_chars", 0)
    return (
        docs.join(labels, docs.doc_id == labels.label_id, "left")
        .join(talk, docs.doc_id == talk.conv_id, "left")
        .select(
            F.col("doc_id").cast("string").alias("product_id"),
            F.concat(F.col("source"), F.lit(" item "), F.col("doc_id").cast("string")).alias("product_name"),
            F.concat_ws("|", "lang", "source").alias("category"),
            F.when(F.col("lang") != "en", F.concat(F.lit("₹"), count)).alias("discounted_price"),
            F.concat(F.lit("$"), count, F.lit(".50")).alias("actual_price"),
            F.lit("10%").alias("discount_percentage"),
            F.concat((1 + 3 * F.col("quality")).cast("string"), F.lit(".5")).alias("rating"),
            F.when(F.col("lang") != "de", count).alias("rating_count"),
            F.col("text").alias("about_product"),
            F.lit(None).cast("string").alias("img_link"),
            F.col("role").alias("review_title"),
            F.col("said").alias("review_content"),
            F.col("role").alias("user_name"),
            (F.col("doc_id") * 1024 + F.coalesce("turn", F.lit(0))).alias("ord"),
        )
    )


# ---------------------------------------------------------------- text


def text_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    rating = 1.0 + 3.0 * F.col("quality") + F.when(F.col("toxic") == 1, 0.0).otherwise(1.0)
    return docs.join(labels, docs.doc_id == labels.label_id, "left").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"),
        F.col("source").alias("brand"),
        F.col("lang").alias("categories"),
        F.lit(None).cast("double").alias("price"),
        F.coalesce(F.when(F.col("quality").isNotNull(), rating), F.lit(0.0)).alias("avg_rating"),
        F.col("n_chars").alias("review_count"),
        F.substring(c.clean_text(F.col("text")), 1, c.HEAD_CHARS).alias("reviews_head"),
    )


def text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text catalog without its text, for jobs that read only figures."""
    return text_catalog(spark, sf_dir).drop("reviews_head")


@dataclass
class Prepared:
    """A fitted vocabulary and the vectors it gives, written once and shared by the queries; the retail
    catalog's with the products that they are made of."""

    model: tfidf.TfidfModel
    vectors: DataFrame
    products: DataFrame | None = None

    @property
    def item_terms(self) -> DataFrame:
        return self.model.item_terms(self.vectors)


_prepared: dict[tuple, Prepared] = {}
_postings: dict[tuple, DataFrame] = {}
_neighbours: dict[tuple, DataFrame] = {}


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return spark.sparkContext.applicationId, sf_dir, name


def prepared_text(spark: SparkSession, sf_dir: str) -> Prepared:
    key = _key(spark, sf_dir, "text")
    if key not in _prepared:
        model, vectors = tfidf.fit_vectors(items(spark, sf_dir))
        _prepared[key] = Prepared(model, materialise(vectors))
    return _prepared[key]


def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the text catalog by term, written once."""
    key = _key(spark, sf_dir, "postings")
    if key not in _postings:
        path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
        rows = neighbours.term_postings(prepared_text(spark, sf_dir).item_terms)
        rows.write.partitionBy("buckets", "bucket").parquet(path)
        _postings[key] = spark.read.parquet(path)
    return _postings[key]


def prepared_retail(spark: SparkSession, sf_dir: str) -> Prepared:
    key = _key(spark, sf_dir, "retail")
    if key not in _prepared:
        reviews = materialise(retail_reviews(spark, sf_dir))
        parts = materialise(c.review_parts(reviews))
        products = materialise(c.catalog_build(reviews, parts))
        model, _, vectors = catalog_vectors(products, parts)
        # A few megabytes that every scan then works on hard: one part per core.
        _prepared[key] = Prepared(model, materialise(vectors.repartition(task_count(spark), "id")), products)
    return _prepared[key]


def text_neighbours(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """``(id, rec_id, score, rank)`` of the whole text catalog, written once."""
    key = _key(spark, sf_dir, f"text{k}")
    if key not in _neighbours:
        ready = prepared_text(spark, sf_dir)
        lists = neighbours.neighbour_lists(ready.vectors, ready.model, k)
        _neighbours[key] = materialise(neighbours.ranked(lists))
    return _neighbours[key]


def text_pairs(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Every item with each of its recommendations."""
    return text_neighbours(spark, sf_dir, 5).filter(F.col("rank") <= k).select(
        F.col("id").alias("source_id"), F.col("rec_id").alias("target_id")
    )


# ---------------------------------------------------------------- vectors and messages


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def message_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns; a conversation is about the document of its number and asks with the
    vector its number falls on."""
    n = table(spark, sf_dir, "embeddings").agg(F.count("*")).scalar()
    return (
        table(spark, sf_dir, "conversations")
        .filter("role = 'user'")
        .select(
            F.concat_ws("-", "conv_id", "turn").alias("request_id"),
            (F.col("conv_id") % n).alias("query_id"),
            F.col("text").alias("message"),
            F.col("conv_id").alias("product_id"),
        )
    )


def message_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = message_table(spark, sf_dir).select("query_id").distinct()
    return asked.join(
        corpus_vectors(spark, sf_dir).withColumnRenamed("id", "query_id"), "query_id"
    )
