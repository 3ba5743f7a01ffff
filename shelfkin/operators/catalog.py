"""The product table: one row per id, with cleaned text and review figures.

Review text is kept whole but never gathered into one cell: a product with very many reviews
would not fit. It lives in ordered parts of a bounded number of reviews, and the product row
carries the opening characters that cards and prompts show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfkin.functions.parsing import (
    brand_from_name,
    extract_price_json,
    numeric,
    numeric_or_zero,
    parse_count,
    parse_rating,
    price_fallback,
)
from shelfkin.functions.text import category_text, clean_text
from shelfkin.lineage import materialise

CATALOG_COLUMNS = [
    "id", "name", "brand", "categories", "manufacturer", "asins", "price", "name_clean",
    "categories_clean", "brand_clean", "content", "reviews_head", "avg_rating", "review_count",
    "unique_reviewers",
]
LOOKUP_COLUMNS = ["id", "name", "brand", "price", "avg_rating", "review_count"]
PART_ROWS = 4096
# Rows of one product that a task puts in order.
CHUNK_ROWS = 1 << 16
HEAD_CHARS = 2000


def first_known(name: str, order: str = "ord") -> Column:
    """The first non-null value of a column in file order."""
    return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(order))).alias(name)


def brand_text(brand: Column) -> Column:
    return F.when(brand.isNull(), F.lit("unknown")).otherwise(clean_text(brand))


def content_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def unique_reviewers(reviews: DataFrame, id_col: str = "id", user: str = "username") -> DataFrame:
    """Distinct known reviewers per id.

    Counted apart from the other figures: a distinct count groups by id and reviewer first, and
    wide product columns should not travel with that.
    """
    return (
        reviews.filter(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.count_distinct(user).alias("unique_reviewers"))
    )


def rated(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("id").isNotNull()).withColumn("_rating", parse_rating(F.col("review_rating")))


def rating_figures() -> list[Column]:
    return [F.avg("_rating").alias("avg_rating"), F.count("_rating").alias("review_count")]


def review_aggregates(reviews: DataFrame) -> DataFrame:
    """Mean rating, number of rated reviews and distinct reviewers per id."""
    figures = rated(reviews).groupBy("id").agg(*rating_figures())
    return figures.join(unique_reviewers(reviews), "id")


def _parts_of(rows: DataFrame, part_rows: int, chunk_rows: int) -> DataFrame:
    """``rows(id, ord, text)`` with ``part``, the row's place among those of its id by ``part_rows``.

    Rows are numbered inside chunks of ``ord``, and the chunks' sizes are summed up per id, so no
    task orders more than a chunk of one id.
    """
    chunk = F.expr(f"ord div {chunk_rows}")
    sizes = rows.groupBy("id", chunk.alias("chunk")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("id", "chunk").orderBy("ord", "text"))
    numbered = rows.withColumn("chunk", chunk).withColumn("number", number).join(before, ["id", "chunk"])
    part = F.expr(f"(before + number - 1) div {part_rows}")
    return numbered.select("id", "ord", "text", part.alias("part"))


def review_parts(reviews: DataFrame, part_rows: int = PART_ROWS, id_col: str = "id",
                 text: str = "review_text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(id, part, text)``: cleaned reviews joined by spaces, ``part_rows`` per part.

    A product has as many parts as its reviews fill, the last one less than full; read in ``part``
    order and joined by spaces they are its whole review text. Only the products with more than one
    part are numbered by ``ord``: there is one of them for every ``part_rows`` reviews at most.
    """
    rows = reviews.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), "ord", clean_text(F.col(text)).alias("text")
    )
    # Written, so that its size is known and text is not shuffled to be marked.
    big = materialise(rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > part_rows).select("id", F.lit(True).alias("big")))
    marked = rows.join(big, "id", "left")
    few = marked.filter("big is null").select("id", "ord", "text", F.lit(0).cast("bigint").alias("part"))
    many = _parts_of(marked.filter("big").drop("big"), part_rows, chunk_rows)
    return (
        few.unionByName(many)
        .groupBy("id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("rows"))
        .select("id", "part", F.array_join("rows.text", " ").alias("text"))
    )


def review_heads(parts: DataFrame, chars: int = HEAD_CHARS) -> DataFrame:
    """``(id, reviews_head)``: the first characters of each product's review text.

    Which parts matter is decided on ``(id, part, length)`` alone: every part after the first
    adds at least its joining space, so no more than ``chars + 1`` of them can. Then the opening
    characters of those parts are fetched, ``chars`` per product or little more.
    """
    order = Window.partitionBy("id").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        parts.select("id", "part", F.least(F.length("text"), F.lit(chars)).alias("length"))
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= chars + 1)
        .withColumn("start", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0)))
        .filter(F.col("start") <= chars)
        .select("id", "part")
    )
    return (
        parts.join(wanted, ["id", "part"])
        .select("id", "part", F.substring("text", 1, chars).alias("text"))
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("rows"))
        .select("id", F.substring(F.array_join("rows.text", " "), 1, chars).alias("reviews_head"))
    )


def catalog_build(reviews: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Product table of the review layout. ``parts`` are the ``review_parts`` where they are written
    already; without they are written once. ``reviews`` are read several times: pass a written table.

    Product columns and rating figures come from the same rows and the same key, so one
    grouping yields both; map-side it leaves one row per product.
    """
    parts = materialise(review_parts(reviews)) if parts is None else parts
    firsts = [first_known(c) for c in ("asins", "brand", "categories", "name", "prices", "manufacturer")]
    return (
        rated(reviews).groupBy("id").agg(*firsts, *rating_figures())
        .join(unique_reviewers(reviews), "id")
        .join(review_heads(parts), "id", "left")
        .withColumns({
            "price": extract_price_json(F.col("prices")),
            "name_clean": clean_text(F.col("name")),
            "categories_clean": clean_text(F.col("categories")),
            "brand_clean": brand_text(F.col("brand")),
            "avg_rating": F.coalesce("avg_rating", F.lit(0.0)),
            "review_count": F.coalesce("review_count", F.lit(0)),
            "reviews_head": F.coalesce("reviews_head", F.lit("")),
        })
        .withColumn("content", content_text(*[F.col(c) for c in ("name_clean", "categories_clean", "brand_clean")]))
        .select(*CATALOG_COLUMNS)
    )


SALES_FIRST = [
    "product_name", "category", "discounted_price", "actual_price", "discount_percentage",
    "rating", "rating_count", "about_product", "img_link",
]


def standardise_sales(sales: DataFrame) -> DataFrame:
    """First known product columns under the shared names, with the derived ones."""
    return (
        sales.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(*[first_known(c) for c in SALES_FIRST])
        .withColumnsRenamed({"product_id": "id", "product_name": "name", "category": "categories"})
        .join(unique_reviewers(sales, "product_id", "user_name"), "id")
        .withColumn("brand", brand_from_name(F.col("name")))
        .withColumns({"asins": F.col("id").cast("string"), "manufacturer": F.col("brand")})
    )


def sales_catalog_build(sales: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Product table of the sales layout, in the same columns; ``parts`` as in ``catalog_build``."""
    if parts is None:
        parts = materialise(review_parts(sales, id_col="product_id", text="review_content"))
    return (
        standardise_sales(sales)
        .join(review_heads(parts), "id", "left")
        .withColumns({
            "price": price_fallback(F.col("discounted_price"), F.col("actual_price")),
            "name_clean": clean_text(F.col("name")),
            "categories_clean": category_text(F.col("categories")),
            "brand_clean": brand_text(F.col("brand")),
            "about_clean": clean_text(F.col("about_product")),
            "avg_rating": numeric_or_zero(F.col("rating")),
            "review_count": parse_count(F.col("rating_count")),
            "reviews_head": F.coalesce("reviews_head", F.lit("")),
        })
        .withColumn(
            "content",
            content_text(*[F.col(c) for c in ("name_clean", "categories_clean", "brand_clean", "about_clean")]),
        )
        .select(*CATALOG_COLUMNS)
    )


def full_content(catalog: DataFrame, parts: DataFrame) -> DataFrame:
    """``(id, seq, text)``: product content at 0, then its review parts in order.

    Joined by spaces in ``seq`` order this is a product's full content.
    """
    head = catalog.select("id", F.lit(0).cast("bigint").alias("seq"), F.col("content").alias("text"))
    rest = parts.select("id", (F.col("part") + 1).alias("seq"), "text")
    return head.unionByName(rest)


def product_lookup(catalog: DataFrame) -> DataFrame:
    return catalog.select(*LOOKUP_COLUMNS)


def product_by_id(catalog: DataFrame, product_id) -> DataFrame:
    """The product with this id; no row when there is none."""
    return catalog.filter(F.col("id") == F.lit(product_id))


def products_page(catalog: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return product_lookup(catalog).orderBy("id").offset(offset).limit(limit)


def typed_catalog(catalog: DataFrame) -> DataFrame:
    """Rating and review count as numbers, zero where they are not."""
    return catalog.withColumns({
        "avg_rating": numeric_or_zero(F.col("avg_rating").cast("string")),
        "review_count": F.coalesce(numeric(F.col("review_count").cast("string")).cast("bigint"), F.lit(0)),
    })


def priced_products(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("price").isNotNull())


def rated_products(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("avg_rating") > 0)
