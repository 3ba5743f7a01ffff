"""Prompt texts for explanations, review summaries and chat.

The jobs stop at the prompt table ``(request_id, prompt, status)``; sending it is the caller's.
The wording is fixed: it must equal what users of the recommender have in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfkin.functions.parsing import fixed, money
from shelfkin.operators.retrieve import Encoder, embedding_corpus, search_hits, search_records, text_search

# Every text below is given wording.
NO_HITS = "No matching products found in our catalog."
NO_PRODUCT_PAIR = "Unable to generate explanation: product not found."
NO_PRODUCT = "Product not found."
NO_REVIEWS = "No reviews available for this product."
SIMILAR_CATEGORY = "Similar category"
EXPLAIN_OPENING = "Explain why this product was recommended based on the user's interest:\n\n"
EXPLAIN_CLOSING = (
    "\n\nProvide a brief, friendly explanation (2-3 sentences) of why this recommendation makes sense."
)
REVIEW_CLOSING = (
    "\n\nFocus on:\n- Key pros mentioned by customers\n- Any cons or concerns\n- Overall sentiment"
)
CHAT_HITS = "Here are the most relevant products from our catalog that match the user's query:\n\n"
CHAT_CURRENT = "The user is currently viewing this product:\n"
CHAT_CLOSING = (
    "\n\nIMPORTANT: You must ONLY recommend or mention products that appear in the catalog data above. "
    "Do NOT invent or hallucinate products that are not listed. If no relevant products were found, "
    "tell the user honestly and suggest they refine their query.\n\n"
    "Provide a helpful, friendly response as an e-commerce shopping assistant. When recommending "
    "products, mention their name, price, rating, and a brief reason why they are a good match."
)

FEEDBACK_CHARS = 150
REVIEW_CHARS = 2000
SHARED_TERMS = 5


def _or(column: Column, text: str) -> Column:
    return F.coalesce(column, F.lit(text))


def _rating(column: Column) -> Column:
    return F.concat(fixed(F.coalesce(column, F.lit(0.0)), 1), F.lit("/5"))


def retrieval_context(queries: DataFrame, hits: DataFrame, max_products: int = 3) -> DataFrame:
    """``(query_id, context)``: the first hits of every query as a text block."""
    snippet = F.col("reviews_snippet")
    feedback = F.when(
        snippet != "",
        F.concat(F.lit("  Customer feedback: "), F.substring(snippet, 1, FEEDBACK_CHARS), F.lit("...\n")),
    ).otherwise(F.lit(""))
    block = F.concat(
        F.lit("Product "), F.col("rank").cast("string"), F.lit(":\n  Name: "), F.col("name"),
        F.lit("\n  Brand: "), F.col("brand"), F.lit("\n  Price: "), money(F.col("price")),
        F.lit("\n  Rating: "), _rating(F.col("avg_rating")), F.lit(" ("),
        F.col("review_count").cast("string"), F.lit(" reviews)\n  Relevance: "),
        fixed(F.col("relevance_score") * 100, 1), F.lit("%\n"), feedback,
    )
    texts = (
        hits.filter(F.col("rank") <= max_products)
        .select("query_id", "rank", block.alias("block"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("blocks"))
        .select("query_id", F.array_join("blocks.block", "\n").alias("context"))
    )
    return queries.select("query_id").join(texts, "query_id", "left").withColumn(
        "context", _or(F.col("context"), NO_HITS)
    )


def explanation_prompts(pairs: DataFrame, lookup: DataFrame, explained: DataFrame) -> DataFrame:
    """One prompt per pair, from ``explained(source_id, target_id, similarity_score, common_features)``."""

    def card(side: str) -> DataFrame:
        return lookup.select(
            F.col("id").alias(f"{side}_id"),
            F.struct(
                _or(F.col("name"), "Unknown Product").alias("name"),
                _or(F.col("brand"), "Unknown").alias("brand"),
                _rating(F.col("avg_rating")).alias("rating"),
            ).alias(side),
        )

    terms = F.array_join(F.slice(F.col("common_features.feature"), 1, SHARED_TERMS), ", ")
    prompt = F.concat(
        F.lit(EXPLAIN_OPENING),
        F.lit("User was viewing: "), F.col("source.name"),
        F.lit("\n- Brand: "), F.col("source.brand"), F.lit("\n- Rating: "), F.col("source.rating"),
        F.lit("\n\nRecommended product: "), F.col("target.name"),
        F.lit("\n- Brand: "), F.col("target.brand"), F.lit("\n- Rating: "), F.col("target.rating"),
        F.lit("\n\nKey matching features: "), _or(F.nullif(terms, F.lit("")), SIMILAR_CATEGORY),
        F.lit("\nSimilarity score: "), fixed(F.coalesce("similarity_score", F.lit(0.0)), 2),
        F.lit(EXPLAIN_CLOSING),
    )
    found = F.col("source").isNotNull() & F.col("target").isNotNull()
    return (
        pairs.select("source_id", "target_id")
        .join(card("source"), "source_id", "left")
        .join(card("target"), "target_id", "left")
        .join(explained, ["source_id", "target_id"], "left")
        .select(
            F.concat_ws("-", "source_id", "target_id").alias("request_id"),
            F.when(found, prompt).otherwise(F.lit(NO_PRODUCT_PAIR)).alias("prompt"),
            F.when(found, "ok").otherwise("not found").alias("status"),
        )
    )


def review_prompts(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """One prompt per ``requests(id)`` over the opening of the product's reviews."""
    reviews = F.substring("reviews_head", 1, REVIEW_CHARS)
    prompt = F.concat(
        F.lit('Summarize the following customer reviews for "'), _or(F.col("name"), "this product"),
        F.lit('" in 3-4 bullet points:\n\nReviews:\n'), reviews, F.lit(REVIEW_CLOSING),
    )
    status = (
        F.when(F.col("found").isNull(), "not found")
        .when(F.trim(reviews) == "", "no reviews")
        .otherwise("ok")
    )
    text = (
        F.when(F.col("status") == "not found", NO_PRODUCT)
        .when(F.col("status") == "no reviews", NO_REVIEWS)
        .otherwise(prompt)
    )
    products = catalog.select("id", "name", F.coalesce("reviews_head", F.lit("")).alias("reviews_head"),
                              F.lit(True).alias("found"))
    return (
        requests.select("id").join(products, "id", "left")
        .withColumn("status", status)
        .select(F.col("id").cast("string").alias("request_id"), text.alias("prompt"), "status")
    )


def chat_requests(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Messages ``(request_id, query_id, message, product_id)`` with the current product, if any."""
    product = catalog.select(
        F.col("id").alias("product_id"),
        F.struct("name", "brand", "price", "avg_rating").alias("product"),
    )
    return messages.join(product, "product_id", "left").select(
        "request_id", "query_id", "message", "product_id", "product"
    )


def chat_prompts(requests: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """One prompt per request: retrieved products, current product, question."""
    hits = F.lit("")
    if contexts is not None:
        requests = requests.join(contexts, "query_id", "left")
        hits = F.concat(F.lit(CHAT_HITS), _or(F.col("context"), NO_HITS), F.lit("\n\n"))
    price = F.col("product.price")
    current = F.concat(
        F.lit(CHAT_CURRENT),
        F.lit("- Product: "), _or(F.col("product.name"), "Unknown"),
        F.lit("\n- Brand: "), _or(F.col("product.brand"), "Unknown"),
        F.lit("\n- Price: "),
        F.when(price.isNotNull() & ~F.isnan(price), F.concat(F.lit("$"), fixed(price, 2))).otherwise("N/A"),
        F.lit("\n- Rating: "), _rating(F.col("product.avg_rating")), F.lit("\n\n"),
    )
    prompt = F.concat(
        hits,
        F.when(F.col("product").isNotNull(), current).otherwise(F.lit("")),
        F.lit("User question: "), F.col("message"), F.lit(CHAT_CLOSING),
    )
    return requests.select("request_id", prompt.alias("prompt"), F.lit("ok").alias("status"))


def chat_by_message(messages: DataFrame, catalog: DataFrame, load: Callable[[], Encoder] | None = None,
                    max_products: int = 3) -> DataFrame:
    """One prompt per ``messages(request_id, message, product_id)``: the products closest to the
    message itself, encoded like the products' texts, the current product, the question."""
    asked = messages.withColumn("query_id", F.col("request_id"))
    questions = asked.select("query_id", F.col("message").alias("text"))
    top = text_search(questions, embedding_corpus(catalog), max_products, load)
    contexts = retrieval_context(questions, search_hits(top, search_records(catalog)), max_products)
    return chat_prompts(chat_requests(asked, catalog), contexts)
