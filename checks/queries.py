"""Every registered query with, where SQL can say it, its counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import adapters as a
from checks.oracle import NO_SPACE, clean, lit, money, numeric, price_text, sql
from shelfkin.functions import parsing, text, vectors
from shelfkin.lineage import materialise, shared_folder
from shelfkin.operators import analytics, catalog, evaluate, explain, lime, neighbours, prompts, retrieve, sampling, tfidf
from shelfkin.plans import prepare, report
from shelfkin.sources import artifacts, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return fn

    return add


def r6(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and sinks

SALES_FIELDS = list(readers.SALES_COLUMNS.values())


# Rows of a file: one with line breaks in its cells is read by one task.
FILE_ROWS = 50_000


def _csv(spark, df, rows, columns, *ties):
    """Several files of unlike size whose names follow ``ord``, more of them for more ``rows``."""
    path = scratch(spark)
    lean = F.sqrt(F.col("ord")).cast("int")
    readers.write_csv(df.repartitionByRange(max(5, -(-rows // FILE_ROWS)), lean).sortWithinPartitions("ord", *ties), path, columns, "gzip")
    return path


def _review_csv(spark, sf):
    ties = "id", text.clean_text(F.col("review_text")), "username", "review_rating"
    return _csv(spark, a.retail_reviews(spark, sf), a.table(spark, sf, "lineitem").count(), readers.REVIEW_COLUMNS, *ties)


def _sales_csv(spark, sf):
    rows = a.table(spark, sf, "documents").count() + a.table(spark, sf, "conversations").count()
    return _csv(spark, a.sales(spark, sf), rows, readers.SALES_COLUMNS)


@query("scan_reviews", """select id::varchar id, asins, brand, categories, name, prices, manufacturer, review_text,
    review_title, review_rating, username,
    row_number() over (order by ord, id, clean, username, review_rating) - 1 as ord from retail_rated""")
def scan_reviews(spark, sf):
    return readers.scan_reviews(spark, _review_csv(spark, sf))


@query("scan_sales", f"select {', '.join(SALES_FIELDS)}, row_number() over (order by ord) - 1 as ord from sales")
def scan_sales(spark, sf):
    return readers.scan_sales(spark, _sales_csv(spark, sf))


@query("process_reviews", f"""select id::varchar id, {', '.join(catalog.CATALOG_COLUMNS[1:])} from retail""")
def process_reviews(spark, sf):
    return prepare.process_reviews(spark, _review_csv(spark, sf), scratch(spark))["products"]


@query("process_sales", f"select {', '.join(catalog.CATALOG_COLUMNS)} from sales_catalog")
def process_sales(spark, sf):
    return prepare.process_sales(spark, _sales_csv(spark, sf), scratch(spark))["products"]


def _written(spark, sf):
    path = scratch(spark)
    ready = a.prepared_text(spark, sf)
    cat = a.text_catalog(spark, sf)
    docs = a.items(spark, sf).withColumn("ord", F.lit(0))
    artifacts.write_artifacts(
        path, cat, catalog.review_parts(docs, text="text"), ready.model.lookup(spark), ready.vectors, ready.model
    )
    return artifacts.load_artifacts(spark, path)


# A figure over the content of each written table.
FIGURES = {
    "products": "sum(length(reviews_head) + length(name))",
    "product_lookup": "sum(review_count)",
    "review_parts": "sum(length(text))",
    "vocabulary": "round(sum(idf) * 100)",
    "item_vectors": "sum(size(idx))",
    "item_terms": "round(sum(weight) * 100)",
    "term_postings": "round(sum(weight) * 100)",
}


@query("write_artifacts", f"""select 'products' as tbl, count(*) n, sum(length(reviews_head) + length(name))::double figure
    from cat union all select 'product_lookup', count(*), sum(review_count)::double from cat
    union all select 'review_parts', count(*), sum(length({clean('text')}))::double from documents
    union all select 'vocabulary', count(*), round(sum(idf) * 100) from vocab
    union all select 'item_vectors', (select count(*) from documents), (select count(*)::double from weights)
    union all select 'item_terms', count(*), round(sum(weight) * 100) from weights
    union all select 'term_postings', count(*), round(sum(weight) * 100) from weights""")
def write_artifacts(spark, sf):
    out = None
    for name, df in _written(spark, sf).items():
        row = df.agg(F.count("*").alias("n"), F.expr(FIGURES[name]).cast("double").alias("figure"))
        row = row.select(F.lit(name).alias("tbl"), "n", "figure")
        out = row if out is None else out.unionByName(row)
    return out


@query("load_artifacts", f"""select 'products' as tbl, id::varchar as key, avg_rating as v1, review_count::double v2, reviews_head as
    txt from cat union all select 'product_lookup', id::varchar, avg_rating, review_count::double, name from cat
    union all select 'review_parts', doc_id::varchar, 0, 0, {clean('text')} from documents
    union all select 'vocabulary', term, round(idf, 6), null, null from vocab
    union all select 'item_terms', id::varchar, round(weight, 6), null, term from weights
    union all select 'term_postings', id::varchar, round(weight, 6), null, term from weights
    union all select 'item_vectors', id::varchar, round(weight, 6), null, term from weights""")
def load_artifacts(spark, sf):
    tables = _written(spark, sf)
    columns = {
        "products": ("id", "avg_rating", "review_count", "reviews_head"),
        "product_lookup": ("id", "avg_rating", "review_count", "name"),
        "review_parts": ("id", "part", "part", "text"),
        "vocabulary": ("term", "idf", None, None),
        "item_terms": ("id", "weight", None, "term"),
        "term_postings": ("id", "weight", None, "term"),
        "item_vectors": ("id", "weight", None, "term"),
    }
    model = tfidf.TfidfModel.of(tables["vocabulary"])
    tables["item_vectors"] = model.item_terms(tables["item_vectors"])
    out = None
    for name, picked in columns.items():
        key, one, two, txt = (F.col(c) if c else F.lit(None) for c in picked)
        rows = tables[name].select(
            F.lit(name).alias("tbl"), key.cast("string").alias("key"), F.round(one.cast("double"), 6).alias("v1"),
            two.cast("double").alias("v2"), txt.cast("string").alias("txt"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("embedding_refresh", """select doc_id id, sha256(text) text_hash, vec_id is not null and lang <> 'fr' reused,
    place, round(coalesce(case when lang <> 'fr' then embedding[place + 1]::double end, v, 0), 4) v
    from documents left join embeddings on vec_id = doc_id cross join (select unnest(range(64))::int place)
    left join doc_unit using (doc_id, place)""")
def embedding_refresh(spark, sf):
    docs = a.documents(spark, sf)
    corpus = docs.select(F.col("doc_id").alias("id"), "text")
    # The French texts changed since their vectors were stored.
    then = F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("text"))
    stored = artifacts.with_text_hash(
        a.corpus_vectors(spark, sf).join(docs.select(F.col("doc_id").alias("id"), then.alias("text")), "id")
    )
    stored = artifacts.store_embeddings(stored, f"embeddings_{uuid.uuid4().hex}", scratch(spark), 8)
    out = artifacts.embedding_refresh(corpus, stored, retrieve.encode_texts)
    cells = out.select("id", "text_hash", "reused", F.posexplode("embedding").alias("place", "v"))
    return cells.select("id", "text_hash", "reused", "place", F.round(F.col("v").cast("double"), 4).alias("v"))


def _together(spark, sf, retail):
    columns = ["id", "name", "brand", "avg_rating", "review_count"]
    return analytics.compare_datasets({
        "retail": retail.select(*columns),
        "text": a.text_facts(spark, sf).select(*columns),
    })


@query("compare_datasets", "select dataset, id, name, brand, avg_rating, review_count from together")
def compare_datasets(spark, sf):
    return _together(spark, sf, a.retail_catalog(spark, sf))


# ---------------------------------------------------------------- projections and filters

LOOKUP = "id, name, brand, price, avg_rating, review_count"


@query("product_lookup", f"select {LOOKUP} from retail")
def product_lookup(spark, sf):
    return catalog.product_lookup(a.retail_catalog(spark, sf))


@query("product_by_id", f"select {', '.join(catalog.CATALOG_COLUMNS)} from retail where id = 3")
def product_by_id(spark, sf):
    return catalog.product_by_id(a.retail_catalog(spark, sf), 3)


@query("products_page", f"select {LOOKUP} from retail order by id limit 100 offset 50")
def products_page(spark, sf):
    return catalog.products_page(a.retail_catalog(spark, sf), limit=100, offset=50)


@query("standardise_sales", """select id, name, categories, brand, asins, manufacturer, discounted_price, actual_price,
    rating, rating_count, unique_reviewers from sales_products""")
def standardise_sales(spark, sf):
    return catalog.standardise_sales(a.sales(spark, sf)).select(
        "id", "name", "categories", "brand", "asins", "manufacturer", "discounted_price", "actual_price",
        "rating", "rating_count", "unique_reviewers",
    )


@query("content_text", "select id, content from retail union all select -id::bigint, content from sales_catalog")
def content_text(spark, sf):
    first = a.retail_catalog(spark, sf).select("id", "content")
    second = catalog.sales_catalog_build(a.sales(spark, sf)).select((-F.col("id").cast("bigint")).alias("id"), "content")
    return first.unionByName(second)


@query("full_content", f"""select id, 0::bigint seq, content as text from retail union all
    select id, part + 1, string_agg(clean, ' ' order by ord, clean) from retail_parts group by 1, 2""")
def full_content(spark, sf):
    reviews = materialise(a.retail_reviews(spark, sf))
    parts = materialise(catalog.review_parts(reviews))
    return catalog.full_content(catalog.catalog_build(reviews, parts), parts)


@query("embedding_corpus", """select id, name || '. Brand: ' || brand || '. ' || content || '. ' ||
    substr(reviews_head, 1, 500) as text from retail""")
def embedding_corpus(spark, sf):
    return retrieve.embedding_corpus(a.retail_catalog(spark, sf))


@query("search_records", """select id, name, brand, coalesce(price, 0) price, avg_rating, review_count,
    substr(reviews_head, 1, 300) reviews_snippet from retail union all
    select -1 - id, name, brand, price, avg_rating, review_count, reviews_snippet from cards""")
def search_records(spark, sf):
    second = retrieve.search_records(a.text_catalog(spark, sf)).withColumn("id", -1 - F.col("id"))
    return retrieve.search_records(a.retail_catalog(spark, sf)).unionByName(second)


@query("rated_products", "select id, brand, avg_rating, review_count from cat where avg_rating > 0")
def rated_products(spark, sf):
    return catalog.rated_products(a.text_facts(spark, sf)).select("id", "brand", "avg_rating", "review_count")


@query("priced_products", "select id, price from sales_catalog where price is not null")
def priced_products(spark, sf):
    return catalog.priced_products(catalog.sales_catalog_build(a.sales(spark, sf))).select("id", "price")


@query("review_points", "select id, name, review_count, avg_rating from retail")
def review_points(spark, sf):
    return analytics.review_points(a.retail_catalog(spark, sf))


@query("positive_weights", """select n.id, n.rec_id, n.score, c.avg_rating rating from nb n join cat c on c.id = n.rec_id
    where c.avg_rating > 0 and n.score > 0""")
def positive_weights(spark, sf):
    rated = catalog.rated_products(a.text_facts(spark, sf)).select(
        F.col("id").alias("rec_id"), F.col("avg_rating").alias("rating")
    )
    rows = a.text_neighbours(spark, sf).filter("score > 0").join(rated, "rec_id")
    return rows.select("id", "rec_id", "score", "rating")


@query("chat_requests", """select request_id, query_id, message, product_id, product_name, product_brand,
    product_rating from requests""")
def chat_requests(spark, sf):
    out = prompts.chat_requests(a.message_table(spark, sf), a.text_facts(spark, sf))
    return out.select(
        "request_id", "query_id", "message", "product_id", F.col("product.name").alias("product_name"),
        F.col("product.brand").alias("product_brand"), F.col("product.avg_rating").alias("product_rating"),
    )


# ---------------------------------------------------------------- catalog


@query("catalog_build", f"select {', '.join(catalog.CATALOG_COLUMNS)} from retail")
def catalog_build(spark, sf):
    return a.retail_catalog(spark, sf)


@query("sales_catalog_build", f"select {', '.join(catalog.CATALOG_COLUMNS)} from sales_catalog")
def sales_catalog_build(spark, sf):
    return catalog.sales_catalog_build(a.sales(spark, sf))


@query("review_aggregates", """select id, avg(rating) avg_rating, count(rating) review_count,
    count(distinct username) unique_reviewers from retail_rated group by 1""")
def review_aggregates(spark, sf):
    return catalog.review_aggregates(a.retail_reviews(spark, sf))


@query("review_parts", """select id, part, string_agg(clean, ' ' order by ord, clean) as text
    from retail_parts group by 1, 2""")
def review_parts(spark, sf):
    return catalog.review_parts(a.retail_reviews(spark, sf))


# ---------------------------------------------------------------- analytics


@query("catalog_stats", """select count(*) total_products, coalesce(sum(review_count), 0)::bigint total_reviews,
    round(coalesce(avg(avg_rating), 0), 2) average_rating,
    round(coalesce(avg(avg_rating) filter (avg_rating > 0), 0), 2) average_rated from cat""")
def catalog_stats(spark, sf):
    return analytics.catalog_stats(a.text_facts(spark, sf))


@query("catalog_kpis", """select count(*) total_products, round(avg(avg_rating), 6) avg_rating,
    sum(review_count)::bigint total_reviews, count(distinct brand) unique_brands from retail""")
def catalog_kpis(spark, sf):
    return analytics.catalog_kpis(a.retail_catalog(spark, sf))


@query("rating_histogram", """select label, count(id) products from
    (values (1, '0-1'), (2, '1-2'), (3, '2-3'), (4, '3-4'), (5, '4-5')) b(bin, label)
    left join cat on avg_rating > bin - 1 and avg_rating <= bin group by 1""")
def rating_histogram(spark, sf):
    return analytics.rating_histogram(a.text_facts(spark, sf))


@query("top_brands", """select brand, count(*) products from cat where brand is not null group by 1
    order by products desc, brand limit 10""")
def top_brands(spark, sf):
    return analytics.top_brands(a.text_facts(spark, sf))


def _histogram_sql(values: str, bins: int) -> str:
    return f"""select * from (with v as materialized ({values}),
        m as materialized (select min(v) low, (max(v) - min(v)) / {bins} width from v)
        select b.bin::int bin, round(low + b.bin * width, 6) low, round(low + (b.bin + 1) * width, 6) high, count(f.bin) n
        from range({bins}) b(bin) join m on low is not null left join
        (select least(case when width > 0 then floor((v - low) / width) else 0 end, {bins - 1}) bin from v, m) f
        on f.bin = b.bin group by b.bin, low, width)"""


@query("price_histogram", _histogram_sql("select price v from retail where price is not null", 30))
def price_histogram(spark, sf):
    return analytics.price_histogram(a.retail_catalog(spark, sf))


@query("most_reviewed", """select id, substr(name, 1, 40) || '...' as name, review_count, avg_rating from retail
    order by review_count desc, id limit 10""")
def most_reviewed(spark, sf):
    return analytics.most_reviewed(a.retail_catalog(spark, sf))


@query("rated_share", """select count(*) total_products, count(*) filter (avg_rating > 0) rated_products,
    round(count(*) filter (avg_rating > 0) / count(*) * 100, 6) rated_percent from cat""")
def rated_share(spark, sf):
    return analytics.rated_share(a.text_facts(spark, sf))


# ---------------------------------------------------------------- terms and weights


@query("tokens", f"select id, array_to_string(words, ' ') words from words")
def tokens(spark, sf):
    return tfidf.with_words(a.items(spark, sf)).select("id", F.array_join("words", " ").alias("words"))


@query("ngrams", "select id, term, n from tf")
def ngrams(spark, sf):
    return tfidf.term_counts(tfidf.with_terms(tfidf.with_words(a.items(spark, sf))))


@query("vocabulary", "select term, cf, df, round(idf, 6) idf from vocab")
def vocabulary(spark, sf):
    terms = tfidf.with_terms(materialise(tfidf.with_words(a.items(spark, sf))))
    return tfidf.vocabulary(terms).withColumn("idf", F.round("idf", 6))


@query("tfidf", "select id, term, round(weight, 6) weight from weights")
def tfidf_weights(spark, sf):
    model, vectors = tfidf.fit_vectors(a.items(spark, sf))
    return model.item_terms(vectors).withColumn("weight", F.round("weight", 6))


@query("tfidf_segments", "select id, term, round(weight, 6) weight from r_weights")
def tfidf_segments(spark, sf):
    return a.prepared_retail(spark, sf).item_terms.withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- recommendations


def _explained(job, spark, sf, *rest):
    ready = a.prepared_text(spark, sf)
    return job(ready.vectors, ready.model, *rest)


@query("neighbours", "select id, rec_id, score, rank from nb")
def neighbour_table(spark, sf):
    ready = a.prepared_text(spark, sf)
    return neighbours.ranked(neighbours.neighbour_lists(ready.vectors, ready.model, 5))


@query("recommend_many", "select id, rec_id, score, rank from padded")
def recommend_many(spark, sf):
    ready = a.prepared_text(spark, sf)
    return neighbours.ranked(neighbours.neighbour_lists(ready.vectors, ready.model, 5, pad=True, block_rows=256))


@query("recommend_one", "select rec_id id, score, rank from padded where id = 3")
def recommend_one(spark, sf):
    ready = a.prepared_text(spark, sf)
    return neighbours.recommend_one(ready.item_terms, 3, 5, catalog=ready.vectors, postings=a.text_postings(spark, sf))


@query("recommend_one_hydrated", """select n.id, n.rec_id, rank, score, name, brand, price, avg_rating, review_count
    from padded n join cat c on c.id = n.rec_id where n.id = 3""")
def recommend_one_hydrated(spark, sf):
    ready = a.prepared_text(spark, sf)
    one = neighbours.recommend_one(ready.item_terms, 3, 5, catalog=ready.vectors, postings=a.text_postings(spark, sf))
    pairs = one.select(F.lit(3).cast("bigint").alias("id"), F.col("id").alias("rec_id"), "score", "rank")
    return evaluate.recommend_hydrated(pairs, a.text_facts(spark, sf))


@query("recommend_hydrated", """select n.id, n.rec_id, rank, score, name, brand, price, avg_rating, review_count
    from nb n join cat c on c.id = n.rec_id""")
def recommend_hydrated(spark, sf):
    return evaluate.recommend_hydrated(a.text_neighbours(spark, sf), a.text_facts(spark, sf))


@query("top_features", """select id, term, weight, rank from (select *, row_number() over
    (partition by id order by weight desc, term)::int rank from (select id, term, round(weight, 6) weight from weights))
    where rank <= 10 and weight > 0""")
def top_features(spark, sf):
    return _explained(explain.top_features, spark, sf)


@query("recommendation_summary", """select * exclude (a) from (select *, case when a > 0.4 then 'excellent'
    when a > 0.25 then 'good' else 'low' end tier from (select id, round(avg(score), 6) avg_score, max(score) max_score,
    min(score) min_score, count(*) filter (score > 0.3) strong, count(*) recommended, avg(score) a from nb group by 1))""")
def recommendation_summary(spark, sf):
    return evaluate.recommendation_summary(a.text_neighbours(spark, sf))


# ---------------------------------------------------------------- explanations


@query("shared_terms", "select source_id, target_id, feature, source_weight, target_weight, combined, rank from shared")
def shared_terms(spark, sf):
    return _explained(explain.shared_terms, spark, sf, a.text_pairs(spark, sf))


def _shap(spark, sf):
    return _explained(explain.shap_explanations, spark, sf, a.text_pairs(spark, sf))


@query("shap_pairs", "select source_id, target_id, feature, value, rank, base_value, similarity_score from shap")
def shap_pairs(spark, sf):
    return explain.shap_values(_shap(spark, sf))


@query("shap_summary", """select source_id, target_id, count(*)::int n_features, round(sum(value), 6) total_contribution,
    any_value(base_value) base_value, any_value(similarity_score) similarity_score from shap group by 1, 2""")
def shap_summary(spark, sf):
    return explain.shap_summary(_shap(spark, sf))


def _lime_inputs(spark, sf):
    ready = a.prepared_text(spark, sf)
    return a.text_pairs(spark, sf), a.items(spark, sf), ready.vectors, ready.model


_STEP = "* 48271 % 2147483647"


@query("lime_samples", f"""select source_id, target_id, n_words, count(*) variants, sum(n_kept)::bigint kept,
    sum(n_kept * sample)::bigint kept_in_order from (
      select source_id, target_id, n_words, sample, case when sample = 0 then n_words else n_words - 1 -
        (((seed + 40503 * sample) % 2147483647 + 1) {_STEP} {_STEP} {_STEP}) % n_words end n_kept from (
          select source_id, target_id, ('0x' || substr(md5('42:' || source_id || ':' || target_id), 1, 8))::bigint seed,
            len(list_distinct(string_split({clean('text')}, ' '))) n_words
          from pairs join items on items.id = target_id where {clean('text')} <> ''), range(1000) r(sample))
    group by 1, 2, 3""")
def lime_samples(spark, sf):
    out = lime.lime_samples(*_lime_inputs(spark, sf))
    kept = F.col("n_kept").cast("long")
    return out.groupBy("source_id", "target_id", "n_words").agg(
        F.count("*").alias("variants"), F.sum(kept).alias("kept"), F.sum(kept * F.col("sample")).alias("kept_in_order")
    )


@query("lime_scores", """select source_id, target_id, 1000 as variants, score as whole, 0 as outside from pairs
    join nb on nb.id = source_id and rec_id = target_id""")
def lime_scores(spark, sf):
    """The whole text scores its pair's cosine, and no variant leaves the scale."""
    out = lime.lime_samples(*_lime_inputs(spark, sf))
    outside = ~F.col("similar").between(0, 1) | (F.round(F.col("similar") + F.col("dissimilar"), 9) != 1)
    return out.groupBy("source_id", "target_id").agg(
        F.count("*").alias("variants"), F.round(F.max(F.when(F.col("sample") == 0, F.col("similar"))), 6).alias("whole"),
        F.sum(outside.cast("int")).alias("outside"),
    )


@query("lime_pairs")
def lime_pairs(spark, sf):
    out = lime.lime_pairs(*_lime_inputs(spark, sf)).drop("residual")
    return out.withColumn("contribution", F.round("contribution", 6))


@query("lime_residuals", f"""select source_id, target_id, least(10, len(list_distinct(string_split({clean('text')}, ' ')))) n_features,
    0.0::double residual from pairs join items on items.id = target_id where {clean('text')} <> ''""")
def lime_residuals(spark, sf):
    """Every pair's coefficients solve their normal equations, worked out anew from the variants."""
    out = lime.lime_pairs(*_lime_inputs(spark, sf))
    return out.groupBy("source_id", "target_id").agg(
        F.count("*").alias("n_features"), (F.round(F.max("residual"), 6) + 0.0).alias("residual")
    )


@query("lime_term_weights", f"""select source_id, target_id, feature, round(coalesce(s.weight, 0), 6) source_weight,
    round(coalesce(t.weight, 0), 6) target_weight from (
      select source_id, target_id, unnest(list_distinct(string_split({clean('text')}, ' '))) feature
      from pairs join items on items.id = target_id where {clean('text')} <> '') p
    left join weights s on s.id = source_id and s.term = feature left join weights t on t.id = target_id and t.term = feature
    where s.weight is not null or t.weight is not null""")
def lime_term_weights(spark, sf):
    """All words of every pair's target with the weights attached to them, less the words that are
    terms of neither side."""
    every = lime.lime_pairs(*_lime_inputs(spark, sf), n_features=None)
    out = lime.lime_term_weights(every, a.prepared_text(spark, sf).item_terms).filter("source_weight > 0 or target_weight > 0")
    return out.select("source_id", "target_id", "feature", r6("source_weight"), r6("target_weight"))


# ---------------------------------------------------------------- retrieval and prompts


@query("semantic_topk", "select query_id, id, relevance_score, rank from topk")
def semantic_topk(spark, sf):
    corpus = a.corpus_vectors(spark, sf)
    return retrieve.semantic_topk(corpus.withColumnRenamed("id", "query_id"), corpus)


@query("encode_texts", "select id, place, round(v, 4) v from unit where v <> 0")
def encode_texts(spark, sf):
    vectors_ = retrieve.encode_texts(retrieve.embedding_corpus(a.retail_catalog(spark, sf)))
    cells = vectors_.select("id", F.posexplode("embedding").alias("place", "v")).filter("v <> 0")
    return cells.select("id", "place", F.round(F.col("v").cast("double"), 4).alias("v"))


@query("text_search", """select query_id, id, relevance_score, rank from (select *, row_number() over (partition by query_id
    order by relevance_score desc, id)::int rank from (select m.request_id query_id, i.id,
    round(coalesce(s, 0), 6) relevance_score from messages m cross join retail i left join
    (select a.request_id, b.id, sum(a.v * b.v) s from asked a join unit b using (place) group by 1, 2) d
    on d.request_id = m.request_id and d.id = i.id)) where rank <= 5""")
def text_search(spark, sf):
    questions = a.message_table(spark, sf).select(F.col("request_id").alias("query_id"), F.col("message").alias("text"))
    return retrieve.text_search(questions, retrieve.embedding_corpus(a.retail_catalog(spark, sf)))


def _hits(spark, sf, queries):
    top = retrieve.semantic_topk(queries, a.corpus_vectors(spark, sf))
    return retrieve.search_hits(top, retrieve.search_records(a.text_catalog(spark, sf)))


@query("search_hits", "select * from hits")
def search_hits(spark, sf):
    return _hits(spark, sf, a.corpus_vectors(spark, sf).withColumnRenamed("id", "query_id"))


@query("retrieval_context", "select query_id, context from context")
def retrieval_context(spark, sf):
    queries = a.corpus_vectors(spark, sf).withColumnRenamed("id", "query_id")
    return prompts.retrieval_context(queries, _hits(spark, sf, queries))


@query("explanation_prompts", f"""select p.source_id || '-' || p.target_id request_id, {lit(prompts.EXPLAIN_OPENING)} ||
    'User was viewing: ' || s.name || chr(10) || '- Brand: ' || s.brand || chr(10) || '- Rating: ' ||
    format('{{:.1f}}', s.avg_rating) || '/5' || chr(10) || chr(10) || 'Recommended product: ' || t.name || chr(10) ||
    '- Brand: ' || t.brand || chr(10) || '- Rating: ' || format('{{:.1f}}', t.avg_rating) || '/5' || chr(10) || chr(10) ||
    'Key matching features: ' || coalesce(f.terms, 'Similar category') || chr(10) || 'Similarity score: ' ||
    format('{{:.2f}}', n.score) || {lit(prompts.EXPLAIN_CLOSING)} prompt, 'ok' status
    from pairs p join cat s on s.id = p.source_id join cat t on t.id = p.target_id
    join nb n on n.id = p.source_id and n.rec_id = p.target_id
    left join (select source_id, target_id, string_agg(feature, ', ' order by rank) terms from shared where rank <= 5
      group by 1, 2) f on f.source_id = p.source_id and f.target_id = p.target_id""")
def explanation_prompts(spark, sf):
    pairs = a.text_pairs(spark, sf)
    explained = _explained(explain.similarity_explanation, spark, sf, pairs)
    return prompts.explanation_prompts(pairs, a.text_facts(spark, sf), explained)


@query("review_prompts", f"""select id::varchar request_id, case when reviews_head = '' then {lit(prompts.NO_REVIEWS)} else
    'Summarize the following customer reviews for "' || name || '" in 3-4 bullet points:' || chr(10) || chr(10) ||
    'Reviews:' || chr(10) || reviews_head || {lit(prompts.REVIEW_CLOSING)} end prompt,
    case when reviews_head = '' then 'no reviews' else 'ok' end status from sales_catalog""")
def review_prompts(spark, sf):
    cat = catalog.sales_catalog_build(a.sales(spark, sf))
    return prompts.review_prompts(cat.select("id"), cat)


CHAT_SQL = f"""select request_id, {lit(prompts.CHAT_HITS)} || context || chr(10) || chr(10) ||
    case when product_name is not null then {lit(prompts.CHAT_CURRENT)} || '- Product: ' || product_name || chr(10) ||
    '- Brand: ' || product_brand || chr(10) || '- Price: ' || coalesce('$' || format('{{:.2f}}', product_price), 'N/A') ||
    chr(10) || '- Rating: ' || format('{{:.1f}}', product_rating) || '/5' || chr(10) || chr(10) else '' end ||
    'User question: ' || message || {lit(prompts.CHAT_CLOSING)} prompt, 'ok' status
    from REQUESTS join CONTEXT using (query_id)"""


@query("chat_prompts", CHAT_SQL.replace("REQUESTS", "requests").replace("CONTEXT", "context"))
def chat_prompts(spark, sf):
    queries = a.message_queries(spark, sf)
    contexts = prompts.retrieval_context(queries, _hits(spark, sf, queries))
    requests = prompts.chat_requests(a.message_table(spark, sf), a.text_facts(spark, sf))
    return prompts.chat_prompts(requests, contexts)


@query("chat_by_message", CHAT_SQL.replace("REQUESTS", "message_requests").replace("CONTEXT", "message_context"))
def chat_by_message(spark, sf):
    """Products with prices, found by what the message says; some current products do not exist."""
    return prompts.chat_by_message(a.message_table(spark, sf), materialise(a.retail_catalog(spark, sf)))


@query("review_prompts_any", f"""select o_orderkey::varchar request_id, case when r.id is null then {lit(prompts.NO_PRODUCT)}
    when trim(substr(reviews_head, 1, 2000)) = '' then {lit(prompts.NO_REVIEWS)} else
    'Summarize the following customer reviews for "' || name || '" in 3-4 bullet points:' || chr(10) || chr(10) ||
    'Reviews:' || chr(10) || substr(reviews_head, 1, 2000) || {lit(prompts.REVIEW_CLOSING)} end prompt,
    case when r.id is null then 'not found' when trim(substr(reviews_head, 1, 2000)) = '' then 'no reviews' else 'ok' end status
    from orders left join retail r on r.id = o_orderkey""")
def review_prompts_any(spark, sf):
    """Asked for the number of every order, of which only some are products."""
    asked = a.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return prompts.review_prompts(asked, a.retail_catalog(spark, sf))


@query("explanation_prompts_any", f"""select o_orderkey || '-' || o_custkey request_id, case when s.id is null or t.id is null
    then {lit(prompts.NO_PRODUCT_PAIR)} else {lit(prompts.EXPLAIN_OPENING)} ||
    'User was viewing: ' || s.name || chr(10) || '- Brand: ' || s.brand || chr(10) || '- Rating: ' ||
    format('{{:.1f}}', s.avg_rating) || '/5' || chr(10) || chr(10) || 'Recommended product: ' || t.name || chr(10) ||
    '- Brand: ' || t.brand || chr(10) || '- Rating: ' || format('{{:.1f}}', t.avg_rating) || '/5' || chr(10) || chr(10) ||
    'Key matching features: Similar category' || chr(10) || 'Similarity score: 0.00' || {lit(prompts.EXPLAIN_CLOSING)} end prompt,
    case when s.id is null or t.id is null then 'not found' else 'ok' end status
    from orders left join retail s on s.id = o_orderkey left join retail t on t.id = o_custkey""")
def explanation_prompts_any(spark, sf):
    """Pairs of an order's and its customer's number: one, both or none of them a product, none explained."""
    pairs = a.table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id"))
    none = pairs.select("source_id", "target_id", F.lit(None).cast("double").alias("similarity_score"),
                        F.lit(None).cast("array<struct<feature:string>>").alias("common_features")).limit(0)
    return prompts.explanation_prompts(pairs, a.retail_catalog(spark, sf), none)


# ---------------------------------------------------------------- evaluation


@query("train_test_split", "select id, avg_rating, part from split")
def train_test_split(spark, sf):
    return evaluate.rated_split(a.text_facts(spark, sf)).select("id", "avg_rating", "part")


@query("sample_products", "select id from cat order by md5('42' || id::varchar), id limit 100")
def sample_products(spark, sf):
    return sampling.sample_products(a.text_facts(spark, sf), 100).select("id")


@query("background_rows", "select id from items order by id limit 100")
def background_rows(spark, sf):
    return sampling.background_rows(a.text_facts(spark, sf)).select("id")


def _prediction(spark, sf):
    ready = a.prepared_text(spark, sf)
    return report.rating_prediction(a.text_facts(spark, sf), ready.vectors, ready.model)


@query("predict_ratings", "select id, actual, predicted from pred")
def predict_ratings(spark, sf):
    return _prediction(spark, sf)[0]


@query("rating_errors", "select * from errors")
def rating_errors(spark, sf):
    return evaluate.rating_errors(*_prediction(spark, sf))


@query("prediction_coverage", "select count(predicted) n_predictions, count(*) n_test_products from pred")
def prediction_coverage(spark, sf):
    return evaluate.prediction_coverage(_prediction(spark, sf)[0])


@query("error_histogram", _histogram_sql("select round(actual - predicted, 6) v from pred where predicted is not null", 20))
def error_histogram(spark, sf):
    return evaluate.error_histogram(_prediction(spark, sf)[0])


def _relevance(spark, sf, n):
    ready = a.prepared_text(spark, sf)
    return report.sampled_relevance(a.text_facts(spark, sf), ready.vectors, ready.model, n, 5)


@query("brand_relevance", """select n.id, n.rec_id, rank, score, lower(s.brand) = lower(t.brand) relevant,
    t.review_count popularity from padded n join cat s using (id) join cat t on t.id = n.rec_id""")
def brand_relevance(spark, sf):
    return _relevance(spark, sf, -1)


@query("ranking_metrics", "select * from ranking")
def ranking_metrics(spark, sf):
    return evaluate.ranking_metrics(_relevance(spark, sf, 100), a.text_facts(spark, sf))


@query("similarity_quality", "select * from quality")
def similarity_quality(spark, sf):
    return evaluate.similarity_quality(_relevance(spark, sf, 50))


@query("evaluation_report", """select e.*, k.* exclude (n_samples), k.n_samples ranking_samples, q.* exclude (n_samples),
    q.n_samples similarity_samples from errors e join ranking k on true join quality q on true""")
def evaluation_report(spark, sf):
    ready = a.prepared_text(spark, sf)
    return report.evaluation_report(a.text_facts(spark, sf), ready.vectors, ready.model)


_METRICS = ", ".join(f"{m}::double {m}" for m in report.METRICS)
_FACTS = ", ".join(f"{m}::double {m}" for m in report.CHARACTERISTICS)


@query("dataset_report", f"""select * from (with l as (
    unpivot (select dataset, {_FACTS} from facts) on columns(* exclude dataset) into name metric value value union all
    unpivot (select 'text' dataset, {_METRICS} from errors join ranking on true join quality on true)
      on columns(* exclude dataset) into name metric value value union all
    unpivot (select 'retail' dataset, {_METRICS} from r_errors join r_ranking on true join r_quality on true)
      on columns(* exclude dataset) into name metric value value)
    select metric, max(value) filter (dataset = 'retail') retail, max(value) filter (dataset = 'text') as text
    from l group by 1)""")
def dataset_report(spark, sf):
    text_ready, retail_ready = a.prepared_text(spark, sf), a.prepared_retail(spark, sf)
    return report.dataset_report(_together(spark, sf, retail_ready.products), {
        "retail": report.evaluation_report(retail_ready.products, retail_ready.vectors, retail_ready.model),
        "text": report.evaluation_report(a.text_facts(spark, sf), text_ready.vectors, text_ready.model),
    })


# ---------------------------------------------------------------- scalar functions


@query("clean_text", f"select page_id id, {clean('html')} as text from pages")
def clean_text(spark, sf):
    return a.table(spark, sf, "pages").select(F.col("page_id").alias("id"), text.clean_text(F.col("html")).alias("text"))


@query("category_text", f"select product_id id, {clean("replace(category, '|', ' ')")} as text from sales")
def category_text(spark, sf):
    return a.sales(spark, sf).select(
        F.col("product_id").alias("id"), text.category_text(F.col("category")).alias("text")
    )


@query("extract_price_json", r"""select id, ord, try_cast(regexp_extract(prices, '"amountMax":(\d+\.?\d*)', 1) as double) price
    from retail_reviews""")
def extract_price_json(spark, sf):
    return a.retail_reviews(spark, sf).select("id", "ord", parsing.extract_price_json(F.col("prices")).alias("price"))


@query("extract_price_text", f"select product_id id, {price_text('discounted_price')} price from sales")
def extract_price_text(spark, sf):
    return a.sales(spark, sf).select(
        F.col("product_id").alias("id"), parsing.extract_price_text(F.col("discounted_price")).alias("price")
    )


@query("price_fallback", f"""select product_id id, coalesce({price_text('discounted_price')}, {price_text('actual_price')}) price
    from sales""")
def price_fallback(spark, sf):
    return a.sales(spark, sf).select(
        F.col("product_id").alias("id"),
        parsing.price_fallback(F.col("discounted_price"), F.col("actual_price")).alias("price"),
    )


@query("brand_from_name", f"""select product_id id,
    coalesce(nullif(regexp_extract(product_name, '{NO_SPACE}'), ''), 'unknown') brand from sales""")
def brand_from_name(spark, sf):
    return a.sales(spark, sf).select(
        F.col("product_id").alias("id"), parsing.brand_from_name(F.col("product_name")).alias("brand")
    )


@query("parse_count", """select product_id id, coalesce(try_cast(regexp_replace(rating_count, '[^0-9]', '', 'g') as bigint), 0) n
    from sales""")
def parse_count(spark, sf):
    return a.sales(spark, sf).select(
        F.col("product_id").alias("id"), parsing.parse_count(F.col("rating_count")).alias("n")
    )


@query("parse_rating", "select id, ord, rating from retail_rated")
def parse_rating(spark, sf):
    return a.retail_reviews(spark, sf).select("id", "ord", parsing.parse_rating(F.col("review_rating")).alias("rating"))


@query("numeric_or_zero", f"""select product_id id, coalesce({numeric('rating')}, 0) rating,
    coalesce({numeric('actual_price')}, 0) price from sales""")
def numeric_or_zero(spark, sf):
    return a.sales(spark, sf).select(
        F.col("product_id").alias("id"), parsing.numeric_or_zero(F.col("rating")).alias("rating"),
        parsing.numeric_or_zero(F.col("actual_price")).alias("price"),
    )


@query("price_display", f"select id, {money('price')} price from retail union all select -1 - id, {money('price')} from cat")
def price_display(spark, sf):
    first = a.retail_catalog(spark, sf).select("id", "price")
    second = a.text_facts(spark, sf).select((-1 - F.col("id")).alias("id"), "price")
    return first.unionByName(second).select("id", parsing.money(F.col("price")).alias("price"))


def _next_pairs(spark, sf):
    left = a.corpus_vectors(spark, sf)
    right = left.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return left.join(right, "id").select("id", vectors.dense_cosine(F.col("embedding"), F.col("other")).alias("score"))


NEXT = "select a.id, list_dot_product(a.e, b.e) score from vec a join vec b on b.id = a.id + 1"


@query("dense_cosine", f"select id, round(score, 6) score from ({NEXT})")
def dense_cosine(spark, sf):
    return _next_pairs(spark, sf).select("id", r6("score"))


@query("clip_similarity", f"""select id, round(greatest(least(score, 1), 0), 6) as similar,
    round(1 - greatest(least(score, 1), 0), 6) as dissimilar from ({NEXT})""")
def clip_similarity(spark, sf):
    clipped = vectors.clip_similarity(F.col("score"))
    return _next_pairs(spark, sf).select(
        "id", F.round(clipped, 6).alias("similar"), F.round(1 - clipped, 6).alias("dissimilar")
    )
