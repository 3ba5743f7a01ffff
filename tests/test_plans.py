"""What the optimiser makes of the jobs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import adapters, queries
from shelfkin.operators import analytics, catalog, explain, neighbours, sampling, tfidf


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.fixture(scope="module")
def ready(spark, data_dir):
    return adapters.prepared_text(spark, data_dir)


def test_weights_need_no_shuffle(spark, data_dir, ready):
    text = plan(tfidf.item_vectors(adapters.table(spark, data_dir, "documents").withColumnRenamed("doc_id", "id"), ready.model))
    assert "Exchange" not in text and "Python" not in text and "ArrowEval" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_vocabulary_sums_before_its_shuffles(spark, data_dir):
    docs = adapters.table(spark, data_dir, "documents").withColumnRenamed("doc_id", "id")
    terms = tfidf.with_terms(tfidf.with_words(docs.select("id", "text")))
    cells = np.zeros(tfidf.CELLS, bool)
    cells[::7] = True
    text = plan(tfidf.term_totals(terms, cells))
    assert text.count("Exchange hashpartitioning(term") == 1 and "partial_sum" in text and "Python" not in text
    # The condition on cells stands below the sums that are shuffled.
    assert text.rindex("partial_sum") < text.index("getbit")
    text = plan(tfidf.cell_totals(terms))
    assert text.count("Exchange") == 1 and "partial_count" in text and "Python" not in text


def test_one_item_is_a_broadcast_join_and_a_top_k(ready):
    text = plan(neighbours.recommend_one(ready.item_terms, 3, 5))
    assert "BroadcastHashJoin" in text and "TakeOrderedAndProject" in text
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_ranks_are_limited_before_the_shuffle(spark):
    scored = spark.range(10).select("id", F.col("id").alias("rec_id"), F.rand(1).alias("score"))
    text = plan(neighbours._lists(scored.repartition(3).filter("score > 0"), 3))
    assert text.count("WindowGroupLimit") == 2
    assert text.count("Exchange hashpartitioning") == 1


def test_catalog_shuffles_slim_rows_and_reads_needed_columns(spark, data_dir):
    text = plan(adapters.retail_catalog(spark, data_dir))
    assert "l_shipdate" not in text and "o_totalprice" not in text
    assert "CartesianProduct" not in text and "Python" not in text
    for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text):
        assert re.match(r"(id|l_partkey|_groupingexpression)#", keys), keys


def test_figures_read_only_their_columns(spark, data_dir):
    text = plan(analytics.catalog_stats(adapters.text_facts(spark, data_dir)))
    assert "text" not in "".join(re.findall(r"ReadSchema: ([^\n]*)", text))


def test_point_lookup_is_pushed_down(spark, data_dir):
    docs = adapters.table(spark, data_dir, "documents").withColumnRenamed("doc_id", "id")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in plan(catalog.product_by_id(docs, 3))


def test_split_has_no_global_sort(spark):
    text = plan(sampling.train_test_split(spark.range(100).withColumn("avg_rating", F.lit(1.0))))
    assert "rangepartitioning" not in text
    single = [line for line in text.split("\n") if "Exchange SinglePartition" in line]
    assert len(single) == 1  # the table of bucket sizes


def test_explanations_have_no_python_and_no_cross_join(ready):
    pairs = ready.vectors.select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"))
    for df in (
        explain.shared_terms(ready.vectors, ready.model, pairs),
        explain.shap_explanations(ready.vectors, ready.model, pairs),
    ):
        text = plan(df)
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
        assert "Generate explode(met" not in text and "Generate explode(held" not in text
    assert "Exchange" not in plan(explain.top_features(ready.vectors, ready.model))


def test_the_index_joins_no_term_with_a_group(ready):
    """Postings meet the table of their terms by broadcast and their vectors by id: nothing else."""
    vectors = ready.vectors.withColumn("key", neighbours._vector_key())
    blocked = neighbours.materialise(neighbours._blocked(vectors, None, ready.model, 5, 64))
    floors = blocked.filter("source").select("id", F.lit(0.5).alias("floor"))
    asked, postings = neighbours._index_sides(blocked, floors, len(ready.model.terms))
    cells = neighbours.materialise(neighbours._index_cells(asked, postings))
    text = plan(neighbours._indexed(blocked, asked, postings, cells, 5, len(ready.model.terms), 64))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert text.count("FlatMapCoGroupsInArrow") == 1


def test_large_samples_are_many_tasks(spark):
    catalog = spark.range(5000).withColumn("total", F.lit(1))
    found = sampling.sample_products(catalog, 4000)
    text = plan(found)
    assert "TakeOrdered" not in text and "rangepartitioning" not in text and found.columns == ["id", "total"]
    want = [r.id for r in catalog.orderBy(F.md5(F.concat(F.lit("42"), F.col("id").cast("string"))), "id").limit(4000).collect()]
    assert sorted(r.id for r in found.collect()) == sorted(want)
    assert sampling.sample_products(catalog, 10_000).count() == 5000 and sampling.sample_products(catalog, 0).count() == 0


def test_more_rows_are_more_files(spark, data_dir, monkeypatch):
    """A file is read by one task, so its size must not follow the table's; the rows stay in order."""
    def rows():
        out = queries.scan_reviews(spark, data_dir)
        return len(out.inputFiles()), sorted(map(tuple, out.collect()), key=repr)

    few, want = rows()
    monkeypatch.setattr(queries, "FILE_ROWS", 400)
    many, got = rows()
    assert few + 5 < many and got == want
