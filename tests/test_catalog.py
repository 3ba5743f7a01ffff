import csv

import pytest
from pyspark.sql import functions as F

from plain import clean
from shelfkin.operators import analytics, catalog, tfidf
from shelfkin.plans.prepare import process_reviews, process_sales
from shelfkin.sources import artifacts, readers

HEAD = ["id", "asins", "brand", "categories", "keys", "name", "prices", "manufacturer", "reviews.text",
        "reviews.title", "reviews.rating", "reviews.username"]
REVIEWS = [
    ["p1", "A1", "", "Audio, Home", "k", "Speaker", '[{"amountMax":99.9,"currency":"USD"}]', "Acme", "Great <b>sound</b>,\nreally \"good\"", "t", "5", "ann"],
    ["p1", "A2", "Acme", "", "k", "Other name", "", "", "", "t", "4.0 stars", "bob"],
    ["p1", "", "Zzz", "", "k", "", "", "", "works fine", "t", "n/a", "ann"],
    ["p2", "B1", "NaN", "", "k", "Reader", "", "", "reads well", "t", "", ""],
    ["", "C1", "Lost", "", "k", "No id", "", "", "gone", "t", "1", "eve"],
]


@pytest.fixture()
def review_csv(tmp_path):
    path = tmp_path / "reviews.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([HEAD, *REVIEWS])
    return str(path)


def test_scan_reads_by_name_and_keeps_file_order(spark, review_csv):
    rows = readers.scan_reviews(spark, review_csv).orderBy("ord").collect()
    assert [r.id for r in rows] == ["p1", "p1", "p1", "p2", None]
    assert rows[0].review_text == 'Great <b>sound</b>,\nreally "good"'
    assert rows[0].brand is None and rows[3].brand is None and rows[2].review_rating is None


def test_order_of_files_and_rows(spark, tmp_path):
    """Small and large files whose names do not follow their sizes."""
    want = []
    for name, n in (("a", 2), ("b", 4000), ("c", 1), ("d", 900)):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            rows = [[f"{name}{i}"] + [f"x{i}"] * (len(HEAD) - 1) for i in range(n)]
            csv.writer(f).writerows([HEAD, *rows])
        want += [r[0] for r in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        for multi_line in (True, False):
            rows = readers.scan_reviews(spark, str(tmp_path), multi_line).select("id", "ord").orderBy("ord").collect()
            assert [r.id for r in rows] == want and [r.ord for r in rows] == list(range(len(want)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_text_is_not_shuffled_for_its_number(spark, review_csv):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = readers.scan_reviews(spark, review_csv)
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
        assert df.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_file_with_other_columns_is_refused(spark, tmp_path):
    for name, head in (("a", HEAD), ("b", HEAD[::-1])):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([head, ["v"] * len(HEAD)])
    with pytest.raises(Exception, match="header|schema"):
        readers.scan_reviews(spark, str(tmp_path)).collect()


def test_catalog_from_reviews(spark, review_csv):
    reviews = readers.scan_reviews(spark, review_csv)
    got = {r.id: r for r in catalog.catalog_build(reviews).collect()}
    assert set(got) == {"p1", "p2"}
    p1, p2 = got["p1"], got["p2"]
    assert (p1.asins, p1.brand, p1.name, p1.categories, p1.price) == ("A1", "Acme", "Speaker", "Audio, Home", 99.9)
    assert p1.content == "speaker audio home acme"
    assert (p1.avg_rating, p1.review_count, p1.unique_reviewers) == (4.5, 2, 2)
    assert p1.reviews_head == "great sound really good  works fine"
    assert (p2.brand, p2.brand_clean, p2.content) == (None, "unknown", "reader  unknown")
    assert (p2.avg_rating, p2.review_count, p2.unique_reviewers, p2.price) == (0.0, 0, 0, None)


def test_review_text_is_whole_and_in_order_for_a_very_large_product(spark):
    """One product holds a third of all rows."""
    rows = [("hot" if i % 3 == 0 else f"p{i % 50}", i, None if i % 7 == 0 else f"Text {i}!") for i in range(3000)]
    reviews = spark.createDataFrame(rows, "id string, ord bigint, review_text string")
    parts = catalog.review_parts(reviews, part_rows=100, chunk_rows=170)
    assert parts.groupBy("id", "part").count().filter("count > 1").count() == 0
    per = {r.id: r.n for r in reviews.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert {r.id: r["count"] for r in parts.groupBy("id").count().collect()} == {i: -(-n // 100) for i, n in per.items()}
    assert all(r.part < -(-per[r.id] // 100) for r in parts.collect())
    got = {}
    for r in parts.orderBy("id", "part").collect():
        got.setdefault(r.id, []).append(r.text)
    want = {}
    for i, _, t in rows:
        want.setdefault(i, []).append(clean(t))
    whole = {i: " ".join(t) for i, t in want.items()}
    assert {i: " ".join(p) for i, p in got.items()} == whole
    for chars in (1, 30, 2000):
        heads = {r.id: r.reviews_head for r in catalog.review_heads(parts, chars).collect()}
        assert heads == {i: t[:chars] for i, t in whole.items()}


def test_sales_layout(spark, tmp_path):
    columns = list(readers.SALES_COLUMNS)
    path = tmp_path / "sales.csv"
    base = {"product_id": "B1", "product_name": "Nova Wave", "category": "Watches|Smart", "discounted_price": "",
            "actual_price": "₹1,999", "rating": "|", "rating_count": "24,269", "about_product": "Nice | <i>thin</i>",
            "review_content": "Good, value", "user_name": "ann,bob", "review_title": "x", "img_link": "",
            "discount_percentage": "5%"}
    other = {**base, "product_name": "Later name", "rating": "4.1", "user_name": "eve", "review_content": "Meh"}
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, columns)
        w.writeheader()
        w.writerows([base, other])
    row = catalog.sales_catalog_build(readers.scan_sales(spark, str(path))).collect()[0]
    assert (row.id, row.asins, row.brand, row.manufacturer, row.name) == ("B1", "B1", "Nova", "Nova", "Nova Wave")
    assert (row.price, row.avg_rating, row.review_count, row.unique_reviewers) == (1999.0, 0.0, 24269, 2)
    assert row.content == "nova wave watches smart nova nice thin"
    assert row.reviews_head == "good value meh"
    tables = process_sales(spark, str(path), str(tmp_path / "out"))
    assert tables["products"].count() == 1


def small_set(spark, n):
    products = spark.range(n).select("id", *[F.lit("1").alias(c) for c in catalog.CATALOG_COLUMNS[1:]])
    terms = spark.createDataFrame([(i, f"t{i % 3}", 0.5) for i in range(n)], "id bigint, term string, weight double")
    other = spark.range(n).withColumn("x", F.lit(1))
    return [products, other, other, other, terms]


def test_a_write_that_stops_leaves_readers_on_the_set_before(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "set")
    with pytest.raises(FileNotFoundError):
        artifacts.load_artifacts(spark, folder)
    assert artifacts.write_artifacts(folder, *small_set(spark, 5)) == 1
    held = artifacts.load_artifacts(spark, folder)
    products, parts, vocabulary, vectors, terms = small_set(spark, 9)
    broken = vocabulary.withColumn("x", F.raise_error(F.lit("stopped")))
    with pytest.raises(Exception, match="stopped"):  # after three of the tables
        artifacts.write_artifacts(folder, products, parts, broken, vectors, terms)
    again = artifacts.load_artifacts(spark, folder)
    assert {n: t.count() for n, t in again.items()} == dict.fromkeys(artifacts.TABLES, 5)
    assert artifacts.write_artifacts(folder, *small_set(spark, 7)) == 2
    assert {n: t.count() for n, t in artifacts.load_artifacts(spark, folder).items()} == dict.fromkeys(artifacts.TABLES, 7)
    assert held["products"].count() == 5  # one older version stays for those who still read it
    assert artifacts.write_artifacts(folder, *small_set(spark, 8)) == 3
    with pytest.raises(Exception, match="exist|FILE_NOT"):
        held["products"].count()
    assert artifacts.load_artifacts(spark, folder)["products"].count() == 8


def test_weights_written_from_the_model_lie_by_id_and_are_not_shuffled(spark, tmp_path, monkeypatch):
    model = tfidf.TfidfModel(["a", "b", "c"], [1.0, 1.0, 1.0])
    rows = [(i % 200 if i < 230 else None, [0, 2] if i % 3 else [], [0.5, 0.25] if i % 3 else []) for i in range(240)]
    vectors = spark.createDataFrame(rows, "id bigint, idx array<int>, weights array<double>").repartition(5)
    products, parts, vocabulary, _, _ = small_set(spark, 5)
    plans, item_terms = [], tfidf.TfidfModel.item_terms

    def seen(self, read):
        out = item_terms(self, read)
        plans.append(out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple"))
        return out

    monkeypatch.setattr(tfidf.TfidfModel, "item_terms", seen)
    artifacts.write_artifacts(str(tmp_path), products, parts, vocabulary, vectors, model)
    tables = artifacts.load_artifacts(spark, str(tmp_path))
    key = lambda r: (r.id is None, r.id or 0, r.term, r.weight)
    want = sorted(item_terms(model, vectors).collect(), key=key)
    for name in ("item_terms", "term_postings"):
        assert sorted(tables[name].select("id", "term", "weight").collect(), key=key) == want
    assert "partitioning" not in plans[0] and "ReadSchema: struct<id:bigint,idx" in plans[0]
    files = {}
    for r in tables["item_terms"].select("id", F.input_file_name().alias("file")).collect():
        files.setdefault(r.file, []).append(-1 if r.id is None else r.id)
    assert all(ids == sorted(ids) for ids in files.values())


def test_process_writes_tables_that_load_back(spark, review_csv, tmp_path):
    tables = process_reviews(spark, review_csv, str(tmp_path / "out"))
    assert set(tables) == set(artifacts.TABLES)
    assert tables["products"].count() == 2 and tables["item_vectors"].count() == 2
    assert tables["product_lookup"].columns == catalog.LOOKUP_COLUMNS
    found = catalog.product_by_id(tables["products"], "p2").collect()
    assert [r.name for r in found] == ["Reader"]
    assert catalog.product_by_id(tables["products"], "nope").count() == 0


def test_loaded_numbers_are_forced(spark):
    df = spark.createDataFrame([("a", "4.5", "12"), ("b", "bad", "x"), ("c", None, None)], "id string, avg_rating string, review_count string")
    got = [(r.avg_rating, r.review_count) for r in catalog.typed_catalog(df).orderBy("id").collect()]
    assert got == [(4.5, 12), (0.0, 0), (0.0, 0)]


def test_page(spark):
    df = spark.range(30).select("id", *[F.lit(0).alias(c) for c in catalog.LOOKUP_COLUMNS[1:]])
    assert [r.id for r in catalog.products_page(df, limit=5, offset=10).collect()] == list(range(10, 15))
    assert catalog.products_page(df, limit=5, offset=28).count() == 2


def test_embedding_refresh_reuses_unchanged_text(spark):
    stored = artifacts.with_text_hash(spark.createDataFrame(
        [(1, "same", [1.0]), (2, "old", [2.0]), (9, "left", [9.0])], "id bigint, text string, embedding array<float>"))
    corpus = spark.createDataFrame([(1, "same"), (2, "new"), (3, "added")], "id bigint, text string")
    out = artifacts.embedding_refresh(corpus, stored, lambda t: t.select("id", F.array(F.lit(0.0).cast("float")).alias("embedding")))
    got = {r.id: (r.embedding, r.reused) for r in out.collect()}
    assert got == {1: ([1.0], True), 2: ([0.0], False), 3: ([0.0], False)}


def test_stored_vectors_are_not_shuffled_by_a_refresh(spark, tmp_path):
    rows = [(i, f"text {i}", [float(i)]) for i in range(200)]
    stored = artifacts.with_text_hash(spark.createDataFrame(rows, "id bigint, text string, embedding array<float>"))
    table = artifacts.store_embeddings(stored, "stored_vectors_test", str(tmp_path / "stored"), 4)
    corpus = spark.createDataFrame([(i, f"text {i if i % 3 else -i}") for i in range(100, 300)], "id bigint, text string")
    matched = artifacts.matched_embeddings(corpus, table)
    text = matched._sc._jvm.PythonSQLUtils.explainString(matched._jdf.queryExecution(), "simple")
    assert text.count("Exchange") == 1 and "Bucketed: true" in text
    after = text.split("Exchange")[1]
    assert "stored_vectors_test" not in after.split("FileScan")[0]
    got = {r.id: r for r in artifacts.embedding_refresh(corpus, table, lambda t: t.select("id", F.array(F.lit(-1.0).cast("float")).alias("embedding"))).collect()}
    assert set(got) == set(range(100, 300))
    assert all(r.reused == (i % 3 > 0 and i < 200) and r.embedding == [float(i) if r.reused else -1.0] for i, r in got.items())
    spark.sql("drop table stored_vectors_test")


def test_figures(spark):
    df = spark.createDataFrame(
        [(1, "x", 0.0, 3, 1.0), (2, "x", 1.0, 9, 4.0), (3, "y", 1.5, 9, None), (4, None, 5.0, 1, 2.0)],
        "id bigint, brand string, avg_rating double, review_count bigint, price double",
    ).withColumn("name", F.concat(F.lit("n" * 45), F.col("id").cast("string")))
    assert {r.label: r.products for r in analytics.rating_histogram(df).collect()} == {"0-1": 1, "1-2": 1, "2-3": 0, "3-4": 0, "4-5": 1}
    assert [(r.brand, r.products) for r in analytics.top_brands(df).collect()] == [("x", 2), ("y", 1)]
    assert analytics.catalog_stats(df).collect()[0] == (4, 22, 1.88, 2.5)
    assert analytics.catalog_stats(df.limit(0)).collect()[0] == (0, 0, 0.0, 0.0)
    assert [r.id for r in analytics.most_reviewed(df, 2).collect()] == [2, 3]
    assert analytics.most_reviewed(df, 1).collect()[0].name == "n" * 40 + "..."
    assert [(r.bin, r.n) for r in analytics.price_histogram(df, 3).orderBy("bin").collect()] == [(0, 1), (1, 1), (2, 1)]
    same = df.withColumn("price", F.lit(7.0))
    assert sorted((r.bin, r.n) for r in analytics.price_histogram(same).collect()) == [(0, 4), *((b, 0) for b in range(1, 30))]
    assert analytics.price_histogram(df.limit(0)).count() == 0


def test_catalog_reads_written_parts(spark, review_csv):
    """Review text is gathered once, into written parts, which the product table starts from."""
    reviews = readers.scan_reviews(spark, review_csv)
    own = catalog.catalog_build(reviews)
    text = own._sc._jvm.PythonSQLUtils.explainString(own._jdf.queryExecution(), "simple")
    assert "review_text" not in text
    given = catalog.catalog_build(reviews, catalog.review_parts(reviews))
    assert sorted(given.collect()) == sorted(own.collect())
