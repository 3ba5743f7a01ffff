import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plain import fit, top, vector
from shelfkin.operators import neighbours as nb
from shelfkin.operators import sparse
from shelfkin.operators import tfidf

WORDS = [f"w{i}" for i in range(120)]


def case(spark, key=lambda i: i, kind="bigint"):
    """A third of the rows are copies of one text, ten have no kept term, one is alone."""
    rng = random.Random(7)
    texts = []
    for i in range(200):
        if i % 3 == 0:
            texts.append("w1 w2 w3 w4 w5")
        elif i % 20 == 1:
            texts.append("the of")
        else:
            texts.append(" ".join(rng.choices(WORDS[(i % 4) * 30:(i % 4) * 30 + 30], k=rng.randint(1, 12))))
    texts += ["zz qq", "zz qq"]
    rows = [(key(i), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"id {kind}, text string")
    model = tfidf.fit(df)
    idf = fit(texts)
    vectors = {i: vector(t, idf) for i, t in rows}
    return tfidf.item_vectors(df, model), model, [i for i, _ in rows], vectors


def lists(df):
    return {r.id: [(x.rec_id, x.score) for x in r.recs] for r in df.collect()}


@pytest.fixture(scope="module")
def numbers(spark):
    vectors, model, ids, plain = case(spark)
    return vectors.persist(), model, ids, plain


@pytest.mark.parametrize("index_share", [0, 1e9])
@pytest.mark.parametrize("block_rows", [16, 4096])
@pytest.mark.parametrize("k", [1, 5])
def test_all_items_equal_brute_force(numbers, block_rows, k, index_share):
    """By groups of blocks and by the index."""
    vectors, model, ids, plain = numbers
    got = lists(nb.neighbour_lists(vectors, model, k, block_rows=block_rows, index_share=index_share))
    assert got == top(ids, plain, k)


@pytest.mark.parametrize("cell_rows", [3, 50])
def test_hot_terms_are_dealt_to_cells(numbers, cell_rows):
    vectors, model, ids, plain = numbers
    with_terms = vectors.filter(F.size("idx") > 0)
    got = lists(nb._many(with_terms, None, model, 5, 16, cell_rows, 1e9))
    assert got == {i: v for i, v in top(ids, plain, 5).items() if plain[i]}


@pytest.mark.parametrize("groups", [1, 3, 50])
def test_groups_of_blocks(numbers, monkeypatch, groups):
    vectors, model, ids, plain = numbers
    monkeypatch.setattr(nb, "_group_count", lambda rows, block_rows, cores: groups)
    monkeypatch.setattr(nb, "HOT_KEYS", 10**6)
    monkeypatch.setattr(nb, "SALT_ROWS", 7)
    assert lists(nb.neighbour_lists(vectors, model, 5, block_rows=16, index_share=0)) == top(ids, plain, 5)


def test_group_count():
    assert [nb._group_count(n, 1024, 8) for n in (1, 5000, 11_000, 10**6, 10**8)] == [1, 5, 6, 16, 1526]


def test_index_sides_hold_all_that_can_reach_a_floor(numbers):
    """A source term that is left out, or a posting, can belong to no pair above the floor."""
    vectors, model, _, _ = numbers
    blocked = nb.materialise(nb._blocked(vectors.filter(F.size("idx") > 0).withColumn("key", nb._vector_key()), None, model, 3, 16))
    floors = blocked.filter("source").select("id", F.lit(0.4).alias("floor"))
    asked, postings = nb._index_sides(blocked, floors, len(model.terms))
    looked = {(r.id, r.term) for r in asked.collect()}
    posted = {(r.id, r.term) for r in postings.collect()}
    rows = {r.id: (dict(zip(r.idx, r.weights)), r.source) for r in blocked.collect()}
    assert len(looked) < sum(len(v) for v, source in rows.values() if source)
    for x, (a, source) in rows.items():
        for y, (b, _) in rows.items():
            if source and sum(w * b.get(t, 0.0) for t, w in a.items()) >= 0.4:
                assert any((x, t) in looked and (y, t) in posted for t in a if t in b)


def test_tasks_do_not_grow_with_the_blocks(numbers, spark):
    vectors, model, _, _ = numbers
    blocked = nb._blocked(vectors.withColumn("key", nb._vector_key()), None, model, 5, 2)
    assert blocked.rdd.getNumPartitions() <= nb.task_count(spark)
    sizes = [r["count"] for r in blocked.groupBy("block").count().collect()]
    assert max(sizes) <= 2 and len(sizes) > 10 * nb.task_count(spark)


def test_more_sources_than_one_round_takes(numbers, monkeypatch):
    """They meet the catalog where it lies too, round by round, and no vector is shuffled."""
    vectors, model, ids, plain = numbers
    sources = vectors.filter("id % 2 = 0").select("id")
    monkeypatch.delattr(nb, "_many")
    monkeypatch.setattr(nb, "GROUP_ROWS", 32)
    want = {i: recs for i, recs in top(ids, plain, 5).items() if i % 2 == 0}
    assert lists(nb.neighbour_lists(vectors, model, 5, sources=sources, few=100)) == want


@pytest.mark.parametrize("few", [0, 100_000])
def test_some_sources(numbers, few, monkeypatch):
    vectors, model, ids, plain = numbers
    monkeypatch.setattr(nb, "MERGE_AFTER", 1)
    monkeypatch.setattr(nb, "BLOCK_ROWS", 16)
    sources = vectors.select("id").filter("id < 40 or id > 195")
    want = {i: v for i, v in top(ids, plain, 5).items() if i < 40 or i > 195}
    assert lists(nb.neighbour_lists(vectors, model, 5, sources=sources, few=few, block_rows=32)) == want


def test_padding_fills_with_first_ids(numbers):
    vectors, model, ids, plain = numbers
    got = lists(nb.neighbour_lists(vectors, model, 5, pad=True, block_rows=64))
    assert got == top(ids, plain, 5, pad=True)
    assert all(len(r) == 5 and i not in [x for x, _ in r] for i, r in got.items())


def test_text_ids(spark):
    vectors, model, ids, plain = case(spark, key=lambda i: f"B{i:04d}é", kind="string")
    assert lists(nb.neighbour_lists(vectors, model, 3, block_rows=50, pad=True)) == top(ids, plain, 3, pad=True)


def test_one_item(numbers):
    vectors, model, ids, plain = numbers
    terms = model.item_terms(vectors)
    for item in (0, 2, 1, 200):
        got = [(r.id, r.score) for r in nb.recommend_one(terms, item, 5, catalog=vectors).orderBy("rank").collect()]
        assert got == top(ids, plain, 5, pad=True)[item]
        got = [(r.id, r.score) for r in nb.recommend_one(terms, item, 5).orderBy("rank").collect()]
        assert got == top(ids, plain, 5)[item]
    assert nb.recommend_one(terms, -1, 5, catalog=vectors).count() == 0


def test_one_item_reads_its_own_postings(numbers, spark, tmp_path):
    vectors, model, ids, plain = numbers
    terms = model.item_terms(vectors)
    path = str(tmp_path / "postings")
    nb.term_postings(terms, 64).write.partitionBy("buckets", "bucket").parquet(path)
    postings = spark.read.parquet(path)
    for item in (0, 2, 1, 200, -1):
        one = nb.recommend_one(terms, item, 5, postings=postings)
        assert [(r.id, r.score) for r in one.orderBy("rank").collect()] == (top(ids, plain, 5)[item] if item >= 0 else [])
    found = nb.shared_postings(postings, ["w1", "w2"])
    text = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in text and "bucket" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term, [w1,w2])" in text.split("PushedFilters")[1]
    asked = text.split("PartitionFilters: [")[1].split("]")[0]
    assert 1 <= len(set(re.findall(r"\b\d+\b", asked.split("bucket#")[-1].split("IN")[-1]))) <= 2 < len(postings.inputFiles())
    spread = spark.read.parquet(path).groupBy("term").agg(F.count_distinct("bucket").alias("n")).filter("n > 1")
    assert spread.count() == 0


def test_postings_are_sorted_by_numbers(numbers, spark, tmp_path):
    """Rows of a file stand bucket by bucket and term by term, without comparing their terms."""
    vectors, model, _, _ = numbers
    terms = model.item_terms(vectors)
    rows = nb.term_postings(terms, 3)
    assert re.search(r"Sort \[bucket#\d+ ASC NULLS FIRST, place#\d+L ASC NULLS FIRST\], false", rows._jdf.queryExecution().toString())
    path = str(tmp_path / "postings")
    rows.write.partitionBy("buckets", "bucket").parquet(path)
    read = spark.read.parquet(path)
    assert sorted(read.select("id", "term", "weight").collect()) == sorted(terms.collect())
    files = {}
    for r in read.select("term", F.input_file_name().alias("file")).collect():
        runs = files.setdefault(r.file, [])
        if runs[-1:] != [r.term]:
            runs.append(r.term)
    assert files and all(len(runs) == len(set(runs)) for runs in files.values())


def test_many_terms_are_one_lookup(numbers, spark, tmp_path):
    """The rows of an item's many terms are checked by a hash, not term by term."""
    vectors, model, _, _ = numbers
    path = str(tmp_path / "postings")
    nb.term_postings(model.item_terms(vectors), 8).write.partitionBy("buckets", "bucket").parquet(path)
    found = nb.shared_postings(spark.read.parquet(path), WORDS)
    assert re.search(r"term#\d+ INSET ", found._jdf.queryExecution().optimizedPlan().toString())
    assert found.count() == model.item_terms(vectors).filter(F.col("term").isin(WORDS)).count()


def test_ranked_rows(numbers):
    vectors, model, _, _ = numbers
    rows = nb.ranked(nb.neighbour_lists(vectors, model, 5))
    assert rows.filter((F.col("score") <= 0) | (F.col("score") > 1) | (F.col("id") == F.col("rec_id"))).count() == 0
    assert rows.groupBy("id", "rank").count().filter("count > 1").count() == 0


def test_blocks_meet_once_and_move_once_per_group(numbers):
    """A row goes to as many cells as there are groups, and few sources leave the catalog in few places."""
    vectors, model, _, _ = numbers
    blocked = nb.materialise(nb._blocked(vectors.filter(F.size("idx") > 0).withColumn("key", nb._vector_key()), None, model, 5, 16))
    floors = blocked.filter("source").select("id", F.lit(0.4).alias("floor"))
    blocks = sorted(r.block for r in blocked.select("block").distinct().collect())
    rows = blocked.count()
    cells, n = nb._cells(blocked, floors, blocks, 3, None)
    assert n == 6 and cells.count() == 3 * rows
    assert {r.cell for r in cells.collect()} <= set(range(6))
    few = blocked.withColumn("source", F.col("source") & (F.col("id") < 40))
    cells, n = nb._cells(few, floors, blocks, 5, 1)
    assert n == 5 and cells.filter("side = 1").count() == rows
    assert cells.filter("side = 0").count() == 5 * few.filter("source").count()


def test_single_precision_only_rules_out():
    """Pairs that meet in single precision, ties and equal rows among them, give the double-precision lists."""
    rng = np.random.default_rng(4)
    table = []
    for i in range(90):
        idx = np.sort(rng.choice(40, rng.integers(1, 12), replace=False)) if i % 7 else np.array([1, 2, 3])
        weights = rng.integers(1, 4, len(idx)).astype(float)
        table.append({"id": i, "idx": idx.astype(np.int32), "weights": weights / np.linalg.norm(weights)})
    schema = pa.schema({"id": pa.int64(), "idx": pa.list_(pa.int32()), "weights": pa.list_(pa.float64())})
    rows = pa.Table.from_pylist(table, schema).combine_chunks()
    a, b = sparse.Rows.of(rows.slice(0, 40).combine_chunks()), sparse.Rows.of(rows.slice(40).combine_chunks())
    left, right = sparse.Block(a, 40), sparse.Block(b, 40)
    lists, others = sparse.Lists(np.zeros(40), 6), sparse.Lists(np.zeros(50), 6)
    row, col, value = sparse.meet(left, right, 6, lists.floor, others.floor)
    lists.add(row, col, value)
    others.add(col, row, value)

    def plain(found):
        return [(r["id"], r["rec_id"], r["score"]) for r in found.to_pylist()]

    row, col, value = lists.result()
    assert list(zip(row, col + 40, value)) == plain(sparse.best_targets(a, b, 40, 6))
    row, col, value = others.result()
    assert list(zip(row + 40, col, value)) == plain(sparse.best_targets(b, a, 40, 6))


def test_partners_that_repeat_take_one_place():
    """An id that is there twice is one partner, and its score does not lift the floor twice."""
    lists = sparse.Lists(np.zeros(1), 2, unique=False)
    lists.add(np.array([0, 0]), np.array([3, 3]), np.array([0.9, 0.9]))
    lists.add(np.array([0]), np.array([1]), np.array([0.5]))
    assert [v.tolist() for v in lists.result()] == [[0, 0], [3, 1], [0.9, 0.5]]
