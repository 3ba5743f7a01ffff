import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfkin.llm import language, queries

ENGLISH = ["the house and the garden are with the old tree", "there is nothing that the children would rather have"]
GERMAN = ["das haus und der garten sind bei dem alten baum", "es gibt nichts was die kinder lieber haben würden"]


@pytest.fixture(scope="module")
def model():
    return language.train(ENGLISH * 6 + GERMAN * 6, ["en"] * 12 + ["de"] * 12, epochs=20)


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    score, steps = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    first, length = np.array([0, 4]), np.array([4, 3])
    pairs = np.zeros((3, 3))
    got = language.forward_backward(score, first, length, steps, pairs)
    want, want_pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for a, n in zip(first, length, strict=True):
        paths = list(itertools.product(range(3), repeat=int(n)))
        mass = np.array([
            np.exp(sum(score[a + t, p[t]] for t in range(n)) + sum(steps[p[t], p[t + 1]] for t in range(n - 1)))
            for p in paths
        ])
        for p, m in zip(paths, mass / mass.sum(), strict=True):
            for t in range(n):
                want[a + t, p[t]] += m
            for t in range(n - 1):
                want_pairs[p[t], p[t + 1]] += m
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_code_switched_words(model):
    text = "the children are with the old tree und die kinder sind bei dem alten baum"
    words = language.words_of(pa.array([text]))
    chance = language.forward_backward(language.emissions(words, model), np.array([0]), np.array([15]), model.steps)
    assert [model.languages[k] for k in chance.argmax(axis=1)] == ["en"] * 7 + ["de"] * 8


def test_words_do_not_cross_rows(model):
    both = language.words_of(pa.array(["haus", None, "", "garten Ünder", "日本 x"]))
    assert both.row.tolist() == [0, 3, 3, 4, 4]
    alone = language.words_of(pa.array(["garten Ünder"]))
    assert np.array_equal(both.whole[1:3], alone.whole)
    assert np.array_equal(both.own[0][1:3], alone.own[0])


def test_odd_rows_and_clashing_columns(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 -- !", "c"), (None, "das haus", "d"), (5, "the house", "e"),
            (5, "the house", "e"), (6, "the garden and " * 20_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {(r.doc_id, r.score): r.language for r in language.identify(docs, model).collect()}
    assert [got[k].lang_pred for k in [(1, "a"), (2, "b"), (3, "c")]] == ["und"] * 3
    assert got[1, "a"].score == 0 and got[None, "d"].lang_pred == "de" and got[5, "e"].lang_pred == "en"
    assert got[6, "f"].n_words == 60_000 and got[6, "f"].lang_pred == "en"
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(empty)
    assert model.languages == [] and language.identify(empty, model).count() == 0
    some = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify(some, model).first().language.lang_pred == "und"


def test_sample_leaves_held_out_rows_alone(spark):
    docs = spark.range(100).selectExpr("id as doc_id", "cast(id as string) as text", "'en' as lang")
    texts = {int(r.text) for r in language.training_sample(docs, 1000).collect()}
    assert texts == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5}
    assert language.training_sample(docs, 10).count() == 10


def test_held_out_accuracy(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "lang")
    rows = queries.op3_language(spark, data_dir).join(docs, F.col("doc_id") == F.col("id")).filter("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
