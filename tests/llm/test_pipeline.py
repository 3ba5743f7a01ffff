import duckdb
import pytest
from test_jaccard import near_five, plain_components, plain_groups
from tokenizers import Tokenizer

import corpus_pipeline
from shelfkin.lineage import materialise
from shelfkin.llm import decontaminate, sql


@pytest.fixture(scope="module")
def steps(spark, data_dir):
    """What goes into each stage and what the last gives, as rows."""
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], data_dir)))
    return [df.columns for df in out], [{r.doc_id: r for r in df.collect()} for df in out]


def test_columns_and_counts(steps, spark, data_dir):
    columns, rows = steps
    assert all(c == columns[0] for c in columns[:-1])
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:], strict=False))
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, data_dir).collect()} == {i: r.ids for i, r in rows[-1].items()}


def test_languages_keep_clean_texts(steps):
    _, (docs, named, *_) = steps
    assert all(any(c.isalpha() for c in r.text) for r in named.values())
    assert len(named) >= 0.99 * sum(any(c.isalpha() for c in r.text) for r in docs.values())


def test_lines_equal_sql(steps):
    _, rows = steps
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", [(i, r.text) for i, r in rows[1].items()])
    found = db.execute(f"select doc_id, text, n_dropped from ({sql.LINE_DEDUP})").fetchall()
    want = {i: t for i, t, n in found if not n or t.strip(" \t\r\n\x0b\x0c")}
    assert {i: r.text for i, r in rows[2].items()} == want
    assert all(r.n_chars == len(r.text) for r in rows[2].values())


def test_one_of_each_group_stays(steps):
    _, rows = steps
    group = plain_components({i: r.text for i, r in rows[2].items()})
    assert set(rows[3]) == {c for _, c in group.values()}


def test_one_of_each_group_by_five_words_stays(steps, spark, data_dir):
    """The stage asks for five words and 80 %, not for the four words and 85 % of op4."""
    _, rows = steps
    group = plain_groups({i: r.text for i, r in rows[2].items()}, 80, 5)
    assert set(rows[3]) == {c for _, c in group.values()}
    texts = near_five()
    group = {c for _, c in plain_groups(texts, 80, 5).values()}
    assert group < {c for _, c in plain_groups(texts, 85, 4).values()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, data_dir).collect()} == group


def test_leaks_go(steps, spark, data_dir):
    _, rows = steps
    items = [decontaminate._word_list(r.text.lower()) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    def leaked(text):
        body = decontaminate._word_list(text.lower())
        return any(decontaminate.distance_within(x, body) <= decontaminate.edits(len(x), decontaminate.SHARE) for x in items)
    assert set(rows[4]) == {i for i, r in rows[3].items() if not leaked(r.text)}


def test_ids_equal_library(steps):
    _, rows = steps
    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    assert set(rows[5]) == set(rows[4])
    assert all(r.ids == library.encode(rows[4][i].text, add_special_tokens=False).ids for i, r in rows[5].items())


def test_empty_documents(spark, data_dir, tmp_path):
    none = spark.read.parquet(f"{data_dir}/documents.parquet").limit(0)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, data_dir):
    """Repeated rows, ids shared or missing, null texts and columns whose names operators use."""
    some = [r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t, "en", 0.5, "x", 7) for i, t in enumerate(some)]
    rows += [rows[3], rows[3], (None, some[5], "en", 0.1, "y", 1), (None, None, None, None, None, None), (8, some[9] + " more", "en", 0.2, "z", 2), (99, "", "", 0.3, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, root string, n long").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = materialise(stage(spark, docs, data_dir))
        assert left.columns == docs.columns, name
        assert left.count() <= docs.count()
        docs = left
    assert docs.filter("text is null").count() == 0 and docs.count() > 20
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data_dir)
    assert last.count() == docs.count()
