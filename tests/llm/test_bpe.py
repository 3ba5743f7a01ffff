import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfkin.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.vocabulary(bpe.read_source(PATH))
TEXTS = [
    "", " ", "It's what they'd've said: don't! 3.14 été ÉTÉ", "ΟΔΟΣ ΣΣ. İstanbul",
    "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext", "日本語のテキスト 🙂🙂‍", "x y z\x1cq\x85w",
    "zq" * 400, "the" * 5000, "²Ⅷ ½ a1b2", "''s '''re", "A퟿B", "ßẞ ﬁ",
]


def same(text: str) -> None:
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(OURS.encode(text), np.int32)
    assert got.tolist() == want
    assert OURS.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cn", "Cs"]), max_size=60))
def test_equals_library_on_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeghinorst'", max_size=300))
def test_equals_library_on_letters(text):
    same(text)


def test_long_and_short_merging_agree():
    ids = [OURS.inner[b] for b in b"thereintheandingtion" * 9]
    assert OURS._merge(list(ids)) == OURS._merge_long(list(ids))


def test_cuts_are_pairs_no_token_holds():
    word = "qxzwjvthe".encode()
    pieces = OURS.cuts(word)
    assert b"".join(pieces) == word and len(pieces) > 1
    inside = [t.removesuffix("</w>") for t in OURS.tokens]
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert not any(chr(a[-1]) + chr(b[0]) in t for t in inside)


def test_query(spark, data_dir):
    rows = queries.op5_bpe(spark, data_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, 7), (1, None, 7), (None, "", 8), (3, "the cat", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.digests(docs, bpe.read_source(PATH), keep_ids=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(r.n_tokens for r in got) == [0, 0, 0, 2]
    assert all(r.ids_sha256 == r.decoded_sha256 == empty for r in got if not r.n_tokens)
    assert bpe.digests(docs.limit(0), bpe.read_source(PATH)).count() == 0


def test_columns_agree_with_the_round_trip(spark):
    docs = spark.createDataFrame([(1, "the cat's 3 été"), (2, None)], "doc_id long, text string")
    source = bpe.read_source(PATH)
    both = docs.withColumn("ids", bpe.encoded(spark, docs.text, source))
    both = both.withColumn("decoded", bpe.decoded(spark, both.ids, source)).drop("text")
    assert sorted(both.collect()) == sorted(bpe.round_trip(docs, source).collect())
