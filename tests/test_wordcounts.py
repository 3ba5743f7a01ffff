import random
from collections import Counter

import numpy as np
import pytest

from shelfkin.operators import tfidf, wordcounts


def make(spark, n=300):
    rng = random.Random(4)
    draw = lambda: f"w{min(int(rng.paretovariate(0.7)), 300)}é"
    rows = [(f"i{i % 290}", [draw() for _ in range(rng.choice([0, 1, 2, 30]))]) for i in range(n)] + [(None, ["w1é", "w1é", "w1é"])]
    return rows, spark.createDataFrame(rows, "id string, words array<string>").repartition(3)


@pytest.mark.parametrize("slice_bytes", [1, 30, 1 << 22])
def test_totals_of_a_slice(slice_bytes, spark, monkeypatch):
    monkeypatch.setattr(wordcounts, "SLICE_BYTES", slice_bytes)
    rows, df = make(spark)
    batches = tfidf._joined(df).toArrow().to_batches()
    uses, holds = Counter(), Counter()
    for _, w in rows:
        terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        uses.update(terms)
        holds.update(set(terms))
    got, has = Counter(), Counter()
    for b in wordcounts.totals(iter(batches), np.ones(64, bool)):
        for r in b.to_pylist():
            got[r["term"]] += r["cf"]
            has[r["term"]] += r["df"]
    assert got == uses and has == holds
    (sums,) = wordcounts.cell_sums(iter(batches), 64)
    assert sum(sums["n"].to_pylist()) == uses.total()
    # A marked cell holds all of a term or nothing.
    half = np.arange(64) % 2 == 0
    parts = [Counter(), Counter()]
    for part, marked in zip(parts, (half, ~half)):
        for b in wordcounts.totals(iter(batches), marked):
            part.update(dict.fromkeys(b["term"].to_pylist(), 1))
    assert not parts[0].keys() & parts[1].keys() and parts[0].keys() | parts[1].keys() == uses.keys()


@pytest.mark.parametrize("max_features, first", [(3, 1), (60, 40), (5000, 1)])
def test_vocabulary_and_vectors_are_those_of_the_terms(spark, monkeypatch, first, max_features):
    monkeypatch.setattr(tfidf, "CELLS", 64)
    _, df = make(spark)
    terms = tfidf.with_terms(df)
    want = tfidf.vocabulary(terms, max_features)
    assert sorted(tfidf.word_vocabulary(df, max_features, first=first).collect()) == sorted(want.collect())
    model = tfidf.TfidfModel.of(want)
    key = lambda r: (r.id or "", r.idx, r.weights)
    assert sorted(map(key, model.word_vectors(df).collect())) == sorted(map(key, model.vectors(terms).collect()))


def test_terms_never_leave_the_counting(spark):
    """Fitting and weighing make no row per use of a term."""
    _, df = make(spark)
    model = tfidf.fit_words(df)
    plan = model.word_vectors(df)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "bigram" not in plan
    _, weighed = tfidf.fit_vectors(spark.createDataFrame([(1, "aa bb"), (2, "aa bb")], "id bigint, text string"))
    assert "CountVectorizer" not in weighed._jdf.queryExecution().toString() and "MapInArrow" in weighed._jdf.queryExecution().toString()
