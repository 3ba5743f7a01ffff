import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from shelfkin.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score double, rank int, weight string, bucket long"


def grams(text, longest=1):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def plain(docs, target, longest=1, buckets=10_000, share=10, least=20, seed=2024):
    def cell(g):
        return zlib.crc32(g.encode()) % buckets

    s = Counter(cell(g) for _, t in docs for g in grams(t, longest)[0])
    t = Counter(cell(g) for x in target for g in grams(x, longest)[0])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        found, n_words = grams(text, longest)
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[cell(g)] for g in found)
        rows.append((i, n_words, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    drawn = able[: share * len(able) // 100]
    out = Counter((*r, k) for k, r in enumerate(drawn, 1))
    left = Counter(rows)
    left.subtract(Counter(drawn))
    out.update({(*r, None): n for r, n in left.items() if n})
    return out


DOCS = [
    (1, "Big DATA, big dätä? " * 8), (2, None), (3, ""), (4, "... --- !"), (5, "a" * 50_000), (6, "w " * 30_000),
    (7, "zebra apple data " * 9), (7, "zebra apple data " * 9), (8, "zebra apple data " * 9), (None, "apple ß0 " * 20),
    (None, None), (9, "\x00one\x7ftwo{three}" * 10),
    *[(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 50))) for i in range(10, 120)],
]
TARGET = ["big data apple", "Zebra data", None, "w3 w5 w5"]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (1, 7), (3, 1_000)])
def test_equals_plain(spark, longest, buckets):
    docs = spark.createDataFrame([(i, t, 0.5, 1, "x", 3) for i, t in DOCS], SCHEMA).repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = importance.ranked(importance.scored(docs, target, longest, buckets))
    got = Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect())
    assert got == plain(DOCS, TARGET, longest, buckets)


def test_drawn_rows_keep_their_columns(spark):
    rows = [(i, t, 0.5, 1, "x", 3) for i, t in DOCS if i is not None]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = importance.resampled(docs, target, share=30)
    want = plain([r[:2] for r in rows], TARGET, share=30)
    assert found.columns == docs.columns
    assert sorted(r.doc_id for r in found.collect()) == sorted(k[0] for k in want.elements() if k[5] is not None)


def test_interning_tells_equal_keys_apart():
    """All n-grams with one key: only their bytes tell them apart."""
    texts = [b"aa", b"ab", b"b", b"aa", b"b", b"aab", b"ab", b"aa"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    slot, owner = importance.intern(data, end - [len(t) for t in texts], end, np.full(len(texts), 5, np.uint64))
    assert len(set(slot.tolist())) == 4
    assert all((slot[i] == slot[j]) == (texts[i] == texts[j]) for i in range(8) for j in range(8))
    assert all(texts[owner[s]] == t for s, t in zip(slot, texts, strict=True))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.ranked(importance.scored(docs, target)).count() == 0
    assert importance.resampled(docs, target).count() == 0
    one = spark.createDataFrame([(1, "a b", 0.0, 1, "", 1)], SCHEMA)
    got = importance.ranked(importance.scored(one, target.limit(0))).collect()
    assert [(r.n_features, r["rank"]) for r in got] == [(2, None)]


def test_slices_agree():
    texts = pa.array([t for _, t in DOCS])
    whole = importance.Interned(texts, 2, 50)
    cells = np.bincount(whole.bucket, whole.count, 50)
    parts = [importance.Interned(texts.slice(k, 1), 2, 50) for k in range(len(texts))]
    assert (cells == sum(np.bincount(p.bucket, p.count, 50) for p in parts)).all()


def test_no_text_is_shuffled(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    plan = importance.bucket_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(bucket" in plan


def test_query_equals_plain(spark, data_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    got = Counter(tuple(r) for r in queries.op11_importance(spark, data_dir).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == Counter({(i, f, w, s, k): n for (i, _, f, w, s, k), n in plain(docs, target).items()})
