import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfkin.llm import components, jaccard, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, n string"


def plain_set(text):
    w = WORDS.findall((text or "").translate(SMALL))
    if len(w) < 4:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3))


def plain_components(texts, share=85):
    held = {i: plain_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in held.items():
        for x in s:
            holders[x].append(i)
    common = collections.Counter((a, b) for v in holders.values() for n, a in enumerate(v) for b in v[n + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= share * (len(held[a]) + len(held[b]) - n):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: (len(held[i]), find(i)) for i in texts}


def corpus(seed):
    """Groups of copies with a few changed words, passages that many texts share, and loners."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    passage = [rng.choice(words) for _ in range(40)]
    texts, n = {}, 0
    for size in [120, 40, 9, 5, 3, 2, 2, 2]:
        base = [rng.choice(words) for _ in range(rng.randint(60, 220))]
        for k in range(size):
            own = list(base)
            for _ in range(0 if k == 0 else rng.randint(0, max(2, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[n] = " ".join(own)
            n += 1
    for _ in range(120):
        own = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(own))
        own[at:at] = passage
        texts[n] = " ".join(own)
        n += 1
    for _ in range(60):
        texts[n] = texts[rng.randrange(n)]
        n += 1
    order = list(texts)
    rng.shuffle(order)
    return {i: texts[k].title() if i % 5 == 0 else texts[k] for i, k in enumerate(order)}


@pytest.mark.parametrize("hot", [3, 64])
def test_components_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    texts = corpus(hot)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == plain_components(texts)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for n, c in got.values() if n}| {i for i, (n, _) in got.items() if not n}


def plain_groups(texts, share, size):
    """Components of sets of ``size`` words, every pair compared."""
    held = {}
    for i, t in texts.items():
        w = WORDS.findall((t or "").translate(SMALL))
        held[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            both = len(held[a] & held[b]) if a < b and root[a] != root[b] else 0
            if both and 100 * both >= share * len(held[a] | held[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    return {i: (len(held[i]), root[i]) for i in texts}


def near_five():
    """Texts with a fifth added, of which five words at 80 % make one group and four at 85 % none."""
    rng = random.Random(4)
    texts = {}
    for n in range(0, 40, 2):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        texts[n] = " ".join(base)
        texts[n + 1] = " ".join(base + [f"w{rng.randrange(5000)}" for _ in range(rng.choice([19, 24, 30]))])
    return texts


def test_length_of_shingles_is_an_argument(spark):
    for texts in (near_five(), corpus(5), {1: "a b c d", 2: "A b c d", 3: "a b c d e", 4: "a b c", 5: ""}):
        docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA).repartition(5)
        for share, size in ((80, 5), (85, 4)):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, share, size).collect()}
            assert got == plain_groups(texts, share, size)


def test_shuffle_route_of_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SENT_IDS", 0)
    texts = corpus(8)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()} == plain_components(texts)


def test_prefixes_keep_every_link():
    """Any two linked sets share as many prefix shingles as both ask for, whatever the counts."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = rng.permutation(1000)[:n]
        b = np.unique(np.concatenate([rng.permutation(a)[: rng.integers(max(1, n * 8 // 10), n + 1)], rng.integers(1000, 2000, rng.integers(0, 12))]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        weight = rng.permutation(2000)
        asked, cut = [], []
        for s in (a, b):
            least = jaccard.need(len(s))
            l = int(rng.integers(1, least + 1))
            asked.append(l)
            cut.append(s[np.argsort(weight[s])][: len(s) - least + l])
        assert len(np.intersect1d(*cut)) >= min(asked)


def test_sets_equal_plain():
    texts = ["", None, "a", "a b", "A B c", "a b c d", "a\tb\x0bc\nd  a b c d", "é È x\x1cy z", "one two three four five " * 30]
    got = {r: len(h) for r, h, _ in jaccard.sets(pa.array(texts, pa.string()))}
    assert got == {i: len(plain_set(t)) for i, t in enumerate(texts) if plain_set(t)}
    same = {c for _, _, c in jaccard.sets(pa.array(["a b c d", "A  B\nC D"]))}
    assert len(same) == 1 and len({c for _, _, c in jaccard.sets(pa.array(["a", "a a", "a a a", "a a a a", "b"]))}) == 5


def test_odd_rows(spark):
    long = "x y z q r s t " * 30_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A b"), (5, "A b"), (None, "c d e f g"), (7, "c d e f g"), (8, long), (9, long)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 2, 7), (7, 2, 7), (8, 7, 8), (9, 7, 8)], key=repr)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """Ids do not name texts: null or repeated ids stand on different ones."""
    words = [f"w{i}" for i in range(120)]
    near = [*words[:60], "other", *words[61:]]
    rows = [(None, " ".join(words)), (None, "x y z q r s"), (3, " ".join(near)), (3, "a b c d e f g"), (2, "a b c d e f g"), (9, " ".join(reversed(words)))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 117, 3), (None, 3, None), (3, 117, 3), (3, 4, 2), (2, 4, 2), (9, 117, 9)], key=repr)


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    root = {r.node: r.root for r in components.components(edges).collect()}
    assert len({root[i] for i in range(41)}) == 1 and len({root[i] for i in range(100, 130)}) == 1
    assert len(set(root.values())) == 2 and 500 not in root


def test_query(spark, data_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_jaccard(spark, data_dir).collect()}
    assert got == plain_components(texts)


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    """Repeated rows, ids shared by different texts, null ids and clashing columns."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [
        (5, a, "s", 1, "x"), (5, a, "s", 1, "x"),           # repeated: one stays
        (None, b, "s", 1, "x"), (None, b, "s", 1, "x"), (7, b, "t", 2, "y"),  # the row with an id stays
        (8, a + " z", "s", 1, "x"), (8, c, "u", 3, "z"),    # same id: one is a copy of 5, the other its own text
        (None, d, "s", 1, "x"), (None, d, "s", 1, "x"),     # no id at all: one stays
        (9, None, "s", 1, "x"), (9, None, "s", 1, "x"), (10, "", "s", 1, "x"), (10, "...", "s", 1, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string, n long, component_id string").repartition(3)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = [rows[0], rows[4], rows[6], rows[7], *rows[9:11], rows[11]]
    got = [tuple(r) for r in kept.collect()]
    assert sorted(map(repr, (g for g in got if g[0] != 10))) == sorted(map(repr, (w for w in want if w[0] != 10)))
    assert len([g for g in got if g[0] == 10]) == 2
