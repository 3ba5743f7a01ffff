import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from shelfkin.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, mask int, n long, part string"
LONG = " ".join(f"word{k}" for k in range(70))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, None), (4, None, "a"), (5, "", "b"), (None, LONG, "b"), (None, None, "b"),
    (6, LONG + " #", "b"), (7, "x " * 100, "b"), (8, LONG.upper(), ""), (8, LONG.upper(), ""), (9, LONG.upper(), "b"),
    (10, "É " * 60, "b"), (11, "A" * 40_000, "c"), (12, "z y\x0bw\x1cv\n" * 20_000, "c"), (13, LONG + " Z" * 40, "c"),
    (14, "unique " + LONG, "c"), (15, "x " * 100, "a"), (15, "x  " * 100, "a"), (3, "x " * 100, "a"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, None, 1), (8, 1, None), (15, 0, 1), (99, 1, 1), (None, 1, 1)]


def plain_masks(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = [
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and first[t] < i,
        ]
        out.append((i, part or "", sum(f << k for k, f in enumerate(fails))))
    return out


def plain_rows(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    masks = plain_masks(docs)
    out = {}
    for part in {p for _, p, _ in masks}:
        mine = [(i, m) for i, p, m in masks if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(1 for _, m in mine if m & bit) - len(gone), sum(1 for _, m in mine if m == bit),
                    sum(1 for i, _ in gone if i in good), sum(1 for i, _ in gone if i in toxic),
                ]
    total = Counter()
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] += row[1]
    return {(*k, *row, total[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def tables(spark, docs=DOCS, labels=LABELS):
    rows = [(*d, 7, 7, "clash") for d in docs]
    return (spark.createDataFrame(rows, SCHEMA).repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("most", [audit.MOST_CELLS, 1])
def test_equals_plain_with_and_without_the_filter(spark, most):
    docs, labels = tables(spark)
    masks = audit.masks(docs, most)
    got = Counter({(r.doc_id, r.part, r["mask"]): 0 for r in masks.collect()})
    for r in masks.collect():
        got[r.doc_id, r.part, r["mask"]] += r.n
    assert got == Counter(plain_masks(DOCS))
    rows = audit.interactions(audit.mask_counts(masks, labels))
    assert {tuple(r) for r in rows.collect()} == plain_rows(DOCS, LABELS)


def test_filter_never_clears_a_repeat(spark):
    """Every repeated text stays possible, however full the filter is; nearly all others are cleared."""
    rows = [(i, f"text {i % 6000 if i < 7000 else i}", "a") for i in range(20_000)]
    docs, _ = tables(spark, rows)
    plane = audit.repeat_plane(docs)
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    count = Counter(t for _, t, _ in rows)
    again = np.array([h for t, h in hashes.items() if count[t] > 1])
    alone = np.array([h for t, h in hashes.items() if count[t] == 1])
    assert audit.may_repeat(again, plane).all()
    assert audit.may_repeat(alone, plane).mean() < 0.02
    full = np.full(audit.BLOCK // 8, 255, np.uint8)
    assert audit.may_repeat(alone, full).all()


def test_only_possible_repeats_carry_text(spark):
    rows = [(i, LONG + str(i % 9000), "a") for i in range(9_100)]
    docs, _ = tables(spark, rows)
    facts = audit._facts(docs, audit.MOST_CELLS)
    held = Counter(r.repeat for r in facts.filter("repeat is not null").collect())
    assert all(held[LONG + str(i)] == 2 for i in range(100)) and len(held) < 300
    assert facts.count() == 9_100


def test_empty_tables(spark):
    docs, labels = tables(spark, [], [])
    assert audit.masks(docs).count() == 0
    assert audit.interactions(audit.mask_counts(audit.masks(docs), labels)).count() == 0


def test_cells_grow_with_the_table():
    assert audit.cell_count(0) == audit.BLOCK
    assert audit.cell_count(10**6) == 1 << 24
    assert audit.cell_count(1 << 26) == 1 << 30
    assert audit.cell_count((1 << 26) + 1) == 0
