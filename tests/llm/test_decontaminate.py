import random

import pytest

from shelfkin.llm import decontaminate as d
from shelfkin.llm import queries

SCHEMA = "doc_id long, text string, distance int"
VOCABULARY = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ["n", "r", "st", "l", "m"]]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at : at + (kind > 0)] = [rng.choice(VOCABULARY)] if kind < 2 else []
    return words


def plain_distance(item, passage):
    above = [0] * (len(passage) + 1)
    for i, x in enumerate(item, 1):
        row = [i]
        for j, y in enumerate(passage, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return min(above)


def test_bit_parallel_distance_equals_table():
    rng = random.Random(3)
    for _ in range(200):
        item = [rng.choice("abcd").encode() for _ in range(rng.randint(1, 70))]
        passage = [rng.choice("abcd").encode() for _ in range(rng.randint(0, 90))]
        assert d.distance_within(item, passage) == plain_distance(item, passage)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    items = {i: prose(rng, rng.randint(8, 70)) for i in range(60)}
    docs = {}
    for n in range(400):
        body = prose(rng, rng.randint(0, 200))
        if n % 2:
            item = items[n % 60]
            part = edited(rng, item, rng.randint(0, d.edits(len(item), d.SHARE)))
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs[n] = body
    table = spark.createDataFrame([(k, " ".join(v).title() + "." * (k % 3), 5) for k, v in docs.items()], SCHEMA)
    bench = spark.createDataFrame([(k, ", ".join(v)) for k, v in items.items()], "item_id long, text string")
    return items, docs, table, bench


def test_recall_and_precision_against_brute_force(planted):
    items, docs, table, bench = planted
    coded = {k: [w.encode() for w in v] for k, v in items.items()}
    want = {}
    for n, body in docs.items():
        body = [w.encode() for w in body]
        for i, item in coded.items():
            if (x := d.distance_within(item, body)) <= d.edits(len(item), d.SHARE):
                want[n, i] = x
    got = {(r.doc_id, r.item_id): r.distance for r in d.leaks(table, bench).collect()}
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(want) > 150 and len(got) >= 0.95 * len(want)


@pytest.mark.parametrize("crowded", [False, True])
def test_recall_per_length_at_the_largest_distance(spark, crowded):
    """Exactly a fifth of the words edited, all over the item or as close together as fits."""
    rng = random.Random(19 + crowded)
    lengths, each = [10, 20, 23, 24, 30, 45, 59, 100, 160, 250, 400], 40
    items = {k: prose(rng, n) for k, n in enumerate(n for n in lengths for _ in range(each))}
    docs = []
    for k, item in items.items():
        most = d.edits(len(item), d.SHARE)
        part = list(item)
        first = rng.randint(0, len(item) - 2 * most)
        places = range(first, first + 2 * most) if crowded else range(len(item))
        for at in sorted(rng.sample(places, most), reverse=True):
            kind = rng.randrange(3)
            part[at : at + (kind > 0)] = [rng.choice(VOCABULARY)] if kind < 2 else []
        docs.append((k, " ".join(prose(rng, 30) + part + prose(rng, 30)), 0))
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    found = d.leaks(spark.createDataFrame(docs, SCHEMA).repartition(4), bench).collect()
    assert all(plain_distance(items[r.item_id], docs[r.doc_id][1].split()) == r.distance for r in found[::29])
    got = {r.doc_id for r in found if r.doc_id == r.item_id}
    recall = {n: sum(j * each <= k < (j + 1) * each for k in got) / each for j, n in enumerate(lengths)}
    assert min(recall.values()) >= 0.93 and len(got) >= 0.95 * len(items), recall


def test_where_the_passage_starts(spark):
    rng = random.Random(23)
    item, body = prose(rng, 150), prose(rng, 700)
    body[120:120] = edited(rng, item, 12)
    body[600:600] = item
    docs = spark.createDataFrame([(1, " ".join(body), 0)], SCHEMA)
    found = d.leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.distance, r.n_words, r.first_word) for r in found] == [(0, 150, 600)]


def test_clean_keeps_columns_and_clean_rows(planted):
    _, docs, table, bench = planted
    kept = d.clean(table, bench)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} >= {n for n in docs if n % 2 == 0}


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, item, 0), (3, item, 0), (None, "so " + item.upper() + " yes", 0), (5, "one two", 0),
         (6, "word " * 50_000 + item, 0)], SCHEMA)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "one two"), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in d.leaks(docs, bench).collect()}
    assert got == {(x, y, 0) for x in (3, None, 6) for y in (1, None)}
    assert d.leaks(docs, bench.limit(0)).count() == 0 and d.leaks(docs.limit(0), bench).count() == 0
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == [1, 2, 5]


def test_query(spark, data_dir):
    docs = {r.doc_id: d._word_list(r.text.lower()) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    items = {r.item_id: d._word_list(r.text.lower()) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()}
    want = {(n, i) for n, body in docs.items() for i, item in items.items()
            if set(item) & set(body) and d.distance_within(item, body) <= d.edits(len(item), d.SHARE)}
    assert {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, data_dir).collect()} == want


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    item = " ".join(f"word{k}" for k in range(20))
    clean = " ".join(f"other{k}" for k in range(60))
    rows = [(1, f"x {item} y", "i"), (1, clean, "i"), (None, f"{clean} {item}", "i"), (None, clean, "i"), (None, None, "i"), (2, item, "i"), (2, item, "i"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    benchmark = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    kept = d.clean(docs, benchmark)
    assert kept.columns == docs.columns
    want = [rows[1], rows[3], rows[4], rows[7]]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))


def test_bitmaps_grow_with_the_benchmark():
    assert d.bitmap_bits(0) == d.bitmap_bits(100_000) == 22
    assert d.bitmap_bits(4_200_000) == 28
    assert d.bitmap_bits(10**12) == 30
