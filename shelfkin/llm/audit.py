"""How a chain of document filters interacts, for every order the filters could run in.

Each document gets a mask of the filters it fails. Four filters look at the text alone; the fifth
fails every document whose whole text stands under a smaller id elsewhere in the table. Counts of
masks add up, so all orders follow from at most ``2 ** filters`` counts per part.

Repeats are found in two steps. Text hashes go into a counting Bloom filter: each task counts the
cells of its own texts up to two, cells of one block are merged in one place, and only the plane
of cells counted twice or more is kept. A text with a cell below two stands alone, for certain.
Texts that may repeat are written out, and only they are shuffled: whole texts are grouped for
their smallest id, and a row that is not its text's first fails.

The filter has ``CELLS_PER_TEXT`` cells per row and is broadcast, so ``most_cells`` bounds it
(2^30 cells are 128 MB, enough for 64 million rows). Tables beyond that skip it and group all
texts: the same result for a larger shuffle.

Defined results: a null text counts as an empty one; a null id is never smaller and never fails as
a repeat; equal rows (same id, same text) are not repeats of each other; a null source is the part
of the empty string; an id with several label rows counts as good (toxic) if one of them says so.
Other columns are not looked at; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfkin.lineage import materialise
from shelfkin.llm.arrow import flat, mix, slices
from shelfkin.shipping import ship

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "#$%&*|"
CELLS_PER_TEXT, PROBES = 16, 3
BLOCK = 1 << 18
MOST_CELLS = 1 << 30
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in SYMBOLS]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


# ---------------------------------------------------------------- the counting Bloom filter


def _whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def cell_count(rows: int, most: int = MOST_CELLS) -> int:
    """Cells for so many rows: a power of two, a block at least; 0 where ``most`` is too few for
    the filter to clear anything worth its cost."""
    cells = max(BLOCK, 1 << (CELLS_PER_TEXT * rows - 1).bit_length())
    return cells if cells <= most else 0


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """The ``PROBES`` cells of every hash, all in one block."""
    h = hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        block = (mix(h) % np.uint64(cells // BLOCK)).astype(np.int64) * BLOCK
        inner = mix(h + np.uint64(0x9E3779B97F4A7C15))
    probes = [((inner >> np.uint64(18 * k)) % np.uint64(BLOCK)).astype(np.int64) + block for k in range(PROBES)]
    return np.stack(probes, axis=1)


def repeat_plane(docs: DataFrame, most_cells: int = MOST_CELLS) -> np.ndarray | None:
    """Bits of the cells that two or more texts (or equal probes) fell on; null where the table is
    too large for the filter."""
    cells = cell_count(docs.count(), most_cells)
    if not cells:
        return None
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [batch.column(0).to_numpy() for batch in batches]
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        cell, n = np.unique(cells_of(hashes, cells), return_counts=True)
        block, first = np.unique(cell // BLOCK, return_index=True)
        ends = np.append(first[1:], len(cell))
        once, twice = [], []
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):
            inner = (cell[a:b] % BLOCK).astype(np.uint32)
            once.append(inner[n[a:b] == 1].tobytes())
            twice.append(inner[n[a:b] > 1].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["block", "once", "twice"]
        )

    def merge(parts: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint8)
        for once, twice in zip(parts["once"].to_pylist(), parts["twice"].to_pylist(), strict=True):
            one = np.frombuffer(once, np.uint32)
            total[one] = np.minimum(total[one] + 1, 2)
            total[np.frombuffer(twice, np.uint32)] = 2
        plane = np.packbits(total > 1).tobytes()
        return pa.table({"block": parts["block"].slice(0, 1), "plane": pa.array([plane], pa.binary())})

    sketches = docs.select(F.xxhash64(_whole(F.col("text")))).mapInArrow(count, "block long, once binary, twice binary")
    merged = sketches.groupBy("block").applyInArrow(merge, "block long, plane binary")
    out = np.zeros(cells // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.plane, np.uint8)
    return out


def may_repeat(hashes: np.ndarray, plane: np.ndarray) -> np.ndarray:
    cell = cells_of(hashes, len(plane) * 8)
    return ((plane[cell // 8] >> (7 - cell % 8).astype(np.uint8)) & 1).all(axis=1)


# ---------------------------------------------------------------- masks


def text_masks(column: pa.Array) -> np.ndarray:
    """The filters that every text fails by itself."""
    data, at = flat(column)
    raw = data.tobytes()
    n = len(column)
    count, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
        found = raw[a:b].split()  # at white space of ASCII, as the words are defined
        count[i], distinct[i] = len(found), len(set(found))

    def per_row(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))[at])

    failed = [
        count < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * count,
        100 * per_row(_CAPITAL[data]) > MOST_CAPITALS * per_row((data & 0xC0) != 0x80),
        per_row(_MARK[data]) > 0,
    ]
    return sum(f.astype(np.int32) << bit for bit, f in enumerate(failed))


def _facts(docs: DataFrame, most_cells: int) -> DataFrame:
    """``(doc_id, part, mask, repeat)``: masks of the text filters, and the text where it may
    stand in the table more than once."""
    plane = repeat_plane(docs, most_cells)
    held = docs.sparkSession.sparkContext.broadcast(plane)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                text, hashes = part.column("text"), part.column("hash").to_numpy()
                alone = ~may_repeat(hashes, held.value) if held.value is not None else np.zeros(len(text), bool)
                repeat = text.take(pa.array(np.arange(len(text)), mask=alone))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("part"), pa.array(text_masks(text), pa.int32()), repeat],
                    names=["doc_id", "part", "mask", "repeat"],
                )

    text = _whole(F.col("text"))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, part string, mask int, repeat string")


def masks(docs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """``(doc_id, part, mask, n)``: the failed filters of every document, as bits in the order of
    ``FILTERS``; ``n`` rows are alike."""
    facts = materialise(_facts(docs, most_cells))
    once = facts.filter("repeat is null").select("doc_id", "part", "mask", F.lit(1).cast("long").alias("n"))
    maybe = facts.filter("repeat is not null")
    first = maybe.groupBy("repeat").agg(F.min("doc_id").alias("doc_id"))
    digest = F.sha2("repeat", 256).alias("digest")
    first = first.filter("doc_id is not null").select("doc_id", digest, F.lit(True).alias("is_first"))
    alike = maybe.select("doc_id", "part", "mask", digest).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    later = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    known = alike.join(first, ["doc_id", "digest"], "left").select(
        "doc_id", "part", (F.col("mask") + F.when(later, REPEAT).otherwise(0)).alias("mask"), "n"
    )
    return once.unionByName(known)


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents with exactly these failures, and how many of
    them are labelled good and toxic."""
    named = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"),
    ).filter("is_good or is_toxic")
    rows = masks.join(named, "doc_id", "left")

    def total(when: str) -> Column:
        return F.sum(F.when(F.coalesce(F.col(when), F.lit(False)), F.col("n")).otherwise(0)).alias(when[3:])

    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("is_good"), total("is_toxic"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: ``kept`` after the step, ``removed`` at it,
    ``redundant`` (fails the step's filter, removed earlier), ``unique_fails`` (fails no other),
    ``good_lost`` and ``toxic_lost`` of the removed, and ``shapley``: documents the filter removes,
    summed over all orders. ``counts`` holds the columns of ``mask_counts``."""
    orders = factorial(len(filters))
    bit = {letter: 1 << i for i, letter in enumerate(filters)}
    steps = ", ".join(
        f"struct('{''.join(order)}' AS filter_order, {k + 1} AS step, {sum(bit[x] for x in order[:k])} AS before, {bit[letter]} AS bit)"
        for order in permutations(filters) for k, letter in enumerate(order)
    )
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = cells.select("part", "cells", F.expr(f"explode(array({steps}))").alias("s")).select("part", "cells", "s.*")

    def total(of, where) -> Column:
        held = F.filter("cells", lambda c: where(c["mask"]))
        return F.aggregate(held, F.lit(0).cast("long"), lambda acc, c: acc + of(c))

    def fails(mask: Column, what: Column) -> Column:
        return mask.bitwiseAND(what) != 0

    now, before = F.col("bit"), F.col("before")

    def removed(mask: Column) -> Column:
        return fails(mask, now) & ~fails(mask, before)

    def in_orders(c: Column) -> Column:
        """A document falls to each of its failing filters in an equal share of all orders."""
        return c["n"] * (F.lit(orders) / F.bit_count(c["mask"])).cast("long")

    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: c["n"], lambda m: ~fails(m, now.bitwiseOR(before))).alias("kept"),
        total(lambda c: c["n"], removed).alias("removed"),
        total(lambda c: c["n"], lambda m: fails(m, now) & fails(m, before)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == now).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(in_orders, lambda m: fails(m, now)).alias("shapley"),
    )
