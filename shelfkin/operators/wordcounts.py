"""Counts of words and bigrams over Arrow batches of ``words``, joined by spaces: the work of one task.

Words are numbered inside a slice of a batch and a bigram is a pair of numbers, so terms are
counted by sorting integers, and strings are made of distinct terms only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of a slice, which bounds a task's memory; a longer row is a slice of its own.
SLICE_BYTES = 1 << 22


class _Slice:
    """Rows of a batch with their words by number: ``codes`` and ``rows`` per word, ``left``, ``right``
    and ``pair_rows`` per bigram."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch, self.n = batch, batch.num_rows
        lists = pc.split_pattern(batch.column("words"), " ")
        # No words split into one that is empty.
        sizes = np.where(_bytes(batch) > 0, pc.list_value_length(lists).to_numpy(), 0)
        flat = lists.flatten()
        coded = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
        self.words = coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.rows = np.repeat(np.arange(self.n), sizes)
        inside = self.rows[1:] == self.rows[:-1]
        self.left, self.right = self.codes[:-1][inside], self.codes[1:][inside]
        self.pair_rows = self.rows[1:][inside]

    def cells(self, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """The cell of every word's and every bigram's hash, the same in all tasks."""
        sums = np.fromiter(map(zlib.crc32, self.words.cast(pa.binary()).to_pylist()), np.uint64, len(self.words))
        first = sums * np.uint64(0x9E3779B97F4A7C15)
        return _mixed(sums, cells)[self.codes], _mixed(first[self.left] + sums[self.right] + np.uint64(1), cells)


def _mixed(x: np.ndarray, cells: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(cells)).astype(np.int64)


def _bytes(batch: pa.RecordBatch) -> np.ndarray:
    return pc.binary_length(batch.column("words")).to_numpy()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    for batch in batches:
        ends = np.cumsum(_bytes(batch), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            most = SLICE_BYTES + (ends[begin - 1] if begin else 0)
            end = max(begin + 1, int(np.searchsorted(ends, most, "right")))
            yield _Slice(batch.slice(begin, end - begin))
            begin = end


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and their lengths."""
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(ordered)])


def cell_sums(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """``(cell, n)``: the uses of all terms of a cell, one row per cell of the task."""
    total = np.zeros(cells, np.int64)
    for s in _slices(batches):
        for found in s.cells(cells):
            total += np.bincount(found, minlength=cells)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["cell", "n"])


def totals(batches: Iterator[pa.RecordBatch], marked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(term, cf, df)`` of a slice's terms in the marked cells."""
    for s in _slices(batches):
        words, n = len(s.words), s.n
        one, two = (marked[c] for c in s.cells(len(marked)))
        # A term's number and its row in one: below 2^63 for slices of up to 2^21 words.
        pairs = words + s.left[two] * words + s.right[two]
        held = np.sort(np.concatenate([s.codes[one] * n + s.rows[one], pairs * n + s.pair_rows[two]]))
        starts, uses = _runs(held)
        if not len(starts):
            continue
        keys = held[starts] // n
        begins, df = _runs(keys)
        keys = keys[begins]
        singles = np.searchsorted(keys, words)
        first, second = np.divmod(keys[singles:] - words, words)
        names = [s.words.take(pa.array(keys[:singles])),
                 pc.binary_join_element_wise(s.words.take(pa.array(first)), s.words.take(pa.array(second)), " ")]
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays(names), pa.array(np.add.reduceat(uses, begins)), pa.array(df)], ["term", "cf", "df"]
        )


def vectors(batches: Iterator[pa.RecordBatch], terms: list[str], idf: list[float]) -> Iterator[pa.RecordBatch]:
    """``(id, idx, weights)``: the unit vectors of ``(id, words)`` over a vocabulary."""
    weight = np.array(idf)
    single = [i for i, t in enumerate(terms) if " " not in t]
    double = [i for i, t in enumerate(terms) if " " in t]
    halves = [terms[i].split(" ", 1) for i in double]
    sides = [sorted({h[k] for h in halves}) for k in (0, 1)]
    place = [{w: i for i, w in enumerate(side)} for side in sides]
    keys = np.array([place[0][a] * len(sides[1]) + place[1][b] for a, b in halves], np.int64)
    order = np.argsort(keys)
    keys, double_index = keys[order], np.array(double, np.int64)[order]
    # The last place is for words that are in no term.
    single_index = np.array([*single, -1], np.int64)

    def found(words: pa.Array, among: list[str]) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=pa.array(among, words.type)), -1).to_numpy().astype(np.int64)

    for s in _slices(batches):
        index = single_index[found(s.words, [terms[i] for i in single])][s.codes]
        known = index >= 0
        held = [s.rows[known] * len(terms) + index[known]]
        if len(keys):
            a, b = found(s.words, sides[0])[s.left], found(s.words, sides[1])[s.right]
            maybe = np.flatnonzero((a >= 0) & (b >= 0))
            pair = a[maybe] * len(sides[1]) + b[maybe]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            hit = keys[at] == pair
            held.append(s.pair_rows[maybe[hit]] * len(terms) + double_index[at[hit]])
        held = np.sort(np.concatenate(held))
        starts, uses = _runs(held)
        row, idx = np.divmod(held[starts], len(terms))
        x = uses * weight[idx]
        norm = np.sqrt(np.bincount(row, x * x, s.n))
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=s.n))].astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            s.batch.column("id"),
            pa.ListArray.from_arrays(ends, pa.array(idx.astype(np.int32))),
            pa.ListArray.from_arrays(ends, pa.array(x / norm[row])),
        ], ["id", "idx", "weights"])
