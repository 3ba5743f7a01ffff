"""Inside a task: dot products of sparse rows, and the best few of a score matrix.

Blocks that meet many others are compared in single precision first: a pair whose product, with all
its rounding errors, stays below both floors is done with, and only the others are worked out in
double precision.

Tables hold ``id``, ``idx array<int>`` and ``weights array<double>``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DIGITS = 6
# Terms with more meetings of rows than this are cheaper as columns of a matrix product.
COMMON = 30_000
# The same in single precision, where the other terms' meetings are added one by one.
DENSE = 2000
# Candidates of a row that are worked out before it is cut to its best few, and entries and rows at a time.
MANY, EXACT_ENTRIES, EXACT_ROWS = 32, 1 << 20, 256
# The least product that is told from none.
TINY = 1e-30

_scratch: dict[int, np.ndarray] = {}


class Rows:
    """Sparse rows of a table: entry ``e`` says that row ``line[e]`` holds term ``idx[e]``."""

    def __init__(self, ids: pa.Array, line: np.ndarray, idx: np.ndarray, weights: np.ndarray):
        self.ids, self.line, self.idx, self.weights = ids, line, idx, weights

    @classmethod
    def of(cls, table: pa.Table) -> Rows:
        idx, weights = table["idx"].combine_chunks(), table["weights"].combine_chunks()
        line = np.repeat(np.arange(len(idx)), pc.list_value_length(idx).to_numpy(zero_copy_only=False))
        return cls(ids_of(table), line, idx.flatten().to_numpy(), weights.flatten().to_numpy())

    def take(self, rows: np.ndarray) -> Rows:
        """The given rows, an ascending list of positions."""
        place = np.full(len(self.ids), -1)
        place[rows] = np.arange(len(rows))
        at = place[self.line]
        held = at >= 0
        return Rows(self.ids.take(pa.array(rows)), at[held], self.idx[held], self.weights[held])

    def top(self, n_terms: int) -> np.ndarray:
        """The largest weight of every term."""
        out = np.zeros(n_terms)
        np.maximum.at(out, self.idx, self.weights)
        return out

    def bound(self, top: np.ndarray) -> np.ndarray:
        return np.bincount(self.line, self.weights * top[self.idx], minlength=len(self.ids))

    def columns(self, terms: np.ndarray, n_terms: int) -> np.ndarray:
        """The given terms' columns as a matrix."""
        place = np.full(n_terms, -1)
        place[terms] = np.arange(len(terms))
        at = place[self.idx]
        held = at >= 0
        out = np.zeros((len(self.ids), len(terms)))
        out[self.line[held], at[held]] = self.weights[held]
        return out

    def postings(self, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and weights in term order, with each term's first position."""
        order = np.argsort(self.idx, kind="stable")
        starts = np.searchsorted(self.idx[order], np.arange(n_terms + 1))
        return self.line[order], self.weights[order], starts


def products(source: Rows, target: Rows, n_terms: int) -> np.ndarray:
    """Dot products of all rows of two sets.

    Terms that many rows hold go through one matrix product, the others touch only the rows
    that hold them.
    """
    rows, weights, at = source.postings(n_terms)
    cols, others, to = target.postings(n_terms)
    meetings = np.diff(at) * np.diff(to)
    common = np.flatnonzero(meetings > COMMON)
    out = source.columns(common, n_terms) @ target.columns(common, n_terms).T
    for t in np.flatnonzero((meetings > 0) & (meetings <= COMMON)):
        mine, theirs = slice(at[t], at[t + 1]), slice(to[t], to[t + 1])
        out[rows[mine, None], cols[theirs]] += weights[mine, None] * others[theirs]
    return out


def best_cells(scores: np.ndarray, keep: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of each row's ``keep`` largest values that reach its ``least``;
    equal values go by column."""
    if scores.shape[1] > keep:
        least = np.maximum(least, np.partition(scores, -keep, axis=1)[:, -keep])
    row, col = np.nonzero(scores >= least[:, None])
    value = scores[row, col]
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < keep
    return row[first], col[first], value[first]


def best_targets(source: Rows, target: Rows, n_terms: int, keep: int,
                 floor: np.ndarray | None = None) -> pa.Table:
    """The ``keep`` best positive targets of each source row; target rows must be in id order.

    Targets below a row's ``floor`` are left out.
    """
    scores = np.round(products(source, target, n_terms), DIGITS)
    least = np.full(len(scores), 10.0**-DIGITS / 2) if floor is None else np.maximum(floor, 10.0**-DIGITS / 2)
    row, col, value = best_cells(scores, keep, least)
    return pa.table({
        "id": source.ids.take(pa.array(row)), "rec_id": target.ids.take(pa.array(col)), "score": value,
    })


class Block:
    """Rows with their postings in single precision."""

    def __init__(self, rows: Rows, n_terms: int):
        self.rows, self.n_terms, self.n = rows, n_terms, len(rows.ids)
        order = np.argsort(rows.idx, kind="stable")
        self.line, self.term = rows.line[order], rows.idx[order]
        self.weight = rows.weights[order].astype(np.float32)
        self.count = np.bincount(rows.idx, minlength=n_terms)
        self.start = np.cumsum(self.count) - self.count
        self.size = np.bincount(rows.line, minlength=self.n)
        self.first = np.cumsum(self.size) - self.size
        self.norm = np.sqrt(np.bincount(rows.line, rows.weights**2, minlength=self.n))

    @property
    def scratch(self) -> np.ndarray:
        """``EXACT_ROWS`` rows of zeros, one matrix per worker; whoever writes to it clears it again."""
        if self.n_terms not in _scratch:
            _scratch[self.n_terms] = np.zeros((EXACT_ROWS, self.n_terms))
        return _scratch[self.n_terms]

    def columns(self, terms: np.ndarray) -> np.ndarray:
        place = np.full(self.n_terms, -1)
        place[terms] = np.arange(len(terms))
        at = place[self.term]
        held = at >= 0
        out = np.zeros((self.n, len(terms)), np.float32)
        out[self.line[held], at[held]] = self.weight[held]
        return out

    def products(self, other: Block) -> np.ndarray:
        """Dot products of all rows of two blocks in single precision."""
        meetings = self.count * other.count
        common = np.flatnonzero(meetings > DENSE)
        out = self.columns(common) @ other.columns(common).T
        rare = (meetings > 0) & (meetings <= DENSE)
        mine = np.flatnonzero(rare[self.term])
        times = other.count[self.term[mine]]
        ends = np.cumsum(times)
        if len(ends):
            theirs = np.arange(ends[-1]) + np.repeat(other.start[self.term[mine]] - (ends - times), times)
            mine = np.repeat(mine, times)
            np.add.at(out.reshape(-1), self.line[mine] * other.n + other.line[theirs], self.weight[mine] * other.weight[theirs])
        return out

    def error(self, other: Block) -> np.ndarray:
        """How far a row's products may be off: a rounding step per entry, and a few for its own."""
        return (self.size + 4) * 2.0**-23 * self.norm * other.norm.max(initial=0.0)

    def exact(self, other: Block, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Rounded dot products of the given pairs, in ascending ``row`` order, in double precision."""
        out = np.zeros(len(row))
        start = 0
        upto = np.cumsum(other.size[col])
        full = self.scratch
        while start < len(row):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + EXACT_ENTRIES)))
            end = min(end, int(np.searchsorted(row, row[start] + EXACT_ROWS)))
            here, there = row[start:end], col[start:end]
            low, high = here[0], here[-1] + 1
            mine = slice(self.first[low], self.first[high - 1] + self.size[high - 1])
            full[self.rows.line[mine] - low, self.rows.idx[mine]] = self.rows.weights[mine]
            times = other.size[there]
            ends = np.cumsum(times)
            theirs = np.arange(ends[-1]) + np.repeat(other.first[there] - (ends - times), times)
            pair = np.repeat(np.arange(end - start), times)
            out[start:end] = np.bincount(pair, full[here[pair] - low, other.rows.idx[theirs]] * other.rows.weights[theirs], minlength=end - start)
            full[self.rows.line[mine] - low, self.rows.idx[mine]] = 0.0
            start = end
        return np.round(out, DIGITS)


def _candidates(products: np.ndarray, floor: np.ndarray, error: np.ndarray, keep: int) -> np.ndarray:
    """Which products may be among their row's best, in single precision."""
    least = np.maximum(floor - 10.0**-DIGITS - error, TINY)
    mask = products >= np.nextafter(least.astype(np.float32), np.float32(0))[:, None]
    over = np.flatnonzero(np.count_nonzero(mask, axis=1) > max(MANY, keep))
    if len(over):
        last = np.partition(products[over], -keep, axis=1)[:, -keep] - 10.0**-DIGITS - 2 * error[over]
        mask[over] &= products[over] >= np.nextafter(last.astype(np.float32), np.float32(0))[:, None]
    return mask


class Lists:
    """The best ``keep`` partners of every row of a side, block by block; partners are numbered in
    id order, equal ids alike. A row whose floor is infinite wants none. Floors rise with what is found
    unless partners repeat (``unique`` is false), where a score may be one partner's twice."""

    def __init__(self, floor: np.ndarray, keep: int, unique: bool = True):
        self.floor, self.keep, self.unique = np.maximum(floor, 10.0**-DIGITS / 2), keep, unique
        self.best = np.full((len(floor), keep), -1.0)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, row: np.ndarray, item: np.ndarray, value: np.ndarray) -> None:
        """Take in candidates; what cannot be among the best any more is dropped."""
        reaches = value >= self.floor[row]
        row, item, value = row[reaches], item[reaches], value[reaches]
        order = np.lexsort((item, -value, row))
        row, item, value = row[order], item[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < self.keep
        row, item, value, place = row[first], item[first], value[first], place[first]
        if not len(row):
            return
        self.found.append((row, item, value))
        if len(self.found) > 4096:
            self.found = [self.result()]
        if not self.unique:
            return
        touched, at = np.unique(row, return_inverse=True)
        new = np.full((len(touched), self.keep), -1.0)
        new[at, place] = value
        best = np.sort(np.concatenate([self.best[touched], new], axis=1), axis=1)[:, self.keep:]
        self.best[touched] = best
        self.floor[touched] = np.maximum(self.floor[touched], best[:, 0])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        row, item, value = (np.concatenate(part) for part in zip(*self.found, strict=True))
        order = np.lexsort((-value, item, row))
        row, item, value = row[order], item[order], value[order]
        taken = value >= self.floor[row]
        taken[1:] &= (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        row, item, value = row[taken], item[taken], value[taken]
        order = np.lexsort((item, -value, row))
        row, item, value = row[order], item[order], value[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < self.keep
        return row[first], item[first], value[first]


def meet(left: Block, right: Block, keep: int, floor: np.ndarray, other_floor: np.ndarray | None = None):
    """``(row, col, value)`` of the pairs that may be among the best of their row or of their column;
    ``other_floor`` are the columns' floors, where these want partners too."""
    products = left.products(right)
    mask = _candidates(products, floor, left.error(right), keep)
    if other_floor is not None:
        mask |= _candidates(products.T, other_floor, right.error(left), keep).T
    row, col = np.nonzero(mask)
    return row, col, left.exact(right, row, col)


def by_id(rows: pa.Table) -> pa.Table:
    return rows.take(pc.sort_indices(rows["id"])).combine_chunks()


def slices(rows: pa.Table, size: int) -> Iterator[pa.Table]:
    for start in range(0, rows.num_rows, size):
        yield rows.slice(start, size)


def ids_of(rows: pa.Table) -> pa.Array:
    return rows["id"].combine_chunks()


def merged(found: list[pa.Table], keep: int, key: str = "id", score: str = "score",
           item: str = "rec_id") -> pa.Table:
    """The ``keep`` best rows of every key."""
    rows = pa.concat_tables(found).sort_by([(key, "ascending"), (score, "descending"), (item, "ascending")])
    code = rows[key].combine_chunks().dictionary_encode().indices.to_numpy()
    return rows.filter(pa.array(np.arange(len(code)) - np.searchsorted(code, code) < keep))
