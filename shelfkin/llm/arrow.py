"""Arrow text columns as flat byte arrays, and exact word hashes over them.

Tasks that look at every byte work on slices of a few megabytes, so a batch of long texts
does not multiply in memory.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20261201).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII white space separates words; every other byte belongs to one.
WORD = np.ones(256, dtype=bool)
WORD[[9, 10, 11, 12, 13, 32]] = False
#: Words of digits, small letters and anything beyond ASCII (after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    _, at = flat(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """A to Z as small letters; other bytes stay."""
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        run = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        run[0] = 1
        have = np.multiply.accumulate(run)
        if n <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row)`` of every word; a word never crosses two rows."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = is_word[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[at[(at < len(data))]] = True
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes: a polynomial over random byte values, mixed."""
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * _power("up", _BASE, n), out=sums[1:])
        h = (sums[end] - sums[start]) * _power("down", _INVERSE, n + 1)[start]
        return mix(h + (end - start).astype(np.uint64))


def window_hashes(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first word, hash)`` of every run of ``n`` words that lies in one row."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    with np.errstate(over="ignore"):
        h = np.zeros(len(first), dtype=np.uint64)
        for k in range(n):
            h = mix(h * _BASE + hashes[first + k])
    return first, h


class RangeHashes:
    """64-bit hashes of any byte ranges of one array, as ``word_hashes`` gives them for words."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTES[data] * _power("up", _BASE, n), out=self.sums[1:])
        self.down = _power("down", _INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def give_back() -> None:
    """Return what earlier tasks of this worker have freed to the system. Workers live on from
    stage to stage, and freed memory stays with them until it is asked for."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim is not None:
        trim(0)
