"""Documents that hold a benchmark item, exactly or with a few words changed.

Both sides are sequences of lower-cased words. A passage within ``share`` of the item's words
by edit distance keeps a known number of the item's word triples, so only windows with that many
benchmark triples are looked at further. Such windows go through the random walk of
Chakraborty, Goldenberg and Koucky, which turns edit distance into Hamming distance; sampled
places of the walk, repeated until the target recall, are the hash keys that windows and items
are joined on. Word-level edit distance of the item to the windows' surroundings decides.

The walk drifts apart as edits add up, so items of ``2 * PIECE`` words or more are cut into
pieces of ``PIECE`` words and somewhat more, each looked up by itself. One of them has no more
than its share of the edits, wherever these are, so long items are found as surely as short ones.

The sent tables are two bitmaps that grow with the benchmark (``bitmap_bits``: at most 128 MB, a
chance hit has one in 32 up to 33 million entries), the window sizes and the bounds of item lengths
(powers of two). Windows get one of few sizes (steps of a quarter); a piece is looked up by its
leading words of that number.

Defined results: null or empty texts match nothing, and so do items of fewer than three words.
Repeated rows of either side give one result per pair of ids; null ids are ids like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.lineage import materialise
from shelfkin.llm.arrow import ALNUM, flat, mix, slices, window_hashes, word_hashes, words
from shelfkin.shipping import ship

SHARE, RECALL = 0.2, 0.95
#: Bits of a bitmap per entry, so a chance hit has one in 32; least and most bits as powers of two.
BITS_PER_ENTRY, LEAST_BITS, MOST_BITS = 32, 22, 30
PLACES = 4  # sampled places of the walk in one key
AGREE = 0.6  # assumed share of equal places at the largest distance of an item that is not cut
PIECE = 12  # least words of a piece
LONG = 1 << 8  # words over which passages are joined
_SLICE = 2 << 20


def repeats(recall: float = RECALL) -> int:
    """Keys per window that reach the recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREE**PLACES))


def window_size(n: int) -> int:
    """The largest window size of at most ``n`` words."""
    size = 3
    while (bigger := max(size + 1, size * 5 // 4)) <= n:
        size = bigger
    return size


def edits(n: int, share: float) -> int:
    """Word edits allowed for an item of ``n`` words."""
    return int(n * share + 1e-9)


def most_words(size: int) -> int:
    """The longest item that is looked up by windows of ``size``."""
    return max(size + 1, size * 5 // 4) - 1


def triples_kept(size: int, share: float) -> int:
    """Item triples that a passage in reach keeps within a window."""
    return max(1, size - 2 - 3 * edits(most_words(size), share))


def pieces(n: int) -> list[tuple[int, int]]:
    """Where the pieces of an item of ``n`` words start, and their window sizes."""
    k = max(1, n // PIECE)
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, window_size(b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]


def bound(n: int) -> int:
    """The power of two above an item's words: how far from a piece the item may reach."""
    return 1 << n.bit_length()


def slack(n: int, share: float) -> int:
    """Words that a passage of an item of ``n`` words may lie off the place that a key tells."""
    return edits(n, share) + 2 * PIECE


def _within(keys: np.ndarray, words: int) -> np.ndarray:
    """The keys of pieces of items of under ``words`` words."""
    with np.errstate(over="ignore"):
        return mix(keys + np.uint64(words) * np.uint64(0x9E3779B97F4A7C15))


def walk_keys(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int, times: int) -> np.ndarray:
    """``times`` hash keys of every window of ``size`` words (fewer where the text stops)."""
    rng = np.random.default_rng(size)
    seeds = rng.integers(1, 1 << 63, (times, 3 * size), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sampled = np.zeros((times, 3 * size), bool)
    for k in range(times):
        sampled[k, rng.choice(2 * size, PLACES, replace=False)] = True
    last = int(np.flatnonzero(sampled.any(axis=0)).max()) + 1
    padded = np.append(hashes, np.uint64(0))
    end = np.minimum(stop, start + size)
    at = np.broadcast_to(start, (times, len(start))).copy()
    keys = np.broadcast_to(np.arange(times, dtype=np.uint64)[:, None] << np.uint64(32) | np.uint64(size), at.shape).copy()
    with np.errstate(over="ignore"):
        for j in range(last):
            word = padded[np.where(at < end, at, len(hashes))]
            use = sampled[:, j]
            if use.any():
                keys[use] = mix(keys[use] * np.uint64(0x9E3779B97F4A7C15) + word[use])
            at += ((word * seeds[:, j : j + 1]) >> np.uint64(63)).astype(np.int64)
    return keys


def _sequences(column: pa.Array) -> tuple[np.ndarray, ...]:
    data, at = flat(column)
    start, end, row = words(data, at, ALNUM)
    return data, start, end, row, word_hashes(data, start, end)


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _item_rows(times: int):
    """Per item: its words, the sizes, keys and the keys' places of its pieces, and its triples' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, _, row, hashes = _sequences(batch.column("text"))
            has, first, count = np.unique(row, return_index=True, return_counts=True)
            for r, a, n in zip(has, first, count, strict=True):
                if n < 3:
                    continue
                cut, words = pieces(int(n)), bound(int(n))
                keys = [walk_keys(hashes, np.array([a + at]), np.array([a + n]), size, times)[:, 0] for at, size in cut]
                keys = _within(np.concatenate(keys), words)
                _, triples = window_hashes(hashes[a : a + n], row[a : a + n], 3)
                yield pa.RecordBatch.from_arrays([
                    batch.column("item_id").slice(r, 1), batch.column("text").slice(r, 1), pa.array([n], pa.int64()),
                    pa.array([words], pa.int64()), pa.array([[size for _, size in cut]], pa.list_(pa.int64())),
                    pa.array([keys.view(np.int64)]), pa.array([np.repeat([at for at, _ in cut], times)], pa.list_(pa.int64())),
                    pa.array([triples.view(np.int64)]),
                ], names=["item_id", "item_text", "n_words", "words", "sizes", "keys", "places", "triples"])

    return run


def _window_rows(sizes: dict[int, list[int]], triple_map: np.ndarray, key_map: np.ndarray, share: float, times: int, bits: int):
    """Passages around windows that share enough triples with some item and a key with a piece of
    some item, with these keys and the first and last word at which a window has each. ``sizes``
    are the window sizes with the bounds of the items; passages that overlap are one, up to
    ``LONG`` words besides what the items reach."""

    def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = _bit(h, bits)
        return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0

    def starts(place: np.ndarray, row: np.ndarray, size: int, n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        need = triples_kept(size, share)
        if len(place) < need:
            return place[:0]
        head, tail = place[: len(place) - need + 1], place[need - 1 :]
        near = np.flatnonzero((tail - head <= size - 3) & (row[head] == row[tail]))
        head, tail = head[near], tail[near]
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, np.maximum(tail + 3 - size, lo[head]), 1)
        np.add.at(mark, head + 1, -1)
        return np.flatnonzero(np.cumsum(mark) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(column, _SLICE):
                data, start, end, row, hashes = _sequences(column.slice(a, b - a))
                first, triples = window_hashes(hashes, row, 3)
                place = first[has(triple_map, triples)]
                if not len(place):
                    continue
                edge = np.flatnonzero(np.diff(row)) + 1
                lo = np.concatenate(([0], edge))[np.searchsorted(edge, np.arange(len(row)), "right")]
                hi = np.append(edge, len(row))[np.searchsorted(edge, np.arange(len(row)), "right")]
                hits = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
                for size, bounds in sizes.items():
                    at = starts(place, row, size, len(row), lo, hi)
                    for c in range(0, len(at), 20_000):
                        s = at[c : c + 20_000]
                        walked = walk_keys(hashes, s, hi[s], size, times)
                        for words_ in bounds:
                            keys = _within(walked, words_)
                            found = has(key_map, keys.reshape(-1)).reshape(keys.shape)
                            k, j = np.nonzero(found)
                            more = slack(words_, share)
                            left = np.maximum(s[j] - (words_ - size) - more, lo[s[j]])
                            right = np.minimum(s[j] + words_ + more, hi[s[j]])
                            hits.append((keys[k, j], s[j], left, right))
                key, at, left, right = (np.concatenate(x) for x in zip(*hits, strict=True))
                if not len(key):
                    continue
                order = np.argsort(left, kind="stable")
                key, at, left, right = key[order], at[order], left[order], right[order]
                apart = left[1:] >= np.maximum.accumulate(right)[:-1]
                new = np.append(True, apart | (np.diff((left - lo[left]) // LONG) != 0))
                passage = np.cumsum(new) - 1
                left, right = left[new], np.maximum.reduceat(right, np.flatnonzero(new))
                order = np.lexsort((at, key, passage))
                key, at, passage = key[order], at[order], passage[order]
                one = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (passage[1:] != passage[:-1])))
                last = at[np.append(one[1:], len(at)) - 1]
                key, at, passage = key[one], at[one], passage[one]
                edge = np.searchsorted(passage, np.arange(len(left) + 1))
                for c in range(0, len(left), 1_000):
                    some = range(c, min(c + 1_000, len(left)))
                    per = [slice(edge[i], edge[i + 1]) for i in some]
                    of = pa.array(a + row[left[some]])
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").take(of), batch.column("text_hash").take(of),
                        pa.array(left[some] - lo[left[some]], pa.int64()),
                        pa.array([data[start[left[i]] : end[right[i] - 1]].tobytes().decode("utf-8") for i in some], pa.string()),
                        pa.array([key[x].view(np.int64) for x in per], pa.list_(pa.int64())),
                        pa.array([at[x] - left[i] for i, x in zip(some, per, strict=True)], pa.list_(pa.int64())),
                        pa.array([last[x] - left[i] for i, x in zip(some, per, strict=True)], pa.list_(pa.int64())),
                    ], names=["doc_id", "text_hash", "first_word", "passage", "keys", "from", "to"])

    return run


def _word_list(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _bottom_row(item: list[bytes], passage: list[bytes], anchored: int = 0) -> Iterator[int]:
    """The edit distances of the item to the runs that end before the first, second ... word of the
    passage and after its last, least over all starts or, where ``anchored``, from the passage's
    start: bit-parallel columns, one bit per item word."""
    n = len(item)
    equal: dict[bytes, int] = {}
    for i, w in enumerate(item):
        equal[w] = equal.get(w, 0) | 1 << i
    every, top = (1 << n) - 1, 1 << (n - 1)
    up, down, now = every, 0, n
    yield now
    for w in passage:
        same = equal.get(w, 0)
        vertical = same | down
        horizontal = ((same & up) + up) ^ up | same
        rise = down | ~(horizontal | up) & every
        fall = up & horizontal
        if rise & top:
            now += 1
        elif fall & top:
            now -= 1
        rise = rise << 1 & every | anchored
        fall = fall << 1 & every
        up = fall | ~(vertical | rise) & every
        down = rise & vertical
        yield now


def distance_within(item: list[bytes], passage: list[bytes]) -> int:
    """The least edit distance between the item and any run of the passage's words."""
    return min(_bottom_row(item, passage))


def best_run(item: list[bytes], passage: list[bytes]) -> tuple[int, int]:
    """The least distance, and where the first run of that distance starts (the shortest to its end)."""
    row = list(_bottom_row(item, passage))
    best = min(row)
    end = row.index(best)
    back = _bottom_row(item[::-1], passage[:end][::-1], 1)
    return best, end - next(j for j, x in enumerate(back) if x == best)


def _best_runs(share: float):
    """The least distance and the first word of that run, looked for around the places that keys tell."""

    def run(passage: pa.Array, item: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        known: dict[str, list[bytes]] = {}
        out, text, body = [], None, []
        # One row at a time: a passage stands in the rows of all its items.
        for p, t, a, b in zip(passage, item, lo.to_pylist(), hi.to_pylist(), strict=True):
            if (p := p.as_py()) != text:
                text, body = p, _word_list(p)
            if (t := t.as_py()) not in known:
                if len(known) >= 1_000:
                    known.clear()
                known[t] = _word_list(t)
            words = known[t]
            more = slack(len(words), share)
            a = max(0, a - more)
            best, at = best_run(words, body[a : b + len(words) + more])
            out.append((best, a + at))
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["distance", "at"])

    return F.arrow_udf(run, "struct<distance: long, at: long>").asNondeterministic()


def bitmap_bits(entries: int) -> int:
    """How many leading bits of a hash number the bits of a bitmap of so many entries."""
    return min(MOST_BITS, max(LEAST_BITS, (BITS_PER_ENTRY * entries - 1).bit_length()))


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the hashes' leading bits: at most ``2^bits / 32`` rows come to the driver."""
    place = F.shiftrightunsigned("h", 64 - bits)
    word = hashes.groupBy(F.shiftright(place, 5).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 31 as int))")).alias("v")
    )
    rows = word.toArrow()
    out = np.zeros(1 << bits - 5, np.uint32)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _found(docs: DataFrame, benchmark: DataFrame, share: float, recall: float, bits: int | None) -> DataFrame:
    """``(doc_id, text_hash, item_id, n_words, distance, first_word)`` of every verified passage."""
    spark = docs.sparkSession
    ship(spark)
    times = repeats(recall)
    kind = dict(benchmark.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    items = materialise(benchmark.select("item_id", F.lower("text").alias("text")).mapInArrow(
        _item_rows(times),
        f"item_id {kind[0]}, item_text string, n_words long, words long, sizes array<long>, keys array<long>,"
        " places array<long>, triples array<long>",
    ).withColumn("item", F.xxhash64("item_id", "item_text")).dropDuplicates(["item"]))
    entries = items.agg(F.sum(F.size("triples")).alias("triples"), F.sum(F.size("keys")).alias("keys")).first()
    bits = bits or bitmap_bits(max(entries.triples or 0, entries.keys or 0))
    triple_map = _bitmap(items.select(F.explode("triples").alias("h")), bits)
    key_map = _bitmap(items.select(F.explode("keys").alias("h")), bits)
    sizes: dict[int, list[int]] = {}
    for size, words_ in sorted(items.select(F.explode("sizes"), "words").distinct().collect()):
        sizes.setdefault(size, []).append(words_)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lower("text").alias("text"))
    passages = materialise(texts.mapInArrow(
        _window_rows(sizes, triple_map, key_map, share, times, bits),
        f"doc_id {kind[1]}, text_hash long, first_word long, passage string, keys array<long>, `from` array<long>, `to` array<long>",
    ).withColumn("id", F.xxhash64("doc_id", "text_hash", "first_word")))
    by_key = items.select("item", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("place"))))
    met = (
        passages.select("id", F.inline(F.arrays_zip(F.col("keys").alias("key"), "from", "to")))
        .join(by_key, "key")
        .groupBy("id", "item")
        .agg(F.min(F.col("from") - F.col("place")).alias("lo"), F.max(F.col("to") - F.col("place")).alias("hi"))
    )
    return (
        met.join(passages.select("id", "doc_id", "text_hash", F.col("first_word").alias("start"), "passage"), "id")
        .join(items.select("item", "item_id", "item_text", "n_words"), "item")
        .withColumn("run", _best_runs(share)("passage", "item_text", "lo", "hi"))
        .select("doc_id", "text_hash", "item_id", "n_words", "run.distance", (F.col("start") + F.col("run.at")).alias("first_word"))
        .filter(F.col("distance") <= F.floor(F.col("n_words") * share + 1e-9))
    )


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL, bits: int | None = None) -> DataFrame:
    """``(doc_id, item_id, distance, n_words, first_word)``: for every document and benchmark
    item found in it the least edit distance in words, the item's words and where a passage of
    that distance starts."""
    near = _found(docs, benchmark, share, recall, bits)
    best = F.min_by(F.struct("distance", "n_words", "first_word"), F.struct("distance", "first_word")).alias("best")
    return near.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.distance", "best.n_words", "best.first_word"
    )


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item. Rows that share an id (or a null id) are
    told apart by their texts."""
    found = _found(docs, benchmark, share, RECALL, None)
    found = found.select(F.col("doc_id").alias("__leaked"), F.col("text_hash").alias("__text")).distinct()
    same = F.col("__leaked").eqNullSafe(docs["doc_id"]) & (F.col("__text") == F.xxhash64(docs["text"]))
    return docs.join(found, same, "left_anti")
