"""Resampling documents towards a target distribution by importance weights.

Every n-gram of a text counts in one of ``buckets`` cells. The corpus and the target texts are
counted once each; a cell's gain is the scaled logarithm of its smoothed share in the target over
its share in the corpus, and a document's weight the sum of gains over its n-grams. With Gumbel
noise from the document's id the highest scores are a draw without replacement in proportion to
the exponentials of the weights.

Inside a task the n-grams of a slice of texts are interned in an open-addressed table
(``intern``): xxhash64 keys, compared byte by byte where keys are equal. A slot has a bucket and a
count, so every distinct n-gram is reduced to its cell once per slice; the slots of all
occurrences then gather the gains.

Defined results: a null or empty text has no n-grams, weight 0 and no rank; a null id is hashed
as an empty one and ranks last among equal scores; rows equal in score and id are ordered by
their number of n-grams; an empty target leaves weights defined (all its counts are 0), an empty
corpus gives no rows. Repeated rows count as often as they stand there; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfkin.lineage import materialise
from shelfkin.llm.arrow import ALNUM, flat, lower, slices, words
from shelfkin.shipping import ship

BUCKETS, LONGEST = 10_000, 1
SHARE, LEAST_WORDS, SEED = 10, 20, 2024
WEIGHT = "struct<n_words: long, n_features: long, weight: long>"
_SLICE = 2 << 20


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes (one at least) from ``a`` on equal those from ``b`` on."""
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    equal = data[np.repeat(a, size) + within] == data[np.repeat(b, size) + within]
    return np.logical_and.reduceat(equal, first) if len(first) else equal


def intern(data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(slot of every occurrence, owner of every slot)``; an owner is the occurrence whose bytes
    the slot stands for, -1 where it is free.

    All occurrences probe at once and those that meet another n-gram move on by one slot. The
    table has twice as many slots as there are occurrences, so probing ends.
    """
    n = len(keys)
    slots = 1 << max(4, (2 * n - 1).bit_length())
    owner = np.full(slots, -1, np.int64)
    at = (keys & np.uint64(slots - 1)).astype(np.int64)
    left = np.arange(n)
    while len(left):
        free = owner[at[left]] < 0
        owner[at[left[free]]] = left[free]
        held = owner[at[left]]
        same = held == left
        maybe = np.flatnonzero(~same & (keys[held] == keys[left]) & ((end - start)[held] == (end - start)[left]))
        same[maybe] = _same_bytes(data, start[left[maybe]], start[held[maybe]], (end - start)[left[maybe]])
        left = left[~same]
        at[left] = (at[left] + 1) & (slots - 1)
    return at, owner


def runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, longest: int):
    """``(bytes, start, end, row)`` of all runs of 1 to ``longest`` words of a row, their words
    joined by one space."""
    if longest == 1:
        return data, start, end, row
    size = end - start
    to = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(to, size) + within] = data[np.repeat(start, size) + within]
    found = []
    for n in range(1, longest + 1):
        first = np.flatnonzero(row[: max(len(row) - n + 1, 0)] == row[n - 1 :])
        found.append((to[first], (to + size)[first + n - 1], row[first]))
    return joined, *(np.concatenate(part) for part in zip(*found, strict=True))


class Interned:
    """The n-grams of a column of texts: ``row`` and ``slot`` of each, ``bucket`` and ``count`` of
    the slots, ``n_words`` of the rows."""

    def __init__(self, column: pa.Array, longest: int, buckets: int):
        data, at = flat(column)
        data = lower(data)
        start, end, row = words(data, at, ALNUM)
        self.n_words = np.bincount(row, minlength=len(column))
        data, start, end, self.row = runs(data, start, end, row, longest)
        raw = data.tobytes()
        keys = np.fromiter(
            (xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start)
        )
        self.slot, owner = intern(data, start, end, keys)
        used = np.flatnonzero(owner >= 0)
        self.bucket = np.zeros(len(owner), np.int64)
        of = owner[used]
        self.bucket[used] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(start[of].tolist(), end[of].tolist(), strict=True)]
        self.count = np.bincount(self.slot, minlength=len(owner))


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: the n-grams of all ``texts(text)`` per cell; cells without any are absent.
    A task passes on one row per cell at most."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            column = batch.column(0)
            for a, b in slices(column, _SLICE):
                held = Interned(column.slice(a, b - a), longest, buckets)
                np.add.at(total, held.bucket, held.count)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` of every cell from the counts of corpus and target."""
    both = (
        corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
        .unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
        .unionByName(corpus.sparkSession.range(buckets).selectExpr("id AS bucket", "0L AS s", "0L AS t"))
        .groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    )
    both = materialise(both)  # a row per bucket
    every = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    share = (F.col("t") + 1) * (every.s + buckets) / ((F.col("s") + 1) * (every.t + buckets))
    return both.select("bucket", F.floor(1000 * F.ln(share)).alias("gain"))


def gain_table(corpus: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gains of all cells; ``buckets`` bounds what comes to the driver."""
    found = bucket_gains(bucket_counts(corpus, longest, buckets), bucket_counts(target, longest, buckets), buckets)
    rows = found.toPandas()
    table = np.zeros(buckets, np.int64)
    table[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    return table


def weight(gains: np.ndarray, text: Column, longest: int = LONGEST) -> Column:
    """The struct ``WEIGHT`` of every text."""

    @F.arrow_udf(WEIGHT)
    def weigh(column: pa.Array) -> pa.Array:
        parts = []
        for a, b in slices(column, _SLICE):
            held = Interned(column.slice(a, b - a), longest, len(gains))
            n = b - a
            gained = np.bincount(held.row, gains[held.bucket[held.slot]], n).astype(np.int64)
            parts.append((held.n_words, np.bincount(held.row, minlength=n), gained))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n_words", "n_features", "weight"])

    return weigh.asNondeterministic()(text)


def score(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """The weight with Gumbel noise that hangs on the seed and the id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return weight + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of every document."""
    ship(docs.sparkSession)
    gains = gain_table(docs, target, longest, buckets)
    held = docs.select("doc_id", weight(gains, F.col("text"), longest).alias("w")).select("doc_id", "w.*")
    return held.withColumn("score", score(F.col("weight"), F.col("doc_id"), seed))


def ranked(scores: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scores`` with ``rank``: 1, 2, ... for the ``share`` percent highest scores among rows of
    at least ``least_words`` words, null for all others.

    Slim rows are sorted over all tasks by range; a row's rank is its place in its range after
    the sizes of the ranges before, so no task sees more than its range.
    """
    scores = materialise(scores)
    able = F.col("n_words") >= least_words
    order = [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    line = scores.repartitionByRange(*order).sortWithinPartitions(*order)
    line = materialise(line.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = line.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(able).alias("able")).collect()
    drawn = share * sum(r.able for r in sizes) // 100
    before, starts = 0, []
    for r in sorted(sizes, key=lambda r: r.part):  # one row per range
        starts.append((r.part, before))
        before += r.n
    starts = scores.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    named = line.withColumn("part", part).join(F.broadcast(starts), "part")
    return named.select(*scores.columns, F.when(rank <= drawn, rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS,
              longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; no text is shuffled.

    The last drawn score and id are the border, so rows that equal both stay or go together.
    """
    ship(docs.sparkSession)
    gains = gain_table(docs, target, longest, buckets)
    held, to = "__weight", "__score"
    rows = docs.withColumn(held, weight(gains, F.col("text"), longest))
    rows = rows.withColumn(to, score(F.col(f"{held}.weight"), F.col("doc_id"), seed))
    slim = rows.select("doc_id", f"{held}.n_words", f"{held}.n_features", F.col(to).alias("score"))
    last = ranked(slim, share, least_words).filter("rank is not null").orderBy(F.desc("rank")).limit(1).collect()
    if not last:
        return docs.limit(0)
    same = (F.col(to) == last[0].score) & ((F.col("doc_id") <= last[0].doc_id) | F.lit(last[0].doc_id is None))
    drawn = (F.col(f"{held}.n_words") >= least_words) & ((F.col(to) > last[0].score) | same)
    return rows.filter(drawn).select(*[F.col(f"`{c}`") for c in docs.columns])
