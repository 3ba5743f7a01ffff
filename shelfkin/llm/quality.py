"""Quality of texts: fixed rules on their statistics, then robust multivariate outliers.

The statistics of texts that pass the fixed rules become a vector of four transformed figures.
Per language and source the minimum-covariance-determinant estimate is fitted to all of the
group's vectors: from the coordinates' medians, each step takes the ``SUBSET`` share of vectors
nearest by Mahalanobis distance and estimates centre and covariance anew. A vector further away
than the cutoff is rejected. Distances are counted in bins per group, so a step is one grouping
that collapses map-side and no group meets in one task; groups of fewer than ``LEAST_GROUP`` rows
are fitted together, per language and, if that is not enough, over all languages.

Covariances carry a floor per coordinate (``FLOORS``), as most texts have no symbol and no repeat
at all and a variance of zero would reject the first one that does.

Defined results: a null or empty text has no words and fails the rules. A null language or source
is a group value of its own. Repeated rows get equal answers; extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfkin.lineage import materialise
from shelfkin.llm.arrow import WORD, flat, slices, window_hashes, word_hashes, words
from shelfkin.shipping import ship

RUN = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
LEAST_GROUP, SUBSET, STEPS = 30, 0.75, 3
#: Smallest standard deviation of each coordinate, and the share of normal vectors kept.
FLOORS = [0.05, 0.05, 0.15, 0.15]
KEEP = 0.99999
_TYPICAL_LENGTH, _SHRINK = 5.0, 50.0
_X = [f"x{k}" for k in range(len(FLOORS))]
_PAIRS = [(i, j) for i in range(len(FLOORS)) for j in range(i, len(FLOORS))]
_GROUP = ["group_lang", "group_source"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_row(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    before = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))[at]
    return np.diff(before)


def repeated_words(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Words of each row that lie in a run of ``RUN`` words found twice or more in the row."""
    first, h = window_hashes(hashes, row, RUN)
    order = np.lexsort((h, row[first]))
    first, h = first[order], h[order]
    same = (h[1:] == h[:-1]) & (row[first[1:]] == row[first[:-1]])
    again = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(h) else np.zeros(0, bool)
    edge = np.zeros(len(row) + RUN + 1, np.int64)
    np.add.at(edge, first[again], 1)
    np.add.at(edge, first[again] + RUN, -1)
    return np.bincount(row[np.cumsum(edge)[: len(row)] > 0], minlength=rows)


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of every text of a column: words, their code points, symbols, lines that repeat an
    earlier one, words in repeated runs, and lines with a word."""
    data, at = flat(column)
    start, end, row = words(data, at, WORD)
    n = len(column)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
        held = Counter(line for line in raw[a:b].split(b"\n") if line.strip(b" \t\r\x0b\x0c"))
        lines[i] = held.total()
        dup[i] = lines[i] - len(held)
    return {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": _per_row(WORD[data] & ((data & 0xC0) != 0x80), at),
        "n_symbols": _per_row(_SYMBOL[data], at),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(word_hashes(data, start, end), row, n),
        "n_lines": lines,
    }


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for a, b in slices(column):
            found = statistics(column.slice(a, b - a))
            keys = [batch.column(c).slice(a, b - a) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays(
                [*keys, *[pa.array(v, pa.int64()) for v in found.values()]], names=["doc_id", "lang", "source", *found]
            )


def counted(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, base_failed)`` of every row."""
    ship(docs.sparkSession)
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines".split()
    keys = [F.col("doc_id"), *[F.col(c).cast("string") for c in ("lang", "source")]]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(*keys, "text").mapInArrow(
        _count, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{n} long" for n in names)
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _vector() -> list[Column]:
    """Word length (drawn to a typical one where there are few words), then the square roots of
    the shares of symbols, repeated lines and repeated words."""
    n = F.col("n_words")
    length = (F.ln(F.col("word_chars") / n) - float(np.log(_TYPICAL_LENGTH))) * n / (n + _SHRINK)
    shares = [F.sqrt(F.col(a) / F.col(b)) for a, b in (("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"))]
    return [c.alias(x) for c, x in zip([length, *shares], _X, strict=True)]


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with the group that their estimate is made over."""
    keys = [F.coalesce(F.col(c), F.lit("\0")).alias(f"group_{c}") for c in ("lang", "source")]
    rows = rows.withColumns({"group_lang": keys[0], "group_source": keys[1]})
    size = rows.groupBy(*_GROUP).agg(F.count("*").alias("size"))
    small = size.filter(F.col("size") < LEAST_GROUP).groupBy("group_lang").agg(F.sum("size").alias("rest"))
    named = size.join(small, "group_lang", "left").select(
        *_GROUP,
        F.when((F.col("size") < LEAST_GROUP) & (F.col("rest") < LEAST_GROUP), "\0\0").otherwise(F.col("group_lang")).alias("to_lang"),
        F.when(F.col("size") < LEAST_GROUP, "\0\0").otherwise(F.col("group_source")).alias("to_source"),
    )
    joined = rows.join(named, _GROUP)
    return joined.drop(*_GROUP).withColumnsRenamed({"to_lang": "group_lang", "to_source": "group_source"})


def _running() -> tuple[Window, Window]:
    by = Window.partitionBy(*_GROUP)
    return by.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow), by


def _start(rows: DataFrame) -> DataFrame:
    """Medians of the coordinates (to a two-hundredth) and a plain metric."""
    cells = rows.select(*_GROUP, F.posexplode(F.array(*[F.round(F.col(x) * 200) for x in _X])).alias("k", "bin"))
    counts = cells.groupBy(*_GROUP, "k", "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*_GROUP, "k")
    below = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = counts.withColumns({"below": below, "all": F.sum("n").over(by)}).filter(F.col("below") * 2 >= F.col("all"))
    median = middle.groupBy(*_GROUP, "k").agg((F.min("bin") / 200).alias("at"))
    metric = [F.lit(1 / (4 * FLOORS[i] ** 2) if i == j else 0.0).alias(f"p{i}{j}") for i, j in _PAIRS]
    return median.groupBy(*_GROUP).agg(*[F.max(F.when(F.col("k") == k, F.col("at"))).alias(f"m{k}") for k in range(len(_X))]).select("*", *metric)


def _distance() -> Column:
    d = [F.col(x) - F.col(f"m{k}") for k, x in enumerate(_X)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + (1.0 if i == j else 2.0) * F.col(f"p{i}{j}") * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def _chi2(x: float, halves: int) -> float:
    """Distribution function of chi-square with ``2 * halves`` degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(halves):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - float(np.exp(-x / 2)) * total


def chi2_quantile(p: float, halves: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, halves) < p else (lo, mid)
    return hi


def _consistency() -> float:
    """What a normal covariance shrinks by when only the nearest ``SUBSET`` share is seen."""
    halves = len(_X) // 2
    return SUBSET / _chi2(chi2_quantile(SUBSET, halves), halves + 1)


def _solved(*columns: pa.Array) -> pa.Array:
    """Centre and inverse covariance from a subset's count and sums."""
    n, *sums = (c.to_numpy(zero_copy_only=False) for c in columns)
    k = len(_X)
    out = []
    for row in range(len(n)):
        mean = np.array([sums[i][row] / n[row] for i in range(k)])
        cov = np.zeros((k, k))
        for (i, j), s in zip(_PAIRS, sums[k:], strict=True):
            cov[i, j] = cov[j, i] = s[row] / n[row] - mean[i] * mean[j]
        inverse = np.linalg.inv(cov * _consistency() + np.diag(np.square(FLOORS)))
        out.append([*mean.tolist(), *[float(inverse[i, j]) for i, j in _PAIRS]])
    return pa.array(out, pa.list_(pa.float64()))


def estimates(rows: DataFrame) -> DataFrame:
    """Centre ``m..`` and inverse covariance ``p..`` of every group of ``rows`` with vectors."""
    fitted = materialise(_start(rows))
    names = [*[f"m{k}" for k in range(len(_X))], *[f"p{i}{j}" for i, j in _PAIRS]]
    solve = F.arrow_udf(_solved, "array<double>").asNondeterministic()
    for _ in range(STEPS):
        near = rows.join(fitted, _GROUP).select(
            *_GROUP, *_X, F.floor(F.ln(_distance() + 1e-6) * 50).alias("bin")
        )
        sums = [F.sum(x).alias(x) for x in _X] + [F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"s{i}{j}") for i, j in _PAIRS]
        bins = near.groupBy(*_GROUP, "bin").agg(F.count("*").alias("n"), *sums)
        upto, every = _running()
        columns = ["n", *_X, *[f"s{i}{j}" for i, j in _PAIRS]]
        running = bins.select(*_GROUP, "bin", *[F.sum(c).over(upto).alias(c) for c in columns], F.sum("n").over(every).alias("all"))
        inside = running.filter(F.col("n") >= F.ceil(F.col("all") * SUBSET))
        first = inside.groupBy(*_GROUP).agg(F.min_by(F.struct(*columns), "bin").alias("best")).select(*_GROUP, "best.*")
        solved = first.select(*_GROUP, solve(*[F.col(c).cast("double") for c in columns]).alias("v"))
        fitted = materialise(solved.select(*_GROUP, *[F.get("v", i).alias(c) for i, c in enumerate(names)]))
    return fitted


def judged(docs: DataFrame) -> DataFrame:
    """The statistics of every row with ``base_failed``, ``kept`` and the squared ``distance``
    from its group (null where the rules fail)."""
    rows = materialise(counted(docs))
    passed = materialise(_grouped(rows.filter("not base_failed").select("*", *_vector())))
    cutoff = chi2_quantile(KEEP, len(_X) // 2)
    far = passed.join(estimates(passed), _GROUP).withColumn("distance", F.round(_distance(), 6))
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    good = far.select(*columns, (F.col("distance") <= cutoff).alias("kept"), "distance")
    failed = rows.filter("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return good.unionByName(failed)
