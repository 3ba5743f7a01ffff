"""Documents whose sets of word n-grams are alike, by adaptive multi-match prefixes.

A document is its set of shingles of ``size`` words, 4 unless told otherwise (as 64-bit hashes).
Texts with equal sets are one class.
Shingles are put in one order for the whole corpus, rare ones first, by a table of counts of a
set size (``2^SKETCH_BITS``), which only orders and never decides. Of a set of ``n`` that has to
share ``need`` with any partner, the first ``n - need + l`` shingles hold at least ``l`` common
ones. Each document picks the ``l`` that makes its estimated cost least: longer prefixes cost
rows, shorter ones candidates to verify. A pair becomes a candidate only when its prefixes share
as many shingles as the two lengths demand, and is verified on the whole texts.

Shingles of very many documents (copies of one text, each changed a little) do not make pairs of
all of them: the group first meets its most typical member, and only what that leaves unlinked
meets the rest. Links inside one component need not be known, so no component is lost.

Defined results: no words, no set, no link. Repeated rows are one class. A component takes the
smallest id of its rows; null ids count only where there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfkin.lineage import materialise
from shelfkin.llm.arrow import WORD, flat, lower, mix, slices, window_hashes, word_hashes, words
from shelfkin.llm.components import components
from shelfkin.shipping import ship

WORDS, SHARE = 4, 85
SKETCH_BITS, BLOCKS = 20, 64
MOST_MATCHES = 16
#: A shingle is hot when this many documents more than the background hold it.
HOT = 64
_SHIFT = np.uint64(64 - SKETCH_BITS)
#: Ids of candidate texts that are sent to all tasks; more of them are joined by a shuffle.
SENT_IDS = 500_000


def need(n: int, share: int = SHARE) -> int:
    """Shingles that a set of ``n`` has in common with any partner."""
    return (share * n + 99) // 100


def shingles(column: pa.Array, weights: np.ndarray | None = None, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the distinct shingles of every row, by row, then by weight and hash."""
    data, at = flat(column)
    data = lower(data)
    start, end, row = words(data, at, WORD)
    hashes = word_hashes(data, start, end)
    parts = [window_hashes(hashes, row, size)]
    count = np.bincount(row, minlength=len(column)) if len(row) else np.zeros(len(column), np.int64)
    short = count[row] < size
    for n in range(1, size):
        first, h = window_hashes(hashes[short], row[short], n)
        whole = count[row[short][first]] == n
        parts.append((np.flatnonzero(short)[first[whole]], mix(h[whole] + np.uint64(n))))
    row = row[np.concatenate([f for f, _ in parts])]
    h = np.concatenate([x for _, x in parts])
    keys = (h, row) if weights is None else (h, weights[(h >> _SHIFT).astype(np.int64)], row)
    order = np.lexsort(keys)
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def sets(column: pa.Array, weights: np.ndarray | None = None, size: int = WORDS) -> Iterator[tuple[int, np.ndarray, int]]:
    """``(row, shingles, class)`` of every row that has words; the class is a hash of the set."""
    row, h = shingles(column, weights, size)
    if not len(h):
        return
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    with np.errstate(over="ignore"):
        known = mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first)).view(np.int64)
    for r, a, b, c in zip(row[first], first, [*first[1:], len(h)], known.tolist(), strict=True):
        yield int(r), h[a:b], c


def _classes_and_counts(size: int):
    """One row per document, and the task's counts of its distinct sets' shingles in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen: set[int] = set()
        names = ["doc_id", "text_hash", "n", "class", "block", "counts"]
        kind = pa.int64()
        for batch in batches:
            kind = batch.column("doc_id").type
            for a, b in slices(batch.column("text")):
                held, known = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                fresh = []
                for r, h, c in sets(batch.column("text").slice(a, b - a), size=size):
                    held[r], known[r] = len(h), c
                    if c not in seen:
                        seen.add(c)
                        fresh.append(h)
                if fresh:
                    counts += np.bincount((np.concatenate(fresh) >> _SHIFT).astype(np.int64), minlength=len(counts)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("text_hash").slice(a, b - a), pa.array(held), pa.array(known),
                     pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], names=names)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(BLOCKS, kind), *[pa.nulls(BLOCKS, pa.int64())] * 3,
                 pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in np.split(counts, BLOCKS)], pa.binary())],
                names=names)

    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in table.column("counts"))
    total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def sketch(rows: DataFrame) -> np.ndarray:
    """The corpus counts: ``2^SKETCH_BITS`` numbers come to the driver. Two steps of sums keep a
    task's share small however many tasks counted."""
    part = rows.select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("salt"))
    kind = "block int, counts binary"
    once = part.groupBy("block", "salt").applyInArrow(lambda t: _sum_counts(t.select(["block", "counts"])), kind)
    found = {r.block: r.counts for r in once.groupBy("block").applyInArrow(_sum_counts, kind).collect()}
    if not found:
        return np.zeros(1 << SKETCH_BITS, np.uint32)
    return np.concatenate([np.frombuffer(found[k], np.uint32) for k in range(BLOCKS)])


def matches(partners: np.ndarray, n: int, least: int) -> int:
    """How many common shingles a document asks for: the ``l`` of least estimated cost.

    ``partners`` are the estimated other holders of its shingles, in order. A prefix shingle
    costs a row and its partners; at most ``partners / l`` candidates match ``l`` times, and
    each costs a look at ``n`` shingles."""
    most = min(MOST_MATCHES, least)
    met = np.cumsum(partners)[n - least : n - least + most] + 0.05 * (n - least + np.arange(1, most + 1))
    length = np.arange(1, most + 1)
    return int(np.argmin(length + met * (1 + n / 4 / length))) + 1


def _prefix_rows(counts: np.ndarray, share: int, size: int):
    background = counts.mean()
    excess = np.maximum(counts - background - 3 * np.sqrt(background), 0)
    hot_from = max(HOT, 6 * np.sqrt(background))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in slices(batch.column("text")):
                out: list[list] = [[] for _ in range(8)]
                for _, h, c in sets(batch.column("text").slice(a, b - a), counts, size):
                    if c in seen:
                        continue
                    seen.add(c)
                    n = len(h)
                    least = need(n, share)
                    partners = excess[(h >> _SHIFT).astype(np.int64)]
                    asked = matches(partners, n, least)
                    length = n - least + asked
                    partners = partners[:length]
                    heat = int(min(partners.sum() / length * 1000, 2**31 - 1))
                    hot = partners > hot_from
                    row = h[:length].view(np.int64), c, n, np.arange(length), asked, int(hot.sum()), heat, hot
                    for at, x in zip(out, row, strict=True):
                        at.append(x if isinstance(x, np.ndarray) else np.full(length, x, np.int64))
                if out[0]:
                    cols = [np.concatenate(x) for x in out]
                    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.bool_()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip(cols, kinds, strict=True)],
                        names=["token", "class", "n", "pos", "asked", "hots", "heat", "hot"])

    return run


def _alike(share: int, size: int):
    def verdict(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), bool)
        step = 256
        for a in range(0, len(left), step):
            l, r = ({i: np.sort(h) for i, h, _ in sets(x.slice(a, step), size=size)} for x in (left, right))
            for i in l.keys() & r.keys():
                both = len(np.intersect1d(l[i], r[i], assume_unique=True))
                out[a + i] = 100 * both >= share * (len(l[i]) + len(r[i]) - both)
        return pa.array(out)

    return F.arrow_udf(verdict, "boolean").asNondeterministic()


def _common(share: int, x: str = "a", y: str = "b") -> Column:
    """Shingles that two sets of sizes ``n_x`` and ``n_y`` have in common when they are alike."""
    return F.ceil(share * (F.col(f"n_{x}") + F.col(f"n_{y}")) / (100 + share))


def _in_reach(share: int, later: Column | int, x: str = "a", y: str = "b") -> Column:
    """Sizes that allow a link, and a shared shingle early enough in both orders: of alike sets,
    the ``l``-th common shingle has at most ``n - common + l - 1`` before it on either side.
    ``later`` is ``l - 1``."""
    fits = 100 * F.least(f"n_{x}", f"n_{y}") >= share * F.greatest(f"n_{x}", f"n_{y}")
    for z in (x, y):
        fits &= F.col(f"pos_{z}") <= F.col(f"n_{z}") - _common(share, x, y) + later
    return fits


class _Corpus:
    """Texts by class, fetched for candidates only."""

    def __init__(self, docs: DataFrame, reps: DataFrame, share: int, size: int):
        self.docs, self.reps, self.alike = docs, reps, _alike(share, size)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` whose whole texts are alike."""
        pairs = materialise(pairs.select("a", "b"))
        nodes = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        wanted = materialise(self.reps.join(nodes, "class").select("class", "row.*"))
        send = F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted
        same = self.docs["doc_id"].eqNullSafe(send["doc_id"]) & (self.docs["text_hash"] == send["text_hash"])
        text = materialise(self.docs.join(send, same).select("class", "text").dropDuplicates(["class"]))
        a, b = (text.select(F.col("class").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b")
        return materialise(both.filter(self.alike("text_a", "text_b")).select("a", "b"))


def _ends(rows: DataFrame, x: str, *more: str) -> DataFrame:
    columns = ("class", "n", "pos", *more)
    return rows.select("token", *[F.col(c).alias(x if c == "class" else f"{c}_{x}") for c in columns])


def _hot_links(hot: DataFrame, corpus: _Corpus, share: int) -> tuple[DataFrame | None, DataFrame | None]:
    """``(links, pairs)``: links of the hot shingles' typical members, and the pairs that share
    a hot shingle early enough and are still in different components."""
    if hot.isEmpty():
        return None, None
    links, rows, lead = None, hot.withColumn("root", F.col("class")), None
    for _ in range(2):
        left = rows if lead is None else rows.join(lead.select("token", "lead_root"), "token").filter("root != lead_root")
        best = F.max_by(F.struct("class", "n", "pos"), F.struct("heat", "class")).alias("best")
        head = left.groupBy("token").agg(best, F.count("*").alias("size")).filter("size > 1")
        head = head.select("token", F.col("best.class").alias("a"), F.col("best.n").alias("n_a"), F.col("best.pos").alias("pos_a"))
        met = _ends(left, "b").join(head, "token").filter(F.col("a") != F.col("b")).filter(_in_reach(share, 0))
        new = corpus.verified(met.select("a", "b").distinct())
        links = new if links is None else links.unionByName(new)
        root = components(links).select(F.col("node").alias("class"), F.col("root").alias("found"))
        rows = materialise(hot.join(root, "class", "left").withColumn("root", F.coalesce("found", "class")).drop("found"))
        if lead is None:
            first = head.select("token", F.col("a").alias("class")).join(root, "class", "left")
            lead = materialise(first.select("token", F.coalesce("found", "class").alias("lead_root")))
    split = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("token")
    rows = rows.join(split, "token").join(lead, "token")
    open_ = _ends(rows.filter("root != lead_root"), "a", "root")
    pairs = open_.join(_ends(rows, "b", "root", "lead_root"), "token").filter(
        "root_a != root_b and (root_b = lead_root_b or a < b)"
    )
    return links, pairs.filter(_in_reach(share, 0)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _candidates(cold: DataFrame, share: int) -> DataFrame:
    """Pairs whose prefixes share as many shingles as both ask for; hot shingles, which are not
    looked at here, may be as many of them as the two prefixes hold."""
    asked = F.least("asked_a", "asked_b")
    a, b = (_ends(cold, x, "asked", "hots") for x in "ab")
    met = a.join(b, "token").filter("a < b").filter(_in_reach(share, asked - 1))
    one = met.select("a", "b", "token", (asked - F.least("hots_a", "hots_b")).alias("least"))
    shared = one.groupBy("a", "b").agg(F.count_distinct("token").alias("shared"), F.min("least").alias("least"))
    return shared.filter("shared >= least").select("a", "b")


def _grouped(docs: DataFrame, share: int, size: int) -> DataFrame:
    """``(doc_id, text_hash, n, root, component_id)`` of every row of ``docs``: the size of its set,
    and the name and smallest id of its component (null for an empty set)."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = materialise(texts.mapInArrow(
        _classes_and_counts(size), f"doc_id {kind}, text_hash long, n long, class long, block int, counts binary"))
    each = rows.filter("block is null").select("doc_id", "text_hash", "n", "class")
    counts = sketch(rows.filter("block is not null"))
    # The smallest id names the class; its text is that of the row with the largest.
    row = F.max(F.struct("doc_id", "text_hash")).alias("row")
    reps = materialise(
        rows.filter("block is null and n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), row)
    )
    corpus = _Corpus(texts, reps, share, size)
    prefix = materialise(texts.select("text").mapInArrow(
        _prefix_rows(counts, share, size), "token long, class long, n int, pos int, asked int, hots int, heat int, hot boolean"))
    hot = prefix.filter("hot").filter(F.col("pos") <= F.col("n") - F.floor((share * F.col("n") + 99) / 100))
    links, hot_pairs = _hot_links(hot.select("token", "class", "n", "pos", "heat").distinct(), corpus, share)
    pairs = _candidates(prefix.filter("not hot"), share)
    if hot_pairs is not None:
        pairs = pairs.unionByName(hot_pairs).distinct()
    edges = corpus.verified(pairs)
    if links is not None:
        edges = edges.unionByName(links)
    root = components(edges).withColumnRenamed("node", "class")
    named = reps.join(root, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    member = named.join(smallest, "root").select("class", "root", "component_id")
    return each.join(member, "class", "left").drop("class")


def near_duplicates(docs: DataFrame, share: int = SHARE, size: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs``, by shingles of ``size`` words
    of which ``share`` percent are common."""
    return _grouped(docs, share, size).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, share: int = SHARE, size: int = WORDS) -> DataFrame:
    """One row of every group: that with the group's smallest id, a null one last. Rows without
    words stay.

    Rows are told apart by id and text, so rows that share an id or have none are judged each by
    its own text. Of rows that agree on both, one stays; which, where other columns differ, is open.
    """
    rows = _grouped(docs, share, size).filter("n > 0").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    rows = materialise(rows)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    first = first.select("root", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_text"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_text"))
    marks = rows.join(first, "root").filter(~is_first | (F.col("copies") > 1)).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), is_first.alias("__first")
    )
    marks = materialise(marks)
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__text"))
    kept = docs.join(marks.filter("not __first"), same, "left_anti")
    again = marks.filter("__first")
    if again.isEmpty():
        return kept
    same = kept["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(kept["text"]) == F.col("__text"))
    marked = kept.join(again, same, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = marked.filter("__first is null").select(*columns)
    return alone.unionByName(marked.filter("__first").dropDuplicates(["__id", "__text"]).select(*columns))
