"""Most similar items by cosine of their TF-IDF vectors.

Scores are rounded to six digits, lists are ordered by score descending and id ascending, and
an item is never its own neighbour. Three routes give the same lists:

* one item: an equi join of its few terms with the weight table, of which the written postings by
  term give just these terms (``recommend_one``);
* few items: their vectors, a checked number of entries, go to every task and the catalog is
  scanned once where it lies; more of them take up to ``FEW_ROUNDS`` such rounds, so that nothing but
  the best of a task is shuffled;
* many items: equal vectors are collapsed and the rest is laid out in blocks of like items.
  Every item first meets its own block, which sets the score it must beat, its floor. With the
  floors known, the cheaper of two exact ways finds what other blocks hold:

  - an inverted index (``_indexed``). An item's terms are ordered rarest first. Two items whose
    first common term is ``t`` score at most the product of what is left of their norms from
    ``t`` on, so an item looks only under its leading terms, those from which on the rest of its
    norm reaches the floor, and meets only postings whose own rest is large enough. A term's
    sources and postings are dealt to cells of a bounded size, so a term that a third of all
    items hold is many tasks;
  - groups of blocks against groups of blocks (``_foreign``), where nearly everything resembles
    everything and an index would meet the same pair under many terms. Blocks meet in single
    precision, once for both directions where all items are sources, and only the pairs that may
    reach a floor are worked out in double precision. Where few items are sources they lie in groups
    of their own, so that the catalog is copied to as few places as their number asks for.

  Which one is cheaper follows from counts of the index's pairs, in large catalogs over a share of the
  items that a hash draws (it decides costs, never results). Pairs of items never become rows:
  a task holds two bounded sets of vectors and passes on the best few per item.
"""

from __future__ import annotations

import logging
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfkin.lineage import materialise, task_count
from shelfkin.operators.sparse import DIGITS, Block, Lists, Rows, best_targets, by_id, ids_of, meet, merged, slices
from shelfkin.operators.tfidf import TfidfModel
from shelfkin.shipping import ship

log = logging.getLogger(__name__)

BLOCK_ROWS = 1024
# Sources and postings of a term that meet in one task.
CELL_ROWS = 2048
# Sources are few while their vectors hold no more entries than this, 48 MB on every executor, in each of
# so many rounds at most.
FEW_ENTRIES, FEW_ROUNDS = 4 << 20, 16
# Catalog rows that are laid out in blocks of like rows together, where sources are few.
GROUP_ROWS = 16 * BLOCK_ROWS
GROUP_BLOCKS = 64
# The index's pairs are counted over one item in so many where there are more items than that.
COUNTED, COUNT_SHARE = 1 << 13, 16
# Ids of one vector that take their list in one task, where the vector is hot.
SALT_ROWS, HOT_KEYS = 4096, 1024
MERGE_AFTER = 32
# Rows of a bucket of the postings by term: a term's reader goes through so many, or its own rows where
# these are more.
POSTINGS = 1 << 18
# The index is taken while its pairs are fewer than this share of all pairs: a pair may meet under
# several terms there, and every meeting brings two vectors.
INDEX_SHARE = 0.25
# More than half a step of the rounded scores, so that a bound is never a tie too low.
SLACK = 1e-6


# ---------------------------------------------------------------- shared pieces


def _id_type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def _pair_schema(df: DataFrame) -> str:
    t = _id_type(df)
    return f"id {t}, rec_id {t}, score double"


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns, to be told from those of a table that ``df`` comes from too."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _nothing(rows: pa.Table) -> pa.Table:
    return pa.table({"id": rows["id"][:0], "rec_id": rows["id"][:0], "score": pa.array([], pa.float64())})


def _lists(scored: DataFrame, keep: int) -> DataFrame:
    """``(id, recs)`` with the first ``keep`` of each id's scored rows, best first."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "rec_id")
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= keep)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "rec_id", "score"))).alias("recs"))
    )


def _without_self(recs: Column, k: int) -> Column:
    """Drop the item itself from a list one longer than wanted, and cut it."""
    kept = F.filter(recs, lambda r: r.rec_id != F.col("id"))
    return F.slice(F.transform(kept, lambda r: F.struct(r.rec_id, r.score)), 1, k)


def _no_recs(df: DataFrame) -> Column:
    return F.array().cast(f"array<struct<rec_id:{_id_type(df)},score:double>>")


# ---------------------------------------------------------------- few items


def _alike(rows: Rows, idf: np.ndarray) -> np.ndarray:
    """Positions of the rows, like ones together: by the term each uses most often, common ones first."""
    if not len(rows.ids):
        return np.zeros(0, int)
    times = rows.weights / idf[rows.idx]
    most = np.maximum.reduceat(times, np.searchsorted(rows.line, np.arange(len(rows.ids))))
    at = np.flatnonzero(times >= most[rows.line] - 1e-9)
    at = at[np.lexsort((rows.idx[at], idf[rows.idx[at]], rows.line[at]))]
    lead = rows.idx[at[np.unique(rows.line[at], return_index=True)[1]]]
    return np.lexsort((lead, idf[lead]))


def _gathered(batches, rows: int):
    """Tables of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from slices(pa.Table.from_batches(held), rows)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _few(vectors: DataFrame, sources: DataFrame, k: int, model: TfidfModel, rounds: int = 1) -> DataFrame:
    """Lists of few sources: one pass over the catalog in each round, ``k + 1`` rows per source and task.

    A round's sources, like ones together, are held by every task as blocks; catalog rows meet them in
    blocks of like rows too. Floors rise with what the task has found.
    """
    idf, n_terms, context = np.array(model.idf), len(model.terms), vectors.sparkSession.sparkContext

    def blocks(table: pa.Table) -> list[tuple[np.ndarray, Block]]:
        order = _alike(Rows.of(table), idf)
        parts = [order[a:a + BLOCK_ROWS] for a in range(0, len(order), BLOCK_ROWS)]
        return [(rows, Block(Rows.of(table.take(pa.array(rows)).combine_chunks()), n_terms)) for rows in parts]

    def scan(shared):
        def run(batches):
            source = shared.value.combine_chunks()
            asked, found = blocks(source), []
            floor, best = np.zeros(source.num_rows), None
            for part in _gathered(batches, GROUP_ROWS):
                targets = by_id(part)
                lists = Lists(floor, k + 1)
                lists.best = lists.best if best is None else best
                for there, theirs in blocks(targets):
                    for here, mine in asked:
                        row, col, value = meet(mine, theirs, k + 1, lists.floor[here])
                        lists.add(here[row], there[col], value)
                row, item, value = lists.result()
                floor, best = lists.floor, lists.best
                found.append(pa.table({
                    "id": ids_of(source).take(pa.array(row)), "rec_id": ids_of(targets).take(pa.array(item)), "score": value,
                }))
                if len(found) > MERGE_AFTER:
                    found = [merged(found, k + 1)]
            if found:
                yield from merged(found, k + 1).to_batches()

        return run

    chosen = sources.select("id", "idx", "weights")
    if rounds > 1:
        chosen = materialise(chosen.withColumn("round", F.pmod(F.xxhash64("id", F.lit(2)), rounds)))
    scored = []
    for i in range(rounds):
        now = chosen.filter(F.col("round") == i).drop("round") if rounds > 1 else chosen
        shared = context.broadcast(now.toArrow())
        scored.append(vectors.select("id", "idx", "weights").mapInArrow(scan(shared), _pair_schema(vectors)))
    return _lists(reduce(DataFrame.unionByName, scored), k + 1).select("id", _without_self(F.col("recs"), k).alias("recs"))


# ---------------------------------------------------------------- many items


def _vector_key() -> Column:
    text = [F.array_join(F.col(c).cast("array<string>"), ",") for c in ("idx", "weights")]
    return F.sha2(F.concat_ws("|", *text), 256)


def _blocked(keyed: DataFrame, asked: DataFrame | None, model: TfidfModel, k: int,
             block_rows: int) -> DataFrame:
    """Distinct vectors laid out in blocks, like items together; ``block`` numbers them.

    Of equal vectors the ``k + 1`` smallest ids stand for all: they have the same score to
    every item, so no further copy can enter a list of ``k``. The window limit runs before the
    shuffle. Rows are ordered by the term they use most often, common ones first, and then by
    their heaviest term; the id at the end splits rows that agree on both. Every range of that
    order is cut into blocks as it stands, so the number of tasks is the session's and not that of
    the blocks. ``asked`` names the vectors wanted as sources.
    """
    same = Window.partitionBy("key")
    idf = model.idf_array()
    used = F.array_max(F.transform(
        F.arrays_zip("idx", "weights"),
        lambda e: F.struct(
            F.round(e.weights / F.get(idf, e.idx), 9).alias("times"),
            (-F.get(idf, e.idx)).alias("common"),
            e.idx.alias("idx"),
        ),
    ))
    heaviest = F.element_at("idx", F.array_position("weights", F.array_max("weights")).cast("int"))
    kept = (
        keyed.withColumn("copy", F.row_number().over(same.orderBy("id")))
        .filter(F.col("copy") <= k + 1)
        .withColumn("copied", F.count("*").over(same) > 1)
    )
    if asked is None:
        kept = kept.withColumn("source", F.col("copy") == 1)
    else:
        kept = kept.join(asked.withColumn("asked", F.lit(True)), "key", "left").withColumn(
            "source", (F.col("copy") == 1) & F.coalesce("asked", F.lit(False))
        ).drop("asked")
    order = [F.desc("used.common"), F.col("used.idx"), F.col("heavy"), F.col("id")]
    ordered = kept.withColumn("used", used).withColumn("heavy", heaviest).repartitionByRange(
        task_count(keyed.sparkSession), *order
    ).sortWithinPartitions(*order)
    # A task's number in the upper bits, the row's in the lower 33: a block never spans two tasks.
    place = F.monotonically_increasing_id()
    task, row = F.shiftright(place, 33), place.bitwiseAND((1 << 33) - 1)
    block = F.shiftleft(task, 33) + F.floor(row / block_rows).cast("long")
    return ordered.withColumn("block", block).drop("used", "heavy", "copy")


def _home(blocked: DataFrame, k: int, n_terms: int) -> DataFrame:
    """Best targets of every source inside its own block."""

    def scan(block: pa.Table) -> pa.Table:
        table = by_id(block)
        targets, lead = Rows.of(table), np.flatnonzero(table["source"].to_numpy())
        found = [_nothing(block)]
        for start in range(0, len(lead), BLOCK_ROWS):
            found.append(best_targets(targets.take(lead[start:start + BLOCK_ROWS]), targets, n_terms, k + 1))
        return pa.concat_tables(found)

    rows = blocked.select("id", "idx", "weights", "source", "block")
    return rows.groupBy("block").applyInArrow(scan, _pair_schema(blocked))


def _rests(number: np.ndarray):
    """Rows ``(id, idx, weights, floor)`` as entries ``(id, term, rest, floor)``, each vector's rarest
    term first: ``rest`` is the norm of its entries from there on. ``number`` counts the items per term."""

    def run(batches):
        for batch in batches:
            rows = Rows.of(pa.Table.from_batches([batch]))
            order = np.lexsort((rows.idx, number[rows.idx], rows.line))
            line, squares = rows.line[order], rows.weights[order] ** 2
            upto = np.concatenate(([0.0], np.cumsum(squares)))
            end = np.searchsorted(line, line, "right")
            rest = np.sqrt(np.maximum(upto[end] - upto[np.arange(len(line))], squares))
            at = pa.array(line)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), pa.array(rows.idx[order], pa.int32()), pa.array(rest), batch.column("floor").take(at)],
                names=["id", "term", "rest", "floor"],
            )

    return run


def _index_sides(blocked: DataFrame, floors: DataFrame, n_terms: int) -> tuple[DataFrame, DataFrame]:
    """``(id, term, rest, floor)`` of the leading terms that each source looks under, and ``(id,
    term, rest)`` of the postings that some source may need.

    A source needs a posting where the product of both rests reaches its floor; a posting below the
    least that any source asks of its term is left out.
    """
    # One number per vocabulary term.
    held = blocked.select(F.explode("idx").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()
    number = np.zeros(n_terms, np.int64)
    number[held["term"].to_numpy()] = held["n"].to_numpy()
    least = F.greatest(F.coalesce("floor", F.lit(0.0)) - SLACK, F.lit(0.0))
    rows = blocked.select("id", "idx", "weights", "source").join(floors, "id", "left").select(
        "id", "idx", "weights", F.when(F.col("source"), least).alias("floor")
    )
    kind = blocked.schema["id"].dataType.simpleString()
    entries = materialise(rows.mapInArrow(_rests(number), f"id {kind}, term int, rest double, floor double"))
    asked = entries.filter("rest >= floor")
    need = asked.groupBy("term").agg(F.min(F.col("floor") / F.col("rest")).alias("need"))
    postings = entries.select("id", "term", "rest").join(F.broadcast(need), "term")
    return asked, postings.filter(F.col("rest") >= F.col("need") - SLACK).select("id", "term", "rest")


def _index_cells(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """``(term, sources, targets)``: how many there are of each; one row per vocabulary term."""
    s, t = (d.groupBy("term").agg(F.count("*").alias(name)) for d, name in ((asked, "sources"), (postings, "targets")))
    return s.join(t, "term")


def _indexed(blocked: DataFrame, asked: DataFrame, postings: DataFrame, cells: DataFrame, k: int, n_terms: int,
             cell_rows: int) -> DataFrame:
    """Best targets of every source among the postings of its leading terms.

    A cell is a term, a part of its sources and a part of its postings; vectors join the rows of
    their cells.
    """
    parts = F.broadcast(cells.select(
        "term", F.ceil(F.col("sources") / cell_rows).cast("int").alias("of_sources"),
        F.ceil(F.col("targets") / cell_rows).cast("int").alias("of_targets"),
    ))
    vectors = blocked.select("id", "idx", "weights")

    def side(rows: DataFrame, own: str, other: str) -> DataFrame:
        """The part of a row by its id; it goes to all parts of the other side."""
        mine = F.pmod(F.xxhash64("id"), F.col(f"of_{own}")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"of_{other}") - 1))
        return rows.join(parts, "term").withColumn(own, mine).withColumn(other, every).drop("of_sources", "of_targets").join(vectors, "id")

    left = side(asked, "sources", "targets")
    right = side(postings, "targets", "sources")
    schema = _pair_schema(blocked)

    def meet(sources: pa.Table, targets: pa.Table) -> pa.Table:
        if not sources.num_rows or not targets.num_rows:
            return pa.table({"id": sources["id"][:0], "rec_id": targets["id"][:0], "score": pa.array([], pa.float64())})
        targets = by_id(targets)
        # No pair of the cell can be worth more than with the largest rest of the other side.
        lift = pc.greater_equal(pc.multiply(sources["rest"], pc.max(targets["rest"])), pc.subtract(sources["floor"], SLACK))
        sources = sources.filter(lift).combine_chunks()
        there, found = Rows.of(targets), [_nothing(sources)]
        for part in slices(sources, BLOCK_ROWS):
            found.append(best_targets(Rows.of(part.combine_chunks()), there, n_terms, k + 1, part["floor"].to_numpy()))
        return pa.concat_tables(found)

    key = ["term", "sources", "targets"]
    return left.groupBy(*key).cogroup(_renewed(right).groupBy(*key)).applyInArrow(meet, schema)


def _cells(blocked: DataFrame, floors: DataFrame, blocks: list, n_groups: int, n_source_groups: int | None) -> tuple[DataFrame, int]:
    """The rows of every cell, and how many cells there are. Blocks are dealt to groups in turn; a cell is
    two groups that meet.

    Without ``n_source_groups`` the groups hold sources and other rows alike and meet once for both
    directions: a row is on side 0, on side 1, or on both (2) where its group meets itself. With them,
    side 0 holds sources only, in groups of their own.
    """
    places = blocked.sparkSession.createDataFrame([(b, i) for i, b in enumerate(blocks)], "block bigint, place int")
    least = F.greatest(F.coalesce("floor", F.lit(0.0)) - SLACK, F.lit(0.0))
    rows = (
        blocked.select("id", "idx", "weights", "block", "source")
        .join(F.broadcast(places), "block")
        .join(floors, "id", "left")
        .withColumn("floor", F.when(F.col("source"), least).otherwise(F.lit(float("inf"))))
    )
    columns = ["id", "idx", "weights", "place", "floor"]
    group = F.col("place") % n_groups

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    if n_source_groups is None:
        low, high = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
        met = rows.select(*columns, group.alias("own"), every(n_groups).alias("other"))
        cell = F.expr("high * (high + 1) div 2 + low").cast("int").alias("cell")
        met = met.select(*columns, low.alias("low"), high.alias("high"), side.alias("side"))
        return met.select(*columns, "side", cell), n_groups * (n_groups + 1) // 2
    left = rows.filter("source").select(
        *columns, F.lit(0).alias("side"), (F.col("place") % n_source_groups).alias("own"), every(n_groups).alias("other")
    )
    right = rows.select(*columns, F.lit(1).alias("side"), every(n_source_groups).alias("own"), group.alias("other"))
    cell = (F.col("own") * n_groups + F.col("other")).cast("int").alias("cell")
    return left.unionByName(right).select(*columns, "side", cell), n_groups * n_source_groups


def _met(both: bool, k: int, n_terms: int, block_rows: int):
    """Best partners inside the one cell of a task; ``both`` if side 1 wants partners too."""

    def parts(rows: pa.Table) -> list[int]:
        """Where blocks begin, and the end. Sources without their blocks' other rows are cut anew."""
        if not both:
            return [*range(0, rows.num_rows, block_rows), rows.num_rows]
        place = rows["place"].to_numpy()
        return [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]

    def numbered(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A row of every id in id order, and every row's place in that order."""
        order = pc.sort_indices(ids).to_numpy()
        code = ids.dictionary_encode("encode").indices.to_numpy()[order]
        first = np.concatenate([[True], code[1:] != code[:-1]])[:len(code)]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(first) - 1
        return order[first], number

    def run(batches):
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        sides = []
        for other in (1, 0):
            side = rows.filter(pc.not_equal(rows["side"], other))
            side = side.take(pc.sort_indices(side, [("place", "ascending"), ("id", "ascending")])).combine_chunks()
            order, number = numbered(side["id"].combine_chunks())
            sides.append((side, order, number, side["floor"].to_numpy().copy(), parts(side)))
        del rows
        (left, l_order, l_number, l_floor, l_at), (right, r_order, r_number, r_floor, r_at) = sides
        l_lists = Lists(l_floor, k + 1, len(r_order) == right.num_rows)
        r_lists = Lists(r_floor, k + 1, len(l_order) == left.num_rows)

        def block(side: pa.Table, start: int, end: int) -> Block:
            return Block(Rows.of(side.slice(start, end - start).combine_chunks()), n_terms)

        l_place, r_place = left["place"].to_numpy(), right["place"].to_numpy()
        if not len(l_place) or not len(r_place):
            return
        here = [(a, b, block(left, a, b)) for a, b in zip(l_at, l_at[1:])]
        for start, end in zip(r_at, r_at[1:]):
            there = block(right, start, end)
            for low, high, mine in here:
                # Where a group meets itself, a block and those before it have met.
                if both and l_place[low] >= r_place[start] and (right["side"][start].as_py() == 2):
                    continue
                row, col, value = meet(mine, there, k + 1, l_lists.floor[low:high], r_lists.floor[start:end] if both else None)
                l_lists.add(low + row, r_number[start + col], value)
                if both:
                    r_lists.add(start + col, l_number[low + row], value)
        for own, lists, others, order in ((left, l_lists, right, r_order), (right, r_lists, left, l_order))[:2 if both else 1]:
            row, item, value = lists.result()
            found = pa.table({
                "id": own["id"].combine_chunks().take(pa.array(row)),
                "rec_id": others["id"].combine_chunks().take(pa.array(order[item])), "score": value,
            })
            yield from found.to_batches()

    return run


def _foreign(blocked: DataFrame, floors: DataFrame, rows: int, asked: int | None, k: int, n_terms: int, block_rows: int) -> DataFrame:
    """Best targets of the sources beyond their own blocks, ``asked`` of them (all without)."""
    # One row per block.
    blocks = sorted(r.block for r in blocked.select("block").distinct().collect())
    cores = blocked.sparkSession.sparkContext.defaultParallelism
    groups = _group_count(rows, max(block_rows, BLOCK_ROWS), cores)
    source_groups = None
    if asked is not None:
        source_groups = min(len(blocks), math.ceil(asked / (GROUP_BLOCKS * BLOCK_ROWS)))
        groups = max(groups, math.ceil(4 * cores / source_groups))
    cells, n = _cells(blocked, floors, blocks, min(groups, len(blocks)), source_groups)
    return cells.repartitionById(n, "cell").mapInArrow(_met(asked is None, k, n_terms, block_rows), _pair_schema(blocked))


def _group_count(rows: int, block_rows: int, cores: int) -> int:
    """Large groups copy rows to fewer places; small inputs still need a task per core."""
    blocks = math.ceil(rows / block_rows)
    return max(1, math.ceil(blocks / GROUP_BLOCKS), min(blocks, math.ceil(math.sqrt(4 * cores))))


def _elsewhere(blocked: DataFrame, floors: DataFrame, rows: int, k: int, n_terms: int, block_rows: int,
               cell_rows: int, index_share: float, every_row: bool) -> DataFrame:
    """Best targets of the sources beyond their own blocks, the cheaper way."""
    sources = blocked.filter("source").count()
    if index_share > 0:
        share = COUNT_SHARE if rows > COUNTED else 1
        drawn = blocked.filter(F.pmod(F.xxhash64("id", F.lit(1)), share) == 0) if share > 1 else blocked
        asked, postings = _index_sides(drawn, floors, n_terms)
        cells = materialise(_index_cells(asked, postings))
        pairs = cells.agg(F.sum(F.col("sources").cast("double") * F.col("targets"))).first()[0] or 0.0
        every = max(float(sources) * rows / share**2, 1.0)
        log.info("neighbours: the index compares %.3f of all pairs", pairs / every)
        if pairs <= index_share * every:
            if share > 1:
                asked, postings = _index_sides(blocked, floors, n_terms)
                cells = materialise(_index_cells(asked, postings))
            return _indexed(blocked, asked, postings, cells, k, n_terms, cell_rows)
    return _foreign(blocked, floors, rows, None if every_row else sources, k, n_terms, block_rows)


def _many(vectors: DataFrame, sources: DataFrame | None, model: TfidfModel, k: int,
          block_rows: int, cell_rows: int = CELL_ROWS, index_share: float = INDEX_SHARE) -> DataFrame:
    n_terms = len(model.terms)
    keyed = materialise(vectors.withColumn("key", _vector_key()))
    wanted, asked = keyed.select("id", "key"), None
    if sources is not None:
        wanted = wanted.join(sources.select("id"), "id", "left_semi")
        asked = wanted.select("key").distinct()
    blocked = materialise(_blocked(keyed, asked, model, k, block_rows))
    rows = blocked.count()

    scored = _home(blocked, k, n_terms)
    if rows:
        home = materialise(scored)
        floors = home.groupBy("id").agg(
            F.when(F.count("*") > k, F.min("score")).alias("floor")
        ).filter("floor is not null")
        more = _elsewhere(blocked, floors, rows, k, n_terms, block_rows, cell_rows, index_share, asked is None)
        # The index meets an item's own block, and may meet a pair under several terms.
        scored = home.unionByName(more).groupBy("id", "rec_id").agg(F.max("score").alias("score"))
    groups = _lists(scored, k + 1).join(
        blocked.filter("source").select("id", "key", "copied"), "id"
    )
    alone = groups.filter(~F.col("copied")).select("id", "recs")
    # A key of more than a HOT_KEYS-th of all ids is dealt out; there are fewer than HOT_KEYS of them.
    hot = wanted.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") * HOT_KEYS > wanted.count())
    hot = F.broadcast(materialise(hot.select("key", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))))
    salts = F.coalesce("salts", F.lit(1))
    salted = groups.filter("copied").join(hot, "key", "left").select(
        "key", "recs", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    members = wanted.join(hot, "key", "left").select("id", "key", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    copies = members.join(salted, ["key", "salt"]).select("id", "recs")
    return alone.unionByName(copies).select("id", _without_self(F.col("recs"), k).alias("recs"))


# ---------------------------------------------------------------- operators


def _padded(lists: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """Fill short lists with zero-score items in id order.

    The first ``k + 1`` ids of the catalog suffice: a list with p entries lacks k - p, and at
    most p + 1 of those ids are taken.
    """
    head = catalog.select("id").orderBy("id").limit(k + 1)
    first = head.agg(F.sort_array(F.collect_list("id"))).scalar()
    free = F.filter(
        F.col("_first"), lambda x: (x != F.col("id")) & ~F.exists("recs", lambda r: r.rec_id == x)
    )
    fill = F.transform(free, lambda x: F.struct(x.alias("rec_id"), F.lit(0.0).alias("score")))
    return lists.withColumn("_first", first).select(
        "id", F.slice(F.concat("recs", fill), 1, k).alias("recs")
    )


def _entries(vectors: DataFrame) -> int:
    return vectors.agg(F.coalesce(F.sum(F.size("idx")), F.lit(0))).first()[0]


def neighbour_lists(vectors: DataFrame, model: TfidfModel, k: int = 5,
                    sources: DataFrame | None = None, pad: bool = False,
                    block_rows: int = BLOCK_ROWS, few: int = FEW_ENTRIES,
                    index_share: float = INDEX_SHARE) -> DataFrame:
    """``(id, recs array<struct<rec_id, score>>)``, one row per source, best first.

    ``vectors(id, idx, weights)`` is the catalog; ``sources`` limits whose lists are wanted.
    Without ``pad`` a list holds positive scores only. ``few`` is the number of vector entries
    up to which sources are sent to every task in a round, ``index_share`` the share of all pairs up to which
    the index is taken.
    """
    ship(vectors.sparkSession)
    with_terms = vectors.filter(F.size("idx") > 0)
    empty = vectors.filter(F.size("idx") == 0).select("id", _no_recs(vectors).alias("recs"))
    if sources is None:
        lists = _many(with_terms, None, model, k, block_rows, index_share=index_share)
    else:
        sources = materialise(sources.select("id").distinct())
        empty = empty.join(sources, "id", "left_semi")
        chosen = with_terms.join(sources, "id", "left_semi")
        # Count ids before looking at vectors: every vector has an entry at least.
        most = few * FEW_ROUNDS
        if sources.count() <= most and (entries := _entries(chosen)) <= most:
            lists = _few(with_terms, chosen, k, model, max(1, math.ceil(entries / few)))
        else:
            lists = _many(with_terms, sources, model, k, block_rows, index_share=index_share)
    lists = lists.unionByName(empty)
    return _padded(lists, vectors, k) if pad else lists


def ranked(lists: DataFrame) -> DataFrame:
    """``(id, rec_id, score, rank)`` rows of neighbour lists."""
    rows = lists.select("id", F.posexplode_outer("recs").alias("pos", "rec"))
    return rows.filter("pos is not null").select(
        "id", "rec.rec_id", "rec.score", (F.col("pos") + 1).alias("rank")
    )


def term_postings(item_terms: DataFrame, buckets: int | None = None) -> DataFrame:
    """``item_terms(id, term, weight)`` with ``buckets`` and ``bucket``, in the order to be written in.

    Partitioned by these two and sorted by term inside, reading some terms opens their
    buckets' files only and skips the row groups of the other terms there. ``bucket`` is a hash of
    the term; there are ``buckets`` of them, of about ``POSTINGS`` rows. Rows are dealt by ranges, so
    a term that very many items hold makes several files. They are dealt and ordered by a number, the bucket
    before more of the term's hash, so no terms are compared.
    """
    if buckets is None:
        buckets = max(8, min(4096, math.ceil(item_terms.count() / POSTINGS)))
    rest = F.shiftrightunsigned(F.xxhash64("term"), 16)
    place = F.shiftleft(_bucket(F.lit(buckets)).cast("bigint"), 48).bitwiseOR(rest)
    rows = item_terms.select("id", "term", "weight", place.alias("place"))
    dealt = rows.repartitionByRange("place", "id").withColumn("bucket", F.shiftright("place", 48).cast("int"))
    # The bucket comes first, as the writer looks for: it would sort again and lose the terms' order.
    ordered = dealt.sortWithinPartitions("bucket", "place")
    return ordered.select("id", "term", "weight", F.lit(buckets).alias("buckets"), "bucket")


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("term"), buckets).cast("int")


def shared_postings(postings: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of written ``term_postings`` that hold one of the terms (no more than a vocabulary).

    The scan opens the files of the terms' buckets. The terms are one list, which is looked up by hash:
    a row is checked once, however many terms are asked.
    """
    one = postings.select("buckets").limit(1).collect()
    if not terms or not one:
        return postings.limit(0)
    names = postings.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    buckets = sorted({r.b for r in names.select(_bucket(F.lit(one[0].buckets)).alias("b")).collect()})
    return postings.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def recommend_one(item_terms: DataFrame, item_id, k: int = 5, catalog: DataFrame | None = None,
                  postings: DataFrame | None = None) -> DataFrame:
    """``(id, score, rank)``: the ``k`` items most like one item, from ``item_terms(id, term, weight)``.

    With ``postings``, a written ``term_postings``, only the item's own terms are read of it;
    without, the whole of ``item_terms``. With ``catalog(id)`` a short list is filled with zero-score
    items in id order.
    """
    source = item_terms.filter(F.col("id") == F.lit(item_id)).select(
        "term", F.col("weight").alias("source_weight")
    )
    others = item_terms
    if postings is not None:
        own = source.collect()  # an item's terms are a part of the vocabulary
        source = item_terms.sparkSession.createDataFrame(own, "term string, source_weight double")
        others = shared_postings(postings, [r.term for r in own])
    scored = (
        others.filter(F.col("id") != F.lit(item_id))
        .join(F.broadcast(source), "term")
        .groupBy("id")
        .agg(F.round(F.sum(F.col("weight") * F.col("source_weight")), DIGITS).alias("score"))
        .filter("score > 0")
    )
    if catalog is not None:
        known = catalog.filter(F.col("id") == F.lit(item_id)).select(F.lit(True).alias("known"))
        best = scored.orderBy(F.desc("score"), "id").limit(k)
        spare = (
            catalog.select("id").orderBy("id").limit(k + 1)
            .filter((F.col("id") != F.lit(item_id)) & known.limit(1).scalar())
            .withColumn("score", F.lit(0.0))
        )
        scored = best.unionByName(spare).groupBy("id").agg(F.max("score").alias("score"))
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
