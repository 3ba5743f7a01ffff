"""TF-IDF vectors over catalog text.

A fitted model holds at most ``max_features`` terms, so the vocabulary is the one thing that
may be sent to every task. Texts that fit one row are weighed where they lie, without a
shuffle. Texts spread over many rows (a product with very many reviews) are counted segment
by segment and only their counts are brought together.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfkin.functions.text import ENGLISH_STOP_WORDS, bigrams, clean_text, words
from shelfkin.lineage import materialise
from shelfkin.operators import wordcounts
from shelfkin.shipping import ship

log = logging.getLogger(__name__)

MAX_FEATURES = 5000
# Cells that term uses are summed by before terms are counted one by one; a multiple of 64.
CELLS = 1 << 18
MIN_DF = 2
# Segments of one item that a task links.
BORDER_ROWS = 4096
# Words and segments of an item that is put together in one row: about a megabyte.
ROW_WORDS, ROW_SEGMENTS = 1 << 17, 1 << 12


def with_words(
    items: DataFrame, text: str = "text", stop_words: Sequence[str] = ENGLISH_STOP_WORDS
) -> DataFrame:
    """Replace the text column with its kept words."""
    return items.withColumn("words", words(clean_text(F.col(text)), stop_words)).drop(text)


def with_terms(tokenised: DataFrame) -> DataFrame:
    """Replace the words with words and bigrams."""
    return tokenised.withColumn("terms", F.concat("words", bigrams(F.col("words")))).drop("words")


def _row_counts(terms: DataFrame) -> DataFrame:
    """``(id, term, n)`` of every row of ``terms(id, terms)``, counted inside the row."""
    ordered = terms.select("id", F.array_sort("terms").alias("s"))
    begins = F.filter(
        F.transform("s", lambda t, i: i), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1))
    )
    ends = F.concat(F.slice("starts", F.lit(2), F.size("s")), F.array(F.size("s")))
    runs = F.zip_with("starts", "ends", lambda a, b: F.struct(F.get("s", a).alias("term"), (b - a).cast("bigint").alias("n")))
    counted = ordered.withColumn("starts", begins).withColumn("ends", ends).select("id", F.explode(runs).alias("r"))
    # A row without terms has an end and no start.
    return counted.select("id", "r.term", "r.n").filter("n is not null")


def term_counts(terms: DataFrame) -> DataFrame:
    """``(id, term, n)``: how often each id's ``terms(id, terms)`` hold a term.

    Terms are counted inside their row; only rows whose id comes again, which are looked up first, are
    brought together by id and term. ``terms`` is read three times.
    """
    again = materialise(terms.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("id").alias("_id")))
    same = F.col("id").eqNullSafe(F.col("_id"))
    alone = _row_counts(terms.join(again, same, "left_anti"))
    if again.isEmpty():
        return alone
    many = _row_counts(terms.join(again, same, "left_semi"))
    return alone.unionByName(many.groupBy("id", "term").agg(F.sum("n").alias("n")))


def _vocabulary(totals: DataFrame, n_items: DataFrame, max_features: int, min_df: int) -> DataFrame:
    """``(term, cf, df, idf)`` of the most frequent terms that enough items hold."""
    n = n_items.agg(F.count("*").alias("n")).scalar()
    return (
        totals.filter(F.col("df") >= min_df)
        .orderBy(F.desc("cf"), "term")
        .limit(max_features)
        .withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)
    )


def _cell() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(CELLS)).cast("int")


def cell_totals(terms: DataFrame) -> DataFrame:
    """``(cell, n)``: the uses of all terms that hash to a cell, so no term of it is used more often.
    Sums of tasks merge by adding up; a task passes on ``CELLS`` rows of two numbers at most."""
    return terms.select(F.explode("terms").alias("term")).groupBy(_cell().alias("cell")).agg(F.count("*").alias("n"))


def _marked(rows: DataFrame, cells: np.ndarray) -> DataFrame:
    """The rows whose ``term`` is in a marked cell."""
    words_ = np.packbits(cells, bitorder="little").view(np.int64).tolist()
    marks = F.split(F.lit(",".join(map(str, words_))), ",").cast("array<bigint>")
    return rows.filter(F.getbit(F.get(marks, F.shiftright(_cell(), 6)), _cell().bitwiseAND(63)) == 1)


def term_totals(terms: DataFrame, cells: np.ndarray | None = None) -> DataFrame:
    """``(term, cf, df)`` of the terms in the marked cells (of all without).

    Each row names its terms once with the number of times it uses them, so one shuffle on the
    term, after map-side sums, yields both the corpus count and the document frequency.
    """
    uses = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d")))
    holds = F.transform(
        F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d"))
    )
    rows = terms.select(F.explode(F.concat(uses, holds)).alias("u")).select("u.*")
    if cells is not None:
        rows = _marked(rows, cells)
    return rows.groupBy("term").agg(F.sum("n").alias("cf"), F.sum("d").alias("df"))


def vocabulary(
    terms: DataFrame, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, first: int | None = None
) -> DataFrame:
    """Vocabulary of one-row items: ``terms(id, terms)``, which is read twice or three times.

    A first pass adds up uses by cells of hashes. Only terms of the ``first`` heaviest cells (four
    times ``max_features``) are counted exactly, so most terms of a large corpus, above all its
    bigrams, are never shuffled. If some other cell weighs as much as the last term taken, all
    cells of that weight are counted in one more pass; then no term outside can belong.
    """
    return _heaviest(cell_totals(terms), partial(term_totals, terms), terms.select("id"), max_features, min_df, first)


def _joined(tokenised: DataFrame) -> DataFrame:
    """Words as one string, which goes to Python as it is; null counts as none."""
    return tokenised.select("id", F.coalesce(F.array_join("words", " "), F.lit("")).alias("words"))


def word_vocabulary(
    tokenised: DataFrame, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, first: int | None = None
) -> DataFrame:
    """``vocabulary`` of the terms of ``tokenised(id, words)``, whose words hold no spaces and are not empty, by the same
    passes; words and bigrams are counted as numbers (``wordcounts``)."""
    ship(tokenised.sparkSession)
    rows = _joined(tokenised).select("words")
    cells = CELLS
    sums = rows.mapInArrow(lambda b: wordcounts.cell_sums(b, cells), "cell int, n bigint")

    def totals(marked: np.ndarray) -> DataFrame:
        found = rows.mapInArrow(lambda b: wordcounts.totals(b, marked), "term string, cf bigint, df bigint")
        return found.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))

    sums = sums.groupBy("cell").agg(F.sum("n").alias("n"))
    return _heaviest(sums, totals, tokenised.select("id"), max_features, min_df, first)


def _heaviest(sums: DataFrame, totals: Callable[[np.ndarray], DataFrame], n_items: DataFrame, max_features: int,
              min_df: int, first: int | None) -> DataFrame:
    """The vocabulary by its cells' ``sums`` and the exact ``totals`` of the terms in marked cells."""
    sums = sums.toArrow()
    weight = np.zeros(CELLS, np.int64)
    weight[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    heavy = np.sort(weight)[::-1]
    least = max(1, int(heavy[min(first or 4 * max_features, CELLS) - 1]))
    while True:
        best = materialise(_vocabulary(totals(weight >= least), n_items, max_features, min_df))
        taken = best.agg(F.count("*").alias("n"), F.min("cf").alias("cf")).first()
        enough = taken.cf if taken.n == max_features else 1
        others = int(weight[weight < least].max(initial=0))
        log.info("vocabulary: %.4f of all uses counted exactly", weight[weight >= least].sum() / max(1, weight.sum()))
        if others < enough:
            return best
        least = enough


@dataclass
class TfidfModel:
    """A fitted vocabulary: terms in alphabetical order with their idf."""

    terms: list[str]
    idf: list[float]

    @classmethod
    def of(cls, vocab: DataFrame) -> TfidfModel:
        # No more rows than the vocabulary's own limit.
        rows = sorted(vocab.select("term", "idf").collect())
        return cls([r.term for r in rows], [r.idf for r in rows])

    def term_array(self) -> Column:
        """The terms as one array literal, for looking up an index inside a row."""
        return F.split(F.lit("\n".join(self.terms)), "\n")

    def idf_array(self) -> Column:
        return F.split(F.lit("\n".join(map(repr, self.idf))), "\n").cast("array<double>")

    def lookup(self, spark) -> DataFrame:
        """``(index, term, idf)``, one row per vocabulary term."""
        rows = [(i, t, w) for i, (t, w) in enumerate(zip(self.terms, self.idf))]
        return spark.createDataFrame(rows, "index int, term string, idf double")

    def vectors(self, terms: DataFrame) -> DataFrame:
        """Replace ``terms`` by the sparse unit vector ``(idx, weights)``, row by row."""
        if not self.terms:
            return terms.drop("terms").withColumns(
                {"idx": F.array().cast("array<int>"), "weights": F.array().cast("array<double>")}
            )
        counter = CountVectorizerModel.from_vocabulary(self.terms, inputCol="terms", outputCol="_counts")
        scaler = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_scaled"
        )
        unit = Normalizer(p=2.0, inputCol="_scaled", outputCol="_unit")
        out = unit.transform(scaler.transform(counter.transform(terms)))
        out = out.withColumn("_unit", F.unwrap_udt("_unit"))
        return out.withColumns(
            {"idx": F.col("_unit.indices"), "weights": F.col("_unit.values")}
        ).drop("terms", "_counts", "_scaled", "_unit")

    def word_vectors(self, tokenised: DataFrame) -> DataFrame:
        """``vectors`` of the terms of ``tokenised(id, words)``, whose words hold no spaces and are not empty."""
        if not self.terms:
            return self.vectors(with_terms(tokenised))
        ship(tokenised.sparkSession)
        terms, idf = self.terms, self.idf
        rows = _joined(tokenised)
        kind = rows.schema["id"].dataType.simpleString()
        return rows.mapInArrow(
            lambda b: wordcounts.vectors(b, terms, idf), f"id {kind}, idx array<int>, weights array<double>"
        )

    def item_terms(self, vectors: DataFrame) -> DataFrame:
        """The long form ``(id, term, weight)`` of a vector table."""
        entries = vectors.select(
            "id", F.explode(F.arrays_zip("idx", "weights")).alias("e")
        ).select("id", F.col("e.idx").alias("index"), F.col("e.weights").alias("weight"))
        names = F.broadcast(self.lookup(vectors.sparkSession).select("index", "term"))
        return entries.join(names, "index").select("id", "term", "weight")


def fit(items: DataFrame, text: str = "text", max_features: int = MAX_FEATURES,
        min_df: int = MIN_DF, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> TfidfModel:
    """Learn the vocabulary of ``items(id, text)``."""
    return fit_words(materialise(with_words(items.select("id", text), text, stop_words)), max_features, min_df)


def fit_words(tokenised: DataFrame, max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> TfidfModel:
    """Learn the vocabulary of ``tokenised(id, words)``."""
    return TfidfModel.of(word_vocabulary(tokenised, max_features, min_df))


def fit_vectors(items: DataFrame, text: str = "text", max_features: int = MAX_FEATURES, min_df: int = MIN_DF,
                stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> tuple[TfidfModel, DataFrame]:
    """The model of ``items(id, text)`` and their vectors; texts are cut into words once."""
    tokenised = materialise(with_words(items.select("id", text), text, stop_words))
    model = fit_words(tokenised, max_features, min_df)
    return model, model.word_vectors(tokenised)


def item_vectors(items: DataFrame, model: TfidfModel, text: str = "text",
                 stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """``(id, idx, weights)`` for ``items(id, text)``."""
    return model.vectors(with_terms(with_words(items.select("id", text), text, stop_words)))


def _links(ends: DataFrame, by: list[str], order: str) -> DataFrame:
    """``(id, term)``: the last word of each row before the first one of the next, rows of equal
    ``by`` in ``order``."""
    last = F.lag("last").over(Window.partitionBy(*by).orderBy(order))
    linked = ends.select("id", F.concat_ws(" ", last, "first").alias("term"), last.isNotNull().alias("crosses"))
    return linked.filter("crosses").select("id", "term")


def border_bigrams(tokenised: DataFrame, bucket_rows: int = BORDER_ROWS) -> DataFrame:
    """``(id, term)``: the bigrams across the borders of ``tokenised(id, seq, words)``, none of them
    empty.

    Segments are linked inside buckets of ``seq``, then the buckets by their own first and last
    words: a product with very many segments is as many tasks, and its buckets are a small table.
    """
    ends = tokenised.select(
        "id", "seq", F.expr(f"seq div {bucket_rows}").alias("bucket"),
        F.element_at("words", 1).alias("first"), F.element_at("words", -1).alias("last"),
    )
    edges = ends.groupBy("id", "bucket").agg(F.min_by("first", "seq").alias("first"), F.max_by("last", "seq").alias("last"))
    return _links(ends, ["id", "bucket"], "seq").unionByName(_links(edges, ["id"], "bucket"))


def segment_term_counts(segments: DataFrame, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """``(id, term, n)`` over ``segments(id, seq, text)`` read in ``seq`` order.

    Equal to counting the terms of the segments joined by spaces. Bigrams that cross a long item's
    border come from a table of first and last words alone, so an item with a great many
    segments never has its text gathered. The segments of all other items, up to ``ROW_WORDS`` words of
    them, are put together first, so that words are shuffled instead of their terms. Segments are cut into
    words once, and terms counted inside their row.
    """
    tokenised = materialise(with_words(segments, "text", stop_words).filter(F.size("words") > 0))
    sizes = tokenised.groupBy("id").agg(F.sum(F.size("words")).alias("words"), F.count("*").alias("rows"))
    large = (F.col("words") > ROW_WORDS) | (F.col("rows") > ROW_SEGMENTS)
    long = materialise(sizes.filter(large).select(F.col("id").alias("_id")))
    same = F.col("id").eqNullSafe(F.col("_id"))
    gathered = (
        tokenised.join(long, same, "left_anti")
        .select("id", F.struct("seq", F.array_join("words", " ").alias("words")).alias("segment"))
        .groupBy("id").agg(F.sort_array(F.collect_list("segment")).alias("segments"))
    )
    whole = _row_counts(with_terms(gathered.select("id", F.split(F.array_join("segments.words", " "), " ").alias("words"))))
    if long.isEmpty():
        return whole
    rest = tokenised.join(long, same, "left_semi")
    borders = border_bigrams(rest).withColumn("n", F.lit(1).cast("bigint"))
    counted = _row_counts(with_terms(rest)).unionByName(borders).groupBy("id", "term").agg(F.sum("n").alias("n"))
    return whole.unionByName(counted)


def segment_vocabulary(counts: DataFrame, ids: DataFrame, max_features: int = MAX_FEATURES,
                       min_df: int = MIN_DF) -> DataFrame:
    """Vocabulary from ``counts(id, term, n)``, a written table, by the passes of ``vocabulary``; ``ids`` has one row
    per item, empty ones too."""
    sums = counts.groupBy(_cell().alias("cell")).agg(F.sum("n").alias("n"))

    def totals(marked: np.ndarray) -> DataFrame:
        return _marked(counts, marked).groupBy("term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))

    return _heaviest(sums, totals, ids, max_features, min_df, None)


def segment_vectors(counts: DataFrame, ids: DataFrame, model: TfidfModel) -> DataFrame:
    """``(id, idx, weights)`` from ``counts(id, term, n)``; items without terms get empty arrays.

    An item's group holds at most one row per vocabulary term.
    """
    weighed = counts.join(F.broadcast(model.lookup(counts.sparkSession)), "term").select(
        "id", "index", (F.col("n") * F.col("idf")).alias("x")
    )
    gathered = weighed.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("index", "x"))).alias("entries"),
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"),
    ).select(
        "id",
        F.col("entries.index").alias("idx"),
        F.transform("entries.x", lambda x: x / F.col("norm")).alias("weights"),
    )
    return ids.select("id").join(gathered, "id", "left").select(
        "id",
        F.coalesce("idx", F.array().cast("array<int>")).alias("idx"),
        F.coalesce("weights", F.array().cast("array<double>")).alias("weights"),
    )
