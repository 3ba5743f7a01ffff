"""Repeated lines across documents, by a log-template tree of fixed depth.

A line's place in the tree is its number of tokens and then its leading tokens; tokens that hold
a digit are variable fields from the start and read ``<*>``. Below that leaf a line belongs to
its own template and, from ``WILD_FROM`` tokens on, to those in which one eighth of the remaining
tokens is a further variable field. Lines of fewer than ``LEAST`` tokens say too little to have
fields: they are templates as they stand, digits included. A template met in two or more documents
recurs: its lines stay in the first of them (smallest id) and are dropped from all others.

Everything is a DataFrame expression over hashes. Texts are cut into lines once; the places and
hashes of lines are written and both the tree and the marking of places start from them. Lines
are grouped map-side before anything else, so a line held by a third of the corpus is one row per
task; where places meet recurring lines again, the lines that make up more than one
``HOT_SHARE``-th of all places (so no more than ``HOT_SHARE`` of them) are broadcast. Texts move
once, to meet the numbers of their dropped lines.

Defined results: null and empty texts stay as they are, blank lines are kept. Rows with a null id
count as one document, the first of all; repeated rows are one document and keep or lose the same
lines. Ids of other kinds than whole numbers are ordered as text, where a null id equals an empty
one. A text that loses every line is empty.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shelfkin.lineage import materialise

LEAD, PARTS, LEAST, WILD_FROM = 3, 8, 5, 8
HOT_SHARE = 1024
# Characters between tokens, and a token with a digit.
SPACE = r"[\t-\r ]+"
VARIABLE = r"(?<![^\t-\r ])[^\t-\r 0-9]*+[0-9][^\t-\r ]*+"
FIELD = "<*>"
_NO_ID = -(1 << 63)
_PARTS = [f"part{k}" for k in range(PARTS)]


def _document(docs: DataFrame) -> Column:
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc, text_hash, pos, line, tokens, n)`` of every line. Blank lines are left out later, by
    their hashes: a condition here would cut every line into tokens a second time."""
    lines = docs.select(
        _document(docs).alias("doc"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )
    line = F.col("line")
    # Looking for plain strings is quick, and most lines have neither digits nor odd blanks.
    digits, odd = ((reduce(or_, map(line.contains, found))) for found in ("0123456789", ["  ", *"\t\x0b\x0c\r"]))
    masked = F.when(digits, F.regexp_replace(line, VARIABLE, FIELD)).otherwise(line)
    tokens = F.when(
        odd | line.startswith(" ") | line.endswith(" "), F.split(F.btrim(masked, F.lit("\t\n\x0b\x0c\r ")), SPACE)
    ).otherwise(F.split(masked, " "))
    return lines.select("doc", "text_hash", "pos", "line", tokens.alias("tokens")).withColumn("n", F.size("tokens"))


def _leaf() -> Column:
    return F.xxhash64("n", F.slice("tokens", 1, LEAD))


def _line() -> Column:
    """The line's hash; short lines are hashed with their digits, only their blanks made alike."""
    bare = F.array_join(F.split(F.btrim("line", F.lit("\t\n\x0b\x0c\r ")), SPACE), " ")
    return F.when(F.col("n") < LEAST, F.xxhash64("n", bare)).otherwise(F.xxhash64("tokens"))


def _part_start(k: int) -> Column:
    return F.floor((F.col("n") - LEAD) * k / PARTS).cast("int")


def _part(k: int) -> Column:
    here = F.slice("tokens", _part_start(k) + LEAD + 1, _part_start(k + 1) - _part_start(k))
    return F.when(F.col("n") >= WILD_FROM, F.hash(here))


def places(docs: DataFrame) -> DataFrame:
    """``(doc, text_hash, pos, leaf, line, n, part0..)`` of every line with a token."""
    parts = [_part(k).alias(p) for k, p in enumerate(_PARTS)]
    blank = (F.col("n") == 1) & (F.get("tokens", 0) == "")
    keyed = _lines(docs).select(
        "doc", "text_hash", "pos", _leaf().alias("leaf"), F.when(~blank, _line()).alias("line"), "n", *parts
    )
    return keyed.filter("line is not null")


def line_table(places: DataFrame) -> DataFrame:
    """Distinct lines ``(leaf, line, n, part0.., first, last, times)`` with their first and last
    document and the number of their places."""
    figures = F.max("n").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("times")
    return places.groupBy("leaf", "line", *_PARTS).agg(*figures)


def recurring(lines: DataFrame) -> DataFrame:
    """``(line, first, times)``: lines of templates that more than one document holds, the first of
    these documents and the number of the line's places."""
    branches = lines.filter(F.col("n") >= WILD_FROM).groupBy("leaf").agg(F.min("line").alias("a"), F.max("line").alias("b"))
    shared = branches.filter("a != b").select("leaf")
    wild = [
        F.when(
            _part_start(k + 1) > _part_start(k),
            F.xxhash64(F.lit(k), *[p for p in _PARTS if p != f"part{k}"]),
        )
        for k in range(PARTS)
    ]
    member = (
        lines.filter(F.col("n") >= WILD_FROM)
        .join(shared, "leaf")
        .select("leaf", "line", "first", "last", "times", F.explode(F.array_compact(F.array(*wild))).alias("template"))
    )
    template = member.groupBy("leaf", "template").agg(F.min("first").alias("start"), F.max("last").alias("stop"))
    general = member.join(template.filter("start != stop"), ["leaf", "template"]).select("line", F.col("start").alias("first"), "times")
    exact = lines.filter("first != last").select("line", "first", "times")
    return exact.unionByName(general).groupBy("line").agg(F.min("first").alias("first"), F.max("times").alias("times"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``(doc, text_hash, dropped)``: the places (from 0) of the lines that each text loses."""
    every = materialise(places(docs))
    seen = materialise(recurring(materialise(line_table(every))))
    met = every.select("doc", "text_hash", "pos", "line")
    hot = seen.filter(F.col("times") > every.count() / HOT_SHARE).select("line", F.col("first").alias("hot"))
    met = met.join(F.broadcast(hot), "line", "left")
    cold = met.filter("hot is null").join(seen.select("line", "first"), "line").filter(F.col("doc") > F.col("first"))
    gone = cold.select("doc", "text_hash", "pos").unionByName(met.filter(F.col("doc") > F.col("hot")).select("doc", "text_hash", "pos"))
    return gone.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("dropped"))


def deduplicate(docs: DataFrame, into: str = "lines") -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text`` and a column ``into`` of
    ``struct<n_lines, n_dropped>``."""
    gone = dropped_lines(docs).select(
        F.col("doc").alias("__doc"), F.col("text_hash").alias("__text_hash"), F.col("dropped").alias("__dropped")
    )
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    text = F.when(
        F.col("__dropped").isNull(), F.col("text")
    ).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    counts = F.struct(
        F.coalesce(1 + F.length("text") - F.length(F.translate("text", "\n", "")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    same = (_document(docs) == F.col("__doc")) & (F.xxhash64("text") == F.col("__text_hash"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", into)]
    joined = docs.join(gone, same, "left").select(*kept, counts.alias(into), text.alias("text"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != into], into)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without recurring lines; a row that loses all its words goes."""
    into = "__lines"
    done = deduplicate(docs, into)
    emptied = (F.col(f"{into}.n_dropped") > 0) & ~F.col("text").rlike(r"[^\t-\r ]")
    return done.filter(~emptied | F.col("text").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
