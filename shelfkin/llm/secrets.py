"""Secrets in texts: fixed patterns, and candidate strings by sliding-window Shannon entropy.

A candidate is a run of letters, digits and ``+/_=-`` with a digit in it. Over each of its windows
of ``WINDOW`` characters the counts are kept incrementally: one character comes in, one goes out,
and the sum of ``c log2 c`` moves by table. Windows at or above the threshold of the candidate's
character class (hexadecimal or wider) mark the span from the first one's start to the last one's
end, unless the candidate is on the allow-list. All of it is column expressions inside the row.

Places are code points, ends exclusive. A null text is empty; an empty text has no span. Repeated
rows get equal answers; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of spans in their order, and the patterns of the first three.
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_wide"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Bits per character that a window needs, for hexadecimal and for wider candidates.
BITS = {"entropy_hex": 3.0, "entropy_wide": 3.75}
#: Candidates that look random but are not secret: UUIDs, numbers with separators, words and short
#: numbers with separators, and placeholders.
ALLOWED = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^([A-Za-z]+|[0-9]{1,4})([+/_=-]+([A-Za-z]+|[0-9]{1,4}))*$",
    r"(?i)example|placeholder|x{6}",
]
_SCALE = 1_000_000
#: Matches whose places are summed up at a time, so that copies grow with the matches.
BLOCK = 128


def _sums(numbers: Column) -> Column:
    """Running sums of a short array; every step copies those before it."""
    empty = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("sums"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x
        return F.struct(total.alias("sum"), F.concat(acc["sums"], F.array(total)).alias("sums"))

    return F.aggregate(numbers, empty, step)["sums"]


def _blocks(numbers: str) -> Column:
    """An array in blocks of ``BLOCK`` numbers."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(BLOCK))
    return F.transform(starts, lambda k: F.slice(numbers, k, BLOCK))


def _lengths(words: Column) -> Column:
    return F.transform(words, lambda w: F.length(w))


def _steps(matches: str, pieces: str) -> Column:
    """From each match's start to the next one's: the match before it and the piece between them.
    Arrays are zipped, never looked up from inside a lambda: there the optimiser may put the
    expression that makes them, to be worked out for every match."""
    before = F.concat(F.array(F.lit(0)), _lengths(F.col(matches)))
    steps = F.zip_with(_lengths(F.col(pieces)), before, lambda a, b: a + b)
    return F.when(F.size(matches) > 0, F.slice(steps, F.lit(1), F.size(matches))).otherwise(F.array().cast("array<int>"))


def _placed(kind: int, starts: str, matches: str) -> Column:
    """The spans of matches from where they start."""
    return F.zip_with(starts, matches, lambda a, m: F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + F.length(m)).alias("stop")))


def _entropy_range(codes: Column, most: Column) -> Column:
    """``struct<first, last>``: where the first window of entropy high enough starts and the last
    one ends (both -1 without any). ``most`` is the largest scaled sum of ``c log2 c`` that passes."""
    table = F.array(*[F.lit(round(c * math.log2(c) * _SCALE) if c else 0).cast("long") for c in range(WINDOW + 2)])
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0).cast("long").alias("sum"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )

    def step(acc: Column, i: Column) -> Column:
        comes = F.get(codes, i)
        goes = F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(0)
        had, lost = F.get(acc["counts"], comes), F.get(acc["counts"], goes)
        change = F.get(table, had + 1) - F.get(table, had)
        change = change + F.when(goes > 0, F.get(table, lost - 1) - F.get(table, lost)).otherwise(0)
        total = acc["sum"] + F.when(comes == goes, 0).otherwise(change)
        counts = F.transform(
            acc["counts"], lambda c, k: c + F.when(k == comes, 1).otherwise(0) - F.when((k == goes) & (goes > 0), 1).otherwise(0)
        )
        passes = (i >= WINDOW - 1) & (total <= most)
        return F.struct(
            counts.alias("counts"), total.alias("sum"),
            F.when(passes & (acc["first"] < 0), i - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
            F.when(passes, i + 1).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))
    )


def _codes(words: str) -> Column:
    """Every word as places of its characters in the alphabet, from 1."""
    return F.transform(words, lambda w: F.transform(
        F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c)))


def _random_ranges(words: str, codes: str) -> Column:
    """Per word its kind and the range of its random windows; null ranges on the allow-list."""

    def one(word: Column, i: Column) -> Column:
        is_hex = word.rlike("^[0-9a-fA-F]+$")
        limit = {k: math.floor(WINDOW * (math.log2(WINDOW) - b) * _SCALE) for k, b in BITS.items()}
        most = F.when(is_hex, limit["entropy_hex"]).otherwise(limit["entropy_wide"]).cast("long")
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed |= word.rlike(pattern)
        kind = F.when(is_hex, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_wide"))
        return F.struct(kind.alias("kind"), F.when(~allowed, _entropy_range(F.get(codes, i), most)).alias("range"))

    return F.transform(words, one)


def _cut(spans: str, ranges: str) -> Column:
    """The candidates' spans cut to their random windows; those without any go."""

    def cut(span: Column, i: Column) -> Column:
        found = F.get(ranges, i)
        return F.struct(
            (span["start"] + found["range"]["first"]).alias("start"), found["kind"].alias("kind"),
            F.when(found["range"]["first"] >= 0, span["start"] + found["range"]["last"]).alias("stop"),
        )

    return F.filter(F.transform(spans, cut), lambda s: s["stop"].isNotNull())


def spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, added)``: the spans of the fixed patterns and of random strings, each
    ``array<struct<start, kind, stop>>`` with kinds as places in ``KINDS``."""
    text = F.col("text")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = found.select("*", *[
        (F.when(text.contains("AKIA"), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
         if name == "access" else F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(name)
        for name, p in patterns.items()
    ])
    found = found.select(
        "doc_id", *patterns,
        *[F.when(F.size(name) > 0, F.split("text", p, -1)).alias(f"{name}_pieces") for name, p in patterns.items()],
        F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("values"),
    )
    # One step after the other, by names: steps, blocks of them, running sums inside the blocks and of
    # the blocks, and both added up.
    names = list(patterns)
    held = found.select("doc_id", "values", *names, *[_steps(x, f"{x}_pieces").alias(f"{x}_steps") for x in names])
    held = held.select("*", *[_blocks(f"{x}_steps").alias(f"{x}_blocks") for x in names])
    held = held.select("*", *[F.transform(f"{x}_blocks", _sums).alias(f"{x}_sums") for x in names])
    held = held.select("*", *[
        F.concat(F.array(F.lit(0)), _sums(F.transform(f"{x}_sums", lambda s: F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0))))).alias(f"{x}_before")
        for x in names
    ])
    held = held.select("*", *[
        F.flatten(F.zip_with(
            f"{x}_sums", F.slice(f"{x}_before", F.lit(1), F.size(f"{x}_sums")), lambda s, b: F.transform(s, lambda v: v + b)
        )).alias(f"{x}_starts") for x in names
    ])
    placed = held.select(
        "doc_id", "values", "random", _codes("random").alias("codes"),
        *[_placed(KINDS.index(x) if x in KINDS else -1, f"{x}_starts", x).alias(f"{x}_spans") for x in names],
    )
    long = F.transform(
        F.filter(F.arrays_zip(F.col("assign_spans").alias("span"), F.coalesce("values", F.array().cast("array<string>")).alias("value")),
                 lambda z: F.length(z["value"]) >= LEAST_VALUE),
        lambda z: z["span"],
    )
    base = F.array_sort(F.concat(long, F.col("access_spans"), F.col("hex_spans")))
    ranged = placed.select("doc_id", base.alias("base"), "random_spans", _random_ranges("random", "codes").alias("ranges"))
    return ranged.select("doc_id", "base", _cut("random_spans", "ranges").alias("added"))


def written(found: Column) -> Column:
    """``kind:start:end`` of spans, by start and kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(one, ",")


def _is(kind: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of every row."""
    found = spans(docs)
    counts = [
        F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])
    ]
    return found.select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
    )
