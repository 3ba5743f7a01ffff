"""Text cleaning and term extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark ML's default English stop words, in that list's order. Cleaned text
# holds no apostrophes, so the contractions of that list could never match and are left out.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now cannot could ought would
""".split()

# Runs of non-word characters that are not just one space, which would be replaced by itself.
GAPS = r"[^\p{L}\p{N}_ ][^\p{L}\p{N}_]*+| [^\p{L}\p{N}_]++"


def clean_text(text: Column) -> Column:
    """Tags dropped, every run of non-word characters one space, trimmed, lower case.

    Word characters are Unicode letters, numbers and the underscore, without combining marks.
    Missing text becomes the empty string.
    """
    known = F.coalesce(text, F.lit(""))
    untagged = F.when(F.contains(known, F.lit("<")), F.regexp_replace(known, "<[^>]+>", "")).otherwise(known)
    return F.lower(F.trim(F.regexp_replace(untagged, GAPS, " ")))


def category_text(categories: Column) -> Column:
    """Cleaned category path whose levels are separated by pipes."""
    return clean_text(F.translate(categories, "|", " "))


def words(clean: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Words of two or more characters that are not stop words, in text order."""
    return F.filter(
        F.split(clean, " "), lambda w: (F.length(w) >= 2) & ~w.isin(list(stop_words))
    )


def bigrams(tokens: Column) -> Column:
    """Each word joined to the one after it; bigrams bridge removed stop words."""
    pairs = F.size(tokens) - 1
    return F.when(
        pairs >= 1,
        F.zip_with(
            F.slice(tokens, F.lit(1), pairs),
            F.slice(tokens, F.lit(2), pairs),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    ).otherwise(F.array().cast("array<string>"))
