"""Numbers and brands out of catalog text, and back into display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The price field in the raw price text, a run without any Unicode white space, and
# what counts as a number.
AMOUNT_MAX = r'"amountMax":(\d+\.?\d*)'
WORD = r"[^\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _double(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def extract_price_json(prices: Column) -> Column:
    """First ``amountMax`` figure of a JSON-like price text, null when there is none."""
    return _double(F.regexp_extract(prices, AMOUNT_MAX, 1))


def extract_price_text(price: Column) -> Column:
    """The number left after stripping currency signs and separators, else null."""
    return _double(F.regexp_replace(price, "[^0-9.]", ""))


def price_fallback(discounted: Column, actual: Column) -> Column:
    """Discounted price when it parses, else the actual price."""
    return F.coalesce(extract_price_text(discounted), extract_price_text(actual))


def brand_from_name(name: Column) -> Column:
    """First word of the product name."""
    return F.coalesce(
        F.nullif(F.regexp_extract(name, WORD, 0), F.lit("")), F.lit("unknown")
    )


def parse_count(count: Column) -> Column:
    """Digits of a count such as ``24,269``; zero when there are none."""
    digits = F.regexp_replace(count, "[^0-9]", "")
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(0))


def numeric(text: Column) -> Column:
    """Plain decimal text as a double; anything else, NaN and infinities are null."""
    value = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def numeric_or_zero(text: Column) -> Column:
    return F.coalesce(numeric(text), F.lit(0.0))


def parse_rating(rating: Column) -> Column:
    """A number, or a text that starts with one (``4.0 out of 5 stars``)."""
    return numeric(F.regexp_extract(rating, WORD, 0))


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with a set number of places, ties to even, no thousands separators."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def money(price: Column) -> Column:
    """``$x.xx`` for a positive price, else ``N/A``."""
    return F.when((price > 0) & ~F.isnan(price), F.concat(F.lit("$"), fixed(price, 2))).otherwise(
        F.lit("N/A")
    )
