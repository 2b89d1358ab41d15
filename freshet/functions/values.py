"""Measured values: missing-token normalisation, number parsing, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .constants import NA_TOKENS, SPLIT_MAX, SPLIT_MIN, WHITESPACE

# Decimal or scientific notation with single underscores between digits, or infinity.
NUMBER_PATTERN = (
    r"^[+-]?((\d+(_\d+)*\.?|(\d+(_\d+)*)?\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf(inity)?)$"
)
PLAIN_PATTERN = r"^-?\d+(\.\d+)?$"
NAN_TEXTS = ("nan", "+nan", "-nan")

READING_DECIMAL = "decimal(15,3)"


def strip(text: Column) -> Column:
    """Remove all leading and trailing whitespace, not spaces alone."""
    return F.trim(text, F.lit(WHITESPACE))


def null_if_missing(text: Column) -> Column:
    """Null for the texts that stand for a missing cell."""
    return F.when(~text.isin(*NA_TOKENS), text)


def normalise_missing(df: DataFrame) -> DataFrame:
    """Apply :func:`null_if_missing` to every string column."""
    return df.select(
        *[
            null_if_missing(F.col(f"`{name}`")).alias(name) if kind == "string" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def _number(stripped_lower: Column) -> Column:
    # The JVM cast takes a trailing type letter and refuses underscores; the pattern settles both.
    plain = F.replace(stripped_lower, F.lit("_"), F.lit(""))
    return F.when(stripped_lower.rlike(NUMBER_PATTERN), plain.try_cast("double"))


def odd_text(text: Column) -> Column:
    """The stripped lower-case text of a cell that is not a plain decimal; null for one that is."""
    return F.when(~text.rlike(PLAIN_PATTERN), F.lower(strip(text)))


def number_of(text: Column, odd: Column) -> Column:
    """The number of a whole cell, given its :func:`odd_text`."""
    # nearly all cells are plain decimals, which need no clean-up
    return F.when(odd.isNull(), text.try_cast("double")).otherwise(_number(odd))


def parse_number(text: Column) -> Column:
    """Text to double; null unless the whole text is a number (NaN is none)."""
    return number_of(text, odd_text(text))


def last_part(odd: Column) -> Column:
    """What follows the last ``|``; null if there is none."""
    return F.when(F.contains(odd, F.lit("|")), strip(F.substring_index(odd, "|", -1)))


def chosen_value(number: Column, part: Column) -> Column:
    """The number of the whole text, or that of its last part if in range."""
    return F.coalesce(number, F.when(part.between(SPLIT_MIN, SPLIT_MAX), part))


def value_status(text: Column, number: Column, odd: Column, tail: Column, part: Column) -> Column:
    """How a cell was understood, from the steps of reading it.

    Status 0 plain number, 1 missing, 2 the word nan, 3 signed nan, 5 not a
    number, 6 number after the last ``|``, 7 that number is NaN or out of
    range, 8 that part is no number.
    """
    return (
        F.when(number.isNotNull(), 0)
        .when(text.isNull(), 1)
        .when(part.between(SPLIT_MIN, SPLIT_MAX), 6)
        .when(part.isNotNull() | tail.isin(*NAN_TEXTS), 7)
        .when(tail.isNotNull(), 8)
        .when(odd == "nan", 2)
        .when(odd.isin(*NAN_TEXTS), 3)
        .otherwise(5)
    )


def measured_value(text: Column) -> Column:
    """``struct<value double, status int>`` of one reading cell; see :func:`value_status`."""
    odd = odd_text(text)
    number, tail = number_of(text, odd), last_part(odd)
    part = parse_number(tail)
    return F.struct(
        chosen_value(number, part).alias("value"), value_status(text, number, odd, tail, part).alias("status")
    )


def stored_value(value: Column) -> Column:
    """The value at the table's precision; infinities and overflow become null."""
    return value.try_cast(READING_DECIMAL)


def period_seconds(text: Column) -> Column:
    """Whole seconds, truncated toward zero; 0 for anything unusable."""
    return F.coalesce(parse_number(text).try_cast("int"), F.lit(0))


def number_or_zero(text: Column) -> Column:
    """Double with null, empty and unusable text as 0."""
    return F.coalesce(parse_number(text), F.lit(0.0))


def integer_or_zero(text: Column) -> Column:
    """Whole number with null, empty and unusable text as 0."""
    return F.coalesce(parse_number(text).try_cast("int"), F.lit(0))


def number_or_null(text: Column) -> Column:
    """Double, null kept as null."""
    return parse_number(text)


def meta_version(text: Column) -> Column:
    """Version text as ``decimal(2,1)``."""
    return text.try_cast("decimal(2,1)")
