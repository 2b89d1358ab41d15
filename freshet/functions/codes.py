"""Code maps of the reading attributes as literal map lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .constants import DATUM_TYPES, PERIOD_SECONDS, QUALIFIERS, VALUE_TYPES
from .values import strip


def _lookup(codes: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(codes.items()))), key)


def datum_type(code: Column) -> Column:
    """Datum URI of a code; null if unknown."""
    return _lookup(DATUM_TYPES, code)


def period_in_seconds(code: Column) -> Column:
    """Seconds of a period name; null if unknown."""
    return _lookup(PERIOD_SECONDS, code)


def period_text(code: Column) -> Column:
    """Seconds of a period name as text, or the name itself if unknown."""
    return F.coalesce(period_in_seconds(code).cast("string"), code)


def value_type(code: Column) -> Column:
    """Word for a value type code, or the code itself if unknown."""
    return F.coalesce(_lookup(VALUE_TYPES, code), code)


def qualifier(code: Column) -> Column:
    """Words for a qualifier code, or the code itself if unknown."""
    return F.coalesce(_lookup(QUALIFIERS, code), code)


def field_value(field: Column, code: Column) -> Column:
    """Translate ``code`` with the map that ``field`` names; null for other fields."""
    name = F.lower(strip(field))
    return (
        F.when(name == "datumtype", datum_type(code))
        .when(name == "period", period_text(code))
        .when(name == "valuetype", value_type(code))
        .when(name == "qualifier", qualifier(code))
    )
