"""Identifiers: URI templating and the dash-separated measure notation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import MEASURE_PREFIX, ROOT_TEMPLATE, STATION_PREFIX
from .values import strip

NOTATION_FIELDS = (
    "station_id",
    "parameter",
    "qualifier",
    "value_type",
    "period_name",
    "unit_name",
    "observation_type",
)


def notation_of(measure: Column) -> Column:
    """Measure URI to notation."""
    return strip(F.replace(measure, F.lit(MEASURE_PREFIX), F.lit("")))


def station_id_of(station_uri: Column) -> Column:
    """Station URI to station id; null stays null."""
    return F.replace(station_uri, F.lit(STATION_PREFIX), F.lit(""))


def root_templated(uri: Column, root: str) -> Column:
    """Replace the API root by a placeholder; a missing URI becomes empty."""
    return F.replace(F.coalesce(uri, F.lit("")), F.lit(root), F.lit(ROOT_TEMPLATE))


def notation_parts(notation: Column) -> Column:
    """The notation cut at its dashes."""
    return F.split(notation, "-")


def notation_fields(parts: Column) -> dict[str, Column]:
    """The seven fields of a notation from its parts; all null if the layout is unknown.

    The layouts differ in the number of dashes. The long ones start with a
    station GUID that holds dashes itself, so their fields count from the end.
    """
    count = F.size(parts)
    short, nine, long = count.isin(4, 5), count == 10, count >= 11
    dipped = nine & (F.get(parts, F.lit(5)) == "gw") & (F.get(parts, F.lit(6)) == "dipped")

    def at(index: int) -> Column:
        return F.get(parts, F.lit(index))

    def back(index: int) -> Column:
        return F.get(parts, count - index)

    def first(length: int | Column) -> Column:
        return F.array_join(F.slice(parts, 1, length), "-")

    return {
        "station_id": F.when(short, at(0)).when(nine, first(5)).when(long, first(count - 6)),
        "parameter": F.when(short, at(1)).when(nine, at(5)).when(long, back(6)),
        "qualifier": F.when(dipped, at(6)).when(long, back(5)),
        "value_type": F.when(short, at(2)).when(dipped, at(7)).when(nine, at(6)).when(long, back(4)),
        "period_name": F.when(short, at(3)).when(dipped, F.lit(None)).when(nine, at(7)).when(long, back(3)),
        "unit_name": F.when(count == 5, at(4)).when(nine, at(8)).when(long, back(2)),
        "observation_type": F.when(nine, at(9)).when(long, back(1)),
    }


def parse_notation(notation: Column) -> Column:
    """The notation as one struct, null where the layout is unknown."""
    parts = notation_parts(notation)
    known = F.size(parts).isin(4, 5, 10) | (F.size(parts) >= 11)
    return F.when(known, F.struct(*[column.alias(name) for name, column in notation_fields(parts).items()]))
