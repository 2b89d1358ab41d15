"""Filters over hazard areas and readings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.constants import OBSERVED_PROPERTIES
from .joins import lookup

AREA_FIELDS = ("eaareaname", "county", "description", "label", "riverorsea", "fwdcode")

READING_VIEWS = {
    "min": ("measure", "r_datetime", "value"),
    "default": ("measure", "r_datetime", "r_date", "value", "completeness", "quality", "qcode"),
    "flow": ("measure", "r_datetime", "r_date", "value", "quality", "qcode", "valid", "invalid", "missing"),
    "full": (
        "measure", "r_datetime", "r_date", "value", "period", "completeness",
        "quality", "qcode", "valid", "invalid", "missing",
    ),
}


def _all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions)


def _known(patterns: dict[str, str | None], fields: Sequence[str] = AREA_FIELDS) -> None:
    unknown = set(patterns) - set(fields)
    if unknown:
        raise TypeError(f"unknown area fields: {sorted(unknown)}")


def areas_by_regex(areas: DataFrame, **patterns: str) -> DataFrame:
    """Areas where every field matches its regular expression anywhere, case-sensitively.

    Fields without a pattern match any text, but not null.
    """
    _known(patterns)
    return areas.where(_all_of([F.col(name).rlike(patterns.get(name, ".*")) for name in AREA_FIELDS]))


def like_pattern(value: str | None) -> str:
    """The text wrapped in wildcards; nothing or empty text gives the wildcard alone.

    A backslash before an ordinary character is dropped, as it would be by a
    LIKE that takes the next character literally.
    """
    if not value:
        return "%"
    kept, rest = [], iter(value)
    for char in rest:
        if char != "\\":
            kept.append(char)
            continue
        following = next(rest, "")
        kept.append("\\" + following if following in ("%", "_", "\\") else following)
    return f"%{''.join(kept)}%"


def areas_like(areas: DataFrame, **values: str | None) -> DataFrame:
    """Areas where every field holds its text, ignoring case; ``%`` and ``_`` are wildcards.

    Every field is compared, also those without a text, so null never matches.
    Other keyword arguments are ignored.
    """
    return areas.where(_all_of([F.col(name).ilike(like_pattern(values.get(name))) for name in AREA_FIELDS]))


def areas_selected(areas: DataFrame, names: Sequence[str] = (), **values: str | None) -> DataFrame:
    """Areas of the ticked names (all, if none is ticked) that also pass :func:`areas_like`."""
    chosen = areas.where(F.col("eaareaname").isin(list(names))) if names else areas
    return areas_like(chosen, **values)


def in_viewport(
    points: DataFrame, min_lat: float, min_long: float, max_lat: float, max_long: float
) -> DataFrame:
    """Rows whose ``lat``/``long`` lies in the map view; bounds count to six places."""
    return points.where(
        F.col("lat").between(round(min_lat, 6), round(max_lat, 6))
        & F.col("long").between(round(min_long, 6), round(max_long, 6))
    )


def overlaps_viewport(
    metrics: DataFrame, min_lat: float, min_long: float, max_lat: float, max_long: float
) -> DataFrame:
    """Rows whose bounding box overlaps the map view."""
    return metrics.where(
        (F.col("bbox_wgs84_min_lat") <= round(max_lat, 6))
        & (F.col("bbox_wgs84_max_lat") >= round(min_lat, 6))
        & (F.col("bbox_wgs84_min_long") <= round(max_long, 6))
        & (F.col("bbox_wgs84_max_long") >= round(min_long, 6))
    )


def on_day(readings: DataFrame, day: dt.date, moment: str = "r_datetime", partition: str | None = None) -> DataFrame:
    """Rows of one day, midnight to midnight.

    ``partition`` names the table's date partition column, so that other days are not read.
    """
    start = F.lit(day).cast("timestamp")
    condition = (F.col(moment) >= start) & (F.col(moment) < start + F.expr("INTERVAL 1 DAY"))
    if partition:
        condition &= F.col(partition) == F.lit(day)
    return readings.where(condition)


def between_moments(
    readings: DataFrame, start: Column, end: Column, moment: str = "r_datetime", partition: str | None = None
) -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    condition = F.col(moment).between(start, end)
    if partition:
        condition &= F.col(partition).between(F.to_date(start), F.to_date(end))
    return readings.where(condition)


def has_day(readings: DataFrame, day: dt.date, column: str = "r_date") -> DataFrame:
    """One row ``present``: whether any row has that day. Stops at the first one found."""
    found = readings.where(F.col(column) == F.lit(day)).select(column).limit(1)
    return found.agg((F.count("*") > 0).alias("present"))


def filter_readings(
    readings: DataFrame,
    measure: str | None = None,
    date: dt.date | None = None,
    min_date: dt.date | None = None,
    mineq_date: dt.date | None = None,
    max_date: dt.date | None = None,
    maxeq_date: dt.date | None = None,
    station: str | None = None,
    station_rloi_id: str | None = None,
    station_wiski_id: str | None = None,
    observation_type: str | None = None,
    observed_property: str | None = None,
    period: int | None = None,
    stations: DataFrame | None = None,
    measures: DataFrame | None = None,
    view: str | None = None,
) -> DataFrame:
    """Readings that satisfy every argument given.

    ``min_date`` and ``max_date`` exclude the day itself, ``mineq_date`` and
    ``maxeq_date`` include it. Station ids other than the GUID need
    ``stations``; ``observed_property`` needs ``measures``. ``view`` picks one
    of the column lists in ``READING_VIEWS``.
    """
    day = F.col("r_date")
    conditions = []
    if measure is not None:
        conditions.append((F.col("measure") == measure) | (F.col("notation") == measure))
    if date is not None:
        conditions.append(day == F.lit(date))
    if min_date is not None:
        conditions.append(day > F.lit(min_date))
    if mineq_date is not None:
        conditions.append(day >= F.lit(mineq_date))
    if max_date is not None:
        conditions.append(day < F.lit(max_date))
    if maxeq_date is not None:
        conditions.append(day <= F.lit(maxeq_date))
    if station is not None:
        conditions.append(F.col("station_id") == station)
    if observation_type is not None:
        conditions.append(F.lower("observation_type") == observation_type.lower())
    if period is not None:
        conditions.append(F.col("period") == period)
    chosen = readings.where(_all_of(conditions)) if conditions else readings

    for column, wanted in (("rloi_id", station_rloi_id), ("wiski_id", station_wiski_id)):
        if wanted is not None:
            if stations is None:
                raise ValueError(f"{column} needs the stations")
            listed = F.array_contains(F.split(F.col(column), ","), wanted)
            matching = stations.where(listed).select(F.col("notation").alias("station_id")).distinct()
            chosen = lookup(chosen, matching, ["station_id"], "left_semi")
    if observed_property is not None:
        if measures is None:
            raise ValueError("observed_property needs the measures")
        if observed_property not in OBSERVED_PROPERTIES:
            raise ValueError(f"unknown observed property: {observed_property}")
        last_part = F.substring_index("observed_property_id", "/", -1)
        matching = measures.where(last_part == observed_property).select("notation").distinct()
        chosen = lookup(chosen, matching, ["notation"], "left_semi")
    return chosen.select(*READING_VIEWS[view]) if view else chosen
