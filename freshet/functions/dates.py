"""Dates and timestamps; the session time zone is UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def parse_date(text: Column) -> Column:
    """Year-month-day text to a date, null if it is anything else."""
    return F.try_to_date(text, "yyyy-M-d")


def parse_datetime(text: Column) -> Column:
    """ISO text with or without time and zone to a timestamp, null if unusable."""
    return F.try_to_timestamp(text)


def month_start(moment: Column) -> Column:
    """First day of the month."""
    return F.trunc(F.to_date(moment), "month")


def day_start(day: Column) -> Column:
    """00:00:00 of a date."""
    return day.cast("timestamp")


def day_end(day: Column) -> Column:
    """Last microsecond of a date."""
    return day.cast("timestamp") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")


def days_between(start: Column, end: Column) -> Column:
    """Number of days from ``start`` to ``end``, both counted."""
    return F.date_diff(end, start) + 1


def calendar(start: Column, end: Column) -> Column:
    """Array of all days from ``start`` to ``end``; empty if they are reversed or null."""
    # sequence() would count downwards for a reversed range
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def chunks(start: Column, end: Column, days: int) -> Column:
    """Array of ``struct<chunk_start, chunk_end>`` cutting the range into pieces of ``days`` days."""
    if days < 1:
        raise ValueError("days must be at least 1")
    starts = F.when(
        start <= end, F.sequence(start, end, F.expr(f"INTERVAL {int(days)} DAY"))
    ).otherwise(F.array().cast("array<date>"))
    return F.transform(
        starts,
        lambda first: F.struct(
            first.alias("chunk_start"),
            F.least(F.date_add(first, days - 1), end).alias("chunk_end"),
        ),
    )


def validated_date(value: str | dt.date | None) -> dt.date | None:
    """A date argument: dates pass, empty gives None, other text than YYYY-MM-DD is an error."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if not value:
        return None
    try:
        return dt.datetime.strptime(value.strip(), "%Y-%m-%d").date()
    except ValueError as error:
        raise ValueError(f"not a date in the form YYYY-MM-DD: {value!r}") from error


def required_date(value: str | dt.date | None) -> dt.date:
    """As ``validated_date``, but an empty argument is an error too."""
    date = validated_date(value)
    if date is None:
        raise ValueError("a date is required")
    return date
