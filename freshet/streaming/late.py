"""Exact repeats dropped from a stream while late rows are still accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.constants import TRAILING_DAYS
from ..operators.readings import READING_KEY


def without_late_repeats(
    readings: DataFrame, moment: str = "r_datetime", keys: tuple[str, ...] = READING_KEY, days: int = TRAILING_DAYS
) -> DataFrame:
    """The first row of each key; state is kept for ``days`` days of event time.

    Revised values are not repeats: they go through the upsert.
    """
    return readings.withWatermark(moment, f"{days} days").dropDuplicatesWithinWatermark(list(keys))
