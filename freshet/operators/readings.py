"""Cleaned readings: one shaped record per file row, and rows that cannot be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import month_start, parse_date, parse_datetime
from ..functions.notation import notation_fields, notation_of, notation_parts
from ..functions.values import (
    chosen_value,
    last_part,
    number_of,
    odd_text,
    parse_number,
    period_seconds,
    stored_value,
    value_status,
)
from .joins import lookup

READING_KEY = ("notation", "r_datetime")
TRACKED = ("quality", "completeness", "qcode", "value", "valid", "invalid", "missing")
RAW_COLUMNS = (
    "source", "measure", "dateTime", "date", "value", "period", "completeness",
    "quality", "qcode", "valid", "invalid", "missing",
)


def _with_all_columns(raw: DataFrame) -> DataFrame:
    # Every file column is optional; the source tag defaults to 'EA'
    absent = {
        name: F.lit("EA") if name == "source" else F.lit(None).cast("string")
        for name in RAW_COLUMNS
        if name not in raw.columns
    }
    return raw.withColumns(absent) if absent else raw


def with_value(cells: DataFrame, text: str, value: str, status: str) -> DataFrame:
    """Add the number in a text column and how it was understood, one step per projection."""
    odd, number, tail, part = (F.col(name) for name in ("_odd", "_number", "_tail", "_part"))
    return (
        cells.withColumn("_odd", odd_text(F.col(text)))
        .withColumns({"_number": number_of(F.col(text), odd), "_tail": last_part(odd)})
        .withColumn("_part", parse_number(tail))
        .withColumns({value: chosen_value(number, part), status: value_status(F.col(text), number, odd, tail, part)})
        .drop("_odd", "_number", "_tail", "_part")
    )


def with_notation(cells: DataFrame, measure: str) -> DataFrame:
    """Add the ``notation`` of a measure URI and its seven fields."""
    return (
        cells.withColumn("notation", notation_of(F.col(measure)))
        .withColumn("_parts", notation_parts(F.col("notation")))
        .withColumns(notation_fields(F.col("_parts")))
        .drop("_parts")
    )


def shape_readings(raw: DataFrame) -> DataFrame:
    """One output record per raw row, in the layout of the readings table.

    ``r_date`` is the day of ``r_datetime``; the file's own date is kept as
    ``source_date``. ``value_status`` says how the value text was understood.
    """
    # few projections, each on results of the one before, so that no parse is repeated
    odd, number, tail, part = (F.col(name) for name in ("_odd", "_number", "_tail", "_part"))
    cells = _with_all_columns(raw).withColumns(
        {
            "r_datetime": parse_datetime(F.col("dateTime")),
            "notation": notation_of(F.col("measure")),
            "_odd": odd_text(F.col("value")),
        }
    )
    parted = cells.withColumns(
        {
            "_parts": notation_parts(F.col("notation")),
            "_number": number_of(F.col("value"), odd),
            "_tail": last_part(odd),
        }
    )
    parsed = parted.withColumn("_part", parse_number(tail))
    fields = notation_fields(F.col("_parts"))
    text = F.lit(None).cast("string")
    passed = [name for name in raw.columns if name not in RAW_COLUMNS]
    return parsed.select(
        "source",
        "r_datetime",
        month_start(F.col("r_datetime")).alias("r_month"),
        F.to_date("r_datetime").alias("r_date"),
        parse_date(F.col("date")).alias("source_date"),
        "measure",
        "notation",
        fields["station_id"].alias("station_id"),
        text.alias("parameter_name"),
        fields["parameter"].alias("parameter"),
        fields["qualifier"].alias("qualifier"),
        fields["value_type"].alias("value_type"),
        fields["period_name"].alias("period_name"),
        period_seconds(F.col("period")).alias("period"),
        fields["unit_name"].alias("unit_name"),
        fields["observation_type"].alias("observation_type"),
        text.alias("datumtype"),
        text.alias("stationreference"),
        stored_value(chosen_value(number, part)).alias("value"),
        value_status(F.col("value"), number, odd, tail, part).alias("value_status"),
        "completeness",
        "quality",
        "qcode",
        "valid",
        "invalid",
        "missing",
        F.lit(None).cast("timestamp").alias("updated"),
        *passed,
    )


def station_labels(stations: DataFrame, prefer_last: str | None = None) -> DataFrame:
    """``(station_id, label)``, one row per station notation.

    Of repeated notations the label with the highest ``prefer_last`` wins (by
    default the label itself, so that the result does not depend on row order).
    """
    order = F.col(prefer_last or "label")
    return (
        stations.select("notation", "label", order.alias("_order"))
        .where(F.col("notation").isNotNull())
        .groupBy(F.col("notation").alias("station_id"))
        .agg(F.max_by("label", "_order").alias("label"))
    )


def with_station_label(readings: DataFrame, stations: DataFrame, prefer_last: str | None = None) -> DataFrame:
    """Add the ``label`` of the reading's station; null where the station is unknown."""
    return lookup(readings, station_labels(stations, prefer_last), ["station_id"])


def usable(readings: DataFrame) -> DataFrame:
    """Rows that have a complete key."""
    return readings.where(F.col("r_datetime").isNotNull() & F.col("notation").isNotNull())


def quarantined(readings: DataFrame) -> DataFrame:
    """Rows without a complete key, with the ``reason``."""
    reason = (
        F.when(F.col("notation").isNull() & F.col("r_datetime").isNull(), "no measure and no timestamp")
        .when(F.col("notation").isNull(), "no measure")
        .when(F.col("r_datetime").isNull(), "no timestamp")
    )
    return readings.withColumn("reason", reason).where(F.col("reason").isNotNull())


def latest_per_measure(readings: DataFrame, *carry: str) -> DataFrame:
    """The newest reading of each measure."""
    return _extreme(readings, F.max_by, carry)


def earliest_per_measure(readings: DataFrame, *carry: str) -> DataFrame:
    """The oldest reading of each measure."""
    return _extreme(readings, F.min_by, carry)


def _extreme(readings: DataFrame, pick, carry: tuple[str, ...]) -> DataFrame:
    # ties on the timestamp are settled by the carried columns, so that the result is a function of the rows
    kept = ("value", *carry)
    order = F.struct("r_datetime", *carry, "value")
    picked = pick(F.struct("r_datetime", *kept), order).alias("_row")
    return (
        readings.where(F.col("r_datetime").isNotNull())
        .groupBy("measure")
        .agg(picked)
        .select("measure", "_row.*")
    )
