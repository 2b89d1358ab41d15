"""Counts and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.constants import VALUE_STATUSES


def row_count(df: DataFrame) -> DataFrame:
    """One row ``n_rows``."""
    return df.agg(F.count("*").alias("n_rows"))


def rows_per(df: DataFrame, *keys: str) -> DataFrame:
    """``n_rows`` of each batch."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def status_histogram(readings: DataFrame, *keys: str) -> DataFrame:
    """``n_rows`` per value status (and key), in status order."""
    return rows_per(readings, *keys, "value_status").orderBy(*keys, "value_status")


def action_tally(changes: DataFrame, *keys: str) -> DataFrame:
    """Rows inserted and updated, in action order; rows left alone are not counted."""
    changed = changes.where(F.col("action").isin("inserted", "updated"))
    return rows_per(changed, *keys, "action").orderBy(*keys, "action")


def day_report(readings: DataFrame, changes: DataFrame) -> DataFrame:
    """Per day: rows read, the count of each value status, rows inserted and updated."""
    read = readings.groupBy("r_date").agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col("value_status") == code).alias(f"status_{code}") for code in VALUE_STATUSES],
    )
    done = changes.groupBy("r_date").agg(
        F.count_if(F.col("action") == "inserted").alias("inserted"),
        F.count_if(F.col("action") == "updated").alias("updated"),
    )
    return read.join(done, "r_date", "left").na.fill(0, ["inserted", "updated"])


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return rows_per(df, *keys).where(F.col("n_rows") > 1)


def facets(df: DataFrame, filtered: DataFrame, column: str) -> DataFrame:
    """All values of a column, and whether each is left after filtering."""
    every = df.select(column).where(F.col(column).isNotNull()).distinct()
    left = filtered.select(column).distinct().withColumn("active", F.lit(True))
    return every.join(left, column, "left").na.fill(False, ["active"])


def facet_counts(df: DataFrame, conditions: Mapping[str, Column | None]) -> DataFrame:
    """All facets in one pass: ``facet, value, n_rows, n_left, n_active`` of each value of each facet.

    ``conditions`` names the facet columns, at most 63, with the filter set on each (None
    for no filter; a null condition fails). ``n_left`` counts the rows that pass the filters
    of all other facets, which is what ticking the value would give; ``n_active`` those
    that pass every filter. Each row carries one bit per filter that it fails, so a facet
    drops its own bit. Null values are no facet value but count as rows that a filter fails.
    """
    failed = F.lit(0).cast("long")
    for bit, condition in enumerate(conditions.values()):
        if condition is not None:
            passes = F.coalesce(condition, F.lit(False))
            failed = failed.bitwiseOR(F.when(passes, F.lit(0)).otherwise(F.lit(1 << bit)).cast("long"))
    names = list(conditions)
    masked = df.select(*[F.col(name).cast("string").alias(f"f{i}") for i, name in enumerate(names)], failed.alias("failed"))
    entries = [
        F.struct(
            F.lit(name).alias("facet"),
            F.col(f"f{bit}").alias("value"),
            (F.col("failed").bitwiseAND(F.lit(~(1 << bit)).cast("long")) == 0).alias("left"),
            (F.col("failed") == 0).alias("active"),
        )
        for bit, name in enumerate(names)
    ]
    return (
        masked.select(F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.count("*").alias("n_rows"), F.count_if("left").alias("n_left"), F.count_if("active").alias("n_active"))
    )


def day_statistics(readings: DataFrame) -> DataFrame:
    """Per day: rows, values, measures, first and last moment, and the count of each value status.

    ``measure_sketch`` lets the measures of several days be counted together.
    """
    return readings.groupBy("r_date").agg(
        F.count("*").alias("n_rows"),
        F.count("value").alias("n_values"),
        F.count_distinct("measure").alias("n_measures"),
        F.min("r_datetime").alias("first_moment"),
        F.max("r_datetime").alias("last_moment"),
        *[F.count_if(F.col("value_status") == code).alias(f"status_{code}") for code in VALUE_STATUSES],
        F.hll_sketch_agg("measure").alias("measure_sketch"),
    )


def statistics_summary(statistics: DataFrame) -> DataFrame:
    """One row on all days of :func:`day_statistics`; the number of measures is an estimate."""
    return statistics.agg(
        F.min("r_date").alias("min_date"),
        F.max("r_date").alias("max_date"),
        F.max("last_moment").alias("max_datetime"),
        F.count("*").alias("days_present"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("n_rows", "n_values", *[f"status_{code}" for code in VALUE_STATUSES])],
        F.hll_sketch_estimate(F.hll_union_agg("measure_sketch")).alias("n_measures_estimate"),
    )


def newest_first(df: DataFrame, n: int, moment: str, *tie_break: str) -> DataFrame:
    """The ``n`` newest rows, newest first."""
    return df.orderBy(F.col(moment).desc(), *tie_break).limit(n)
