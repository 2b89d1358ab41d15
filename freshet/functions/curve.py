"""Places on a space-filling curve, as the order of rows in files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def axis_number(df: DataFrame, name: str) -> Column:
    """The axis as a finite double: numbers as they are, days and moments in seconds; null otherwise."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampNTZType)):
        value = value.cast("timestamp")
    number = value.cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def axis_bounds(df: DataFrame, axes: Sequence[str]) -> list[tuple[float, float]]:
    """The smallest and largest value of each axis, in one aggregate; (0, 0) for an axis without values."""
    numbers = df.select(*[axis_number(df, name).alias(f"x{i}") for i, name in enumerate(axes)])
    row = numbers.agg(*[f(f"x{i}") for i in range(len(axes)) for f in (F.min, F.max)]).first()
    return [(row[2 * i], row[2 * i + 1]) if row[2 * i] is not None else (0.0, 0.0) for i in range(len(axes))]


def with_curve(df: DataFrame, axes: Sequence[str], bounds: Sequence[tuple[float, float]], name: str) -> DataFrame:
    """Add the place on the Z-order curve through the box of ``bounds``.

    Each axis is cut into 2 ** (62 // axes) equal steps and the bits of all steps are
    interleaved. Values outside the bounds count as the nearest bound, absent ones as the lower.
    """
    bits = 62 // len(axes)
    top = (1 << bits) - 1
    steps = {}
    for i, (axis, (low, high)) in enumerate(zip(axes, bounds)):
        step = F.floor((axis_number(df, axis) - low) / (high - low) * (top + 1)) if high > low else F.lit(0)
        steps[f"{name}_{i}"] = F.coalesce(F.least(F.greatest(step.cast("long"), F.lit(0)), F.lit(top)), F.lit(0)).cast("long")
    placed = [
        F.shiftleft(F.shiftright(F.col(step), bit).bitwiseAND(F.lit(1)), bit * len(axes) + len(axes) - 1 - i)
        for i, step in enumerate(steps)
        for bit in range(bits)
    ]
    curve = reduce(lambda left, right: left.bitwiseOR(right), placed)
    return df.withColumns(steps).withColumn(name, curve).drop(*steps)
