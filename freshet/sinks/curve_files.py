"""Files in the order of a space-filling curve, so that a filter on place and time skips most of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.curve import axis_bounds, with_curve

_CURVE, _SPREAD = "__curve", "__spread"


def write_by_curve(
    rows: DataFrame, path: str, axes: Sequence[str] = ("lat", "long", "r_datetime"), mode: str = "errorifexists"
) -> None:
    """Write ``rows`` as Parquet, near together what is near on all ``axes``.

    Readers filter on the axes themselves: the bounds in the footers of row groups and
    pages then rule out most of the table, whichever axes a filter names
    (moments need the timestamp type that ``prepare`` sets). ``rows`` is
    evaluated three times: for the bounds of the axes, for the ranges of the curve, and
    to be written. The bounds only shape the order, so each batch may have its own. Rows
    of one place and moment are spread by a hash of the row's plain columns, so no place
    is one task. Rows without a value on an axis are kept.
    """
    plain = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    placed = with_curve(rows, axes, axis_bounds(rows, axes), _CURVE).withColumn(_SPREAD, F.xxhash64(*plain))
    (
        placed.repartitionByRange(_CURVE, _SPREAD)
        .sortWithinPartitions(_CURVE, _SPREAD)
        .drop(_CURVE, _SPREAD)
        .write.mode(mode)
        .parquet(path)
    )
