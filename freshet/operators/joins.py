"""Joins of many facts to a table of unique keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup(facts: DataFrame, dimension: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join facts to a dimension whose ``on`` columns are unique (semi and anti joins: any).

    No job runs while the plan is built. Spark broadcasts the dimension if its size in
    bytes, estimated from the files or measured after its shuffle, is within
    ``spark.sql.autoBroadcastJoinThreshold``, and the facts then stay where they are.
    A larger one is shuffled; the session's adaptive skew join then divides the facts of
    a hot key, or of null keys, between tasks. All four join types keep the facts on the
    side that it can divide.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"facts must be on the left of a lookup, not {how!r}")
    return facts.join(dimension, list(on), how)
