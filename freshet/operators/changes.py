"""Comparing a batch with the stored rows, and merging it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def one_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key under ``order``, which has to be total.

    The rank filter also runs before the shuffle, so a key with many rows sends
    one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def first_of_key(df: DataFrame, key: str, column: str) -> DataFrame:
    """``df`` with whether a row is the first of its key in order of its values; null keys always are.

    A key with many rows is not gathered: its least row comes from a grouped minimum,
    and only rows equal to it are ranked.
    """
    text = df.withColumn("_text", F.to_json(F.struct(*df.columns)))
    least = text.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_text").alias("_least"))
    marked = text.join(least, key, "left").withColumn("_is_least", F.col("_text") == F.col("_least"))
    alike = Window.partitionBy(key, F.when(F.col("_is_least"), F.lit("")).otherwise(F.col("_text"))).orderBy("_text")
    first = F.col(key).isNull() | (F.col("_is_least") & (F.row_number().over(alike) == 1))
    return marked.withColumn(column, first).select(*df.columns, column)


def _paired(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    old = stored.select(*keys, F.struct(*stored.columns).alias("old"))
    new = batch.select(*keys, F.struct(*batch.columns).alias("new"))
    return old.join(new, list(keys), "full_outer")


def _differs(tracked: Sequence[str]) -> Column:
    same = F.lit(True)
    for name in tracked:
        same = same & F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}"))
    return ~same


def _action(tracked: Sequence[str]) -> Column:
    return (
        F.when(F.col("old").isNull(), "inserted")
        .when(F.col("new").isNull(), "kept")
        .when(_differs(tracked), "updated")
        .otherwise("unchanged")
    )


def classify_changes(
    stored: DataFrame, batch: DataFrame, keys: Sequence[str], tracked: Sequence[str]
) -> DataFrame:
    """``keys`` and ``action`` of every stored or incoming row.

    The action is inserted, updated (a tracked column differs, nulls compared
    as values), unchanged, or kept (not in the batch).
    """
    return _paired(stored, batch, keys).select(*keys, _action(tracked).alias("action"))


def merge_changes(
    stored: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    updated_column: str | None = None,
    moment: Column | None = None,
) -> DataFrame:
    """The table after the batch, with the ``action`` taken on each row.

    A changed row takes the tracked columns of the batch and, in
    ``updated_column``, the ``moment``; its other columns stay as stored.
    """
    rows = _paired(stored, batch, keys).withColumn("action", _action(tracked))
    changed = F.col("action") == "updated"
    inserted = F.col("action") == "inserted"
    columns = []
    for name in stored.columns:
        old = F.col(f"old.`{name}`")
        new = F.col(f"new.`{name}`") if name in batch.columns else F.lit(None)
        if name == updated_column:
            after = F.when(changed, F.current_timestamp() if moment is None else moment).when(~inserted, old)
        elif name in keys:
            after = F.col(f"`{name}`")
        elif name in tracked:
            after = F.when(changed | inserted, new).otherwise(old)
        else:
            after = F.when(inserted, new).otherwise(old)
        columns.append(after.alias(name))
    return rows.select(*columns, "action")


def without_repeats(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is not stored yet."""
    return batch.join(stored.select(*keys), list(keys), "left_anti")


def repeats(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch that a unique key would reject."""
    return batch.join(stored.select(*keys), list(keys), "left_semi")
