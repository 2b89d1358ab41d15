"""A Parquet table partitioned by day.

Writers touch the partitions of the days they hold and no others: the days of a
batch, a list no longer than the calendar, become a filter on the partition
column. A result that depends on the table itself is staged in the shared
folder first, so that no partition is overwritten while it is being read.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.dates import day_end, day_start, required_date
from ..operators.changes import merge_changes, one_row_per_key
from ..operators.coverage import days_present
from ..session import hadoop_path, staged


class DayTable:
    """Rows keyed by ``keys``, stored by ``day``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str],
        tracked: Sequence[str] = (),
        day: str = "r_date",
        moment: str | None = "r_datetime",
        updated_column: str | None = None,
        created_column: str | None = None,
    ):
        self.spark = spark
        self.path = path
        self.keys = list(keys)
        self.tracked = list(tracked)
        self.day = day
        self.moment = moment
        self.updated_column = updated_column
        self.created_column = created_column
        if created_column and created_column not in schema.names:
            schema = T.StructType([*schema.fields, T.StructField(created_column, T.TimestampType())])
        self.schema = schema

    def stored_days(self) -> list[dt.date]:
        """The days that have a partition, from the folder names alone."""
        folder, files = hadoop_path(self.spark, self.path)
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        # rows without a day, if any, are in a partition of another form
        matches = [re.fullmatch(rf"{re.escape(self.day)}=(\d{{4}}-\d{{2}}-\d{{2}})", name) for name in names]
        return sorted(dt.date.fromisoformat(match[1]) for match in matches if match)

    def days(self) -> DataFrame:
        """:meth:`stored_days` as rows ``r_date``."""
        return self.spark.createDataFrame([(day,) for day in self.stored_days()], "r_date date")

    def read(self) -> DataFrame:
        """All stored rows; no rows if nothing has been written."""
        if not self.stored_days():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def _write(self, rows: DataFrame, mode: str) -> None:
        order = [self.day, *[key for key in self.keys if key != self.day]]
        (
            rows.select(*self.schema.names)
            # few files per day, and a day of any size is split over several tasks
            .hint("rebalance", F.col(self.day))
            .sortWithinPartitions(*order)
            .write.partitionBy(self.day)
            .mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .parquet(self.path)
        )

    def _stamped(self, rows: DataFrame) -> DataFrame:
        if self.created_column and self.created_column not in rows.columns:
            return rows.withColumn(self.created_column, F.current_timestamp())
        return rows

    def _among(self, days: Sequence[dt.date]) -> Column:
        return F.col(self.day).isin(list(days))

    def _days_of(self, rows: DataFrame) -> list[dt.date]:
        return [row.r_date for row in days_present(rows, self.day).collect()]

    def _all_keys(self) -> list[str]:
        return list(dict.fromkeys([self.day, *self.keys]))

    def append(self, rows: DataFrame) -> None:
        """Add rows of days that are not stored yet."""
        self._write(self._stamped(rows), "append")

    def replace_days(self, rows: DataFrame) -> DataFrame:
        """Replace every day that ``rows`` holds. Returns ``r_date, rows_deleted, rows_loaded, rows_rejected``.

        Rows without a day have no partition to replace: they are stored nowhere, and
        counted as rejected in a row of their own, whose ``r_date`` is null.
        """
        incoming = staged(self._stamped(rows).select(*self.schema.names), "replacement")
        without = incoming.where(F.col(self.day).isNull()).agg(F.count("*").alias("rows_rejected")).where("rows_rejected > 0")
        incoming = incoming.where(F.col(self.day).isNotNull())
        loaded = incoming.groupBy(self.day).agg(F.count("*").alias("rows_loaded"))
        replaced = self.read().where(self._among(self._days_of(incoming)))
        deleted = replaced.groupBy(self.day).agg(F.count("*").alias("rows_deleted"))
        report = staged(
            loaded.join(deleted, self.day, "left").select(
                F.col(self.day).alias("r_date"),
                F.coalesce("rows_deleted", F.lit(0)).cast("long").alias("rows_deleted"),
                "rows_loaded",
                F.lit(0).cast("long").alias("rows_rejected"),
            ).unionByName(without.select(
                F.lit(None).cast("date").alias("r_date"), F.lit(0).cast("long").alias("rows_deleted"),
                F.lit(0).cast("long").alias("rows_loaded"), "rows_rejected")),
            "replacement-report",
        )
        self._write(incoming, "overwrite")
        return report

    def upsert(self, rows: DataFrame, order: Sequence[Column], moment: Column | None = None) -> DataFrame:
        """Insert new keys and update changed rows in the days that ``rows`` holds.

        Of several rows with one key the first under ``order`` counts. ``rows``
        is evaluated twice, first for its days alone. Returns ``keys`` and
        ``action`` of every row of those days; rows without a day have no partition to
        go to and are returned as ``rejected``. The day has to follow from the keys: a
        key that comes with another day is another row.
        """
        rejected = self._rejected(rows)
        rows = rows.where(F.col(self.day).isNotNull())
        stored = self.read().where(self._among(self._days_of(rows)))
        incoming = self._stamped(one_row_per_key(rows, self.keys, order)).select(*self.schema.names)
        # the day follows from the key, and joining on it too keeps a day's rows together
        keys = self._all_keys()
        merged = staged(
            merge_changes(stored, incoming, keys, self.tracked, self.updated_column, moment), "merged"
        )
        changed = self._days_of(merged.where(F.col("action").isin("inserted", "updated")))
        if changed:
            self._write(merged.where(self._among(changed)), "overwrite")
        return merged.select(*keys, "action").unionByName(rejected)

    def _rejected(self, rows: DataFrame) -> DataFrame:
        without = rows.where(F.col(self.day).isNull())
        return without.select(*self._all_keys(), F.lit("rejected").alias("action"))

    def append_or_upsert(self, rows: DataFrame, order: Sequence[Column], moment: Column | None = None) -> DataFrame:
        """Append the days that are absent, upsert the others. Returns ``keys`` and ``action``.

        Rows without a day are stored nowhere and returned as ``rejected``.
        """
        rejected = self._rejected(rows)
        rows = rows.where(F.col(self.day).isNotNull())
        stored = set(self.stored_days())
        days = self._days_of(rows)
        known, new = [d for d in days if d in stored], [d for d in days if d not in stored]
        none = rejected
        actions = self.upsert(rows.where(self._among(known)), order, moment).unionByName(none) if known else none
        if not new:
            return actions
        single = one_row_per_key(rows.where(self._among(new)), self.keys, order)
        appended = staged(self._stamped(single).select(*self.schema.names), "appended")
        self.append(appended)
        return actions.unionByName(appended.select(*self._all_keys(), F.lit("inserted").alias("action")))

    def delete_between(self, first: dt.date | str, last: dt.date | str) -> None:
        """Delete the rows from the first moment of ``first`` to the last one of ``last``.

        Without a moment column the days themselves are compared. Text other than YYYY-MM-DD is an error.
        """
        first, last = required_date(first), required_date(last)
        touched = [day for day in self.stored_days() if first <= day <= last]
        if self.moment is None:
            survivors_by_day = []
        else:
            inside = F.col(self.moment).between(day_start(F.lit(first)), day_end(F.lit(last)))
            survivors = staged(self.read().where(self._among(touched) & (~inside | inside.isNull())), "survivors")
            survivors_by_day = self._days_of(survivors)
            self._write(survivors, "overwrite")
        self.drop_days([day for day in touched if day not in survivors_by_day])

    def drop_days(self, days: Sequence[dt.date]) -> None:
        """Delete all rows of these days; days that are not stored are passed over."""
        for day in days:
            folder, files = hadoop_path(self.spark, f"{self.path}/{self.day}={day.isoformat()}")
            files.delete(folder, True)
