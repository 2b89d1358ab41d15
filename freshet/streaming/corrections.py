"""Landed files as a stream in which a file may be written again.

A file source knows a file by its name, so a corrected file is never read. Here every
trigger compares the listing with a ledger of (path, length, change time), loads what is
new, and loads the days of changed files anew from all their files. Columns are matched
by header name. The ledger is written after the table, so a trigger that failed is
repeated as a whole, and repeating it changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.readings import LoadResult, load_days
from ..session import discard, staged
from ..sinks.day_table import DayTable
from ..sinks.ledger import FileLedger
from ..sources.reading_files import list_reading_files, source_day, source_tag


@dataclass
class Trigger:
    """What one trigger found and did; ``added`` and ``reloaded`` are None without such days."""

    batch: int
    new_files: int
    changed_files: int
    gone_files: int
    added: LoadResult | None = None
    reloaded: LoadResult | None = None


def load_landed(table: DayTable, base: str, stations: DataFrame, ledger: FileLedger) -> Trigger:
    """One trigger: load new files, and again the days of files that have changed.

    A new file of a day that is loaded already is upserted with it. A day of which a file
    has changed or is gone is replaced from the files it has now, so that rows missing
    there go; a day without any file left keeps its rows.
    """
    listing = list_reading_files(table.spark, base).where(F.col("day").isNotNull())
    found = ledger.compare(listing).withColumn("r_date", source_day(source_tag(F.col("path"))))
    found = staged(found, "landed")
    counts = {r.state: r.n for r in found.groupBy("state").agg(F.count("*").alias("n")).collect()}
    done = Trigger(max(ledger.batches(), default=0) + 1, *(counts.get(state, 0) for state in ("new", "changed", "gone")))
    changed = found.where("state <> 'new'").select("r_date").distinct()
    new = found.where("state = 'new'").select("r_date").distinct().join(changed, "r_date", "left_anti")
    if done.changed_files or done.gone_files:
        done.reloaded = load_days(table, base, changed, stations, replace=True)
    if done.new_files:
        done.added = load_days(table, base, new, stations)
    if counts:
        ledger.record(found, done.batch)
    discard(found)
    return done


def follow_landed(
    table: DayTable, base: str, stations: DataFrame, ledger: FileLedger, checkpoint: str, every: str = "1 minute"
) -> StreamingQuery:
    """:func:`load_landed` once per trigger, until the returned query is stopped."""
    ticks = table.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.foreachBatch(lambda _rows, _batch: load_landed(table, base, stations, ledger) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )
