"""Landed files as a stream, upserted into the readings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import normalise_missing
from ..operators.readings import quarantined, shape_readings, usable, with_station_label
from ..plans.readings import batch_order
from ..session import staged
from ..sinks.day_table import DayTable
from ..sources.reading_files import READING_SCHEMA, source_tag


def stream_readings(spark: SparkSession, base: str, files_per_batch: int | None = None) -> DataFrame:
    """New reading files below ``base`` as a stream of raw cells.

    A file whose header differs from the expected columns fails the batch
    instead of being read into the wrong ones.
    """
    reader = (
        spark.readStream.schema(READING_SCHEMA)
        .option("header", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    cells = reader.csv(base).select("*", source_tag(F.col("_metadata.file_path")).alias("source"))
    return normalise_missing(cells)


def upsert_stream(
    raw: DataFrame, table: DayTable, stations: DataFrame, checkpoint: str, quarantine: str | None = None
) -> StreamingQuery:
    """Upsert every micro-batch and stop when all landed files are done.

    Running a batch again changes nothing, as its rows are then equal to the stored ones.
    Rows that cannot be stored go to ``quarantine`` with the reason, one folder a batch,
    which a second run replaces; by default it lies next to the table.
    """

    folder = quarantine or f"{table.path.rstrip('/')}_quarantine"

    def write(batch: DataFrame, batch_id: int) -> None:
        # the files are read once, although the upsert reads its rows twice
        shaped = staged(shape_readings(batch), "micro-batch")
        rejected = quarantined(shaped)
        rejected.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        table.append_or_upsert(with_station_label(usable(shaped), stations), batch_order())

    return (
        raw.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
