"""Queries whose result a stream produces from landed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.readings import usable
from ..plans.readings import readings_table
from ..session import discard, fresh_path, staged
from ..sinks.ledger import FileLedger
from ..sources.reading_files import READING_COLUMNS
from ..streaming.corrections import load_landed
from ..streaming.ingest import stream_readings, upsert_stream
from ..streaming.late import without_late_repeats
from ..streaming.latest import LatestReadings, follow_latest
from .inputs import RAW_READINGS, STATIONS, derive, land_readings, table
from .readings import moment_text, shaped
from .registry import query
from .sqltext import RAW, SHAPED, winners


def _streamed(spark, sf_dir):
    """The table and the quarantine folder after a stream over all landed files."""
    base = land_readings(derive(spark, sf_dir, RAW_READINGS), fresh_path(spark, "landed"))
    target, quarantine = readings_table(spark, fresh_path(spark, "stream-table")), fresh_path(spark, "stream-quarantine")
    stream = upsert_stream(
        stream_readings(spark, base, files_per_batch=20),
        target,
        derive(spark, sf_dir, STATIONS),
        fresh_path(spark, "stream-checkpoint"),
        quarantine,
    )
    stream.awaitTermination()
    return target, quarantine


@query(
    "stream_upsert",
    f"""select notation, strftime(r_datetime, '%Y-%m-%d %H:%M:%S') as r_datetime, cast(value as double) as value, quality, qcode, label
        from ({winners()}) w""",
)
def stream_upsert(spark, sf_dir):
    return _streamed(spark, sf_dir)[0].read().select(
        "notation", moment_text("r_datetime"), F.col("value").cast("double").alias("value"), "quality", "qcode", "label"
    )


@query(
    "stream_quarantine",
    f"""select source, measure, value_status, quality, qcode,
          case when notation is not null then 'no timestamp' when r_datetime is not null then 'no measure'
               else 'no measure and no timestamp' end as reason
        from ({SHAPED}) s where notation is null or r_datetime is null""",
)
def stream_quarantine(spark, sf_dir):
    """The rows that a stream could not store, with the reason."""
    rejected = spark.read.parquet(_streamed(spark, sf_dir)[1])
    return rejected.select("source", "measure", "value_status", "quality", "qcode", "reason")


@query("stream_dedup", "select event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, value from events")
def stream_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    landed, out = fresh_path(spark, "repeated-events"), fresh_path(spark, "deduplicated")
    # every event arrives twice
    events.union(events).write.parquet(landed)
    source = spark.readStream.schema(events.schema).parquet(landed)
    stream = (
        without_late_repeats(source, "ts", ("event_id",))
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", fresh_path(spark, "dedup-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return spark.read.schema(events.schema).parquet(out).select("event_id", "user_id", moment_text("ts"), "value")


#: the day whose file is written again: odd events are left out, the others have another quality
CORRECTED_DAY = "hydro-2024-01-10"
CORRECTED = f"""
(select * replace (case when source = '{CORRECTED_DAY}' then 'Corrected' else quality end as quality)
 from ({RAW}) r1 where source <> '{CORRECTED_DAY}' or event_id % 2 = 0)
"""


@query(
    "stream_corrections",
    f"""select notation, strftime(r_datetime, '%Y-%m-%d %H:%M:%S') as r_datetime, cast(value as double) as value, quality, qcode, label
        from ({winners(SHAPED.replace(f"({RAW})", CORRECTED))}) w""",
)
def stream_corrections(spark, sf_dir):
    """The table after two triggers; between them a file is corrected, with its columns in another order."""
    raw = derive(spark, sf_dir, RAW_READINGS)
    base, stations = land_readings(raw, fresh_path(spark, "landed")), derive(spark, sf_dir, STATIONS)
    target, ledger = readings_table(spark, fresh_path(spark, "corrected-table")), FileLedger(spark, fresh_path(spark, "ledger"))
    load_landed(target, base, stations, ledger)
    columns = [F.lit("Corrected").alias(c) if c == "quality" else F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c)
               for c in reversed(READING_COLUMNS)]
    (
        raw.where((F.col("source") == CORRECTED_DAY) & (F.col("event_id") % 2 == 0)).select(*columns)
        .write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(f"{base}/year=2024/source={CORRECTED_DAY}")
    )
    load_landed(target, base, stations, ledger)
    return target.read().select(
        "notation", moment_text("r_datetime"), F.col("value").cast("double").alias("value"), "quality", "qcode", "label"
    )


@query(
    "stream_latest",
    f"""select l.n as notation, strftime(l.t, '%Y-%m-%d %H:%M:%S') as r_datetime, l.e as event_id, cast(l.v as double) as value
        from (select measure, max({{'t': r_datetime, 'e': event_id, 'n': notation, 'v': value}}) as l
          from ({SHAPED}) s where r_datetime is not null and measure is not null group by measure) g""",
)
def stream_latest(spark, sf_dir):
    """The latest reading per measure after four micro-batches; later ones bring late rows, equal moments and repeats."""
    rows = staged(usable(shaped(spark, sf_dir)).select("measure", "r_datetime", "event_id", "notation", "value"), "latest-rows")
    landed, checkpoint = fresh_path(spark, "landed-latest"), fresh_path(spark, "latest-checkpoint")
    sink, ended = LatestReadings(spark, fresh_path(spark, "latest"), ("event_id", "notation")), []
    # a delivery is as many files as tasks write, and one micro-batch; the second comes once more, so that rows repeat
    for part in (2, 0, 1, 0):
        rows.where(F.col("event_id") % 3 == part).write.mode("append").parquet(landed)
        stream = follow_latest(spark.readStream.schema(rows.schema).parquet(landed), sink, checkpoint)
        stream.awaitTermination()
        ended.append(stream.lastProgress["batchId"])
    discard(rows)
    sink.compact(ended[1])
    return sink.read().select("notation", moment_text("r_datetime"), "event_id", F.col("value").cast("double").alias("value"))
