"""The latest reading of every measure, kept up to date by a stream.

The state is one row a measure: its latest reading, which a late row replaces only if it
is newer. Each micro-batch emits the measures that changed and writes them to a folder
of its own, which a repeated batch replaces, so the sink is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.constants import TRAILING_DAYS
from ..session import discard, hadoop_path, staged


def _newest(carry: tuple[str, ...]):
    # ties on the moment are settled by the carried columns and the value, as in the batch operator
    return F.max(F.struct("r_datetime", *carry, "value")).alias("last")


class LatestReadings:
    """The changes of each micro-batch, one folder a batch, and the newest of each measure over them."""

    def __init__(self, spark: SparkSession, path: str, carry: tuple[str, ...] = ()):
        self.spark, self.path, self.carry = spark, path.rstrip("/"), carry

    def read(self) -> DataFrame:
        """``measure, r_datetime``, the carried columns and ``value``: one row a measure."""
        rows = self.spark.read.parquet(self.path).drop("batch")
        return rows.groupBy("measure").agg(_newest(self.carry)).select("measure", "last.*")

    def write(self, changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def compact(self, upto: int) -> None:
        """Fold the batches up to ``upto`` into one; a batch of that number is not to be repeated any more."""
        folder, files = hadoop_path(self.spark, self.path)
        numbers = sorted(int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(folder)
                         if s.getPath().getName().startswith("batch="))
        old = [n for n in numbers if n <= upto]
        if len(old) < 2:
            return
        rows = self.spark.read.parquet(*(f"{self.path}/batch={n}" for n in old))
        whole = staged(rows.groupBy("measure").agg(_newest(self.carry)).select("measure", "last.*"), "latest")
        self.write(whole, old[-1])
        discard(whole)
        for n in old[:-1]:
            target, files = hadoop_path(self.spark, f"{self.path}/batch={n}")
            files.delete(target, True)


def latest_stream(readings: DataFrame, carry: tuple[str, ...] = (), days: int = TRAILING_DAYS) -> DataFrame:
    """The newest reading of each measure of a stream of readings, for update mode.

    ``days`` is the watermark, past which no downstream operator need wait; the state
    itself is one row a measure and needs no bound in time. Rows without a moment or a
    measure count for nothing.
    """
    kept = readings.where(F.col("r_datetime").isNotNull() & F.col("measure").isNotNull())
    return kept.withWatermark("r_datetime", f"{days} days").groupBy("measure").agg(_newest(carry)).select("measure", "last.*")


def follow_latest(
    readings: DataFrame, sink: LatestReadings, checkpoint: str, available_now: bool = True, every: str = "10 seconds", days: int = TRAILING_DAYS
) -> StreamingQuery:
    """Run :func:`latest_stream` into a sink: over what has landed, or with a trigger ``every`` so often."""
    stream = (
        latest_stream(readings, sink.carry, days)
        .writeStream.outputMode("update")
        .foreachBatch(lambda rows, batch: sink.write(rows, batch))
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return stream.trigger(**trigger).start()
