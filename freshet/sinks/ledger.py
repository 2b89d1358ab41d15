"""Which landed files a table holds: path, length and change time of every file loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import discard, hadoop_path, staged

LEDGER_SCHEMA = "path string, length long, modified long, batch long"


class FileLedger:
    """A table of loaded files, one folder a batch; the newest batch of a path counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def batches(self) -> list[int]:
        """Numbers of the batches recorded, from folder names alone."""
        folder, files = hadoop_path(self.spark, self.path)
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder) if status.isDirectory()]
        return sorted(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))

    def read(self) -> DataFrame:
        """``path, length, modified`` of each file as it was when it was last loaded."""
        if not self.batches():
            return self.spark.createDataFrame([], "path string, length long, modified long")
        rows = self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)
        last = F.max_by(F.struct("length", "modified"), F.col("batch")).alias("last")
        return rows.groupBy("path").agg(last).select("path", "last.length", "last.modified").where("length is not null")

    def compare(self, listing: DataFrame) -> DataFrame:
        """Files that are not as recorded, ``path, length, modified, state``: ``new``, ``changed`` or ``gone``."""
        known = self.read().select("path", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
        same = (F.col("length") == F.col("_length")) & (F.col("modified") == F.col("_modified"))
        state = F.when(F.col("_length").isNull(), "new").when(F.col("length").isNull(), "gone").when(~same, "changed")
        both = listing.select("path", "length", "modified").join(known, "path", "full")
        return both.select("path", "length", "modified", state.alias("state")).where("state is not null")

    def record(self, files: DataFrame, batch: int) -> None:
        """Note files as loaded, and those without a length as gone. A batch that is recorded again replaces itself."""
        files.select("path", "length", "modified").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def compact(self) -> None:
        """One folder for all batches: the last one, written anew, before the others go."""
        batches = self.batches()
        if len(batches) < 2:
            return
        whole = staged(self.read(), "ledger")
        self.record(whole, batches[-1] + 1)
        discard(whole)
        for batch in batches:
            folder, files = hadoop_path(self.spark, f"{self.path}/batch={batch}")
            files.delete(folder, True)
