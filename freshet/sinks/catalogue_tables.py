"""Sets of catalogue tables that are replaced together or extended.

``<base>/version=<id>/<table>`` holds one complete set. A version becomes
current when its name is written to ``<base>/current/<number>``, after all its
tables. Numbers grow and nothing is overwritten, so readers always find a set.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.changes import first_of_key, repeats, without_repeats
from ..session import hadoop_path, staged


class CatalogueTables:
    """Named tables under one base path."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    def _pointers(self) -> list[str]:
        # numbers of the pointers that are written in full, in growing order
        folder, files = hadoop_path(self.spark, f"{self.base}/current")
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        done = [name for name in names if files.exists(hadoop_path(self.spark, f"{self.base}/current/{name}/_SUCCESS")[0])]
        return sorted(done, key=int)

    def _version(self, pointer: str) -> str:
        return self.spark.read.schema("version string").json(f"{self.base}/current/{pointer}").first().version

    def current_version(self) -> str | None:
        """Name of the set in use; None before the first load."""
        pointers = self._pointers()
        return self._version(pointers[-1]) if pointers else None

    def read(self, table: str) -> DataFrame:
        """One table of the current set."""
        version = self.current_version()
        if version is None:
            raise ValueError(f"nothing has been loaded under {self.base}")
        return self.spark.read.parquet(f"{self.base}/version={version}/{table}")

    def refresh(self, tables: dict[str, DataFrame]) -> str:
        """Replace all tables; readers see either the old set or the new one."""
        version = uuid.uuid4().hex
        for name, rows in tables.items():
            stamped = rows.withColumn("created", F.current_timestamp()) if "created" not in rows.columns else rows
            stamped.write.parquet(f"{self.base}/version={version}/{name}")
        pointer = self.spark.range(1).select(F.lit(version).alias("version")).coalesce(1)
        number = int((self._pointers() or ["0"])[-1]) + 1
        # of two writers at the same time one fails here
        pointer.write.mode("error").json(f"{self.base}/current/{number}")
        return version

    def remove_old(self, keep: int = 1) -> None:
        """Delete all sets but the newest ``keep``; no reader may still use them."""
        if keep < 1:
            raise ValueError("the set in use has to stay")
        for pointer in self._pointers()[:-keep]:
            for path in (f"version={self._version(pointer)}", f"current/{pointer}"):
                folder, files = hadoop_path(self.spark, f"{self.base}/{path}")
                files.delete(folder, True)

    def append(self, table: str, rows: DataFrame, key: str = "json_id") -> DataFrame:
        """Add the rows whose key is new, one for each key. Returns the rows that were rejected.

        Of rows of the batch with one key the first in order of their values is taken. Rows
        without a key repeat nothing.
        """
        version = self.current_version()
        if version is None:
            raise ValueError(f"nothing has been loaded under {self.base}")
        stored = self.read(table)
        # both are written out before the table changes
        ranked = staged(first_of_key(rows, key, "_first"), "batch")
        single, others = ranked.where("_first").drop("_first"), ranked.where("not _first").drop("_first")
        rejected = staged(repeats(stored, single, [key]).unionByName(others), "rejected")
        accepted = staged(without_repeats(stored, single, [key]), "accepted")
        stamped = accepted.withColumn("created", F.current_timestamp())
        stamped.write.mode("append").parquet(f"{self.base}/version={version}/{table}")
        return rejected
