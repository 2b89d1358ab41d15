"""Daily reading files ``<base>/<yyyy>/hydro-<yyyy-mm-dd>.csv``.

A day is one CSV file, or a directory of part files as Spark writes it. All
cells are text; columns are matched by header name.
"""

from __future__ import annotations

import csv
import datetime as dt
from collections import defaultdict
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.constants import SOURCE_LIMITS
from ..functions.values import normalise_missing
from ..session import hadoop_path

READING_COLUMNS = (
    "measure", "dateTime", "date", "value", "period", "completeness",
    "quality", "qcode", "valid", "invalid", "missing",
)
READING_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in READING_COLUMNS])

SOURCE_PATTERN = r"(hydro-\d{4}-\d{2}-\d{2})(?:\.csv)?(?:/[^/]*)?$"
PROBE_THREADS = 16
DAYS_PER_GLOB = 100


def source_tag(path: Column) -> Column:
    """``hydro-<date>`` of a file path; null for other names."""
    return F.nullif(F.regexp_extract(path, SOURCE_PATTERN, 1), F.lit(""))


def source_day(tag: Column) -> Column:
    """The day in a ``hydro-<date>`` tag."""
    return F.try_to_date(F.substring(tag, 7, 10), "yyyy-MM-dd")


def list_reading_files(spark: SparkSession, base: str, days: Iterable[dt.date] | None = None) -> DataFrame:
    """``(path, length, modified, source, day)`` of the landed files, empty ones included.

    Names, sizes and change times (milliseconds) come from the file system; contents are
    not read. With ``days`` only names of those days are listed, one or two folders below
    ``base``, and not the whole tree.
    """
    folder, files = hadoop_path(spark, base)
    found = []

    def add(listing):
        while listing.hasNext():
            status = listing.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))

    if days is None:
        add(files.listFiles(folder, True))
    else:
        wanted = sorted(set(days))
        for first in range(0, len(wanted), DAYS_PER_GLOB):
            names = ",".join(f"hydro-{day.isoformat()}" for day in wanted[first : first + DAYS_PER_GLOB])
            for depth in ("*", "*/*"):
                for status in files.globStatus(hadoop_path(spark, f"{base}/{depth}{{{names}}}*")[0]) or []:
                    add(files.listFiles(status.getPath(), True))
    return (
        spark.createDataFrame(found, "path string, length long, modified long")
        .where(F.col("path").endswith(".csv"))
        .withColumn("source", source_tag(F.col("path")))
        .where(F.col("source").isNotNull())
        .distinct()
        .withColumn("day", source_day(F.col("source")))
    )


def _csv(reader):
    # quotes inside a cell are doubled
    return reader.option("header", True).option("escape", '"')


def _names(header: list[str]) -> tuple[str, ...]:
    """Column names of a header; the first of equal names counts, and an empty one is of no use."""
    seen: set[str] = set()
    return tuple(name if name and not (name.lower() in seen or seen.add(name.lower())) else f"_c{place}" for place, name in enumerate(header))


def _header_groups(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each header line.

    The file system hands over the first line of every file, so the number of Spark jobs does not follow
    that of the files.
    """
    jvm = spark._jvm

    def first_line(path: str) -> str:
        target, files = hadoop_path(spark, path)
        stream = files.open(target)
        try:
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
            line = reader.readLine()
            # blank lines before the header are passed over, as in the scan
            while line is not None and not line.strip():
                line = reader.readLine()
            return line or ""
        finally:
            stream.close()

    with ThreadPoolExecutor(PROBE_THREADS) as pool:
        lines = list(pool.map(first_line, paths))
    headers = {line: _names(next(csv.reader([line.removeprefix("\ufeff")]), [])) for line in set(lines)}
    groups = defaultdict(list)
    for path, line in zip(paths, lines):
        if headers[line]:
            groups[headers[line]].append(path)
    return groups


def _scan_group(spark: SparkSession, header: tuple[str, ...], paths: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    raw = _csv(spark.read).schema(schema).csv(paths)
    known = [F.col(f"`{name}`") for name in header if name in READING_COLUMNS]
    return raw.select(*known, source_tag(F.col("_metadata.file_path")).alias("source"))


def scan_readings(
    spark: SparkSession, base: str, days: Iterable[dt.date] | None = None
) -> DataFrame:
    """All reading cells of the landed files, with the source tag of each row.

    Files are grouped by header line, so a file with other or reordered columns
    is still read by name. Empty files are skipped. ``days`` restricts the scan
    to the files of those days.
    """
    files = list_reading_files(spark, base, days).where(F.col("length") > 0)
    if days is not None:
        files = files.where(F.col("day").isin(list(days)))
    return scan_files(spark, [row.path for row in files.select("path").collect()])


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All reading cells of the given files, matched by header name."""
    schema = T.StructType(READING_SCHEMA.fields + [T.StructField("source", T.StringType())])
    groups = _header_groups(spark, paths)
    if not groups:
        return spark.createDataFrame([], schema)
    scans = [_scan_group(spark, header, members) for header, members in groups.items()]
    united = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), scans)
    columns = [
        F.col(name) if name in united.columns else F.lit(None).cast("string").alias(name)
        for name in schema.names
    ]
    return normalise_missing(united.select(*columns))


def unusable_days(files: DataFrame, readings: DataFrame) -> DataFrame:
    """Days with a file but no rows: empty files and files of a header line only."""
    with_rows = readings.select(source_day(F.col("source")).alias("day")).distinct()
    return files.select("day").distinct().join(with_rows, "day", "left_anti")


def limited(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows, as a request limit gives them."""
    return df.limit(rows)


def limit_reached(
    readings: DataFrame, per: str = "source", limit: int = SOURCE_LIMITS["readings"]
) -> DataFrame:
    """Batches whose row count equals the request limit, so that rows may be missing."""
    return readings.groupBy(per).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= limit)
