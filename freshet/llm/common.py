"""Helpers shared by the text operators: sessions, staged tables, bitmaps, components."""

from __future__ import annotations

import atexit
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_path, hadoop_path, prepare

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows per Arrow batch; texts are further cut into slices of about a megabyte.
ARROW_ROWS = "500"


def session_of(df: DataFrame) -> SparkSession:
    """The frame's session with the settings that the operators rely on."""
    return tuned(df.sparkSession)


def tuned(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target, files = hadoop_path(spark, path)
        files.delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended, and its folder with it
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    The files outlive any executor. They go when ``discard`` is called, or when the
    driver's program ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    atexit.register(_delete, spark, path)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no frame still reads."""
    for table in tables:
        _delete(table.sparkSession, table.staged_path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


# --- a set of keys of bounded size --------------------------------------------------

BITMAP_BITS = 1 << 23


def bitmap(keys: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bit for each hashed key of a one-column frame: ``bits / 8`` bytes, however many keys.

    Membership in it is a necessary condition only; a join decides afterwards.
    """
    place = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(bits))
    words = (keys.select(place.alias("p"))
             .groupBy(F.shiftright("p", 5).cast("int").alias("w"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("b")))
    out = np.zeros(bits // 32, dtype=np.uint32)
    table = words.toArrow()
    out[table["w"].to_numpy()] = table["b"].to_numpy().astype(np.uint32)
    return out


def in_bitmap(spark: SparkSession, words: np.ndarray, column: str) -> Callable[[DataFrame], DataFrame]:
    """Keep the rows whose key may be in the bitmap, before they are shuffled."""
    sent = spark.sparkContext.broadcast(words)
    bits = len(words) * 32

    def keep(df: DataFrame) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                place = batch.column("__place").to_numpy()
                hit = (sent.value[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1)
                yield batch.filter(pa.array(hit.astype(bool))).drop_columns(["__place"])

        schema = df.schema
        marked = df.withColumn("__place", F.pmod(F.xxhash64(F.col(column)), F.lit(bits)))
        return marked.mapInArrow(run, schema)

    return keep


# --- connected components ------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """The smallest vertex reachable from each vertex of an undirected edge list (a, b).

    Alternates large-star and small-star steps (Kiveris et al., 2014) until no edge
    changes. Every step is a grouped minimum, pre-aggregated before its shuffle, and
    a join, whose hot centres adaptive execution splits. Edge lists are sets; two of them
    are compared by their count and two hashes. Returns (vertex, component); vertices
    without an edge are not listed.
    """

    def mark(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first())

    current = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = mark(current)
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .union(least.select("a", F.col("m").alias("b"))).distinct())
        small = staged(small, "small")
        discard(current, large)
        current, last, before = small, before, mark(small)
        if last == before:
            return current.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(
                current.select("b", "b").distinct())


# --- runs of equal keys in sorted Arrow batches -----------------------------------------


def keyed_runs(batches: Iterator, keys: Sequence[str], at_least: int = 1) -> Iterator:
    """Tables that end where a key ends, from batches of a partition sorted by ``keys``.

    Each table holds all rows of every key in it, and about ``at_least`` rows.
    """
    import pyarrow as pa

    held: list = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        table = pa.Table.from_batches(held)
        cut = last_run(table, keys)
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def last_run(table, keys: Sequence[str]) -> int:
    """Where the rows of the last key of a sorted table begin."""
    n = table.num_rows
    same = np.ones(n, dtype=bool)
    for key in keys:
        values = table[key].to_numpy()
        same &= values == values[-1]
    away = np.flatnonzero(~same)
    return int(away[-1]) + 1 if len(away) else 0


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """First rows of the runs of equal values in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for values in columns:
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def crc32_of(column: str | Column) -> Column:
    """CRC-32 of a column's text, null as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit("")).cast("binary"))




# --- vectors ----------------------------------------------------------------------------


def matrices(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and double-precision matrix of a list column's usable vectors, by dimension.

    Left out are vectors that are null, empty, zero, or hold a null or non-finite component.
    """
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count:
        lengths = lengths * ~column.is_null().to_numpy(zero_copy_only=False)
    first = column.offsets.to_numpy()[:-1]
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == size)
        x = values[first[at][:, None] + np.arange(size)]
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        if good.any():
            yield at[good], x[good]


def with_row(rows: DataFrame, name: str = "row") -> DataFrame:
    """A number for each row that stays the same when the table is read again.

    Rows of files are numbered by file and place in it; other frames are staged with a
    number.
    """
    try:
        return rows.withColumn(name, F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:  # not a table of files
        return staged(rows.withColumn(name, F.monotonically_increasing_id()), "rows")
