"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # hot keys are divided between tasks, also where that costs another shuffle
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the default type has no bounds in the footers, so filters on moments could skip nothing
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # larger generated methods are not compiled by the JVM; split them instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(app: str, cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the local benchmark; clusters bring their own."""
    n_partitions = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", n_partitions)
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on (UTC days, adaptive joins)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="freshet-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, visible to every executor.

    A temporary folder is used only where the setting is absent and the whole
    session runs in one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and fixes the rows
    for plans that need to read the same result more than once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no frame still reads."""
    for table in tables:
        target, files = hadoop_path(table.sparkSession, table.staged_path)
        files.delete(target, True)


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, for listing and deleting."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())
