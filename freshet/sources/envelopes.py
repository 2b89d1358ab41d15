"""JSON documents ``{"meta": {...}, "items": [...]}`` of the catalogue APIs.

Items stay JSON text here, one row each, so that the raw document can be kept
and every catalogue parses it with its own schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.jsontext import list_of

ENVELOPE_SCHEMA = """
    `@context` string,
    meta struct<
        `@id`:string, publisher:string, license:string, licence:string,
        licenseName:string, licenceName:string, documentation:string,
        version:string, comment:string, hasFormat:string>,
    items array<string>
"""


def read_envelopes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per document. The API caps a document at 50,000 items."""
    return (
        spark.read.option("multiLine", True)
        .schema(ENVELOPE_SCHEMA)
        .json(path)
        .withColumn("batch_id", F.xxhash64("_metadata.file_path"))
    )


def parse_envelopes(documents: DataFrame, text: str, batch_id: str) -> DataFrame:
    """As :func:`read_envelopes`, for documents held in a text column."""
    parsed = documents.select(
        F.from_json(F.col(text), ENVELOPE_SCHEMA).alias("d"), F.col(batch_id).alias("batch_id")
    )
    return parsed.select("d.*", "batch_id")


def envelope_items(envelopes: DataFrame) -> DataFrame:
    """``(batch_id, raw)``: one row per item, as JSON text."""
    return envelopes.select("batch_id", F.explode("items").alias("raw"))


def envelope_meta(envelopes: DataFrame) -> DataFrame:
    """One metadata row per document; both spellings of the licence are accepted."""
    meta = F.col("meta")
    return envelopes.select(
        "batch_id",
        F.col("`@context`").alias("context"),
        meta["@id"].alias("json_id"),
        meta["publisher"].alias("publisher"),
        F.coalesce(meta["license"], meta["licence"]).alias("license"),
        F.coalesce(meta["licenseName"], meta["licenceName"]).alias("license_name"),
        meta["documentation"].alias("documentation"),
        meta["version"].alias("version"),
        meta["comment"].alias("comment"),
        list_of(meta["hasFormat"]).alias("has_format"),
    )


def item_counts(envelopes: DataFrame, loaded: DataFrame) -> DataFrame:
    """Items received and rows loaded, per batch."""
    received = envelopes.select(
        "batch_id", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("items")
    ).groupBy("batch_id").agg(F.sum("items").alias("n_items"))
    kept = loaded.groupBy("batch_id").agg(F.count("*").alias("n_loaded"))
    return received.join(kept, "batch_id", "left").select(
        "batch_id", "n_items", F.coalesce("n_loaded", F.lit(0)).alias("n_loaded")
    )
