"""Parent and child tables without foreign keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.notation import station_id_of
from .area_metrics import AREA_KEYS
from .joins import lookup


def children_of(parents: DataFrame, children: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Each child with the columns of its parent; ``left`` also keeps orphans."""
    return lookup(children, parents, [on], how)


def cascaded(children: DataFrame, remaining_parents: DataFrame, on: str) -> DataFrame:
    """Children left after their parents were deleted."""
    return lookup(children, remaining_parents.select(on), [on], "left_semi")


def orphans(children: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """Children without a parent."""
    return lookup(children, parents.select(on), [on], "left_anti")


def measures_with_station(measures: DataFrame, stations: DataFrame) -> DataFrame:
    """Measures joined to stations by the id in the station URI."""
    named = stations.select(
        F.col("notation").alias("station_id_label"), F.col("label").alias("station_name")
    )
    keyed = measures.withColumn("station_id_label", station_id_of(F.col("station_id")))
    return lookup(keyed, named, ["station_id_label"])


def colocated_pairs(links: DataFrame, stations: DataFrame) -> DataFrame:
    """``(station_id, colocated_id)`` links with the label of the linked station."""
    linked = stations.select(
        F.col("json_id").alias("colocated_id"),
        F.col("notation").alias("colocated_notation"),
        F.col("label").alias("colocated_label"),
    )
    return lookup(links, linked, ["colocated_id"], "inner")


def area_view(
    areas: DataFrame, polygons: DataFrame | Callable[[DataFrame, list[str]], DataFrame], metrics: DataFrame
) -> DataFrame:
    """Areas with polygon and metrics, one row per area and polygon; absent parts are null.

    ``polygons`` is a table of polygons by area, or a function that adds them to areas
    and keeps the named columns, and the areas that have none. The function is applied
    last, so that where an area has many polygons no row of the result is shuffled.
    """
    measured = metrics.select(
        "floodarea_id",
        "bbox_wgs84_min_lat", "bbox_wgs84_min_long", "bbox_wgs84_max_lat", "bbox_wgs84_max_long",
        "bcen_bng_lat", "bcen_bng_long", "mpoly_cent_wgs84_lat", "mpoly_cent_wgs84_long",
        "area_m2", "area_km2", "rank",
    )
    described = areas.select(
        "floodarea_id", "fwdcode", "eaareaname", "county", "description", "label", "riverorsea"
    )
    if callable(polygons):
        whole = areas.join(measured, "floodarea_id", "left")
        also = [name for name in (*described.columns, *measured.columns) if name not in AREA_KEYS]
        located = F.col("polygon_json").isNotNull()
        joined = polygons(whole, also).withColumns({name: F.when(located, F.col(name)) for name in ("lat", "long")})
    else:
        located = polygons.select("floodarea_id", "lat", "long", "polygon_json")
        joined = described.join(located, "floodarea_id", "left").join(measured, "floodarea_id", "left")
    return joined.select(
        *described.columns,
        "lat", "long",
        *[name for name in measured.columns if name != "floodarea_id"],
        "polygon_json",
    )


def catalogue_columns(areas: DataFrame) -> DataFrame:
    """The columns of the area catalogue."""
    return areas.select("eaareaname", "county", "description", "label", "fwdcode")


def listing_columns(areas: DataFrame) -> DataFrame:
    """The columns of the area listing."""
    return areas.select("county", "fwdcode", "lat", "long")
