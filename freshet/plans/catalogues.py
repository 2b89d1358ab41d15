"""Loading catalogue documents into their table sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import meta_version
from ..operators import catalogue as C
from ..operators.area_metrics import AREA_KEYS, area_metrics, unmeasured_areas, with_rank
from ..operators.relations import area_view
from ..session import staged
from ..sinks.catalogue_tables import CatalogueTables
from ..sources.envelopes import envelope_items, envelope_meta, read_envelopes
from ..sources.polygon_files import read_polygon_documents

AREA_VIEW = "v_floodarea"

# table name -> flattening of the items
HYDROLOGY_STATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "station": C.hydrology_stations,
    "station_type": C.station_types,
    "station_observed_property": C.station_properties,
    "station_status": C.station_statuses,
    "station_measure": C.station_measures,
    "station_colocated": C.station_colocations,
}
HYDROLOGY_MEASURES = {"measure": C.hydrology_measures}
FLOOD_STATIONS = {"station": C.flood_stations, "station_measure": C.flood_station_measures}
FLOOD_MEASURES = {"measure": C.flood_measures}


def catalogue_tables(envelopes: DataFrame, flatten: dict[str, Callable]) -> dict[str, DataFrame]:
    """Metadata, raw documents and flattened tables of one catalogue."""
    items = staged(envelope_items(envelopes), "items")
    tables = {name: function(items) for name, function in flatten.items()}
    return {"meta": envelope_meta(envelopes), "document": C.raw_documents(items), **tables}


def refresh_catalogue(
    spark: SparkSession, documents: str | list[str], base: str, flatten: dict[str, Callable]
) -> CatalogueTables:
    """Replace a table set by the content of landed documents."""
    target = CatalogueTables(spark, base)
    target.refresh(catalogue_tables(read_envelopes(spark, documents), flatten))
    return target


def area_tables(envelopes: DataFrame, polygon_documents: DataFrame) -> dict[str, DataFrame]:
    """Areas, polygons, ranked metrics and areas without any, with metadata and raw documents."""
    items = staged(envelope_items(envelopes), "area-items")
    areas = staged(C.flood_areas(items), "areas")
    polygons = staged(C.area_polygons(areas, polygon_documents), "polygons")
    metrics = staged(area_metrics(polygons), "metrics")
    meta = envelope_meta(envelopes).withColumn("version", meta_version(F.col("version")))
    return {
        "meta": meta,
        "document": C.raw_documents(items),
        "area": areas,
        "polygon": polygons,
        "metrics": with_rank(metrics),
        "unmeasured": unmeasured_areas(polygons, metrics).select(*AREA_KEYS),
    }


def refresh_areas(spark: SparkSession, documents: str | list[str], polygons: str, base: str) -> CatalogueTables:
    """Replace the area tables by the content of landed documents and polygon files."""
    target = CatalogueTables(spark, base)
    target.refresh(area_tables(read_envelopes(spark, documents), read_polygon_documents(spark, polygons)))
    return target


def register_area_view(tables: CatalogueTables) -> DataFrame:
    """The joined view over the current area tables, also by name in SQL."""
    view = area_view(tables.read("area"), tables.read("polygon"), tables.read("metrics"))
    view.createOrReplaceTempView(AREA_VIEW)
    return view
