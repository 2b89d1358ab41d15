"""Catalogue items flattened into entity and child tables.

Every function takes ``(batch_id, raw)`` rows, ``raw`` being the JSON text of
one item. Entities are keyed by their URI, ``json_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsontext as J
from ..functions.constants import FLOOD_ROOT
from ..functions.dates import parse_date, parse_datetime
from ..functions.geodesy import with_points
from ..functions.geometry import geojson_multipolygon
from ..functions.notation import root_templated, station_id_of
from ..functions.values import integer_or_zero, number_or_null, number_or_zero

HYD_STATION_ITEM = """
    `@id` string, label string, notation string, easting string, northing string,
    lat string, long string, catchmentName string, riverName string, town string,
    stationGuid string, stationReference string, wiskiID string, RLOIid string,
    rloiStationLink string, catchmentArea string, dateOpened string, dateClosed string,
    nrfaStationID string, nrfaStationURL string, datum string, boreholeDepth string,
    aquifer string, statusReason string, dataQualityMessage string,
    dataQualityStatement string, sampleOf string,
    type array<struct<`@id`:string>>,
    observedProperty array<struct<`@id`:string>>,
    status array<struct<`@id`:string, label:string>>,
    measures array<struct<`@id`:string, parameter:string, period:string, valueStatistic:string>>,
    colocatedStation array<struct<`@id`:string>>
"""

HYD_MEASURE_ITEM = """
    `@id` string, label string, parameter string, parameterName string, notation string,
    qualifier string, period string, periodName string, hasTelemetry string, valueType string,
    datumType string, timeseriesID string, unit struct<`@id`:string>, unitName string,
    valueStatistic struct<`@id`:string, label:string>,
    observationType struct<`@id`:string, label:string>,
    observedProperty struct<`@id`:string, label:string>,
    station struct<`@id`:string, label:string, wiskiID:string, stationReference:string, RLOIid:string>
"""

FLD_STATION_ITEM = """
    `@id` string, label string, notation string, easting string, northing string,
    lat string, long string, catchmentName string, riverName string, town string,
    stationReference string, wiskiID string, RLOIid string, dateOpened string,
    stageScale string, status string, datumOffset string,
    measures array<struct<`@id`:string, parameter:string, parameterName:string,
        period:string, qualifier:string, unitName:string>>
"""

FLD_MEASURE_ITEM = """
    `@id` string, label string, parameter string, parameterName string, notation string,
    qualifier string, period string, periodName string, station string, stationReference string,
    hasTelemetry string, valueType string, datumType string, unit string, unitName string,
    latestReading struct<`@id`:string, date:string, dateTime:string, measure:string, value:string>
"""

AREA_ITEM = """
    `@id` string, county string, description string, eaAreaName string, eaRegionName string,
    floodWatchArea string, fwdCode string, label string, lat string, long string,
    notation string, polygon string, quickDialNumber string, riverOrSea string
"""


def _parsed(items: DataFrame, schema: str) -> DataFrame:
    return items.select("batch_id", F.from_json("raw", schema).alias("i"))


def _typed(measures: DataFrame) -> DataFrame:
    """Period and telemetry flag, which documents hold as numbers, flags or text."""
    return measures.withColumns({
        "period": F.col("period").try_cast("double").try_cast("int"),
        "has_telemetry": F.col("has_telemetry").try_cast("boolean"),
    })


def _located(items: DataFrame, schema: str, number: Callable[[Column], Column]) -> DataFrame:
    parsed = _parsed(items, schema)
    return with_points(parsed.withColumns({"lat": number(_field("lat")), "long": number(_field("long"))}))


def _field(name: str) -> Column:
    return F.col(f"i.`{name}`")


def _renamed(names: dict[str, str]) -> list[Column]:
    return [_field(source).alias(target) for target, source in names.items()]


def raw_documents(items: DataFrame) -> DataFrame:
    """The unparsed item of every entity."""
    return items.select("batch_id", J.member(F.col("raw"), "@id").alias("json_id"), F.col("raw").alias("document"))


def hydrology_stations(items: DataFrame) -> DataFrame:
    """Hydrology stations, one row each."""
    return _located(items, HYD_STATION_ITEM, number_or_null).select(
        "batch_id",
        *_renamed({"json_id": "@id", "label": "label", "notation": "notation"}),
        number_or_null(_field("easting")).alias("easting"),
        number_or_null(_field("northing")).alias("northing"),
        "lat",
        "long",
        *_renamed({
            "catchment_name": "catchmentName",
            "river_name": "riverName",
            "town": "town",
            "station_guid": "stationGuid",
            "station_reference": "stationReference",
            "wiski_id": "wiskiID",
        }),
        J.list_or_text(_field("RLOIid")).alias("rloi_id"),
        J.link_ids(_field("rloiStationLink")).alias("rloi_station_link"),
        number_or_zero(_field("catchmentArea")).alias("catchment_area"),
        parse_date(_field("dateOpened")).alias("date_opened"),
        parse_date(_field("dateClosed")).alias("date_closed"),
        *_renamed({"nrfa_station_id": "nrfaStationID", "nrfa_station_url": "nrfaStationURL"}),
        integer_or_zero(_field("datum")).alias("datum"),
        number_or_zero(_field("boreholeDepth")).alias("borehole_depth"),
        *_renamed({
            "aquifer": "aquifer",
            "status_reason": "statusReason",
            "data_quality_message": "dataQualityMessage",
        }),
        J.member(_field("dataQualityStatement"), "@id").alias("data_quality_statement"),
        J.member(_field("sampleOf"), "@id").alias("sample_of_id"),
        J.member(_field("sampleOf"), "label").alias("sample_of_label"),
        "geom4326",
        "geom27700",
    )


def _children(items: DataFrame, schema: str, field: str) -> DataFrame:
    parsed = _parsed(items, schema)
    return parsed.select("batch_id", _field("@id").alias("station_id"), F.explode(_field(field)).alias("c"))


def station_types(items: DataFrame) -> DataFrame:
    """``(station_id, type_id)``."""
    return _children(items, HYD_STATION_ITEM, "type").select("station_id", F.col("c.`@id`").alias("type_id"))


def station_properties(items: DataFrame) -> DataFrame:
    """``(station_id, property_id)`` of the observed properties."""
    rows = _children(items, HYD_STATION_ITEM, "observedProperty")
    return rows.select("station_id", F.col("c.`@id`").alias("property_id"))


def station_statuses(items: DataFrame) -> DataFrame:
    """``(station_id, status_id, status_label_id)``."""
    return _children(items, HYD_STATION_ITEM, "status").select(
        "station_id",
        F.col("c.`@id`").alias("status_id"),
        J.id_or_text(F.col("c.label")).alias("status_label_id"),
    )


def station_measures(items: DataFrame) -> DataFrame:
    """``(station_id, measure_id, parameter, period, value_statistic_id)``."""
    return _children(items, HYD_STATION_ITEM, "measures").select(
        "station_id",
        F.col("c.`@id`").alias("measure_id"),
        F.col("c.parameter").alias("parameter"),
        F.col("c.period").try_cast("double").try_cast("int").alias("period"),
        J.member(F.col("c.valueStatistic"), "@id").alias("value_statistic_id"),
    )


def station_colocations(items: DataFrame) -> DataFrame:
    """``(station_id, colocated_id)``."""
    rows = _children(items, HYD_STATION_ITEM, "colocatedStation")
    return rows.select("station_id", F.col("c.`@id`").alias("colocated_id"))


def hydrology_measures(items: DataFrame) -> DataFrame:
    """Hydrology measures, one row each, with the station id taken from its URI."""
    def nested(field: str, name: str) -> Column:
        return F.col(f"i.{field}.`{name}`")

    return _typed(_parsed(items, HYD_MEASURE_ITEM).select(
        "batch_id",
        *_renamed({
            "json_id": "@id",
            "label": "label",
            "parameter": "parameter",
            "parameter_name": "parameterName",
            "notation": "notation",
            "qualifier": "qualifier",
            "period": "period",
            "period_name": "periodName",
            "has_telemetry": "hasTelemetry",
            "value_type": "valueType",
            "datum_type": "datumType",
            "timeseries_id": "timeseriesID",
        }),
        nested("unit", "@id").alias("unit"),
        *_renamed({"unit_name": "unitName"}),
        nested("valueStatistic", "@id").alias("value_statistic_id"),
        nested("valueStatistic", "label").alias("value_statistic_label"),
        nested("observationType", "@id").alias("observation_type_id"),
        nested("observationType", "label").alias("observation_type_label"),
        nested("observedProperty", "@id").alias("observed_property_id"),
        nested("observedProperty", "label").alias("observed_property_label"),
        nested("station", "@id").alias("station_id"),
        station_id_of(nested("station", "@id")).alias("station_id_label"),
        nested("station", "label").alias("station_label"),
        nested("station", "wiskiID").alias("station_wiski_id"),
        nested("station", "stationReference").alias("station_reference"),
        J.list_or_text(nested("station", "RLOIid")).alias("station_rloi_id"),
    ))


def flood_stations(items: DataFrame) -> DataFrame:
    """Flood-monitoring stations, one row each; repeated coordinates give the first one."""
    return _located(items, FLD_STATION_ITEM, J.first_number).select(
        "batch_id",
        *_renamed({"json_id": "@id", "label": "label", "notation": "notation"}),
        J.first_number(_field("easting")).alias("easting"),
        J.first_number(_field("northing")).alias("northing"),
        "lat",
        "long",
        *_renamed({
            "catchment_name": "catchmentName",
            "river_name": "riverName",
            "town": "town",
            "station_reference": "stationReference",
            "wiski_id": "wiskiID",
        }),
        J.list_or_text(_field("RLOIid")).alias("rloi_id"),
        parse_date(_field("dateOpened")).alias("date_opened"),
        *_renamed({"stage_scale": "stageScale", "status": "status"}),
        number_or_null(_field("datumOffset")).alias("datum_offset"),
        "geom4326",
        "geom27700",
    )


def flood_station_measures(items: DataFrame) -> DataFrame:
    """Measures listed inside flood-monitoring stations."""
    return _children(items, FLD_STATION_ITEM, "measures").select(
        "station_id",
        F.col("c.`@id`").alias("json_id"),
        F.col("c.parameter").alias("parameter"),
        F.col("c.parameterName").alias("parameter_name"),
        F.col("c.period").try_cast("double").try_cast("int").alias("period"),
        F.col("c.qualifier").alias("qualifier"),
        F.col("c.unitName").alias("unit_name"),
    )


def flood_measures(items: DataFrame) -> DataFrame:
    """Flood-monitoring measures, one row each, with their latest reading."""
    latest = "i.latestReading.`{}`".format
    return _typed(_parsed(items, FLD_MEASURE_ITEM).select(
        "batch_id",
        *_renamed({
            "json_id": "@id",
            "label": "label",
            "parameter": "parameter",
            "parameter_name": "parameterName",
            "notation": "notation",
            "qualifier": "qualifier",
            "period": "period",
            "period_name": "periodName",
            "station": "station",
            "station_reference": "stationReference",
            "has_telemetry": "hasTelemetry",
            "value_type": "valueType",
            "datum_type": "datumType",
        }),
        F.lit(None).cast("string").alias("timeseries_id"),
        *_renamed({"unit": "unit", "unit_name": "unitName"}),
        F.col(latest("@id")).alias("latest_reading_id"),
        parse_date(F.col(latest("date"))).alias("latest_reading_date"),
        parse_datetime(F.col(latest("dateTime"))).alias("latest_reading_datetime"),
        F.col(latest("measure")).alias("latest_reading_measure"),
        F.col(latest("value")).try_cast("double").alias("latest_reading_value"),
    ))


def flood_areas(items: DataFrame) -> DataFrame:
    """Hazard areas, one row each; missing coordinates are 0 while the points stay null."""
    return _located(items, AREA_ITEM, number_or_null).select(
        "batch_id",
        F.xxhash64(_field("@id")).alias("floodarea_id"),
        root_templated(_field("@id"), FLOOD_ROOT).alias("envagy_id"),
        *_renamed({
            "county": "county",
            "description": "description",
            "eaareaname": "eaAreaName",
            "earegionname": "eaRegionName",
            "floodwatcharea": "floodWatchArea",
            "fwdcode": "fwdCode",
            "label": "label",
        }),
        F.coalesce("lat", F.lit(0.0)).alias("lat"),
        F.coalesce("long", F.lit(0.0)).alias("long"),
        _field("notation").alias("notation"),
        root_templated(_field("polygon"), FLOOD_ROOT).alias("polygon"),
        *_renamed({"quickdialnumber": "quickDialNumber", "riverorsea": "riverOrSea"}),
        "geom4326",
        "geom27700",
    )


def area_polygons(areas: DataFrame, documents: DataFrame, how: str = "inner", also: Sequence[str] = ()) -> DataFrame:
    """``areas`` with their landed polygon text; areas without a usable document are left out.

    ``left`` keeps those, without a polygon; ``also`` names further columns of the areas to keep.
    """
    accepted = documents.select("fwdcode", J.accepted_geojson(F.col("polygon_json")).alias("polygon_json"))
    return (
        areas.select("floodarea_id", "fwdcode", "lat", "long", "geom4326", "geom27700", *also)
        .join(accepted.where(F.col("polygon_json").isNotNull()), "fwdcode", how)
        .withColumn("polygon_geom", geojson_multipolygon(F.col("polygon_json")))
    )
