"""Queries that return every column of catalogues, readings and geometries, and of loads that follow a first one.

A field is described once, as ``(JSON key, SQL for its JSON text, {column: SQL for its value})``;
documents and expected columns are both made from these descriptions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import geodesy as G
from ..functions.constants import FLOOD_ROOT, HYDROLOGY_ROOT, STATION_PREFIX
from ..functions.geometry import geojson_multipolygon
from ..functions.values import normalise_missing
from ..functions.wkb import multipolygon_wkb, point_wkb
from ..operators import catalogue as C, readings as R
from ..plans.catalogues import HYDROLOGY_STATIONS, catalogue_tables
from ..session import fresh_path
from ..sinks.catalogue_tables import CatalogueTables
from ..sinks.day_table import DayTable
from ..sources.envelopes import envelope_items, envelope_meta, parse_envelopes, read_envelopes
from .catalogue import K, PK, STATION_LAT, STATION_LONG
from .geography import _RINGS, bng_sql, polygons
from .inputs import RAW_READINGS, STATIONS, derive, plain
from .readings import moment_text
from .registry import query
from .sqltext import na

Field = tuple[str, str, dict[str, str]]


def text(k: str, key: str, column: str, gap: int) -> Field:
    """A text that is null where ``gap`` divides the number ``k``."""
    number = f"cast({k} as string)"
    return (
        key,
        f"case when {k} % {gap} = 0 then 'null' else concat('\"{key} ', {number}, '\"') end",
        {column: f"case when {k} % {gap} <> 0 then concat('{key} ', {number}) end"},
    )


def texts(k: str, **columns: str) -> list[Field]:
    return [text(k, key, column, 3 + place % 5) for place, (key, column) in enumerate(columns.items())]


def nested(k: str, key: str, gap: int, **columns: str) -> Field:
    """An object whose members are texts; ``id`` stands for ``@id``. Null where ``gap`` divides ``k``."""
    number = f"cast({k} as string)"
    members = [
        f"'\"{'@id' if name == 'id' else name}\":\"{key} {name} ', {number}, '\"'" for name in columns
    ]
    inside = ", ',', ".join(members)
    return (
        key,
        f"case when {k} % {gap} = 0 then 'null' else concat('{{{{', {inside}, '}}}}') end",
        {column: f"case when {k} % {gap} <> 0 then concat('{key} {name} ', {number}) end" for name, column in columns.items()},
    )


def item(fields: list[Field]) -> str:
    """SQL for the JSON text of one item."""
    members = ", ',', ".join(f"'\"{key}\":', {json}" for key, json, _ in fields)
    return f"concat('{{{{', {members}, '}}}}')"


def flat(fields: list[Field], rows: str, **more: str) -> str:
    """SQL for the columns of all items."""
    columns = {name: value for _, _, values in fields for name, value in values.items()} | more
    return f"select {', '.join(f'{value} as {name}' for name, value in columns.items())} from ({rows}) rows"


def documents(spark, sf_dir, fields: list[Field], rows: str, batch: str) -> DataFrame:
    """``batch, doc``: an envelope around all items of a batch, as the API hands out up to 50,000."""
    single = derive(spark, sf_dir, f"select {batch} as batch, {item(fields)} as item from ({rows}) rows")
    head = ('{"@context":"http://context/","meta":{"@id":"meta","publisher":"Agency","licence":"http://licence/",'
            '"licenseName":"OGL","documentation":"http://doc/","version":"0.9","comment":"status: beta","hasFormat":["csv","rdf"]},"items":[')
    return single.groupBy("batch").agg(
        F.concat(F.lit(head), F.concat_ws(",", F.collect_list("item")), F.lit("]}")).alias("doc")
    )


def landed(docs: DataFrame, name: str) -> str:
    """Write one file for each document. Returns the folder."""
    path = fresh_path(docs.sparkSession, name)
    docs.write.partitionBy("batch").text(path)
    return path


def items(spark, sf_dir, fields: list[Field], rows: str, batch: str) -> DataFrame:
    return envelope_items(parse_envelopes(documents(spark, sf_dir, fields, rows, batch), "doc", "batch"))


def dates_as_text(rows: DataFrame) -> DataFrame:
    """Dates and timestamps as text, points as coordinates; only millimetres of grid metres."""
    columns = []
    for field in rows.schema:
        if isinstance(field.dataType, T.DateType):
            columns.append(F.date_format(field.name, "yyyy-MM-dd").alias(field.name))
        elif isinstance(field.dataType, T.TimestampType):
            columns.append(moment_text(field.name))
        elif field.name == "geom27700":
            columns += [F.round(f"geom27700.{axis}", 3).alias(f"grid_{axis}") for axis in "xy"]
            columns.append(F.col("geom27700.srid").alias("grid_srid"))
        elif field.name == "geom4326":
            columns += [F.col(f"geom4326.{axis}").alias(f"point_{axis}") for axis in "xy"]
            columns.append(F.col("geom4326.srid").alias("point_srid"))
        else:
            columns.append(F.col(field.name))
    return rows.select(*columns)


def with_grid(sql: str, where: str = "lat is not null and long is not null") -> str:
    """Rows with their points in degrees and on the grid; null where ``where`` does not hold."""
    grid = bng_sql(f"select *, long as lon from ({sql}) q")
    found = {
        "point_x": "long", "point_y": "lat", "point_srid": "4326",
        "grid_x": "round(e, 3)", "grid_y": "round(n, 3)", "grid_srid": "27700",
    }
    points = ", ".join(f"case when {where} then {value} end as {name}" for name, value in found.items())
    names = "* exclude (lon, p, l, nu0, xa, ya, za, xb, yb, zb, flat, lam, q0, q1, q2, q3, q4, q5, nu, rho, d, s, c, t, arc, h2, e, n)"
    return f"select {names}, {points} from ({grid}) w"


# --- catalogues -----------------------------------------------------------------

_S = "s_suppkey"
STATION_FIELDS: list[Field] = [
    ("@id", f"concat('\"{STATION_PREFIX}', {K}, '\"')", {"json_id": f"concat('{STATION_PREFIX}', {K})"}),
    *texts(_S, label="label", notation="notation", catchmentName="catchment_name", riverName="river_name", town="town",
           stationGuid="station_guid", stationReference="station_reference", wiskiID="wiski_id",
           nrfaStationID="nrfa_station_id", nrfaStationURL="nrfa_station_url", aquifer="aquifer",
           statusReason="status_reason", dataQualityMessage="data_quality_message"),
    ("easting", K, {"easting": f"cast({_S} as double)"}),
    ("northing", f"concat('\"', {K}, '.25\"')", {"northing": f"cast({_S} as double) + 0.25"}),
    ("lat", f"case when {_S} % 7 = 0 then 'null' else {STATION_LAT} end",
     {"lat": f"case when {_S} % 7 <> 0 then cast({STATION_LAT} as double) end"}),
    ("long", STATION_LONG, {"long": f"cast({STATION_LONG} as double)"}),
    ("RLOIid", f"concat('[\"', {K}, '\",\"9\"]')", {"rloi_id": f"concat({K}, ',9')"}),
    ("rloiStationLink", f"concat('{{{{\"@id\":\"http://link/', {K}, '\"}}}}')", {"rloi_station_link": f"concat('http://link/', {K})"}),
    ("catchmentArea", f"case when {_S} % 2 = 0 then '12.5' else '\"\"' end",
     {"catchment_area": f"case when {_S} % 2 = 0 then 12.5::double else 0::double end"}),
    ("dateOpened", "'\"2001-02-03\"'", {"date_opened": "'2001-02-03'"}),
    ("dateClosed", f"case when {_S} % 2 = 0 then '\"2011-12-31\"' else '\"never\"' end",
     {"date_closed": f"case when {_S} % 2 = 0 then '2011-12-31' end"}),
    ("datum", K, {"datum": f"cast({_S} as integer)"}),
    ("boreholeDepth", "'3.5'", {"borehole_depth": "3.5::double"}),
    nested(_S, "dataQualityStatement", 4, id="data_quality_statement"),
    nested(_S, "sampleOf", 3, id="sample_of_id", label="sample_of_label"),
]
_STATION_ROWS = "select * from {supplier}"
# stations of a document
_STATION_BATCH = "cast(floor(s_suppkey / 500) as bigint)"
STATIONS_SQL = with_grid(plain(flat(STATION_FIELDS, _STATION_ROWS)))


@query("station_files_all_columns", STATIONS_SQL)
def station_files_all_columns(spark, sf_dir):
    """Stations from document files, in all columns but the number of the file."""
    path = landed(documents(spark, sf_dir, STATION_FIELDS, _STATION_ROWS, _STATION_BATCH), "station-files")
    stations = C.hydrology_stations(envelope_items(read_envelopes(spark, path)))
    return dates_as_text(stations.drop("batch_id"))


@query(
    "meta_files_all_columns",
    f"""select 'http://context/' as context, 'meta' as json_id, 'Agency' as publisher, 'http://licence/' as license,
          'OGL' as license_name, 'http://doc/' as documentation, '0.9' as version, 'status: beta' as comment, 'csv|rdf' as has_format
        from (select distinct {_STATION_BATCH} from supplier) s""",
)
def meta_files_all_columns(spark, sf_dir):
    """The metadata of document files."""
    path = landed(documents(spark, sf_dir, STATION_FIELDS, _STATION_ROWS, _STATION_BATCH), "meta-files")
    meta = envelope_meta(read_envelopes(spark, path))
    return meta.drop("batch_id").withColumn("has_format", F.array_join("has_format", "|"))


_P = "p_partkey"
_PART_ROWS = "select * from {part}"
_PART_BATCH = "cast(floor(p_partkey / 5000) as bigint)"
_TYPED: list[Field] = [
    ("period", "case when p_size % 3 = 0 then concat('\"', cast(p_size as string), '.0\"') when p_size % 3 = 1 then '\"daily\"' else cast(p_size as string) end",
     {"period": "case when p_size % 3 <> 1 then p_size end"}),
    ("hasTelemetry", "case p_size % 3 when 0 then 'true' when 1 then '\"no\"' else '\"maybe\"' end",
     {"has_telemetry": "case p_size % 3 when 0 then true when 1 then false end"}),
]
MEASURE_FIELDS: list[Field] = [
    ("@id", f"concat('\"{HYDROLOGY_ROOT}/id/measures/', {PK}, '\"')", {"json_id": f"concat('{HYDROLOGY_ROOT}/id/measures/', {PK})"}),
    *texts(_P, label="label", parameter="parameter", parameterName="parameter_name", notation="notation", qualifier="qualifier",
           periodName="period_name", valueType="value_type", datumType="datum_type", timeseriesID="timeseries_id", unitName="unit_name"),
    *_TYPED,
    nested(_P, "unit", 3, id="unit"),
    nested(_P, "valueStatistic", 4, id="value_statistic_id", label="value_statistic_label"),
    nested(_P, "observationType", 5, id="observation_type_id", label="observation_type_label"),
    nested(_P, "observedProperty", 6, id="observed_property_id", label="observed_property_label"),
    ("station",
     f"case when {_P} % 3 = 0 then 'null' else concat('{{{{\"@id\":\"{STATION_PREFIX}S', {PK}, '\",\"label\":\"L', {PK}, '\",\"wiskiID\":\"W', {PK}, "
     f"'\",\"stationReference\":\"F', {PK}, '\",\"RLOIid\":[\"1\",\"', {PK}, '\"]}}}}') end",
     {name: f"case when {_P} % 3 <> 0 then concat({before}, {PK}) end" for name, before in (
         ("station_id", f"'{STATION_PREFIX}S'"), ("station_id_label", "'S'"), ("station_label", "'L'"), ("station_wiski_id", "'W'"),
         ("station_reference", "'F'"), ("station_rloi_id", "'1,'"))}),
]


@query("hydrology_measures_all_columns", plain(flat(MEASURE_FIELDS, _PART_ROWS, batch_id=_PART_BATCH)))
def hydrology_measures_all_columns(spark, sf_dir):
    return dates_as_text(C.hydrology_measures(items(spark, sf_dir, MEASURE_FIELDS, _PART_ROWS, _PART_BATCH)))


FLOOD_STATION_FIELDS: list[Field] = [
    ("@id", f"concat('\"{FLOOD_ROOT}/id/stations/', {K}, '\"')", {"json_id": f"concat('{FLOOD_ROOT}/id/stations/', {K})"}),
    *texts(_S, label="label", notation="notation", catchmentName="catchment_name", riverName="river_name", town="town",
           stationReference="station_reference", wiskiID="wiski_id", stageScale="stage_scale", status="status"),
    ("easting", f"concat('[\"\",', {K}, ',7]')", {"easting": f"cast({_S} as double)"}),
    ("northing", f"concat('\"', {K}, '.5\"')", {"northing": f"cast({_S} as double) + 0.5"}),
    ("lat", f"concat('[', {STATION_LAT}, ',1]')", {"lat": f"cast({STATION_LAT} as double)"}),
    ("long", f"case when {_S} % 5 = 0 then '\"west\"' else {STATION_LONG} end",
     {"long": f"case when {_S} % 5 <> 0 then cast({STATION_LONG} as double) end"}),
    ("RLOIid", f"case when {_S} % 2 = 0 then '\"1\"' else '[\"1\",\"2\"]' end", {"rloi_id": f"case when {_S} % 2 = 0 then '1' else '1,2' end"}),
    ("dateOpened", f"case when {_S} % 3 = 0 then '\"1999-12-31\"' else '\"1999-13-31\"' end",
     {"date_opened": f"case when {_S} % 3 = 0 then '1999-12-31' end"}),
    ("datumOffset", f"case when {_S} % 4 = 0 then 'null' else '1.25' end", {"datum_offset": f"case when {_S} % 4 <> 0 then 1.25::double end"}),
    ("measures", f"concat('[{{{{\"@id\":\"m', {K}, '\",\"parameter\":\"level\",\"parameterName\":\"Water Level\",\"period\":900,\"qualifier\":\"Stage\",'"
     f", '\"unitName\":\"mASD\"}}}},{{{{\"@id\":\"n', {K}, '\",\"period\":\"x\"}}}}]')", {}),
]


@query("flood_stations_all_columns", with_grid(plain(flat(FLOOD_STATION_FIELDS, _STATION_ROWS, batch_id=_STATION_BATCH))))
def flood_stations_all_columns(spark, sf_dir):
    return dates_as_text(C.flood_stations(items(spark, sf_dir, FLOOD_STATION_FIELDS, _STATION_ROWS, _STATION_BATCH)))


_FLOOD_STATION = f"concat('{FLOOD_ROOT}/id/stations/', {K}) as station_id"


@query(
    "flood_station_measures_all_columns",
    f"""select {_FLOOD_STATION}, concat('m', {K}) as json_id, 'level' as parameter, 'Water Level' as parameter_name, 900 as period,
          'Stage' as qualifier, 'mASD' as unit_name from supplier
        union all select {_FLOOD_STATION}, concat('n', {K}), null, null, null, null, null from supplier""",
)
def flood_station_measures_all_columns(spark, sf_dir):
    return C.flood_station_measures(items(spark, sf_dir, FLOOD_STATION_FIELDS, _STATION_ROWS, _STATION_BATCH))


_PRICE = "cast(cast(p_retailprice as decimal(12, 2)) as string)"
FLOOD_MEASURE_FIELDS: list[Field] = [
    ("@id", f"concat('\"{FLOOD_ROOT}/id/measures/', {PK}, '\"')", {"json_id": f"concat('{FLOOD_ROOT}/id/measures/', {PK})"}),
    *texts(_P, label="label", parameter="parameter", parameterName="parameter_name", notation="notation", qualifier="qualifier",
           periodName="period_name", station="station", stationReference="station_reference", valueType="value_type",
           datumType="datum_type", unit="unit", unitName="unit_name"),
    *_TYPED,
    ("latestReading",
     f"case {_P} % 3 when 0 then 'null' when 1 then concat('{{{{\"@id\":\"r', {PK}, '\",\"date\":\"2024-01-02\",\"dateTime\":\"2024-01-02T03:04:05Z\",',"
     f" '\"measure\":\"m', {PK}, '\",\"value\":', {_PRICE}, '}}}}') else concat('{{{{\"@id\":\"r', {PK}, '\",\"date\":\"soon\",\"value\":\"high\"}}}}') end",
     {"latest_reading_id": f"case when {_P} % 3 <> 0 then concat('r', {PK}) end",
      "latest_reading_date": f"case when {_P} % 3 = 1 then '2024-01-02' end",
      "latest_reading_datetime": f"case when {_P} % 3 = 1 then '2024-01-02 03:04:05' end",
      "latest_reading_measure": f"case when {_P} % 3 = 1 then concat('m', {PK}) end",
      "latest_reading_value": f"case when {_P} % 3 = 1 then cast({_PRICE} as double) end"}),
]


@query(
    "flood_measures_all_columns",
    plain(flat(FLOOD_MEASURE_FIELDS, _PART_ROWS, batch_id=_PART_BATCH, timeseries_id="cast(null as varchar)")),
)
def flood_measures_all_columns(spark, sf_dir):
    return dates_as_text(C.flood_measures(items(spark, sf_dir, FLOOD_MEASURE_FIELDS, _PART_ROWS, _PART_BATCH)))


_AREA_LAT = "cast(cast(50.5 + (p_partkey % 400) * 0.01 as decimal(8, 2)) as string)"
_AREA_LONG = "cast(cast(-4.5 + (p_partkey % 500) * 0.01 as decimal(8, 2)) as string)"
AREA_FIELDS: list[Field] = [
    ("@id", f"concat('\"{FLOOD_ROOT}/id/floodAreas/', {PK}, '\"')", {"envagy_id": f"concat('{{root}}/id/floodAreas/', {PK})"}),
    *texts(_P, county="county", description="description", eaAreaName="eaareaname", eaRegionName="earegionname",
           floodWatchArea="floodwatcharea", fwdCode="fwdcode", label="label", notation="notation",
           quickDialNumber="quickdialnumber", riverOrSea="riverorsea"),
    ("lat", f"case when {_P} % 7 = 0 then 'null' else {_AREA_LAT} end", {"lat": f"case when {_P} % 7 <> 0 then cast({_AREA_LAT} as double) end"}),
    ("long", _AREA_LONG, {"long": f"cast({_AREA_LONG} as double)"}),
    ("polygon", f"concat('\"{FLOOD_ROOT}/id/floodAreas/', {PK}, '/polygon\"')", {"polygon": f"concat('{{root}}/id/floodAreas/', {PK}, '/polygon')"}),
]
# the expected texts hold a brace themselves
_AREA_FLAT = flat(AREA_FIELDS, _PART_ROWS.format(part="part"), batch_id=_PART_BATCH)


@query("flood_areas_all_columns", f"select * replace (coalesce(lat, 0) as lat) from ({with_grid(_AREA_FLAT)}) z")
def flood_areas_all_columns(spark, sf_dir):
    """All columns but the hash of the URI, which SQL has no function for."""
    return dates_as_text(C.flood_areas(items(spark, sf_dir, AREA_FIELDS, _PART_ROWS, _PART_BATCH)).drop("floodarea_id"))


# the second load has other labels, and a quarter of the stations is gone
_LATER_ROWS = "select * from {supplier} where s_suppkey % 4 <> 0"


def _later(fields: list[Field]) -> list[Field]:
    label = ("town", f"concat('\"Later ', {K}, '\"')", {"town": f"concat('Later ', {K})"})
    return [label if field[0] == "town" else field for field in fields]


@query("refresh_with_other_documents", with_grid(plain(flat(_later(STATION_FIELDS), _LATER_ROWS))))
def refresh_with_other_documents(spark, sf_dir):
    """The station table after a second load of other documents, of which nothing of the first is left."""
    target = CatalogueTables(spark, fresh_path(spark, "catalogue"))
    for fields, part in ((STATION_FIELDS, _STATION_ROWS), (_later(STATION_FIELDS), _LATER_ROWS)):
        envelopes = parse_envelopes(documents(spark, sf_dir, fields, part, _STATION_BATCH), "doc", "batch")
        target.refresh(catalogue_tables(envelopes, HYDROLOGY_STATIONS))
    return dates_as_text(target.read("station").drop("batch_id", "created"))


# --- readings -------------------------------------------------------------------

QUALITY = """
select r.*, case event_id % 4 when 0 then 'Complete' when 1 then 'NA' when 2 then '' else 'Incomplete' end as completeness,
  case event_id % 5 when 0 then null when 1 then 'null' else cast(event_id % 97 as string) end as valid,
  case event_id % 3 when 0 then '0' when 1 then '' else '2' end as invalid,
  case event_id % 6 when 0 then 'NaN' when 1 then null else '%' end as missing
from ({raw}) r
""".replace("{raw}", RAW_READINGS)
_QUALITY_COLUMNS = ("quality", "qcode", "completeness", "valid", "invalid", "missing")


@query(
    "quality_columns",
    f"select event_id, {', '.join(na(name) for name in _QUALITY_COLUMNS)} from ({plain(QUALITY)}) r",
)
def quality_columns(spark, sf_dir):
    """The six columns that are passed on as they come, without missing tokens."""
    shaped = R.shape_readings(normalise_missing(derive(spark, sf_dir, QUALITY)))
    return shaped.select("event_id", *_QUALITY_COLUMNS)


# --- stored tables --------------------------------------------------------------

# moments that are absent, or on another day than the one that the row is stored under
MOMENTS = """
select event_id as k, value as v, cast(ts as date) as r_date,
  case event_id % 5 when 0 then null when 1 then ts + interval '1' day else ts end as r_datetime
from {events}
"""
_MOMENT_SCHEMA = T.StructType([
    T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType()),
    T.StructField("r_date", T.DateType()), T.StructField("r_datetime", T.TimestampType()),
])


@query(
    "delete_range_of_moments",
    f"""select k, v, strftime(r_date, '%Y-%m-%d') as r_date, strftime(r_datetime, '%Y-%m-%d %H:%M:%S') as r_datetime
        from ({plain(MOMENTS)}) m where not (r_date between date '2024-01-05' and date '2024-01-07'
          and coalesce(r_datetime >= timestamp '2024-01-05' and r_datetime < timestamp '2024-01-08', false))""",
)
def delete_range_of_moments(spark, sf_dir):
    """Rows of the range whose moment is absent or beyond it stay."""
    target = DayTable(spark, fresh_path(spark, "moments"), _MOMENT_SCHEMA, ["k"], ["v"])
    target.append(derive(spark, sf_dir, MOMENTS))
    target.delete_between(dt.date(2024, 1, 5), dt.date(2024, 1, 7))
    return target.read().select("k", "v", F.date_format("r_date", "yyyy-MM-dd").alias("r_date"), moment_text("r_datetime"))


_CREATED = """
select event_id as k, case when event_id % {{n}} = 0 then value + 1 else value end as v, cast(ts as date) as r_date,
  cast('{{moment}}' as timestamp) as created
from {events} where event_id % 7 {{which}} 0
"""


def _created(n: int, moment: str, which: str) -> str:
    return _CREATED.replace("{{n}}", str(n)).replace("{{moment}}", moment).replace("{{which}}", which)


_FIRST, _SECOND = _created(10**9 + 7, "2024-02-01 00:00:00", "<>"), _created(3, "2024-03-01 00:00:00", ">=")


@query(
    "created_moments",
    f"""select n.k, n.v, strftime(coalesce(o.created, n.created), '%Y-%m-%d %H:%M:%S') as created
        from ({plain(_SECOND)}) n left join ({plain(_FIRST)}) o on o.k = n.k""",
)
def created_moments(spark, sf_dir):
    """A row keeps the moment at which it was first stored, also when it is updated."""
    schema = T.StructType(_MOMENT_SCHEMA.fields[:3])
    target = DayTable(spark, fresh_path(spark, "created"), schema, ["k"], ["v"], moment=None, created_column="created")
    target.append(derive(spark, sf_dir, _FIRST))
    target.upsert(derive(spark, sf_dir, _SECOND), [F.col("v")])
    return target.read().select("k", "v", moment_text("created"))


# --- binary geometries ----------------------------------------------------------


def double_hex(x: str) -> str:
    """SQL for the sixteen hexadecimal digits of a double, lowest byte first."""
    power = f"cast(floor(log2(abs({x}))) as integer)"
    # a logarithm next to a power of two may be off by one
    exact = f"({power} + case when abs({x}) >= pow(2::double, {power} + 1) then 1 when abs({x}) < pow(2::double, {power}) then -1 else 0 end)"
    fraction = f"cast((abs({x}) / pow(2::double, {exact}) - 1) * 4503599627370496::double as bigint)"
    bits = f"(({exact} + 1023)::bigint * 4503599627370496::bigint + {fraction})"
    number = f"(case when {x} < 0 then 9223372036854775808::uhugeint else 0::uhugeint end + {bits}::uhugeint)"
    digits = f"lpad(to_hex({number}), 16, '0')"
    ordered = " || ".join(f"substr({digits}, {place}, 2)" for place in range(15, 0, -2))
    return f"case when {x} = 0 then '0000000000000000' else {ordered} end"


@query(
    "point_wkb_bytes",
    f"select notation, '0101000020E6100000' || {double_hex('long')} || {double_hex('lat')} as wgs84 from ({plain(STATIONS)}) s",
)
def point_wkb_bytes(spark, sf_dir):
    """All bytes of points in degrees."""
    located = G.with_points(derive(spark, sf_dir, STATIONS))
    return located.select("notation", F.hex(point_wkb(F.col("geom4326"))).alias("wgs84"))


def _decoded(binary, place: int):
    # an eight-byte number from its bits, lowest byte first; exact for normal numbers
    digits = F.concat(*[F.substring(F.hex(F.substring(binary, place + k, 1)), 1, 2) for k in range(7, -1, -1)])
    top = F.conv(F.substring(digits, 1, 3), 16, 10).cast("int")
    fraction = F.conv(F.substring(digits, 4, 13), 16, 10).cast("double") / F.lit(float(2**52))
    return F.when(top >= 2048, -1.0).otherwise(1.0) * (1 + fraction) * F.pow(F.lit(2.0), (top % 2048) - 1023)


@query(
    "point_wkb_grid",
    f"""select notation, round(e, 3) as x, round(n, 3) as y
        from ({bng_sql('select notation, lat, long as lon from (' + plain(STATIONS) + ') s')}) p""",
)
def point_wkb_grid(spark, sf_dir):
    """Grid points read back from their bytes."""
    located = G.with_points(derive(spark, sf_dir, STATIONS))
    binary = located.select("notation", point_wkb(F.col("geom27700")).alias("b"))
    return binary.select("notation", F.round(_decoded(F.col("b"), 10), 3).alias("x"), F.round(_decoded(F.col("b"), 18), 3).alias("y"))


_BOX_VERTICES = f"""
select floodarea_id, ring, sign, case when kind = 0 and floodarea_id % 2 = 1 then 4 - seq else seq end as seq,
  cast(cast(x + fx * w as decimal(12, 6)) as double) as lon, cast(cast(y + fy * h as decimal(12, 6)) as double) as lat
from (select r.*, p_partkey % 3 as kind from ({_RINGS}) r join part on p_partkey = floodarea_id) r
cross join (values (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) as v(seq, fx, fy)
"""
_POLYGON_START = "0103000000"


@query(
    "polygon_wkb_bytes",
    f"""with ring as (
          select floodarea_id, ring, sign, '05000000' || string_agg({double_hex('lon')} || {double_hex('lat')}, '' order by seq) as body
          from ({_BOX_VERTICES}) v group by all)
        select p_partkey as floodarea_id, case when a.body is not null then '0106000020E6100000'
          || case when b.sign = 1 then '02000000{_POLYGON_START}01000000' || a.body || '{_POLYGON_START}01000000' || b.body
                  when b.sign = -1 then '01000000{_POLYGON_START}02000000' || a.body || b.body
                  else '01000000{_POLYGON_START}01000000' || a.body end end as wgs84
        from part left join ring a on a.floodarea_id = p_partkey and a.ring = 0
          left join ring b on b.floodarea_id = p_partkey and b.ring = 1""",
)
def polygon_wkb_bytes(spark, sf_dir):
    """All bytes of polygons in degrees; areas without a polygon have none."""
    shapes = polygons(spark, sf_dir).select("floodarea_id", geojson_multipolygon(F.col("polygon_json")).alias("g"))
    return shapes.select("floodarea_id", F.hex(multipolygon_wkb(F.col("g"), 4326)).alias("wgs84"))
