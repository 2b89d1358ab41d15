"""Queries on catalogue documents, built as JSON text from the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import jsontext as J
from ..functions.constants import FLOOD_ROOT, HYDROLOGY_ROOT, STATION_PREFIX
from ..functions.values import integer_or_zero, meta_version, number_or_null, number_or_zero
from ..operators import catalogue as C
from ..plans.catalogues import HYDROLOGY_STATIONS, catalogue_tables
from ..session import fresh_path
from ..sinks.catalogue_tables import CatalogueTables
from ..sources.envelopes import envelope_items, envelope_meta, item_counts, parse_envelopes
from .inputs import AREAS, derive, plain
from .registry import ORACLES, query


def json_sql(template: str, **expressions: str) -> str:
    """SQL for a JSON text in which ``<name>`` stands for an expression."""
    pieces = re.split(r"<(\w+)>", template)
    literals = ["'" + piece.replace("{", "{{").replace("}", "}}") + "'" for piece in pieces[::2]]
    mixed = [literals[0]]
    for name, literal in zip(pieces[1::2], literals[1:]):
        mixed += [expressions[name], literal]
    return f"concat({', '.join(mixed)})"


def literal(text: str) -> str:
    return json_sql(text)


def document(batch: str, items: str, rows: str) -> str:
    """SQL for ``batch, doc`` rows: one envelope around the items of a row."""
    envelope = json_sql(
        '{"@context":"http://context/<b>","meta":{"@id":"meta-<b>","publisher":"Agency","<lic>":"http://licence/",'
        '"documentation":"http://doc/","version":"<version>","comment":"status: beta","hasFormat":["csv","rdf"]},'
        '"items":[<items>]}',
        b=f"cast({batch} as string)",
        lic=f"case when {batch} % 2 = 0 then 'license' else 'licence' end",
        version=f"case when {batch} % 5 = 0 then 'one' else '0.9' end",
        items=items,
    )
    return f"select {batch} as batch, {envelope} as doc from ({rows}) rows"


K = "cast(s_suppkey as string)"
PK = "cast(p_partkey as string)"
STATION_LAT = "cast(cast(50.5 + (s_suppkey % 40) * 0.1 as decimal(8, 2)) as string)"
STATION_LONG = "cast(cast(-4.5 + (s_suppkey % 50) * 0.1 as decimal(8, 2)) as string)"

STATION_ITEM = json_sql(
    '{"@id":"<prefix><k>","label":"<label>","notation":"N<k>","easting":<k>,"northing":<k>.5,"lat":<lat>,"long":<long>,'
    '"catchmentName":"C<k>","town":"T<k>"<rloi>,"rloiStationLink":<link>,"catchmentArea":<area>,"dateOpened":"<opened>",'
    '"datum":"<k>","boreholeDepth":"","dataQualityStatement":<quality>,"sampleOf":<sample>,<types>'
    '"observedProperty":[{"@id":"prop-<k>"}],"status":[{"@id":"s1","label":{"@id":"lab-<k>"}},{"@id":"s2","label":"plain"}],'
    '"measures":[{"@id":"m1-<k>","parameter":"flow","period":900,"valueStatistic":{"@id":"vs-<k>"}},'
    '{"@id":"m2-<k>","parameter":"level","valueStatistic":"max"}],"colocatedStation":[{"@id":"<prefix>c<k>"}]},'
    '{"@id":"<prefix>bare<k>"}',
    prefix=f"'{STATION_PREFIX}'",
    k=K,
    label="s_name",
    lat=f"case when s_suppkey % 7 = 0 then 'null' else {STATION_LAT} end",
    long=STATION_LONG,
    rloi="case s_suppkey % 3 when 0 then "
    + json_sql(',"RLOIid":"R<k>"', k=K)
    + " when 1 then "
    + json_sql(',"RLOIid":["R<k>","S<k>"]', k=K)
    + " else '' end",
    link="case s_suppkey % 3 when 0 then "
    + json_sql('{"@id":"http://link/<k>"}', k=K)
    + " when 1 then "
    + json_sql('[{"@id":"http://link/<k>"},{"label":"no id"},{"@id":"http://link/b"}]', k=K)
    + " else '[]' end",
    area="case s_suppkey % 3 when 0 then '12.5' when 1 then '\"\"' else 'null' end",
    opened="case when s_suppkey % 5 = 0 then '2001-02' else '2001-2-3' end",
    quality="case when s_suppkey % 2 = 0 then " + json_sql('{"@id":"q-<k>"}', k=K) + " else '\"good\"' end",
    sample="case when s_suppkey % 2 = 1 then " + json_sql('{"@id":"sa-<k>","label":"Sample <k>"}', k=K) + " else '\"none\"' end",
    types="case when s_suppkey % 6 = 0 then '' else " + literal('"type":[{"@id":"t1"},{"@id":"t2"}],') + " end",
)
STATION_DOCS = document("s_nationkey", STATION_ITEM, "select * from {supplier}")


def _envelopes(spark, sf_dir, text: str) -> DataFrame:
    return parse_envelopes(derive(spark, sf_dir, text), "doc", "batch")


def _items(spark, sf_dir, text: str) -> DataFrame:
    return envelope_items(_envelopes(spark, sf_dir, text))


def date_text(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


STATION_FLAT = f"""
select s_nationkey as batch_id, concat('{STATION_PREFIX}', {K}) as json_id, s_name as label, concat('N', {K}) as notation,
  cast(s_suppkey as double) as easting, cast(s_suppkey as double) + 0.5 as northing,
  case when s_suppkey % 7 <> 0 then cast({STATION_LAT} as double) end as lat, cast({STATION_LONG} as double) as long,
  concat('C', {K}) as catchment_name, concat('T', {K}) as town,
  case s_suppkey % 3 when 0 then concat('R', {K}) when 1 then concat('R', {K}, ',S', {K}) end as rloi_id,
  case s_suppkey % 3 when 0 then concat('http://link/', {K}) when 1 then concat('http://link/', {K}, ',,http://link/b') end as rloi_station_link,
  case when s_suppkey % 3 = 0 then 12.5::double else 0.0::double end as catchment_area,
  case when s_suppkey % 5 <> 0 then '2001-02-03' end as date_opened, cast(s_suppkey as integer) as datum, 0.0::double as borehole_depth,
  case when s_suppkey % 2 = 0 then concat('q-', {K}) end as data_quality_statement,
  case when s_suppkey % 2 = 1 then concat('sa-', {K}) end as sample_of_id,
  case when s_suppkey % 2 = 1 then concat('Sample ', {K}) end as sample_of_label,
  s_suppkey % 7 <> 0 as has_point
from supplier
union all select s_nationkey, concat('{STATION_PREFIX}bare', {K}), null, null, null, null, null, null, null, null, null, null, 0.0::double, null,
  0, 0.0::double, null, null, null, false from supplier
"""


@query("json_envelope_stations", STATION_FLAT)
def json_envelope_stations(spark, sf_dir):
    return _station_rows(C.hydrology_stations(_items(spark, sf_dir, STATION_DOCS)))


def _station_rows(stations: DataFrame) -> DataFrame:
    return stations.select(
        "batch_id", "json_id", "label", "notation", "easting", "northing", "lat", "long", "catchment_name", "town",
        "rloi_id", "rloi_station_link", "catchment_area", date_text("date_opened"), "datum", "borehole_depth",
        "data_quality_statement", "sample_of_id", "sample_of_label",
        (F.col("geom4326").isNotNull() & F.col("geom27700").isNotNull()).alias("has_point"),
    )


_SID = f"concat('{STATION_PREFIX}', {K}) as station_id"


@query(
    "station_children",
    f"""select {_SID}, 'type' as kind, unnest(['t1', 't2']) as child, cast(null as varchar) as detail from supplier where s_suppkey % 6 <> 0
        union all select {_SID}, 'property', concat('prop-', {K}), null from supplier
        union all select {_SID}, 'status', 's1', concat('lab-', {K}) from supplier
        union all select {_SID}, 'status', 's2', 'plain' from supplier
        union all select {_SID}, 'measure', concat('m1-', {K}), concat('flow 900 vs-', {K}) from supplier
        union all select {_SID}, 'measure', concat('m2-', {K}), 'level' from supplier
        union all select {_SID}, 'colocated', concat('{STATION_PREFIX}c', {K}), null from supplier""",
)
def station_children(spark, sf_dir):
    items = _items(spark, sf_dir, STATION_DOCS)
    return _child_rows(C.station_types(items), C.station_properties(items), C.station_statuses(items), C.station_measures(items),
                       C.station_colocations(items))


def _child_rows(types, properties, statuses, measures, colocations) -> DataFrame:
    none = F.lit(None).cast("string").alias("detail")

    def part(rows, kind, child, detail=none):
        return rows.select("station_id", F.lit(kind).alias("kind"), F.col(child).alias("child"), detail)

    measured = F.concat_ws(" ", "parameter", "period", "value_statistic_id").alias("detail")
    return (
        part(types, "type", "type_id")
        .unionByName(part(properties, "property", "property_id"))
        .unionByName(part(statuses, "status", "status_id", F.col("status_label_id").alias("detail")))
        .unionByName(part(measures, "measure", "measure_id", measured))
        .unionByName(part(colocations, "colocated", "colocated_id"))
    )


@query(
    "envelope_meta",
    """select s_nationkey as batch_id, concat('http://context/', cast(s_nationkey as string)) as context,
         concat('meta-', cast(s_nationkey as string)) as json_id, 'Agency' as publisher, 'http://licence/' as license,
         cast(case when s_nationkey % 5 <> 0 then 0.9 end as double) as version, 'csv,rdf' as formats
       from supplier""",
)
def envelope_meta_rows(spark, sf_dir):
    return _meta_rows(envelope_meta(_envelopes(spark, sf_dir, STATION_DOCS)))


def _meta_rows(meta: DataFrame) -> DataFrame:
    return meta.select(
        "batch_id", "context", "json_id", "publisher", "license",
        meta_version(F.col("version")).cast("double").alias("version"),
        F.array_join("has_format", ",").alias("formats"),
    )


@query(
    "item_counts",
    "select s_nationkey as batch_id, 2 * count(*) as n_items, 2 * count(*) as n_loaded from supplier group by s_nationkey",
)
def item_counts_rows(spark, sf_dir):
    envelopes = _envelopes(spark, sf_dir, STATION_DOCS)
    return item_counts(envelopes, C.hydrology_stations(envelope_items(envelopes)))


@query(
    "raw_documents",
    f"""select s_nationkey as batch_id, concat('{STATION_PREFIX}', x, {K}) as json_id
        from supplier cross join (values (''), ('bare')) as v(x)""",
)
def raw_documents(spark, sf_dir):
    return C.raw_documents(_items(spark, sf_dir, STATION_DOCS)).select("batch_id", "json_id")


@query(
    "full_refresh",
    """select 'station' as name, 2 * count(*) as n_rows from supplier
       union all select 'station_type', 2 * count(*) from supplier where s_suppkey % 6 <> 0
       union all select 'station_observed_property', count(*) from supplier
       union all select 'station_status', 2 * count(*) from supplier
       union all select 'station_measure', 2 * count(*) from supplier
       union all select 'station_colocated', count(*) from supplier
       union all select 'meta', count(*) from supplier
       union all select 'document', 2 * count(*) from supplier""",
)
def full_refresh(spark, sf_dir):
    target = CatalogueTables(spark, fresh_path(spark, "catalogue"))
    envelopes = _envelopes(spark, sf_dir, STATION_DOCS)
    names = ["meta", "document", *HYDROLOGY_STATIONS]
    # two loads: the second one replaces the first
    for _ in range(2):
        target.refresh(catalogue_tables(envelopes, HYDROLOGY_STATIONS))
    counts = [target.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name in names]
    united = counts[0]
    for count in counts[1:]:
        united = united.unionByName(count)
    return united


_BARE = f"concat('{{\"@id\":\"{STATION_PREFIX}bare', {K}, '\"}}')"
# items are stored as parsed: numbers in their shortest form
_STORED_ITEM = STATION_ITEM
for _number in (STATION_LAT, STATION_LONG):
    _STORED_ITEM = _STORED_ITEM.replace(_number, f"cast(cast({_number} as double) as string)")
DOCUMENT_TEXTS = f"""
select s_nationkey as batch_id, concat('{STATION_PREFIX}', {K}) as json_id,
  left(items, length(items) - length({_BARE}) - 1) as document
from (select *, {plain(_STORED_ITEM)} as items from supplier) s
union all select s_nationkey, concat('{STATION_PREFIX}bare', {K}), {_BARE} from supplier
"""


@query("raw_documents_text", DOCUMENT_TEXTS)
def raw_documents_text(spark, sf_dir):
    return C.raw_documents(_items(spark, sf_dir, STATION_DOCS))


def _refreshed(spark, sf_dir) -> CatalogueTables:
    # two loads: the second one replaces the first
    target = CatalogueTables(spark, fresh_path(spark, "catalogue"))
    envelopes = _envelopes(spark, sf_dir, STATION_DOCS)
    for _ in range(2):
        target.refresh(catalogue_tables(envelopes, HYDROLOGY_STATIONS))
    return target


@query("full_refresh_stations", STATION_FLAT)
def full_refresh_stations(spark, sf_dir):
    return _station_rows(_refreshed(spark, sf_dir).read("station"))


@query("full_refresh_children", ORACLES["station_children"])
def full_refresh_children(spark, sf_dir):
    target = _refreshed(spark, sf_dir)
    return _child_rows(*(target.read(f"station_{name}") for name in ("type", "observed_property", "status", "measure", "colocated")))


@query("full_refresh_meta", ORACLES["envelope_meta"])
def full_refresh_meta(spark, sf_dir):
    return _meta_rows(_refreshed(spark, sf_dir).read("meta"))


@query("full_refresh_documents", DOCUMENT_TEXTS)
def full_refresh_documents(spark, sf_dir):
    return _refreshed(spark, sf_dir).read("document").select("batch_id", "json_id", "document")


MEASURE_ITEM = json_sql(
    '{"@id":"<root>/id/measures/M<k>","label":"<label>","parameter":"flow","parameterName":"Flow","notation":"M<k>",'
    '"period":<size>,"hasTelemetry":<flag>,"unit":{"@id":"u-<k>"},"unitName":"m3/s"<vs>,'
    '"observedProperty":{"@id":"op-<k>","label":"Flow"}<station>}',
    root=f"'{HYDROLOGY_ROOT}'",
    k=PK,
    label="p_name",
    size="cast(p_size as string)",
    flag="case when p_size % 2 = 0 then 'true' else 'false' end",
    vs="case when p_partkey % 3 = 0 then '' else " + json_sql(',"valueStatistic":{"@id":"vs-<k>","label":"max"}', k=PK) + " end",
    station="case p_partkey % 3 when 0 then "
    + json_sql(',"station":{"@id":"<p>S<k>","label":"St","wiskiID":"W<k>","RLOIid":["1","2"]}', p=f"'{STATION_PREFIX}'", k=PK)
    + " when 1 then "
    + json_sql(',"station":{"@id":"<p>S<k>","RLOIid":"7"}', p=f"'{STATION_PREFIX}'", k=PK)
    + " else '' end",
)
MEASURE_DOCS = document("p_size", MEASURE_ITEM, "select * from {part}")


@query(
    "json_envelope_measures",
    f"""select concat('{HYDROLOGY_ROOT}/id/measures/M', {PK}) as json_id, p_name as label, concat('M', {PK}) as notation,
          p_size as period, p_size % 2 = 0 as has_telemetry, concat('u-', {PK}) as unit,
          case when p_partkey % 3 <> 0 then concat('vs-', {PK}) end as value_statistic_id,
          case when p_partkey % 3 <> 0 then 'max' end as value_statistic_label, cast(null as varchar) as observation_type_id,
          concat('op-', {PK}) as observed_property_id,
          case when p_partkey % 3 <> 2 then concat('{STATION_PREFIX}S', {PK}) end as station_id,
          case when p_partkey % 3 <> 2 then concat('S', {PK}) end as station_id_label,
          case when p_partkey % 3 = 0 then concat('W', {PK}) end as station_wiski_id,
          case p_partkey % 3 when 0 then '1,2' when 1 then '7' end as station_rloi_id
        from part""",
)
def json_envelope_measures(spark, sf_dir):
    return C.hydrology_measures(_items(spark, sf_dir, MEASURE_DOCS)).select(
        "json_id", "label", "notation", "period", "has_telemetry", "unit", "value_statistic_id", "value_statistic_label",
        "observation_type_id", "observed_property_id", "station_id", "station_id_label", "station_wiski_id", "station_rloi_id",
    )


FLD_STATION_ITEM = json_sql(
    '{"@id":"<root>/id/stations/<k>","label":"<label>","notation":"<k>","easting":<east>,"northing":"<k>","lat":<lat>,"long":<long>,'
    '"RLOIid":<rloi>,"dateOpened":"1999-12-31","stageScale":"sc","status":"st","datumOffset":<offset>,'
    '"measures":[{"@id":"m-<k>","parameter":"level","parameterName":"Water Level","period":900,"qualifier":"Stage","unitName":"mASD"}]}',
    root=f"'{FLOOD_ROOT}'",
    k=K,
    label="s_name",
    east="case s_suppkey % 4 when 0 then " + K + " when 1 then concat('[\"', " + K + ", '\",\"9\"]') when 2 then '[null,\"\",5.5]' else '[]' end",
    lat=f"case when s_suppkey % 3 = 0 then concat('[', {STATION_LAT}, ',1]') else {STATION_LAT} end",
    long=f"case when s_suppkey % 5 = 0 then '\"west\"' else concat('\"', {STATION_LONG}, '\"') end",
    rloi="case when s_suppkey % 2 = 0 then '\"1\"' else '[\"1\",\"2\"]' end",
    offset="case when s_suppkey % 2 = 0 then 'null' else '1.25' end",
)
FLD_STATION_DOCS = document("s_nationkey", FLD_STATION_ITEM, "select * from {supplier}")


@query(
    "flood_stations",
    f"""select concat('{FLOOD_ROOT}/id/stations/', {K}) as json_id, s_name as label,
          case s_suppkey % 4 when 0 then cast(s_suppkey as double) when 1 then cast(s_suppkey as double) when 2 then 5.5::double end as easting,
          cast(s_suppkey as double) as northing, cast({STATION_LAT} as double) as lat,
          case when s_suppkey % 5 <> 0 then cast({STATION_LONG} as double) end as long,
          case when s_suppkey % 2 = 0 then '1' else '1,2' end as rloi_id, '1999-12-31' as date_opened,
          case when s_suppkey % 2 <> 0 then 1.25::double end as datum_offset, s_suppkey % 5 <> 0 as has_point,
          concat('m-', {K}) as measure_id, 900 as period, 'Stage' as qualifier
        from supplier""",
)
def flood_stations(spark, sf_dir):
    items = _items(spark, sf_dir, FLD_STATION_DOCS)
    measures = C.flood_station_measures(items).select(
        F.col("station_id").alias("json_id"), F.col("json_id").alias("measure_id"), "period", "qualifier"
    )
    stations = C.flood_stations(items).select(
        "json_id", "label", "easting", "northing", "lat", "long", "rloi_id", date_text("date_opened"), "datum_offset",
        F.col("geom27700").isNotNull().alias("has_point"),
    )
    return stations.join(measures, "json_id")


FLD_MEASURE_ITEM = json_sql(
    '{"@id":"<root>/id/measures/<k>","label":"<label>","notation":"<k>","period":<size>,"hasTelemetry":true,'
    '"station":"<root>/id/stations/<k>","unit":"u","unitName":"m"<latest>}',
    root=f"'{FLOOD_ROOT}'",
    k=PK,
    label="p_name",
    size="cast(p_size as string)",
    latest="case p_partkey % 3 when 0 then '' when 1 then "
    + json_sql(',"latestReading":{"@id":"r-<k>","date":"2024-01-02","dateTime":"2024-01-02T03:04:05Z","measure":"m","value":<v>}',
               k=PK, v="cast(cast(p_retailprice as decimal(12, 2)) as string)")
    + " else " + json_sql(',"latestReading":{"@id":"r-<k>","date":"soon","dateTime":"later"}', k=PK) + " end",
)
FLD_MEASURE_DOCS = document("p_size", FLD_MEASURE_ITEM, "select * from {part}")


@query(
    "flood_measures",
    f"""select concat('{FLOOD_ROOT}/id/measures/', {PK}) as json_id, p_name as label, p_size as period, true as has_telemetry,
          concat('{FLOOD_ROOT}/id/stations/', {PK}) as station, cast(null as varchar) as timeseries_id,
          case when p_partkey % 3 <> 0 then concat('r-', {PK}) end as latest_reading_id,
          case when p_partkey % 3 = 1 then '2024-01-02' end as latest_reading_date,
          case when p_partkey % 3 = 1 then '2024-01-02 03:04:05' end as latest_reading_datetime,
          case when p_partkey % 3 = 1 then cast(cast(p_retailprice as decimal(12, 2)) as double) end as latest_reading_value
        from part""",
)
def flood_measures(spark, sf_dir):
    return C.flood_measures(_items(spark, sf_dir, FLD_MEASURE_DOCS)).select(
        "json_id", "label", "period", "has_telemetry", "station", "timeseries_id", "latest_reading_id",
        date_text("latest_reading_date"),
        F.date_format("latest_reading_datetime", "yyyy-MM-dd HH:mm:ss").alias("latest_reading_datetime"),
        "latest_reading_value",
    )


AREA_ITEM = json_sql(
    '{"@id":"<root>/id/floodAreas/<code>","county":<county>,"description":"<description>","eaAreaName":"<area>","fwdCode":"<code>",'
    '"label":"<label>","lat":<lat>,"long":<long>,"notation":"<code>"<polygon>,"quickDialNumber":"1","riverOrSea":"<river>"}',
    root=f"'{FLOOD_ROOT}'",
    code="fwdcode",
    county="case when county is null then 'null' else concat('\"', county, '\"') end",
    description="description",
    area="eaareaname",
    label="label",
    lat="case when floodarea_id % 7 = 0 then 'null' else cast(cast(lat as decimal(8, 2)) as string) end",
    long="cast(cast(long as decimal(8, 2)) as string)",
    polygon="case when floodarea_id % 4 = 0 then '' else "
    + json_sql(',"polygon":"<root>/id/floodAreas/<code>/polygon"', root=f"'{FLOOD_ROOT}'", code="fwdcode") + " end",
    river="riverorsea",
)
AREA_DOCS = document("floodarea_id", AREA_ITEM, AREAS)


@query(
    "json_envelope_areas",
    f"""select concat('{{root}}/id/floodAreas/', fwdcode) as envagy_id, county, description, eaareaname, fwdcode, label,
          case when floodarea_id % 7 = 0 then 0.0::double else lat end as lat, long,
          case when floodarea_id % 4 = 0 then '' else concat('{{root}}/id/floodAreas/', fwdcode, '/polygon') end as polygon,
          riverorsea, floodarea_id % 7 <> 0 as has_point
        from ({plain(AREAS)}) a""",
)
def json_envelope_areas(spark, sf_dir):
    return C.flood_areas(_items(spark, sf_dir, AREA_DOCS)).select(
        "envagy_id", "county", "description", "eaareaname", "fwdcode", "label", "lat", "long", "polygon", "riverorsea",
        F.col("geom27700").isNotNull().alias("has_point"),
    )


# every shape a field can take
SHAPES = f"""
select p_partkey, case p_partkey % 7
    when 0 then {json_sql('["<n>","b"]', n='p_name')} when 1 then p_name when 2 then {json_sql('{"@id":"<n>","label":"L"}', n='p_name')}
    when 3 then {literal('[{"@id":"x"},{"label":"none"}]')} when 4 then '[null,"",4.5]' when 5 then '[]' else null end as j
from {{part}}
"""


@query(
    "list_or_scalar_json",
    f"""select p_partkey,
          case p_partkey % 7 when 0 then concat(p_name, ',b') when 1 then p_name when 4 then ',4.5' when 5 then '' end as joined,
          case p_partkey % 7 when 2 then p_name when 3 then 'x,' end as links,
          case p_partkey % 7 when 0 then p_name when 1 then p_name when 4 then '4.5' end as first_value,
          case p_partkey % 7 when 4 then 4.5::double end as first_number,
          case p_partkey % 7 when 2 then 'L' end as label,
          case p_partkey % 7 when 1 then p_name when 2 then p_name end as id_or_text,
          p_partkey % 7 not in (1, 6) as accepted
        from part""",
)
def list_or_scalar_json(spark, sf_dir):
    rows = derive(spark, sf_dir, SHAPES)
    j, kind = F.col("j"), F.col("p_partkey") % 7
    return rows.select(
        "p_partkey",
        F.when(kind.isin(0, 1, 4, 5), J.list_or_text(j)).alias("joined"),
        F.when(kind.isin(2, 3, 5), J.link_ids(j)).alias("links"),
        F.when(kind.isin(0, 1, 4, 5), J.first_text(j)).alias("first_value"),
        F.when(kind.isin(0, 1, 4, 5), J.first_number(j)).alias("first_number"),
        J.member(j, "label").alias("label"),
        F.when(kind.isin(1, 2), J.id_or_text(j)).alias("id_or_text"),
        J.accepted_geojson(j).isNotNull().alias("accepted"),
    )


_OBJECT = f"concat('{{\"@id\":\"', p_name, '\",\"label\":\"L\"}}')"


@query(
    "list_or_scalar_json_all_shapes",
    f"""select p_partkey,
          case p_partkey % 7 when 0 then concat(p_name, ',b') when 1 then p_name when 2 then {_OBJECT}
            when 3 then '{{"@id":"x"}},{{"label":"none"}}' when 4 then ',4.5' when 5 then '' end as joined,
          case p_partkey % 7 when 2 then p_name when 3 then 'x,' end as links,
          case p_partkey % 7 when 0 then p_name when 1 then p_name when 2 then {_OBJECT} when 3 then '{{"@id":"x"}}' when 4 then '4.5' end
            as first_value,
          case p_partkey % 7 when 4 then 4.5::double end as first_number,
          case p_partkey % 7 when 2 then 'L' end as label,
          case p_partkey % 7 when 1 then p_name when 2 then p_name end as id_or_text,
          p_partkey % 7 not in (1, 6) as accepted
        from part""",
)
def list_or_scalar_json_all_shapes(spark, sf_dir):
    j = F.col("j")
    return derive(spark, sf_dir, SHAPES).select(
        "p_partkey", J.list_or_text(j).alias("joined"), J.link_ids(j).alias("links"), J.first_text(j).alias("first_value"),
        J.first_number(j).alias("first_number"), J.member(j, "label").alias("label"), J.id_or_text(j).alias("id_or_text"),
        J.accepted_geojson(j).isNotNull().alias("accepted"),
    )


NUMBERS = """
select p_partkey, case p_partkey % 5 when 0 then null when 1 then '' when 2 then cast(cast(p_retailprice as decimal(12, 2)) as string)
    when 3 then cast(p_size as string) else p_name end as t
from {part}
"""


@query(
    "zero_defaults",
    f"""select p_partkey, coalesce(try_cast(t as double), 0) as zero_default, coalesce(cast(trunc(try_cast(t as double)) as integer), 0) as zero_integer,
          try_cast(t as double) as nullable from ({plain(NUMBERS)}) n""",
)
def zero_defaults(spark, sf_dir):
    t = F.col("t")
    return derive(spark, sf_dir, NUMBERS).select(
        "p_partkey",
        number_or_zero(t).alias("zero_default"),
        integer_or_zero(t).alias("zero_integer"),
        number_or_null(t).alias("nullable"),
    )
