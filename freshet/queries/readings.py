"""Queries on single readings: cleaning, parsing, codes, labels, files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions import codes
from ..functions.constants import FLOOD_ROOT, STATION_PREFIX
from ..functions.notation import root_templated
from ..functions.values import normalise_missing, period_seconds, stored_value
from ..operators import readings as R, relations, summaries
from ..operators.filters import between_moments, filter_readings, in_viewport
from ..session import fresh_path
from ..sinks.curve_files import write_by_curve
from ..sources import reading_files
from .inputs import GUID_TAIL, RAW_READINGS, STATIONS, derive, land_readings, plain
from .registry import query
from .sqltext import CELLS, SHAPED, notation_columns, value_columns


def cells(spark, sf_dir) -> DataFrame:
    """Raw cells with missing texts as null."""
    return normalise_missing(derive(spark, sf_dir, RAW_READINGS))


def shaped(spark, sf_dir) -> DataFrame:
    """Shaped readings, with the event number that made them."""
    return R.shape_readings(cells(spark, sf_dir))


def day_text(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def moment_text(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(
    "value_status_histogram",
    f"""select source, status as value_status, count(*) as n_rows
        from ({value_columns('value', CELLS, 'source')}) v group by all""",
)
def value_status_histogram(spark, sf_dir):
    return summaries.status_histogram(shaped(spark, sf_dir), "source")


@query(
    "clean_value",
    f"""select event_id, status as value_status, coalesce(isinf(f), false) as infinite,
          case when not isinf(f) then f end as number,
          cast(case when not isinf(f) then cast(f as decimal(15, 3)) end as double) as stored
        from ({value_columns('value', CELLS, 'event_id')}) v""",
)
def clean_value(spark, sf_dir):
    rows = R.with_value(cells(spark, sf_dir).select("event_id", "value"), "value", "read", "value_status")
    number = F.col("read")
    infinite = F.coalesce(F.abs(number) == float("inf"), F.lit(False))
    return rows.select(
        "event_id",
        "value_status",
        infinite.alias("infinite"),
        F.when(~infinite, number).alias("number"),
        stored_value(number).cast("double").alias("stored"),
    )


@query(
    "parse_notation",
    f"select * exclude (measure) from ({notation_columns(f'select event_id, measure from ({CELLS}) c')}) n",
)
def parse_notation(spark, sf_dir):
    return R.with_notation(cells(spark, sf_dir).select("event_id", "measure"), "measure").drop("measure")


@query(
    "period_coerce",
    f"""select event_id, coalesce(cast(trunc(try_cast(period as double)) as integer), 0) as period_seconds
        from ({CELLS}) c""",
)
def period_coerce(spark, sf_dir):
    return cells(spark, sf_dir).select("event_id", period_seconds(F.col("period")).alias("period_seconds"))


@query(
    "reading_times",
    f"""select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as r_datetime,
          strftime(date_trunc('month', ts), '%Y-%m-%d') as r_month, strftime(ts, '%Y-%m-%d') as r_date,
          strftime(try_cast(date as date), '%Y-%m-%d') as source_date
        from (select *, try_cast(dateTime as timestamp) as ts from ({CELLS}) c) t""",
)
def reading_times(spark, sf_dir):
    return shaped(spark, sf_dir).select(
        "event_id",
        moment_text("r_datetime"),
        day_text("r_month"),
        day_text("r_date"),
        day_text("source_date"),
    )


SHAPED_COLUMNS = """event_id, source, strftime(r_datetime, '%Y-%m-%d %H:%M:%S') as r_datetime,
  strftime(r_month, '%Y-%m-%d') as r_month, strftime(r_date, '%Y-%m-%d') as r_date,
  strftime(source_date, '%Y-%m-%d') as source_date, measure, notation, station_id, parameter, qualifier,
  value_type, period_name, period, unit_name, observation_type, cast(value as double) as value, value_status,
  quality, qcode, label"""


@query("labelled_readings", f"select {SHAPED_COLUMNS} from ({SHAPED}) s")
def labelled_readings(spark, sf_dir):
    labelled = R.with_station_label(shaped(spark, sf_dir), derive(spark, sf_dir, STATIONS))
    return labelled.select(
        "event_id",
        "source",
        moment_text("r_datetime"),
        day_text("r_month"),
        day_text("r_date"),
        day_text("source_date"),
        "measure",
        "notation",
        "station_id",
        "parameter",
        "qualifier",
        "value_type",
        "period_name",
        "period",
        "unit_name",
        "observation_type",
        F.col("value").cast("double").alias("value"),
        "value_status",
        "quality",
        "qcode",
        "label",
    )


@query(
    "quarantine",
    f"""select event_id, measure, case when notation is null and r_datetime is null then 'no measure and no timestamp'
          when notation is null then 'no measure' else 'no timestamp' end as reason
        from ({SHAPED}) s where notation is null or r_datetime is null""",
)
def quarantine(spark, sf_dir):
    return R.quarantined(shaped(spark, sf_dir)).select("event_id", "measure", "reason")


# codes of every map, with unknown ones, and field names in mixed case
CODED = """
select event_id,
  case event_id % 5 when 0 then ' DatumType ' when 1 then 'period' when 2 then 'VALUETYPE'
    when 3 then 'qualifier' else 'colour' end as field,
  case event_id % 5
    when 0 then case user_id % 4 when 0 then 'mAOD' when 1 then 'mASD' when 2 then 'mBDAT' else event_type end
    when 1 then case user_id % 6 when 0 then '5_min' when 1 then '15_min' when 2 then '30_min' when 3 then '1_h'
      when 4 then 'Unspecified' else event_type end
    when 2 then case user_id % 8 when 0 then 'i' when 1 then 't' when 2 then 'max' when 3 then 'min' when 4 then 'Mean'
      when 5 then 'Event' when 6 then 'Cumulative_Total' else event_type end
    when 3 then case user_id % 5 when 0 then 'crest_tapping' when 1 then 'tidal_level' when 2 then 'logged'
      when 3 then 'tipping_bucket_raingauge' else event_type end
    else event_type end as code
from {events}
"""


@query(
    "code_maps",
    f"""select event_id, code, case event_id % 5
          when 0 then case code when 'mAOD' then '{{root}}/def/core/datumAOD' when 'mASD' then '{{root}}/def/core/datumASD'
            when 'mBDAT' then '{{root}}/def/core/datumBDAT' end
          when 1 then case code when '5_min' then '300' when '15_min' then '900' when '30_min' then '1800'
            when '1_h' then '3600' when 'Unspecified' then '0' else code end
          when 2 then case code when 'i' then 'instantaneous' when 't' then 'total' when 'Mean' then 'mean'
            when 'Event' then 'event' when 'Cumulative_Total' then 'cumulative total' else code end
          when 3 then case code when 'crest_tapping' then 'Crest Tapping' when 'tidal_level' then 'Tidal Level'
            when 'logged' then 'Logged' when 'tipping_bucket_raingauge' then 'Tipping Bucket Raingauge' else code end
          end as meaning,
          case code when '5_min' then 300 when '15_min' then 900 when '30_min' then 1800 when '1_h' then 3600
            when 'Unspecified' then 0 end as seconds
        from ({plain(CODED)}) c""",
)
def code_maps(spark, sf_dir):
    return derive(spark, sf_dir, CODED).select(
        "event_id",
        "code",
        codes.field_value(F.col("field"), F.col("code")).alias("meaning"),
        codes.period_in_seconds(F.col("code")).alias("seconds"),
    )


LINKED = f"""
select event_id, case when event_id % 17 = 0 then null else concat('{FLOOD_ROOT}/id/floodAreas/', event_type) end as uri,
  case when event_id % 19 = 0 then null
    else concat('{STATION_PREFIX}', lpad(cast(user_id as string), 8, '0'), '{GUID_TAIL}') end as station_id
from {{events}}
"""


@query(
    "uri_templating",
    f"""select event_id, replace(coalesce(uri, ''), '{FLOOD_ROOT}', '{{root}}') as templated,
          replace(l.station_id, '{STATION_PREFIX}', '') as station_id_label,
          s.label as station_name
        from ({plain(LINKED)}) l left join ({plain(STATIONS)}) s
          on s.notation = replace(l.station_id, '{STATION_PREFIX}', '')""",
)
def uri_templating(spark, sf_dir):
    links = derive(spark, sf_dir, LINKED)
    joined = relations.measures_with_station(links, derive(spark, sf_dir, STATIONS))
    return joined.select(
        "event_id",
        root_templated(F.col("uri"), FLOOD_ROOT).alias("templated"),
        "station_id_label",
        "station_name",
    )


@query(
    "readings_csv_scan",
    f"select source, measure, dateTime, date, value, period, quality, qcode from ({CELLS}) c",
)
def readings_csv_scan(spark, sf_dir):
    raw = derive(spark, sf_dir, RAW_READINGS)
    base = land_readings(raw, fresh_path(spark, "reading-files"))
    columns = ("source", "measure", "dateTime", "date", "value", "period", "quality", "qcode")
    return reading_files.scan_readings(spark, base).select(*columns)


@query(
    "reading_filter_set",
    f"""select event_id, cast(value as double) as value, quality from ({SHAPED}) s
        where r_date > date '2024-01-02' and r_date <= date '2024-01-28' and period = 900
          and lower(observation_type) = 'qualified'""",
)
def reading_filter_set(spark, sf_dir):
    chosen = filter_readings(
        shaped(spark, sf_dir),
        min_date=dt.date(2024, 1, 2),
        maxeq_date=dt.date(2024, 1, 28),
        observation_type="Qualified",
        period=900,
    )
    return chosen.select("event_id", F.col("value").cast("double").alias("value"), "quality")


@query(
    "readings_of_property",
    f"""select event_id, notation from ({SHAPED}) s
        where exists (select 1 from ({plain(STATIONS)}) st where st.notation = s.station_id and st.river_name in ('NATION_1', 'NATION_2'))
          and parameter = 'gw'""",
)
def readings_of_property(spark, sf_dir):
    rows = shaped(spark, sf_dir)
    stations = derive(spark, sf_dir, STATIONS).select(
        "notation", F.when(F.col("river_name").isin("NATION_1", "NATION_2"), "R1,R2").alias("rloi_id")
    )
    property_uri = F.concat(
        F.lit("http://environment.data.gov.uk/reference/def/op/"),
        F.when(F.col("parameter") == "gw", "groundwaterLevel").otherwise("waterLevel"),
    )
    measures = rows.select("notation", property_uri.alias("observed_property_id"))
    chosen = filter_readings(
        rows,
        station_rloi_id="R2",
        observed_property="groundwaterLevel",
        stations=stations,
        measures=measures,
    )
    return chosen.select("event_id", "notation")


VIEWED = f"""(select *, case when event_id % 3 = 0 then '1.0' when event_id % 3 = 1 then '0' end as completeness,
    case when event_id % 4 = 0 then 'yes' when event_id % 4 = 1 then 'no' end as valid,
    case when event_id % 5 > 0 then concat('i', event_id % 5) end as invalid,
    case when event_id % 6 > 0 then concat('m', event_id % 6) end as missing from ({SHAPED}) s0)"""
READ_MOMENT = "strftime(r_datetime, '%Y-%m-%d %H:%M:%S') as r_datetime"
READ_DATE = "strftime(r_date, '%Y-%m-%d') as r_date"
READ_VALUE = "cast(value as double) as value"


def viewed(spark, sf_dir) -> DataFrame:
    """Shaped readings whose files fill every quality column."""
    raw = derive(spark, sf_dir, RAW_READINGS)
    number = F.col("event_id")
    filled = raw.withColumns(
        {
            "completeness": F.when(number % 3 == 0, "1.0").when(number % 3 == 1, "0"),
            "valid": F.when(number % 4 == 0, "yes").when(number % 4 == 1, "no"),
            "invalid": F.when(number % 5 > 0, F.concat(F.lit("i"), number % 5)),
            "missing": F.when(number % 6 > 0, F.concat(F.lit("m"), number % 6)),
        }
    )
    return R.shape_readings(normalise_missing(filled))


def _as_text(rows: DataFrame) -> DataFrame:
    """Days and moments as text, values as doubles, whichever of them a view has."""
    wanted = {"r_datetime": moment_text("r_datetime"), "r_date": day_text("r_date"), "value": F.col("value").cast("double")}
    return rows.withColumns({name: column for name, column in wanted.items() if name in rows.columns})


@query(
    "reading_view_full",
    f"""select measure, {READ_MOMENT}, {READ_DATE}, {READ_VALUE}, period, completeness, quality, qcode, valid, invalid, missing
        from {VIEWED} v where r_date >= date '2024-01-03' and r_date < date '2024-01-28'""",
)
def reading_view_full(spark, sf_dir):
    """From a day on and before another, with every quality column."""
    rows = filter_readings(viewed(spark, sf_dir), mineq_date=dt.date(2024, 1, 3), max_date=dt.date(2024, 1, 28), view="full")
    return _as_text(rows)


@query(
    "reading_view_flow",
    f"""select measure, {READ_MOMENT}, {READ_DATE}, {READ_VALUE}, quality, qcode, valid, invalid, missing
        from {VIEWED} v where r_date = date '2024-01-12'""",
)
def reading_view_flow(spark, sf_dir):
    """One day."""
    return _as_text(filter_readings(viewed(spark, sf_dir), date=dt.date(2024, 1, 12), view="flow"))


STATION = f"00000006{GUID_TAIL}"


@query(
    "reading_view_default",
    f"""select measure, {READ_MOMENT}, {READ_DATE}, {READ_VALUE}, completeness, quality, qcode
        from {VIEWED} v where station_id = '{STATION}'""",
)
def reading_view_default(spark, sf_dir):
    """One station by its GUID."""
    return _as_text(filter_readings(viewed(spark, sf_dir), station=STATION, view="default"))


@query(
    "reading_view_min",
    f"""select measure, {READ_MOMENT}, {READ_VALUE} from ({SHAPED}) s
        where exists (select 1 from ({plain(STATIONS)}) st where st.notation = s.station_id and st.s_suppkey % 3 = 2)""",
)
def reading_view_min(spark, sf_dir):
    """Stations by an id that is one of several in a list."""
    listed = F.when(F.col("s_suppkey") % 3 == 2, "W0,W1").when(F.col("s_suppkey") % 3 == 0, "W11,W2")
    stations = derive(spark, sf_dir, STATIONS).select("notation", listed.alias("wiski_id"))
    return _as_text(filter_readings(shaped(spark, sf_dir), station_wiski_id="W1", stations=stations, view="min"))


MEASURE = f"00000006{GUID_TAIL}-level-i-900-m-qualified"


@query(
    "readings_of_measure",
    f"select event_id, measure, {READ_MOMENT} from ({SHAPED}) s where notation = '{MEASURE}' or measure = '{MEASURE}'",
)
def readings_of_measure(spark, sf_dir):
    """One measure by its notation."""
    rows = filter_readings(shaped(spark, sf_dir), measure=MEASURE)
    return rows.select("event_id", "measure", moment_text("r_datetime"))


PLACED = """
select event_id, ts as r_datetime, value, cast(50.5 + (user_id % 400) * 0.01 as double) as lat,
  case when event_id % 211 > 0 then cast(-4.5 + (user_id % 500) * 0.01 as double) end as long
from {events}
"""


@query(
    "readings_in_view",
    f"""select event_id, lat, long, strftime(r_datetime, '%Y-%m-%d %H:%M:%S') as r_datetime, value from ({plain(PLACED)}) p
        where lat between 50.6 and 52.25 and long between -4.25 and -2.5
          and r_datetime between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-12 18:30:00'""",
)
def readings_in_view(spark, sf_dir):
    """A map view and a span of time, of files in the order of a curve through both."""
    path = fresh_path(spark, "curve")
    write_by_curve(derive(spark, sf_dir, PLACED), path)
    seen = in_viewport(spark.read.parquet(path), 50.6, -4.25, 52.25, -2.5)
    span = (F.lit(dt.datetime(2024, 1, 5, 6)), F.lit(dt.datetime(2024, 1, 12, 18, 30)))
    return between_moments(seen, *span).select("event_id", "lat", "long", moment_text("r_datetime"), "value")


@query(
    "latest_earliest",
    f"""select measure, strftime(l.t, '%Y-%m-%d %H:%M:%S') as latest, l.e as latest_event, cast(l.v as double) as latest_value,
          strftime(f.t, '%Y-%m-%d %H:%M:%S') as earliest, f.e as earliest_event
        from (select measure,
            max({{'t': r_datetime, 'e': event_id, 'v': value}}) as l, min({{'t': r_datetime, 'e': event_id, 'v': value}}) as f
          from ({SHAPED}) s where r_datetime is not null group by measure) g""",
)
def latest_earliest(spark, sf_dir):
    rows = shaped(spark, sf_dir)
    newest = R.latest_per_measure(rows, "event_id").select(
        "measure",
        F.date_format("r_datetime", "yyyy-MM-dd HH:mm:ss").alias("latest"),
        F.col("event_id").alias("latest_event"),
        F.col("value").cast("double").alias("latest_value"),
    )
    oldest = R.earliest_per_measure(rows, "event_id").select(
        F.col("measure").alias("first_measure"),
        F.date_format("r_datetime", "yyyy-MM-dd HH:mm:ss").alias("earliest"),
        F.col("event_id").alias("earliest_event"),
    )
    joined = newest.join(oldest, F.col("measure").eqNullSafe(F.col("first_measure")))
    return joined.drop("first_measure")


@query(
    "key_uniqueness",
    f"""select notation, strftime(r_datetime, '%Y-%m-%d %H:%M:%S') as r_datetime, count(*) as n_rows
        from ({SHAPED}) s group by notation, s.r_datetime having count(*) > 1""",
)
def key_uniqueness(spark, sf_dir):
    repeated = summaries.repeated_keys(shaped(spark, sf_dir), R.READING_KEY)
    return repeated.select("notation", moment_text("r_datetime"), "n_rows")


@query("rows_per_batch", f"select source, count(*) as n_rows from ({CELLS}) c group by source")
def rows_per_batch(spark, sf_dir):
    return summaries.rows_per(cells(spark, sf_dir), "source")


@query("row_counts", f"select count(*) as n_rows from ({CELLS}) c")
def row_counts(spark, sf_dir):
    return summaries.row_count(cells(spark, sf_dir))


@query(
    "limit_reached",
    f"select source, count(*) as n_rows from ({CELLS}) c group by source having count(*) >= 340",
)
def limit_reached(spark, sf_dir):
    return reading_files.limit_reached(cells(spark, sf_dir), "source", 340)


