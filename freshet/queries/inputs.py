"""Readings, stations, areas and polygons derived from the given tables.

The texts run unchanged in Spark and in the checking database, so both sides
start from equal rows. ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.constants import MEASURE_PREFIX, STATION_PREFIX
from ..sources.reading_files import READING_COLUMNS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

GUID_TAIL = "-4a1f-42c6-9d07-5be0c3f7721a"

_P = MEASURE_PREFIX
_G = f"lpad(cast(user_id as string), 8, '0'), '{GUID_TAIL}"
_E = "'E', lpad(cast(user_id as string), 8, '0'), "

# raw cells with defects in every column
RAW_READINGS = f"""
select event_id,
  concat('hydro-', substr(cast(ts as string), 1, 10)) as source,
  case when event_id % 101 = 0 then null
       when event_id % 97 = 0 then '{_P}bad-notation'
       else concat('{_P}', case user_id % 6
         when 0 then concat({_G}-level-i-900-m-qualified')
         when 1 then concat({_G}_SE1-gw-dipped-i-mAOD-qualified')
         when 2 then concat({_G}-gw-logged-i-subdaily-mAOD-qualified')
         when 3 then concat({_E}'-ph-i-subdaily')
         when 4 then concat({_E}'-bga-i-subdaily-rfu')
         else concat('x-y-', {_G}-gw-logged-i-subdaily-mAOD-qualified') end) end as measure,
  case when event_id % 89 = 0 then 'not a time'
       when event_id % 83 = 0 then concat(replace(substr(cast(ts as string), 1, 19), ' ', 'T'), 'Z')
       else replace(substr(cast(ts as string), 1, 19), ' ', 'T') end as dateTime,
  case when event_id % 79 = 0 then '2024-02-30' else substr(cast(ts as string), 1, 10) end as date,
  case event_id % 50 when 1 then 'NaN' when 2 then '1.5|2.5' when 3 then '1|x' when 4 then 'abc'
    when 5 then '' when 6 then 'inf' when 7 then '1_000' when 8 then '1d' when 9 then '0|99999999'
    when 10 then '+nan' when 11 then ' 12 ' when 12 then 'NAN' when 13 then null when 14 then '1|nan'
    else cast(value as string) end as value,
  case event_id % 7 when 0 then '900' when 1 then '900.0' when 2 then '' when 3 then 'x'
    when 4 then null when 5 then '3600.7' else '-1.5' end as period,
  case event_id % 3 when 0 then 'Good' when 1 then 'Unchecked' else null end as quality,
  event_type as qcode
from {{events}}
"""

# covers some of the reading stations only
STATIONS = f"""
select concat(lpad(cast(s_suppkey as string), 8, '0'), '{GUID_TAIL}') as notation, s_name as label,
  concat('{STATION_PREFIX}', lpad(cast(s_suppkey as string), 8, '0'), '{GUID_TAIL}') as json_id,
  cast(50.5 + (s_suppkey % 40) * 0.1 as double) as lat, cast(-4.5 + (s_suppkey % 50) * 0.1 as double) as long,
  n_name as river_name, s_suppkey
from {{supplier}} join {{nation}} on s_nationkey = n_nationkey
"""

# county is null in places, to test that an unfiltered comparison still drops those rows
AREAS = """
select p_partkey as floodarea_id, r_name as eaareaname,
  case when p_partkey % 13 = 0 then null else n_name end as county,
  concat(p_name, ' / ', p_type) as description, p_name as label, p_brand as riverorsea,
  concat('0', lpad(cast(p_partkey as string), 5, '0'), 'WAF') as fwdcode,
  cast(50.5 + (p_partkey % 400) * 0.01 as double) as lat, cast(-4.5 + (p_partkey % 500) * 0.01 as double) as long
from {part} join {nation} on p_partkey % 25 = n_nationkey join {region} on n_regionkey = r_regionkey
"""

# four days on which nothing was delivered
PRESENT_DAYS = """
select event_id, ts as r_datetime, cast(ts as date) as r_date from {events} where extract(day from ts) not in (4, 9, 10, 23)
"""

# two deliveries that overlap by two days; changed, nulled and equal rows
OLD_SNAPSHOT = """
select event_id as k, value as v, event_type as quality, cast(ts as date) as r_date
from {events} where extract(day from ts) < 20
"""
NEW_SNAPSHOT = """
select event_id as k, case when event_id % 5 = 0 then value + 1 else value end as v,
  case when event_id % 11 = 0 then null else event_type end as quality, cast(ts as date) as r_date
from {events} where extract(day from ts) >= 18
"""

# origin, width and height; kind 0 is a rectangle, 1 has a hole, 2 has two parts
BOXES = """
select p_partkey as floodarea_id, concat('0', lpad(cast(p_partkey as string), 5, '0'), 'WAF') as fwdcode,
  cast(-4.5 + (p_partkey % 500) * 0.01 as decimal(12, 6)) as x0, cast(50.5 + (p_partkey % 400) * 0.01 as decimal(12, 6)) as y0,
  cast(0.002 * (1 + p_partkey % 5) as decimal(12, 6)) as w, cast(0.001 * (1 + p_partkey % 7) as decimal(12, 6)) as h,
  p_partkey % 3 as kind
from {part}
"""

# station links: every station with the next one of the same nation
COLOCATED = f"""
select concat('{STATION_PREFIX}', lpad(cast(s_suppkey as string), 8, '0'), '{GUID_TAIL}') as station_id,
  concat('{STATION_PREFIX}', lpad(cast(s_suppkey + 25 as string), 8, '0'), '{GUID_TAIL}') as colocated_id
from {{supplier}}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of one of the texts above."""
    frames = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in text}
    return spark.sql(text, **frames)


def plain(text: str) -> str:
    """The text with bare table names."""
    return text.format(**{name: name for name in TABLES})


def land_readings(raw: DataFrame, base: str) -> str:
    """Write raw cells as daily files, in all columns of a reading file. Returns ``base``."""
    cells = [F.col(name) if name in raw.columns else F.lit(None).cast("string").alias(name) for name in READING_COLUMNS]
    (
        # "source=hydro-<date>" is the day's folder of part files
        raw.select(*cells, "source", F.substring("source", 7, 4).alias("year"))
        .hint("rebalance", F.col("source"))
        .write.partitionBy("year", "source")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(base)
    )
    return base
