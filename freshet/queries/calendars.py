"""Queries on coverage, load ranges and day filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.dates import day_end, day_start, parse_date, parse_datetime
from ..operators import coverage as V, filters, summaries
from .inputs import PRESENT_DAYS, derive, plain, table
from .readings import day_text
from .registry import query

TODAY = dt.date(2024, 2, 10)

PRESENT = plain(PRESENT_DAYS)
BOUNDS = f"select min(r_date) as lo, max(r_date) as hi from ({PRESENT}) p"
CALENDAR = f"select cast(d as date) as r_date from (select unnest(generate_series(lo, hi, interval 1 day)) as d from ({BOUNDS}) b) c"


@query(
    "coverage_summary",
    f"""select strftime(min(r_date), '%Y-%m-%d') as min_date, strftime(max(r_date), '%Y-%m-%d') as max_date,
          count(distinct r_date) as days_present, date_diff('day', min(r_date), max(r_date)) + 1 as days_in_range,
          date_diff('day', min(r_date), max(r_date)) + 1 - count(distinct r_date) as days_missing
        from ({PRESENT}) p""",
)
def coverage_summary(spark, sf_dir):
    return V.coverage_summary(derive(spark, sf_dir, PRESENT_DAYS)).select(
        day_text("min_date"), day_text("max_date"), "days_present", "days_in_range", "days_missing"
    )


@query(
    "high_water_mark",
    f"""select 'max_datetime' as name, strftime(max(r_datetime), '%Y-%m-%d %H:%M:%S') as value from ({PRESENT}) p
        union all select 'min_date', strftime(min(r_datetime), '%Y-%m-%d') from ({PRESENT}) p
        union all select 'max_date', strftime(max(r_datetime), '%Y-%m-%d') from ({PRESENT}) p
        union all select 'days_present', cast(count(distinct r_date) as varchar) from ({PRESENT}) p""",
)
def high_water_mark(spark, sf_dir):
    rows = derive(spark, sf_dir, PRESENT_DAYS)
    mark = V.high_water_mark(rows).select(F.date_format("max_datetime", "yyyy-MM-dd HH:mm:ss").alias("max_datetime"))
    bounds = V.date_bounds(rows).select(day_text("min_date"), day_text("max_date"))
    count = V.distinct_day_count(rows).select(F.col("days_present").cast("string").alias("days_present"))
    named = [frame.unpivot([], frame.columns, "name", "value") for frame in (mark, bounds, count)]
    return named[0].unionByName(named[1]).unionByName(named[2])


MISSING = f"select strftime(r_date, '%Y-%m-%d') as r_date from ({CALENDAR}) c where r_date not in (select r_date from ({PRESENT}) p)"


@query("missing_days", MISSING)
def missing_days(spark, sf_dir):
    return V.missing_days(derive(spark, sf_dir, PRESENT_DAYS)).select(day_text("r_date"))


@query("missing_days_except", MISSING)
def missing_days_except(spark, sf_dir):
    return V.missing_days_by_difference(derive(spark, sf_dir, PRESENT_DAYS)).select(day_text("r_date"))


@query(
    "gap_backfill",
    f"{MISSING} and r_date >= date '2024-01-05' and r_date <= date '2024-03-01'",
)
def gap_backfill(spark, sf_dir):
    rows = derive(spark, sf_dir, PRESENT_DAYS)
    gaps = V.missing_days(rows, "r_date", dt.date(2024, 1, 5), dt.date(2024, 3, 1))
    return gaps.select(day_text("r_date"))


ORDER_RANGES = """
select o_custkey, cast(min(o_orderdate) as date) as lo, cast(max(o_orderdate) as date) as hi
from orders group by o_custkey
"""


@query(
    "date_chunks",
    f"""select o_custkey, strftime(s, '%Y-%m-%d') as chunk_start, strftime(least(s + interval 29 day, hi), '%Y-%m-%d') as chunk_end
        from (select o_custkey, hi, unnest(generate_series(lo, hi, interval 30 day)) as s from ({ORDER_RANGES}) r) c""",
)
def date_chunks(spark, sf_dir):
    ranges = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.to_date(F.min("o_orderdate")).alias("min_date"), F.to_date(F.max("o_orderdate")).alias("max_date"))
    )
    return V.date_chunks(ranges, 30).select("o_custkey", day_text("chunk_start"), day_text("chunk_end"))


@query(
    "clamped_ranges",
    f"""select o_custkey, strftime(greatest(lo, date '1996-01-01'), '%Y-%m-%d') as min_date,
          strftime(least(hi, date '1997-12-31'), '%Y-%m-%d') as max_date
        from ({ORDER_RANGES}) r""",
)
def clamped_ranges(spark, sf_dir):
    ranges = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.to_date(F.min("o_orderdate")).alias("min_date"), F.to_date(F.max("o_orderdate")).alias("max_date"))
    )
    cut = V.clamped(ranges, dt.date(1996, 1, 1), dt.date(1997, 12, 31))
    return cut.select("o_custkey", day_text("min_date"), day_text("max_date"))


def _range_text(ranges):
    return ranges.select(day_text("start_date"), day_text("end_date"))


@query(
    "incremental_range",
    f"""select strftime(hi + interval 1 day, '%Y-%m-%d') as start_date, '2024-02-07' as end_date
        from ({BOUNDS}) b where hi + interval 1 day <= date '2024-02-07'""",
)
def incremental_range(spark, sf_dir):
    return _range_text(V.incremental_range(derive(spark, sf_dir, PRESENT_DAYS), TODAY))


@query(
    "trailing_range",
    f"select strftime(hi - interval 14 day, '%Y-%m-%d') as start_date, '2024-02-09' as end_date from ({BOUNDS}) b",
)
def trailing_range(spark, sf_dir):
    return _range_text(V.trailing_range(derive(spark, sf_dir, PRESENT_DAYS), TODAY))


@query(
    "forced_range",
    f"""select event_id, strftime(r_date, '%Y-%m-%d') as r_date from ({PRESENT}) p
        where r_date between date '2024-01-08' and date '2024-01-12'""",
)
def forced_range(spark, sf_dir):
    days = V.range_days(V.forced_range(spark, dt.date(2024, 1, 8), dt.date(2024, 1, 12)))
    rows = V.with_days(derive(spark, sf_dir, PRESENT_DAYS), days)
    return rows.select("event_id", day_text("r_date"))


@query(
    "days_present_semi",
    f"""select event_id from events where cast(ts as date) in (select r_date from ({PRESENT}) p)""",
)
def days_present_semi(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("r_date", F.to_date("ts"))
    return V.with_days(events, V.days_present(derive(spark, sf_dir, PRESENT_DAYS))).select("event_id")


@query("days_absent_anti", f"select event_id from events where cast(ts as date) not in (select r_date from ({PRESENT}) p)")
def days_absent_anti(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("r_date", F.to_date("ts"))
    return V.without_days(events, V.days_present(derive(spark, sf_dir, PRESENT_DAYS))).select("event_id")


@query(
    "date_in_table",
    f"""select '2024-01-05' as r_date, exists(select 1 from ({PRESENT}) p where r_date = date '2024-01-05') as present
        union all select '2024-01-09', exists(select 1 from ({PRESENT}) p where r_date = date '2024-01-09')""",
)
def date_in_table(spark, sf_dir):
    rows = derive(spark, sf_dir, PRESENT_DAYS)
    found, gap = (
        filters.has_day(rows, day).select(F.lit(day.isoformat()).alias("r_date"), "present")
        for day in (dt.date(2024, 1, 5), dt.date(2024, 1, 9))
    )
    return found.unionByName(gap)


@query(
    "half_open_day",
    "select event_id, value from events where ts >= timestamp '2024-01-07' and ts < timestamp '2024-01-08'",
)
def half_open_day(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return filters.on_day(events, dt.date(2024, 1, 7), "ts").select("event_id", "value")


@query(
    "closed_range",
    """select event_id, value from events
       where ts between timestamp '2024-01-07 00:00:00' and timestamp '2024-01-09 23:59:59.999999'""",
)
def closed_range(spark, sf_dir):
    first, last = (F.lit(dt.date(2024, 1, day)) for day in (7, 9))
    events = table(spark, sf_dir, "events")
    return filters.between_moments(events, day_start(first), day_end(last), "ts").select("event_id", "value")


# dates and timestamps in good and bad forms
DATE_TEXTS = """
select event_id, case event_id % 8 when 0 then '2024-1-5' when 1 then '24-01-05' when 2 then '2024-02-30'
    when 3 then '2024-01-05x' when 4 then '' when 5 then null else substr(cast(ts as string), 1, 10) end as d,
  case event_id % 5 when 0 then substr(cast(ts as string), 1, 10) when 1 then 'soon' when 2 then null
    else concat(replace(substr(cast(ts as string), 1, 19), ' ', 'T'), 'Z') end as t
from {events}
"""


@query(
    "date_parsing",
    f"""select event_id, strftime(case when regexp_full_match(d, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') then try_cast(d as date) end, '%Y-%m-%d') as day,
          strftime(try_cast(t as timestamp), '%Y-%m-%d %H:%M:%S') as moment
        from ({plain(DATE_TEXTS)}) x""",
)
def date_parsing(spark, sf_dir):
    return derive(spark, sf_dir, DATE_TEXTS).select(
        "event_id",
        F.date_format(parse_date(F.col("d")), "yyyy-MM-dd").alias("day"),
        F.date_format(parse_datetime(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("moment"),
    )


@query("latest_first", "select event_id, value from events order by ts desc, event_id limit 100")
def latest_first(spark, sf_dir):
    return summaries.newest_first(table(spark, sf_dir, "events"), 100, "ts", "event_id").select("event_id", "value")
