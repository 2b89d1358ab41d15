"""Whole loads of landed files: from daily files to the readings table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.constants import VALUE_STATUSES
from ..plans import readings as P
from ..operators import summaries
from ..session import fresh_path, hadoop_path
from ..sinks.day_statistics import DayStatistics
from ..sinks.day_table import DayTable
from ..sources.reading_files import READING_SCHEMA, list_reading_files, scan_readings, unusable_days
from .inputs import RAW_READINGS, STATIONS, derive, land_readings
from .readings import day_text, moment_text
from .registry import query
from .sqltext import SHAPED, winners

# a later delivery of the same files, with other quality flags in places
REVISED_READINGS = f"""
select event_id, source, measure, dateTime, date, value, period, qcode,
  case when event_id % 5 = 0 then 'Revised' else quality end as quality
from ({RAW_READINGS}) r
"""
REVISED = f"select * replace (case when event_id % 5 = 0 then 'Revised' else quality end as quality) from ({SHAPED}) v"

COLUMNS = """notation, strftime(r_datetime, '%Y-%m-%d %H:%M:%S') as r_datetime, cast(value as double) as value, quality, qcode, label"""
FIRST, LAST = dt.date(2024, 1, 1), dt.date(2024, 1, 30)


def _day(day: int) -> dt.date:
    return FIRST.replace(day=day)


def _landed(spark: SparkSession, sf_dir: str, text: str = RAW_READINGS) -> str:
    return land_readings(derive(spark, sf_dir, text), fresh_path(spark, "landed"))


def _loaded(spark: SparkSession, sf_dir: str, *spans: tuple[int, int]) -> tuple[DayTable, str, DataFrame]:
    """A table that holds the days of ``spans``, the folder of all files, and the stations."""
    table, stations = P.readings_table(spark, fresh_path(spark, "readings")), derive(spark, sf_dir, STATIONS)
    base = _landed(spark, sf_dir)
    for first, last in spans:
        P.load_forced_days(table, base, stations, _day(first), _day(last))
    return table, base, stations


def _contents(table: DayTable) -> DataFrame:
    value = F.col("value").cast("double").alias("value")
    return table.read().select(
        "notation", moment_text("r_datetime"), value, "quality", "qcode", "label", F.col("updated").isNotNull().alias("updated")
    )


@query("load_new_days", f"select {COLUMNS}, false as updated from ({winners()}) w")
def load_new_days(spark, sf_dir):
    """The days after the last one stored, three days behind."""
    table, base, stations = _loaded(spark, sf_dir, (1, 12))
    P.load_new_days(table, base, stations, LAST + dt.timedelta(days=3))
    return _contents(table)


@query("fill_gaps", f"select {COLUMNS}, false as updated from ({winners()}) w")
def fill_gaps(spark, sf_dir):
    """The days missing between the first and the last one stored."""
    table, base, stations = _loaded(spark, sf_dir, (1, 5), (9, 12), (20, 30))
    P.fill_gaps(table, base, stations)
    return _contents(table)


@query(
    "load_forced_days",
    f"""select {COLUMNS}, updated from (
          select n.*, n.value is distinct from o.value or n.quality is distinct from o.quality or n.qcode is distinct from o.qcode as updated
          from ({winners(REVISED)}) n join ({winners()}) o on o.notation = n.notation and o.r_datetime = n.r_datetime
          where n.r_date between date '2024-01-10' and date '2024-01-20'
          union all
          select o.*, false as updated from ({winners()}) o
          where o.r_date not between date '2024-01-10' and date '2024-01-20') n""",
)
def load_forced_days(spark, sf_dir):
    """Revised files of eleven days on top of what is stored."""
    table, _, stations = _loaded(spark, sf_dir, (1, 30))
    P.load_forced_days(table, _landed(spark, sf_dir, REVISED_READINGS), stations, _day(10), _day(20))
    return _contents(table)


@query(
    "reload_trailing_days",
    f"""select {COLUMNS}, false as updated from (
          select * from ({winners(REVISED)}) n where r_date >= date '2024-01-16'
          union all select * from ({winners()}) o where r_date < date '2024-01-16') w""",
)
def reload_trailing_days(spark, sf_dir):
    """Revised files replace the last days stored, fourteen before the last one and on."""
    table, _, stations = _loaded(spark, sf_dir, (1, 30))
    P.reload_trailing_days(table, _landed(spark, sf_dir, REVISED_READINGS), stations, LAST + dt.timedelta(days=1))
    return _contents(table)


STATISTICS = "n_rows, n_values, n_measures, first_moment, last_moment, " + ", ".join(f"status_{code}" for code in VALUE_STATUSES)
STATUS_COUNTS = ", ".join(f"count(*) filter (where value_status = {code}) as status_{code}" for code in VALUE_STATUSES)
KEPT = f"select * from ({winners()}) w where r_date not between date '2024-01-20' and date '2024-01-22'"


def _followed(spark: SparkSession, sf_dir: str) -> DayStatistics:
    """Statistics that followed two loads, the second on top of some of the first, and a deletion."""
    table, base, stations = _loaded(spark, sf_dir)
    statistics = DayStatistics(spark, fresh_path(spark, "statistics"))
    P.load_forced_days(table, base, stations, _day(1), _day(12), statistics)
    P.load_forced_days(table, base, stations, _day(8), LAST, statistics)
    table.delete_between(_day(20), _day(22))
    statistics.catch_up(table)
    return statistics


@query(
    "day_statistics",
    f"""select strftime(r_date, '%Y-%m-%d') as r_date, count(*) as n_rows, count(value) as n_values, count(distinct measure) as n_measures,
          strftime(min(r_datetime), '%Y-%m-%d %H:%M:%S') as first_moment, strftime(max(r_datetime), '%Y-%m-%d %H:%M:%S') as last_moment,
          {STATUS_COUNTS}
        from ({KEPT}) k group by k.r_date""",
)
def day_statistics(spark, sf_dir):
    """Statistics of every day, kept with the writes."""
    rows = _followed(spark, sf_dir).read()
    counts = [name for name in STATISTICS.split(", ") if not name.endswith("_moment")]
    return rows.select(day_text("r_date"), moment_text("first_moment"), moment_text("last_moment"), *counts)


@query(
    "statistics_summary",
    f"""select strftime(min(r_date), '%Y-%m-%d') as min_date, strftime(max(r_date), '%Y-%m-%d') as max_date,
          strftime(max(r_datetime), '%Y-%m-%d %H:%M:%S') as max_datetime, count(distinct r_date) as days_present,
          count(*) as n_rows, count(value) as n_values, {STATUS_COUNTS}
        from ({KEPT}) k""",
)
def statistics_summary(spark, sf_dir):
    """The whole table in one row, without reading a reading."""
    row = summaries.statistics_summary(_followed(spark, sf_dir).read()).drop("n_measures_estimate")
    return row.withColumns({"min_date": day_text("min_date"), "max_date": day_text("max_date"), "max_datetime": moment_text("max_datetime")})


@query(
    "unusable_days",
    "select distinct strftime(cast(ts as date), '%Y-%m-%d') as day from events where extract(day from ts) in (4, 9)",
)
def unusable(spark, sf_dir):
    """Of two days all rows are withheld: one comes as a file of no bytes, one as a header line."""
    raw = derive(spark, sf_dir, RAW_READINGS)
    withheld = F.substring("source", 15, 2).isin("04", "09")
    base = land_readings(raw.where(~withheld), fresh_path(spark, "landed"))
    for (source,) in raw.where(withheld).select("source").distinct().collect():  # two days
        folder = f"{base}/year={source[6:10]}/source={source}"
        if source.endswith("04"):
            path, files = hadoop_path(spark, f"{folder}/part-0.csv")
            files.create(path).close()
        else:
            spark.createDataFrame([], READING_SCHEMA).write.option("header", True).csv(folder)
    found = unusable_days(list_reading_files(spark, base), scan_readings(spark, base))
    return found.select(day_text("day"))
