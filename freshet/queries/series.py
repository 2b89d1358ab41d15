"""Queries on time series of readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbours, readings as R, series as S
from .inputs import derive, plain, table
from .readings import shaped
from .registry import query
from .sqltext import SHAPED


@query(
    "latest_per_measure",
    f"""select notation, strftime(l.t, '%Y-%m-%d %H:%M:%S') as r_datetime, l.e as event_id
        from (select measure, max(notation) as notation, max({{'t': r_datetime, 'e': event_id}}) as l
          from ({SHAPED}) s where r_datetime is not null and measure is not null group by measure) g""",
)
def latest_per_measure(spark, sf_dir):
    newest = R.latest_per_measure(R.usable(shaped(spark, sf_dir)), "event_id", "notation")
    return newest.select("notation", F.date_format("r_datetime", "yyyy-MM-dd HH:mm:ss").alias("r_datetime"), "event_id")


@query(
    "rolling_anomaly",
    """select event_id, n_before, round(mean_before, 6) as mean_before, round(z, 6) as z_score, coalesce(abs(z) > 2, false) as anomalous
       from (select *, case when sd > 0 then (value - mean_before) / sd end as z from (
         select event_id, value, count(value) over w as n_before, avg(value) over w as mean_before, stddev_samp(value) over w as sd
         from events window w as (partition by user_id order by ts
           range between interval 5 days preceding and interval 1 microsecond preceding)) a) b""",
)
def rolling_anomaly(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    scored = S.rolling_anomaly(events, 5 * S.DAY_SECONDS, 2.0, "user_id", "ts", "value")
    return scored.select(
        "event_id",
        "n_before",
        F.round("mean_before", 6).alias("mean_before"),
        F.round("z_score", 6).alias("z_score"),
        "anomalous",
    )


GRID = "select user_id, epoch_us(ts) // 86400000000 as slot, avg(value) as mean from events group by all"
PAIRS = "select distinct user_id as l, user_id + 1 as r from events"


@query(
    "lag_correlation",
    f"""select l as "left", r as "right", lag, count(*) as n_slots from (
          select p.l, p.r, unnest(generate_series(-2, 2)) as lag, a.slot from ({PAIRS}) p join ({GRID}) a on a.user_id = p.l) x
        join ({GRID}) b on b.user_id = x.r and b.slot = x.slot + x.lag group by all""",
)
def lag_correlation(spark, sf_dir):
    return _correlations(spark, sf_dir).select("left", "right", "lag", "n_slots")


def _correlations(spark, sf_dir, min_slots=1):
    events = table(spark, sf_dir, "events")
    grid = S.gridded(events, S.DAY_SECONDS, "user_id", "ts", "value")
    pairs = events.select(F.col("user_id").alias("left"), (F.col("user_id") + 1).alias("right")).distinct()
    return S.lag_correlation(grid, pairs, 2, "user_id", min_slots)


@query(
    "correlation_strength",
    f"""select l as "left", r as "right", lag, round(corr(x.mean, b.mean), 6) as correlation from (
          select p.l, p.r, unnest(generate_series(-2, 2)) as lag, a.slot, a.mean from ({PAIRS}) p join ({GRID}) a on a.user_id = p.l) x
        join ({GRID}) b on b.user_id = x.r and b.slot = x.slot + x.lag group by all having count(*) >= 5""",
)
def correlation_strength(spark, sf_dir):
    strong = _correlations(spark, sf_dir, min_slots=5)
    return strong.select("left", "right", "lag", F.round("correlation", 6).alias("correlation"))


@query(
    "best_lag",
    f"""select "left", "right", b.lag as lag, round(b.c, 6) as correlation, b.n as n_slots from (
          select "left", "right", max({{'s': abs(c), 'a': -abs(lag), 'b': -lag, 'lag': lag, 'c': c, 'n': n}}) as b from (
            select l as "left", r as "right", lag, corr(x.mean, b.mean) as c, count(*) as n from (
              select p.l, p.r, unnest(generate_series(-2, 2)) as lag, a.slot, a.mean from ({PAIRS}) p join ({GRID}) a on a.user_id = p.l) x
            join ({GRID}) b on b.user_id = x.r and b.slot = x.slot + x.lag group by all having count(*) >= 5) k
          where c is not null group by all) m""",
)
def best_lag(spark, sf_dir):
    best = S.best_lag(_correlations(spark, sf_dir, min_slots=5))
    return best.select("left", "right", "lag", F.round("correlation", 6).alias("correlation"), "n_slots")


# a third of the stations stand at one place, a fifth close together, the others all over the grid
SPREAD_STATIONS = """
select c_custkey as station_id,
  cast(case when c_custkey % 3 = 0 then 5000 when c_custkey % 5 = 1 then 20000 + (c_custkey * 31 % 997) * 0.25
       else (c_custkey * 7919 % 100003) * 2.5 end as double) as x,
  cast(case when c_custkey % 3 = 0 then 7000 when c_custkey % 5 = 1 then 40000 + (c_custkey * 17 % 499) * 0.5
       else (c_custkey * 104729 % 99991) * 1.25 end as double) as y
from {customer}
"""


@query(
    "neighbour_places",
    f"""with p as (select min(station_id) as class_id, x, y, count(*) as n_members from ({plain(SPREAD_STATIONS)}) s group by x, y)
        select * from (
          select a.class_id, b.class_id as neighbour_id, b.n_members, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as distance,
            row_number() over (partition by a.class_id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.class_id) as rank
          from p a join p b on a.class_id <> b.class_id) r where rank <= 6""",
)
def neighbour_places(spark, sf_dir):
    """The six nearest other places of each place."""
    edges = neighbours.nearest_places(derive(spark, sf_dir, SPREAD_STATIONS), 6)
    return edges.select("class_id", "rank", "neighbour_id", F.round("distance", 6).alias("distance"), "n_members")
