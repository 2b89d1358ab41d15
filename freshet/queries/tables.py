"""Queries on merging, replacing, deleting and relating tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F, types as T

from ..operators import changes, readings as R, relations, summaries
from ..session import fresh_path
from ..sinks.alerts import alert_table, find_alerts
from ..sinks.catalogue_tables import CatalogueTables
from ..sinks.day_table import DayTable
from .inputs import COLOCATED, NEW_SNAPSHOT, OLD_SNAPSHOT, STATIONS, derive, plain, table
from .readings import day_text, shaped
from .registry import query
from .sqltext import SHAPED

OLD, NEW = plain(OLD_SNAPSHOT), plain(NEW_SNAPSHOT)

SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("k", T.LongType()),
        T.StructField("v", T.DoubleType()),
        T.StructField("quality", T.StringType()),
        T.StructField("r_date", T.DateType()),
    ]
)

# the overlapping days arrive twice: as stored and as revised
DELIVERIES = f"""
select *, 2 as delivery from ({NEW_SNAPSHOT}) n
union all select *, 1 as delivery from ({OLD_SNAPSHOT}) o where r_date >= date '2024-01-18'
"""

MERGED = f"""
select coalesce(o.k, n.k) as k, coalesce(o.r_date, n.r_date) as r_date,
  case when o.k is null then n.v when n.k is not null then n.v else o.v end as v,
  case when o.k is null then n.quality when n.k is not null then n.quality else o.quality end as quality,
  case when o.k is null then 'inserted' when n.k is null then 'kept'
       when o.v is distinct from n.v or o.quality is distinct from n.quality then 'updated'
       else 'unchanged' end as action
from ({OLD}) o full join ({NEW}) n on o.k = n.k
"""

MERGED_TEXT = f"select k, v, quality, strftime(r_date, '%Y-%m-%d') as r_date"


def _batch(spark, sf_dir):
    rows = derive(spark, sf_dir, DELIVERIES)
    return changes.one_row_per_key(rows, ["k"], [F.col("delivery").desc()]).drop("delivery")


def _day_table(spark, sf_dir, name: str) -> DayTable:
    target = DayTable(spark, fresh_path(spark, name), SNAPSHOT_SCHEMA, ["k"], ["v", "quality"], moment=None)
    target.append(derive(spark, sf_dir, OLD_SNAPSHOT))
    return target


def _snapshot_text(rows):
    return rows.select("k", "v", "quality", day_text("r_date"))


@query("upsert_result", f"{MERGED_TEXT}, action from ({MERGED}) m")
def upsert_result(spark, sf_dir):
    merged = changes.merge_changes(
        derive(spark, sf_dir, OLD_SNAPSHOT), _batch(spark, sf_dir), ["k"], ["v", "quality"]
    )
    return merged.select("k", "v", "quality", day_text("r_date"), "action")


@query("change_classes", f"select k, action from ({MERGED}) m")
def change_classes(spark, sf_dir):
    return changes.classify_changes(
        derive(spark, sf_dir, OLD_SNAPSHOT), _batch(spark, sf_dir), ["k"], ["v", "quality"]
    )


@query(
    "upsert_actions",
    f"""select strftime(r_date, '%Y-%m-%d') as r_date, action, count(*) as n_rows from ({MERGED}) m
        where action in ('inserted', 'updated') group by all""",
)
def upsert_actions(spark, sf_dir):
    merged = changes.merge_changes(
        derive(spark, sf_dir, OLD_SNAPSHOT), _batch(spark, sf_dir), ["k"], ["v", "quality"]
    )
    return summaries.action_tally(merged.withColumn("r_date", F.date_format("r_date", "yyyy-MM-dd")), "r_date")


@query("upsert_table", f"{MERGED_TEXT} from ({MERGED}) m")
def upsert_table(spark, sf_dir):
    target = _day_table(spark, sf_dir, "upsert")
    target.upsert(derive(spark, sf_dir, DELIVERIES), [F.col("delivery").desc()])
    return _snapshot_text(target.read())


@query("append_or_upsert", f"{MERGED_TEXT} from ({MERGED}) m")
def append_or_upsert(spark, sf_dir):
    target = _day_table(spark, sf_dir, "append-or-upsert")
    target.append_or_upsert(derive(spark, sf_dir, DELIVERIES), [F.col("delivery").desc()])
    return _snapshot_text(target.read())


@query(
    "replace_day",
    f"""{MERGED_TEXT} from (select * from ({OLD}) o where r_date not in (select r_date from ({NEW}) n)
        union all select * from ({NEW}) n) u""",
)
def replace_day(spark, sf_dir):
    target = _day_table(spark, sf_dir, "replace")
    target.replace_days(derive(spark, sf_dir, NEW_SNAPSHOT))
    return _snapshot_text(target.read())


@query(
    "replace_report",
    f"""select strftime(n.r_date, '%Y-%m-%d') as r_date, n.c as rows_loaded, coalesce(o.c, 0) as rows_deleted
        from (select r_date, count(*) as c from ({NEW}) n group by r_date) n
        left join (select r_date, count(*) as c from ({OLD}) o group by r_date) o on o.r_date = n.r_date""",
)
def replace_report(spark, sf_dir):
    report = _day_table(spark, sf_dir, "replace").replace_days(derive(spark, sf_dir, NEW_SNAPSHOT))
    return report.select(day_text("r_date"), "rows_loaded", "rows_deleted")


# two deliveries with rows that have no day
HALF = lambda k: f"select k, v, quality, case when k % 50 = {k} then null else r_date end as r_date from ({NEW_SNAPSHOT}) n where k % 2 = {k}"


def _loaded(call: int, earlier: str) -> str:
    half = plain(HALF(call - 1))
    return f"""
select {call} as call, strftime(n.r_date, '%Y-%m-%d') as r_date, n.c as rows_loaded, coalesce(o.c, 0) as rows_deleted, 0 as rows_rejected
from (select r_date, count(*) as c from ({half}) h where r_date is not null group by r_date) n
left join (select r_date, count(*) as c from ({earlier}) e group by r_date) o on o.r_date = n.r_date
union all
select {call}, null, 0, 0, count(*) from ({half}) h where r_date is null having count(*) > 0"""


FIRST_HALF = plain(HALF(0))
AFTER_FIRST = f"select * from ({OLD}) o where r_date not in (select r_date from ({FIRST_HALF}) f where r_date is not null) union all select * from ({FIRST_HALF}) g where r_date is not null"


@query("replace_reports_rejected", f"{_loaded(1, OLD)} union all {_loaded(2, AFTER_FIRST)}")
def replace_reports_rejected(spark, sf_dir):
    """The reports of two replacements whose rows without a day are stored nowhere."""
    target = _day_table(spark, sf_dir, "replace-twice")
    reports = [target.replace_days(derive(spark, sf_dir, HALF(k))).withColumn("call", F.lit(k + 1)) for k in (0, 1)]
    return reports[0].unionByName(reports[1]).select("call", day_text("r_date"), "rows_loaded", "rows_deleted", "rows_rejected")


@query(
    "delete_range",
    f"{MERGED_TEXT} from ({OLD}) o where r_date not between date '2024-01-05' and date '2024-01-07'",
)
def delete_range(spark, sf_dir):
    target = _day_table(spark, sf_dir, "delete")
    target.delete_between(dt.date(2024, 1, 5), dt.date(2024, 1, 7))
    return _snapshot_text(target.read())


@query(
    "append_without_repeats",
    f"""{MERGED_TEXT} from (select * from ({OLD}) o
        union all select * from ({NEW}) n where k not in (select k from ({OLD}) o2)) u""",
)
def append_without_repeats(spark, sf_dir):
    tables = CatalogueTables(spark, fresh_path(spark, "catalogue"))
    tables.refresh({"snapshot": derive(spark, sf_dir, OLD_SNAPSHOT)})
    tables.append("snapshot", derive(spark, sf_dir, NEW_SNAPSHOT), "k")
    return _snapshot_text(tables.read("snapshot"))


@query("rejected_repeats", f"{MERGED_TEXT} from ({NEW}) n where k in (select k from ({OLD}) o)")
def rejected_repeats(spark, sf_dir):
    rows = changes.repeats(derive(spark, sf_dir, OLD_SNAPSHOT), derive(spark, sf_dir, NEW_SNAPSHOT), ["k"])
    return _snapshot_text(rows)


@query(
    "deduplicated_batch",
    f"""select notation, strftime(r_datetime, '%Y-%m-%d %H:%M:%S') as r_datetime, max(event_id) as event_id
        from ({SHAPED}) s where notation is not null and r_datetime is not null group by notation, s.r_datetime""",
)
def deduplicated_batch(spark, sf_dir):
    rows = R.usable(shaped(spark, sf_dir))
    single = changes.one_row_per_key(rows, R.READING_KEY, [F.col("event_id").desc()])
    return single.select("notation", F.date_format("r_datetime", "yyyy-MM-dd HH:mm:ss").alias("r_datetime"), "event_id")


_STATUS_COUNTS = ", ".join(
    f"count(*) filter (where value_status = {code}) as status_{code}" for code in (0, 1, 2, 3, 5, 6, 7, 8)
)


@query(
    "day_report",
    f"""select strftime(r_date, '%Y-%m-%d') as r_date, count(*) as n_rows, {_STATUS_COUNTS},
          count(distinct case when notation is not null then concat(notation, ' ', cast(r_datetime as varchar)) end) as inserted,
          0 as updated
        from ({SHAPED}) s where r_date is not null group by s.r_date""",
)
def day_report(spark, sf_dir):
    rows = shaped(spark, sf_dir).where(F.col("r_date").isNotNull())
    batch = changes.one_row_per_key(R.usable(rows), R.READING_KEY, [F.col("event_id").desc()])
    actions = changes.classify_changes(batch.limit(0), batch, ["r_date", *R.READING_KEY], R.TRACKED)
    report = summaries.day_report(rows, actions)
    return report.withColumn("r_date", F.date_format("r_date", "yyyy-MM-dd"))


ALERTS = """
select event_id as floodalert_id, cast(ts as date) as alert_date, concat('area ', cast(user_id % 25 as string)) as area,
  concat('0', lpad(cast(user_id as string), 5, '0'), 'WAF') as fwdcode, concat('alert area ', cast(user_id as string)) as alert_area,
  event_type as type
from {events} where event_type = 'error'
"""


@query(
    "alert_history",
    f"""select floodalert_id, strftime(alert_date, '%Y-%m-%d') as alert_date, area, fwdcode, alert_area, type
        from ({plain(ALERTS)}) a where alert_date between date '2024-01-03' and date '2024-01-20' and area = 'area 7'""",
)
def alert_history(spark, sf_dir):
    history = alert_table(spark, fresh_path(spark, "alerts"))
    history.append(derive(spark, sf_dir, ALERTS))
    found = find_alerts(history.read(), dt.date(2024, 1, 3), dt.date(2024, 1, 20), area="area 7")
    return found.withColumn("alert_date", F.date_format("alert_date", "yyyy-MM-dd")).drop("created")


ALL_ALERTS = ALERTS.replace("where event_type = 'error'", "")


@query(
    "alert_history_all_types",
    f"""select floodalert_id, strftime(alert_date, '%Y-%m-%d') as alert_date, area, fwdcode, alert_area, type
        from ({plain(ALL_ALERTS)}) a where alert_date between date '2024-01-03' and date '2024-01-20' and area = 'area 7'""",
)
def alert_history_all_types(spark, sf_dir):
    history = alert_table(spark, fresh_path(spark, "alerts"))
    history.append(derive(spark, sf_dir, ALL_ALERTS))
    found = find_alerts(history.read(), dt.date(2024, 1, 3), dt.date(2024, 1, 20), area="area 7")
    return found.withColumn("alert_date", F.date_format("alert_date", "yyyy-MM-dd")).drop("created")


@query(
    "parent_child_join",
    """select l_orderkey, l_linenumber, o_custkey, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey""",
)
def parent_child_join(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    children = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return relations.children_of(parents, children, "l_orderkey")


REMAINING = "select * from orders where o_orderstatus <> 'F'"


@query(
    "cascade_semi",
    f"select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from ({REMAINING}) r)",
)
def cascade_semi(spark, sf_dir):
    remaining = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    children = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return relations.cascaded(children, remaining.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query(
    "orphans_anti",
    f"select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from ({REMAINING}) r)",
)
def orphans_anti(spark, sf_dir):
    remaining = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    children = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return relations.orphans(children, remaining.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query(
    "colocated_self_join",
    f"""select c.station_id, c.colocated_id, s.notation as colocated_notation, s.label as colocated_label
        from ({plain(COLOCATED)}) c join ({plain(STATIONS)}) s on s.json_id = c.colocated_id""",
)
def colocated_self_join(spark, sf_dir):
    return relations.colocated_pairs(derive(spark, sf_dir, COLOCATED), derive(spark, sf_dir, STATIONS))
