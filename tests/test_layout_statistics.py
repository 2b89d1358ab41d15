"""Files in curve order, statistics kept with the writes, and facets in one pass."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from freshet.functions.curve import axis_bounds, with_curve
from freshet.operators import summaries
from freshet.operators.filters import between_moments, in_viewport
from freshet.plans import readings as P
from freshet.sinks.curve_files import write_by_curve
from freshet.sinks.day_statistics import DayStatistics
from freshet.sinks.day_table import DayTable

START = dt.datetime(2024, 1, 1)


def scanned_rows(df):
    """Rows that the scan of an executed plan handed on, after row groups and pages were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_curve_interleaves_the_axes(spark):
    points = [(float(x), float(y)) for x, y in itertools.product(range(8), repeat=2)]
    rows = spark.createDataFrame(points, "x double, y double")
    assert axis_bounds(rows, ("x", "y")) == [(0.0, 7.0), (0.0, 7.0)]
    got = {(r.x, r.y): r.c for r in with_curve(rows, ("x", "y"), [(0, 8), (0, 8)], "c").collect()}

    def interleaved(x, y):  # the first three bits of each axis, x first
        return sum(((int(v) >> bit) & 1) << (2 * bit + first) for bit in range(3) for v, first in ((x, 1), (y, 0)))

    by_curve = sorted(points, key=lambda p: got[p])
    assert by_curve == sorted(points, key=lambda p: interleaved(*p))
    assert len(set(got.values())) == 64


def test_curve_takes_absent_and_odd_values(spark):
    odd = [(None, None, None), (float("nan"), 1.0, START), (float("inf"), 2.0, None), (50.0, float("-inf"), START), (51.0, 3.0, START)]
    rows = spark.createDataFrame(odd, "lat double, long double, r_datetime timestamp")
    bounds = axis_bounds(rows, ("lat", "long", "r_datetime"))
    assert bounds[:2] == [(50.0, 51.0), (1.0, 3.0)]
    assert all(r.c >= 0 for r in with_curve(rows, ("lat", "long", "r_datetime"), bounds, "c").collect())
    assert axis_bounds(rows.where("false"), ("lat",)) == [(0.0, 0.0)]


def test_files_in_curve_order_skip_rows(spark, tmp_path):
    pick = random.Random(3)
    rows = spark.createDataFrame(
        [(i, 50 + 5 * pick.random(), -4 + 5 * pick.random(), START + dt.timedelta(minutes=pick.randrange(40_000))) for i in range(40_000)],
        "i int, lat double, long double, r_datetime timestamp",
    )
    path, plain = str(tmp_path / "curve"), str(tmp_path / "plain")
    spark.conf.set("parquet.block.size", str(64 << 10))
    spark.conf.set("parquet.page.row.count.limit", "500")
    try:
        write_by_curve(rows, path)
        rows.repartition(4).write.parquet(plain)
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("parquet.page.row.count.limit")

    def view(p):
        return in_viewport(spark.read.parquet(p), 51.0, -3.0, 51.5, -2.5)

    def span(p):
        return between_moments(spark.read.parquet(p), F.lit(START), F.lit(START + dt.timedelta(days=1)))

    for question in (view, span, lambda p: between_moments(view(p), F.lit(START), F.lit(START + dt.timedelta(days=2)))):
        assert sorted(question(path).collect()) == sorted(question(plain).collect())
        assert scanned_rows(question(plain)) > 35_000
        # 80 pages cut each of the three axes about four times, and a filter within one part touches two at most
        assert scanned_rows(question(path)) <= 20_000


def test_one_place_is_many_tasks(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.lit(51.5).alias("lat"), F.lit(None).cast("double").alias("long"), F.lit(START).alias("r_datetime"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_by_curve(rows, str(tmp_path / "hot"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = spark.read.parquet(str(tmp_path / "hot"))
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 2 and max(sizes) < 10_000
    assert stored.columns == rows.columns


def _reading(day, measure, value, status=0):
    return {"r_date": day, "r_datetime": dt.datetime.combine(day, dt.time(6)), "measure": measure, "notation": measure, "value": value, "value_status": status}


def _readings(spark, *rows):
    from decimal import Decimal

    filled = [{**{name: None for name in P.READINGS_SCHEMA.names}, **r, "value": None if r["value"] is None else Decimal(r["value"])} for r in rows]
    return spark.createDataFrame([[r[name] for name in P.READINGS_SCHEMA.names] for r in filled], P.READINGS_SCHEMA)


def test_statistics_follow_the_writes(spark, tmp_path):
    first, second, third = (dt.date(2024, 1, d) for d in (1, 2, 4))
    table = P.readings_table(spark, str(tmp_path / "readings"))
    statistics = DayStatistics(spark, str(tmp_path / "statistics"))
    assert statistics.catch_up(table) == [] and statistics.read().count() == 0
    table.append(_readings(spark, _reading(first, "a", 1), _reading(first, "b", None, 5), _reading(second, "a", 2)))
    assert statistics.catch_up(table) == [first, second]
    assert statistics.catch_up(table) == []

    # a write that dies after the statistics were invalidated leaves none, and the next call makes them
    statistics.invalidate([second, third])
    table.replace_days(_readings(spark, _reading(second, "a", 7), _reading(second, "c", 8), _reading(third, "a", 3)))
    assert statistics.outdated(table) == [second, third]
    statistics.catch_up(table)
    stored = {r.r_date: r for r in statistics.read().collect()}
    assert [(r.n_rows, r.n_values, r.n_measures, r.status_0, r.status_5) for _, r in sorted(stored.items())] == [(2, 1, 2, 1, 1), (2, 2, 2, 2, 0), (1, 1, 1, 1, 0)]
    whole = summaries.statistics_summary(statistics.read()).first()
    assert (whole.days_present, whole.n_rows, whole.n_measures_estimate, whole.max_datetime) == (3, 5, 3, dt.datetime(2024, 1, 4, 6))

    table.delete_between(second, second)
    statistics.catch_up(table)
    assert [r.r_date for r in statistics.read().orderBy("r_date").collect()] == [first, third]


def test_statistics_of_no_days(spark):
    whole = summaries.statistics_summary(summaries.day_statistics(_readings(spark))).first()
    assert (whole.days_present, whole.n_rows, whole.status_0, whole.min_date) == (0, 0, 0, None)


def test_dropped_days(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k int, r_date date").schema, ["k"], moment=None)
    table.drop_days([dt.date(2024, 1, 1)])
    table.append(spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 2))], "k int, r_date date"))
    table.drop_days([dt.date(2024, 1, 1), dt.date(2024, 1, 3)])
    assert table.stored_days() == [dt.date(2024, 1, 2)]


def test_facets_equal_brute_force(spark):
    pick = random.Random(1)
    rows = [tuple(pick.choice([None, "x", "y", "z"]) for _ in range(3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    conditions = {"a": F.col("a").isin("x", "y"), "b": F.col("b") != "z", "c": None}
    tests = [lambda r: r[0] in ("x", "y"), lambda r: r[1] not in (None, "z"), lambda r: True]
    want = set()
    for i, name in enumerate("abc"):
        for value in "xyz":
            own = [r for r in rows if r[i] == value]
            left = [r for r in own if all(t(r) for j, t in enumerate(tests) if j != i)]
            want.add((name, value, len(own), len(left), len([r for r in left if tests[i](r)])))
    assert {tuple(r) for r in summaries.facet_counts(df, conditions).collect()} == want
    assert summaries.facet_counts(df.where("false"), conditions).collect() == []


def test_facets_are_one_scan_and_one_shuffle(spark, tmp_path):
    path = str(tmp_path / "areas")
    spark.createDataFrame([("x", "y")], "a string, b string").write.parquet(path)
    plan = summaries.facet_counts(spark.read.parquet(path), {"a": F.col("a") == "x", "b": None})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "SortAggregate" not in plan
