"""Filters, joins, merging, coverage and series."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from freshet.operators import changes, coverage, filters, joins, readings as R, relations, series, summaries

DAY = dt.date(2024, 1, 5)


@pytest.fixture(scope="module")
def areas(spark):
    rows = [
        ("East", "Cambs", "Fens of 100%", "a_b", "Ouse", "1"),
        ("East", None, "Fens", "ab", "Ouse", "2"),
        ("West", "Devon", "Moor\\land", "axb", "Exe", "3"),
    ]
    return spark.createDataFrame(rows, "eaareaname string, county string, description string, label string, riverorsea string, fwdcode string")


def codes(df):
    return sorted(row.fwdcode for row in df.collect())


def test_regex_filter(areas):
    assert codes(filters.areas_by_regex(areas)) == ["1", "3"]
    assert codes(filters.areas_by_regex(areas, riverorsea="^E")) == ["3"]
    assert codes(filters.areas_by_regex(areas, riverorsea="^e")) == []
    with pytest.raises(TypeError):
        filters.areas_by_regex(areas, colour="x")


def test_like_filter(areas):
    assert codes(filters.areas_like(areas)) == ["1", "3"]
    assert codes(filters.areas_like(areas, county="CAM", other="ignored")) == ["1"]
    assert codes(filters.areas_like(areas, label="a_b")) == ["1", "3"]
    assert codes(filters.areas_like(areas, label="a\\_b")) == ["1"]
    assert codes(filters.areas_like(areas, label="\\a", description="")) == ["1", "3"]
    assert codes(filters.areas_like(areas, description="r\\\\l")) == ["3"]
    assert codes(filters.areas_like(areas, description="100\\%")) == ["1"]


def test_like_pattern():
    assert filters.like_pattern(None) == filters.like_pattern("") == "%"
    assert filters.like_pattern("a\\bc\\") == "%abc%"


def test_selected_areas(areas):
    assert codes(filters.areas_selected(areas, ["West"])) == ["3"]
    assert codes(filters.areas_selected(areas, [], label="a")) == ["1", "3"]


def test_facets(areas):
    got = {row.eaareaname: row.active for row in summaries.facets(areas, filters.areas_like(areas, county="cam"), "eaareaname").collect()}
    assert got == {"East": True, "West": False}


def test_filters_prune_partitions_and_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select(
        F.expr("timestamp '2024-01-01' + make_dt_interval(0, cast(id as int))").alias("r_datetime"), "id", F.lit("x").alias("wide")
    )
    rows.withColumn("r_date", F.to_date("r_datetime")).write.partitionBy("r_date").parquet(path)
    found = filters.on_day(spark.read.parquet(path), dt.date(2024, 1, 2), partition="r_date").select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(r_date" in plan and "2024-01-02" in plan
    assert "GreaterThanOrEqual(r_datetime" in plan
    assert "wide" not in plan
    assert sorted(row.id for row in found.collect()) == list(range(24, 48))


def readings_frame(spark):
    return spark.createDataFrame(
        [
            ("m1", "n1", "s1", dt.date(2024, 1, 4), 900, "qualified"),
            ("m1", "n1", "s1", DAY, 900, "Qualified"),
            ("m2", "n2", "s2", DAY, 3600, None),
        ],
        "measure string, notation string, station_id string, r_date date, period int, observation_type string",
    )


def test_reading_filters(spark):
    rows = readings_frame(spark)
    count = lambda **kw: filters.filter_readings(rows, **kw).count()
    assert count() == 3 and count(measure="m1") == 2 and count(measure="n2") == 1
    assert count(date=DAY) == 2 and count(min_date=dt.date(2024, 1, 4)) == 2 and count(mineq_date=dt.date(2024, 1, 4)) == 3
    assert count(max_date=DAY) == 1 and count(maxeq_date=DAY) == 3
    assert count(station="s2") == 1 and count(observation_type="QUALIFIED") == 2 and count(period=3600) == 1
    stations = spark.createDataFrame([("s1", "7,8", "w1"), ("s2", "9", None)], "notation string, rloi_id string, wiski_id string")
    assert count(station_rloi_id="8", stations=stations) == 2 and count(station_wiski_id="w1", stations=stations) == 2
    measures = spark.createDataFrame([("n2", "http://x/op/rainfall"), ("n2", "http://x/op/rainfall")], "notation string, observed_property_id string")
    assert count(observed_property="rainfall", measures=measures) == 1
    with pytest.raises(ValueError):
        count(observed_property="colour", measures=measures)
    with pytest.raises(ValueError):
        count(station_rloi_id="8")


def test_lookup_broadcasts_by_bytes_without_a_job(spark, tmp_path):
    facts = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name")).write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    expected = sorted((i, f"n{0 if i % 3 == 0 else i}" if i % 3 == 0 or i < 1000 else None) for i in range(3000))
    tracker = spark.sparkContext.statusTracker()
    for threshold, broadcast in (("10m", True), ("1k", False)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            jobs = len(tracker.getJobIdsForGroup(None))
            joined = joins.lookup(facts, names, ["k"])
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert len(tracker.getJobIdsForGroup(None)) == jobs
            assert ("BroadcastHashJoin" in plan) == broadcast
            assert sorted((row.id, row.name) for row in joined.collect()) == expected
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        joins.lookup(facts, names, ["k"], "full_outer")


def test_labels_are_unique_per_station(spark):
    stations = spark.createDataFrame([("a", "x", 1), ("a", "w", 2), (None, "y", 3)], "notation string, label string, n int")
    assert [tuple(r) for r in R.station_labels(stations).collect()] == [("a", "x")]
    assert [tuple(r) for r in R.station_labels(stations, "n").collect()] == [("a", "w")]


def test_shape_defaults(spark):
    raw = spark.createDataFrame([("2024-01-05T00:00:00",), ("bad",)], "dateTime string")
    rows = R.shape_readings(raw).collect()
    assert rows[0].source == "EA" and rows[0].r_date == DAY and rows[0].r_month == dt.date(2024, 1, 1)
    assert rows[0].value_status == 1 and rows[0].period == 0 and rows[0].notation is None
    assert [row.reason for row in R.quarantined(R.shape_readings(raw)).orderBy("reason").collect()] == [
        "no measure", "no measure and no timestamp",
    ]


def test_one_row_per_key_prunes_before_the_shuffle(spark):
    rows = spark.range(2000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    single = changes.one_row_per_key(rows, ["k"], [F.col("id").desc()])
    assert "WindowGroupLimit" in single._jdf.queryExecution().executedPlan().toString()
    got = {row.k: row.id for row in single.collect()}
    assert got[0] == 1998 and len(got) == 1 + sum(i % 3 != 0 for i in range(2000))


SCHEMA = "k int, v double, q string, label string, updated timestamp"
MOMENT = dt.datetime(2024, 2, 1)


def test_merge(spark):
    stored = spark.createDataFrame([(1, 1.0, "a", "l", None), (2, 2.0, None, "l", None), (3, None, "c", "l", None), (4, 4.0, "d", "l", None)], SCHEMA)
    batch = spark.createDataFrame([(1, 1.0, "a", "new", None), (2, 2.0, "b", "new", None), (3, 3.0, "c", "new", None), (5, None, None, "new", None)], SCHEMA)
    merged = changes.merge_changes(stored, batch, ["k"], ["v", "q"], "updated", F.lit(MOMENT))
    got = {row.k: tuple(row)[1:] for row in merged.collect()}
    assert got == {
        1: (1.0, "a", "l", None, "unchanged"),
        2: (2.0, "b", "l", MOMENT, "updated"),
        3: (3.0, "c", "l", MOMENT, "updated"),
        4: (4.0, "d", "l", None, "kept"),
        5: (None, None, "new", None, "inserted"),
    }
    again = changes.classify_changes(merged.drop("action"), batch, ["k"], ["v", "q"])
    assert {row.action for row in again.collect()} == {"unchanged", "kept"}
    tally = {row.action: row.n_rows for row in summaries.action_tally(merged).collect()}
    assert tally == {"inserted": 1, "updated": 2}


def days_frame(spark, *days):
    return spark.createDataFrame([(dt.datetime(2024, 1, d), dt.date(2024, 1, d)) for d in days], "r_datetime timestamp, r_date date")


def test_coverage(spark):
    rows = days_frame(spark, 3, 3, 5, 9)
    summary = coverage.coverage_summary(rows).first()
    assert (summary.days_present, summary.days_in_range, summary.days_missing) == (3, 7, 4)
    missing = lambda *a: sorted(row.r_date.day for row in coverage.missing_days(rows, "r_date", *a).collect())
    assert missing() == [4, 6, 7, 8]
    assert missing(dt.date(2024, 1, 5)) == [6, 7, 8]
    assert missing(dt.date(2023, 1, 1), dt.date(2024, 1, 6)) == [4, 6]
    assert missing(dt.date(2025, 1, 1)) == []


def test_load_ranges(spark):
    rows, empty = days_frame(spark, 3, 9), days_frame(spark, 3).limit(0)
    today = dt.date(2024, 1, 20)
    pair = lambda df: [tuple(row) for row in df.collect()]
    assert pair(coverage.incremental_range(rows, today)) == [(dt.date(2024, 1, 10), dt.date(2024, 1, 17))]
    assert pair(coverage.incremental_range(rows, today, 7)) == [(dt.date(2024, 1, 10), dt.date(2024, 1, 13))]
    assert pair(coverage.incremental_range(rows, dt.date(2024, 1, 10))) == []
    assert pair(coverage.incremental_range(empty, today)) == [(dt.date(2022, 1, 1), dt.date(2024, 1, 17))]
    assert pair(coverage.trailing_range(rows, today)) == [(dt.date(2023, 12, 26), dt.date(2024, 1, 19))]
    assert pair(coverage.forced_range(spark, today)) == [(today, today)]
    assert pair(coverage.forced_range(spark, today, dt.date(2024, 1, 1))) == []


def test_relations(spark):
    parents = spark.createDataFrame([(1, "p")], "k int, name string")
    children = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    assert [row.c for row in relations.cascaded(children, parents, "k").collect()] == ["a"]
    assert [row.c for row in relations.orphans(children, parents, "k").collect()] == ["b"]
    assert relations.children_of(parents, children, "k", "left").count() == 2


def test_latest_and_earliest_of_a_hot_measure(spark):
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 50)).alias("measure"),
        F.expr("timestamp '2024-01-01' + make_dt_interval(0, 0, cast(id as int))").alias("r_datetime"),
        F.col("id").cast("double").alias("value"),
    )
    newest = {row.measure: row.value for row in R.latest_per_measure(rows).collect()}
    oldest = {row.measure: row.value for row in R.earliest_per_measure(rows).collect()}
    assert newest["hot"] == 897.0 and oldest["hot"] == 0.0 and len(newest) == 51


def test_rolling_anomaly_against_brute_force(spark):
    generator = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"s{i % 4}", generator.randrange(0, 200_000), generator.gauss(0, 1)) for i in range(600)]
    frame = spark.createDataFrame(
        [(i, key, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), v) for i, (key, s, v) in enumerate(rows)],
        "i int, notation string, r_datetime timestamp, value double",
    )
    got = {row.i: row for row in series.rolling_anomaly(frame, 3600 * 5, 1.5).collect()}
    assert len(got) == len(rows)
    for i, (key, second, value) in enumerate(rows):
        before = [v for k, s, v in rows if k == key and second - 3600 * 5 <= s < second]
        assert got[i].n_before == len(before)
        if before:
            assert math.isclose(got[i].mean_before, statistics.fmean(before), abs_tol=1e-9)
        z = (value - statistics.fmean(before)) / statistics.stdev(before) if len(before) > 1 else None
        assert (z is None) == (got[i].z_score is None)
        if z is not None:
            assert math.isclose(got[i].z_score, z, rel_tol=1e-6, abs_tol=1e-9) and got[i].anomalous == (abs(z) > 1.5)


def test_lagged_copy_is_found(spark):
    wave = [math.sin(i / 3) + (i % 5) * 0.1 for i in range(60)]
    rows = [("a", i * 900, wave[i]) for i in range(60)] + [("b", (i + 2) * 900, wave[i]) for i in range(60)]
    frame = spark.createDataFrame(
        [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), v) for k, s, v in rows], "notation string, r_datetime timestamp, value double"
    )
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a")], "left string, right string")
    table = series.lag_correlation(series.gridded(frame, 900), pairs, 3)
    best = {(row.left, row.right): row for row in series.best_lag(table).collect()}
    assert best["a", "b"].lag == 2 and best["b", "a"].lag == -2
    assert math.isclose(best["a", "b"].correlation, 1.0, rel_tol=1e-9) and best["a", "b"].n_slots == 60
    for row in table.collect():
        left = {s // 900: v for k, s, v in rows if k == row.left}
        right = {s // 900: v for k, s, v in rows if k == row.right}
        both = [(left[s], right[s + row.lag]) for s in left if s + row.lag in right]
        assert row.n_slots == len(both)
        assert math.isclose(row.correlation, statistics.correlation(*zip(*both)), rel_tol=1e-9, abs_tol=1e-9)


def test_constant_series_have_no_correlation(spark):
    rows = [(k, dt.datetime(2024, 1, 1, 0, m), v) for k, v in (("flat", 0.1), ("flat2", 5.0)) for m in range(0, 60, 15)]
    rows += [("wave", dt.datetime(2024, 1, 1, 0, m), float(m)) for m in range(0, 60, 15)]
    grid = series.gridded(spark.createDataFrame(rows, "notation string, r_datetime timestamp, value double"), 900)
    pairs = spark.createDataFrame([("flat", "flat2"), ("flat", "wave"), ("wave", "wave")], "left string, right string")
    table = series.lag_correlation(grid, pairs, 1)
    assert all(row.correlation is None for row in table.where("left = 'flat'").collect())
    assert [(row.left, row.lag) for row in series.best_lag(table).collect()] == [("wave", 0)]


def test_grid_means(spark):
    frame = spark.createDataFrame([("a", dt.datetime(1970, 1, 1, 0, m), float(m)) for m in (0, 10, 20)] + [("a", None, 1.0)], "notation string, r_datetime timestamp, value double")
    assert [tuple(r) for r in series.gridded(frame, 900).orderBy("slot").collect()] == [("a", 0, 5.0), ("a", 1, 20.0)]


def test_rolling_anomaly_has_no_sliding_frame(spark):
    frame = spark.range(20).select(F.lit("a").alias("notation"), F.timestamp_seconds("id").alias("r_datetime"), F.lit(1.5).alias("value"))
    scored = series.rolling_anomaly(frame, 5)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), -1)" in plan and "RangeFrame, -5" not in plan
    rows = scored.orderBy("r_datetime").collect()
    assert [r.n_before for r in rows] == [0, 1, 2, 3, 4] + [5] * 15
    assert all(r.z_score is None and not r.anomalous for r in rows)


def test_first_of_key_takes_one_row(spark):
    from freshet.operators.changes import first_of_key

    rows = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("b", 5), (None, 1), (None, 1)], "k string, v int")
    got = sorted((r.k or "", r.v, r.first) for r in first_of_key(rows, "k", "first").collect())
    assert got == [("", 1, True), ("", 1, True), ("a", 1, False), ("a", 1, True), ("a", 2, False), ("b", 5, True)]


def test_measures_in_text_or_decimals(spark):
    from freshet.operators import catalogue

    raws = ['{"@id":"a","period":"900","hasTelemetry":"true","latestReading":{"value":"1.5"}}',
            '{"@id":"b","period":900.0,"hasTelemetry":false,"latestReading":{"value":2}}', '{"@id":"c","period":"often"}']
    items = spark.createDataFrame([(1, r) for r in raws], "batch_id long, raw string")
    got = {r.json_id: (r.period, r.has_telemetry) for r in catalogue.flood_measures(items).collect()}
    assert got == {"a": (900, True), "b": (900, False), "c": (None, None)}
    assert sorted(r.latest_reading_value or 0 for r in catalogue.flood_measures(items).collect()) == [0, 1.5, 2.0]
    assert {r.json_id: r.period for r in catalogue.hydrology_measures(items).collect()} == {"a": 900, "b": 900, "c": None}
