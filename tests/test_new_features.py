"""Neighbours, corrected files, the latest readings as a stream, replaced days, and series in parts."""

import datetime as dt
import math
import pathlib
import random

import pytest
from pyspark.sql import functions as F, types as T

from freshet.operators import neighbours, series
from freshet.plans.readings import readings_table
from freshet.queries import QUERIES, streams
from freshet.sinks.day_table import DayTable
from freshet.sinks.ledger import FileLedger
from freshet.sources import reading_files
from freshet.streaming.corrections import load_landed
from freshet.streaming.latest import LatestReadings, follow_latest

ID = "11111111-2222-3333-4444-{:012d}"
MEASURE = "http://environment.data.gov.uk/hydrology/id/measures/" + ID + "-level-i-900-m-qualified"


def nearest(points, k):
    at = {}
    for key, x, y in points:
        if x is not None and y is not None and math.isfinite(x) and math.isfinite(y):
            at.setdefault((x, y), []).append(key)
    classes = {place: min(keys) for place, keys in at.items()}
    out = set()
    for (x, y), key in classes.items():
        others = sorted(((x - u) * (x - u) + (y - v) * (y - v), other, len(at[u, v])) for (u, v), other in classes.items() if other != key)
        out |= {(key, rank, other, round(math.sqrt(d), 6), n) for rank, (d, other, n) in enumerate(others[:k], 1)}
    return out


@pytest.mark.parametrize("k, finest, cell_places", [(3, 1.0, 4), (5, 0.25, 1), (500, 1.0, 16)])
def test_nearest_places(spark, k, finest, cell_places):
    rng = random.Random(k)
    points = [(i, rng.uniform(-1e5, 6e5), rng.uniform(0, 1e6)) for i in range(120)]
    points += [(1000 + i, 3e5 + rng.random(), 4e5 + rng.random()) for i in range(80)]  # a crowd within one unit
    points += [(5000 + i, 100.0, 200.0) for i in range(300)]  # one very full place
    points += [(9000, None, 1.0), (9001, float("nan"), 1.0), (9002, float("inf"), 0.0)]
    table = spark.createDataFrame(points, "station_id long, x double, y double")
    got = neighbours.nearest_places(table, k, finest=finest, cell_places=cell_places)
    assert {(r.class_id, r.rank, r.neighbour_id, round(r.distance, 6), r.n_members) for r in got.collect()} == nearest(points, k)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cells_descend_together(spark, monkeypatch):
    """The descent keeps a few rows for each cell, not for each place and level."""
    rows, kept = [], neighbours.staged

    def counted(frame, name, *partition_by):
        table = kept(frame, name, *partition_by)
        if name == "cells_in_reach":
            rows.append(table.count())
        return table

    monkeypatch.setattr(neighbours, "staged", counted)
    rng = random.Random(5)
    points = [(i, rng.uniform(0, 4e3), rng.uniform(0, 4e3)) for i in range(600)]
    got = neighbours.nearest_places(spark.createDataFrame(points, "station_id long, x double, y double"), 3)
    assert {(r.class_id, r.rank, r.neighbour_id, round(r.distance, 6), r.n_members) for r in got.collect()} == nearest(points, 3)
    assert sum(rows) < 20 * len(points)


def test_few_or_no_places(spark):
    schema = "station_id long, x double, y double"
    assert neighbours.nearest_places(spark.createDataFrame([], schema), 3).collect() == []
    assert neighbours.nearest_places(spark.createDataFrame([(1, 0.0, 0.0), (2, -0.0, 0.0)], schema), 3).collect() == []
    members = neighbours.place_members(spark.createDataFrame([(2, 0.0, 0.0), (1, -0.0, 0.0), (3, 4.0, 3.0)], schema))
    assert {tuple(r) for r in members.collect()} == {(1, 1), (2, 1), (3, 3)}
    two = neighbours.nearest_places(spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], schema), 3)
    assert {tuple(r) for r in two.collect()} == {(1, 1, 2, 5.0, 1), (2, 1, 1, 5.0, 1)}


def reading_file(base, day, rows, header=("measure", "dateTime", "value", "quality")):
    folder = base / day[:4]
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"hydro-{day}.csv"
    path.write_text(",".join(header) + "\n" + "".join(",".join(str(row[name]) for name in header) + "\n" for row in rows))
    return path


def cell(station, moment, value, quality="Good"):
    return {"measure": MEASURE.format(station), "dateTime": moment, "value": value, "quality": quality}


def test_a_file_written_again_is_loaded_again(spark, tmp_path):
    stations = spark.createDataFrame([(ID.format(1), "one")], "notation string, label string")
    base = tmp_path / "landing"
    reading_file(base, "2024-03-01", [cell(1, "2024-03-01T00:00:00", 1), cell(2, "2024-03-01T00:00:00", 2)])
    reading_file(base, "2024-03-02", [cell(1, "2024-03-02T00:00:00", 3)])
    table, ledger = readings_table(spark, str(tmp_path / "table")), FileLedger(spark, str(tmp_path / "ledger"))
    first = load_landed(table, str(base), stations, ledger)
    assert (first.new_files, first.changed_files, first.gone_files, first.reloaded) == (2, 0, 0, None)
    again = load_landed(table, str(base), stations, ledger)
    assert (again.new_files, again.changed_files, again.gone_files, again.added) == (0, 0, 0, None)
    # the same name, other columns, a row fewer; and a new day
    reading_file(base, "2024-03-01", [cell(1, "2024-03-01T00:00:00", 9, "Corrected")], ("quality", "value", "extra", "measure", "dateTime")[:2] + ("measure", "dateTime"))
    reading_file(base, "2024-03-03", [cell(1, "2024-03-03T00:00:00", 4)])
    second = load_landed(table, str(base), stations, ledger)
    assert (second.new_files, second.changed_files) == (1, 1)
    got = {(r.r_date.day, r.station_id[-1], float(r.value), r.quality) for r in table.read().collect()}
    assert got == {(1, "1", 9.0, "Corrected"), (2, "1", 3.0, "Good"), (3, "1", 4.0, "Good")}
    assert len(ledger.batches()) == 2
    ledger.compact()
    assert ledger.batches() == [3] and ledger.read().count() == 3
    # a trigger that failed before the ledger was written is repeated
    FileLedger(spark, str(tmp_path / "other"))
    load_landed(table, str(base), stations, FileLedger(spark, str(tmp_path / "other")))
    assert {(r.r_date.day, float(r.value)) for r in table.read().collect()} == {(1, 9.0), (2, 3.0), (3, 4.0)}
    (base / "2024" / "hydro-2024-03-02.csv").unlink()
    gone = load_landed(table, str(base), stations, ledger)
    assert gone.gone_files == 1 and table.read().count() == 3 and ledger.read().count() == 2
    assert load_landed(table, str(base), stations, ledger).gone_files == 0


def test_jobs_do_not_follow_the_files(spark, tmp_path):
    def jobs(n):
        base = tmp_path / f"landing{n}"
        for day in range(1, n + 1):
            header = ("measure", "dateTime", "value", "quality") if day % 2 else ("value", "quality", "dateTime", "measure")
            reading_file(base, f"2024-04-{day:02d}", [cell(day, f"2024-04-{day:02d}T00:00:00", day)], header)
        spark.sparkContext.setJobGroup(f"scan{n}", "scan")
        rows = reading_files.scan_readings(spark, str(base)).collect()
        spark.sparkContext.setJobGroup("", "")
        assert {(r.source[-2:], float(r.value)) for r in rows} == {(f"{d:02d}", float(d)) for d in range(1, n + 1)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"scan{n}"))

    assert jobs(4) == jobs(20)


def test_only_the_days_asked_for_are_listed(spark, tmp_path):
    for day in ("2024-05-01", "2024-05-02", "2024-06-01"):
        reading_file(tmp_path, day, [cell(1, f"{day}T00:00:00", 1)])
    part = tmp_path / "2024" / "hydro-2024-06-02"
    part.mkdir()
    (part / "part-0.csv").write_text("measure,dateTime\n")
    listed = reading_files.list_reading_files(spark, str(tmp_path), [dt.date(2024, 5, 2), dt.date(2024, 6, 2), dt.date(2030, 1, 1)])
    assert sorted((r.day, r.length > 0) for r in listed.select("day", "length").collect()) == [(dt.date(2024, 5, 2), True), (dt.date(2024, 6, 2), True)]
    assert reading_files.list_reading_files(spark, str(tmp_path)).count() == 4


def test_odd_headers(spark, tmp_path):
    folder = tmp_path / "2024"
    folder.mkdir()
    (folder / "hydro-2024-07-01.csv").write_text('\n"value",measure,value,,"a ""b"""\n1,m,2,x,y\n')
    (folder / "hydro-2024-07-02.csv").write_text("\n\n")
    rows = reading_files.scan_readings(spark, str(tmp_path)).collect()
    assert [(r.measure, r.value, r.source) for r in rows] == [("m", "1", "hydro-2024-07-01")]


def test_replaced_days_keep_no_row_without_a_day(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("r_date", T.DateType())])
    table = DayTable(spark, str(tmp_path / "t"), schema, ["k"], moment=None)
    day = dt.date(2024, 1, 1)
    reports = [table.replace_days(spark.createDataFrame(rows, schema)).collect()
               for rows in ([(1, day), (2, None)], [(3, day), (4, None), (5, None)], [(6, None)])]
    assert [sorted((r.r_date is None, r.rows_deleted, r.rows_loaded, r.rows_rejected) for r in report) for report in reports] == [
        [(False, 0, 1, 0), (True, 0, 0, 1)], [(False, 1, 1, 0), (True, 0, 0, 2)], [(True, 0, 0, 1)]]
    assert [r.k for r in table.read().collect()] == [3]


def test_latest_readings_of_a_stream(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"m{rng.randrange(8)}", start + dt.timedelta(minutes=rng.randrange(50)), i, float(i)) for i in range(300)]
    rows += [(None, start, 1, 1.0), ("m1", None, 2, 2.0)]
    schema = "measure string, r_datetime timestamp, i int, value double"
    landed = str(tmp_path / "landed")
    for part in (2, 0, 1):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(landed)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)
    sink = LatestReadings(spark, str(tmp_path / "latest"), ("i",))
    follow_latest(source, sink, str(tmp_path / "checkpoint")).awaitTermination()
    expected = {}
    for measure, moment, i, value in rows:
        if measure and moment:
            expected[measure] = max(expected.get(measure, (start, -1, 0.0)), (moment, i, value))
    read = lambda: {r.measure: (r.r_datetime, r.i, r.value) for r in sink.read().collect()}
    assert read() == expected
    # a batch that is written again replaces itself; folded batches give the same rows
    sink.write(spark.createDataFrame(
        spark.read.parquet(f"{sink.path}/batch=1").collect(), "measure string, r_datetime timestamp, i int, value double"), 1)
    assert read() == expected
    sink.compact(1)
    assert read() == expected
    # and later files are taken up from the checkpoint
    spark.createDataFrame([("m1", start + dt.timedelta(days=1), 999, 5.0), ("m2", start - dt.timedelta(days=40), 0, 0.0)], schema).coalesce(1).write.mode("append").parquet(landed)
    follow_latest(source, sink, str(tmp_path / "checkpoint")).awaitTermination()
    assert read() == {**expected, "m1": (start + dt.timedelta(days=1), 999, 5.0)}


def test_a_delivery_is_landed_by_many_tasks(spark, sf_dir, tmp_path, monkeypatch):
    """The latest readings land and stream in as many files as the events have, not in one a delivery."""
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    expected = {tuple(r) for r in QUERIES["stream_latest"](spark, sf_dir).collect()}
    paths, fresh = {}, streams.fresh_path
    monkeypatch.setattr(streams, "fresh_path", lambda session, name: paths.setdefault(name, fresh(session, name)))
    monkeypatch.setattr(streams, "staged", lambda frame, name: frame, raising=False)
    monkeypatch.setattr(streams, "discard", lambda *tables: None, raising=False)
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task a file
    try:
        got = {tuple(r) for r in QUERIES["stream_latest"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert got == expected
    assert len(list(pathlib.Path(paths["landed-latest"]).glob("*.parquet"))) > 4 * 3


def test_anomalies_do_not_depend_on_the_parts(spark):
    """One hot series within one window: every number of parts gives brute-force results."""
    rng = random.Random(11)
    rows = [(i, "hot" if i % 10 else None, rng.randrange(0, 3_000), rng.choice([rng.gauss(5, 2), None, float("nan") if i == 7 else 1.0])) for i in range(400)]
    frame = spark.createDataFrame([(i, k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), v) for i, k, s, v in rows],
                                  "i int, notation string, r_datetime timestamp, value double")
    for parts, part_rows in ((64, 10**6), (1, 0), (64, 60), (10**9, 0)):  # no slice, all, some of them in parts
        got = {r.i: r for r in series.rolling_anomaly(frame, 1000, 1.5, parts=parts, part_rows=part_rows).collect()}
        assert len(got) == len(rows)
        for i, k, s, v in rows:
            before = [w for _, l, t, w in rows if l == k and s - 1000 <= t < s and w is not None]
            assert got[i].n_before == len(before)
            mean = sum(before) / len(before) if before else None
            if mean is None or math.isnan(mean):
                assert got[i].mean_before is None or math.isnan(got[i].mean_before)
            else:
                assert math.isclose(got[i].mean_before, mean, abs_tol=1e-9)


def test_a_hot_slice_is_many_tasks(spark):
    """A series at one row a millisecond within one window is dealt out by its parts."""
    frame = spark.range(20_000).select(F.lit("hot").alias("notation"), F.timestamp_millis(F.col("id")).alias("r_datetime"), F.col("id").cast("double").alias("value"))
    plan = series.rolling_anomaly(frame, 20, part_rows=1000)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "RangeFrame" in line]
    assert windows and all("_part" in line.split("specifiedwindowframe")[-1] for line in windows)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_lags_over_block_borders(spark, block):
    rng = random.Random(2)
    grid = [(k, slot, rng.choice([rng.random(), 3.0])) for k in "abc" for slot in range(-30, 40) if rng.random() < 0.6]
    grid += [("flat", slot, 0.1) for slot in range(-30, 40)]
    frame = spark.createDataFrame(grid, "notation string, slot long, mean double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("a", "flat"), ("a", "nobody")], "left string, right string")
    got = {(r.left, r.right, r.lag): (r.n_slots, r.correlation) for r in series.lag_correlation(frame, pairs, 9, block_slots=block).collect()}
    at = {}
    for k, slot, v in grid:
        at.setdefault(k, {})[slot] = v
    import statistics

    expected = 0
    for left, right in (("a", "b"), ("b", "a"), ("c", "c"), ("a", "flat")):
        for lag in range(-9, 10):
            both = [(v, at[right][s + lag]) for s, v in at[left].items() if s + lag in at[right]]
            n, corr = got[left, right, lag]
            expected += 1
            assert n == len(both)
            if right == "flat":
                assert corr is None
            else:
                assert math.isclose(corr, statistics.correlation(*zip(*both)), rel_tol=1e-9, abs_tol=1e-9)
    assert len(got) == expected


def test_lags_are_not_shuffled(spark):
    """The rows before the last aggregate do not grow with the number of lags."""
    grid = spark.range(200).select(F.lit("a").alias("notation"), F.col("id").alias("slot"), F.rand(1).alias("mean"))
    pairs = spark.createDataFrame([("a", "a")], "left string, right string")
    plan = series.lag_correlation(grid, pairs, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sequence(-50" not in plan
