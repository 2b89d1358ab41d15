"""Whole loads: files to tables, in batch and as streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F, types as T

from freshet.operators.summaries import repeated_keys
from freshet.plans import catalogues, readings as P
from freshet.sinks.alerts import ALERT_SCHEMA, alert_table, find_alerts
from freshet.sinks.catalogue_tables import CatalogueTables
from freshet.sinks.day_table import DayTable
from freshet.sources.reading_files import READING_COLUMNS
from freshet.streaming.ingest import stream_readings, upsert_stream
from freshet.streaming.late import without_late_repeats

MEASURE = "http://environment.data.gov.uk/hydrology/id/measures/"
HEADER = ",".join(READING_COLUMNS)


def line(station, moment, value, quality="Good"):
    return f"{MEASURE}{station}-level-i-900,{moment},{moment[:10]},{value},900,,{quality},,,,"


def write_day(base, day, lines):
    folder = base / day[:4]
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"hydro-{day}.csv").write_text("\n".join([HEADER, *lines]) + "\n")


@pytest.fixture
def stations(spark):
    return spark.createDataFrame([("S1", "First"), ("S1", "Again")], "notation string, label string")


def contents(table):
    rows = table.read().select("station_id", "r_datetime", F.col("value").cast("double"), "quality", "label", "updated").collect()
    return {(row.station_id, row.r_datetime): (row[2], row.quality, row.label, row.updated is not None) for row in rows}


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_load_rules(spark, tmp_path, stations):
    base = tmp_path / "landed"
    for day in (1, 2, 4):
        write_day(base, f"2024-01-0{day}", [line("S1", f"2024-01-0{day}T00:00:00", day), line("S2", f"2024-01-0{day}T06:00:00", "bad")])
    table = P.readings_table(spark, str(tmp_path / "table"))
    source = str(base)

    # first load: an empty table starts at the default first day
    result = P.load_new_days(table, source, stations, dt.date(2024, 1, 7))
    assert table.stored_days() == [dt.date(2024, 1, d) for d in (1, 2, 4)]
    report = {row.r_date.day: row for row in result.report.collect()}
    assert (report[1].n_rows, report[1].status_0, report[1].status_5, report[1].inserted, report[1].updated) == (2, 1, 1, 2, 0)
    first = contents(table)
    assert first[("S1", at(2))] == (2.0, "Good", "First", False) and first[("S2", at(2, 6))] == (None, "Good", None, False)

    # nothing new to load
    P.load_new_days(table, source, stations, dt.date(2024, 1, 7))
    assert contents(table) == first

    # the missing day is filled, and nothing is missing afterwards
    write_day(base, "2024-01-03", [line("S1", "2024-01-03T00:00:00", 3)])
    P.fill_gaps(table, source, stations)
    assert table.stored_days() == [dt.date(2024, 1, d) for d in (1, 2, 3, 4)]

    # a forced day is upserted: one revised value, one equal row, one new row
    write_day(base, "2024-01-02", [
        line("S1", "2024-01-02T00:00:00", 2.5), line("S2", "2024-01-02T06:00:00", "bad"), line("S3", "2024-01-02T09:00:00", 1),
        "broken,not a time,,,,,,,,,",
    ])
    result = P.load_forced_days(table, source, stations, dt.date(2024, 1, 2))
    report = result.report.where("r_date is not null").first()
    assert (report.inserted, report.updated) == (1, 1)
    assert [row.reason for row in result.quarantine.collect()] == ["no timestamp"]
    after = contents(table)
    assert after[("S1", at(2))] == (2.5, "Good", "First", True) and after[("S2", at(2, 6))] == first[("S2", at(2, 6))]
    repeat = P.load_forced_days(table, source, stations, "2024-01-02").report.where("r_date is not null").first()
    assert (repeat.inserted, repeat.updated) == (0, 0)
    assert contents(table) == after

    # the trailing days are replaced; a reading of another day does not wipe out that day
    write_day(base, "2024-01-04", [line("S9", "2024-01-04T00:00:00", 9), line("S9", "2023-12-01T00:00:00", 9), line("S1", "2024-01-01T00:00:00", 7)])
    result = P.reload_trailing_days(table, source, stations, dt.date(2024, 1, 5), days=1)
    final = contents(table)
    assert ("S1", at(4)) not in final and final[("S9", at(4))][0] == 9.0
    assert final[("S9", dt.datetime(2023, 12, 1))][0] == 9.0
    assert final[("S1", at(1))] == (7.0, "Good", "First", True) and final[("S2", at(1, 6))] == first[("S2", at(1, 6))]
    assert {row.r_date.day: row.rows_deleted for row in result.report.collect()}[4] == 2
    assert repeated_keys(table.read(), ("notation", "r_datetime")).count() == 0
    assert table.read().where("created is null").count() == 0


SNAPSHOT = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("at", T.TimestampType()), T.StructField("day", T.DateType())])


def test_delete_and_partition_writes(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), SNAPSHOT, ["k"], day="day", moment="at")
    assert table.read().count() == 0 and table.days().count() == 0
    rows = [(d * 10 + h, at(d, h), dt.date(2024, 1, d)) for d in range(1, 6) for h in range(4)]
    # one row is filed under a day that its timestamp does not belong to
    rows.append((99, at(1), dt.date(2024, 1, 3)))
    table.append(spark.createDataFrame(rows, SNAPSHOT))
    table.delete_between(dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    assert sorted(row.k for row in table.read().collect()) == [10, 11, 12, 13, 40, 41, 42, 43, 50, 51, 52, 53, 99]
    assert table.stored_days() == [dt.date(2024, 1, d) for d in (1, 3, 4, 5)]


def test_date_arguments(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), SNAPSHOT, ["k"], day="day", moment="at")
    table.append(spark.createDataFrame([(d, at(d), dt.date(2024, 1, d)) for d in range(1, 5)], SNAPSHOT))
    table.delete_between("2024-01-02", " 2024-01-03 ")
    assert sorted(row.k for row in table.read().collect()) == [1, 4]
    base, readings = str(tmp_path / "none"), P.readings_table(spark, str(tmp_path / "readings"))
    for call in (
        lambda: table.delete_between("2024-01-02", None),
        lambda: P.load_forced_days(readings, base, None, "02/01/2024"),
        lambda: P.load_forced_days(readings, base, None, "2024-01-02", "soon"),
        lambda: P.load_forced_days(readings, base, None, ""),
        lambda: P.load_new_days(readings, base, None, "2024-13-01"),
        lambda: P.reload_trailing_days(readings, base, None, ""),
        lambda: P.fill_gaps(readings, base, None, last="yesterday"),
    ):
        with pytest.raises(ValueError, match="date"):
            call()
    assert sorted(row.k for row in table.read().collect()) == [1, 4]


def test_upsert_reads_only_the_days_of_the_batch(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), SNAPSHOT, ["k"], ["at"], day="day", moment="at")
    table.append(spark.createDataFrame([(d, at(d), dt.date(2024, 1, d)) for d in range(1, 9)], SNAPSHOT))
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("day=2024-01-0[1-7]/*.parquet")}
    actions = table.upsert(spark.createDataFrame([(8, at(8, 1), dt.date(2024, 1, 8)), (9, at(8), dt.date(2024, 1, 8))], SNAPSHOT), [F.col("at")])
    assert {(row.k, row.action) for row in actions.collect()} == {(8, "updated"), (9, "inserted")}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("day=2024-01-0[1-7]/*.parquet")} == untouched


def test_a_large_day_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(300_000).select(
        F.col("id").cast("int").alias("k"), F.expr("timestamp '2024-01-01'").alias("at"),
        F.when(F.col("id") % 3 == 0, F.expr("date '2024-01-01'")).otherwise(F.expr("date_add(date '2024-01-02', cast(id % 20 as int))")).alias("day"),
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        DayTable(spark, str(tmp_path / "t"), SNAPSHOT, ["k"], day="day", moment="at").append(rows.repartition(6))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "t" / "day=2024-01-01").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 300_000


def test_alerts(spark, tmp_path):
    table = alert_table(spark, str(tmp_path / "alerts"))
    rows = [(1, dt.date(2024, 1, 1), "East", "c1", "x", "warning"), (2, dt.date(2024, 1, 2), "West", "c2", "y", "alert")]
    table.append(spark.createDataFrame(rows, ALERT_SCHEMA))
    table.append(spark.createDataFrame([(3, dt.date(2024, 1, 3), "East", "c1", "x", "alert")], ALERT_SCHEMA))
    ids = lambda **kw: sorted(row.floodalert_id for row in find_alerts(table.read(), **kw).collect())
    assert ids() == [1, 2, 3] and ids(fwdcode="c1") == [1, 3] and ids(area="West") == [2]
    assert ids(first=dt.date(2024, 1, 2)) == [2, 3] and ids(last=dt.date(2024, 1, 2)) == [1, 2]


def square(x, y):
    ring = [[x, y], [x + 0.1, y], [x + 0.1, y + 0.1], [x, y + 0.1], [x, y]]
    return json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}}]})


def test_area_refresh(spark, tmp_path):
    items = [
        {"@id": f"http://environment.data.gov.uk/flood-monitoring/id/floodAreas/{code}", "fwdCode": code, "county": "Kent", "description": "d",
         "eaAreaName": "East", "label": code, "riverOrSea": "Sea", "lat": 51.0, "long": 1.0}
        for code in ("A1", "A2", "A3")
    ]
    (tmp_path / "areas.json").write_text(json.dumps({"@context": "c", "meta": {"version": "0.9"}, "items": items}))
    polygons = tmp_path / "polygons"
    polygons.mkdir()
    (polygons / "A1.json").write_text(square(0, 50))
    (polygons / "A2.json").write_text(square(0, 52))
    tables = catalogues.refresh_areas(spark, str(tmp_path / "areas.json"), str(polygons), str(tmp_path / "tables"))
    view = {row.fwdcode: row for row in catalogues.register_area_view(tables).collect()}
    assert len(view) == 3 and view["A3"].area_m2 is None and view["A3"].lat is None
    # the same square of degrees is smaller further north
    assert (view["A1"]["rank"], view["A2"]["rank"]) == (1, 2)
    assert len(view["A1"]) == 21
    assert spark.sql("select count(*) from v_floodarea where county ilike '%ken%'").first()[0] == 3
    assert float(tables.read("meta").first().version) == 0.9


def test_refresh_replaces_the_whole_set(spark, tmp_path):
    tables = CatalogueTables(spark, str(tmp_path))
    assert tables.current_version() is None
    one = spark.createDataFrame([("a", 1), ("b", 2)], "json_id string, n int")
    tables.refresh({"t": one, "u": one.limit(1)})
    rejected = tables.append("t", spark.createDataFrame([("b", 9), ("c", 3)], "json_id string, n int"))
    assert [tuple(row) for row in rejected.collect()] == [("b", 9)]
    assert sorted((row.json_id, row.n) for row in tables.read("t").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    tables.refresh({"t": one.limit(1), "u": one})
    assert tables.read("t").count() == 1 and tables.read("u").count() == 2
    # a pointer that is not written in full counts for nothing
    (tmp_path / "current" / "9").mkdir()
    assert tables.read("u").count() == 2
    tables.remove_old()
    assert len(list(tmp_path.glob("version=*"))) == 1 and tables.read("u").count() == 2


def test_station_refresh(spark, tmp_path):
    document = {"meta": {}, "items": [{"@id": "s", "type": [{"@id": "t1"}, {"@id": "t2"}], "colocatedStation": [{"@id": "o"}]}]}
    (tmp_path / "stations.json").write_text(json.dumps(document))
    tables = catalogues.refresh_catalogue(spark, str(tmp_path / "stations.json"), str(tmp_path / "tables"), catalogues.HYDROLOGY_STATIONS)
    counts = {name: tables.read(name).count() for name in ("meta", "document", *catalogues.HYDROLOGY_STATIONS)}
    assert counts == {
        "meta": 1, "document": 1, "station": 1, "station_type": 2, "station_observed_property": 0, "station_status": 0,
        "station_measure": 0, "station_colocated": 1,
    }


def test_stream_equals_batch(spark, tmp_path, stations):
    base = tmp_path / "landed"
    for day in (1, 2, 3):
        write_day(base, f"2024-01-0{day}", [line("S1", f"2024-01-0{day}T{h:02d}:00:00", h) for h in range(5)] + ["broken,,,,,,,,,,"])
    batch = P.readings_table(spark, str(tmp_path / "batch"))
    P.load_forced_days(batch, str(base), stations, dt.date(2024, 1, 1), dt.date(2024, 1, 3))
    stream = P.readings_table(spark, str(tmp_path / "stream"))
    for _ in range(2):
        # the second run finds no new files; a fresh checkpoint replays all of them
        for checkpoint in ("one", "two"):
            source = stream_readings(spark, str(base), files_per_batch=1)
            upsert_stream(source, stream, stations, str(tmp_path / checkpoint)).awaitTermination()
        assert contents(stream) == contents(batch) and len(contents(stream)) == 15


def test_stream_refuses_other_headers(spark, tmp_path, stations):
    folder = tmp_path / "landed" / "2024"
    folder.mkdir(parents=True)
    (folder / "hydro-2024-01-01.csv").write_text("value,measure\n1,m\n")
    table = P.readings_table(spark, str(tmp_path / "t"))
    query = upsert_stream(stream_readings(spark, str(tmp_path / "landed")), table, stations, str(tmp_path / "c"))
    with pytest.raises(Exception):
        query.awaitTermination()
    assert table.stored_days() == []


def test_late_repeats(spark, tmp_path):
    schema = "notation string, r_datetime timestamp, value double"
    rows = [("a", at(20), 1.0), ("a", at(20), 1.0), ("a", at(10), 2.0), ("b", at(20), 3.0)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    kept = without_late_repeats(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    (
        kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    got = sorted(tuple(row) for row in spark.read.parquet(str(tmp_path / "out")).select("notation", "value").collect())
    assert got == [("a", 1.0), ("a", 2.0), ("b", 3.0)]
