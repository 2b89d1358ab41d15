"""Scans of landed files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from freshet.operators import catalogue as C
from freshet.sources import area_files, envelopes, polygon_files, reading_files
from freshet.sources.sql import read_sql


def write_day(base, day, text):
    folder = base / day[:4]
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"hydro-{day}.csv").write_text(text)


@pytest.fixture
def landed(tmp_path):
    write_day(tmp_path, "2023-12-31", "measure,dateTime,value\nm1,2023-12-31T00:00:00,1.5\nm2,2023-12-31T00:15:00,NaN\n")
    write_day(tmp_path, "2024-01-01", "value,extra,measure\n2.5,x,m1\n 12 ,y,null\n")
    write_day(tmp_path, "2024-01-02", "")
    write_day(tmp_path, "2024-01-03", "measure,dateTime,value\n")
    (tmp_path / "2024" / "notes.csv").write_text("measure\nno reading\n")
    return str(tmp_path)


def test_columns_are_matched_by_name(spark, landed):
    rows = reading_files.scan_readings(spark, landed).select("source", "measure", "dateTime", "value", "quality").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [
            ("hydro-2023-12-31", "m1", "2023-12-31T00:00:00", "1.5", None),
            ("hydro-2023-12-31", "m2", "2023-12-31T00:15:00", None, None),
            ("hydro-2024-01-01", "m1", None, "2.5", None),
            ("hydro-2024-01-01", None, None, " 12 ", None),
        ],
        key=str,
    )


def test_quoted_cells(spark, tmp_path):
    write_day(tmp_path, "2024-01-01", 'measure,quality\n"m,1","said ""ok"""\n')
    row = reading_files.scan_readings(spark, str(tmp_path)).first()
    assert (row.measure, row.quality, row.value) == ("m,1", 'said "ok"', None)


def test_days_select_files(spark, landed):
    rows = reading_files.scan_readings(spark, landed, [dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
    assert {row.source for row in rows.collect()} == {"hydro-2024-01-01"}
    assert reading_files.scan_readings(spark, landed, []).count() == 0


def test_unusable_days(spark, landed):
    files = reading_files.list_reading_files(spark, landed)
    unusable = reading_files.unusable_days(files, reading_files.scan_readings(spark, landed))
    assert sorted(row.day for row in unusable.collect()) == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]


def test_limits(spark, landed):
    rows = reading_files.scan_readings(spark, landed)
    assert reading_files.limited(rows, 3).count() == 3
    assert reading_files.limit_reached(rows, limit=2).count() == 2
    assert reading_files.limit_reached(rows, limit=3).count() == 0


def test_areas_with_quoted_text(spark, tmp_path):
    path = tmp_path / "areas.csv"
    path.write_text('fwdcode,eaareaname,county,description,label,riverorsea\n1,East,,"a, ""b""\nc",NA,River\n')
    row = area_files.read_areas(spark, str(path)).first()
    assert row.asDict() == {
        "fwdcode": "1", "eaareaname": "East", "county": None, "description": 'a, "b"\nc', "label": None, "riverorsea": "River",
    }


@pytest.fixture
def documents(tmp_path):
    first = {
        "@context": "ctx",
        "meta": {"@id": "m", "license": "L", "version": "0.9", "hasFormat": ["a", "b"]},
        "items": [
            {"@id": "s1", "label": "One", "lat": 51.5, "long": -0.12, "RLOIid": ["1", "2"], "unknown": {"x": 1.10},
             "status": [{"@id": "st", "label": {"@id": "open"}}], "measures": [{"@id": "m1", "period": 900}]},
            {"@id": "s2", "RLOIid": "7", "lat": None, "sampleOf": "text", "status": [{"@id": "st", "label": "closed"}]},
        ],
    }
    second = {"meta": {"licence": "M", "licenceName": "N"}, "items": []}
    (tmp_path / "a.json").write_text(json.dumps(first, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(second))
    return str(tmp_path)


def test_envelopes(spark, documents):
    found = envelopes.read_envelopes(spark, documents)
    meta = {row.license: row for row in envelopes.envelope_meta(found).collect()}
    assert set(meta) == {"L", "M"}
    assert meta["L"].has_format == ["a", "b"] and meta["L"].context == "ctx" and meta["M"].license_name == "N"
    items = envelopes.envelope_items(found)
    stations = {row.json_id: row for row in C.hydrology_stations(items).collect()}
    assert stations["s1"].rloi_id == "1,2" and stations["s2"].rloi_id == "7"
    assert stations["s1"].geom27700 is not None and stations["s2"].geom4326 is None
    assert stations["s2"].sample_of_id is None and stations["s2"].catchment_area == 0.0
    statuses = {tuple(row) for row in C.station_statuses(items).collect()}
    assert statuses == {("s1", "st", "open"), ("s2", "st", "closed")}
    assert [tuple(row) for row in C.station_measures(items).collect()] == [("s1", "m1", None, 900, None)]
    raw = {row.json_id: json.loads(row.document) for row in C.raw_documents(items).collect()}
    assert raw["s1"]["unknown"] == {"x": 1.1}
    counts = sorted((row.n_items, row.n_loaded) for row in envelopes.item_counts(found, C.hydrology_stations(items)).collect())
    assert counts == [(0, 0), (2, 2)]


def test_polygon_documents(spark, tmp_path):
    (tmp_path / "034WAF.json").write_text('{\n"features": []\n}')
    (tmp_path / "035WAF").write_text("{}")
    rows = {row.fwdcode: row.polygon_json for row in polygon_files.read_polygon_documents(spark, str(tmp_path)).collect()}
    assert rows == {"034WAF": '{\n"features": []\n}', "035WAF": "{}"}


def test_parameterised_sql(spark):
    frame = spark.createDataFrame([("Cambs",), ("Kent",)], "county string")
    rows = read_sql(spark, "select * from {areas} where county ilike :county", {"county": "%cam%"}, areas=frame)
    assert [row.county for row in rows.collect()] == ["Cambs"]
