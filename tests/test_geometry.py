"""Grid transform and polygon measures."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from freshet.functions import geodesy as G
from freshet.functions.wkb import multipolygon_wkb, point_wkb
from freshet.operators import area_metrics as M


def collection(kind, coordinates):
    return json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": kind, "coordinates": coordinates}}]})


def rectangle(x, y, w, h, reverse=False):
    ring = [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    return ring[::-1] if reverse else ring


SHAPES = {
    1: collection("Polygon", [rectangle(0, 50, 0.2, 0.1)]),
    2: collection("Polygon", [rectangle(0, 50, 0.2, 0.1, reverse=True)]),
    3: collection("Polygon", [rectangle(0, 50, 0.4, 0.4), rectangle(0.1, 50.1, 0.1, 0.1)]),
    4: collection("MultiPolygon", [[rectangle(0, 50, 0.4, 0.4), rectangle(0.1, 50.1, 0.1, 0.1)], [rectangle(1, 51, 0.2, 0.1)]]),
    5: '{"features":[]}',
    6: "not json",
    7: None,
    8: collection("Point", [1, 2]),
    9: collection("Polygon", [rectangle(0, 50, 0.2, 0.1)[:-1]]),
}


@pytest.fixture(scope="module")
def polygons(spark):
    return spark.createDataFrame([(i, f"A{i}", text) for i, text in SHAPES.items()], "floodarea_id long, fwdcode string, polygon_json string")


def test_published_grid_point(spark):
    lat = 52 + 39 / 60 + 27.2531 / 3600
    long = 1 + 43 / 60 + 4.5177 / 3600
    row = G.with_grid(spark.createDataFrame([(lat, long)], "lat double, long double")).first()
    assert abs(row.x - 651409.903) < 0.001 and abs(row.y - 313177.270) < 0.001


def test_whole_chain(spark):
    rows = spark.createDataFrame([(51.5074, -0.1278), (None, 1.0), (1.0, None)], "lat double, long double")
    first, *rest = G.with_points(rows).collect()
    assert abs(first.geom27700.x - 530028.75) < 0.01 and abs(first.geom27700.y - 180380.10) < 0.01
    assert (first.geom4326.srid, first.geom4326.x, first.geom4326.y) == (4326, -0.1278, 51.5074)
    assert first.geom27700.srid == 27700
    assert all(row.geom4326 is None and row.geom27700 is None for row in rest)


def test_round_trip_below_a_millimetre(spark):
    points = [(49.9 + i * 0.5, -6.0 + j * 0.8) for i in range(22) for j in range(11)]
    rows = spark.createDataFrame(points, "lat double, long double")
    back = G.with_wgs84(G.with_bng(rows), lat="lat2", long="long2").collect()
    assert len(back) == len(points)
    assert max(abs(r.lat - r.lat2) for r in back) * 111_000 < 0.001
    assert max(abs(r.long - r.long2) for r in back) * 111_000 < 0.001


def test_polygon_measures(polygons):
    rows = {row.floodarea_id: row for row in M.area_metrics(polygons).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 9]
    one = rows[1]
    assert (one.bbox_wgs84_min_lat, one.bbox_wgs84_min_long, one.bbox_wgs84_max_lat, one.bbox_wgs84_max_long) == (50, 0, 50.1, 0.2)
    assert (one.bcen_wgs84_lat, one.bcen_wgs84_long) == (50.05, 0.1)
    assert (one.mpoly_cent_wgs84_lat, one.mpoly_cent_wgs84_long) == (50.05, 0.1)
    for other in (2, 9):
        assert math.isclose(rows[other].area_m2, one.area_m2, rel_tol=1e-12)
        assert rows[other].mpoly_cent_bng_lat == one.mpoly_cent_bng_lat
    assert math.isclose(one.area_km2 * 1e6, one.area_m2)
    # 0.16 - 0.01 square degrees about 50.2, then 0.02 more at (1.1, 51.05)
    hole_x = (0.16 * 0.2 - 0.01 * 0.15) / 0.15
    assert rows[3].mpoly_cent_wgs84_long == round(hole_x, 6)
    assert rows[4].mpoly_cent_wgs84_long == round((0.15 * hole_x + 0.02 * 1.1) / 0.17, 6)
    assert (rows[4].bbox_wgs84_max_lat, rows[4].bbox_wgs84_max_long) == (51.1, 1.2)
    assert rows[1].bbox_bng_min_lat < rows[1].mpoly_cent_bng_lat < rows[1].bbox_bng_max_lat


def test_areas_without_a_polygon_are_reported(polygons):
    assert sorted(row.floodarea_id for row in M.unmeasured_areas(polygons, M.area_metrics(polygons)).collect()) == [5, 6, 7, 8]


def test_packing_is_reversible(polygons):
    flat = M.with_rank(M.area_metrics(polygons))
    unpacked = M.unpacked_metrics(M.with_rank(M.packed_metrics(polygons)))
    names = unpacked.columns
    assert sorted(map(tuple, unpacked.collect())) == sorted(map(tuple, flat.select(*names).collect()))


def test_bounding_box_geometry(polygons):
    row = M.area_metrics(polygons).where("floodarea_id = 1").first()
    ring = row.geom_bbox_wgs84.coordinates[0]
    assert len(ring) == 5 and ring[0] == ring[-1] == [0.2, 50.0]
    assert row.geom_bbox_bng.srid == 27700
    assert row.geom_mpoly_cent_bng.x == row.mpoly_cent_bng_long


def test_rank_with_a_hot_value(spark):
    # a third of the rows share one value
    values = [5.0] * 100 + [float(i) for i in range(200)] + [None]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, area_m2 double").repartition(7)
    got = {row.i: row["rank"] for row in M.with_rank(rows).collect()}
    for i, value in enumerate(values):
        assert got[i] == (None if value is None else 1 + sum(v is not None and v > value for v in values))


def test_point_wkb(spark):
    rows = G.with_points(spark.createDataFrame([(51.5, -0.25), (None, None)], "lat double, long double"))
    first, second = [row[0] for row in rows.select(point_wkb(F.col("geom4326"))).collect()]
    assert struct.unpack("<BIIdd", first) == (1, 0x20000001, 4326, -0.25, 51.5)
    assert second is None


def test_multipolygon_wkb(polygons):
    from freshet.functions.geometry import geojson_multipolygon

    shapes = polygons.select("floodarea_id", geojson_multipolygon(F.col("polygon_json")).alias("g"))
    got = {row.floodarea_id: row.w for row in shapes.select("floodarea_id", multipolygon_wkb(F.col("g"), 4326).alias("w")).collect()}
    assert struct.unpack("<BIII", got[4][:13]) == (1, 0x20000006, 4326, 2)
    # part header, two rings of five positions; part header, one ring
    assert len(got[4]) == 13 + 9 + 2 * (4 + 5 * 16) + 9 + 4 + 5 * 16
    assert struct.unpack("<dd", got[1][13 + 9 + 4 : 13 + 9 + 4 + 16]) == (0.0, 50.0)
    assert got[7] is None and got[5] is None
