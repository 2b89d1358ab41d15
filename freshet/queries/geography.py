"""Queries on points, polygons and their measures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import geodesy as G
from ..functions.geometry import geojson_multipolygon
from ..functions.wkb import point_wkb
from ..operators import area_metrics as M
from ..operators.filters import overlaps_viewport
from ..session import staged
from .inputs import BOXES, STATIONS, derive, plain
from .registry import query

# --- GeoJSON texts of the boxes -------------------------------------------------

_CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))


def _position(x: str, y: str) -> str:
    return ", ',', ".join(
        [f"'[', cast(cast({x} as decimal(12, 6)) as string)", f"cast(cast({y} as decimal(12, 6)) as string), ']'"]
    )


def _ring(x: str, y: str, w: str, h: str, reverse: bool = False) -> str:
    corners = reversed(_CORNERS) if reverse else _CORNERS
    positions = [_position(f"{x} + {fx} * ({w})", f"{y} + {fy} * ({h})") for fx, fy in corners]
    return "'[', " + ", ',', ".join(positions) + ", ']'"


def _feature(kind: str, coordinates: str) -> str:
    head = '{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":{{"type":"' + kind + '","coordinates":['
    return f"concat('{head}', {coordinates}, " + "']}}}}]}}')"


_OUTER = _ring("x0", "y0", "w", "h")
_OUTER_REVERSED = _ring("x0", "y0", "w", "h", reverse=True)
_HOLE = _ring("x0 + w * 0.25", "y0 + h * 0.25", "w * 0.25", "h * 0.25")
_SECOND = _ring("x0 + w * 2", "y0 + h * 2", "w * 0.5", "h * 0.5")

# a tenth of the areas has no document and another tenth a document without features
POLYGONS = f"""
select floodarea_id, fwdcode, case
  when floodarea_id % 10 = 3 then null
  when floodarea_id % 10 = 7 then '{{{{"features":[]}}}}'
  when kind = 1 then {_feature('Polygon', _OUTER + ", ',', " + _HOLE)}
  when kind = 2 then {_feature('MultiPolygon', "'[', " + _OUTER + ", '],[', " + _SECOND + ", ']'")}
  when floodarea_id % 2 = 1 then {_feature('Polygon', _OUTER_REVERSED)}
  else {_feature('Polygon', _OUTER)} end as polygon_json
from ({BOXES}) b
"""

POLYGON_TEXT = plain(POLYGONS)


def polygons(spark, sf_dir) -> DataFrame:
    """The polygon documents, written out as they would have landed."""
    return staged(derive(spark, sf_dir, POLYGONS), "polygon-documents")


# --- the same measures in plain SQL ---------------------------------------------


def _constants() -> dict[str, float]:
    n = (G.AIRY_A - G.AIRY_B) / (G.AIRY_A + G.AIRY_B)
    return {
        "wa": G.WGS84_A,
        "we": 1 - G.WGS84_B**2 / G.WGS84_A**2,
        "aa": G.AIRY_A,
        "ae": 1 - G.AIRY_B**2 / G.AIRY_A**2,
        "f0": G.GRID_SCALE,
        "m": 1 + G.SHIFT_SCALE / 1e6,
        "rx": math.radians(G.SHIFT_RX / 3600),
        "ry": math.radians(G.SHIFT_RY / 3600),
        "rz": math.radians(G.SHIFT_RZ / 3600),
        "tx": G.SHIFT_TX,
        "ty": G.SHIFT_TY,
        "tz": G.SHIFT_TZ,
        "k0": math.radians(G.GRID_LAT0),
        "l0": math.radians(G.GRID_LON0),
        "bf": G.AIRY_B * G.GRID_SCALE,
        "c1": 1 + n + 1.25 * n**2 + 1.25 * n**3,
        "c2": 3 * n + 3 * n**2 + 2.625 * n**3,
        "c3": 1.875 * n**2 + 1.875 * n**3,
        "c4": 35 / 24 * n**3,
    }


def _literal(value: float) -> str:
    return f"(cast('{value!r}' as double))"


def bng_sql(rows: str) -> str:
    """Rows with grid ``e`` and ``n`` for their doubles ``lon`` and ``lat``."""
    k = {name: _literal(value) for name, value in _constants().items()}
    steps = [
        "radians(lat) as p, radians(lon) as l",
        f"{k['wa']} / sqrt(1 - {k['we']} * sin(p) * sin(p)) as nu0",
        f"nu0 * cos(p) * cos(l) as xa, nu0 * cos(p) * sin(l) as ya, (1 - {k['we']}) * nu0 * sin(p) as za",
        f"{k['tx']} + {k['m']} * xa - {k['rz']} * ya + {k['ry']} * za as xb, "
        f"{k['ty']} + {k['rz']} * xa + {k['m']} * ya - {k['rx']} * za as yb, "
        f"{k['tz']} - {k['ry']} * xa + {k['rx']} * ya + {k['m']} * za as zb",
        "sqrt(xb * xb + yb * yb) as flat, atan2(yb, xb) as lam",
        f"atan2(zb, flat * (1 - {k['ae']})) as q0",
        *[
            f"atan2(zb + {k['ae']} * {k['aa']} / sqrt(1 - {k['ae']} * sin(q{i}) * sin(q{i})) * sin(q{i}), flat) as q{i + 1}"
            for i in range(5)
        ],
        f"{k['aa']} * {k['f0']} / sqrt(1 - {k['ae']} * sin(q5) * sin(q5)) as nu, "
        f"{k['aa']} * {k['f0']} * (1 - {k['ae']}) / pow(1 - {k['ae']} * sin(q5) * sin(q5), 1.5) as rho, "
        f"lam - {k['l0']} as d, sin(q5) as s, cos(q5) as c, tan(q5) * tan(q5) as t, "
        f"{k['bf']} * ({k['c1']} * (q5 - {k['k0']}) - {k['c2']} * sin(q5 - {k['k0']}) * cos(q5 + {k['k0']}) "
        f"+ {k['c3']} * sin(2 * (q5 - {k['k0']})) * cos(2 * (q5 + {k['k0']})) "
        f"- {k['c4']} * sin(3 * (q5 - {k['k0']})) * cos(3 * (q5 + {k['k0']}))) as arc",
        "nu / rho - 1 as h2",
        "400000 + nu * c * d + nu / 6 * pow(c, 3) * (nu / rho - t) * pow(d, 3) "
        "+ nu / 120 * pow(c, 5) * (5 - 18 * t + t * t + 14 * h2 - 58 * t * h2) * pow(d, 5) as e, "
        "arc - 100000 + nu / 2 * s * c * pow(d, 2) + nu / 24 * s * pow(c, 3) * (5 - t + 9 * h2) * pow(d, 4) "
        "+ nu / 720 * s * pow(c, 5) * (61 - 58 * t + t * t) * pow(d, 6) as n",
    ]
    text = rows
    for number, step in enumerate(steps):
        text = f"select *, {step} from ({text}) g{number}"
    return text


_BOX_SQL = f"select * from ({plain(BOXES)}) b where floodarea_id % 10 not in (3, 7)"

_RINGS = f"""
select floodarea_id, 0 as ring, 1 as sign, x0 as x, y0 as y, w, h from ({_BOX_SQL}) b0
union all select floodarea_id, 1, -1, x0 + w * 0.25, y0 + h * 0.25, w * 0.25, h * 0.25 from ({_BOX_SQL}) b1 where kind = 1
union all select floodarea_id, 1, 1, x0 + w * 2, y0 + h * 2, w * 0.5, h * 0.5 from ({_BOX_SQL}) b2 where kind = 2
"""

_VERTICES = f"""
select floodarea_id, ring, sign, seq, cast(cast(x + fx * w as decimal(12, 6)) as double) as lon,
  cast(cast(y + fy * h as decimal(12, 6)) as double) as lat
from ({_RINGS}) r cross join (values (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) as v(seq, fx, fy)
"""

# all measures of the measured areas, unrounded
METRIC_SQL = f"""
with v as (select floodarea_id, ring, sign, seq, lon, lat, e, n from ({bng_sql(_VERTICES)}) g),
edge as (
  select a.floodarea_id, a.ring, a.sign, z.e as oe, z.n as onn,
    (a.e - z.e) * (b.n - z.n) - (b.e - z.e) * (a.n - z.n) as cr, a.e + b.e - 2 * z.e as se, a.n + b.n - 2 * z.n as sn
  from v a join v b on a.floodarea_id = b.floodarea_id and a.ring = b.ring and b.seq = a.seq + 1
  join v z on a.floodarea_id = z.floodarea_id and z.ring = 0 and z.seq = 0),
ringsum as (
  select floodarea_id, ring, sign, any_value(oe) as oe, any_value(onn) as onn, sum(cr) as cr, sum(cr * se) as me, sum(cr * sn) as mn
  from edge group by floodarea_id, ring, sign),
mass as (
  select floodarea_id, sum(sign * abs(cr) / 2) as area_m2,
    any_value(oe) + sum(sign * sign(cr) * me / 6) / sum(sign * abs(cr) / 2) as cen_e,
    any_value(onn) + sum(sign * sign(cr) * mn / 6) / sum(sign * abs(cr) / 2) as cen_n
  from ringsum group by floodarea_id),
box as (
  select floodarea_id, min(lat) as min_lat, min(lon) as min_long, max(lat) as max_lat, max(lon) as max_long,
    min(e) as min_e, min(n) as min_n, max(e) as max_e, max(n) as max_n
  from v where sign = 1 group by floodarea_id),
mass84 as (
  select floodarea_id, sum(sign * w * h * (x + w * 0.5)) / sum(sign * w * h) as cen_long,
    sum(sign * w * h * (y + h * 0.5)) / sum(sign * w * h) as cen_lat
  from (select floodarea_id, sign, cast(x as double) as x, cast(y as double) as y, cast(w as double) as w, cast(h as double) as h
    from ({_RINGS}) r) d group by floodarea_id)
select box.*, area_m2, area_m2 / 1e6 as area_km2, cen_e, cen_n, cen_long, cen_lat,
  (min_lat + max_lat) / 2 as bcen_lat, (min_long + max_long) / 2 as bcen_long,
  (min_e + max_e) / 2 as bcen_e, (min_n + max_n) / 2 as bcen_n
from box join mass using (floodarea_id) join mass84 using (floodarea_id)
"""


def metrics(spark, sf_dir) -> DataFrame:
    return M.area_metrics(polygons(spark, sf_dir))


def rounded(name: str, places: int, alias: str | None = None):
    return F.round(F.col(name), places).alias(alias or name)


def millimetres(name: str, alias: str | None = None):
    """A grid coordinate as whole millimetres, cut off where rounded values never lie."""
    return F.floor(F.col(name) * 1000 + 0.3).alias(alias or f"{name}_mm")


# --- queries --------------------------------------------------------------------


@query(
    "point_to_bng",
    f"""select notation, round(e, 3) as x, round(n, 3) as y
        from ({bng_sql('select notation, lat, long as lon from (' + plain(STATIONS) + ') s')}) p""",
)
def point_to_bng(spark, sf_dir):
    located = G.with_points(derive(spark, sf_dir, STATIONS))
    return located.select("notation", rounded("geom27700.x", 3, "x"), rounded("geom27700.y", 3, "y"))


@query(
    "bng_roundtrip",
    f"select notation, round(lat, 8) as lat, round(long, 8) as long, 4326 as srid from ({plain(STATIONS)}) s",
)
def bng_roundtrip(spark, sf_dir):
    grid = G.with_bng(derive(spark, sf_dir, STATIONS)).drop("lat", "long")
    back = G.with_points(G.with_wgs84(grid))
    return back.select(
        "notation", rounded("geom4326.y", 8, "lat"), rounded("geom4326.x", 8, "long"), F.col("geom4326.srid").alias("srid")
    )


@query(
    "geojson_shapes",
    f"""select floodarea_id, case when floodarea_id % 10 in (3, 7) then null when kind = 2 then 2 else 1 end as n_parts,
          case when floodarea_id % 10 in (3, 7) then null when kind = 0 then 1 else 2 end as n_rings
        from ({plain(BOXES)}) b""",
)
def geojson_shapes(spark, sf_dir):
    shapes = polygons(spark, sf_dir).withColumn("g", geojson_multipolygon(F.col("polygon_json")))
    present = F.col("g").isNotNull()
    return shapes.select(
        "floodarea_id",
        F.when(present, F.size("g")).alias("n_parts"),
        F.when(present, F.size(F.flatten("g"))).alias("n_rings"),
    )


@query(
    "polygon_bbox",
    f"""select floodarea_id, min_lat as bbox_wgs84_min_lat, min_long as bbox_wgs84_min_long, max_lat as bbox_wgs84_max_lat,
          max_long as bbox_wgs84_max_long, round(bcen_lat, 6) as bcen_wgs84_lat, round(bcen_long, 6) as bcen_wgs84_long,
          cast(floor(round(min_n, 6) * 1000 + 0.3) as bigint) as bbox_bng_min_lat_mm, cast(floor(round(min_e, 6) * 1000 + 0.3) as bigint) as bbox_bng_min_long_mm, cast(floor(round(max_n, 6) * 1000 + 0.3) as bigint) as bbox_bng_max_lat_mm,
          cast(floor(round(max_e, 6) * 1000 + 0.3) as bigint) as bbox_bng_max_long_mm, cast(floor(round(bcen_n, 6) * 1000 + 0.3) as bigint) as bcen_bng_lat_mm, cast(floor(round(bcen_e, 6) * 1000 + 0.3) as bigint) as bcen_bng_long_mm
        from ({METRIC_SQL}) m""",
)
def polygon_bbox(spark, sf_dir):
    corners = [f"bbox_{{}}_{corner}_{axis}" for corner in ("min", "max") for axis in ("lat", "long")]
    return metrics(spark, sf_dir).select(
        "floodarea_id",
        *[corner.format("wgs84") for corner in corners],
        "bcen_wgs84_lat",
        "bcen_wgs84_long",
        *[millimetres(corner.format("bng")) for corner in corners],
        millimetres("bcen_bng_lat"),
        millimetres("bcen_bng_long"),
    )


@query(
    "polygon_centroid",
    f"""select floodarea_id, round(cen_lat, 6) as mpoly_cent_wgs84_lat, round(cen_long, 6) as mpoly_cent_wgs84_long,
          cast(floor(round(cen_n, 6) * 1000 + 0.3) as bigint) as mpoly_cent_bng_lat_mm, cast(floor(round(cen_e, 6) * 1000 + 0.3) as bigint) as mpoly_cent_bng_long_mm from ({METRIC_SQL}) m""",
)
def polygon_centroid(spark, sf_dir):
    return metrics(spark, sf_dir).select(
        "floodarea_id",
        "mpoly_cent_wgs84_lat",
        "mpoly_cent_wgs84_long",
        millimetres("mpoly_cent_bng_lat"),
        millimetres("mpoly_cent_bng_long"),
    )


@query(
    "polygon_area",
    f"select floodarea_id, round(area_m2, 1) as area_m2, round(area_km2, 6) as area_km2 from ({METRIC_SQL}) m",
)
def polygon_area(spark, sf_dir):
    return metrics(spark, sf_dir).select("floodarea_id", rounded("area_m2", 1), rounded("area_km2", 6))


@query(
    "unmeasured_areas",
    f"select floodarea_id, fwdcode from ({plain(BOXES)}) b where floodarea_id % 10 in (3, 7)",
)
def unmeasured_areas(spark, sf_dir):
    documents = polygons(spark, sf_dir)
    return M.unmeasured_areas(documents, M.area_metrics(documents)).select("floodarea_id", "fwdcode")


# box areas in square degrees (millionths), with many ties
@query(
    "area_rank",
    f"""select floodarea_id, cast(w * h * 1000000 as bigint) as size, rank() over (order by w * h desc) as rank
        from ({plain(BOXES)}) b""",
)
def area_rank(spark, sf_dir):
    size = (F.col("w") * F.col("h") * 1_000_000).cast("long")
    return M.with_rank(derive(spark, sf_dir, BOXES).select("floodarea_id", size.alias("size")), "size")


@query(
    "metrics_projection",
    f"""select floodarea_id, cast(floor(round(min_n, 6) * 1000 + 0.3) as bigint) as bbox_bng_min_lat_mm, cast(floor(round(max_e, 6) * 1000 + 0.3) as bigint) as bbox_bng_max_long_mm,
          cast(floor(round(bcen_n, 6) * 1000 + 0.3) as bigint) as bcen_bng_lat_mm, cast(floor(round(cen_e, 6) * 1000 + 0.3) as bigint) as mpoly_cent_bng_long_mm, round(bcen_lat, 6) as bcen_wgs84_lat,
          round(cen_long, 6) as mpoly_cent_wgs84_long, min_lat as bbox_wgs84_min_lat,
          rank() over (order by round(area_m2, 1) desc) as rank
        from ({METRIC_SQL}) m""",
)
def metrics_projection(spark, sf_dir):
    packed = staged(M.packed_metrics(polygons(spark, sf_dir)), "packed-metrics")
    ranked = M.with_rank(packed.withColumn("_size", F.round("area_m2", 1)), "_size")
    flat = M.unpacked_metrics(ranked)
    return flat.select(
        "floodarea_id",
        millimetres("bbox_bng_min_lat"),
        millimetres("bbox_bng_max_long"),
        millimetres("bcen_bng_lat"),
        millimetres("mpoly_cent_bng_long"),
        "bcen_wgs84_lat",
        "mpoly_cent_wgs84_long",
        "bbox_wgs84_min_lat",
        "rank",
    )


@query(
    "bbox_geometry",
    f"""select floodarea_id, 4326 as srid, 5 as n_positions, max_long as first_x, min_lat as first_y, cast(floor(round(cen_e, 6) * 1000 + 0.3) as bigint) as centroid_x_mm,
          27700 as centroid_srid
        from ({METRIC_SQL}) m""",
)
def bbox_geometry(spark, sf_dir):
    ring = F.col("geom_bbox_wgs84.coordinates")[0]
    return metrics(spark, sf_dir).select(
        "floodarea_id",
        F.col("geom_bbox_wgs84.srid").alias("srid"),
        F.size(ring).alias("n_positions"),
        ring[0][0].alias("first_x"),
        ring[0][1].alias("first_y"),
        millimetres("geom_mpoly_cent_bng.x", "centroid_x_mm"),
        F.col("geom_mpoly_cent_bng.srid").alias("centroid_srid"),
    )


@query(
    "point_wkb",
    f"""select notation, 25 as n_bytes, '0101000020E6100000' as wgs84_head, '0101000020346C0000' as bng_head
        from ({plain(STATIONS)}) s""",
)
def point_wkb_rows(spark, sf_dir):
    located = G.with_points(derive(spark, sf_dir, STATIONS))
    binary = located.select(
        "notation", point_wkb(F.col("geom4326")).alias("wgs84"), point_wkb(F.col("geom27700")).alias("bng")
    )
    return binary.select(
        "notation",
        F.length("bng").alias("n_bytes"),
        F.substring(F.hex("wgs84"), 1, 18).alias("wgs84_head"),
        F.substring(F.hex("bng"), 1, 18).alias("bng_head"),
    )


@query(
    "area_overlap",
    f"""select floodarea_id from ({METRIC_SQL}) m
        where min_lat <= 53.25 and max_lat >= 51.0 and min_long <= -1.0 and max_long >= -3.5""",
)
def area_overlap(spark, sf_dir):
    return overlaps_viewport(metrics(spark, sf_dir), 51.0, -3.5, 53.25, -1.0).select("floodarea_id")
