"""WGS84 degrees to British National Grid metres and back.

The shift between the two datums is the published seven-parameter similarity
transform, good to about 5 m against the grid-file method. Formulas are the
Ordnance Survey's transverse Mercator series. Each step is a projection on
the one before, so that no intermediate result is computed twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

WGS84_SRID = 4326
BNG_SRID = 27700

# Ellipsoid axes in metres.
WGS84_A, WGS84_B = 6378137.0, 6356752.314245
AIRY_A, AIRY_B = 6377563.396, 6356256.909

# Datum shift from WGS84 to OSGB36 (metres, arc seconds, parts per million).
SHIFT_TX, SHIFT_TY, SHIFT_TZ = -446.448, 125.157, -542.060
SHIFT_RX, SHIFT_RY, SHIFT_RZ = -0.1502, -0.2470, -0.8421
SHIFT_SCALE = 20.4894

# The National Grid projection.
GRID_SCALE = 0.9996012717
GRID_LAT0, GRID_LON0 = 49.0, -2.0
GRID_E0, GRID_N0 = 400000.0, -100000.0

WGS84_E2 = 1 - (WGS84_B / WGS84_A) ** 2
AIRY_E2 = 1 - (AIRY_B / AIRY_A) ** 2
PHI0, LAM0 = math.radians(GRID_LAT0), math.radians(GRID_LON0)

_RX, _RY, _RZ = (math.radians(angle / 3600) for angle in (SHIFT_RX, SHIFT_RY, SHIFT_RZ))
_SCALE = 1 + SHIFT_SCALE * 1e-6
SHIFT = np.array([SHIFT_TX, SHIFT_TY, SHIFT_TZ])
TURN = np.array([[_SCALE, -_RZ, _RY], [_RZ, _SCALE, -_RX], [-_RY, _RX, _SCALE]])
TURN_BACK = np.linalg.inv(TURN)

NORTHING_ROUNDS = 6

# Named values of a point to the named values of the next step.
Values = Mapping[str, Column]
Stage = Callable[[Values], dict[str, Column]]


def _trig(p: Values) -> dict[str, Column]:
    return dict(sin_phi=F.sin(p["phi"]), cos_phi=F.cos(p["phi"]), sin_lam=F.sin(p["lam"]), cos_lam=F.cos(p["lam"]))


def _trig_of_degrees(p: Values) -> dict[str, Column]:
    return _trig(dict(phi=F.radians(p["lat"]), lam=F.radians(p["long"])))


def _shifted(a: float, e2: float, matrix: np.ndarray, offset: np.ndarray) -> Stage:
    """Point of one ellipsoid, given by sines and cosines, to axes of the other datum."""

    def apply(p: Values) -> dict[str, Column]:
        nu = a / F.sqrt(1 - e2 * p["sin_phi"] * p["sin_phi"])
        height = p.get("h", F.lit(0.0))
        axes = (
            (nu + height) * p["cos_phi"] * p["cos_lam"],
            (nu + height) * p["cos_phi"] * p["sin_lam"],
            ((1 - e2) * nu + height) * p["sin_phi"],
        )
        x, y, z = (
            sum((float(weight) * axis for weight, axis in zip(row, axes)), F.lit(float(shift)))
            for row, shift in zip(matrix, offset)
        )
        return dict(x=x, y=y, z=z)

    return apply


def _to_geodetic(a: float, b: float) -> list[Stage]:
    e2 = 1 - (b / a) ** 2
    second_e2 = (a / b) ** 2 - 1

    def polar(p: Values) -> dict[str, Column]:
        return dict(lam=F.atan2(p["y"], p["x"]), z=p["z"], flat=F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))

    def latitude(p: Values) -> dict[str, Column]:
        # Bowring's formula, exact to rounding for points near the surface
        u, v = p["z"] * a, p["flat"] * b
        size = F.sqrt(u * u + v * v)
        sine, cosine = u / size, v / size
        up = p["z"] + (second_e2 * b) * sine * sine * sine
        out = p["flat"] - (e2 * a) * cosine * cosine * cosine
        return dict(phi=F.atan2(up, out), lam=p["lam"], z=p["z"], flat=p["flat"])

    return [polar, latitude]


def _meridian_arc(phi: Column) -> Column:
    n = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
    minus, plus = phi - PHI0, phi + PHI0
    return (AIRY_B * GRID_SCALE) * (
        (1 + n + 5 / 4 * n**2 + 5 / 4 * n**3) * minus
        - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(minus) * F.cos(plus)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * minus) * F.cos(2 * plus)
        - (35 / 24 * n**3) * F.sin(3 * minus) * F.cos(3 * plus)
    )


def _curvature(p: Values, **carried: Column) -> dict[str, Column]:
    # nu and rho: radii of curvature across and along the meridian; t: squared tangent
    w = 1 - AIRY_E2 * p["s"] * p["s"]
    return dict(
        nu=AIRY_A * GRID_SCALE / F.sqrt(w),
        ratio=w / (1 - AIRY_E2),
        s=p["s"],
        c=p["c"],
        t=(p["s"] * p["s"]) / (p["c"] * p["c"]),
        **carried,
    )


def _project() -> list[Stage]:
    def trig(p: Values) -> dict[str, Column]:
        return dict(s=F.sin(p["phi"]), c=F.cos(p["phi"]), arc=_meridian_arc(p["phi"]), d=p["lam"] - LAM0)

    def radii(p: Values) -> dict[str, Column]:
        return _curvature(p, arc=p["arc"], d=p["d"])

    def grid(p: Values) -> dict[str, Column]:
        nu, ratio, s, c, t, d = (p[n] for n in ("nu", "ratio", "s", "c", "t", "d"))
        # powers of the longitude difference, scaled to the parallel
        q = c * d
        q2 = q * q
        eta2 = ratio - 1
        north2 = F.lit(0.5)
        north4 = (5 - t + 9 * eta2) / 24
        north6 = (61 - 58 * t + t * t) / 720
        east3 = (ratio - t) / 6
        east5 = (5 - 18 * t + t * t + 14 * eta2 - 58 * t * eta2) / 120
        return dict(
            x=GRID_E0 + nu * q * (1 + q2 * (east3 + q2 * east5)),
            y=GRID_N0 + p["arc"] + nu * s / c * q2 * (north2 + q2 * (north4 + q2 * north6)),
        )

    return [trig, radii, grid]


def _unproject() -> list[Stage]:
    def start(p: Values) -> dict[str, Column]:
        north = p["y"] - GRID_N0
        return dict(phi=north / (AIRY_A * GRID_SCALE) + PHI0, north=north, e=p["x"] - GRID_E0)

    def improve(p: Values) -> dict[str, Column]:
        step = (p["north"] - _meridian_arc(p["phi"])) / (AIRY_A * GRID_SCALE)
        return dict(phi=p["phi"] + step, north=p["north"], e=p["e"])

    def trig(p: Values) -> dict[str, Column]:
        return dict(s=F.sin(p["phi"]), c=F.cos(p["phi"]), phi=p["phi"], e=p["e"])

    def radii(p: Values) -> dict[str, Column]:
        return _curvature(p, phi=p["phi"], e=p["e"])

    def degrees(p: Values) -> dict[str, Column]:
        # u is the easting in units of nu, so every term of the series is dimensionless
        t, ratio = p["t"], p["ratio"]
        u = p["e"] / p["nu"]
        u2 = u * u
        eta2 = ratio - 1
        south2 = F.lit(0.5)
        south4 = (5 + 3 * t + eta2 - 9 * t * eta2) / 24
        south6 = (61 + 90 * t + 45 * t * t) / 720
        east3 = (ratio + 2 * t) / 6
        east5 = (5 + 28 * t + 24 * t * t) / 120
        east7 = (61 + 662 * t + 1320 * t * t + 720 * t * t * t) / 5040
        return dict(
            phi=p["phi"] - p["s"] / p["c"] * ratio * u2 * (south2 - u2 * (south4 - u2 * south6)),
            lam=LAM0 + u / p["c"] * (1 - u2 * (east3 - u2 * (east5 - u2 * east7))),
        )

    return [start, *([improve] * NORTHING_ROUNDS), trig, radii, degrees]


def _depth_below_wgs84(p: Values) -> dict[str, Column]:
    sine, cosine = F.sin(p["phi"]), F.cos(p["phi"])
    return dict(h=WGS84_A * F.sqrt(1 - WGS84_E2 * sine * sine) - p["flat"] * cosine - p["z"] * sine)


def _in_degrees(p: Values) -> dict[str, Column]:
    return dict(lat=F.degrees(p["phi"]), long=F.degrees(p["lam"]))


_WGS84_TO_AIRY = _shifted(WGS84_A, WGS84_E2, TURN, SHIFT)
_AIRY_TO_WGS84 = _shifted(AIRY_A, AIRY_E2, TURN_BACK, -TURN_BACK @ SHIFT)


def _run(df: DataFrame, stages: list[Stage], inputs: dict[str, str], tag: str) -> tuple[DataFrame, dict[str, str]]:
    """Add one projection per stage. Returns the frame and the columns that hold the last values."""
    names = inputs
    for number, stage in enumerate(stages):
        values = stage({name: F.col(f"`{column}`") for name, column in names.items()})
        names = {name: f"_{tag}{number}_{name}" for name in values}
        df = df.withColumns({names[name]: value for name, value in values.items()})
    return df, names


def _finished(df: DataFrame, kept: list[str], results: dict[str, str]) -> DataFrame:
    return df.select(
        *[F.col(f"`{name}`") for name in kept], *[F.col(column).alias(name) for name, column in results.items()]
    )


def with_bng(df: DataFrame, lat: str = "lat", long: str = "long", x: str = "x", y: str = "y") -> DataFrame:
    """Add grid metres ``x, y`` of WGS84 degrees; null if a coordinate is null."""
    stages = [_trig_of_degrees, _WGS84_TO_AIRY, *_to_geodetic(AIRY_A, AIRY_B), *_project()]
    done, names = _run(df, stages, {"lat": lat, "long": long}, "f")
    return _finished(done, df.columns, {x: names["x"], y: names["y"]})


def with_grid(df: DataFrame, lat: str = "lat", long: str = "long", x: str = "x", y: str = "y") -> DataFrame:
    """Add grid metres ``x, y`` of degrees that are already on the Airy ellipsoid."""
    def in_radians(p: Values) -> dict[str, Column]:
        return dict(phi=F.radians(p["lat"]), lam=F.radians(p["long"]))

    done, names = _run(df, [in_radians, *_project()], {"lat": lat, "long": long}, "f")
    return _finished(done, df.columns, {x: names["x"], y: names["y"]})


def with_wgs84(df: DataFrame, x: str = "x", y: str = "y", lat: str = "lat", long: str = "long") -> DataFrame:
    """Add WGS84 degrees ``lat, long`` of grid metres; null if a coordinate is null.

    Points of the Airy surface lie off the WGS84 one. They are moved there
    first, which makes this the inverse of :func:`with_bng`.
    """
    airy, point = _run(df, [*_unproject(), _trig], {"x": x, "y": y}, "u")
    surface = [_AIRY_TO_WGS84, *_to_geodetic(WGS84_A, WGS84_B)]
    seen, height = _run(airy, [*surface, _depth_below_wgs84], point, "h")
    done, names = _run(seen, [*surface, _in_degrees], {**point, **height}, "b")
    return _finished(done, df.columns, {lat: names["lat"], long: names["long"]})


def tagged_point(srid: int, x: Column, y: Column) -> Column:
    """``struct<srid, x, y>``; null if a coordinate is null."""
    point = F.struct(F.lit(srid).alias("srid"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.when(x.isNotNull() & y.isNotNull(), point)


def with_points(df: DataFrame, lat: str = "lat", long: str = "long") -> DataFrame:
    """Add ``geom4326`` (x is the longitude) and ``geom27700``; both null if a coordinate is null."""
    grid = with_bng(df, lat, long, "_x", "_y")
    return grid.withColumns(
        {
            "geom4326": tagged_point(WGS84_SRID, F.col(long), F.col(lat)),
            "geom27700": tagged_point(BNG_SRID, F.col("_x"), F.col("_y")),
        }
    ).drop("_x", "_y")
