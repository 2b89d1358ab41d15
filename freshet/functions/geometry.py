"""Polygons as nested arrays ``array<array<array<array<double>>>>``: parts, rings, positions, x and y."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import bind

PLACES = 6

POLYGON_TYPE = "array<array<array<double>>>"
MULTIPOLYGON_TYPE = "array<array<array<array<double>>>>"


def geojson_multipolygon(text: Column) -> Column:
    """Geometry of the first feature; a polygon becomes a multipolygon of one part.

    Null if the text has no such geometry.
    """
    geometry = F.from_json(
        F.get_json_object(text, "$.features[0].geometry"), "type string, coordinates string"
    )

    def shape(found: Column) -> Column:
        coordinates, kind = found["coordinates"], found["type"]
        return F.when(kind == "Polygon", F.array(F.from_json(coordinates, POLYGON_TYPE))).when(
            kind == "MultiPolygon", F.from_json(coordinates, MULTIPOLYGON_TYPE)
        )

    return bind(geometry, shape)


def ring_edges(positions: Column) -> Column:
    """``array<struct<p, q>>``: every position with the next one, the last one with the first."""
    following = F.concat(F.slice(positions, 2, F.size(positions)), F.slice(positions, 1, 1))
    return F.arrays_zip(positions.alias("p"), following.alias("q"))


def rounded(value: Column) -> Column:
    """Six places, ties to even."""
    return F.bround(value, PLACES)


def box_ring(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """The rectangle as a polygon of one closed ring."""
    corners = ((max_x, min_y), (max_x, max_y), (min_x, max_y), (min_x, min_y), (max_x, min_y))
    return F.array(F.array(*[F.array(x, y) for x, y in corners]))


def tagged_polygon(srid: int, polygon: Column) -> Column:
    """``struct<srid, coordinates>``."""
    return F.struct(F.lit(srid).alias("srid"), polygon.alias("coordinates"))
