"""Bounding boxes, centres, centroids, areas and ranks of hazard areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geodesy import BNG_SRID, WGS84_SRID, tagged_point, with_bng
from ..functions.geometry import box_ring, geojson_multipolygon, ring_edges, rounded, tagged_polygon
from ..session import staged
from .joins import lookup


AREA_KEYS = ("floodarea_id", "fwdcode")


def polygon_edges(polygons: DataFrame, text: str = "polygon_json") -> DataFrame:
    """One row per edge (p to q) of every ring, in degrees (x, y) and in grid metres (e, n).

    ``ring`` 0 is the outline of its ``part``, other rings are holes. The last
    edge closes the ring; it has no length if the ring is closed already.
    ``o_x, o_y`` is the first position of the area.
    """
    shapes = polygons.select(*AREA_KEYS, geojson_multipolygon(F.col(text)).alias("shape"))
    first = F.get(F.get(F.get("shape", F.lit(0)), F.lit(0)), F.lit(0))
    parts = shapes.select(
        *AREA_KEYS,
        F.get(first, F.lit(0)).alias("o_x"),
        F.get(first, F.lit(1)).alias("o_y"),
        # the inner form would add a filter below, and with it a second parse of the text
        F.posexplode_outer("shape").alias("part", "rings"),
    )
    kept = (*AREA_KEYS, "o_x", "o_y", "part")
    ring_rows = parts.select(*kept, F.posexplode("rings").alias("ring", "positions"))
    edges = ring_rows.select(*kept, "ring", F.inline(ring_edges(F.col("positions"))).alias("p", "q"))
    ends = edges.select(
        *kept,
        "ring",
        *[F.get(point, F.lit(axis)).alias(f"{point}_{name}") for point in "pq" for axis, name in enumerate("xy")],
    )
    return with_bng(with_bng(ends, "p_y", "p_x", "p_e", "p_n"), "q_y", "q_x", "q_e", "q_n")


def _grid_origin() -> tuple[Column, Column]:
    # Near the area on the grid; sums are taken from here, as those of coordinates far from 0 would cancel.
    return 400_000 + (F.col("o_x") + 2) * 68_000, (F.col("o_y") - 49) * 111_200 - 100_000


def _ring_sums(x: str, y: str, ox: Column, oy: Column, tag: str) -> list[Column]:
    # twice the signed area, and six times the first moments
    ax, ay = F.col(f"p_{x}") - ox, F.col(f"p_{y}") - oy
    bx, by = F.col(f"q_{x}") - ox, F.col(f"q_{y}") - oy
    cross = ax * by - bx * ay
    outline = F.col("ring") == 0
    return [
        F.sum(cross).alias(f"a_{tag}"),
        F.sum((ax + bx) * cross).alias(f"mx_{tag}"),
        F.sum((ay + by) * cross).alias(f"my_{tag}"),
        F.min(F.when(outline, F.col(f"p_{x}"))).alias(f"min_x_{tag}"),
        F.min(F.when(outline, F.col(f"p_{y}"))).alias(f"min_y_{tag}"),
        F.max(F.when(outline, F.col(f"p_{x}"))).alias(f"max_x_{tag}"),
        F.max(F.when(outline, F.col(f"p_{y}"))).alias(f"max_y_{tag}"),
    ]


def _area_sums(tag: str) -> list[Column]:
    sign = F.when(F.col("ring") == 0, 1).otherwise(-1)
    turn = sign * F.signum(f"a_{tag}")
    return [
        F.sum(sign * F.abs(f"a_{tag}") / 2).alias(f"area_{tag}"),
        F.sum(turn * F.col(f"mx_{tag}") / 6).alias(f"mx_{tag}"),
        F.sum(turn * F.col(f"my_{tag}") / 6).alias(f"my_{tag}"),
        *[
            function(f"{name}_{tag}").alias(f"{name}_{tag}")
            for function, names in ((F.min, ("min_x", "min_y")), (F.max, ("max_x", "max_y")))
            for name in names
        ],
    ]


def measured_polygons(polygons: DataFrame, text: str = "polygon_json") -> DataFrame:
    """Bounds, area and centroid of each GeoJSON polygon, in degrees (``_deg``) and on the grid (``_bng``).

    Edges are summed per ring and rings per area: holes subtract and parts
    weigh by area, whatever their winding. The edges of a ring are made in one
    task and summed there, so only ring sums are shuffled. Areas without a
    polygon have no row.
    """
    origin_e, origin_n = _grid_origin()
    ring_totals = (
        polygon_edges(polygons, text)
        .groupBy(*AREA_KEYS, "part", "ring")
        .agg(
            F.any_value("o_x").alias("o_x"),
            F.any_value("o_y").alias("o_y"),
            *_ring_sums("x", "y", F.col("o_x"), F.col("o_y"), "deg"),
            *_ring_sums("e", "n", origin_e, origin_n, "bng"),
        )
    )
    totals = ring_totals.groupBy(*AREA_KEYS).agg(
        F.any_value("o_x").alias("o_x"), F.any_value("o_y").alias("o_y"), *_area_sums("deg"), *_area_sums("bng")
    )
    centres = {}
    for tag, origin in (("deg", (F.col("o_x"), F.col("o_y"))), ("bng", (origin_e, origin_n))):
        for axis, start in zip("xy", origin):
            centres[f"cen_{axis}_{tag}"] = start + F.try_divide(f"m{axis}_{tag}", f"area_{tag}")
    return totals.withColumns(centres)


def area_metrics(polygons: DataFrame, text: str = "polygon_json") -> DataFrame:
    """One metrics row per area with a usable polygon.

    In the grid columns ``lat`` names the northing and ``long`` the easting.
    """
    measured = measured_polygons(polygons, text)
    usable = measured.where(F.col("cen_x_bng").isNotNull() & F.col("cen_x_deg").isNotNull())

    def middle(axis: str, tag: str) -> Column:
        return rounded((F.col(f"max_{axis}_{tag}") + F.col(f"min_{axis}_{tag}")) / 2)

    columns = []
    for crs, tag in (("wgs84", "deg"), ("bng", "bng")):
        for corner in ("min", "max"):
            for name, axis in (("lat", "y"), ("long", "x")):
                bound = F.col(f"{corner}_{axis}_{tag}")
                # degrees are kept as they came
                columns.append((bound if crs == "wgs84" else rounded(bound)).alias(f"bbox_{crs}_{corner}_{name}"))
        for name, axis in (("lat", "y"), ("long", "x")):
            columns.append(middle(axis, tag).alias(f"bcen_{crs}_{name}"))
            columns.append(rounded(F.col(f"cen_{axis}_{tag}")).alias(f"mpoly_cent_{crs}_{name}"))
    flat = usable.select(
        *AREA_KEYS, *columns, (F.col("area_bng") / 1e6).alias("area_km2"), F.col("area_bng").alias("area_m2")
    )
    return flat.withColumns(_metric_geometries())


def _metric_geometries() -> dict[str, Column]:
    geometries = {}
    for crs, srid in (("wgs84", WGS84_SRID), ("bng", BNG_SRID)):
        box = box_ring(
            F.col(f"bbox_{crs}_min_long"),
            F.col(f"bbox_{crs}_min_lat"),
            F.col(f"bbox_{crs}_max_long"),
            F.col(f"bbox_{crs}_max_lat"),
        )
        geometries[f"geom_bbox_{crs}"] = tagged_polygon(srid, box)
        for name in ("bcen", "mpoly_cent"):
            geometries[f"geom_{name}_{crs}"] = tagged_point(
                srid, F.col(f"{name}_{crs}_long"), F.col(f"{name}_{crs}_lat")
            )
    return geometries


def unmeasured_areas(polygons: DataFrame, metrics: DataFrame) -> DataFrame:
    """Areas left out of the ``metrics`` made by :func:`area_metrics`."""
    return polygons.join(metrics.select("floodarea_id"), "floodarea_id", "left_anti")


def packed_metrics(polygons: DataFrame, text: str = "polygon_json") -> DataFrame:
    """The metrics as nested pairs: latitude before longitude, but x before y on the grid."""
    flat = area_metrics(polygons, text)

    def pair(*names: str) -> Column:
        return F.array(*[F.col(name) for name in names])

    def box(crs: str, first: str, second: str) -> Column:
        return F.array(
            pair(f"bbox_{crs}_min_{first}", f"bbox_{crs}_min_{second}"),
            pair(f"bbox_{crs}_max_{first}", f"bbox_{crs}_max_{second}"),
        )

    return flat.select(
        "floodarea_id",
        "fwdcode",
        box("wgs84", "lat", "long").alias("bounding_box_wgs84"),
        pair("bcen_wgs84_lat", "bcen_wgs84_long").alias("bound_centre_wgs84"),
        pair("mpoly_cent_wgs84_lat", "mpoly_cent_wgs84_long").alias("mpoly_centroid_wgs84"),
        box("bng", "long", "lat").alias("bounding_box_bng"),
        pair("bcen_bng_long", "bcen_bng_lat").alias("bound_centre_bng"),
        pair("mpoly_cent_bng_long", "mpoly_cent_bng_lat").alias("mpoly_centroid_bng"),
        "area_km2",
        "area_m2",
    )


def unpacked_metrics(packed: DataFrame) -> DataFrame:
    """Nested pairs, and ``rank``, as the flat columns of the metrics table."""
    def item(name: str, *path: int) -> Column:
        column = F.col(name)
        for index in path:
            column = F.get(column, F.lit(index))
        return column

    columns = []
    for crs, lat, long in (("wgs84", 0, 1), ("bng", 1, 0)):
        for corner, position in (("min", 0), ("max", 1)):
            columns.append(item(f"bounding_box_{crs}", position, lat).alias(f"bbox_{crs}_{corner}_lat"))
            columns.append(item(f"bounding_box_{crs}", position, long).alias(f"bbox_{crs}_{corner}_long"))
        for source, target in (("bound_centre", "bcen"), ("mpoly_centroid", "mpoly_cent")):
            columns.append(item(f"{source}_{crs}", lat).alias(f"{target}_{crs}_lat"))
            columns.append(item(f"{source}_{crs}", long).alias(f"{target}_{crs}_long"))
    return packed.select("floodarea_id", "fwdcode", *columns, "area_km2", "area_m2", "rank")


def with_rank(df: DataFrame, value: str = "area_m2", rank: str = "rank") -> DataFrame:
    """Add the rank by descending ``value``; equal values share a rank, null has none.

    No task sorts the whole table: rows are counted per distinct value, the
    values are cut into ranges, and each range starts at the row count of the
    ranges above it. ``df`` is read twice; stage it first if it is costly.
    """
    value_column = F.col(value)
    counted = df.where(value_column.isNotNull()).groupBy(value).agg(F.count("*").alias("_rows"))
    # written out, because a second run could draw other range borders
    ranged = staged(
        counted.repartitionByRange(value_column.desc()).withColumn("_range", F.spark_partition_id()),
        "ranked-values",
    )
    totals = ranged.groupBy("_range").agg(F.sum("_rows").alias("_total"))
    # one row per range, so this window is as short as the number of partitions
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(above), F.lit(0)).alias("_start"))
    higher = Window.partitionBy("_range").orderBy(value_column.desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        ranged.withColumn("_higher", F.coalesce(F.sum("_rows").over(higher), F.lit(0)))
        .join(F.broadcast(starts), "_range")
        .select(value, (F.col("_start") + F.col("_higher") + 1).alias(rank))
    )
    return lookup(df, ranks, [value])
