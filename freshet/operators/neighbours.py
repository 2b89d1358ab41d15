"""Edges between neighbouring stations: the nearest places of each place.

Stations at one place are one class, so a crowded place has as many edges as any other.
The places are counted in the cells of a quadtree, and the cells descend it together from
the root: of the cells that a cell still looks at, those that hold enough places bound the
distance of the k-th neighbour of all its places from above, and cells that begin farther
away are left out. What is left is a few cells per cell and level, whatever the density
around it; full cells are divided, and a cell leaves the descent when neither it nor any
cell it looks at is full. Its places then bound their own distances in the same way, and
compare the places of what is left exactly.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import prepare, staged

#: Cells of the finest level have this many units of the coordinates on a side.
FINEST = 1.0
#: A cell of so many places is compared place by place.
CELL_PLACES = 16


def places(stations: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(class_id, x, y, n_members): stations with equal coordinates under their smallest key.

    Stations without a finite position have no place.
    """
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    # -0.0 is 0.0
    at = lambda c: (F.col(c).cast("double") + F.lit(0.0))
    return (
        stations.where(finite(x) & finite(y) & F.col(key).isNotNull())
        .groupBy(at(x).alias("x"), at(y).alias("y"))
        .agg(F.min(key).alias("class_id"), F.count("*").alias("n_members"))
        .select("class_id", "x", "y", "n_members")
    )


#: A cell: where it is in the quadtree, the box around its places, and their number.
CELL = ("level", "column", "row", "x0", "x1", "y0", "y1", "places")


def _squared(a: str, b: str, farthest: bool) -> Column:
    """The square of the distance between places of two boxes, at least or at most.

    Rounded like the distance of two places, so that it bounds what that comes to.
    """

    def along(axis: str) -> Column:
        low, high, other_low, other_high = (F.col(f"{side}.{axis}{end}") for side in (a, b) for end in (0, 1))
        if farthest:
            return F.greatest(other_high - low, high - other_low)
        return F.greatest(other_low - high, low - other_high, F.lit(0.0))

    return along("x") * along("x") + along("y") * along("y")


def _in_reach(front: DataFrame, k: int, *key: str) -> DataFrame:
    """Of the cells ``other`` of each ``own``, those that may hold one of its ``k`` nearest places."""
    whole = Window.partitionBy(*key)
    nearest = whole.orderBy("far", "other.level", "other.column", "other.row")
    front = front.withColumns({"near": _squared("own", "other", False), "far": _squared("own", "other", True)})
    front = front.withColumn("enough", F.sum("other.places").over(nearest) > k)  # the place itself is one of them
    front = front.withColumn("bound", F.min(F.when(F.col("enough"), F.col("far"))).over(whole))
    return front.where(F.col("bound").isNull() | (F.col("near") <= F.col("bound"))).drop("near", "far", "enough", "bound")


def _divided(front: DataFrame, side: str, inner: DataFrame, level: int) -> DataFrame:
    """The pairs with the full cells of a level replaced by the cells in them."""
    at = [F.col(f"{side}.{c}") for c in ("level", "column", "row")]
    inner = inner.select("column", "row", "inner")
    parts = front.join(inner, (at[0] == level) & (at[1] == inner["column"]) & (at[2] == inner["row"]), "left")
    other = "other" if side == "own" else "own"
    return parts.select(other, F.explode(F.coalesce("inner", F.array(side))).alias(side))


def nearest_places(
    stations: DataFrame, k: int, key: str = "station_id", x: str = "x", y: str = "y",
    finest: float = FINEST, cell_places: int = CELL_PLACES,
) -> DataFrame:
    """The ``k`` nearest other places of each place by distance on the plane.

    Returns ``class_id, rank, neighbour_id, distance, n_members`` (of the neighbour),
    nearest first, equal distances by the smaller id; all others where there are fewer
    than ``k``. ``finest`` is the side of the smallest cells; places closer than that are
    told apart by their coordinates.
    """
    prepare(stations.sparkSession)
    known = staged(places(stations, key, x, y), "places")
    ends = known.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not ends[4]:
        return known.select(
            "class_id", F.lit(0).alias("rank"), F.col("class_id").alias("neighbour_id"), F.lit(0.0).alias("distance"), "n_members")
    left, low = ends[0], ends[2]
    extent, depth = max(ends[1] - ends[0], ends[3] - ends[2]), 0
    while finest * (1 << depth) <= extent:
        depth += 1
    if depth > 31:
        raise ValueError("finest is too small for the extent of the stations")
    column, row = F.floor((F.col("x") - left) / finest), F.floor((F.col("y") - low) / finest)
    known = staged(known.withColumns({"column": column, "row": row}), "placed")
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("places")]
    cell = F.struct(*CELL)
    levels = known.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "column", "row")
    cells = levels.groupBy("level", F.expr("shiftright(column, level)").alias("column"), F.expr("shiftright(row, level)").alias("row")).agg(*box)
    full = cells.where(F.col("level") < depth).groupBy(
        (F.col("level") + 1).alias("level"), F.shiftright("column", 1).alias("column"), F.shiftright("row", 1).alias("row")
    ).agg(F.sum("places").alias("places"), F.collect_list(cell).alias("inner")).where(F.col("places") > cell_places)
    full = staged(full.select("column", "row", "inner", "level"), "full_cells", ("level",))

    root = known.agg(*box).select(
        F.lit(depth).alias("level"), F.lit(0).cast("long").alias("column"), F.lit(0).cast("long").alias("row"), "x0", "x1", "y0", "y1", "places")
    front = root.select(cell.alias("own"), cell.alias("other"))
    own = ("own.level", "own.column", "own.row")
    is_full = lambda side: (F.col(f"{side}.level") > 0) & (F.col(f"{side}.places") > cell_places)
    ready = [] if depth else [front]
    for level in range(depth, 0, -1):
        inner = full.where(F.col("level") == level)
        front = _in_reach(_divided(_divided(front, "own", inner, level), "other", inner, level), k, *own)
        more = F.max(is_full("own") | is_full("other")).over(Window.partitionBy(*own))
        front = staged(front.select("own", "other", more.alias("more")), "cells_in_reach", ("more",))
        ready.append(front.where("not more").drop("more"))
        front = front.where("more").drop("more")
        if front.isEmpty():
            break
    pairs = functools.reduce(DataFrame.unionByName, ready)
    # each cell looks at itself, too
    leaves = pairs.where(" and ".join(f"{c} = other.{c[4:]}" for c in own)).select(*own)
    # each place is listed under the levels in use
    in_use = [r.level for r in leaves.select("level").distinct().collect()]
    listed = known.withColumn("level", F.explode(F.array(*map(F.lit, in_use)))).withColumns(
        {"column": F.expr("shiftright(column, level)"), "row": F.expr("shiftright(row, level)")})
    listed = staged(listed.join(leaves, ["level", "column", "row"], "left_semi"), "listed")
    point = F.struct(F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1")).alias("own")
    front = pairs.select(*own, "other").join(listed, ["level", "column", "row"]).select("class_id", "x", "y", point, "other")
    front = _in_reach(front, k, "class_id").select("class_id", "x", "y", "other.level", "other.column", "other.row")
    others = listed.select(
        "level", "column", "row", F.col("class_id").alias("neighbour_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), "n_members")
    near = front.join(others, ["level", "column", "row"]).where("class_id <> neighbour_id")
    distance = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    order = Window.partitionBy("class_id").orderBy("squared", "neighbour_id")
    ranked = near.withColumn("squared", distance).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("class_id", "rank", "neighbour_id", F.sqrt("squared").alias("distance"), "n_members")


def place_members(stations: DataFrame, key: str = "station_id", x: str = "x", y: str = "y") -> DataFrame:
    """``station_id, class_id``: the class of each station, which carries the edges of :func:`nearest_places`."""
    known = places(stations, key, x, y)
    at = stations.select(F.col(key).alias("station_id"), (F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y"))
    return at.join(known.select("class_id", "x", "y"), ["x", "y"]).select("station_id", "class_id")
