"""Extended well-known binary of geometries, for sinks that take nothing else.

The encoders are inner functions, so that they reach the executors with the
query and need no package there.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

SRID_FLAG = 0x20000000
POINT, POLYGON, MULTIPOLYGON = 1, 3, 6


def point_wkb(points: Column) -> Column:
    """Binary form of ``struct<srid, x, y>`` points; null stays null."""
    layout = np.dtype([("order", "u1"), ("kind", "<u4"), ("srid", "<u4"), ("x", "<f8"), ("y", "<f8")])

    @F.pandas_udf("binary")
    def encode(points: pd.DataFrame) -> pd.Series:
        present = (points["x"].notna() & points["y"].notna()).to_numpy()
        records = np.zeros(int(present.sum()), dtype=layout)
        records["order"] = 1
        records["kind"] = POINT | SRID_FLAG
        for name in ("srid", "x", "y"):
            records[name] = points[name].to_numpy()[present]
        encoded = iter(records)
        return pd.Series([next(encoded).tobytes() if there else None for there in present], dtype=object)

    return encode(points)


def multipolygon_wkb(multipolygon: Column, srid: int) -> Column:
    """Binary form of nested coordinate arrays, tagged with ``srid``; null stays null."""

    @F.pandas_udf("binary")
    def encode(values: pd.Series, ring_sizes: pd.Series, part_sizes: pd.Series) -> pd.Series:
        def one(numbers, positions_of, rings_of):
            if numbers is None:
                return None
            data = np.asarray(numbers, dtype="<f8").tobytes()
            pieces = [struct.pack("<BIII", 1, MULTIPOLYGON | SRID_FLAG, srid, len(rings_of))]
            ring = start = 0
            for n_rings in rings_of:
                pieces.append(struct.pack("<BII", 1, POLYGON, n_rings))
                for n_positions in positions_of[ring : ring + n_rings]:
                    end = start + 16 * int(n_positions)
                    pieces += [struct.pack("<I", n_positions), data[start:end]]
                    start = end
                ring += n_rings
            return b"".join(pieces)

        return pd.Series([one(*row) for row in zip(values, ring_sizes, part_sizes)], dtype=object)

    rings = F.flatten(multipolygon)
    numbers = F.flatten(F.transform(F.flatten(rings), lambda position: F.slice(position, 1, 2)))
    return encode(numbers, F.transform(rings, F.size), F.transform(multipolygon, F.size))
