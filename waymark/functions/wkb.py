"""Well-known binary geometries, little endian, as Arrow functions."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Fixed values of the format.
POINT, LINE_STRING, MULTI_LINE_STRING = 1, 2, 5


def point_bytes(lon: float, lat: float) -> bytes:
    return struct.pack("<BIdd", 1, POINT, lon, lat)


def line_bytes(points: list[tuple[float, float]]) -> bytes:
    """A line; a single point stands twice, as a line needs two."""
    points = points * 2 if len(points) == 1 else points
    return struct.pack("<BII", 1, LINE_STRING, len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


def path_bytes(runs: list[list[tuple[float, float]]]) -> bytes | None:
    """Runs of a path: one of one point is a Point, one of more a LineString, several a MultiLineString."""
    runs = [r for r in runs if r]
    if not runs:
        return None
    if len(runs) == 1:
        return point_bytes(*runs[0][0]) if len(runs[0]) == 1 else line_bytes(runs[0])
    return struct.pack("<BII", 1, MULTI_LINE_STRING, len(runs)) + b"".join(map(line_bytes, runs))


@F.arrow_udf(BinaryType())
def _points(lon: pa.Array, lat: pa.Array) -> pa.Array:
    out = np.zeros(len(lon), np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")]))
    out["order"], out["kind"] = 1, POINT
    out["x"], out["y"] = lon.to_numpy(zero_copy_only=False), lat.to_numpy(zero_copy_only=False)
    raw = out.tobytes()
    size = out.dtype.itemsize
    return pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary(), mask=np.isnan(out["x"]) | np.isnan(out["y"]))


@F.arrow_udf(BinaryType())
def _lines(lon1: pa.Array, lat1: pa.Array, lon2: pa.Array, lat2: pa.Array) -> pa.Array:
    return pa.array([line_bytes([(a, b), (c, d)]) for a, b, c, d in zip(lon1.to_pylist(), lat1.to_pylist(), lon2.to_pylist(), lat2.to_pylist())], pa.binary())


@F.arrow_udf(BinaryType())
def _paths(points: pa.Array) -> pa.Array:
    def one(rows: list[dict] | None) -> bytes | None:
        runs: dict[int, list] = {}
        for r in rows or []:
            runs.setdefault(r["part"], []).append((r["lon"], r["lat"]))
        return path_bytes([runs[k] for k in sorted(runs)])

    return pa.array([one(p) for p in points.to_pylist()], pa.binary())


def wkb_point(lon: Column, lat: Column) -> Column:
    return _points(lon, lat)


def wkb_line(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return _lines(lon1, lat1, lon2, lat2)


def wkb_path(points: Column) -> Column:
    """From array<struct<idx, part, lon, lat>> in order of idx: part numbers the runs."""
    return _paths(points)
