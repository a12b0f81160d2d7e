"""Geometry columns: well-known binary (2-D polygons) and a scalar kernel over Arrow."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrangement import Geometry


def dump(g: Geometry | None) -> bytes | None:
    """Little-endian WKB MultiPolygon; rings are closed in the bytes."""
    if g is None:
        return None
    out = [struct.pack("<BII", 1, 6, len(g))]
    for polygon in g:
        out.append(struct.pack("<BII", 1, 3, len(polygon)))
        for ring in polygon:
            closed = [*ring, ring[0]] if ring else []
            out.append(struct.pack("<I", len(closed)) + b"".join(struct.pack("<dd", *p) for p in closed))
    return b"".join(out)


def parse(data: bytes | None) -> Geometry | None:
    """Polygon or MultiPolygon of either byte order."""
    if data is None:
        return None
    g, _ = _geometry(bytes(data), 0)
    return g


def _geometry(data: bytes, at: int) -> tuple[Geometry, int]:
    order = "<" if data[at] else ">"
    (kind,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if kind == 6:
        out: Geometry = []
        for _ in range(n):
            part, at = _geometry(data, at)
            out += part
        return out, at
    if kind != 3:
        raise ValueError(f"WKB type {kind} is no polygon")
    rings = []
    for _ in range(n):
        (m,) = struct.unpack_from(order + "I", data, at)
        flat = struct.unpack_from(f"{order}{2 * m}d", data, at + 4)
        at += 4 + 16 * m
        ring = list(zip(flat[::2], flat[1::2]))
        rings.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
    return [rings], at


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """WKB of boxes."""
    @F.pandas_udf("binary")
    def make(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([dump([[[(p, q), (r, q), (r, s), (p, s)]]]) for p, q, r, s in zip(a, b, c, d)])

    return make(x0, y0, x1, y1)


def geometry_udf(fn: Callable, returns: str = "binary"):
    """Arrow-batched UDF over WKB columns; binary results are geometries."""
    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for values in zip(*columns):
            values = [parse(v) if isinstance(v, (bytes, bytearray)) else v for v in values]
            out.append(None if any(v is None for v in values) else fn(*values))
        return pd.Series([dump(g) for g in out] if returns == "binary" else out)

    return run
