"""Geometry as Column expressions: rings are arrays of points, rectangles four doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to web Mercator metres."""
    return F.radians(lon) * EARTH_RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH_RADIUS), F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - math.pi / 2)


def map_points(ring: Column, fn) -> Column:
    """``fn(x, y) -> (x, y)`` on every vertex of a ring."""
    return F.transform(ring, lambda p: F.struct(*[v.alias(n) for v, n in zip(fn(p["x"], p["y"]), "xy")]))


def affine(coefficients: tuple[float, ...]):
    a, b, c, d, e, f = coefficients
    return lambda x, y: (a * x + b * y + c, d * x + e * y + f)


def swap_lon_lat(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Order a pair that looks swapped (longitude under 35 with latitude over 90)."""
    swapped = (lon < 35) & (lat > 90)
    return F.when(swapped, lat).otherwise(lon), F.when(swapped, lon).otherwise(lat)


def signed_area(ring: Column) -> Column:
    """Shoelace; the ring may but need not repeat its first vertex."""
    n = F.size(ring)
    return F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0.0),
        lambda acc, i: acc + ring[i]["x"] * ring[(i + 1) % n]["y"] - ring[(i + 1) % n]["x"] * ring[i]["y"],
    ) / 2


def ring_length(ring: Column) -> Column:
    n = F.size(ring)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + F.hypot(ring[(i + 1) % n]["x"] - ring[i]["x"], ring[(i + 1) % n]["y"] - ring[i]["y"]))


def centroid(ring: Column) -> tuple[Column, Column]:
    n, area = F.size(ring), signed_area(ring)

    def moment(axis: str) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), n - 1), F.lit(0.0),
            lambda acc, i: acc + (ring[i][axis] + ring[(i + 1) % n][axis]) * (ring[i]["x"] * ring[(i + 1) % n]["y"] - ring[(i + 1) % n]["x"] * ring[i]["y"]),
        ) / (6 * area)

    return moment("x"), moment("y")


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def rect_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test; points on the boundary are inside."""
    n = F.size(ring)
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(ring[i].alias("p"), ring[(i + 1) % n].alias("q")))

    def on_edge(s: Column) -> Column:
        (px, py), (qx, qy) = (s["p"]["x"], s["p"]["y"]), (s["q"]["x"], s["q"]["y"])
        cross = (qx - px) * (y - py) - (qy - py) * (x - px)
        return (F.abs(cross) <= 1e-12 * (F.abs(qx - px) + F.abs(qy - py) + 1)) & x.between(F.least(px, qx), F.greatest(px, qx)) & y.between(F.least(py, qy), F.greatest(py, qy))

    def crosses(s: Column) -> Column:
        (px, py), (qx, qy) = (s["p"]["x"], s["p"]["y"]), (s["q"]["x"], s["q"]["y"])
        return ((py > y) != (qy > y)) & (x < px + (qx - px) * (y - py) / (qy - py))

    return F.exists(steps, on_edge) | (F.size(F.filter(steps, crosses)) % 2 == 1)


def densify(ring: Column, distance: float) -> Column:
    """Vertices added so that no edge is longer than ``distance``."""
    n = F.size(ring)

    def edge(i: Column) -> Column:
        p, q = ring[i], ring[(i + 1) % n]
        parts = F.greatest(F.lit(1), F.ceil(F.hypot(q["x"] - p["x"], q["y"] - p["y"]) / distance).cast("int"))
        return F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct((p["x"] + (q["x"] - p["x"]) * k / parts).alias("x"), (p["y"] + (q["y"] - p["y"]) * k / parts).alias("y")))

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), edge))


def delete_holes(parts: Column) -> Column:
    """Polygons as arrays of rings, outer first: only the outer ring stays."""
    return F.transform(parts, lambda rings: F.slice(rings, 1, 1))


def zoom_box(x: Column, y: Column, width: Column, low: float = 500.0, high: float = 5000.0) -> Column:
    """Square around a place, its side clamped."""
    half = F.least(F.greatest(width, F.lit(low)), F.lit(high)) / 2
    return F.struct((x - half).alias("xmin"), (y - half).alias("ymin"), (x + half).alias("xmax"), (y + half).alias("ymax"))


def floor_round(c: Column, places: int = 2) -> Column:
    """Half-up rounding by floor: equal on every engine."""
    k = 10**places
    return F.floor(c * k + 0.5) / k
