"""Topology of lines and areas: ends of lines, shared vertices, snapping, left-over ground.

What is near, shared or lonely is found by joins on coordinates and grid cells; Python
sees one area, or the areas of one parent, at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.geometry import arrangement as arr
from cadastra.geometry import wkb

from . import spatial
from .polygons import by_group, dealt

#: Decimals at which two coordinates are the same.
DIGITS = 8
#: A vertex no further than this from a fixed line lies on it.
ON_LINE = 1e-7
CLEANING_PASSES = 3


def line_length(points: Column) -> Column:
    """Length of an array of ``[x, y]``."""
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1])))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def line_ends(lines: DataFrame, keys: list[str], line: str = "line", points: str = "points") -> DataFrame:
    """``keys, line, end, x, y, rx, ry``: both ends of every line, with rounded places."""
    last = F.element_at(points, -1)
    ends = F.array(*[F.struct(F.lit(e).alias("end"), p[0].alias("x"), p[1].alias("y")) for e, p in ((0, F.col(points)[0]), (1, last))])
    found = lines.where(F.size(points) > 1).select(*keys, F.col(line).alias("line"), F.explode(ends).alias("e")).select(*keys, "line", "e.*")
    return found.select("*", F.round("x", DIGITS).alias("rx"), F.round("y", DIGITS).alias("ry"))


def dangling_ends(lines: DataFrame, keys: list[str], line: str = "line", points: str = "points") -> DataFrame:
    """Ends where no other line of the same ``keys`` ends."""
    ends = line_ends(lines, keys, line, points)
    at = [*keys, "rx", "ry"]
    lonely = ends.groupBy(*at).agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a = b").select(*at)
    return ends.join(lonely, at, "left_semi")


def refine_lines(lines: DataFrame, keys: list[str], gap: float, branch: float) -> DataFrame:
    """``keys, line, points`` of split lines ``keys, line, points``: dangling ends of two
    lines no further than ``gap`` apart are bridged, lines shorter than ``branch`` that
    dangle at both ends go, and what meets two by two is joined and numbered anew.

    Bridges are taken in the order of the ends, an end at most once: rounds of pairs that
    come first at both their ends.  A single line, and lines of which nothing would stay,
    are left as they are."""
    lines = spatial.cut_lineage(lines.select(*keys, "line", "points"))
    many = lines.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    single = lines.join(many, keys, "left_anti")
    lines = spatial.cut_lineage(lines.join(many, keys, "left_semi"))
    dangling = spatial.cut_lineage(dangling_ends(lines, keys).withColumn("k", F.col("line").cast("long") * 2 + F.col("end")))

    points = dangling.select(*keys, "k", "line", "x", "y")
    met = spatial.box_join(points, points, gap, on=keys, within=gap).where("a.k < b.k AND a.line <> b.line")
    near = F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2) <= gap
    place = [F.struct(F.col(f"{s}.k").alias("k"), F.col(f"{s}.x").alias("x"), F.col(f"{s}.y").alias("y")).alias(s) for s in "ab"]
    bridges = first_matches(met.where(near).select(*[F.col(f"a.{k}").alias(k) for k in keys], *place), keys)

    free = dangling.groupBy(*keys, "line").agg(F.count("*").alias("n")).where("n = 2").select(*keys, "line")
    short = lines.where(line_length(F.col("points")) < branch).join(free, [*keys, "line"], "left_semi").select(*keys, "line")
    kept = lines.join(short, [*keys, "line"], "left_anti").select(*keys, "points")
    bridge = bridges.select(*keys, F.array(F.array("a.x", "a.y"), F.array("b.x", "b.y")).alias("points"))
    every = spatial.cut_lineage(kept.union(bridge))
    lost = lines.join(every.select(*keys).distinct(), keys, "left_anti")

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in lines.select(*keys).schema], "line int", "points array<array<double>>"])

    def joined(key: tuple, own: list[tuple]) -> list[tuple]:
        found = sorted(arr.merge_lines([[tuple(p) for p in r.points] for r in own]))
        return [(*key, i, [list(p) for p in line]) for i, line in enumerate(found)]

    same = single.union(lost).select(*keys, F.col("line").cast("int").alias("line"), "points")
    return by_group(every, keys, joined, schema).union(same)


def first_matches(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of pairs of structs ``a, b`` those that a pass in the order of ``(a.k, b.k)`` would
    take, each ``k`` at most once.  A pair that comes first at both its ends is taken in
    that pass whatever follows, so every round takes all such pairs at once."""
    left = spatial.cut_lineage(pairs)
    done = None
    while not left.isEmpty():
        order = F.struct(F.col("a.k").alias("ka"), F.col("b.k").alias("kb"))
        ends = left.select(*keys, F.explode(F.array("a.k", "b.k")).alias("k"), order.alias("o"))
        first = ends.groupBy(*keys, "k").agg(F.min("o").alias("o"))
        twice = first.groupBy(*keys, "o").agg(F.count("*").alias("n")).where("n = 2").select(*keys, F.col("o.ka").alias("ka"), F.col("o.kb").alias("kb"))
        flat = left.select("*", F.col("a.k").alias("ka"), F.col("b.k").alias("kb"))
        taken = spatial.cut_lineage(flat.join(twice, [*keys, "ka", "kb"], "left_semi"))
        used = taken.select(*keys, F.explode(F.array("ka", "kb")).alias("k"))
        for end in ("ka", "kb"):
            flat = flat.join(used.withColumnRenamed("k", end), [*keys, end], "left_anti")
        left = spatial.cut_lineage(flat.select(*keys, "a", "b"))
        done = taken if done is None else done.union(taken)
    return pairs.limit(0) if done is None else done.select(*keys, "a", "b")


_VERTEX = "array<struct<part:int,ring:int,pos:double,x:double,y:double,size:int>>"


def _vertices(geom: pd.Series) -> pd.Series:
    return pd.Series([[(i, j, float(k), *map(float, p), len(r)) for i, polygon in enumerate(wkb.parse(g)) for j, r in enumerate(polygon) for k, p in enumerate(r)] if g is not None else None for g in geom])


def _rebuilt(found: pd.Series, old: pd.Series) -> pd.Series:
    """Shapes of sorted vertices; those that would be no valid shape stay as they were."""
    out = []
    for rows, before in zip(found, old):
        if before is None or not len(rows):
            out.append(before)
            continue
        polygons: dict[int, dict[int, list]] = {}
        for r in rows:
            ring = polygons.setdefault(r["part"], {}).setdefault(r["ring"], [])
            if not ring or ring[-1] != (r["x"], r["y"]):
                ring.append((r["x"], r["y"]))
        g = [[ring[:-1] if ring[0] == ring[-1] else ring for _, ring in sorted(rings.items())] for _, rings in sorted(polygons.items())]
        out.append(wkb.dump(g) if arr.is_valid(g) else before)
    return pd.Series(out)


def vertices(layer: DataFrame, key: str, *more: str, geom: str = "geom") -> DataFrame:
    """``key, more, part, ring, pos, x, y, size``: a row per vertex, size being its ring's."""
    return layer.where(F.col(geom).isNotNull()).select(key, *more, F.explode(F.pandas_udf(_vertices, _VERTEX)(geom)).alias("v")).select(key, *more, "v.*")


def segments(points: DataFrame, key: str, *more: str) -> DataFrame:
    """``key, more, part, ring, pos, px, py, qx, qy`` and the bounding box of each side of
    the rings in ``vertices``: a vertex is joined to the one after it."""
    ring = [key, "part", "ring"]
    after = points.select(*ring, F.pmod(F.col("pos") - 1, F.col("size").cast("double")).alias("pos"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return _boxed(points.join(after, [*ring, "pos"]).select(*ring, *more, "pos", F.col("x").alias("px"), F.col("y").alias("py"), "qx", "qy"))


def _boxed(sides: DataFrame) -> DataFrame:
    return sides.select("*", F.least("px", "qx").alias("x0"), F.least("py", "qy").alias("y0"), F.greatest("px", "qx").alias("x1"), F.greatest("py", "qy").alias("y1"))


def _foot(p: str, s: str) -> tuple[Column, Column, Column, Column]:
    """Place along side ``s`` (0 to 1), foot and distance of point ``p``."""
    dx, dy = F.col(f"{s}.qx") - F.col(f"{s}.px"), F.col(f"{s}.qy") - F.col(f"{s}.py")
    size = dx * dx + dy * dy
    t = F.when(size > 0, ((F.col(f"{p}.x") - F.col(f"{s}.px")) * dx + (F.col(f"{p}.y") - F.col(f"{s}.py")) * dy) / size).otherwise(F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    x, y = F.col(f"{s}.px") + t * dx, F.col(f"{s}.py") + t * dy
    return t, x, y, F.sqrt((F.col(f"{p}.x") - x) ** 2 + (F.col(f"{p}.y") - y) ** 2)


def snap(layer: DataFrame, targets: DataFrame, tolerance: float, size: float, key: str = "id", nodes: bool = False, on: list[str] = (), geom: str = "geom") -> DataFrame:
    """``layer`` with its shapes snapped to target lines ``on, px, py, qx, qy``.

    A vertex within ``tolerance`` moves to the nearest point of a target; with ``nodes`` to
    the nearest end of a target if one is that near.  Then ends of targets within the
    tolerance of a side that have no vertex there yet become vertices of it.  ``on``:
    columns that must be equal.  size: side of the grid cells.  A shape that would become
    invalid stays; null shapes stay null; ties go to the least coordinates."""
    layer = spatial.cut_lineage(layer)
    points = spatial.cut_lineage(vertices(layer, key, *[c for c in on if c != key], geom=geom))
    sides = _boxed(targets.select(*on, "px", "py", "qx", "qy"))
    at = [key, "part", "ring", "pos"]
    met = spatial.box_join(points, sides, size, on=on, within=tolerance)
    t, x, y, far = _foot("a", "b")

    def choice(rank: int, d: Column, x: Column, y: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), d.alias("far"), x.alias("x"), y.alias("y"))

    options = [choice(1 if nodes else 0, far, x, y)]
    for end in "pq":
        ex, ey = F.col(f"b.{end}x"), F.col(f"b.{end}y")
        options.append(choice(0, F.sqrt((F.col("a.x") - ex) ** 2 + (F.col("a.y") - ey) ** 2), ex, ey))
    best = met.select(*[F.col(f"a.{c}").alias(c) for c in at], F.explode(F.array(*options)).alias("o")).where(F.col("o.far") <= tolerance)
    best = best.groupBy(*at).agg(F.min("o").alias("o"))
    moved = points.join(best, at, "left").select(*at, *[c for c in on if c != key], F.coalesce("o.x", "x").alias("x"), F.coalesce("o.y", "y").alias("y"), "size")
    moved = spatial.cut_lineage(moved)

    own = segments(moved, key, *[c for c in on if c != key])
    node = targets.select(*on, F.explode(F.array(F.struct(F.col("px").alias("x"), F.col("py").alias("y")), F.struct(F.col("qx").alias("x"), F.col("qy").alias("y")))).alias("n")).select(*on, "n.*").distinct()
    near = spatial.box_join(node, own, size, on=on, within=tolerance)
    t, _, _, far = _foot("a", "b")
    apart = [F.sqrt((F.col("a.x") - F.col(f"b.{e}x")) ** 2 + (F.col("a.y") - F.col(f"b.{e}y")) ** 2) > tolerance for e in "pq"]
    new = near.select(*[F.col(f"b.{c}").alias(c) for c in (key, "part", "ring")], (F.col("b.pos") + t).alias("pos"), F.col("a.x").alias("x"), F.col("a.y").alias("y"), t.alias("t"), far.alias("far"), (apart[0] & apart[1]).alias("free"))
    new = new.where((F.col("t") > 0) & (F.col("t") < 1) & (F.col("far") <= tolerance) & F.col("free")).select(*at, "x", "y")

    return _of_vertices(layer, moved.select(*at, "x", "y").union(new), key, geom)


def _of_vertices(layer: DataFrame, every: DataFrame, key: str, geom: str) -> DataFrame:
    """``layer`` with the shapes that ``key, part, ring, pos, x, y`` describe."""
    found = every.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part", "ring", "pos", "x", "y"))).alias("_found"))
    done = layer.join(found, key, "left")
    rebuilt = F.pandas_udf(_rebuilt, "binary")
    none = F.array().cast("array<struct<part:int,ring:int,pos:double,x:double,y:double>>")
    return done.withColumn(geom, rebuilt(F.coalesce("_found", none), F.col(geom))).drop("_found").select(*layer.columns)


def free_vertices(layer: DataFrame, key: str, fixed: DataFrame | None, size: float, geom: str = "geom") -> DataFrame:
    """Vertices that no other area has and that lie on no line of ``fixed`` (px, py, qx,
    qy).  Which areas have a vertex is a shuffle by rounded coordinates, counted before it."""
    points = spatial.cut_lineage(vertices(layer, key, geom=geom).select("*", F.round("x", DIGITS).alias("rx"), F.round("y", DIGITS).alias("ry")))
    lonely = points.groupBy("rx", "ry").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a = b").select("rx", "ry")
    free = points.join(lonely, ["rx", "ry"], "left_semi")
    if fixed is not None:
        met = spatial.box_join(free, _boxed(fixed.select("px", "py", "qx", "qy")), size, within=ON_LINE)
        on = met.where(_foot("a", "b")[3] < ON_LINE).select(*[F.col(f"a.{c}").alias(c) for c in (key, "part", "ring", "pos")])
        free = free.join(on, [key, "part", "ring", "pos"], "left_anti")
    return free


def clean_vertices(layer: DataFrame, tolerance: float, size: float, key: str = "id", parent: str = "parent", buildings: DataFrame | None = None, fixed: DataFrame | None = None, geom: str = "geom") -> DataFrame:
    """``layer`` without surplus vertices: those that are no neighbour's, on no fixed line
    and nearer than ``tolerance`` to a neighbour without touching it.

    Joins find the areas in question; only parents that have some reach Python, where up
    to ``CLEANING_PASSES`` passes in the order of ``key`` try each vertex and leave it out
    if the shape stays valid, keeps its ``buildings`` (``key, x, y``) and overlaps no
    neighbour more than before.  Null shapes stay; sides of a triangle stay."""
    layer = spatial.cut_lineage(dealt(layer))
    free = spatial.cut_lineage(free_vertices(layer, key, fixed, size, geom))
    sides = segments(vertices(layer, key, geom=geom), key).withColumnRenamed(key, "_other")
    met = spatial.box_join(free, sides, size, within=tolerance).where(F.col(f"a.{key}") != F.col("b._other"))
    near = met.where(_foot("a", "b")[3] <= tolerance).select(F.col(f"a.{key}").alias(key)).distinct()
    parents = spatial.cut_lineage(layer.join(near, key, "left_semi").select(parent).distinct())

    spots = free.groupBy(key).agg(F.collect_list(F.array("x", "y")).alias("_free"))
    work = layer.join(parents, parent, "left_semi").join(spots, key, "left")
    if buildings is not None:
        own = buildings.groupBy(key).agg(F.collect_list(F.array(F.col("x").cast("double"), F.col("y").cast("double"))).alias("_points"))
        work = work.join(own, key, "left")
    else:
        work = work.withColumn("_points", F.lit(None).cast("array<array<double>>"))

    def pairs(v):
        return [tuple(map(float, p)) for p in v] if v is not None else []

    columns = [c for c in layer.columns if c != geom]
    work = work.select(*columns, F.col(geom).alias("_geom"), "_free", "_points")
    n = len(columns)

    def run(_, own: list[tuple]) -> list[tuple]:
        done = cleaned([wkb.parse(r[n]) if r[n] is not None else [] for r in own], [set(pairs(r[n + 1])) for r in own], [pairs(r[n + 2]) for r in own], tolerance)
        return [(*r[:n], wkb.dump(g) if g else None) for r, g in zip(own, done)]

    tried = by_group(spatial.cut_lineage(work), [parent], run, layer.select(*columns, geom).schema, [key])
    return layer.join(parents, parent, "left_anti").select(*layer.columns).union(tried.select(*layer.columns))


def distance(g: arr.Geometry, p: arr.Point) -> float:
    """Of a point from an area, 0 inside."""
    if arr.contains(g, np.array([p]))[0]:
        return 0.0
    s = arr.segments(g)
    d = s[:, 2:] - s[:, :2]
    t = np.clip(((np.array(p) - s[:, :2]) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
    return float(np.hypot(*(s[:, :2] + d * t[:, None] - np.array(p)).T).min())


def cleaned(shapes: list[arr.Geometry], free: list[set[arr.Point]], buildings: list[list[arr.Point]], tolerance: float) -> list[arr.Geometry]:
    """Shapes after the passes of ``clean_vertices``; each sees what earlier ones became."""
    shapes = list(shapes)
    for _ in range(CLEANING_PASSES):
        changed = False
        for i, shape in enumerate(shapes):
            if not shape or not free[i]:
                continue
            near = [g for j, g in enumerate(shapes) if j != i and g and not arr.apart(shape, g)]
            for p in [p for polygon in shape for ring in polygon for p in ring if p in free[i]]:
                if not near or not 0 < min(distance(g, p) for g in near) <= tolerance:
                    continue
                trial = [[[q for q in ring if q != p] if len(ring) > 3 else ring for ring in polygon] for polygon in shapes[i]]
                if trial == shapes[i] or not arr.is_valid(trial):
                    continue
                if buildings[i] and not arr.contains(trial, np.array(buildings[i]))[arr.contains(shapes[i], np.array(buildings[i]))].all():
                    continue
                if any(arr.area(arr.intersection(trial, g)) - arr.area(arr.intersection(shapes[i], g)) > 1e-9 for g in near):
                    continue
                shapes[i], changed = trial, True
        if not changed:
            break
    return shapes


def allocated(parts: list[arr.Geometry], whole: arr.Geometry) -> list[arr.Geometry]:
    """Parts with the pieces of ``whole`` that none of them covers: each piece goes to the
    part of the longest common border, else to that of the nearest centre."""
    parts = list(parts)
    if not parts or not whole:
        return parts
    total = arr.area(whole)
    rest = arr.difference(whole, *parts)
    for piece in rest:
        piece = [piece]
        if arr.area(piece) <= 1e-12 * total:
            continue
        border = [arr.shared_boundary(piece, p) for p in parts]
        to = max(range(len(parts)), key=lambda i: (border[i], -i))
        if border[to] < 0:
            c = arr.centroid(piece)
            to = min(range(len(parts)), key=lambda i: (math.dist(c, arr.centroid(parts[i])), i))
        parts[to] = arr.union([parts[to], piece])
    return parts


def allocate_residue(wholes: DataFrame, parts: DataFrame, key: str = "id", part: str = "part") -> DataFrame:
    """``key, part, geom``: parts of areas (``key, geom``) that together cover them, with
    the ground no part had given to one of them.  A task sees the parts of one area; areas
    without parts give no rows, parts of no area stay as they are."""
    def run(k: tuple, own: list[tuple]) -> list[tuple]:
        whole = next((r.whole for r in own if r.whole is not None), None)
        left = [r for r in own if not r.is_whole]
        if whole is None:
            return [(*k, r.part, r.geom) for r in left]
        return [(*k, r.part, wkb.dump(g)) for r, g in zip(left, allocated([wkb.parse(r.geom) for r in left], wkb.parse(whole)))]

    parts = parts.select(key, part, "geom")
    kinds = [parts.schema[c].dataType.simpleString() for c in (key, part)]
    rows = parts.select(F.col(key).alias("k"), F.col(part).alias("part"), "geom", F.lit(None).cast("binary").alias("whole"), F.lit(False).alias("is_whole"))
    rows = rows.union(wholes.select(F.col(key).alias("k"), F.lit(None).cast(kinds[1]), F.lit(None).cast("binary"), F.col("geom"), F.lit(True)))
    return by_group(rows, ["k"], run, f"{key} {kinds[0]}, {part} {kinds[1]}, geom binary", ["part"])


def dangles(lines: DataFrame, size: float, key: str = "id", points: str = "points", near: float = 1e-8) -> DataFrame:
    """``key, end, x, y`` of the ends of lines that no other line comes near, be it with
    its end or along it.  Lines of less than two points have no ends."""
    ends = line_ends(lines, [], key, points).withColumnRenamed("line", key)
    steps = F.expr(f"transform(sequence(1, size({points}) - 1), i -> struct({points}[i - 1][0] AS px, {points}[i - 1][1] AS py, {points}[i][0] AS qx, {points}[i][1] AS qy))")
    sides = _boxed(lines.where(F.size(points) > 1).select(F.col(key).alias("_other"), F.explode(steps).alias("s")).select("_other", "s.*"))
    met = spatial.box_join(ends, sides, size, within=near).where(F.col(f"a.{key}") != F.col("b._other"))
    met = met.where(_foot("a", "b")[3] <= near).select(F.col(f"a.{key}").alias(key), F.col("a.end").alias("end"))
    return ends.join(met, [key, "end"], "left_anti").select(key, "end", "x", "y")


def _canonical(geom: pd.Series) -> pd.Series:
    """Equal bytes for equal areas: rings without points on straight lines, from the least
    point on, outer ones one way round and holes the other, all in order."""
    def ring(points, sign):
        points = [(round(x, DIGITS) + 0.0, round(y, DIGITS) + 0.0) for x, y in arr._straight(points)]
        points = points if arr.ring_area(points) * sign > 0 else points[::-1]
        k = points.index(min(points))
        return points[k:] + points[:k]

    def whole(g):
        return sorted([ring(p[0], 1), *sorted(ring(r, -1) for r in p[1:])] for p in g if p and p[0])

    return pd.Series([wkb.dump(whole(wkb.parse(g))) if g is not None else None for g in geom])


def duplicates(layer: DataFrame, key: str = "id", geom: str = "geom") -> DataFrame:
    """``key, first, copies``: areas that equal one of a smaller key, the least such key and
    how many are equal, whatever point their rings begin at and which way they run.  A
    row a copy, not a pair: a thousand copies are not half a million rows."""
    form = layer.where(F.col(geom).isNotNull()).select(key, F.sha2(F.pandas_udf(_canonical, "binary")(geom), 256).alias("form"))
    form = spatial.cut_lineage(form)
    groups = form.groupBy("form").agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return form.join(groups, "form").where(F.col(key) != F.col("first")).select(key, "first", "copies")


def noded(layer: DataFrame, size: float, key: str = "id", geom: str = "geom") -> DataFrame:
    """``layer`` in which a vertex of one area that lies on a side of another (or of the
    same) is a vertex of that side too.  size: side of the grid cells."""
    layer = spatial.cut_lineage(layer)
    points = spatial.cut_lineage(vertices(layer, key, geom=geom))
    spots = points.select(F.round("x", DIGITS).alias("x"), F.round("y", DIGITS).alias("y")).distinct()
    met = spatial.box_join(spots, segments(points, key), size, within=ON_LINE)
    t, _, _, far = _foot("a", "b")
    apart = [F.sqrt((F.col("a.x") - F.col(f"b.{e}x")) ** 2 + (F.col("a.y") - F.col(f"b.{e}y")) ** 2) > ON_LINE for e in "pq"]
    new = met.where((far <= ON_LINE) & apart[0] & apart[1]).select(*[F.col(f"b.{c}").alias(c) for c in (key, "part", "ring")], (F.col("b.pos") + t).alias("pos"), F.col("a.x").alias("x"), F.col("a.y").alias("y"))
    return _of_vertices(layer, points.select(*new.columns).union(new), key, geom)


def junctions(points: DataFrame, sides: DataFrame) -> DataFrame:
    """``rx, ry`` of the places where other than two different sides end, those of all
    areas taken together: what lies between two of them belongs to the same areas."""
    def place(x: str, y: str) -> Column:
        return F.struct(F.round(x, DIGITS).alias("rx"), F.round(y, DIGITS).alias("ry"))

    ends = sides.select(place("px", "py").alias("p"), place("qx", "qy").alias("q"))
    once = ends.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    return once.select(F.explode(F.array("p", "q")).alias("v")).groupBy("v").agg(F.count("*").alias("n")).where("n <> 2").select("v.*")


def arcs_simplified(g: arr.Geometry, fixed: set[arr.Point], tolerance: float) -> arr.Geometry:
    """``g`` with its rings cut at the ``fixed`` places (rounded) and each arc simplified.
    An arc is walked from its lesser end whatever the ring's direction and a ring without
    a fixed place from its least point, so that neighbours come to the same line."""
    def ring(points: arr.Ring) -> arr.Ring:
        places = [(round(x, DIGITS) + 0.0, round(y, DIGITS) + 0.0) for x, y in points]
        cuts = [i for i, p in enumerate(places) if p in fixed] or [min(range(len(places)), key=lambda i: places[i])]
        out: arr.Ring = []
        for i, j in zip(cuts, [*cuts[1:], cuts[0] + len(points)]):
            walk = [k % len(points) for k in range(i, j + 1)]
            back = walk[::-1]
            if [places[k] for k in back] < [places[k] for k in walk]:
                out += [points[back[k]] for k in arr.simplified_places([places[k] for k in back], tolerance)][:0:-1]
            else:
                out += [points[walk[k]] for k in arr.simplified_places([places[k] for k in walk], tolerance)][:-1]
        return out

    return [[ring(r) for r in polygon] for polygon in g]


def _crossing(size: float) -> Column:
    """Whether sides ``a`` and ``b`` cross with more than a touch of their ends."""
    def turn(s: str, o: str, e: str) -> Column:
        dx, dy = F.col(f"{s}.qx") - F.col(f"{s}.px"), F.col(f"{s}.qy") - F.col(f"{s}.py")
        return (dx * (F.col(f"{o}.{e}y") - F.col(f"{s}.py")) - dy * (F.col(f"{o}.{e}x") - F.col(f"{s}.px"))) / F.sqrt(dx * dx + dy * dy + 1e-300)

    def parted(s: str, o: str) -> Column:
        p, q = turn(s, o, "p"), turn(s, o, "q")
        return (F.least(p, q) < -size) & (F.greatest(p, q) > size)

    return parted("a", "b") & parted("b", "a")


def simplify_layer(layer: DataFrame, tolerance: float, size: float, key: str = "id", geom: str = "geom") -> DataFrame:
    """``layer`` with fewer vertices and no new gap or overlap between neighbours.

    Borders are cut where other than two sides meet, and what lies between two such places
    is simplified (Douglas-Peucker) alike for all areas that have it; the places are found
    by two shuffles of sides, an area then sees but its own.  An area that would become
    invalid, or whose new sides would cross another side, keeps all its vertices, and its
    neighbours those they share with it: rounds until none is left.  Areas that cross
    others before are therefore left alone.  Null shapes stay null."""
    layer = spatial.cut_lineage(noded(layer, size, key, geom))
    points = spatial.cut_lineage(vertices(layer, key, geom=geom).select("*", F.round("x", DIGITS).alias("rx"), F.round("y", DIGITS).alias("ry")))
    nodes = spatial.cut_lineage(junctions(points, segments(points, key)))

    @F.pandas_udf("struct<geom:binary,same:boolean,valid:boolean>")
    def run(shapes: pd.Series, at: pd.Series) -> pd.DataFrame:
        rows = []
        for shape, places in zip(shapes, at):
            if shape is None:
                rows.append((None, True, True))
                continue
            g = wkb.parse(shape)
            new = arcs_simplified(g, {(p[0] + 0.0, p[1] + 0.0) for p in places} if places is not None else set(), tolerance)
            rows.append((wkb.dump(new), new == g, new == g or arr.is_valid(new)))
        return pd.DataFrame(rows, columns=["geom", "same", "valid"])

    kept = layer.select(key).limit(0)
    while True:
        marks = nodes.union(points.join(kept, key, "left_semi").select("rx", "ry")).distinct()
        own = points.join(marks, ["rx", "ry"], "left_semi").groupBy(key).agg(F.collect_list(F.array("rx", "ry")).alias("_at"))
        done = spatial.cut_lineage(layer.join(own, key, "left").withColumn("_new", run(geom, "_at")).drop("_at"))
        new = segments(vertices(done.select(key, F.col("_new.geom").alias("geom")), key), key)
        changed = new.join(done.where("NOT _new.same").select(key), key, "left_semi")
        crossed = spatial.box_join(changed, new, size).where(_crossing(ON_LINE)).select(F.explode(F.array(f"a.{key}", f"b.{key}")).alias(key))
        spoiled = done.where("NOT _new.valid").select(key).union(crossed).distinct()
        spoiled = spatial.cut_lineage(spoiled.join(kept, key, "left_anti"))
        if spoiled.isEmpty():
            return done.withColumn(geom, F.col("_new.geom")).select(*layer.columns)
        kept = spatial.cut_lineage(kept.union(spoiled))
