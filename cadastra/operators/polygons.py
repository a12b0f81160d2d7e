"""Joins of true polygons: the grid finds boxes that meet, the kernel tests shapes.

Areas have a WKB column; every predicate and overlay is evaluated on candidate pairs in
Arrow batches, so nothing but pairs whose boxes meet reaches Python."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cadastra.geometry import arrangement as arr
from cadastra.geometry import wkb

from . import spatial

RELATION = "struct<intersects:boolean,contains:boolean,equals:boolean,touches:boolean,overlaps:boolean,within:boolean,area:double>"
#: Predicates by the number that location joins of desktop systems give them.
PREDICATES = {0: "intersects", 1: "contains", 2: "equals", 3: "touches", 4: "overlaps", 5: "within"}


def _bounds(geom: pd.Series) -> pd.DataFrame:
    found = [arr.bounds(g) if (g := wkb.parse(v)) else (None,) * 4 for v in geom]
    return pd.DataFrame(found, columns=list(spatial.BOX), dtype=float)


def boxed(areas: DataFrame, geom: str = "geom") -> DataFrame:
    """``areas`` that have a geometry, with its bounding box; dealt, as small files with
    many areas come in one partition."""
    return dealt(areas.where(F.col(geom).isNotNull())).withColumn("_b", F.pandas_udf(_bounds, "struct<x0:double,y0:double,x1:double,y1:double>")(geom)).select("*", *[F.col(f"_b.{c}").alias(c) for c in spatial.BOX]).drop("_b").where("NOT isnan(x0)")


def relate(a: arr.Geometry, b: arr.Geometry) -> tuple:
    """Every predicate of two areas and the size of their common part."""
    if arr.apart(a, b):
        return False, False, False, False, False, False, 0.0
    both = arr.Arrangement([a, b])
    sizes = np.maximum(np.array(both.areas), 0.0)  # of faces, without the holes' cycles
    common, only_a, only_b = both.labels.all(axis=1), both.labels[:, 0] & ~both.labels[:, 1], ~both.labels[:, 0] & both.labels[:, 1]
    tiny = 1e-12 * max(arr.area(a), arr.area(b))
    inner, left, right = (sizes[m].sum() > tiny for m in (common, only_a, only_b))
    size = arr.area(both.select(common)) if inner else 0.0
    meet = inner or bool({n for e in arr._cover(a, both) for n in both.edges[e]} & {n for e in arr._cover(b, both) for n in both.edges[e]})
    return bool(meet), bool(inner and not right), bool(inner and not left and not right), bool(meet and not inner), bool(inner and left and right), bool(inner and not left), float(size)


def _relations(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    names = [*PREDICATES.values(), "area"]
    return pd.DataFrame([relate(wkb.parse(x), wkb.parse(y)) for x, y in zip(a, b)], columns=names)


def relation(a: Column, b: Column) -> Column:
    """``relate`` of two WKB columns; marked as not repeatable, so that no filter takes it
    before the pairs are dealt or evaluates it twice."""
    return F.pandas_udf(_relations, RELATION).asNondeterministic()(a, b)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows in even partitions: the work on a shape is far more than its bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Rows that ``by_group`` hands on at a time.
GROUP_ROWS = 2000


def by_group(rows: DataFrame, keys: list[str], run: Callable, schema: str | StructType, order: list[str] = ()) -> DataFrame:
    """What ``run(key, rows)`` yields for each group of rows with equal ``keys`` (null is
    one too), which come as named tuples in the given order.  Groups are dealt by key and
    told apart in sorted partitions, so that small ones cost no frame each; a task holds
    one group at a time."""
    names = rows.columns
    kind = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    row = namedtuple("row", names, rename=True)
    at = [names.index(k) for k in keys]

    def read(batches) -> Iterator[tuple]:
        for b in batches:
            yield from map(row._make, zip(*(c.to_pylist() for c in b.columns)))

    def written(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    def each(batches) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, own in groupby(read(batches), key=lambda r: tuple([r[i] for i in at])):
            out += run(key, list(own))
            if len(out) >= GROUP_ROWS:
                yield written(out)
                out = []
        if out:
            yield written(out)

    return dealt(rows, *keys).sortWithinPartitions(*keys, *order).mapInArrow(each, schema)


def polygon_join(left: DataFrame, right: DataFrame, size: float, predicates: tuple[int, ...] = (0,), on: list[str] = (), geom: str = "geom", scaled: bool = False) -> DataFrame:
    """Pairs of areas as structs ``a`` and ``b`` with their relation ``r``, for which one
    of the ``predicates`` holds.  on: columns that must be equal besides.  Rows without
    a geometry meet nothing.  scaled: for layers whose areas differ much in size; the
    boxes, which are read twice then, are written to the shared folder first."""
    a, b = boxed(left, geom), boxed(right, geom)
    met = spatial.scaled_box_join(spatial.cut_lineage(a), spatial.cut_lineage(b), size, on=on) if scaled else spatial.box_join(a, b, size, on=on)
    found = dealt(met).withColumn("r", relation(F.col(f"a.{geom}"), F.col(f"b.{geom}")))
    hit = F.lit(False)
    for p in predicates:
        hit = hit | F.col(f"r.{PREDICATES[p]}")
    return found.where(hit)


def left_polygon_join(left: DataFrame, right: DataFrame, size: float, key: str, predicates: tuple[int, ...] = (0,), geom: str = "geom") -> DataFrame:
    """One row per pair; left rows without any keep a null ``b``."""
    met = polygon_join(left, right, size, predicates, geom=geom).select(F.col(f"a.{key}").alias("k"), "b")
    return left.select(F.struct(*left.columns).alias("a")).join(spatial.not_broadcast(met), F.col(f"a.{key}") == F.col("k"), "left").select("a", "b")


def point_join(points: DataFrame, areas: DataFrame, size: float, geom: str = "geom") -> DataFrame:
    """``(a, b)``: points ``x, y`` and the areas that hold them, their border included."""
    @F.pandas_udf("boolean")
    def holds(shape: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bool(arr.contains(wkb.parse(g), np.array([[p, q]]))[0]) for g, p, q in zip(shape, x, y)])

    met = dealt(spatial.box_join(points, boxed(areas, geom), size))
    return met.where(holds.asNondeterministic()(F.col(f"b.{geom}"), F.col("a.x"), F.col("a.y")))


def first_containing(points: DataFrame, areas: DataFrame, size: float, point_key: str, area_key: str, geom: str = "geom") -> DataFrame:
    """``(point key, area key)``: the area of least key that holds the point."""
    met = point_join(points, areas, size, geom)
    return met.groupBy(F.col(f"a.{point_key}").alias(point_key)).agg(F.min(f"b.{area_key}").alias(area_key))


def count_points(areas: DataFrame, points: DataFrame, size: float, key: str = "id", geom: str = "geom") -> DataFrame:
    """``areas`` with ``num_bldg_pts``, the points inside, zero where none."""
    n = point_join(points, areas.select(key, geom), size, geom).groupBy(F.col(f"b.{key}").alias(key)).agg(F.count("*").alias("num_bldg_pts"))
    return areas.join(spatial.not_broadcast(n), key, "left").withColumn("num_bldg_pts", F.coalesce("num_bldg_pts", F.lit(0)).cast("long"))


#: Decimals at which two common areas are the same.
AREA_DIGITS = 9


def best_overlap(left: DataFrame, right: DataFrame, size: float, left_key: str, right_key: str, geom: str = "geom") -> DataFrame:
    """``(left key, right key, area)`` of the largest common part; ties: least key.  Left
    areas that only touch others, or meet none, give no row."""
    met = polygon_join(left.select(left_key, geom), right.select(right_key, geom), size, geom=geom)
    met = met.select(F.col(f"a.{left_key}").alias(left_key), F.round("r.area", AREA_DIGITS).alias("area"), F.col(f"b.{right_key}").alias(right_key)).where("area > 0")
    best = met.groupBy(left_key).agg(F.min(F.struct((-F.col("area")).alias("m"), F.col(right_key).alias("k"))).alias("o"))
    return best.select(left_key, F.col("o.k").alias(right_key), (-F.col("o.m")).alias("area"))


def adjacency(areas: DataFrame, size: float, key: str, parent: str, geom: str = "geom") -> DataFrame:
    """Ordered pairs of different areas of one parent that touch or intersect."""
    shapes = areas.select(key, parent, geom)
    met = polygon_join(shapes, shapes, size, on=[parent], geom=geom).where(F.col(f"a.{key}") != F.col(f"b.{key}"))
    return met.select(F.col(f"a.{key}").alias(key), F.col(f"b.{key}").alias("neighbour"), F.col(f"a.{parent}").alias(parent))


def semi_join(left: DataFrame, right: DataFrame, size: float, key: str, predicates: tuple[int, ...] = (0,), geom: str = "geom") -> DataFrame:
    """Rows of ``left`` that meet any area of ``right`` by one of the predicates."""
    hits = polygon_join(left.select(key, geom), right.select(geom), size, predicates, geom=geom).select(F.col(f"a.{key}").alias(key)).distinct()
    return left.join(spatial.not_broadcast(hits), key, "left_semi")


def overlap_polygons(areas: DataFrame, size: float, key: str = "id", geom: str = "geom") -> DataFrame:
    """``(a, b, part, geom, area, height, width)``: the parts of the common area of every
    two areas, with the sides of the smallest rectangle around a part."""
    shapes = boxed(areas, geom)
    met = dealt(spatial.box_join(shapes, shapes, size, closed=False).where(F.col(f"a.{key}") < F.col(f"b.{key}")))

    @F.pandas_udf("array<struct<geom:binary,area:double,height:double,width:double>>")
    def parts(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for g, h in zip(x, y):
            row = []
            for p in arr.intersection(wkb.parse(g), wkb.parse(h)):
                height, width = arr.min_rectangle(p[0])
                row.append({"geom": wkb.dump([p]), "area": arr.area([p]), "height": height, "width": width})
            out.append(row)
        return pd.Series(out)

    return met.select("a", "b", F.posexplode(parts.asNondeterministic()(F.col(f"a.{geom}"), F.col(f"b.{geom}"))).alias("part", "p")).select("a", "b", "part", "p.*")


FREE = "tile string, piece int, edge boolean, geom binary, borders array<struct<side:string,nx:long,ny:long,lo:double,hi:double>>"


#: Links of no more than so many are followed by one task, more by rounds before.
TASK_LINKS = 200_000


def _united(batches):
    """``(id, least id reachable)`` of every piece with a link."""
    above: dict[str, str] = {}

    def find(x: str) -> str:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            a, b = find(a), find(b)
            above[max(a, b)] = min(a, b)
    yield pd.DataFrame([(x, find(x)) for x in list(above)], columns=["a", "g"])


def _spread(pieces: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, gap, edge)``: the least name of linked pieces, whose ``links`` go both ways.

    In each round every piece hooks on to its first neighbour in a random order, what
    hangs together becomes one and the links between what is left go on: each round
    leaves half of the pieces at most, whatever way they are strung."""
    def order(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("k"))

    root, near = spatial.cut_lineage(pieces.select("id", F.col("id").alias("r"))), links
    while near.count() > TASK_LINKS:
        first = near.groupBy("a").agg(F.min(order("b")).alias("m"))
        up = spatial.cut_lineage(first.select("a", F.least("m", order("a"))["k"].alias("p")))
        while not (far := spatial.cut_lineage(up.join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p"))).where("p <> q").isEmpty():
            up = far.select("a", F.col("q").alias("p"))
        root = spatial.cut_lineage(root.join(up, F.col("r") == F.col("a"), "left").select("id", F.coalesce("p", "r").alias("r")))
        ends = [up.select(F.col("a").alias(c), F.col("p").alias(f"p{c}")) for c in "ab"]
        near = spatial.cut_lineage(near.join(ends[0], "a").join(ends[1], "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    rest = near.coalesce(1).mapInPandas(_united, "a string, g string")
    root = spatial.cut_lineage(root.join(rest, F.col("r") == F.col("a"), "left").select("id", F.coalesce("g", "r").alias("r")))
    least = root.groupBy("r").agg(F.min("id").alias("gap"))
    return spatial.cut_lineage(root.join(least, "r").join(pieces, "id").select("id", "gap", "edge"))


def empty_squares(occupied: DataFrame, levels: int) -> DataFrame:
    """``l, x, y``: the largest squares of ``2^l`` tiles in which no tile ``x, y`` of
    ``occupied`` lies, within the one of ``2^levels`` that holds them all.  Their number
    grows with the occupied tiles and the levels, not with the ground that is free."""
    up = [F.expr(f"shiftright({c}, l)").alias(c) for c in "xy"]
    held = spatial.cut_lineage(occupied.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("l")).select("l", *up).distinct())
    quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    below = held.where("l > 0").select((F.col("l") - 1).alias("l"), "x", "y", quarter.alias("s")).select("l", (F.col("x") * 2 + F.col("s.i")).alias("x"), (F.col("y") * 2 + F.col("s.j")).alias("y"))
    return below.join(held, ["l", "x", "y"], "left_anti")


def _over(l: str, x: Column, y: Column, levels: int) -> Column:
    """The squares of level ``l`` and above that hold the one at ``x, y``."""
    return F.transform(F.sequence(F.col(l), F.lit(levels)), lambda m: F.struct(m.alias("l"), *[F.call_function("shiftright", v, m - F.col(l)).alias(c) for c, v in (("x", x), ("y", y))]))


def gap_polygons(areas: DataFrame, tile: float, geom: str = "geom") -> DataFrame:
    """``(gap, geom, area)``: what all areas together enclose without covering it.

    The plane is cut into square tiles.  Free pieces are what a tile's areas leave of it
    and the largest squares of tiles without any area; those that share a stretch of
    border are one, and those that do not reach the border of the whole are gaps.  A task
    sees one tile's areas or one gap's pieces; free ground costs nothing by its size, so
    that areas may lie far apart."""
    shapes = boxed(areas.select(F.col(geom).alias("geom")))
    box = shapes.agg(F.floor((F.min("x0")) / tile).alias("a"), F.floor(F.min("y0") / tile).alias("b"), F.floor(F.max("x1") / tile).alias("c"), F.floor(F.max("y1") / tile).alias("d")).first()  # one row
    if box["a"] is None:
        return shapes.select(F.lit("").alias("gap"), "geom", F.lit(0.0).alias("area")).where("false")
    # a free tile at least on every side of the extent
    levels = int(max(box["c"] - box["a"], box["d"] - box["b"]) + 2).bit_length()
    held = spatial.cells(shapes, tile).select("cx", "cy", "geom")

    def free(key: tuple, own: list[tuple]) -> list[tuple]:
        cx, cy = key
        square = [[[(cx * tile, cy * tile), ((cx + 1) * tile, cy * tile), ((cx + 1) * tile, (cy + 1) * tile), (cx * tile, (cy + 1) * tile)]]]
        rest = arr.difference(square, *[wkb.parse(r.geom) for r in own])
        rows = []
        for i, p in enumerate(rest):
            borders = []
            for (px, py), (qx, qy) in zip(p[0], p[0][1:] + p[0][:1]):
                for on, side, nx, ny, lo, hi in ((px == qx == cx * tile, f"x|{cx}|{cy}", cx - 1, cy, py, qy), (py == qy == cy * tile, f"y|{cx}|{cy}", cx, cy - 1, px, qx), (px == qx == (cx + 1) * tile, f"x|{cx + 1}|{cy}", cx + 1, cy, py, qy), (py == qy == (cy + 1) * tile, f"y|{cx}|{cy + 1}", cx, cy + 1, px, qx)):
                    if on:
                        borders.append({"side": side, "nx": nx, "ny": ny, "lo": min(lo, hi), "hi": max(lo, hi)})
            rows.append((f"{cx}|{cy}", i, False, wkb.dump([p]), borders))
        return rows

    pieces = spatial.cut_lineage(by_group(held, ["cx", "cy"], free, FREE).withColumn("id", F.concat_ws("|", "tile", "piece")))
    shift = {"x": 1 - box["a"], "y": 1 - box["b"]}
    squares = empty_squares(held.select(*[(F.col(f"c{c}") + shift[c]).alias(c) for c in "xy"]).distinct(), levels)
    last = F.shiftleft(F.lit(1).cast("long"), levels)
    side = F.expr("shiftleft(1L, l)")
    outer = (F.col("x") == 0) | (F.col("y") == 0) | ((F.col("x") + 1) * side == last) | ((F.col("y") + 1) * side == last)
    squares = spatial.cut_lineage(squares.select("l", "x", "y", F.concat_ws("|", F.lit("q"), "l", "x", "y").alias("id"), outer.alias("edge")))

    sides = pieces.select("id", F.explode("borders").alias("s")).select("id", "s.*")
    x, y = (sides.select(F.col("id").alias(k), "side", F.col("lo").alias(f"l{n}"), F.col("hi").alias(f"h{n}")) for n, k in ((1, "a"), (2, "b")))
    links = x.join(y, "side").where("a <> b AND l1 < h2 AND l2 < h1").select("a", "b")
    near = sides.select("id", F.lit(0).alias("l"), *[(F.col(f"n{c}") + shift[c]).alias(c) for c in "xy"])
    for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
        near = near.union(squares.select("id", "l", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")))
    over = near.distinct().select(F.col("id").alias("a"), F.explode(_over("l", F.col("x"), F.col("y"), levels)).alias("o")).select("a", "o.*")
    beside = over.join(squares.select(F.col("id").alias("b"), "l", "x", "y"), ["l", "x", "y"]).select("a", "b")
    links = spatial.cut_lineage(links.union(beside).union(beside.select("b", "a")).distinct())

    named = pieces.select("id", "edge").union(squares.select("id", "edge"))
    label = _spread(named, links)
    closed = label.groupBy("gap").agg(F.max("edge").alias("open")).where("NOT open").select("gap")
    corner = [((F.col(c) * side - shift[c]) * tile, ((F.col(c) + 1) * side - shift[c]) * tile) for c in "xy"]
    ground = squares.where("NOT edge").select("id", corner[0][0].alias("x0"), corner[1][0].alias("y0"), corner[0][1].alias("x1"), corner[1][1].alias("y1"))
    where = label.join(closed, "gap").select("id", "gap")
    inside = pieces.join(where, "id").select("gap", "geom").union(ground.join(where, "id").select("gap", wkb.rectangle(*[F.col(c) for c in spatial.BOX]).alias("geom")))

    def whole(key: tuple, own: list[tuple]) -> list[tuple]:
        g = arr.union([wkb.parse(r.geom) for r in own])
        return [(*key, wkb.dump(g), arr.area(g))]

    return by_group(inside, ["gap"], whole, "gap string, geom binary, area double")


def shape_area(geom: Column | str) -> Column:
    return wkb.geometry_udf(arr.area, "double")(geom)
