"""Queries of ``operators.topology`` over areas of the driver's customers and lines along
them, planted so that closed forms in SQL tell the results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cadastra.functions import geo
from cadastra.geometry import wkb
from cadastra.operators import spatial, topology

from . import enumeration
from . import geometry_ops as ops
from .fixtures import CELL, duck, load
from .geometry_queries import _engine, _polygons
from .registry import query

A = duck("areas")
#: Offsets of a quarter at most are snapped or bridged.
TOLERANCE = 0.25


def _areas(spark, sf):
    return load(spark, sf, "areas").select("id", *spatial.BOX)


def _line(*points: str):
    return F.array(*[F.array(F.expr(f"CAST({p.split(',')[0]} AS DOUBLE)"), F.expr(f"CAST({p.split(',')[1]} AS DOUBLE)")) for p in points])


# Three sides of a box: the right one starts id % 4 tenths above its corner, the upper one
# is whole; a stub beside them is id % 4 tenths long.
@query("G25_refine_lines", f"""{A}, l AS (SELECT id, x1-x0 AS w, y1-y0 AS h, id % 4 AS k FROM areas)
 SELECT id, CASE WHEN k = 3 THEN 3 ELSE 1 END AS lines, floor((w + h - k * 0.1 + CASE WHEN k IN (1, 2) THEN k * 0.1 ELSE 0 END + w + CASE WHEN k = 3 THEN 0.3 ELSE 0 END) * 1e6 + 0.5) / 1e6 AS length FROM l""")
def g25(spark, sf):
    """Bridged where the gap is at most a quarter; stubs under a quarter go."""
    base = _areas(spark, sf).withColumn("g", F.expr("id % 4 * 0.1D"))
    rows = F.array(_line("x0,y0", "x1,y0"), _line("x1,y0 + g", "x1,y1"), _line("x1,y1", "x0,y1"), _line("x0,y1 + 5", "x0 + g,y1 + 5"))
    lines = base.select("id", F.posexplode(rows).alias("line", "points")).where("line < 3 OR id % 4 > 0")
    done = topology.refine_lines(lines, ["id"], TOLERANCE, TOLERANCE)
    found = done.withColumn("length", topology.line_length(F.col("points"))).groupBy("id").agg(F.count("*").alias("lines"), F.sum("length").alias("length"))
    return found.select("id", "lines", geo.floor_round(F.col("length"), 6).alias("length"))


_D = "CASE WHEN id % 4 = 3 THEN 0 ELSE (id % 4) * 0.1 END"


def _offset_targets(spark, sf, above: str):
    d = F.expr("id % 4 * 0.1D")
    return _areas(spark, sf).select("id", (F.col("x1") + d).alias("px"), (F.col("y0") - 1).alias("py"), (F.col("x1") + d).alias("qx"), (F.col("y1") + F.expr(above)).alias("qy"))


def _shapes(spark, sf):
    return _areas(spark, sf).select("id", wkb.rectangle(*[F.col(c) for c in spatial.BOX]).alias("geom"))


@query("G18_snap_closest", f"{A} SELECT id, floor((x1-x0 + {_D}) * (y1-y0) * 1e6 + 0.5) / 1e6 AS area FROM areas")
def g18_closest(spark, sf):
    done = topology.snap(_shapes(spark, sf), _offset_targets(spark, sf, "1"), TOLERANCE, CELL, on=["id"])
    return done.select("id", geo.floor_round(ops.area_of("geom"), 6).alias("area"))


@query("G18_snap_nodes", f"{A} SELECT id, floor(((x1-x0 + {_D}) * (y1-y0) + CASE WHEN id % 4 = 1 THEN (x1-x0 + 0.1) * 0.1 / 2 ELSE 0 END) * 1e6 + 0.5) / 1e6 AS area FROM areas")
def g18_nodes(spark, sf):
    """The target ends as far above the corner as it lies beside it: a tenth of both is
    near enough for its end, two tenths for its line only."""
    done = topology.snap(_shapes(spark, sf), _offset_targets(spark, sf, "id % 4 * 0.1D"), TOLERANCE, CELL, nodes=True, on=["id"])
    return done.select("id", geo.floor_round(ops.area_of("geom"), 6).alias("area"))


@query("G23_allocate_residue", f"""{A}, l AS (SELECT id, x1-x0 AS w, y1-y0 AS h FROM areas)
 SELECT id, 0 AS part, h + CASE WHEN w <= 3 THEN h + w - 2 ELSE 0 END AS area FROM l UNION ALL SELECT id, 1, (w - 2) * (h - 1) + CASE WHEN w > 3 THEN h + w - 2 ELSE 0 END FROM l""")
def g23(spark, sf):
    """Left over are an upright strip between the parts and one above the right part."""
    base = _areas(spark, sf)
    left = base.select("id", F.lit(0).alias("part"), wkb.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + 1, F.col("y1")).alias("geom"))
    right = base.select("id", F.lit(1).alias("part"), wkb.rectangle(F.col("x0") + 2, F.col("y0"), F.col("x1"), F.col("y1") - 1).alias("geom"))
    done = topology.allocate_residue(_shapes(spark, sf), left.union(right))
    return done.select("id", "part", geo.floor_round(ops.area_of("geom"), 6).alias("area"))


@query("G24_clean_vertices", f"""{A} SELECT id * 2 AS id, CASE WHEN id % 3 = 1 THEN 4 ELSE 5 END AS points, CASE WHEN id % 3 = 2 THEN floor(((x1-x0) * (y1-y0) - (y1-y0) * 0.002 / 2) * 1e6 + 0.5) / 1e6 ELSE (x1-x0) * (y1-y0) END AS area FROM areas
 UNION ALL SELECT id * 2 + 1, 4, 3 * (y1-y0) FROM areas""")
def g24(spark, sf):
    """Two neighbours a customer; the left one has a vertex 0, 1 or 2 thousandths inside
    its right side.  On the border it stays, within the tolerance it goes, beyond it stays."""
    @F.pandas_udf("binary")
    def dented(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([wkb.dump([[[(a, b), (a + c, b), (a + c - e, b + k / 2), (a + c, b + k), (a, b + k)]]]) for a, b, c, k, e in zip(x, y, w, h, d)])

    base = _areas(spark, sf).select("id", F.expr("20D * (id % 1000)").alias("x"), F.expr("20D * (id div 1000)").alias("y"), F.expr("x1 - x0").alias("w"), F.expr("y1 - y0").alias("h"))
    left = base.select((F.col("id") * 2).alias("id"), F.col("id").alias("parent"), dented("x", "y", "w", "h", F.expr("id % 3 * 0.001D")).alias("geom"))
    right = base.select((F.col("id") * 2 + 1).alias("id"), F.col("id").alias("parent"), wkb.rectangle(F.col("x") + F.col("w"), F.col("y"), F.col("x") + F.col("w") + 3, F.col("y") + F.col("h")).alias("geom"))
    done = topology.clean_vertices(left.union(right), 0.0015, CELL)
    count = topology.vertices(done, "id").groupBy("id").agg(F.count("*").cast("int").alias("points"))
    return done.select("id", geo.floor_round(ops.area_of("geom"), 6).alias("area")).join(count, "id")





# From every box a bar along its lower side and one that starts in the middle of it.
@query("G13_dangles", f"""{A}, l AS (SELECT 2*id AS id, x0 AS px, y0 AS py, x1 AS qx, y0 AS qy FROM areas UNION ALL SELECT 2*id+1, (x0+x1)/2, y0, (x0+x1)/2, y1 FROM areas),
 e AS (SELECT id, 0 AS "end", px AS x, py AS y FROM l UNION ALL SELECT id, 1, qx, qy FROM l)
 SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id <> e.id AND e.x BETWEEN l.px AND l.qx AND e.y BETWEEN l.py AND l.qy)""")
def g13_dangles(spark, sf):
    base = _areas(spark, sf)
    low = base.select((F.col("id") * 2).alias("id"), _line("x0,y0", "x1,y0").alias("points"))
    up = base.select((F.col("id") * 2 + 1).alias("id"), _line("(x0 + x1) / 2,y0", "(x0 + x1) / 2,y1").alias("points"))
    return topology.dangles(low.union(up), CELL)


@query("G13_duplicate_shapes", f"{A}, g AS (SELECT x0, y0, x1, y1, min(id) AS first, count(*) AS copies FROM (SELECT * FROM areas UNION ALL SELECT * REPLACE (-id AS id) FROM areas WHERE id % 3 = 0) GROUP BY ALL HAVING count(*) > 1) SELECT a.id, first, copies FROM (SELECT * FROM areas UNION ALL SELECT * REPLACE (-id AS id) FROM areas WHERE id % 3 = 0) a JOIN g USING (x0, y0, x1, y1) WHERE a.id <> first")
def g13_duplicates(spark, sf):
    """Copies run the other way, start elsewhere and have a point more."""
    @F.pandas_udf("binary")
    def turned(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([wkb.dump([[[(r, s), (r, (q + s) / 2), (r, q), (p, q), (p, s)]]]) for p, q, r, s in zip(a, b, c, d)])

    base = _areas(spark, sf)
    copies = base.where("id % 3 = 0").select((-F.col("id")).alias("id"), turned(*spatial.BOX).alias("geom"))
    return topology.duplicates(_shapes(spark, sf).union(copies))


@query("E12_conserved", f"""{duck('eas', 'buildings')}, o AS (SELECT pid, min(ea_id) AS ea_id FROM buildings b JOIN eas e ON b.x BETWEEN e.x0 AND e.x1 AND b.y BETWEEN e.y0 AND e.y1 GROUP BY pid),
 t AS (SELECT ea_id, sum(hh * 20)::DOUBLE AS hh, count(*) AS n FROM o JOIN buildings USING (pid) GROUP BY ea_id)
 SELECT parent, sum(coalesce(t.hh, hhcount))::DOUBLE AS hh, sum(coalesce(n, 0))::BIGINT AS buildings FROM eas LEFT JOIN t USING (ea_id) GROUP BY parent""")
def e12_conserved(spark, sf):
    """Households and buildings of every parent after splits and merges: none is lost."""
    eas, buildings = _engine(spark, sf)
    done = enumeration.delineate(eas, buildings)
    return done.groupBy("parent").agg(geo.floor_round(F.sum("hh"), 6).alias("hh"), F.sum("bldg_count").cast("long").alias("buildings"))


_PLACES = """s AS (SELECT s_suppkey, ((s_suppkey*37)%197)::DOUBLE AS x, ((s_suppkey*53)%193)::DOUBLE AS y FROM supplier), r AS (SELECT c_custkey, 1000 + 3.5 * ((c_custkey*53)%1193) AS x, 9 + 0.25 * ((c_custkey*37)%1009) AS y FROM customer),
 su AS (SELECT s_suppkey, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS y FROM s), ru AS (SELECT c_custkey, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS y FROM r)"""


def _control(spark, sf):
    source = load(spark, sf, "supplier").select("s_suppkey", F.expr("CAST((s_suppkey*37)%197 AS DOUBLE)").alias("x"), F.expr("CAST((s_suppkey*53)%193 AS DOUBLE)").alias("y"))
    reference = load(spark, sf, "customer").select("c_custkey", F.expr("1000 + 3.5D * ((c_custkey*53)%1193)").alias("x"), F.expr("9 + 0.25D * ((c_custkey*37)%1009)").alias("y"))
    return source, reference


@query("J14_nearest_in_place", f"WITH {_PLACES} SELECT s_suppkey, c_custkey FROM su, ru QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY (su.x-ru.x)*(su.x-ru.x) + (su.y-ru.y)*(su.y-ru.y), c_custkey) = 1")
def j14_nearest(spark, sf):
    return spatial.control_points(*_control(spark, sf), "s_suppkey", "c_custkey", on="barangay")


@query("J14_by_position", "SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) USING (n)")
def j14_position(spark, sf):
    source, reference = _control(spark, sf)
    return spatial.control_points(source.drop("x", "y"), reference.drop("x", "y"), "s_suppkey", "c_custkey")


_HELD = f"""{duck('eas', 'buildings')}, o AS (SELECT pid, min(ea_id) AS ea_id FROM buildings b JOIN eas e ON b.x BETWEEN e.x0 AND e.x1 AND b.y BETWEEN e.y0 AND e.y1 GROUP BY pid),
 t AS (SELECT ea_id, sum(hh * 20)::DOUBLE AS hh, count(*) AS n FROM o JOIN buildings USING (pid) GROUP BY ea_id)"""


@query("E19_split_rounds", f"{_HELD} SELECT ea_id, coalesce(t.hh, hhcount)::DOUBLE AS hh, coalesce(n, 0)::BIGINT AS buildings, (x1-x0)*(y1-y0) AS area, true AS settled FROM eas LEFT JOIN t USING (ea_id)")
def e19_rounds(spark, sf):
    """Households, buildings and ground of every area over its parts after the rounds,
    and whether each part is under the limit or lies where no split is possible.  Ground
    to four places: shapes are snapped to 2 ** -22 at these coordinates."""
    eas, buildings = _engine(spark, sf)
    parts = enumeration.split_rounds(eas, buildings, rounds=8)
    return parts.groupBy("ea_id").agg(
        geo.floor_round(F.sum("hh"), 6).alias("hh"), F.sum(F.size("buildings")).cast("long").alias("buildings"),
        geo.floor_round(F.sum(ops.area_of("geom")), 4).alias("area"), F.bool_and(~F.col("open")).alias("settled"))


@query("E19_variant", f"{_HELD} SELECT parent, sum(coalesce(t.hh, hhcount))::DOUBLE AS hh, sum(coalesce(n, 0))::BIGINT AS buildings FROM eas LEFT JOIN t USING (ea_id) GROUP BY parent")
def e19(spark, sf):
    """Households and buildings of every parent after the variant engine."""
    eas, buildings = _engine(spark, sf)
    done = enumeration.variant(eas, buildings, eas.where("hhcount >= 300").select("ean", "hhcount"))
    return done.groupBy("parent").agg(geo.floor_round(F.sum("hh"), 6).alias("hh"), F.sum("bldg_count").cast("long").alias("buildings"))


_LADDER = "CASE WHEN o_orderkey % 1000 = 7 THEN 3000.0 WHEN o_orderkey % 50 = 3 THEN 90.0 ELSE 1 + o_orderkey % 3 END"


@query("J03_boxes_of_all_sizes", f"""{A}, b AS (SELECT o_orderkey, ((o_orderkey*7919)%2000)::DOUBLE AS x0, ((o_orderkey*6101)%2000)::DOUBLE AS y0, x0 + ({_LADDER})::DOUBLE AS x1, y0 + ({_LADDER})::DOUBLE AS y1 FROM orders)
 SELECT o_orderkey, count(*) AS n, min(id) AS least FROM b JOIN areas a ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 GROUP BY o_orderkey""")
def j03_sizes(spark, sf):
    """Boxes from a side of one to one over the whole extent, with the areas they meet."""
    side = F.expr(_LADDER).cast("double")
    x, y = F.expr("CAST((o_orderkey*7919)%2000 AS DOUBLE)"), F.expr("CAST((o_orderkey*6101)%2000 AS DOUBLE)")
    boxes = load(spark, sf, "orders").select("o_orderkey", x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side).alias("y1"))
    met = spatial.scaled_box_join(boxes, load(spark, sf, "areas").select("id", *spatial.BOX), 4.0)
    return met.groupBy(F.col("a.o_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.min("b.id").alias("least"))
