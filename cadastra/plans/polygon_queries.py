"""Queries over areas that are no rectangles: L-shapes, boxes less their upper right
corner, whose overlays SQL can count by unit cells and whose borders it can compare."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cadastra.functions import geo
from cadastra.geometry import wkb
from cadastra.operators import polygons

from . import boundary
from .fixtures import CELL, duck, load
from .registry import query

#: The corner that is cut off starts at (mx, my).
_L = "l AS (SELECT *, x0 + 1 + id % 2 AS mx, y0 + 1 + id % 2 AS my FROM areas)"
_CELLS = "c AS (SELECT id, gx, gy FROM (SELECT id, mx, my, gx, unnest(range(y0::BIGINT, y1::BIGINT)) AS gy FROM (SELECT id, mx, my, y0, y1, unnest(range(x0::BIGINT, x1::BIGINT)) AS gx FROM l)) WHERE NOT (gx >= mx AND gy >= my))"
_BASE = f"{duck('areas', 'buildings')}, {_L}, {_CELLS}"
_BOXES = "r AS (SELECT id, x0, x1, y0, my AS y1 FROM l UNION ALL SELECT id, x0, mx, y0, y1 FROM l)"


def shapes(spark, sf):
    @F.pandas_udf("binary")
    def make(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([wkb.dump([[[(x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1)]]]) for x0, y0, x1, y1, mx, my in zip(a, b, c, d, e, f)])

    cut = 1 + F.col("id") % 2
    return load(spark, sf, "areas").withColumn("geom", make("x0", "y0", "x1", "y1", F.col("x0") + cut, F.col("y0") + cut)).drop("x0", "y0", "x1", "y1")


@query("J04_polygon_overlaps", f"{_BASE} SELECT a.id AS id1, b.id AS id2, count(*)::DOUBLE AS area FROM c a JOIN c b ON a.gx = b.gx AND a.gy = b.gy AND a.id < b.id GROUP BY 1, 2")
def j04(spark, sf):
    found = polygons.overlap_polygons(shapes(spark, sf).select("id", "geom"), CELL)
    return found.groupBy(F.col("a.id").alias("id1"), F.col("b.id").alias("id2")).agg(geo.floor_round(F.sum("area"), 6).alias("area"))


@query("J05_polygon_points", f"{_BASE} SELECT b.pid, min(l.id) AS id, count(*) AS areas FROM buildings b JOIN l ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND NOT (x > mx AND y > my) GROUP BY b.pid")
def j05(spark, sf):
    met = polygons.point_join(load(spark, sf, "buildings").select("pid", "x", "y"), shapes(spark, sf).select("id", "geom"), CELL)
    return met.groupBy(F.col("a.pid").alias("pid")).agg(F.min("b.id").alias("id"), F.count("*").alias("areas"))


@query("P16_polygon_predicates", f"""{_BASE}, {_BOXES}, n AS (SELECT id, count(*) AS n FROM c GROUP BY id), o AS (SELECT a.id, b.id AS other, count(*) AS n FROM c a JOIN c b ON a.gx = b.gx AND a.gy = b.gy AND a.id <> b.id GROUP BY 1, 2),
 m AS (SELECT DISTINCT a.id, b.id AS other FROM r a JOIN r b ON a.id <> b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
 SELECT m.id, m.other, coalesce(o.n = q.n, false) AS contains, coalesce(o.n = p.n AND o.n = q.n, false) AS equals, o.n IS NULL AS touches, coalesce(o.n < p.n AND o.n < q.n, false) AS overlaps, coalesce(o.n = p.n, false) AS within FROM m LEFT JOIN o USING (id, other) JOIN n p ON p.id = m.id JOIN n q ON q.id = m.other""")
def p16(spark, sf):
    areas = shapes(spark, sf).select("id", "geom")
    met = polygons.polygon_join(areas, areas, CELL, (0,)).where("a.id <> b.id")
    return met.select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), *[F.col(f"r.{p}").alias(p) for p in ("contains", "equals", "touches", "overlaps", "within")])


@query("P17_polygon_codes", f"{_BASE}, o AS (SELECT DISTINCT a.id, b.id AS other FROM c a JOIN c b ON a.gx = b.gx AND a.gy = b.gy AND a.id <> b.id), {_BOXES}, m AS (SELECT DISTINCT a.id, b.id AS other FROM r a JOIN r b ON a.id <> b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1) SELECT l.id, count(m.other) AS touching FROM l LEFT JOIN (SELECT * FROM m EXCEPT SELECT * FROM o) m USING (id) GROUP BY l.id")
def p17(spark, sf):
    areas = shapes(spark, sf).select("id", "geom")
    met = polygons.left_polygon_join(areas, areas, CELL, "id", (3,))
    return met.groupBy(F.col("a.id").alias("id")).agg(F.count("b.id").alias("touching"))


@query("overlap_report_polygons")
def overlaps(spark, sf):
    done = boundary.polygon_overlap_report(shapes(spark, sf), load(spark, sf, "buildings").select("pid", "x", "y"), CELL)
    return done.select("id1", "id2", "part", "involved_areas", "count_involved_areas", "mbi_area", "height", "width", "num_bldg_pts", "mbi_level")


@query("gap_report")
def gaps(spark, sf):
    done = boundary.gap_report(shapes(spark, sf), load(spark, sf, "buildings").select("pid", "x", "y"), CELL)
    return done.select("gap", "involved_areas", "count_involved_areas", "mbi_area", "num_bldg_pts", "mbi_level")
