"""Everyday joins of true polygons: areas and enumeration areas as L-shapes, whose common
ground SQL can count by unit cells and whose borders it can compare by two boxes each."""

from __future__ import annotations

import os
import shutil
import uuid

import pandas as pd
from pyspark.sql import functions as F

from cadastra.functions import codes, geo
from cadastra.geometry import wkb
from cadastra.operators import polygons, spatial, topology
from cadastra.sources import layers, packages

from . import enumeration
from . import geometry_ops as ops
from .fixtures import CELL, duck, load
from .polygon_queries import shapes
from .registry import query


def _parts(name: str, of: str, *more: str) -> str:
    """Two boxes that make up each L-shape of ``of``, as view ``name``."""
    more = ", ".join(more)
    return f"{name} AS (SELECT {more}, x0, x1, y0, my AS y1 FROM {of} UNION ALL SELECT {more}, x0, mx, y0, y1 FROM {of})"


def _cells(name: str, of: str, key: str) -> str:
    """Unit cells of each L-shape of ``of``, as view ``name``."""
    return f"{name} AS (SELECT {key}, gx, gy FROM (SELECT {key}, mx, my, gx, unnest(range(y0::BIGINT, y1::BIGINT)) AS gy FROM (SELECT {key}, mx, my, y0, y1, unnest(range(x0::BIGINT, x1::BIGINT)) AS gx FROM {of})) WHERE NOT (gx >= mx AND gy >= my))"


_BASE = ", ".join([
    duck("areas", "buildings", "eas"),
    "l AS (SELECT *, x0 + 1 + id % 2 AS mx, y0 + 1 + id % 2 AS my FROM areas)", "el AS (SELECT *, x0 + 2 + ea_id % 2 AS mx, y0 + 2 + ea_id % 2 AS my FROM eas)",
    _parts("r", "l", "id", "region"), _parts("er", "el", "ea_id", "parent", "hhcount", "eadel_indi"), _cells("c", "l", "id"), _cells("ec", "el", "ea_id"),
])
_MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
_HIT = "b.x BETWEEN a.x0 AND a.x1 AND b.y BETWEEN a.y0 AND a.y1 AND NOT (b.x > a.mx AND b.y > a.my)"
_BEST = "z AS (SELECT ea_id, id, count(*)::DOUBLE AS area FROM ec JOIN c USING (gx, gy) GROUP BY 1, 2), s AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY ea_id ORDER BY area DESC, id) = 1)"


def _eas(spark, sf):
    @F.pandas_udf("binary")
    def notched(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([wkb.dump([[[(x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1)]]]) for x0, y0, x1, y1, mx, my in zip(a, b, c, d, e, f)])

    cut = 2 + F.col("ea_id") % 2
    return load(spark, sf, "eas").withColumn("geom", notched("x0", "y0", "x1", "y1", F.col("x0") + cut, F.col("y0") + cut)).drop("x0", "y0", "x1", "y1")


def _points(spark, sf):
    return load(spark, sf, "buildings").select("pid", "x", "y")


@query("J03_polygon_location", f"{_BASE}, m AS (SELECT DISTINCT a.ea_id, b.id FROM er a JOIN r b ON {_MEET}) SELECT eas.ea_id, m.id AS area_id FROM eas LEFT JOIN m USING (ea_id)")
def j03(spark, sf):
    met = polygons.left_polygon_join(_eas(spark, sf).select("ea_id", "geom"), shapes(spark, sf).select("id", "geom"), CELL, "ea_id")
    return met.select(F.col("a.ea_id").alias("ea_id"), F.col("b.id").alias("area_id"))


# the points are counted before the outer join, which some engines get wrong on inequalities
@query("J06_polygon_count", f"{_BASE}, n AS (SELECT a.id, count(*) AS n FROM l a JOIN buildings b ON {_HIT} GROUP BY a.id) SELECT id, coalesce(n, 0) AS num_bldg_pts FROM areas LEFT JOIN n USING (id)")
def j06(spark, sf):
    return polygons.count_points(shapes(spark, sf).select("id", "geom"), _points(spark, sf), CELL).select("id", "num_bldg_pts")


@query("J07_polygon_parent", f"{_BASE}, {_BEST} SELECT ea_id, id, area FROM s")
def j07(spark, sf):
    return polygons.best_overlap(_eas(spark, sf), shapes(spark, sf), CELL, "ea_id", "id")


@query("J08_polygon_resolve", f"{_BASE}, {_BEST} SELECT e.ea_id, coalesce(CASE WHEN e.ea_id % 4 = 0 THEN substr(parent, 1, 9) END, lpad(CAST(s.id AS VARCHAR), 9, '0'), 'Unknown') AS parent FROM eas e LEFT JOIN s USING (ea_id)")
def j08(spark, sf):
    """An own code first, then the area of the largest common ground."""
    eas = _eas(spark, sf)
    own = F.when(F.col("ea_id") % 4 == 0, F.substring(codes.clean_code(F.concat("parent", F.lit(".0"))), 1, 9))
    found = eas.join(polygons.best_overlap(eas, shapes(spark, sf), CELL, "ea_id", "id"), "ea_id", "left")
    return found.select("ea_id", F.coalesce(own, F.lpad(F.col("id").cast("string"), 9, "0"), F.lit("Unknown")).alias("parent"))


@query("J10_polygon_adjacency", f"{_BASE} SELECT DISTINCT a.ea_id, b.ea_id AS neighbour FROM er a JOIN er b ON a.parent = b.parent AND a.ea_id <> b.ea_id AND {_MEET} WHERE b.hhcount < 300")
def j10(spark, sf):
    eas = _eas(spark, sf)
    pairs = polygons.adjacency(eas, CELL, "ea_id", "parent")
    open_ = spatial.not_broadcast(eas.where("hhcount < 300").select(F.col("ea_id").alias("neighbour")))
    return pairs.join(open_, "neighbour", "left_semi").select("ea_id", "neighbour")


@query("J16_polygon_select", f"{_BASE} SELECT DISTINCT a.ea_id FROM er a JOIN r b ON {_MEET} AND b.region = 'ASIA'")
def j16(spark, sf):
    return polygons.semi_join(_eas(spark, sf), shapes(spark, sf).where("region = 'ASIA'"), CELL, "ea_id").select("ea_id")


@query("J17_polygon_lookup", f"{_BASE} SELECT b.pid, string_agg(a.geocode, ',' ORDER BY a.geocode) AS codes FROM buildings b JOIN l a ON {_HIT} GROUP BY b.pid")
def j17(spark, sf):
    met = polygons.point_join(_points(spark, sf), shapes(spark, sf).select("geocode", "geom"), CELL)
    return met.groupBy(F.col("a.pid").alias("pid")).agg(F.array_join(F.sort_array(F.collect_list("b.geocode")), ",").alias("codes"))


@query("P08_polygon_subset", f"{_BASE} SELECT DISTINCT b.pid FROM buildings b JOIN l a ON {_HIT} AND a.city_mun = 'BUILDING'")
def p08(spark, sf):
    return polygons.point_join(_points(spark, sf), shapes(spark, sf).where("city_mun = 'BUILDING'").select("id", "geom"), CELL).select(F.col("a.pid").alias("pid")).distinct()


@query("E03_polygon_partners", f"{_BASE}, m AS (SELECT DISTINCT a.ea_id, b.ea_id AS other FROM er a JOIN er b ON a.parent = b.parent AND a.ea_id <> b.ea_id AND {_MEET} AND b.hhcount < 300 WHERE a.hhcount <= 100) SELECT ea_id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS partners FROM m GROUP BY ea_id")
def e03(spark, sf):
    eas = _eas(spark, sf).select("ea_id", "parent", "hhcount", "geom")
    met = polygons.polygon_join(eas.where("hhcount <= 100"), eas.where("hhcount < 300"), CELL, on=["parent"]).where("a.ea_id <> b.ea_id")
    return met.groupBy(F.col("a.ea_id").alias("ea_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("b.ea_id")), lambda x: x.cast("string")), ",").alias("partners"))


@query("E04_polygon_buildings", f"{_BASE} SELECT b.pid, min(a.ea_id) AS ea_id FROM buildings b JOIN el a ON {_HIT} AND (a.hhcount >= 300 OR a.hhcount <= 100) GROUP BY b.pid")
def e04(spark, sf):
    wanted = _eas(spark, sf).where("hhcount >= 300 OR hhcount <= 100").select("ea_id", "geom")
    return polygons.first_containing(_points(spark, sf), wanted, CELL, "pid", "ea_id")


@query("E06_polygon_needed", f"{_BASE}, w AS (SELECT * FROM er WHERE hhcount >= 300 OR hhcount <= 100 OR eadel_indi IS NOT NULL) SELECT ea_id FROM w UNION SELECT b.ea_id FROM w a JOIN er b ON a.parent = b.parent AND a.ea_id <> b.ea_id AND {_MEET}")
def e06(spark, sf):
    eas = _eas(spark, sf).select("ea_id", "parent", "hhcount", "eadel_indi", "geom")
    wanted = eas.where("hhcount >= 300 OR hhcount <= 100 OR eadel_indi IS NOT NULL")
    met = polygons.polygon_join(wanted, eas, CELL, on=["parent"]).where("a.ea_id <> b.ea_id")
    return wanted.select("ea_id").union(met.select(F.col("b.ea_id").alias("ea_id"))).distinct()


@query("E02_classify_issues", f"""{_BASE}, ov AS (SELECT DISTINCT gx, gy FROM c p JOIN c q USING (gx, gy) JOIN areas s ON s.id = p.id JOIN areas t ON t.id = q.id WHERE p.id < q.id AND s.region = 'ASIA' AND t.region = 'ASIA'),
 m AS (SELECT DISTINCT ea_id FROM er JOIN ov ON x0 <= gx + 1 AND gx <= x1 AND y0 <= gy + 1 AND gy <= y1)
 SELECT ea_id, CASE WHEN ea_id IN (FROM m) OR lower(trim(eadel_indi)) IN ('for delineation', 'for_delineation') OR hhcount >= 300 THEN 'delineate' WHEN ea_id % 7 = 0 THEN 'merge' ELSE 'none' END AS class, CASE WHEN hhcount > 0 THEN 300.0::DOUBLE / hhcount ELSE 1.0 END AS ratio FROM eas""")
def e02(spark, sf):
    """Enumeration areas that meet an overlap of a region's areas are flagged by it; the
    merge flag, set for every seventh, decides instead of the count."""
    flag = F.when(F.col("ea_id") % 7 == 0, " For Merging").when(F.col("ea_id") % 7 == 3, "no")
    issues = polygons.overlap_polygons(shapes(spark, sf).where("region = 'ASIA'").select("id", "geom"), CELL).select("geom")
    return enumeration.classified(_eas(spark, sf).withColumn("merge_indi", flag), issues, CELL, merge="merge_indi").select("ea_id", "class", "ratio")


@query("S12_packages", f"{duck('areas')} SELECT replace(province, '_', '-') || '_2025_03_bgy' AS layer, '2025_03' AS file_date, count(*) AS n, sum((x1-x0)*(y1-y0) - (x1-x0-1-id%2)*(y1-y0-1-id%2)) AS area FROM areas GROUP BY province")
def s12(spark, sf):
    """A package per province, written to the shared folder and read back with the dates
    that their names tell."""
    path = os.path.join(packages.local_path(spatial.shared_folder(spark)), f"packages-{uuid.uuid4().hex}")
    packages.write_geopackages(shapes(spark, sf).select("id", F.translate("province", "_", "-").alias("code"), "geom"), path, "code", "areas {geocode}_2025_03 bgy")
    try:
        rows = layers.read_packages(spark, path, "id long, geom binary")
        found = rows.groupBy("layer").agg(F.count("*").alias("n"), geo.floor_round(F.sum(ops.area_of("geom")), 6).alias("area"))
        return spatial.cut_lineage(found.join(layers.gpkg_layers(spark, path).select("layer", "file_date"), "layer")).select("layer", "file_date", "n", "area")
    finally:
        shutil.rmtree(path, ignore_errors=True)


# A quarter around an L-shape: five corners are round, at the inner one two strips share a
# square; within it five corners share one and the inner one is round.
@query("G10_buffer", f"""{_BASE}, s AS (SELECT id, (x1-x0)*(y1-y0) - (x1-mx)*(y1-my) AS area, 2 * (x1-x0 + y1-y0) AS round, 0.0625 * 4 * sin(pi() / 16) AS fan FROM l)
 SELECT id, floor((area + round / 4 + 5 * fan - 0.0625) * 1e6 + 0.5) / 1e6 AS outer_area, floor((area - round / 4 + 5 * 0.0625 - fan) * 1e6 + 0.5) / 1e6 AS inner_area FROM s""")
def g10(spark, sf):
    layer = polygons.dealt(shapes(spark, sf).select("id", "geom"))
    return layer.select("id", geo.floor_round(ops.area_of(ops.buffer_of("geom", 0.25)), 6).alias("outer_area"), geo.floor_round(ops.area_of(ops.buffer_of("geom", -0.25)), 6).alias("inner_area"))


# Two neighbours with a bend of id % 4 tenths in their border and a third above both, whose
# lower side has no vertex where the two meet.
@query("G28_simplify_layer", f"""{duck('areas')}, s AS (SELECT id, x1-x0 AS w, y1-y0 AS h, id % 4 = 3 AS bent FROM areas)
 SELECT id * 3 AS id, CASE WHEN bent THEN 5 ELSE 4 END AS points, floor((w * h - CASE WHEN bent THEN 0.15 * h ELSE 0 END) * 1e6 + 0.5) / 1e6 AS area FROM s
 UNION ALL SELECT id * 3 + 1, CASE WHEN bent THEN 5 ELSE 4 END, floor((3 * h + CASE WHEN bent THEN 0.15 * h ELSE 0 END) * 1e6 + 0.5) / 1e6 FROM s UNION ALL SELECT id * 3 + 2, 5, 2 * (w + 3) FROM s""")
def g28(spark, sf):
    """Bends of less than a quarter go, in both neighbours alike; the place where three
    areas meet stays and becomes a vertex of the third."""
    @F.pandas_udf("array<binary>")
    def three(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, e: pd.Series) -> pd.Series:
        rows = []
        for a, b, c, k, d in zip(x, y, w, h, e):
            bend = (a + c - d, b + k / 2)
            left = [(a, b), (a + c, b), bend, (a + c, b + k), (a, b + k)]
            right = [(a + c, b), (a + c + 3, b), (a + c + 3, b + k), (a + c, b + k), bend]
            rows.append([wkb.dump([[r]]) for r in (left, right, [(a, b + k), (a + c + 3, b + k), (a + c + 3, b + k + 2), (a, b + k + 2)])])
        return pd.Series(rows)

    base = load(spark, sf, "areas").select("id", three(F.expr("20D * (id % 1000)"), F.expr("20D * (id div 1000)"), F.expr("x1 - x0"), F.expr("y1 - y0"), F.expr("id % 4 * 0.1D")).alias("g"))
    layer = base.select("id", F.posexplode("g").alias("k", "geom")).select((F.col("id") * 3 + F.col("k")).alias("id"), "geom")
    done = topology.simplify_layer(layer, 0.25, CELL)
    count = topology.vertices(done, "id").groupBy("id").agg(F.count("*").cast("int").alias("points"))
    return done.select("id", geo.floor_round(ops.area_of("geom"), 6).alias("area")).join(count, "id").select("id", "points", "area")
