"""Queries that need the polygon kernel.  Areas are rectangles with whole corners, so
areas of overlays can be counted by unit cells in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cadastra.functions import geo
from cadastra.geometry import wkb
from cadastra.operators import polygons, spatial

from . import enumeration, special
from . import geometry_ops as ops
from .fixtures import CELL, duck, duck_sql, load
from .registry import query

E, A = duck("eas"), duck("areas")
UNIT = "SELECT {k}, count(DISTINCT gx * 100000 + gy)::DOUBLE AS area FROM (SELECT {k}, gx, unnest(range(y0::BIGINT, y1::BIGINT)) AS gy FROM (SELECT {k}, y0, y1, unnest(range(x0::BIGINT, x1::BIGINT)) AS gx FROM {t})) GROUP BY {k}"


def _polygons(spark, sf):
    return load(spark, sf, "eas").withColumn("geom", wkb.rectangle(*[F.col(c) for c in spatial.BOX]))


@query("A03_dissolve", f"{E} {UNIT.format(k='parent', t='eas')}")
def a03(spark, sf):
    return ops.dissolve(_polygons(spark, sf), "parent").select("parent", geo.floor_round(ops.area_of("geom"), 6).alias("area"))


@query("G02_make_valid", f"{A} SELECT id, ((x1-x0)*(y1-y0))/2 AS area FROM areas")
def g02(spark, sf):
    @F.pandas_udf("binary")
    def bow(a, b, c, d):
        import pandas as pd

        return pd.Series([wkb.dump([[[(p, q), (r, s), (r, q), (p, s)]]]) for p, q, r, s in zip(a, b, c, d)])

    df = polygons.dealt(load(spark, sf, "areas").select("id", *spatial.BOX)).select("id", bow(*[F.col(c) for c in spatial.BOX]).alias("g"))
    return df.select("id", geo.floor_round(ops.area_of(ops.make_valid_of("g")), 6).alias("area"))


@query("G06_difference", f"{A} SELECT a.id AS id1, b.id AS id2, (a.x1-a.x0)*(a.y1-a.y0) - (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS area FROM areas a JOIN areas b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def g06(spark, sf):
    areas = load(spark, sf, "areas").select("id", *spatial.BOX).withColumn("g", wkb.rectangle(*[F.col(c) for c in spatial.BOX]))
    p = polygons.dealt(spatial.overlap_pairs(areas, CELL))
    return p.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), geo.floor_round(ops.area_of(ops.difference_of("a.g", "b.g")), 6).alias("area"))


def _holes(shown: str = "true") -> str:
    """Views of the ground that a parent's areas enclose: ``k`` has the cells of each hole
    with the place of its least cell.  Free cells reached from outside are no holes."""
    step = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy)"
    return f"""WITH RECURSIVE eas AS ({duck_sql("eas")}), u AS (SELECT DISTINCT parent, gx, unnest(range(y0::BIGINT, y1::BIGINT)) AS gy FROM (SELECT parent, y0, y1, unnest(range(x0::BIGINT, x1::BIGINT)) AS gx FROM eas WHERE {shown})),
 b AS (SELECT parent, min(gx) - 1 AS a, max(gx) + 1 AS c, min(gy) - 1 AS b, max(gy) + 1 AS d FROM u GROUP BY parent),
 g AS (SELECT parent, gx, unnest(range(b, d + 1)) AS gy FROM (SELECT *, unnest(range(a, c + 1)) AS gx FROM b) EXCEPT SELECT parent, gx, gy FROM u),
 o AS (SELECT parent, a AS gx, b AS gy FROM b UNION SELECT g.parent, g.gx, g.gy FROM o, {step} JOIN g ON g.parent = o.parent AND g.gx = o.gx + dx AND g.gy = o.gy + dy),
 h AS (SELECT * FROM g EXCEPT SELECT * FROM o),
 r AS (SELECT parent, gx, gy, gx AS sx, gy AS sy FROM h UNION SELECT r.parent, h.gx, h.gy, sx, sy FROM r, {step} JOIN h ON h.parent = r.parent AND h.gx = r.gx + dx AND h.gy = r.gy + dy),
 k AS (SELECT parent, gx, gy, min((sx, sy)) AS hole FROM r GROUP BY ALL)"""


@query("G09_gap_finder", f"{_holes()}, z AS (SELECT parent, hole, count(*)::DOUBLE AS area FROM k GROUP BY ALL) SELECT parent, (row_number() OVER (PARTITION BY parent ORDER BY area DESC) - 1)::INT AS part, area FROM z")
def g09(spark, sf):
    return ops.gap_finder(_polygons(spark, sf), "parent").select("parent", "part", geo.floor_round(F.col("area"), 6).alias("area"))


@query("G12_polygonize", f"{E} {UNIT.format(k='parent', t='eas')}")
def g12(spark, sf):
    import pandas as pd

    from cadastra.geometry import arrangement as arr

    def run(pdf):
        faces = arr.Arrangement([wkb.parse(g) for g in pdf["geom"]]).faces()
        return pd.DataFrame([(pdf["parent"].iloc[0], float(sum(arr.area(f) for f, label in faces if label.any())))], columns=["parent", "area"])

    done = polygons.dealt(_polygons(spark, sf).select("parent", "geom"), "parent").groupBy("parent").applyInPandas(run, "parent string, area double")
    return done.select("parent", geo.floor_round(F.col("area"), 6).alias("area"))


@query("G13_layer_checks", f"{E} SELECT ea_id AS fid, 'null' AS issue FROM eas WHERE ea_id % 50 = 0 UNION ALL SELECT min(ea_id), 'duplicate' FROM eas WHERE ea_id % 50 > 0 GROUP BY x0, y0, x1, y1 HAVING count(*) > 1")
def g13(spark, sf):
    layer = _polygons(spark, sf).select(F.col("ea_id").alias("fid"), F.when(F.col("ea_id") % 50 > 0, F.col("geom")).alias("geom"))
    return ops.check_layer(layer)


@query("G14_repair", f"{E} SELECT parent, ea_id AS fid, (x1-x0)*(y1-y0) AS area, ea_id % 10 = 0 AS repaired FROM eas")
def g14(spark, sf):
    layer = _polygons(spark, sf).select("parent", F.col("ea_id").alias("fid"), "geom")
    done = ops.repair(layer, "parent", selected=F.col("fid") % 10 == 0)
    return done.select("parent", "fid", geo.floor_round(ops.area_of("geom"), 6).alias("area"), "repaired")


@query("G15_recover_null", f"""{_holes("ea_id % 41 > 0")}, f AS (SELECT parent FROM eas GROUP BY parent HAVING count(*) > 1 AND count(*) FILTER (ea_id % 41 = 0) = 1 AND parent IN (SELECT parent FROM h))
 SELECT parent, ea_id AS fid, ea_id % 41 = 0 AND parent IN (FROM f) AS recovered, ea_id % 41 = 0 AND parent NOT IN (FROM f) AS missing FROM eas""")
def g15(spark, sf):
    layer = _polygons(spark, sf).select("parent", F.col("ea_id").alias("fid"), F.when(F.col("ea_id") % 41 > 0, F.col("geom")).alias("geom"))
    return ops.recover_null(layer, "parent").select("parent", "fid", "recovered", F.col("geom").isNull().alias("missing"))


@query("G17_gap_fill", f"""{_holes()}, t AS (SELECT parent, min(ea_id) AS ea_id FROM eas WHERE hhcount > 200 GROUP BY parent), q AS (SELECT * FROM t JOIN eas USING (parent, ea_id)),
 n AS (SELECT DISTINCT k.parent, hole FROM k JOIN q ON k.parent = q.parent AND (gx BETWEEN x0 - 1 AND x1 AND gy BETWEEN y0 AND y1 - 1 OR gx BETWEEN x0 AND x1 - 1 AND gy BETWEEN y0 - 1 AND y1)),
 f AS (SELECT parent, count(*)::DOUBLE AS gained FROM k JOIN n USING (parent, hole) GROUP BY parent)
 SELECT parent, 'original' AS role, ea_id AS fid, (x1-x0)*(y1-y0) AS area FROM q UNION ALL SELECT parent, 'result', ea_id, (x1-x0)*(y1-y0) + coalesce(gained, 0) FROM q LEFT JOIN f USING (parent) UNION ALL SELECT parent, 'gap_fill', ea_id, gained FROM q JOIN f USING (parent)""")
def g17(spark, sf):
    layer = _polygons(spark, sf)
    box = spatial.extent(layer, "parent")
    layer = layer.join(box, "parent").withColumn("extent", wkb.rectangle(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))
    done = ops.gap_fill(layer, "parent", "ea_id", "geom", F.col("hhcount") > 200, F.col("extent"))
    return done.select("parent", "role", "ea_id" if "ea_id" in done.columns else "fid", geo.floor_round(F.col("area"), 6).alias("area"))


def _engine(spark, sf):
    eas = _polygons(spark, sf).select("ea_id", "ean", "parent", F.col("hhcount").cast("double").alias("hhcount"), F.col("eadel_indi").isNotNull().alias("flagged"), "geom")
    pts = load(spark, sf, "buildings")
    owner = spatial.first_containing(pts.select("pid", "x", "y"), load(spark, sf, "eas").select("ea_id", *spatial.BOX), CELL, "pid", "ea_id")
    inside = owner.join(pts, "pid").join(eas.select("ea_id", "parent"), "ea_id")
    hh = (F.col("hh") * 20).cast("double")
    from pyspark.sql import Window

    total = F.sum(hh).over(Window.partitionBy("ea_id"))
    return eas, inside.select("ea_id", "parent", "x", "y", hh.alias("hh"), (hh / total).alias("value"))


@query("E12_delineate")
def e12(spark, sf):
    eas, buildings = _engine(spark, sf)
    return enumeration.delineate(eas, buildings).select("parent", "ea_id", "new_ea", "hh", "bldg_count", "split_by", "sink")


@query("E17_split_lines")
def e17(spark, sf):
    eas, buildings = _engine(spark, sf)
    return enumeration.split_borders(enumeration.delineate(eas, buildings), tolerance=0.05).select("parent", "ea_id", "line", geo.floor_round(F.col("length"), 6).alias("length"))


_CROSS = "{a}.x0 < {b}.x1 AND {b}.x0 < {a}.x1 AND {a}.y0 < {b}.y1 AND {b}.y0 < {a}.y1"
_BOTH = "greatest({a}.x0,{b}.x0) AS x0, greatest({a}.y0,{b}.y0) AS y0, least({a}.x1,{b}.x1) AS x1, least({a}.y1,{b}.y1) AS y1"


def _boxes(a: str, b: str) -> tuple[str, str]:
    return _BOTH.format(a=a, b=b), _CROSS.format(a=a, b=b)


_AB, _IP, _CE = _boxes("a", "b"), _boxes("i", "p"), _boxes("c", "e")


@query("E01_inject_special", f"""{duck('areas', 'eas')}, i AS (SELECT a.id*10000000 + b.id AS issue, {_AB[0]} FROM areas a JOIN areas b ON a.id < b.id AND {_AB[1]}),
 p AS (SELECT DISTINCT parent, CAST((ea_id*31)%211 // 40 * 40 + 230*(ea_id // 1000) AS DOUBLE) AS x0, CAST((ea_id*59)%199 // 40 * 40 AS DOUBLE) AS y0, x0 + 40 AS x1, y0 + 40 AS y1 FROM (SELECT parent, ea_id FROM eas)),
 c AS (SELECT * FROM (SELECT issue, parent, {_IP[0]} FROM i JOIN p ON {_IP[1]}) QUALIFY row_number() OVER (PARTITION BY issue ORDER BY (x1-x0)*(y1-y0) DESC, parent) = 1),
 m AS (SELECT issue, ea_id, {_CE[0]} FROM c JOIN eas e ON {_CE[1]}),
 o AS (SELECT issue, ea_id FROM m QUALIFY row_number() OVER (PARTITION BY issue ORDER BY (x1-x0)*(y1-y0) DESC, ea_id) = 1),
 f AS (SELECT parent, min(ea_id) AS first FROM eas GROUP BY parent), n AS ({UNIT.format(k='ea_id', t='m')})
 SELECT c.parent, (SELECT max(ea_id) FROM eas) + row_number() OVER (ORDER BY c.issue) AS fid, c.issue, coalesce(o.ea_id, f.first) AS source_id, s.ean, (c.x1-c.x0)*(c.y1-c.y0) AS area
 FROM c LEFT JOIN o USING (issue) LEFT JOIN f ON f.parent = c.parent LEFT JOIN eas s ON s.ea_id = coalesce(o.ea_id, f.first)
 UNION ALL SELECT parent, ea_id, NULL, NULL, ean, (x1-x0)*(y1-y0) - coalesce(n.area, 0) FROM eas LEFT JOIN n USING (ea_id)""")
def e01(spark, sf):
    """Overlaps of areas as special areas, taken out of the enumeration areas."""
    areas = load(spark, sf, "areas").select("id", *spatial.BOX)
    pairs = spatial.overlap_pairs(areas, CELL).select((F.col("a.id") * 10_000_000 + F.col("b.id")).alias("issue"), wkb.rectangle(*[F.col(c) for c in spatial.BOX]).alias("geom"))
    x, y = F.expr("CAST((ea_id*31)%211 div 40 * 40 + 230*(ea_id div 1000) AS DOUBLE)"), F.expr("CAST((ea_id*59)%199 div 40 * 40 AS DOUBLE)")
    parents = load(spark, sf, "eas").select("parent", x.alias("px"), y.alias("py")).distinct().select("parent", wkb.rectangle(F.col("px"), F.col("py"), F.col("px") + 40, F.col("py") + 40).alias("geom"))
    done = special.inject_special(_polygons(spark, sf).select("ea_id", "parent", "ean", "geom"), pairs, parents, CELL)
    return done.select("parent", F.col("ea_id").alias("fid"), "issue", "source_id", "ean", geo.floor_round(ops.area_of("geom"), 6).alias("area"))


_PAIRS = f"FROM areas a JOIN areas b ON a.id < b.id AND {_AB[1]}"
_COMMON = "(least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0))"


def _overlapping(spark, sf):
    areas = load(spark, sf, "areas").select("id", *spatial.BOX).withColumn("g", wkb.rectangle(*[F.col(c) for c in spatial.BOX]))
    pairs = spatial.overlap_pairs(areas, CELL).select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), F.col("a.g").alias("g1"), F.col("b.g").alias("g2"))
    return polygons.dealt(pairs)


@query("G05_intersection", f"{A} SELECT a.id AS id1, b.id AS id2, {_AB[0]} {_PAIRS}")
def g05(spark, sf):
    found = spatial.cut_lineage(_overlapping(spark, sf).select("id1", "id2", ops.intersection_of("g1", "g2").alias("geom")))
    return polygons.boxed(found).select("id1", "id2", *[geo.floor_round(F.col(c), 6).alias(c) for c in spatial.BOX])


@query("G07_union_area", f"{A} SELECT a.id AS id1, b.id AS id2, (a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) - {_COMMON} AS area {_PAIRS}")
def g07(spark, sf):
    return _overlapping(spark, sf).select("id1", "id2", geo.floor_round(ops.area_of(ops.union_of("g1", "g2")), 6).alias("area"))


def _multi(spark, sf):
    """Areas of three parts: the box, a sliver of side 0.01 and a square beside them."""
    @F.pandas_udf("binary")
    def make(i: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def box(x, y, w, h):
            return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]

        return pd.Series([wkb.dump([box(x0, y0, x1 - x0, y1 - y0), box(x0, y1 + 1, 0.01, 0.01), box(x1 + 10, y0, 1 + k % 3, 1 + k % 3)]) for k, x0, y0, x1, y1 in zip(i, a, b, c, d)])

    return load(spark, sf, "areas").select("id", make("id", *spatial.BOX).alias("geom"))


@query("G03_single_parts", f"{A} SELECT id, part, CASE part WHEN 0 THEN (x1-x0)*(y1-y0) WHEN 1 THEN 1e-4 ELSE (1+id%3)*(1+id%3)::DOUBLE END AS area FROM areas, (SELECT unnest([0, 1, 2]) AS part)")
def g03(spark, sf):
    return ops.single_parts(_multi(spark, sf)).select("id", "part", geo.floor_round(ops.area_of("geom"), 6).alias("area"))


@query("G29_force_single", f"{A} SELECT id, greatest((x1-x0)*(y1-y0), (1+id%3)*(1+id%3)::DOUBLE) AS area FROM areas")
def g29(spark, sf):
    return _multi(spark, sf).select("id", geo.floor_round(ops.area_of(ops.largest_part_of("geom")), 6).alias("area"))


@query("A19_sliver_cleanup", f"{A} SELECT id, (x1-x0)*(y1-y0) + (1+id%3)*(1+id%3) AS area FROM areas")
def a19(spark, sf):
    return ops.without_slivers(_multi(spark, sf), "id").select("id", geo.floor_round(ops.area_of("geom"), 6).alias("area"))
