"""Queries for joins, matchers, aggregations, sequences and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.functions import codes, geo, names, rules
from cadastra.operators import relational as rel
from cadastra.operators import spatial

from .fixtures import CELL, duck, load
from .registry import query
from .scalar_queries import _barangay, _normal, _to_arabic, _to_roman

A, B, E, N, S, C = duck("areas"), duck("buildings"), duck("eas"), duck("names"), duck("survey"), duck("cases")
AB = duck("areas", "buildings")
HIT = "b.x >= a.x0 AND b.x <= a.x1 AND b.y >= a.y0 AND b.y <= a.y1"
MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
CROSS = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
COMMON = "(least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0))"


@query("J01_join_first", f"{A}, r AS (SELECT city_mun, min(geocode) AS psgc_geocode FROM areas GROUP BY city_mun) SELECT c_custkey, psgc_geocode FROM customer LEFT JOIN r ON c_mktsegment = city_mun")
def j01(spark, sf):
    right = load(spark, sf, "areas").select("city_mun", "geocode")
    left = load(spark, sf, "customer").withColumnRenamed("c_mktsegment", "city_mun")
    return rel.join_first(left, right, "city_mun", "geocode", "psgc_").select("c_custkey", "psgc_geocode")


@query("J02_join_all", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def j02(spark, sf):
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return rel.join_all(load(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey")


@query("J03_location_join", f"{duck('areas', 'eas')} SELECT a.ea_id, b.id AS area_id FROM eas a LEFT JOIN areas b ON {MEET}")
def j03(spark, sf):
    left = load(spark, sf, "eas").select("ea_id", *spatial.BOX)
    right = load(spark, sf, "areas").select("id", *spatial.BOX)
    return spatial.left_location_join(left, right, CELL, "ea_id").select(F.col("a.ea_id").alias("ea_id"), F.col("b.id").alias("area_id"))


@query("J04_overlap_pairs", f"{A} SELECT a.id AS id1, b.id AS id2, {COMMON} AS area FROM areas a JOIN areas b ON a.id < b.id AND {CROSS}")
def j04(spark, sf):
    pairs = spatial.overlap_pairs(load(spark, sf, "areas").select("id", *spatial.BOX), CELL)
    return pairs.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), spatial.box_area(*[F.col(c) for c in spatial.BOX]).alias("area"))


@query("J05_first_containing", f"{AB} SELECT b.pid, min(a.id) AS id FROM buildings b JOIN areas a ON {HIT} GROUP BY b.pid")
def j05(spark, sf):
    return spatial.first_containing(load(spark, sf, "buildings").select("pid", "x", "y"), load(spark, sf, "areas").select("id", *spatial.BOX), CELL, "pid", "id")


@query("J06_count_points", f"{AB} SELECT a.id, count(b.pid) AS num_bldg_pts FROM areas a LEFT JOIN buildings b ON {HIT} GROUP BY a.id")
def j06(spark, sf):
    return spatial.count_points(load(spark, sf, "areas").select("id", *spatial.BOX), load(spark, sf, "buildings").select("pid", "x", "y"), CELL).select("id", "num_bldg_pts")


@query("J07_parent_by_overlap", f"{duck('areas', 'eas')}, z AS (SELECT a.ea_id, b.id, {COMMON} AS area FROM eas a JOIN areas b ON {CROSS}) SELECT ea_id, id, area FROM z QUALIFY row_number() OVER (PARTITION BY ea_id ORDER BY area DESC, id) = 1")
def j07(spark, sf):
    return spatial.best_overlap(load(spark, sf, "eas").select("ea_id", *spatial.BOX), load(spark, sf, "areas").select("id", *spatial.BOX), CELL, "ea_id", "id")


@query("J08_resolve_parent", f"""{duck('areas', 'eas')}, z AS (SELECT a.ea_id, b.id, {COMMON} AS area FROM eas a JOIN areas b ON {CROSS}), s AS (SELECT ea_id, id FROM z QUALIFY row_number() OVER (PARTITION BY ea_id ORDER BY area DESC, id) = 1)
 SELECT e.ea_id, coalesce(CASE WHEN e.ea_id % 4 = 0 THEN substr(parent, 1, 9) END, lpad(CAST(s.id AS VARCHAR), 9, '0'), 'Unknown') AS parent FROM eas e LEFT JOIN s USING (ea_id)""")
def j08(spark, sf):
    eas = load(spark, sf, "eas")
    spatial_code = spatial.best_overlap(eas.select("ea_id", *spatial.BOX), load(spark, sf, "areas").select("id", *spatial.BOX), CELL, "ea_id", "id")
    own = F.when(F.col("ea_id") % 4 == 0, F.substring(codes.clean_code(F.concat("parent", F.lit(".0"))), 1, 9))
    return eas.join(spatial_code, "ea_id", "left").select("ea_id", F.coalesce(own, F.lpad(F.col("id").cast("string"), 9, "0"), F.lit("Unknown")).alias("parent"))


@query("J09_semi_active", f"{E} SELECT ea_id FROM eas WHERE parent IN (SELECT lpad(CAST((s_suppkey % 6)*1000 + s_suppkey % 5 AS VARCHAR), 9, '0') FROM supplier WHERE s_acctbal > 0)")
def j09(spark, sf):
    active = load(spark, sf, "supplier").where("s_acctbal > 0").select(F.lpad(((F.col("s_suppkey") % 6) * 1000 + F.col("s_suppkey") % 5).cast("string"), 9, "0").alias("parent"))
    return load(spark, sf, "eas").join(active, "parent", "left_semi").select("ea_id")


@query("J10_adjacency", f"{E} SELECT a.ea_id, b.ea_id AS neighbour FROM eas a JOIN eas b ON a.parent = b.parent AND a.ea_id <> b.ea_id AND {MEET} WHERE b.hhcount < 300")
def j10(spark, sf):
    eas = load(spark, sf, "eas").select("ea_id", "parent", "hhcount", *spatial.BOX)
    pairs = spatial.adjacency(eas, CELL, "ea_id", "parent")
    return pairs.join(eas.where("hhcount < 300").select(F.col("ea_id").alias("neighbour")), "neighbour", "left_semi").select("ea_id", "neighbour")


_D3 = """least(levenshtein(a, b), CASE WHEN an IS NOT NULL AND bn IS NOT NULL THEN CASE WHEN an = bn THEN levenshtein(ab, bb) ELSE 4 END ELSE levenshtein(ar, br) END, levenshtein(ax, bx))"""


def _forms(sql: str, p: str) -> str:
    split = "'^(.+?)\\s+(\\d+)$'"
    return f"SELECT *, nullif(regexp_extract({p}r, {split}, 2), '') AS {p}n, CASE WHEN regexp_matches({p}r, '^.+?\\s+\\d+$') THEN regexp_extract({p}r, {split}, 1) ELSE {p}r END AS {p}b FROM (SELECT *, {_to_arabic(p)} AS {p}r, {_to_roman(p)} AS {p}x FROM ({sql}))"


_PAIRS = f"""{duck('names', 'reference_names')}, s AS ({_forms(f"SELECT DISTINCT {_normal('name')} AS a FROM names", 'a')}), r AS ({_forms(f"SELECT ref_order, ref_name, {_normal('ref_name')} AS b FROM reference_names", 'b')})"""


@query("J11_fuzzy_all", f"{_PAIRS} SELECT a AS name, ref_name, {_D3} AS distance, CASE WHEN {_D3} = levenshtein(a, b) THEN 'DIRECT' ELSE 'ROMAN_NUMERAL' END AS method FROM s, r WHERE a <> '' AND {_D3} <= 3")
def j11(spark, sf):
    src = load(spark, sf, "names").select(names.normalize_name(F.col("name")).alias("a")).where("a <> ''").distinct()
    refs = load(spark, sf, "reference_names").withColumn("b", names.normalize_name(F.col("ref_name")))
    found = rel.fuzzy_all(src, refs, "a", "b", 3)
    return found.select(F.col("a").alias("name"), "ref_name", F.col("distance").cast("long").alias("distance"), "method")


_DR = "CASE WHEN an IS NOT NULL AND bn IS NOT NULL THEN CASE WHEN an = bn THEN levenshtein(ab, bb) END WHEN an IS NOT NULL OR bn IS NOT NULL THEN levenshtein(ar, br) WHEN levenshtein(ar, br) <= 2 THEN levenshtein(ar, br) END"


@query("J12_fuzzy_roman", f"{_PAIRS}, z AS (SELECT a AS name, ref_order, {_DR} AS distance FROM s, r WHERE a <> '') SELECT name, distance, ref_order FROM z WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, ref_order) = 1")
def j12(spark, sf):
    src = load(spark, sf, "names").select(names.normalize_name(F.col("name")).alias("name")).where("name <> ''").distinct()
    refs = load(spark, sf, "reference_names").withColumn("b", names.normalize_name(F.col("ref_name")))
    found = rel.fuzzy_roman(src, refs, "name", "name", "b", "ref_order", 3)
    return found.select("name", F.col("distance").cast("long").alias("distance"), "ref_order")


@query("J13_cascade_lookup", f"""{N}, e AS (SELECT lower(trim(p_name)) AS k, max_by(p_partkey, p_partkey) AS c FROM part GROUP BY 1), n AS (SELECT {_barangay('p_name')} AS k, max_by(p_partkey, p_partkey) AS c FROM part GROUP BY 1)
 SELECT id, coalesce(e.c, n.c) AS code, CASE WHEN e.c IS NOT NULL THEN 'EXACT' WHEN n.c IS NOT NULL THEN 'NORMALIZED' ELSE 'UNMATCHED' END AS status FROM names LEFT JOIN e ON e.k = lower(trim(name)) LEFT JOIN n ON n.k = {_barangay('name')}""")
def j13(spark, sf):
    refs = load(spark, sf, "part").select("p_name", "p_partkey", F.col("p_partkey").alias("o"))
    return rel.cascade_lookup(load(spark, sf, "names").select("id", "name"), refs, "name", "p_name", "p_partkey", "o").select("id", "code", "status")


@query("J13_cascade_close")
def j13_close(spark, sf):
    refs = load(spark, sf, "part").select("p_name", "p_partkey", F.col("p_partkey").alias("o"))
    return rel.cascade_lookup(load(spark, sf, "names").select("id", "name"), refs, "name", "p_name", "p_partkey", "o", cutoff=0.75).select("id", "code", "status")


@query("J14_control_points", f"{duck('names', 'reference_names')} SELECT n.id, ref_order FROM names n JOIN (SELECT lower(trim(ref_name)) AS k, min(ref_order) AS ref_order FROM reference_names GROUP BY 1) r ON lower(trim(n.clean)) = k")
def j14(spark, sf):
    refs = load(spark, sf, "reference_names").groupBy(F.lower(F.trim("ref_name")).alias("k")).agg(F.min("ref_order").alias("ref_order"))
    return load(spark, sf, "names").withColumn("k", F.lower(F.trim("clean"))).join(refs, "k").select("id", "ref_order")


@query("J15_nearest_neighbour", "SELECT a.s_suppkey, min(((a.s_suppkey*37)%197 - (b.s_suppkey*37)%197)**2 + ((a.s_suppkey*53)%193 - (b.s_suppkey*53)%193)**2) AS d2 FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND NOT ((a.s_suppkey*37)%197 = (b.s_suppkey*37)%197 AND (a.s_suppkey*53)%193 = (b.s_suppkey*53)%193) GROUP BY a.s_suppkey")
def j15(spark, sf):
    pts = load(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37) % 197).cast("double").alias("x"), ((F.col("s_suppkey") * 53) % 193).cast("double").alias("y"))
    return spatial.nearest(pts, pts.withColumnRenamed("s_suppkey", "other"), "s_suppkey", "other", 8.0).select("s_suppkey", "d2")


@query("J16_select_by_location", f"{duck('areas', 'eas')} SELECT DISTINCT a.ea_id FROM eas a JOIN areas b ON {MEET} AND b.region = 'ASIA'")
def j16(spark, sf):
    return spatial.semi_location(load(spark, sf, "eas").select("ea_id", *spatial.BOX), load(spark, sf, "areas").where("region = 'ASIA'").select("id", *spatial.BOX), CELL, "ea_id").select("ea_id")


@query("J17_form_lookup", f"{AB} SELECT b.pid, string_agg(a.geocode, ',' ORDER BY a.geocode) AS codes FROM buildings b JOIN areas a ON {HIT} GROUP BY b.pid")
def j17(spark, sf):
    met = spatial.box_join(load(spark, sf, "buildings").select("pid", "x", "y"), load(spark, sf, "areas").select("id", "geocode", *spatial.BOX), CELL)
    return met.groupBy(F.col("a.pid").alias("pid")).agg(F.array_join(F.sort_array(F.collect_list("b.geocode")), ",").alias("codes"))


@query("J18_anti_unmatched", f"{N} SELECT id, 'Unmatched' AS remarks, '1003' AS code FROM names WHERE {_normal('name')} NOT IN (SELECT p_name FROM part)")
def j18(spark, sf):
    src = load(spark, sf, "names").select("id", names.normalize_name(F.col("name")).alias("k"))
    refs = load(spark, sf, "part").select(F.col("p_name").alias("k"))
    return rel.anti_unmatched(src, refs, "k", {"remarks": "Unmatched", "code": "1003"}).select("id", "remarks", "code")


@query("J19_value_relation", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j19(spark, sf):
    return load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("P08_subset_ids", f"{AB} SELECT DISTINCT b.pid FROM buildings b JOIN areas a ON {HIT} AND a.city_mun = 'BUILDING'")
def p08(spark, sf):
    return spatial.semi_location(load(spark, sf, "buildings").select("pid", "x", "y"), load(spark, sf, "areas").where("city_mun = 'BUILDING'").select("id", *spatial.BOX), CELL, "pid").select("pid")


@query("P16_predicates", f"{A} SELECT a.id, b.id AS other, ({CROSS}) AS overlaps_inside, (a.x0 <= b.x0 AND a.x1 >= b.x1 AND a.y0 <= b.y0 AND a.y1 >= b.y1) AS contains FROM areas a JOIN areas b ON a.id <> b.id AND {MEET}")
def p16(spark, sf):
    areas = load(spark, sf, "areas").select("id", *spatial.BOX)
    met = spatial.box_join(areas, areas, CELL).where("a.id <> b.id")
    x0, y0, x1, y1 = spatial.common("a", "b")
    return met.select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), ((x0 < x1) & (y0 < y1)).alias("overlaps_inside"), F.expr("a.x0 <= b.x0 AND a.x1 >= b.x1 AND a.y0 <= b.y0 AND a.y1 >= b.y1").alias("contains"))


@query("P17_location_codes", f"{duck('areas', 'eas')} SELECT a.ea_id, count(*) AS n FROM eas a JOIN areas b ON {MEET} GROUP BY a.ea_id")
def p17(spark, sf):
    met = spatial.box_join(load(spark, sf, "eas").select("ea_id", *spatial.BOX), load(spark, sf, "areas").select("id", *spatial.BOX), CELL)
    return met.groupBy(F.col("a.ea_id").alias("ea_id")).agg(F.count("*").alias("n"))


@query("A01_involved_areas", f"""{A} SELECT city_mun AS issue_uuid, min(geocode) AS geocode, string_agg(geocode, ',' ORDER BY geocode) AS involved_areas, string_agg(barangay || ', ' || city_mun, ';' ORDER BY geocode) AS involved_bgys, count(*) AS count_involved_areas,
 count(DISTINCT region) AS n_region, count(DISTINCT province) AS n_province, count(DISTINCT city_mun) AS n_city_mun, count(DISTINCT barangay) AS n_barangay FROM areas GROUP BY city_mun""")
def a01(spark, sf):
    df = load(spark, sf, "areas").withColumn("issue_uuid", F.col("city_mun"))
    return rel.involved_areas(df, "issue_uuid").select("issue_uuid", "geocode", "involved_areas", "involved_bgys", "count_involved_areas", "n_region", "n_province", "n_city_mun", "n_barangay")


@query("A02_count_involved", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem")
def a02(spark, sf):
    return rel.with_group_count(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"])


@query("A04_sum_population", f"{AB}, m AS (SELECT b.pid, min(a.id) AS id FROM buildings b JOIN areas a ON {HIT} GROUP BY b.pid) SELECT id, sum(CASE WHEN hh > 1 THEN hh - 1 ELSE 1.0 END)::DOUBLE AS hh_count FROM m JOIN buildings USING (pid) GROUP BY id")
def a04(spark, sf):
    pts = load(spark, sf, "buildings")
    owner = spatial.first_containing(pts.select("pid", "x", "y"), load(spark, sf, "areas").select("id", *spatial.BOX), CELL, "pid", "id")
    return owner.join(pts.select("pid", "hh"), "pid").groupBy("id").agg(F.sum(rules.building_population(F.col("hh") - 1)).alias("hh_count"))


@query("A05_share_bpv", "SELECT l_orderkey, l_linenumber, coalesce(l_quantity / nullif(sum(l_quantity) OVER (PARTITION BY l_orderkey), 0), 0) AS share FROM lineitem")
def a05(spark, sf):
    total = F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.try_divide("l_quantity", total), F.lit(0.0)).alias("share"))


@query("A06_mean_per_building", f"{E} SELECT ea_id, coalesce(hhcount / nullif(CAST(ea_id % 7 AS DOUBLE), 0), 0) AS mean_pop FROM eas")
def a06(spark, sf):
    return load(spark, sf, "eas").select("ea_id", F.coalesce(F.try_divide(F.col("hhcount").cast("double"), (F.col("ea_id") % 7).cast("double")), F.lit(0.0)).alias("mean_pop"))


_HH = f"{AB}, s AS (SELECT a.id, sum(b.hh) AS n FROM areas a JOIN buildings b ON {HIT} GROUP BY a.id)"


@query("A07_impute_households", f"{_HH} SELECT a.id, coalesce(CAST(nullif(a.id % 5, 0) AS DOUBLE), CAST(n AS DOUBLE)) AS hh FROM areas a LEFT JOIN s USING (id)")
def a07(spark, sf):
    areas = load(spark, sf, "areas")
    met = spatial.box_join(load(spark, sf, "buildings").select("pid", "x", "y", "hh"), areas.select("id", *spatial.BOX), CELL)
    n = met.groupBy(F.col("b.id").alias("id")).agg(F.sum(rules.building_population(F.col("a.hh"))).alias("n"))
    return areas.join(n, "id", "left").select("id", F.coalesce(F.nullif((F.col("id") % 5).cast("double"), F.lit(0.0)), "n").alias("hh"))


@query("A08_fill_missing_households", f"{_HH} SELECT a.id, coalesce(CASE WHEN a.id % 5 > 0 THEN CAST(a.id % 5 - 1 AS DOUBLE) END, CAST(n AS DOUBLE)) AS hh FROM areas a LEFT JOIN s USING (id)")
def a08(spark, sf):
    areas = load(spark, sf, "areas")
    met = spatial.box_join(load(spark, sf, "buildings").select("pid", "x", "y", "hh"), areas.select("id", *spatial.BOX), CELL)
    n = met.groupBy(F.col("b.id").alias("id")).agg(F.sum(rules.building_population(F.col("a.hh"), 0.0)).alias("n"))
    return areas.join(n, "id", "left").select("id", F.coalesce(F.when(F.col("id") % 5 > 0, (F.col("id") % 5 - 1).cast("double")), "n").alias("hh"))


@query("A09_kpi_counts", f"{E} SELECT count(*) AS total, count(*) FILTER (hhcount > 300) AS delineation, count(*) FILTER (hhcount < 100) AS merging FROM eas")
def a09(spark, sf):
    return load(spark, sf, "eas").agg(F.count("*").alias("total"), F.count_if(F.col("hhcount") > 300).alias("delineation"), F.count_if(F.col("hhcount") < 100).alias("merging"))


@query("A10_count_per_barangay", f"{E} SELECT parent, count(*) AS n FROM eas GROUP BY parent")
def a10(spark, sf):
    return load(spark, sf, "eas").groupBy("parent").agg(F.count("*").alias("n"))


@query("A11_match_stats", f"{N}, z AS (SELECT CASE WHEN {_normal('name')} IN (SELECT p_name FROM part) THEN 'MATCHED' ELSE 'UNMATCHED' END AS match_status FROM names) SELECT match_status, count(*) AS n, floor(count(*) * 100.0 / sum(count(*)) OVER () * 10 + 0.5) / 10 AS pct FROM z GROUP BY match_status")
def a11(spark, sf):
    refs = load(spark, sf, "part").select(F.col("p_name").alias("k"), F.lit(1).alias("hit")).distinct()
    src = load(spark, sf, "names").select(names.normalize_name(F.col("name")).alias("k")).join(refs, "k", "left")
    n = src.groupBy(F.when(F.col("hit") == 1, "MATCHED").otherwise("UNMATCHED").alias("match_status")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", geo.floor_round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 1))


@query("A12_distinct_sorted", f"{N} SELECT DISTINCT trim(name) AS v FROM names WHERE trim(name) <> '' ORDER BY 1")
def a12(spark, sf):
    return load(spark, sf, "names").select(F.trim("name").alias("v")).where("v <> ''").distinct().orderBy("v")


@query("A13_code_tree", f"{A} SELECT substr(geocode, 1, 11) AS city, string_agg(DISTINCT geocode, ',' ORDER BY geocode) AS members FROM areas GROUP BY 1")
def a13(spark, sf):
    return load(spark, sf, "areas").groupBy(F.substring("geocode", 1, 11).alias("city")).agg(F.array_join(F.sort_array(F.collect_set("geocode")), ",").alias("members"))


@query("A14_case_report", f"""{C}, k AS (SELECT DISTINCT region, province, mbi_type FROM cases), n AS (SELECT province, mbi_type, count(*) AS total, count(*) FILTER (mbi_status = 'O') AS remaining FROM cases GROUP BY 1, 2), d AS (SELECT province, max_by(filed, load_order) AS updated FROM cases GROUP BY 1)
 SELECT region, province, mbi_type, total, remaining, updated FROM k JOIN n USING (province, mbi_type) JOIN d USING (province)""")
def a14(spark, sf):
    """Lines of an order share their number now and then, so cases their ``load_order``:
    of equal ones the first in the files counts, as in the SQL's engine, and none without
    a date."""
    c = load(spark, sf, "cases")
    at = load(spark, sf, "lineitem").select(
        F.expr("CAST(l_suppkey%11 AS STRING)").alias("province"), F.col("l_shipdate").alias("filed"),
        F.when(F.expr("l_shipdate IS NOT NULL AND l_orderkey + l_linenumber IS NOT NULL"), F.struct(F.expr("-(l_orderkey*10 + l_linenumber)"), "_metadata.file_path", "_metadata.row_index")).alias("place"))
    n = c.groupBy("province", "mbi_type").agg(F.count("*").alias("total"), F.count_if(F.col("mbi_status") == "O").alias("remaining"))
    d = at.groupBy("province").agg(F.min_by("filed", "place").alias("updated"))
    return c.select("region", "province", "mbi_type").distinct().join(n, ["province", "mbi_type"]).join(d, "province").select("region", "province", "mbi_type", "total", "remaining", "updated")


_LON, _LAT = "(121 + 0.00003*x - 0.00001*y + (pid%7)*0.000001)", "(14 + 0.00002*x + 0.00004*y - (pid%5)*0.000001)"


@query("A15_affine_fit", f"""{B}, p AS (SELECT pid, x, y, {_LON} AS lon, {_LAT} AS lat FROM buildings), c AS (SELECT regr_slope(lon, x) AS dummy, avg(x) AS mx, avg(y) AS my, avg(lon) AS ml, avg(lat) AS mt FROM p),
 s AS (SELECT sum((x-mx)*(x-mx)) AS uu, sum((x-mx)*(y-my)) AS uv, sum((y-my)*(y-my)) AS vv, sum((x-mx)*(lon-ml)) AS up, sum((y-my)*(lon-ml)) AS vp, sum((x-mx)*(lat-mt)) AS uq, sum((y-my)*(lat-mt)) AS vq FROM p, c)
 SELECT pid, floor((ml + ((up*vv-vp*uv)*(x-mx) + (vp*uu-up*uv)*(y-my))/(uu*vv-uv*uv))*100000 + 0.5)/100000 AS lon, floor((mt + ((uq*vv-vq*uv)*(x-mx) + (vq*uu-uq*uv)*(y-my))/(uu*vv-uv*uv))*100000 + 0.5)/100000 AS lat FROM p, c, s""")
def a15(spark, sf):
    df = load(spark, sf, "buildings").select("pid", "x", "y", F.expr(_LON).alias("lon"), F.expr(_LAT).alias("lat"))
    fit = rel.affine_fit(df, "x", "y", "lon", "lat")
    lon, lat = geo.affine(fit)(F.col("x"), F.col("y"))
    return df.select("pid", geo.floor_round(lon, 5).alias("lon"), geo.floor_round(lat, 5).alias("lat"))


@query("A16_residual_inliers", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_tax <= greatest(3 * (SELECT quantile_cont(l_quantity * l_tax, 0.5) FROM lineitem), 0.05)")
def a16(spark, sf):
    df = load(spark, sf, "lineitem").withColumn("res", F.col("l_quantity") * F.col("l_tax"))
    med = df.agg(F.percentile("res", 0.5)).first()[0]  # one number
    return df.where(F.col("res") <= max(3 * (med or 0.0), 0.05)).select("l_orderkey", "l_linenumber")


@query("A18_auto_sliver", "WITH p AS (SELECT s_suppkey AS k, (s_suppkey*37)%197 AS x, (s_suppkey*53)%193 AS y FROM supplier), n AS (SELECT a.k, min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2)) AS d FROM p a JOIN p b ON NOT (a.x = b.x AND a.y = b.y) GROUP BY a.k) SELECT floor(least(greatest(0.01*avg(d)*avg(d), 0.5), 100.0)*1000000 + 0.5)/1000000 AS threshold FROM n")
def a18(spark, sf):
    pts = load(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37) % 197).cast("double").alias("x"), ((F.col("s_suppkey") * 53) % 193).cast("double").alias("y"))
    n = spatial.nearest(pts, pts.withColumnRenamed("s_suppkey", "other"), "s_suppkey", "other", 8.0)
    d = F.avg(F.sqrt("d2"))
    return n.agg(geo.floor_round(F.least(F.greatest(0.01 * d * d, F.lit(0.5)), F.lit(100.0)), 6).alias("threshold"))


@query("A20_max_bsn", f"{S} SELECT ea_geocode, coalesce(max(CASE WHEN CAST(bsn AS INT) > 60000 AND CAST(bsn AS INT) < 70000 THEN CAST(bsn AS INT) END), 60000) AS bsn_2, lpad(CAST(coalesce(max(CASE WHEN bsn LIKE '7%' THEN CAST(bsn AS INT) END), 70000) AS VARCHAR), 5, '0') AS bsn_3 FROM survey GROUP BY ea_geocode")
def a20(spark, sf):
    n = F.col("bsn").cast("int")
    return load(spark, sf, "survey").groupBy("ea_geocode").agg(
        F.coalesce(F.max(F.when((n > 60000) & (n < 70000), n)), F.lit(60000)).alias("bsn_2"),
        F.lpad(F.coalesce(F.max(F.when(F.col("bsn").startswith("7"), n)), F.lit(70000)).cast("string"), 5, "0").alias("bsn_3"))


@query("A21_group_count", f"{A} SELECT id, count(*) OVER (PARTITION BY city_mun) AS n FROM areas")
def a21(spark, sf):
    return rel.with_group_count(load(spark, sf, "areas"), ["city_mun"]).select("id", "n")


@query("A22_extent", f"{A} SELECT province, min(x0) AS xmin, min(y0) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM areas GROUP BY province")
def a22(spark, sf):
    return spatial.extent(load(spark, sf, "areas"), "province")


@query("A23_unmatched_concat", f"{N} SELECT 'Unmatched Barangay List: ' || string_agg(v, ', ' ORDER BY v) AS remarks FROM (SELECT DISTINCT {_normal('name')} AS v FROM names) WHERE v NOT IN (SELECT p_name FROM part) HAVING count(*) > 0")
def a23(spark, sf):
    src = load(spark, sf, "names").select(names.normalize_name(F.col("name")).alias("v")).distinct()
    left = src.join(load(spark, sf, "part").select(F.col("p_name").alias("v")), "v", "left_anti")
    return left.agg(F.count("*").alias("n"), F.concat(F.lit("Unmatched Barangay List: "), F.array_join(F.sort_array(F.collect_list("v")), ", ")).alias("remarks")).where("n > 0").select("remarks")


@query("A24_area_pick_list", f"{A} SELECT substr(geocode, 1, 12) AS code, substr(geocode, 1, 12) || '_' || max_by(barangay, id) AS label FROM areas GROUP BY 1")
def a24(spark, sf):
    code = F.substring("geocode", 1, 12)
    return load(spark, sf, "areas").groupBy(code.alias("code")).agg(F.max_by("barangay", "id").alias("name")).select("code", F.concat_ws("_", "code", "name").alias("label"))


@query("W01_sequential_fid", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS fid FROM orders QUALIFY o_orderstatus = 'O'")
def w01(spark, sf):
    return load(spark, sf, "orders").withColumn("fid", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("o_orderstatus = 'O'").select("o_orderkey", F.col("fid").cast("long").alias("fid"))


_SEQ = f"{E}, c AS (SELECT parent, count(*) AS base FROM eas GROUP BY parent), z AS (SELECT e.*, base, hhcount >= 300 AS is_new FROM eas e JOIN c USING (parent)), q AS (SELECT *, CASE WHEN is_new THEN base + row_number() OVER (PARTITION BY parent, is_new ORDER BY x0, y0, ea_id) END AS sequence FROM z)"


def _sequenced(spark, sf):
    eas = load(spark, sf, "eas").withColumn("is_new", F.col("hhcount") >= 300)
    eas = rel.with_group_count(eas, ["parent"], "base")
    return rel.new_codes(eas, "parent", "is_new", [F.col("x0"), F.col("y0"), F.col("ea_id")], "base")


@query("W02_new_sequence", f"{_SEQ} SELECT ea_id, sequence FROM q")
def w02(spark, sf):
    return _sequenced(spark, sf).select("ea_id", "sequence")


@query("W03_code_compose", f"{_SEQ} SELECT ea_id, CASE WHEN NOT is_new THEN ean WHEN substr(ean, 1, 3) = '000' THEN lpad(CAST(sequence AS VARCHAR), 3, '0') || '000' ELSE substr(ean, 1, 3) || lpad(CAST(sequence AS VARCHAR), 3, '0') END AS new_ea FROM q")
def w03(spark, sf):
    return _sequenced(spark, sf).select("ea_id", F.when(~F.col("is_new"), F.col("ean")).otherwise(codes.compose_ea_code(F.col("ean"), F.col("sequence"))).alias("new_ea"))


@query("W04_conditional_order", f"{E}, z AS (SELECT *, max(CASE WHEN hhcount >= 440 THEN 1 ELSE 0 END) OVER (PARTITION BY parent) AS split FROM eas) SELECT ea_id, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN split = 1 THEN x0 END, CASE WHEN split = 1 THEN y0 ELSE ea_id END, ea_id) AS pos FROM z")
def w04(spark, sf):
    df = load(spark, sf, "eas").withColumn("split", F.max(F.col("hhcount") >= 440).over(Window.partitionBy("parent")))
    order = [F.when(F.col("split"), F.col("x0")), F.when(F.col("split"), F.col("y0")).otherwise(F.col("ea_id").cast("double")), F.col("ea_id")]
    return df.select("ea_id", F.row_number().over(Window.partitionBy("parent").orderBy(*order)).cast("long").alias("pos"))


@query("W05_first_preserve", f"{E} SELECT parent, ea_id FROM eas QUALIFY row_number() OVER (PARTITION BY parent ORDER BY hhcount DESC, ea_id) = 1")
def w05(spark, sf):
    return spatial.first_per(load(spark, sf, "eas"), ["parent"], [F.col("hhcount").desc(), F.col("ea_id")]).select("parent", "ea_id")


_CAND = "SELECT l_orderkey // 4 AS k, l_partkey AS ref, CAST(l_quantity AS BIGINT) AS d FROM lineitem"


@query("W06_best_and_ties", f"SELECT k, min(d) AS best, CASE WHEN count(*) FILTER (d = m) > 1 THEN 'MULTIPLE_MATCHES' ELSE 'MATCH' END AS status FROM (SELECT *, min(d) OVER (PARTITION BY k) AS m FROM ({_CAND})) GROUP BY k")
def w06(spark, sf):
    df = load(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("k"), F.col("l_quantity").cast("long").alias("d"))
    best = df.groupBy("k", "d").agg(F.count("*").alias("n")).groupBy("k").agg(F.min(F.struct("d", "n")).alias("b"))
    return best.select("k", F.col("b.d").alias("best"), F.when(F.col("b.n") > 1, "MULTIPLE_MATCHES").otherwise("MATCH").alias("status"))


@query("W07_top_candidates", f"SELECT k, string_agg(label, ', ' ORDER BY d, ref, label) AS all_candidates FROM (SELECT *, ref || ' (dist=' || d || ')' AS label FROM ({_CAND}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, ref) <= 10) GROUP BY k")
def w07(spark, sf):
    df = load(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("k"), F.col("l_partkey").alias("ref"), F.col("l_quantity").cast("long").alias("d"))
    label = F.concat(F.col("ref").cast("string"), F.lit(" (dist="), F.col("d").cast("string"), F.lit(")"))
    return rel.top_candidates(df, "k", label, ["d", "ref"])


@query("W08_role_autodetect", "WITH l AS (SELECT lower(replace(p_name, ' ', '_')) AS name FROM part), r AS (SELECT unnest(['_bolt', '_gear', '_ring', '_plate']) AS suffix) SELECT suffix, min(name) AS layer FROM l JOIN r ON suffix(name, suffix) GROUP BY suffix")
def w08(spark, sf):
    layers = load(spark, sf, "part").select(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name")).distinct()
    roles = F.explode(F.filter(F.array(*[F.lit(s) for s in ("_bolt", "_gear", "_ring", "_plate")]), lambda s: F.endswith(F.col("name"), s)))
    return layers.select("name", roles.alias("suffix")).groupBy("suffix").agg(F.min("name").alias("layer"))


@query("W09_export_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 25) DESC, lower(p_name), p_partkey) AS pos FROM part")
def w09(spark, sf):
    order = [(F.col("p_size") > 25).desc(), F.lower("p_name"), F.col("p_partkey")]
    return load(spark, sf, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(*order)).cast("long").alias("pos"))


@query("T01_global_sort", f"{E} SELECT parent, ea_id FROM eas ORDER BY parent, ea_id")
def t01(spark, sf):
    return load(spark, sf, "eas").select("parent", "ea_id").orderBy("parent", "ea_id")


@query("T02_preview_limit", f"{E} SELECT ea_id, hhcount FROM eas ORDER BY hhcount DESC, ea_id LIMIT 15")
def t02(spark, sf):
    return load(spark, sf, "eas").select("ea_id", "hhcount").orderBy(F.col("hhcount").desc(), "ea_id").limit(15)


@query("T03_argmax", f"{E} SELECT parent, max_by(ea_id, hhcount::BIGINT * 10000000 - ea_id) AS ea_id FROM eas GROUP BY parent")
def t03(spark, sf):
    return load(spark, sf, "eas").groupBy("parent").agg(F.max_by("ea_id", F.struct("hhcount", -F.col("ea_id"))).alias("ea_id"))


@query("U01_merge_layers", "SELECT c_custkey AS fid, c_name AS name, CAST(NULL AS DOUBLE) AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def u01(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_custkey").alias("fid"), F.col("c_name").alias("name"))
    return rel.union_layers([a, load(spark, sf, "supplier").select(F.col("s_suppkey").alias("fid"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))])


@query("U02_id_sets", "(SELECT l_orderkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') INTERSECT SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def u02(spark, sf):
    a = load(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    o = load(spark, sf, "orders")
    return a.union(o.where("o_orderstatus = 'P'").select("o_orderkey")).distinct().intersect(o.where("o_totalprice > 100000").select("o_orderkey"))


@query("U03_set_difference", "SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05")
def u03(spark, sf):
    gone = load(spark, sf, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("id"))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(gone, "id", "left_anti").distinct()


@query("U04_ordered_dedup", f"{N} SELECT lower(trim(name)) AS k, arg_min(name, id) AS first_casing FROM names GROUP BY 1")
def u04(spark, sf):
    return load(spark, sf, "names").groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min_by("name", "id").alias("first_casing"))


@query("G04_bounding_rect", f"{A} SELECT a.id AS id1, b.id AS id2, greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0), least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS height, least(least(a.x1,b.x1)-greatest(a.x0,b.x0), least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS width FROM areas a JOIN areas b ON a.id < b.id AND {CROSS}")
def g04(spark, sf):
    p = spatial.overlap_pairs(load(spark, sf, "areas").select("id", *spatial.BOX), CELL)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return p.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), F.greatest(w, h).alias("height"), F.least(w, h).alias("width"))


@query("G10_within_distance", f"{A} SELECT a.id AS id1, b.id AS id2 FROM areas a JOIN areas b ON a.id < b.id AND a.x0 - 1 <= b.x1 AND b.x0 <= a.x1 + 1 AND a.y0 - 1 <= b.y1 AND b.y0 <= a.y1 + 1")
def g10(spark, sf):
    areas = load(spark, sf, "areas").select("id", *spatial.BOX)
    return spatial.box_join(areas, areas, CELL, within=1.0).where("a.id < b.id").select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"))


@query("G13_simple_checks", f"{A}, z AS (SELECT id, CASE WHEN id % 50 = 0 THEN NULL WHEN id % 30 = 7 THEN md5('dup') ELSE md5(CAST(x0 AS INT) || '|' || CAST(y0 AS INT) || '|' || CAST(x1 AS INT) || '|' || CAST(y1 AS INT)) END AS g FROM areas), d AS (SELECT g, min(id) AS first, count(*) AS n FROM z WHERE g IS NOT NULL GROUP BY g) SELECT id, 'null' AS issue FROM z WHERE g IS NULL UNION ALL SELECT id, 'duplicate' FROM z JOIN d USING (g) WHERE n > 1 AND id = first")
def g13(spark, sf):
    whole = F.concat_ws("|", *[F.col(c).cast("int").cast("string") for c in spatial.BOX])
    z = load(spark, sf, "areas").select("id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 30 == 7, F.md5(F.lit("dup"))).otherwise(F.md5(whole)).alias("g"))
    dup = z.where("g IS NOT NULL").groupBy("g").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("issue"))
    return z.where("g IS NULL").select("id", F.lit("null").alias("issue")).union(dup)


@query("G21_strip_split", f"{E} SELECT ea_id, k AS strip, CASE WHEN x1-x0 >= y1-y0 THEN x0 + (x1-x0)/n*k ELSE x0 END AS x0, CASE WHEN x1-x0 >= y1-y0 THEN y0 ELSE y0 + (y1-y0)/n*k END AS y0 FROM (SELECT *, greatest(2, ceil(hhcount/300.0))::INT AS n FROM eas) , LATERAL (SELECT unnest(range(n))::INT AS k)")
def g21(spark, sf):
    eas = load(spark, sf, "eas").select("ea_id", "hhcount", *spatial.BOX)
    return spatial.strips(eas, F.greatest(F.lit(2), F.ceil(F.col("hhcount") / 300.0))).select("ea_id", "strip", "x0", "y0")


@query("E02_classify", f"{E} SELECT ea_id, CASE WHEN lower(trim(eadel_indi)) IN ('for delineation', 'for_delineation') OR hhcount >= 300 THEN 'delineate' WHEN hhcount <= 100 THEN 'merge' ELSE 'none' END AS class, CASE WHEN hhcount = 0 THEN 1.0 ELSE 300.0 / hhcount END AS ratio FROM eas")
def e02(spark, sf):
    c = rules.ea_class(F.col("hhcount"), F.col("eadel_indi"), None, F.lit(False))
    return load(spark, sf, "eas").select("ea_id", c.alias("class"), F.when(F.col("hhcount") == 0, 1.0).otherwise(300.0 / F.col("hhcount")).alias("ratio"))


@query("E03_merge_partners", f"{E} SELECT a.ea_id, string_agg(CAST(b.ea_id AS VARCHAR), ',' ORDER BY b.ea_id) AS partners FROM eas a JOIN eas b ON a.parent = b.parent AND a.ea_id <> b.ea_id AND {MEET} AND b.hhcount < 300 WHERE a.hhcount <= 100 GROUP BY a.ea_id")
def e03(spark, sf):
    eas = load(spark, sf, "eas").select("ea_id", "parent", "hhcount", *spatial.BOX)
    met = spatial.box_join(eas.where("hhcount <= 100"), eas.where("hhcount < 300"), CELL, on=["parent"]).where("a.ea_id <> b.ea_id")
    return met.groupBy(F.col("a.ea_id").alias("ea_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("b.ea_id")), lambda x: x.cast("string")), ",").alias("partners"))


@query("E04_assign_buildings", f"{duck('eas', 'buildings')} SELECT b.pid, min(a.ea_id) AS ea_id FROM buildings b JOIN eas a ON {HIT} AND (a.hhcount >= 300 OR a.hhcount <= 100) GROUP BY b.pid")
def e04(spark, sf):
    wanted = load(spark, sf, "eas").where("hhcount >= 300 OR hhcount <= 100").select("ea_id", *spatial.BOX)
    return spatial.first_containing(load(spark, sf, "buildings").select("pid", "x", "y"), wanted, CELL, "pid", "ea_id")


_CLASS = "CASE WHEN lower(trim(eadel_indi)) IN ('for delineation', 'for_delineation') OR hhcount >= 300 THEN 'delineate' WHEN hhcount <= 100 THEN 'merge' ELSE 'none' END"


@query("E05_preview", f"{duck('eas', 'buildings')}, c AS (SELECT *, {_CLASS} AS class FROM eas), m AS (SELECT b.pid, min(a.ea_id) AS ea_id FROM buildings b JOIN c a ON {HIT} AND class <> 'none' GROUP BY b.pid) SELECT c.ea_id, class, hhcount, count(m.pid) AS bldg_count FROM c LEFT JOIN m USING (ea_id) WHERE class <> 'none' GROUP BY ALL")
def e05(spark, sf):
    """Candidates and their buildings, without splitting or merging any."""
    c = rules.ea_class(F.col("hhcount"), F.col("eadel_indi"), None, F.lit(False))
    wanted = load(spark, sf, "eas").withColumn("class", c).where("class <> 'none'")
    found = spatial.first_containing(load(spark, sf, "buildings").select("pid", "x", "y"), wanted.select("ea_id", *spatial.BOX), CELL, "pid", "ea_id")
    counts = found.groupBy("ea_id").agg(F.count("*").alias("n"))
    return wanted.join(counts, "ea_id", "left").select("ea_id", "class", "hhcount", F.coalesce("n", F.lit(0)).alias("bldg_count"))


@query("E06_load_needed", f"{E}, c AS (SELECT * FROM eas WHERE hhcount >= 300 OR hhcount <= 100 OR eadel_indi IS NOT NULL) SELECT ea_id FROM c UNION SELECT b.ea_id FROM c a JOIN eas b ON a.parent = b.parent AND a.ea_id <> b.ea_id AND {MEET}")
def e06(spark, sf):
    eas = load(spark, sf, "eas").select("ea_id", "parent", "hhcount", "eadel_indi", *spatial.BOX)
    c = eas.where("hhcount >= 300 OR hhcount <= 100 OR eadel_indi IS NOT NULL")
    met = spatial.box_join(c, eas, CELL, on=["parent"]).where("a.ea_id <> b.ea_id")
    return c.select("ea_id").union(met.select(F.col("b.ea_id").alias("ea_id"))).distinct()


@query("E15_code_assignment", f"{_SEQ} SELECT parent, ea_id, CASE WHEN NOT is_new THEN ean WHEN substr(ean, 1, 3) = '000' THEN lpad(CAST(sequence AS VARCHAR), 3, '0') || '000' ELSE substr(ean, 1, 3) || lpad(CAST(sequence AS VARCHAR), 3, '0') END AS new_ea FROM q")
def e15(spark, sf):
    return _sequenced(spark, sf).select("parent", "ea_id", F.when(~F.col("is_new"), F.col("ean")).otherwise(codes.compose_ea_code(F.col("ean"), F.col("sequence"))).alias("new_ea"))


@query("E16_output_routing", f"{E} SELECT ea_id, CASE WHEN hhcount >= 300 OR ea_id % 29 = 0 THEN 'delineated' WHEN hhcount <= 100 THEN 'merged' ELSE 'retained' END AS sink FROM eas")
def e16(spark, sf):
    from_split, special, from_merge = F.col("hhcount") >= 300, F.col("ea_id") % 29 == 0, F.col("hhcount") <= 100
    return load(spark, sf, "eas").select("ea_id", F.when(from_split | special, "delineated").when(from_merge & ~from_split, "merged").otherwise("retained").alias("sink"))


@query("E18_candidates_table", f"{E} SELECT ean AS ea_number, hhcount FROM eas WHERE hhcount >= 300")
def e18(spark, sf):
    n = codes.try_number(F.col("hhcount"))
    return load(spark, sf, "eas").where(n >= 300).select(F.col("ean").alias("ea_number"), "hhcount")


@query("R02_conflicting_names", "SELECT lower(p_name) AS stem, count(*) AS n FROM part WHERE p_name NOT LIKE '%~%' GROUP BY 1 HAVING count(*) > 1")
def r02(spark, sf):
    return load(spark, sf, "part").where(~F.contains("p_name", F.lit("~"))).groupBy(F.lower("p_name").alias("stem")).agg(F.count("*").alias("n")).where("n > 1")


@query("R03_source_checks", "SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F]')")
def r03(spark, sf):
    return load(spark, sf, "documents").where(F.coalesce(F.col("text").rlike(r"[^\x00-\x7F]"), F.lit(False))).select("doc_id")


@query("R01_rule_engine", f"{E} SELECT 'error' AS level, 'hh_negative' AS rule, ea_id FROM eas WHERE hhcount <= 0 UNION ALL SELECT 'warning', 'hh_over', ea_id FROM eas WHERE hhcount > 300 UNION ALL SELECT 'warning', 'no_flag', ea_id FROM eas WHERE eadel_indi IS NULL AND hhcount > 400")
def r01(spark, sf):
    checks = (("error", "hh_negative", F.col("hhcount") <= 0), ("warning", "hh_over", F.col("hhcount") > 300), ("warning", "no_flag", F.col("eadel_indi").isNull() & (F.col("hhcount") > 400)))
    hits = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for level, rule, test in checks]))
    return load(spark, sf, "eas").select("ea_id", F.explode(hits).alias("h")).select("h.level", "h.rule", "ea_id")


@query("R04_primary_key", "SELECT p_brand AS layer, CASE WHEN count(*) FILTER (p_size = 50) = 1 THEN 'pk' WHEN max(p_size) >= 10 THEN 'fid' ELSE 'error' END AS key FROM part GROUP BY p_brand")
def r04(spark, sf):
    return load(spark, sf, "part").groupBy(F.col("p_brand").alias("layer")).agg(F.when(F.count_if(F.col("p_size") == 50) == 1, "pk").when(F.max("p_size") >= 10, "fid").otherwise("error").alias("key"))


_ACTION = "CASE WHEN o_orderkey % 6 = 0 THEN 'remove' WHEN o_orderpriority = '1-URGENT' THEN 'offline' WHEN o_orderpriority = '2-HIGH' THEN 'copy' WHEN o_orderpriority = '3-MEDIUM' THEN 'no_action' ELSE 'keep_existent' END"


@query("R05_prevention_reason", """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 10 = 1 THEN 'unsupported_datasource' END, CASE WHEN o_orderkey % 6 > 1 THEN NULL WHEN o_orderkey % 15 < 5 THEN 'localized_path' WHEN o_orderkey % 21 < 7 THEN 'invalid_remote_raster_layer' ELSE 'invalid' END) AS reasons FROM orders""")
def r05(spark, sf):
    k = F.col("o_orderkey")
    return load(spark, sf, "orders").select("o_orderkey", F.array_join(rules.prevention_reasons(k % 10 != 1, k % 6 > 1, k % 15 < 5, k % 21 < 7), ",").alias("reasons"))


def _action():
    p = F.col("o_orderpriority")
    return F.when(F.col("o_orderkey") % 6 == 0, "remove").when(p == "1-URGENT", "offline").when(p == "2-HIGH", "copy").when(p == "3-MEDIUM", "no_action").otherwise("keep_existent")


@query("R06_sync_action", f"SELECT o_orderkey, {_ACTION} AS action FROM orders")
def r06(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", _action().alias("action"))


@query("R07_group_exclusive", "SELECT p_name AS layer, p_brand AS grp, (row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) = 1) AS visible, p_partkey FROM part")
def r07(spark, sf):
    w = Window.partitionBy("p_name").orderBy("p_brand", "p_partkey")
    return load(spark, sf, "part").select(F.col("p_name").alias("layer"), F.col("p_brand").alias("grp"), (F.row_number().over(w) == 1).alias("visible"), "p_partkey")


@query("R08_style_match", "SELECT p_partkey, CASE WHEN p_name LIKE '%bolt' THEN 'base' WHEN p_name LIKE '%gear%' THEN 'ea' WHEN p_name LIKE '%ring%' THEN 'building' END AS style FROM part")
def r08(spark, sf):
    alias = F.element_at(F.create_map(F.lit("bolt"), F.lit("base")), F.element_at(F.split("p_name", " "), -1))
    return load(spark, sf, "part").select("p_partkey", F.coalesce(alias, F.when(F.contains("p_name", F.lit("gear")), "ea").when(F.contains("p_name", F.lit("ring")), "building")).alias("style"))


@query("R09_mixed_actions", f"SELECT o_custkey AS file, min(o_orderkey) AS first FROM (SELECT *, {_ACTION} AS a FROM orders) WHERE a IN ('offline', 'copy') GROUP BY o_custkey HAVING count(DISTINCT a) > 1")
def r09(spark, sf):
    df = load(spark, sf, "orders").withColumn("a", _action()).where("a IN ('offline', 'copy')")
    return df.groupBy(F.col("o_custkey").alias("file")).agg(F.min("o_orderkey").alias("first"), F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("file", "first")


@query("R10_missing_references", "SELECT DISTINCT split_part(f, '|', 1) AS path FROM (SELECT p_name || '.gpkg|layername=' || p_brand AS f FROM part) WHERE split_part(f, '|', 1) NOT IN (SELECT p_name || '.gpkg' FROM part WHERE p_size > 48)")
def r10(spark, sf):
    part = load(spark, sf, "part")
    xml = F.concat(F.lit("<datasource>"), F.col("p_name"), F.lit(".gpkg|layername="), F.col("p_brand"), F.lit('</datasource><x source="memory:"/>'))
    found = part.select(F.explode(F.regexp_extract_all(xml, F.lit("<datasource>([^<]+)</datasource>"), F.lit(1))).alias("s")).where(~F.col("s").rlike("^[a-z]+:")).select(F.substring_index("s", "|", 1).alias("path")).distinct()
    return found.join(part.where("p_size > 48").select(F.concat("p_name", F.lit(".gpkg")).alias("path")), "path", "left_anti")


@query("R11_forbidden_paths", "SELECT p_partkey FROM part WHERE p_partkey % 6 NOT IN (0, 4, 5)")
def r11(spark, sf):
    from .scalar_queries import _FILE

    return load(spark, sf, "part").where(~codes.is_valid_path(F.expr(_FILE))).select("p_partkey")


_PATHS = (".git/config", "a/.gitignore", "docs/x.md", "src/docs.md", "a/b.pyc", "tsconfig.base.json", "a/package.json", "my-package.json", "__pycache__/x", "a/__pycache__/x.txt", ".antigravity2/y", "README.md", "README.txt", "scripts/run.py")


@query("R12_exclusion_globs", "SELECT p_partkey FROM part WHERE p_partkey % 14 IN (0, 1, 2, 4, 5, 6, 8, 10, 11, 13)")
def r12(spark, sf):
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("p_partkey") % 14 + 1).cast("int"))
    return load(spark, sf, "part").where(rules.is_excluded(F.substring_index(path, "/", -1), path)).select("p_partkey")


@query("overlap_report", f"""{AB}, o AS (SELECT a.id AS id1, b.id AS id2, greatest(a.x0,b.x0) AS x0, greatest(a.y0,b.y0) AS y0, least(a.x1,b.x1) AS x1, least(a.y1,b.y1) AS y1, a.geocode AS g1, b.geocode AS g2,
 CASE WHEN a.region <> b.region THEN '1_Inter-Region' WHEN a.province <> b.province THEN '2_Inter-Province' WHEN a.city_mun <> b.city_mun THEN '3_Inter-City/Municipality' WHEN a.barangay <> b.barangay THEN '4_Inter-Barangay' ELSE '5_Within-Barangay' END AS mbi_level FROM areas a JOIN areas b ON a.id < b.id AND {CROSS}),
 n AS (SELECT a.id1, a.id2, count(*) AS n FROM o a JOIN buildings b ON {HIT} GROUP BY 1, 2)
 SELECT o.id1, o.id2, least(g1, g2) || ',' || greatest(g1, g2) AS involved_areas, 2::BIGINT AS count_involved_areas, floor((x1-x0)*(y1-y0)*100+0.5)/100 AS mbi_area, coalesce(n, 0) AS num_bldg_pts, mbi_level FROM o LEFT JOIN n USING (id1, id2) WHERE NOT ((x1-x0)*(y1-y0) <= 0.1 AND coalesce(n, 0) = 0)""")
def overlap_report(spark, sf):
    from .boundary import overlap_report as report

    areas, pts = load(spark, sf, "areas"), load(spark, sf, "buildings")
    return report(areas, pts.select("pid", "x", "y"), CELL).select("id1", "id2", "involved_areas", "count_involved_areas", "mbi_area", "num_bldg_pts", "mbi_level")
