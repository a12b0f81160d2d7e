"""Queries for projections, filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions import codes, geo, names, rules
from cadastra.operators import relational as rel

from .fixtures import duck, load
from .registry import query


def _normal(c: str) -> str:
    out = f"CASE WHEN {c} IS NULL OR trim({c}) = '' OR {c} = 'NULL' THEN '' ELSE lower(trim({c})) END"
    for a, b in names.ABBREVIATIONS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace(regexp_replace({out}, '[-–—]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _to_arabic(c: str) -> str:
    out = f"upper(coalesce({c}, ''))"
    for n, sign in reversed(names.NUMERALS.items()):
        if sign != "V":
            out = f"regexp_replace({out}, '\\b{sign}\\b', '{n}', 'g')"
    return f"lower({out})"


def _to_roman(c: str) -> str:
    out = f"coalesce({c}, '')"
    for n, sign in reversed(names.NUMERALS.items()):
        out = f"regexp_replace({out}, '\\b{n if n > 9 else f'0?{n}'}\\b', '{sign}', 'g')"
    return f"lower({out})"


def _barangay(c: str) -> str:
    out = f"trim(lower(coalesce({c}, '')))"
    for a, b in (("sta.", "santa"), ("sta ", "santa "), (" sta", " santa"), ("sto.", "santo"), ("sto ", "santo "), (" sto", " santo")):
        out = f"replace({out}, '{a}', '{b}')"
    for t in names.ADMIN_TERMS:
        out = f"replace({out}, '{t}', '')"
    for n in range(15, 0, -1):
        out = f"regexp_replace({out}, '(^|\\s){names.NUMERALS[n].lower()}\\s*$', '\\1{n}')"
    plain = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return f"CASE WHEN regexp_matches({plain}, '^\\d+$') THEN regexp_replace({plain}, '^0+(\\d)', '\\1') ELSE {plain} END"


N = duck("names")
S = duck("survey")
E = duck("eas")
A = duck("areas")


@query("S01_scan_layer", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def s01(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")


@query("S02_scan_bbox", f"{A} SELECT id, x0, y0 FROM areas WHERE x0 <= 120 AND x1 >= 40 AND y0 <= 90 AND y1 >= 30")
def s02(spark, sf):
    return load(spark, sf, "areas").where("x0 <= 120 AND x1 >= 40 AND y0 <= 90 AND y1 >= 30").select("id", "x0", "y0")


@query("S03_scan_columns", "SELECT o_orderkey, o_orderpriority FROM orders")
def s03(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")


@query("S04_scan_by_fid", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def s04(spark, sf):
    ids = load(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(ids, "o_orderkey", "left_semi")


@query("S06_file_date", "SELECT s_suppkey, CAST(regexp_extract(concat('qa_', '2025', '_', lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 2, '0'), '_', s_name, '.gpkg'), '^[^_]*_([0-9]{4}_[0-9]{2})_', 1) AS VARCHAR) AS file_date FROM supplier")
def s06(spark, sf):
    name = F.concat(F.lit("qa_2025_"), F.lpad((F.col("s_suppkey") % 12 + 1).cast("string"), 2, "0"), F.lit("_"), F.col("s_name"), F.lit(".gpkg"))
    return load(spark, sf, "supplier").select("s_suppkey", F.regexp_extract(name, r"^[^_]*_(\d{4}_\d{2})_", 1).alias("file_date"))


@query("S13_sheet_rows", "SELECT r_name AS \"Region\", count(*) AS \"Cases\" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def s13(spark, sf):
    return load(spark, sf, "areas").groupBy(F.col("region").alias("Region")).agg(F.count("*").alias("Cases"))


@query("S14_offline_copy", f"{A} SELECT NULL::BIGINT AS fid_1, id AS fid, geocode, sha256('areas.gpkg|layername=' || city_mun) AS table_name FROM areas WHERE x0 <= 150 AND x1 >= 20 AND y0 <= 150 AND y1 >= 20")
def s14(spark, sf):
    df = load(spark, sf, "areas").where("x0 <= 150 AND x1 >= 20 AND y0 <= 150 AND y1 >= 20")
    return df.select(F.lit(None).cast("long").alias("fid_1"), F.col("id").alias("fid"), "geocode", F.sha2(F.concat(F.lit("areas.gpkg|layername="), "city_mun"), 256).alias("table_name"))


@query("S15_datasource_dedup", "SELECT sha256('src:' || c_mktsegment) AS source, count(*) AS layers, min(c_custkey) AS first_layer FROM customer GROUP BY c_mktsegment")
def s15(spark, sf):
    return load(spark, sf, "customer").groupBy(F.sha2(F.concat(F.lit("src:"), "c_mktsegment"), 256).alias("source")).agg(F.count("*").alias("layers"), F.min("c_custkey").alias("first_layer"))


@query("P01_refactor_fields", f"{A} SELECT CAST(id AS INTEGER) AS fid, upper(barangay) AS name, CAST(NULL AS VARCHAR) AS remarks, x1 - x0 AS width FROM areas")
def p01(spark, sf):
    return rel.refactor_fields(load(spark, sf, "areas"), [("id", "fid", "int"), ("upper(barangay)", "name", "string"), ("remarks", "remarks", "string"), ("x1 - x0", "width", "double")])


@query("P02_strip_lengths", "SELECT p_partkey, p_name FROM part")
def p02(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.col("p_name").cast("string").alias("p_name"))


@query("P03_field_calc", f"{A} SELECT id, city_mun || ' / ' || province AS place FROM areas")
def p03(spark, sf):
    return load(spark, sf, "areas").withColumn("place", F.concat_ws(" / ", "city_mun", "province")).select("id", "place")


@query("P04_filter_expr", f"{S} SELECT fid FROM survey WHERE bldg_type <> '07' AND longitude > 10")
def p04(spark, sf):
    return load(spark, sf, "survey").where("bldg_type <> '07' AND longitude > 10").select("fid")


@query("P05_noise_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.1 AND l_orderkey % 3 = 0) AND (CASE WHEN l_partkey % 5 > 0 THEN l_partkey END) IS NOT NULL")
def p05(spark, sf):
    df = load(spark, sf, "lineitem")
    code = F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey"))
    return df.where(rules.keep_issue(F.col("l_discount"), F.col("l_orderkey") % 3, code)).select("l_orderkey", "l_linenumber")


@query("P06_subset_prefix", f"{A} SELECT id, geocode FROM areas WHERE geocode LIKE '0000000000000%'")
def p06(spark, sf):
    return load(spark, sf, "areas").where(F.col("geocode").startswith("0000000000000")).select("id", "geocode")


@query("P07_subset_substr", f"{S} SELECT fid FROM survey WHERE substr(ea_geocode, 1, 12) = '000000000000' OR substr(bsn_geoid, 1, 14) = '00000000000150'")
def p07(spark, sf):
    return load(spark, sf, "survey").where((F.substring("ea_geocode", 1, 12) == "000000000000") | (F.substring("bsn_geoid", 1, 14) == "00000000000150")).select("fid")


@query("P09_cascade_filter", f"{A} SELECT id FROM areas WHERE lower(region) = 'asia' AND lower(city_mun) = 'building'")
def p09(spark, sf):
    return rel.cascade_filter(load(spark, sf, "areas"), region="ASIA", province="All Provinces", city_mun=" Building ").select("id")


@query("P10_prefix_filter", f"{A} SELECT id FROM areas WHERE substr(geocode, 1, 5) = '00000' AND substr(geocode, 1, 11) = '00000000000'")
def p10(spark, sf):
    return load(spark, sf, "areas").where((F.substring("geocode", 1, 5) == "00000") & (F.substring("geocode", 1, 11) == "00000000000")).select("id")


@query("P11_text_search", f"{A} SELECT id FROM areas WHERE contains(lower(barangay), '12') OR contains(lower(city_mun), '12') OR contains(lower(geocode), '12')")
def p11(spark, sf):
    return rel.text_search(load(spark, sf, "areas"), ["barangay", "city_mun", "geocode"], " 12 ").select("id")


@query("P12_rule_classify", f"""{S} SELECT fid, concat_ws(',', CASE WHEN CAST(bsn AS INT) > 0 AND CAST(bsn AS INT) < 40000 THEN 'Existing' END, CASE WHEN CAST(bsn AS INT) > 60000 AND CAST(bsn AS INT) < 70000 THEN 'Homeless' END,
 CASE WHEN CAST(bsn AS INT) > 70000 AND CAST(bsn AS INT) < 80000 THEN 'New' END, CASE WHEN CAST(bsn AS INT) = 55555 THEN 'Relocation' END, CASE WHEN bsn = '00000' THEN 'Demolished' END, CASE WHEN bldg_type = '07' THEN 'ILQ' END) AS labels FROM survey""")
def p12(spark, sf):
    return load(spark, sf, "survey").select("fid", F.array_join(rules.building_labels(F.col("bsn"), F.col("bldg_type")), ",").alias("labels"))


@query("P13_form_constraint", f"""{S} SELECT fid, concat_ws(',', CASE WHEN length(ean) <> 6 THEN 'ean_length' END, CASE WHEN length(bsn) <> 5 THEN 'bsn_length' END, CASE WHEN length(bsn_geoid) <> 19 THEN 'bsn_geoid_length' END,
 CASE WHEN longitude IS NULL THEN 'longitude_null' END, CASE WHEN latitude IS NULL THEN 'latitude_null' END, CASE WHEN map_uuid IS NULL THEN 'map_uuid_null' END, CASE WHEN ea_geocode <> '00000000000123' THEN 'layer_name' END) AS broken FROM survey""")
def p13(spark, sf):
    df = load(spark, sf, "survey")
    return df.select("fid", F.array_join(rules.form_violations({c: F.col(c) for c in df.columns}, F.lit("00000000000123_bldgpts")), ",").alias("broken"))


@query("P14_check_input", f"""{S} SELECT fid FROM survey WHERE longitude IS NULL OR latitude IS NULL OR map_uuid IS NULL OR bsn_geoid IS NULL OR ean IS NULL OR bsn IS NULL OR ea_geocode IS NULL OR bldg_type IS NULL OR fid % 11 = 5 OR fid % 11 = 0
 OR length(ean) <> 6 OR length(bsn) <> 5 OR length(bsn_geoid) <> 19 OR length(ea_geocode) <> 14""")
def p14(spark, sf):
    df = load(spark, sf, "survey")
    features = F.when(F.col("fid") % 11 != 5, (F.col("fid") % 11).cast("string"))
    return df.where(rules.needs_check({c: F.col(c) for c in df.columns} | {"up_feature": features, "date": F.col("datecreate")})).select("fid")


@query("P15_road_class", "SELECT o_orderkey, CASE 2001 + o_orderkey % 12 WHEN 2001 THEN 'Provincial/National Road' WHEN 2002 THEN 'Municipal Road' WHEN 2003 THEN 'Barangay Road' WHEN 2004 THEN 'Alley' WHEN 2005 THEN 'Proposed Road' WHEN 2010 THEN 'Trail' END AS road_class FROM orders")
def p15(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", rules.decode((F.lit(2001) + F.col("o_orderkey") % 12).cast("int"), rules.ROAD_CLASSES).alias("road_class"))


@query("P18_first_with_value", "SELECT min(o_orderkey) AS fid, 'O' AS v FROM orders WHERE trim(o_orderstatus) = 'O'")
def p18(spark, sf):
    return load(spark, sf, "orders").where(F.trim(F.col("o_orderstatus").cast("string")) == "O").select(F.col("o_orderkey").alias("fid"), F.col("o_orderstatus").alias("v")).orderBy("fid").limit(1)


@query("F01_normalize_name", f"{N} SELECT id, {_normal('name')} AS v FROM names")
def f01(spark, sf):
    return load(spark, sf, "names").select("id", names.normalize_name(F.col("name")).alias("v"))


@query("F02_roman_to_arabic", f"{N} SELECT id, {_to_arabic('name')} AS v FROM names")
def f02(spark, sf):
    return load(spark, sf, "names").select("id", names.roman_to_arabic(F.col("name")).alias("v"))


@query("F03_arabic_to_roman", f"{N} SELECT id, {_to_roman('name')} AS v FROM names")
def f03(spark, sf):
    return load(spark, sf, "names").select("id", names.arabic_to_roman(F.col("name")).alias("v"))


@query("F04_split_name_number", f"{N}, z AS (SELECT id, {_normal('name')} AS v FROM names) SELECT id, CASE WHEN regexp_matches(v, '^.+?\\s+\\d+$') THEN regexp_extract(v, '^(.+?)\\s+(\\d+)$', 1) ELSE v END AS base, nullif(regexp_extract(v, '^(.+?)\\s+(\\d+)$', 2), '') AS num FROM z")
def f04(spark, sf):
    df = load(spark, sf, "names").select("id", names.normalize_name(F.col("name")).alias("v"))
    return df.select("id", names.name_base(F.col("v")).alias("base"), names.name_number(F.col("v")).alias("num"))


@query("F05_levenshtein", f"{N} SELECT id, levenshtein({_normal('name')}, clean) AS d FROM names")
def f05(spark, sf):
    return load(spark, sf, "names").select("id", names.levenshtein(names.normalize_name(F.col("name")), F.col("clean")).cast("long").alias("d"))


@query("F06_title_case")
def f06(spark, sf):
    return load(spark, sf, "names").select("id", names.title_case_smart(F.col("name")).alias("v"), names.title_case_smart(F.col("name"), True).alias("strict"))


@query("F09_normalize_barangay", f"{N} SELECT id, {_barangay('name')} AS v FROM names")
def f09(spark, sf):
    return load(spark, sf, "names").select("id", names.normalize_barangay(F.col("name")).alias("v"))


@query("F10_close_match")
def f10(spark, sf):
    left = load(spark, sf, "names").select(names.normalize_name(F.col("name")).alias("name")).where("name <> ''").distinct()
    found = rel.close_matches(left, load(spark, sf, "reference_names"), "name", "ref_name")
    return left.join(found.select("name", "match"), "name", "left")


@query("F11_clean_geocode", "SELECT c_custkey, lpad(regexp_replace(regexp_replace(trim(CAST(c_custkey AS VARCHAR) || '.0'), '\\.0$', ''), '\\D', '', 'g'), 9, '0') AS v FROM customer")
def f11(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", codes.clean_geocode(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")), 9).alias("v"))


@query("F12_psgc_to_14", f"{A} SELECT id, substr(substr(geocode, 5, 10), 3) || '000000' AS v FROM areas")
def f12(spark, sf):
    return load(spark, sf, "areas").select("id", codes.psgc_to_14(F.substring("geocode", 5, 10)).alias("v"))


_LAYER = "CASE c_custkey % 4 WHEN 0 THEN concat(p_name, '_BGY') WHEN 1 THEN concat('North ', p_name, ' - Barangay') WHEN 2 THEN concat(substr(p_name, 2, 5), '_bgy') ELSE concat('qz ', substr(p_name, 4, 6)) END"


@query("F13_city_detect", f"""WITH l AS (SELECT c_custkey, {_LAYER} AS layer FROM customer JOIN part ON p_partkey = c_custkey), k AS (SELECT c_custkey, regexp_replace(lower(regexp_replace(layer, '[_\\-\\s]+(bgy|barangay)$', '', 'i')), '[^a-z0-9]', '', 'g') AS k FROM l),
 p AS (SELECT replace(lower(p_name), ' ', '') AS c, min(p_partkey) AS o, arg_min(p_name, p_partkey) AS city FROM part GROUP BY 1) SELECT c_custkey, arg_min(city, o) AS city FROM k LEFT JOIN p ON k <> '' AND (contains(k, c) OR contains(c, k)) GROUP BY c_custkey""")
def f13(spark, sf):
    part = load(spark, sf, "part")
    layers = load(spark, sf, "customer").join(part, F.col("p_partkey") == F.col("c_custkey")).select("c_custkey", F.expr(_LAYER).alias("layer"))
    return rel.city_detect(layers, part.select("p_name", "p_partkey"), "layer", "p_name", "p_partkey").select("c_custkey", "city")


@query("F14_mbi_level", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 + 1 > 1 THEN '1_Inter-Region' WHEN l_partkey % 3 > 1 THEN '2_Inter-Province' WHEN l_suppkey % 4 > 1 THEN '3_Inter-City/Municipality' WHEN l_orderkey % 3 > 1 THEN '4_Inter-Barangay' ELSE '5_Within-Barangay' END AS mbi_level FROM lineitem")
def f14(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rules.mbi_level(F.col("l_linenumber") % 2 + 1, F.col("l_partkey") % 3, F.col("l_suppkey") % 4, F.col("l_orderkey") % 3).alias("mbi_level"))


@query("F15_mbi_status", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '2!_%' ESCAPE '!' OR o_orderpriority LIKE '2-%' OR o_orderpriority LIKE '3-%' THEN '2_Pending' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderstatus END AS status FROM orders")
def f15(spark, sf):
    category = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "4_Inland Water").otherwise(F.replace("o_orderpriority", F.lit("-"), F.lit("_")))
    return load(spark, sf, "orders").select("o_orderkey", rules.mbi_status_default(category, F.col("o_orderstatus")).alias("status"))


@query("F16_round_area", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_discount * 100 + 0.5) / 100 AS area FROM lineitem")
def f16(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", geo.floor_round(F.col("l_extendedprice") * F.col("l_discount")).alias("area"))


@query("F17_stable_uuid", "SELECT c_custkey, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS uuid FROM (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR) || '|' || CAST(c_nationkey AS VARCHAR)) AS h FROM customer)")
def f17(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", codes.stable_uuid(F.col("c_custkey"), F.col("c_nationkey")).alias("uuid"))


@query("F18_next_bsn", f"""{S}, m AS (SELECT max(CASE WHEN CAST(bsn AS INT) > 60000 AND CAST(bsn AS INT) < 70000 THEN CAST(bsn AS INT) END) AS m6, max(CASE WHEN CAST(bsn AS INT) >= 70000 AND CAST(bsn AS INT) < 80000 THEN CAST(bsn AS INT) END) AS m7 FROM survey)
 SELECT fid, CASE WHEN bldg_type = '09' THEN '55555' WHEN bldg_type IN ('10','11') THEN '00000' WHEN bldg_type = '08' AND bsn LIKE '6%' THEN bsn WHEN bldg_type = '08' THEN coalesce(lpad(CAST(m6 + 1 AS VARCHAR), 5, '0'), '60001') WHEN map_uuid IS NOT NULL THEN coalesce(lpad(CAST(m7 + 1 AS VARCHAR), 5, '0'), '70001') ELSE bsn END AS next_bsn FROM survey, m""")
def f18(spark, sf):
    df = load(spark, sf, "survey")
    n = F.col("bsn").cast("int")
    top = df.agg(F.max(F.when((n > 60000) & (n < 70000), n)).alias("m6"), F.max(F.when((n >= 70000) & (n < 80000), n)).alias("m7")).first()  # two numbers
    return df.select("fid", codes.next_bsn(F.col("map_uuid"), F.col("bldg_type"), F.col("bsn"), F.lit(top["m6"]), F.lit(top["m7"])).alias("next_bsn"))


@query("F19_bsn_geoid", f"{S} SELECT fid, coalesce((CASE WHEN fid % 4 > 0 THEN ea_geocode END) || bsn, substr(bsn_geoid, 1, 14) || bsn) AS v FROM survey")
def f19(spark, sf):
    return load(spark, sf, "survey").select("fid", codes.bsn_geoid(F.when(F.col("fid") % 4 > 0, F.col("ea_geocode")), F.substring("bsn_geoid", 1, 14), F.col("bsn")).alias("v"))


@query("F20_ean_default", f"{S} SELECT fid, coalesce(CASE WHEN fid % 3 > 0 THEN ean END, substr(ea_geocode, 9, 6)) AS ean FROM survey")
def f20(spark, sf):
    return load(spark, sf, "survey").select("fid", codes.ean_default(F.when(F.col("fid") % 3 > 0, F.col("ean")), F.col("ea_geocode")).alias("ean"))


@query("F21_date_stamp", "SELECT event_id, strftime(ts, '%m.%d.%Y - %I:%M:%S %p') AS stamp FROM events")
def f21(spark, sf):
    return load(spark, sf, "events").select("event_id", F.date_format("ts", "MM.dd.yyyy - hh:mm:ss a").alias("stamp"))


@query("F22_value_map", f"""{S} SELECT fid, CASE CASE WHEN fid % 29 = 0 THEN '99' ELSE bldg_type END WHEN '01' THEN '01_Single House' WHEN '02' THEN '02_Duplex' WHEN '03' THEN '03_Apartment/Accessoria/Rowhouse' WHEN '04' THEN '04_Condominium/Condotel'
 WHEN '05' THEN '05_Other Multi-Unit Residential Building' WHEN '06' THEN '06_Commercial/Industrial/Agricultural' WHEN '07' THEN '07_Institutional Living Quarter' WHEN '08' THEN '08_None (Homeless)' WHEN '09' THEN '09_Temporary Evacuation Centers/Relocation Area'
 WHEN '10' THEN '10_Demolished/Destroyed, Dilapidated, and Out-of-scope' WHEN '11' THEN '11_Purely Commercial/Industrial/Agricultural Building' WHEN '99' THEN '99_Other Type of Building' END AS label FROM survey""")
def f22(spark, sf):
    kind = F.when(F.col("fid") % 29 == 0, "99").otherwise(F.col("bldg_type"))
    return load(spark, sf, "survey").select("fid", rules.decode(kind, rules.BUILDING_TYPES).alias("label"))


@query("F23_correspondence", f"{S} SELECT fid, coalesce(map_uuid, '') || ':' || ea_geocode || ':' || CAST(year(datecreate) AS VARCHAR) AS v FROM survey")
def f23(spark, sf):
    year = F.concat(F.year("datecreate").cast("string"), F.lit(".0"))
    return load(spark, sf, "survey").select("fid", codes.correspondence_key(F.col("map_uuid"), F.col("ea_geocode"), year).alias("v"))


@query("F24_ea_display_name", f"""{E}, z AS (SELECT ea_id, CASE ea_id % 6 WHEN 0 THEN name WHEN 1 THEN 'EA 7' WHEN 2 THEN ' 12.0 ' END AS n, CASE ea_id % 6 WHEN 3 THEN ean WHEN 4 THEN 'AB' || substr(ean, 3, 1) || 'X' || substr(ean, 4, 3) END AS c FROM eas)
 SELECT ea_id, CASE ea_id % 6 WHEN 0 THEN 'EA ' || trim(n) WHEN 1 THEN 'EA 7' WHEN 2 THEN 'EA 12' WHEN 3 THEN 'EA ' || c WHEN 4 THEN 'EA ' || right(c, 3) ELSE 'EA Unknown' END AS v FROM z""")
def f24(spark, sf):
    kind = F.col("ea_id") % 6
    name = F.when(kind == 0, F.col("name")).when(kind == 1, "EA 7").when(kind == 2, " 12.0 ")
    code = F.when(kind == 3, F.col("ean")).when(kind == 4, F.concat(F.lit("AB"), F.substring("ean", 3, 1), F.lit("X"), F.substring("ean", 4, 3)))
    return load(spark, sf, "eas").select("ea_id", codes.ea_display_name(name, code).alias("v"))


@query("F25_layer_type_key", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '') ELSE regexp_replace(p_name, '^[^ ]* ', '') END AS v FROM part")
def f25(spark, sf):
    label = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Layer (*_"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit(")"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    return load(spark, sf, "part").select("p_partkey", codes.layer_type_key(label).alias("v"))


@query("F26_strip_count", "SELECT p_partkey, p_name AS v FROM part")
def f26(spark, sf):
    return load(spark, sf, "part").select("p_partkey", codes.strip_count_label(F.concat(F.col("p_name"), F.lit(" ["), F.col("p_size").cast("string"), F.lit("] "))).alias("v"))


@query("F27_export_stem", f"{A} SELECT id, substr(geocode, 1, 3) || '_' || province AS v FROM areas")
def f27(spark, sf):
    return load(spark, sf, "areas").select("id", codes.export_stem(F.col("geocode"), F.col("province")).alias("v"))


@query("F28_semver", "SELECT p_partkey, (p_partkey % 5) || '.' || (p_size + 1) || '.0' AS bumped, (p_partkey % 5 > 2 OR (p_partkey % 5 = 2 AND p_size > 7) OR (p_partkey % 5 = 2 AND p_size = 7 AND p_partkey % 9 > 3)) AS newer FROM part")
def f28(spark, sf):
    text = F.concat_ws(".", (F.col("p_partkey") % 5).cast("string"), F.col("p_size").cast("string"), F.concat((F.col("p_partkey") % 9).cast("string"), F.lit("-rc")))
    df = load(spark, sf, "part").select("p_partkey", codes.semver(text).alias("s"))
    return df.select("p_partkey", codes.bump(F.col("s"), "minor").alias("bumped"), (F.col("s") > F.struct(F.lit(2).alias("major"), F.lit(7).alias("minor"), F.lit(3).alias("patch"))).alias("newer"))


@query("F29_change_lines", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN 'Merge branch ' || p_name WHEN 2 THEN 'Bugfix/' || p_name WHEN 3 THEN 'release v' || p_partkey WHEN 4 THEN 'Update changelog' WHEN 5 THEN 'ok' WHEN 6 THEN 'update readme' ELSE 'wip' END AS line,
 p_partkey % 8 IN (1, 2, 3, 4, 5, 7) AS noise FROM part""")
def f29(spark, sf):
    kinds = ("concat('* fix(core): ', p_name, ' by @some-one in https://host.example/pull/', p_partkey)", "concat('Merge branch ', p_name, '…')", "concat('Bugfix/', p_name)", "concat('release v', p_partkey)", "'Update changelog'", "'* feat!ok'", "'docs: update readme in https://host.example/x'", "'chore:wip'")
    line = F.expr("CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds)) + " END")
    df = load(spark, sf, "part").select("p_partkey", codes.clean_change_line(line).alias("line"))
    return df.select("p_partkey", "line", codes.is_noise_line(F.col("line")).alias("noise"))


@query("F30_change_category", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'fixes' WHEN 1 THEN 'improvements' WHEN 2 THEN 'features' WHEN 3 THEN 'features' WHEN 4 THEN 'fixes' ELSE 'features' END AS category FROM part")
def f30(spark, sf):
    verb = F.element_at(F.array(*map(F.lit, ("Fixed", "refactored", "Fix", "Improve", " Bugs in", "Corrected"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return load(spark, sf, "part").select("p_partkey", codes.change_category(F.concat_ws(" ", verb, F.col("p_name"))).alias("category"))


@query("F31_json_list", "SELECT p_partkey, '[\"' || replace(p_name, ' ', '\",\"') || '\"]' AS v FROM part")
def f31(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.to_json(F.split("p_name", " ")).alias("v"))


@query("F32_numeric_coercion", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS v FROM events")
def f32(spark, sf):
    raw = F.when(F.col("event_id") % 10 == 0, "x").when(F.col("event_id") % 10 == 5, "NaN").otherwise(F.get_json_object("props", "$.k"))
    return load(spark, sf, "events").select("event_id", codes.try_number(raw, 1.0).alias("v"))


@query("F33_swap_lon_lat", "SELECT o_orderkey, CASE WHEN o_orderkey % 60 < 35 AND o_orderkey % 130 > 90 THEN o_orderkey % 130 ELSE o_orderkey % 60 END AS lon, CASE WHEN o_orderkey % 60 < 35 AND o_orderkey % 130 > 90 THEN o_orderkey % 60 ELSE o_orderkey % 130 END AS lat FROM orders")
def f33(spark, sf):
    lon, lat = geo.swap_lon_lat(F.col("o_orderkey") % 60, F.col("o_orderkey") % 130)
    return load(spark, sf, "orders").select("o_orderkey", lon.alias("lon"), lat.alias("lat"))


@query("F34_slugify", f"{N} SELECT id, lower(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS v FROM names")
def f34(spark, sf):
    return load(spark, sf, "names").select("id", codes.slugify(F.col("name")).alias("v"))


_FILE = "CASE p_partkey % 6 WHEN 0 THEN p_name || '.gpkg' WHEN 1 THEN 'CON' WHEN 2 THEN p_name || '?.csv' WHEN 3 THEN p_name || ' ' WHEN 4 THEN 'lpt1.txt' ELSE 'dir/' || p_name || '/x.qgz' END"


@query("F35_valid_filename", "SELECT p_partkey, p_partkey % 6 IN (0, 4) AS as_name, p_partkey % 6 IN (0, 4, 5) AS as_path FROM part")
def f35(spark, sf):
    df = load(spark, sf, "part").select("p_partkey", F.expr(_FILE).alias("f"))
    return df.select("p_partkey", codes.is_valid_filename(F.col("f")).alias("as_name"), codes.is_valid_path(F.col("f")).alias("as_path"))


@query("F36_fileparts", "SELECT p_partkey, 'a/' || p_brand AS dir, replace(p_name, ' ', '.') AS stem, '.csv' AS ext FROM part")
def f36(spark, sf):
    path = F.concat(F.lit("a/"), F.col("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".csv"))
    return load(spark, sf, "part").select("p_partkey", *[v.alias(k) for k, v in codes.file_parts(path).items()])


@query("F37_next_free_name", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'fid' WHEN 1 THEN 'fid_1' WHEN 2 THEN 'fid_2' ELSE 'fid_1' END AS v FROM part")
def f37(spark, sf):
    sets = ("array('a')", "array('fid')", "array('fid', 'fid_1')", "array('fid', 'fid_2')")
    taken = F.expr("CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(sets)) + " END")
    return load(spark, sf, "part").select("p_partkey", codes.next_free_name(taken, F.lit("fid")).alias("v"))


_BOX = "x0*y0"


@query("G01_reproject", f"{duck('buildings')} SELECT pid, floor(radians(x)*6378137.0*1000+0.5)/1000 AS mx, floor(ln(tan(pi()/4+radians(y/4)/2))*6378137.0*1000+0.5)/1000 AS my FROM buildings WHERE x < 180")
def g01(spark, sf):
    x, y = geo.to_mercator(F.col("x"), F.col("y") / 4)
    return load(spark, sf, "buildings").where("x < 180").select("pid", geo.floor_round(x, 3).alias("mx"), geo.floor_round(y, 3).alias("my"))


@query("G08_delete_holes", f"{A} SELECT id, (x1-x0)*(y1-y0) AS area FROM areas")
def g08(spark, sf):
    outer = geo.rect_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    hole = geo.rect_ring(F.col("x0") + 1, F.col("y0") + 1, F.col("x0") + 2, F.col("y0") + 2)
    filled = geo.delete_holes(F.array(F.array(outer, hole)))
    return load(spark, sf, "areas").select("id", geo.signed_area(filled[0][0]).alias("area"))


@query("G11_measures", f"{A} SELECT id, (x1-x0)*(y1-y0) AS area, 2*(x1-x0+y1-y0) AS perimeter, floor((x0+x1)/2*1000000+0.5)/1000000 AS cx, floor((y0+y1)/2*1000000+0.5)/1000000 AS cy, x0 AS xmin, y1 AS ymax FROM areas")
def g11(spark, sf):
    ring = geo.rect_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    df = load(spark, sf, "areas").select("id", ring.alias("r"))
    cx, cy = geo.centroid(F.col("r"))
    b = geo.bounds(F.col("r"))
    return df.select("id", geo.signed_area(F.col("r")).alias("area"), geo.ring_length(F.col("r")).alias("perimeter"), geo.floor_round(cx, 6).alias("cx"), geo.floor_round(cy, 6).alias("cy"), b["xmin"].alias("xmin"), b["ymax"].alias("ymax"))


@query("G19_densify", f"{A} SELECT id, CAST(2*(ceil((x1-x0)/2)+ceil((y1-y0)/2)) AS BIGINT) AS vertices FROM areas")
def g19(spark, sf):
    ring = geo.densify(geo.rect_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]), 2.0)
    return load(spark, sf, "areas").select("id", F.size(ring).cast("long").alias("vertices"))


@query("G26_affine_transform", f"{A} SELECT id, 3*x0 - y0 + 7 AS ax, 2*x0 + 5*y0 - 1 AS ay FROM areas")
def g26(spark, sf):
    ring = geo.map_points(geo.rect_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]), geo.affine((3.0, -1.0, 7.0, 2.0, 5.0, -1.0)))
    return load(spark, sf, "areas").select("id", ring[0]["x"].alias("ax"), ring[0]["y"].alias("ay"))


@query("G27_zoom_box", f"{A} SELECT id, x0 - least(greatest((x1-x0)*100, 500.0), 5000.0)/2 AS xmin, y0 + least(greatest((x1-x0)*100, 500.0), 5000.0)/2 AS ymax FROM areas")
def g27(spark, sf):
    box = geo.zoom_box(F.col("x0"), F.col("y0"), (F.col("x1") - F.col("x0")) * 100)
    return load(spark, sf, "areas").select("id", box["xmin"].alias("xmin"), box["ymax"].alias("ymax"))
