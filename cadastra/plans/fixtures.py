"""Areas, buildings and enumeration areas derived from the star-schema tables by whole
arithmetic that is equal on every engine, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AREAS = """SELECT c_custkey AS id, lpad(CAST(c_custkey AS STRING), 14, '0') AS geocode, r_name AS region, n_name AS province, c_mktsegment AS city_mun, c_name AS barangay,
 CAST((c_custkey*37)%197 + 220*(c_custkey div 1000) AS DOUBLE) AS x0, CAST((c_custkey*53)%193 AS DOUBLE) AS y0,
 CAST((c_custkey*37)%197 + 220*(c_custkey div 1000) + 3 + c_custkey%5 AS DOUBLE) AS x1, CAST((c_custkey*53)%193 + 3 + c_custkey%7 AS DOUBLE) AS y1
 FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey"""
BUILDINGS = """SELECT o_orderkey AS pid, CAST((o_orderkey*7919)%2000 AS DOUBLE)/10 + 220*(o_custkey div 1000) AS x, CAST((o_orderkey*6101)%2000 AS DOUBLE)/10 AS y,
 1 + o_orderkey%6 AS hh, o_custkey AS owner FROM orders"""
#: Enumeration areas: parts as areas with codes and household counts.
EAS = """SELECT p_partkey AS ea_id, lpad(CAST(p_partkey%1000 AS STRING), 6, '0') AS ean, lpad(CAST(((p_partkey*31)%211 div 40)*1000 + ((p_partkey*59)%199 div 40) + 100000*(p_partkey div 1000) AS STRING), 9, '0') AS parent, CAST((p_partkey*17)%450 AS INT) AS hhcount,
 CASE WHEN p_partkey%11=0 THEN 'for_delineation' WHEN p_partkey%13=0 THEN 'For Delineation ' END AS eadel_indi, p_name AS name,
 CAST((p_partkey*31)%211 + 230*(p_partkey div 1000) AS DOUBLE) AS x0, CAST((p_partkey*59)%199 AS DOUBLE) AS y0,
 CAST((p_partkey*31)%211 + 230*(p_partkey div 1000) + 4 + p_partkey%3 AS DOUBLE) AS x1, CAST((p_partkey*59)%199 + 4 + p_partkey%4 AS DOUBLE) AS y1 FROM part"""
#: Dirty place names: part names with abbreviations, numerals and case varied by key.
NAMES = """SELECT p_partkey AS id, CASE p_partkey%8 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('Brgy. ', p_name) WHEN 2 THEN concat('Sto. ', p_name, ' III') WHEN 3 THEN concat(p_name, ' 3')
 WHEN 4 THEN concat('  ', replace(p_name, ' ', '-'), ' V ') WHEN 5 THEN concat(p_name, ' Pob. XIV') WHEN 6 THEN CASE WHEN p_partkey%3=0 THEN 'NULL' ELSE concat(p_name, ' 01') END ELSE replace(p_name, 'l', 'r') END AS name, p_name AS clean FROM part"""
REFERENCE = """SELECT min(p_partkey) AS ref_order, p_name AS ref_name FROM part GROUP BY p_name"""
#: Survey points of buildings.
SURVEY = """SELECT o_orderkey AS fid, lpad(CAST((o_orderkey*7)%99999 AS STRING), CASE WHEN o_orderkey%9=0 THEN 4 ELSE 5 END, '0') AS bsn, CASE WHEN o_orderkey%10=3 THEN NULL ELSE lpad(CAST(o_orderkey%13 AS STRING), 2, '0') END AS bldg_type,
 lpad(CAST(o_custkey AS STRING), CASE WHEN o_orderkey%17=0 THEN 5 ELSE 6 END, '0') AS ean, lpad(CAST(o_custkey AS STRING), 14, '0') AS ea_geocode,
 CASE WHEN o_orderkey%7=0 THEN NULL ELSE CAST(o_orderkey%180 AS DOUBLE) END AS longitude, CASE WHEN o_orderkey%19=0 THEN NULL ELSE CAST(o_orderkey%90 AS DOUBLE) END AS latitude,
 CASE WHEN o_orderkey%23=0 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS map_uuid, concat(lpad(CAST(o_custkey AS STRING), 14, '0'), lpad(CAST(o_orderkey%99999 AS STRING), 5, '0')) AS bsn_geoid, o_orderdate AS datecreate FROM orders"""
CASES = """SELECT l_orderkey*10 + l_linenumber AS case_id, l_orderkey*10 + l_linenumber AS load_order, CAST(l_orderkey%7 AS STRING) AS region, CAST(l_suppkey%11 AS STRING) AS province, l_returnflag AS mbi_type, l_linestatus AS mbi_status, l_shipdate AS filed FROM lineitem"""
CELL = 16.0

ALL = {"areas": AREAS, "buildings": BUILDINGS, "eas": EAS, "names": NAMES, "reference_names": REFERENCE, "survey": SURVEY, "cases": CASES}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a driver table itself."""
    if name not in ALL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = ALL[name]
    for t in ("customer", "nation", "region", "orders", "part", "lineitem", "supplier"):
        if f"FROM {t}" in sql or f"JOIN {t}" in sql:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region", "orders", "part", "lineitem", "supplier") if f"{{{t}}}" in sql}
    return spark.sql(sql, **tables)


def duck(*names: str) -> str:
    """WITH clause that defines the derived tables for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({duck_sql(n)})" for n in names)


def duck_sql(name: str) -> str:
    return ALL[name].replace(" div ", " // ").replace(" AS STRING)", " AS VARCHAR)")
