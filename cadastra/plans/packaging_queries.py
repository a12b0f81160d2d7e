"""Queries of the packaging rules.  Projects are the orders, layers their lines; names,
sources and flags are derived from the keys, and the rules run on those columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import packaging
from .fixtures import load
from .registry import query

#: Expressions over ``lineitem`` and ``orders`` that both engines read alike.
LAYERS = {
    "project": "l_orderkey", "layer": "l_orderkey*10 + l_linenumber", "layer_type": "CASE WHEN l_suppkey%7=0 THEN 'raster' WHEN l_partkey%101<>7 THEN 'vector' END",
    "valid": "CASE WHEN l_partkey%103<>5 THEN l_partkey%8<>0 END", "supported": "l_suppkey%10<>1", "localized": "l_partkey%3=0",
    "provider": "CASE l_partkey%7 WHEN 0 THEN 'postgres' WHEN 1 THEN 'memory' WHEN 2 THEN 'delimitedtext' WHEN 3 THEN 'wms' ELSE 'ogr' END",
    "storage": "CASE l_partkey%7 WHEN 0 THEN 'PostgreSQL' WHEN 1 THEN 'Memory' WHEN 2 THEN 'Delimited text file' WHEN 4 THEN 'GPKG' WHEN 5 THEN 'CSV' ELSE 'ESRI Shapefile' END",
    "encoding": "CASE l_suppkey%5 WHEN 0 THEN 'ISO-8859-1' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'UTF-8' END",
    "path": "CASE WHEN l_partkey%7 NOT IN (0, 1, 3) THEN concat(CASE WHEN l_suppkey%6=0 THEN '/srv/other/' ELSE '/srv/survey/' END, CASE WHEN l_linenumber=5 THEN 'Cañada' ELSE 'layer' END, CAST(l_suppkey%3 AS STRING), '.gpkg') END",
    "pk": "CASE l_suppkey%4 WHEN 0 THEN '' WHEN 1 THEN 'id' WHEN 2 THEN 'id;part' ELSE 'a,b' END", "fields": "CASE WHEN l_linenumber%2=0 THEN 'name;FID;id' ELSE 'name;id;part' END",
    "read_only": "l_returnflag = 'R'",
    "action": "CASE l_partkey%5 WHEN 0 THEN 'offline' WHEN 1 THEN 'copy' WHEN 2 THEN 'keep_existent' WHEN 3 THEN 'remove' ELSE 'no_action' END",
    "cloud_action": "CASE (l_partkey + l_suppkey)%6 WHEN 0 THEN 'offline' WHEN 1 THEN 'copy' WHEN 2 THEN 'keep_existent' WHEN 3 THEN 'remove' WHEN 4 THEN 'no_action' END",
    "configured": "l_linenumber<>2", "cloud_configured": "l_linenumber<>2 OR l_suppkey%2=0",
}
PROJECTS = {
    "project": "o_orderkey", "file": "'survey.qgz'", "home": "'/srv/survey'", "absolute": "o_orderkey%11=0", "preset_home": "CASE WHEN o_orderkey%13=0 THEN '/home/a' WHEN o_orderkey%2=0 THEN '' END", "dirty": "o_orderstatus = 'P'",
}
FILES = {
    "project": "l_orderkey",
    "path": "CASE l_linenumber WHEN 1 THEN 'survey.qgz' WHEN 2 THEN concat('data/', CASE WHEN l_partkey%9=0 THEN 'what?' ELSE 'roads' END, '.gpkg') WHEN 3 THEN 'photos/survey.png' WHEN 4 THEN 'survey.gpkg~' WHEN 5 THEN '.sync/survey.a|b' ELSE concat('con/', CAST(l_suppkey AS STRING)) END",
}


def _exprs(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


def _layers(spark, sf):
    rows = load(spark, sf, "lineitem").selectExpr(*_exprs(LAYERS))
    return rows.withColumn("pk", F.when(F.col("pk") != "", F.split("pk", ";"))).withColumn("fields", F.split("fields", ";"))


def _projects(spark, sf):
    return load(spark, sf, "orders").selectExpr(*_exprs(PROJECTS))


def _files(spark, sf):
    return load(spark, sf, "lineitem").selectExpr(*_exprs(FILES))


_DUCK = f"""WITH l0 AS (SELECT {', '.join(_exprs(LAYERS))} FROM lineitem), p AS (SELECT {', '.join(_exprs(PROJECTS))} FROM orders), f AS (SELECT {', '.join(_exprs(FILES))} FROM lineitem),
 l1 AS (SELECT *, CASE WHEN pk = '' THEN 0 ELSE len(string_split(pk, ';')) END AS npk FROM l0),
 l2 AS (SELECT *, CASE WHEN npk = 1 THEN pk WHEN npk = 0 THEN list_filter(string_split(fields, ';'), lambda x: lower(x) = 'fid')[1] END AS k FROM l1),
 l AS (SELECT *, CASE WHEN coalesce(layer_type, '') <> 'vector' THEN 'not_vector' WHEN npk > 1 THEN 'composite' WHEN k IS NULL THEN 'missing' WHEN contains(k, ',') THEN 'comma' END AS err,
  concat_ws(',', CASE WHEN NOT supported THEN 'unsupported_datasource' END, CASE WHEN coalesce(valid, false) THEN NULL WHEN localized THEN 'localized_path' WHEN provider = 'wms' THEN 'invalid_remote_raster_layer' ELSE 'invalid' END) AS why FROM l2)"""

_ALIVE = "NOT coalesce(action = 'remove' AND cloud_action = 'remove', false)"
_PAST = "coalesce(cloud_action, '') <> 'remove'"
#: name, condition, subject, scopes; rules from the key's on end where the cloud removes.
_LAYER_SQL = (
    ("encoding", "layer_type = 'vector' AND encoding NOT IN ('UTF-8', '')", "encoding", "cable cloud"),
    ("file_name", "path LIKE '%ñ%'", "path", "cable cloud"),
    ("outside_home", "path NOT LIKE '/srv/survey/%' AND NOT localized", "path", "cable cloud"),
    ("primary_key", f"{_PAST} AND why = '' AND layer_type = 'vector' AND NOT (coalesce(cloud_action, '') = 'no_action' AND path IS NULL) AND NOT read_only AND err IS NOT NULL", "err", "cloud"),
    ("memory", f"{_PAST} AND valid AND provider = 'memory'", "provider", "cable cloud"),
    ("not_configured", f"{_PAST} AND NOT configured AND NOT cloud_configured", "NULL", "cable cloud"),
    ("prevented", f"{_PAST} AND why <> ''", "why", "cable cloud"),
    ("experimental", f"{_PAST} AND cloud_action = 'offline' AND NOT read_only AND NOT (storage IN ('GPKG', 'PostgreSQL', 'Delimited text file', 'CSV'))", "storage", "cloud"),
)


def _findings(scope: str) -> str:
    rows = [f"SELECT project, layer, 'warning' AS level, '{n}' AS rule, {s} AS subject FROM l WHERE {_ALIVE} AND {c}" for n, c, s, scopes in _LAYER_SQL if scope in scopes]
    rows.append("SELECT project, NULL, 'error', 'absolute_paths', NULL FROM p WHERE absolute")
    rows.append("SELECT project, NULL, 'error', 'home_path', preset_home FROM p WHERE preset_home <> ''")
    rows.append("SELECT project, NULL, 'error', 'forbidden_path', path FROM f WHERE path LIKE '%?%' OR path LIKE 'con/%'")
    if scope == "cable":
        rows.append("SELECT project, NULL, 'error', 'mixed_actions', path FROM l WHERE action IN ('offline', 'copy') AND path IS NOT NULL GROUP BY project, path HAVING count(DISTINCT action) = 2")
    else:
        rows.append("SELECT project, NULL, 'warning', 'unsaved', NULL FROM p WHERE dirty")
        rows.append("SELECT project, NULL, 'warning', 'conflicting_name', path FROM f WHERE path = 'photos/survey.png'")
    return f"{_DUCK} {' UNION ALL '.join(rows)}"


@query("R01_package_rules_cloud", _findings("cloud"))
def r01_cloud(spark, sf):
    return packaging.check(_projects(spark, sf), _layers(spark, sf), _files(spark, sf), "cloud")


@query("R01_package_rules_cable", _findings("cable"))
def r01_cable(spark, sf):
    return packaging.check(_projects(spark, sf), _layers(spark, sf), _files(spark, sf), "cable")


@query("R04_layer_keys", f"{_DUCK} SELECT layer, CASE WHEN err IS NULL THEN k END AS name, err AS error FROM l")
def r04(spark, sf):
    return packaging.described(_layers(spark, sf)).select("layer", "key.*")


@query("R05_layer_reasons", f"{_DUCK} SELECT layer, why AS reasons FROM l")
def r05(spark, sf):
    return packaging.described(_layers(spark, sf)).select("layer", F.array_join("reasons", ",").alias("reasons"))


def _routes(scope: str) -> str:
    action = "action" if scope == "cable" else "CASE WHEN coalesce(valid, false) AND layer_type = 'vector' AND err IS NOT NULL THEN 'no_action' ELSE cloud_action END"
    only = "false" if scope == "cable" else "why = '' AND coalesce(layer_type = 'vector', false) AND err IS NOT NULL"
    return f"""{_DUCK}, a AS (SELECT *, {action} AS act FROM l) SELECT layer, CASE WHEN why LIKE '%unsupported_datasource%' OR regexp_matches(why, '(^|,)invalid$') THEN 'remove' WHEN why <> '' THEN 'leave' WHEN act = 'offline' THEN 'offline'
 WHEN act IN ('copy', 'no_action') THEN 'copy' WHEN act = 'keep_existent' THEN 'copy_if_absent' WHEN act = 'remove' THEN 'remove' ELSE 'leave' END AS route, CASE WHEN why = '' AND err IS NULL THEN k END AS key_name, {only} AS made_read_only FROM a"""


@query("R06_layer_routes_cloud", _routes("cloud"))
def r06_cloud(spark, sf):
    return packaging.routed(_layers(spark, sf), "cloud").select("layer", "route", "key_name", "made_read_only")


@query("R06_layer_routes_cable", _routes("cable"))
def r06_cable(spark, sf):
    return packaging.routed(_layers(spark, sf), "cable").select("layer", "route", "key_name", "made_read_only")
