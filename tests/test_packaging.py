import pytest
from pyspark.sql import Row

from cadastra.plans import packaging

LAYERS = "project long, layer long, layer_type string, valid boolean, supported boolean, provider string, storage string, encoding string, path string, localized boolean, pk array<string>, fields array<string>, read_only boolean, action string, cloud_action string, configured boolean, cloud_configured boolean, home string"
PROJECTS = "project long, file string, home string, absolute boolean, preset_home string, dirty boolean"


def layer(n, **more):
    base = dict(project=1, layer=n, layer_type="vector", valid=True, supported=True, provider="ogr", storage="GPKG", encoding="UTF-8", path="/p/a.gpkg", localized=False,
                pk=["id"], fields=["id"], read_only=False, action="offline", cloud_action="offline", configured=True, cloud_configured=True, home="clash")
    return Row(**{**base, **more})


@pytest.fixture(scope="module")
def tables(spark):
    layers = spark.createDataFrame([
        layer(1), layer(2, action="remove", cloud_action="remove", encoding="X", provider="memory"), layer(3, cloud_action="remove", encoding="X", provider="memory"),
        layer(4, pk=["a", "b"], path="/p/b.gpkg"), layer(5, pk=None, fields=["x", "Fid"], path="/p2/c.gpkg", action="copy"), layer(6, pk=[], fields=None, path="/p/a.gpkg", action="copy", storage="SHP"),
        layer(7, **{c: None for c in ("layer_type", "valid", "supported", "provider", "storage", "encoding", "path", "localized", "pk", "fields", "read_only", "action", "cloud_action", "configured", "cloud_configured")}),
        layer(8, valid=False, localized=True, path=None), layer(9, pk=["a,b"], cloud_action="copy", path="/p/d.gpkg"), layer(9, pk=["a,b"], cloud_action="copy", path="/p/d.gpkg")], LAYERS)
    projects = spark.createDataFrame([(1, "map.qgz", "/p", True, "", True), (2, "map.qgz", None, None, None, None)], PROJECTS)
    files = spark.createDataFrame([(1, p) for p in ("map.qgz", "map.png", "in/map.txt", "map.gpkg~", ".sync/map.a", "mapped.png", "x/con/y", "a:b", None, "")] + [(3, "map.png")], "project long, path string")
    return projects, layers, files


def found(tables, scope):
    return sorted(((r["layer"] or 0, r["rule"], r["subject"]) for r in packaging.check(*tables, scope).collect()), key=str)


def test_rules_by_scope(tables):
    both = [(0, "absolute_paths", None), (0, "forbidden_path", "a:b"), (0, "forbidden_path", "x/con/y"), (3, "encoding", "X"), (5, "outside_home", "/p2/c.gpkg"), (7, "not_configured", None), (7, "prevented", "unsupported_datasource,invalid"), (8, "prevented", "localized_path")]
    cloud = [(0, "conflicting_name", "in/map.txt"), (0, "conflicting_name", "map.png"), (0, "unsaved", None), (4, "primary_key", "composite"), (6, "experimental", "SHP"), (6, "primary_key", "missing"), (9, "primary_key", "comma"), (9, "primary_key", "comma")]
    assert found(tables, "cable") == sorted([*both, (0, "mixed_actions", "/p/a.gpkg")], key=str)
    assert found(tables, "cloud") == sorted(both + cloud, key=str)
    with pytest.raises(ValueError):
        packaging.check(*tables, "air")


def test_routes(tables):
    def routes(scope):
        return {r["layer"]: (r["route"], r["key_name"], r["made_read_only"]) for r in packaging.routed(tables[1], scope).collect()}

    assert routes("cloud") == {
        1: ("offline", "id", False), 2: ("remove", "id", False), 3: ("remove", "id", False), 4: ("copy", None, True), 5: ("offline", "Fid", False), 6: ("copy", None, True),
        7: ("remove", None, False), 8: ("leave", None, False), 9: ("copy", None, True)}
    assert {k: v[0] for k, v in routes("cable").items()} == {1: "offline", 2: "remove", 3: "offline", 4: "offline", 5: "copy", 6: "copy", 7: "remove", 8: "leave", 9: "offline"}


def test_empty_tables(tables):
    none = [t.limit(0) for t in tables]
    assert packaging.check(*none, "cloud").collect() == [] and packaging.routed(none[1], "cable").collect() == []
