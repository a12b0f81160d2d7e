import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.functions import geo
from cadastra.geometry import arrangement as arr
from cadastra.geometry import wkb
from cadastra.operators import spatial
from cadastra.plans import enumeration as ea
from cadastra.plans import geometry_ops as ops
from cadastra.plans import special
from cadastra.sources import layers


def square(x, y, w=1.0, h=1.0):
    return [[[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]]


RING = [square(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]


def test_gaps_are_enclosed_holes_only():
    assert [arr.area(g) for g in arr.gaps(RING)] == [1.0]
    assert arr.gaps([g for g in RING if g != square(1, 0)]) == []


def test_overlay_identities_on_random_polygons():
    rng = random.Random(1)
    for _ in range(40):
        a, b = (arr.make_valid([[[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randint(3, 7))]]]) for _ in range(2))
        both = arr.area(arr.intersection(a, b))
        assert arr.area(arr.union([a, b])) + both == pytest.approx(arr.area(a) + arr.area(b), abs=1e-6)
        assert arr.area(arr.difference(a, b)) + both == pytest.approx(arr.area(a), abs=1e-6)
        assert arr.is_valid(arr.union([a, b]))


def test_bow_tie_is_repaired_and_measured():
    bow = [[[(0, 0), (2, 2), (2, 0), (0, 2)]]]
    assert not arr.is_valid(bow) and arr.area(arr.make_valid(bow)) == 2 and arr.is_valid(arr.make_valid(bow))
    assert arr.min_rectangle([(0, 0), (2, 2), (1, 3), (-1, 1)]) == pytest.approx((8**0.5, 2**0.5))
    assert arr.shared_boundary(square(0, 0, 2, 2), square(2, 1, 2, 2)) == 1 and arr.shared_boundary(square(0, 0), square(1, 1)) == 0 and arr.shared_boundary(square(0, 0), square(5, 5)) < 0
    assert arr.clip_line([(-1, 0.5), (5, 0.5)], square(0, 0, 2, 2)) == [[(0.0, 0.5), (2.0, 0.5)]]
    assert sum(arr.ring_area(r) for r in arr.voronoi([(1, 1), (3, 1), (2, 4)], (0, 0, 5, 5))) == pytest.approx(25)
    assert len(arr.simplify([(0, 0), (1, 0.01), (2, 0), (2, 2), (0, 2)], 0.1)) == 4
    assert arr.snap_to([(0.5, 0.1)], np.array([[0, 0, 1, 0]]), 0.2) == [(0.5, 0.0)]


def test_wkb_round_trip():
    g = [*arr.difference(square(0, 0, 3, 3), square(1, 1)), *square(9, 9)]
    assert wkb.parse(wkb.dump(g)) == g and wkb.parse(None) is None


def layer(spark, shapes):
    return spark.createDataFrame([("k", i, None if g is None else wkb.dump(g)) for i, g in enumerate(shapes)], "k string, fid long, geom binary")


def test_layer_operators(spark):
    centre_missing = layer(spark, [*RING, None])
    got = {r["fid"]: r for r in ops.recover_null(centre_missing, "k").collect()}
    assert got[8]["recovered"] and arr.area(wkb.parse(got[8]["geom"])) == 1
    bow = [[[(0, 0), (2, 2), (2, 0), (0, 2)]]]
    mixed = layer(spark, [square(0, 0), square(0, 0), None, bow])
    assert sorted(tuple(r) for r in ops.check_layer(mixed).collect()) == [(0, "duplicate"), (2, "null"), (3, "self_intersection")]
    fixed = ops.repair(mixed, "k")
    assert {r["issue"] for r in ops.check_layer(fixed).collect()} == {"duplicate", "null"}
    assert ops.gap_finder(layer(spark, RING), "k").first()["area"] == 1
    filled = ops.gap_fill(layer(spark, RING), "k", "fid", "geom", F.col("fid") == 0, F.lit(bytearray(wkb.dump(square(0, 0, 3, 3)))))
    assert {r["role"]: r["area"] for r in filled.collect()}.keys() <= {"original", "result", "gap_fill"}


def test_gap_is_filled_into_a_touching_target():
    result, gained = ops.fill_gaps(RING, 1, square(0, 0, 3, 3))
    assert arr.area(gained) == 1 and arr.area(result) == 2


def test_grid_join_equals_nested_loop(spark):
    rng = random.Random(4)
    boxes = []
    for i in range(120):
        x, y = rng.randint(-50, 50), rng.randint(-50, 50)
        boxes.append((i, float(x), float(y), float(x + rng.randint(0, 12)), float(y + rng.randint(0, 12))))
    df = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")
    for closed in (True, False):
        got = sorted((r[0], r[1]) for r in spatial.box_join(df, df, 7.0, closed).select("a.id", "b.id").collect())
        op = (lambda p, q: p <= q) if closed else (lambda p, q: p < q)
        want = sorted((a[0], b[0]) for a in boxes for b in boxes if op(max(a[1], b[1]), min(a[3], b[3])) and op(max(a[2], b[2]), min(a[4], b[4])))
        assert got == want


def test_nearest_equals_brute_force(spark):
    rng = random.Random(6)
    pts = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)] + [(90, 5000.0, 5000.0)]
    df = spark.createDataFrame(pts, "k long, x double, y double")
    got = {r["k"]: r["d2"] for r in spatial.nearest(df, df.withColumnRenamed("k", "o"), "k", "o", 3.0).collect()}
    assert got == pytest.approx({a[0]: min((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 for b in pts if b[0] != a[0]) for a in pts})


def test_point_in_ring_counts_the_boundary(spark):
    ring = geo.rect_ring(F.lit(0), F.lit(0), F.lit(2), F.lit(2))
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (2.0, 2.0), (2.1, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(geo.point_in_ring(F.col("x"), F.col("y"), ring)).collect()] == [True, True, True, False]


def buildings(n, seed=0):
    rng = random.Random(seed)
    return [(rng.uniform(0.5, 9.5), rng.uniform(0.5, 9.5), 10.0, 1 / n) for _ in range(n)]


def test_split_is_a_partition():
    area = {"id": 1, "ean": "001000", "geom": square(0, 0, 10, 10), "buildings": buildings(60), "hh": 600.0, "flagged": False}
    parts = ea.split(area)
    assert len(parts) >= 2 and sum(arr.area(p["geom"]) for p in parts) == pytest.approx(100, rel=1e-6)
    assert sum(p["hh"] for p in parts) == 600 and all(p["hh"] > 100 for p in parts)
    assert arr.area(arr.intersection(parts[0]["geom"], parts[1]["geom"])) < 1e-6
    assert ea.split_lines(parts)


def test_strips_over_the_limit_are_cut_again():
    # most households in the first tenth of the area, the others thin
    dense = [(0.02 + 0.01 * i, 0.5 + 0.1 * (i % 80), 10.0, 0.0) for i in range(96)]
    thin = [(1.5 + 0.5 * i, 5.0, 10.0, 0.0) for i in range(15)]
    area = {"id": 1, "ean": "001000", "geom": square(0, 0, 10, 10), "buildings": dense + thin, "hh": 1110.0, "flagged": False}
    parts = ea.split_strips(area)
    assert all(100 < p["hh"] <= 300 for p in parts)
    assert sum(p["hh"] for p in parts) == 1110 and sum(arr.area(p["geom"]) for p in parts) == pytest.approx(100, rel=1e-6)
    # what a single pass leaves
    assert any(p["hh"] > 300 for n in range(4, 9) for p in ea.enforce_minimum(ea._kept(dict(area), ea.strips(dict(area), n))))


def delineated(spark, points, barriers=None):
    eas = spark.createDataFrame([(1, "001000", "p", 400.0, False, wkb.dump(square(0, 0, 10, 10)))], "ea_id long, ean string, parent string, hhcount double, flagged boolean, geom binary")
    inside = spark.createDataFrame([(1, "p", *b) for b in points], "ea_id long, parent string, x double, y double, hh double, value double")
    walls = None if barriers is None else spark.createDataFrame(barriers, "parent string, x0 double, y0 double, x1 double, y1 double")
    return sorted((r["hh"], r["sink"]) for r in ea.delineate(eas, inside, barriers=walls).collect())


def test_delineate_heeds_barriers_and_values(spark):
    grid = [(x + i, 1.0 + 2 * j) for x in (1.0, 5.9) for i in (0.0, 1.0, 2.0, 3.0) for j in range(5)]
    even = [(*p, 10.0, 1 / 40) for p in grid]
    assert delineated(spark, even, [("p", 5.0, -1.0, 5.0, 11.0), ("other", 0.0, 0.0, 1.0, 1.0)]) == [(200.0, "delineated"), (200.0, "delineated")]
    assert delineated(spark, even) != [(200.0, "delineated"), (200.0, "delineated")]
    heavy = [(*p, 10.0, 0.8 if i == 0 else 0.2 / 39) for i, p in enumerate(grid)]
    assert delineated(spark, heavy) == [(400.0, "retained")]


def test_isolated_buildings_do_not_move_the_clusters():
    near = [(i % 3, i // 3) for i in range(9)]
    xy = np.array([*near, *[(x + 10, y) for x, y in near], (60.0, 0.0)], dtype=float)
    assert ea.isolated(xy).tolist() == [False] * 18 + [True] and not ea.isolated(xy[:5]).any()
    labels = ea.clusters(xy, np.ones(len(xy)), 2).tolist()
    assert len(set(labels[:9])) == len(set(labels[9:])) == 1 and labels[0] != labels[18]


def test_greedy_groups_respect_limits_and_barriers():
    pts = [(0.0, 0.0, 0.4), (1.0, 0.0, 0.4), (2.0, 0.0, 0.4), (10.0, 0.0, 0.1)]
    assert ea.greedy_groups(pts, 1.0) == [[0, 1], [2, 3]]
    wall = np.array([[0.5, -1.0, 0.5, 1.0]])
    assert ea.greedy_groups(pts, 10.0, wall)[0] == [0]


def test_merge_prefers_the_best_score():
    def at(i, hh, x):
        return {"id": i, "ean": "001000", "geom": square(x, 0), "buildings": [], "hh": float(hh)}

    done = ea.merge_small([at(1, 50, 1), at(2, 249, 0), at(3, 251, 2)])
    assert sorted(a["hh"] for a in done) == [251, 299]
    done = ea.merge_small([at(1, 0, 1), at(2, 290, 0), at(3, 120, 2)])
    assert sorted(a["hh"] for a in done) == [120, 290] and len(done) == 2
    codes = [a["new_ea"] for a in ea.number([{**at(7, 200, 0), "from_split": True}, {**at(7, 150, 1), "from_split": True}], 5)]
    assert codes == ["001000", "001006"]


def test_kmeans_is_stable():
    pts = np.array([[0, 0], [0, 1], [9, 9], [9, 8]], dtype=float)
    labels = ea.weighted_kmeans(pts, np.ones(4), 2)
    assert labels[0] == labels[1] != labels[2] == labels[3]


def test_geopackage_reader(spark, tmp_path):
    path = tmp_path / "qa_2025_03_x.gpkg"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT)")
        db.executemany("INSERT INTO gpkg_contents VALUES (?)", [("areas",), ("layer_styles",)])
        db.execute("CREATE TABLE areas (fid INTEGER, name TEXT, geom BLOB)")
        db.execute("INSERT INTO areas VALUES (1, 'a', ?)", (b"GP\0\1" + b"\0" * 4 + wkb.dump(square(0, 0)),))
    got = layers.read_gpkg(spark, str(path), "areas", "fid long, name string, geom binary").first()
    assert (got["fid"], got["name"]) == (1, "a") and wkb.parse(got["geom"]) == square(0, 0)
    assert tuple(layers.gpkg_layers(spark, str(tmp_path)).select("layer", "file_date").first()) == ("areas", "2025_03")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("01", 1), ("02", 2)], "geocode string, n int")
    for kind in ("csv", "orc", "json", "parquet"):
        layers.write_layer(df, f"{tmp_path}/x.{kind}")
        assert layers.read_layer(spark, f"{tmp_path}/x.{kind}").count() == 2
    layers.write_packages(df, f"{tmp_path}/packages")
    assert (tmp_path / "packages" / "geocode=01").is_dir()
    with pytest.raises(ValueError):
        layers.require_columns(df, "n", "m")


def test_special_areas_are_clipped_and_taken_out(spark):
    shape = lambda *a: wkb.dump(square(*a))
    eas = spark.createDataFrame([(1, "p", "001", shape(0, 0, 2, 4)), (2, "p", "002", shape(2, 0, 2, 4)), (3, "q", "003", shape(4, 0, 4, 4)), (4, "q", "004", None)], "ea_id long, parent string, ean string, geom binary")
    parents = spark.createDataFrame([("p", shape(0, 0, 4, 4)), ("q", shape(4, 0, 4, 4)), ("r", shape(20, 0, 4, 4))], "parent string, geom binary")
    issues = spark.createDataFrame([(10, shape(1, 1, 4, 2)), (11, shape(5, 5, 1, 1)), (12, shape(21, 1, 1, 1)), (13, None), (14, shape(2, 0, 2, 4))], "issue long, geom binary")
    got = {r["ea_id"]: (r["parent"], r["ean"], r["issue"], r["source_id"], r["geom"] and arr.area(wkb.parse(r["geom"]))) for r in special.inject_special(eas, issues, parents, 4.0).collect()}
    assert got == {
        1: ("p", "001", None, None, 6.0), 2: ("p", "002", None, None, 0.0), 3: ("q", "003", None, None, 16.0), 4: ("q", "004", None, None, None),
        5: ("p", "002", 10, 2, 6.0), 6: ("r", None, 12, None, 1.0), 7: ("p", "002", 14, 2, 8.0)}
    assert special.inject_special(eas, issues.limit(0), parents, 4.0).count() == 4
    assert special.inject_special(eas.limit(0), issues, parents, 4.0).count() == 3


def test_borders_of_split_areas(spark):
    rows = [("p", 1, "delineated", wkb.dump(square(0, 0, 2, 4))), ("p", 1, "delineated", wkb.dump(square(2, 0, 2, 4))), ("p", 1, "delineated", wkb.dump(square(4, 0, 2, 4))), ("p", 2, "retained", wkb.dump(square(6, 0, 2, 4)))]
    done = spark.createDataFrame(rows, "parent string, ea_id long, sink string, geom binary")
    got = [(r["ea_id"], r["line"], r["length"], sorted(map(tuple, r["points"]))) for r in ea.split_borders(done).orderBy("line").collect()]
    assert got == [(1, 0, 4.0, [(2.0, 0.0), (2.0, 4.0)]), (1, 1, 4.0, [(4.0, 0.0), (4.0, 4.0)])]


def test_parts_and_slivers(spark):
    many = [*square(0, 0, 10, 10), *square(20, 0, 0.05, 0.05), *square(30, 0, 0.2, 0.2)]
    rows = [("a", wkb.dump(many)), ("a", wkb.dump(square(40, 0, 1, 1))), ("b", wkb.dump(square(0, 0, 0.01, 0.01))), ("c", None), ("d", wkb.dump([]))]
    layer = spark.createDataFrame(rows, "name string, geom binary")
    assert sorted((r["name"], r["part"]) for r in ops.single_parts(layer).collect()) == [("a", 0), ("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert {r["name"]: arr.area(wkb.parse(r["geom"])) for r in ops.without_slivers(layer, "name").collect()} == pytest.approx({"a": 101.04, "b": 0.0001})
    assert [r[0] and round(arr.area(wkb.parse(r[0])), 9) for r in layer.where("name <> 'a'").select(ops.largest_part_of("geom")).collect()] == [0.0001, None, 0]


EAS = "ea_id long, ean string, parent string, hhcount double, flagged boolean, special boolean, geom binary"
INSIDE = "ea_id long, parent string, x double, y double, hh double, value double"


def test_variant_imputes_splits_in_rounds_and_routes(spark):
    grid = [(x + i, 1.0 + 2 * j) for x in (1.0, 5.9) for i in (0.0, 1.0, 2.0, 3.0) for j in range(5)]
    heavy = [(1, "p", *p, 10.0, 0.8 if i == 0 else 0.2 / 39) for i, p in enumerate(grid)]
    eas = spark.createDataFrame([
        (1, "001000", "p", None, None, None, wkb.dump(square(0, 0, 10, 10))), (2, "002000", "p", 50.0, False, True, wkb.dump(square(20, 0, 4, 4))),
        (3, "003000", "p", 150.0, False, True, wkb.dump(square(24, 0, 4, 4))), (4, "004000", None, 0.0, True, False, None), (5, None, "q", None, False, None, wkb.dump(square(0, 20, 1, 1)))], EAS)
    inside = spark.createDataFrame(heavy, INSIDE)
    assert {r["ea_id"]: r["hhcount"] for r in ea.imputed(eas, inside).collect()} == {1: 400.0, 2: 50.0, 3: 150.0, 4: 0.0, 5: 0.0}
    # every area's value is checked, or only that of candidates, by their own count
    held = ea.variant(eas, inside)
    assert {(r["ea_id"], r["hh"], r["sink"]) for r in held.collect()} == {(1, 400.0, "retained"), (2, 50.0, "delineated"), (3, 150.0, "delineated"), (4, 0.0, "retained"), (5, 0.0, "retained")}
    other = spark.createDataFrame([("002000", 400.0), ("002000", None)], "ean string, hhcount double")
    free = ea.variant(eas, inside, other).where("ea_id = 1").collect()
    assert len(free) > 1 and sum(r["hh"] for r in free) == 400 and {r["sink"] for r in free} == {"delineated"} and sum(r["bldg_count"] for r in free) == 40
    same = spark.createDataFrame([("001000", 400.0)], "ean string, hhcount double")
    assert ea.variant(eas, inside, same).where("ea_id = 1").count() == 1
    empty = ea.variant(eas.limit(0), inside.limit(0), other.limit(0))
    assert empty.collect() == [] and empty.columns == held.columns


def test_parts_over_the_limit_are_split_again(spark):
    points = [(1, "p", x + 0.5, y + 0.5, 45.0 if x < 4 else 5.0, 1 / 64) for x in range(8) for y in range(8)]
    eas = spark.createDataFrame([(1, "001000", "p", 1600.0, False, False, wkb.dump(square(0, 0, 8, 8)))], EAS)
    inside = spark.createDataFrame(points, INSIDE)
    limit = spark.createDataFrame([], "ean string, hhcount double")

    def sizes(**how):
        rows = ea.split_rounds(eas, inside, limit, 100, 300, **how).collect()
        assert sum(r["hh"] for r in rows) == 1600 and sum(len(r["buildings"]) for r in rows) == 64
        assert sum(arr.area(wkb.parse(r["geom"])) for r in rows) == pytest.approx(64, abs=1e-5)
        return {r["part"]: r["hh"] for r in rows}

    once, more = sizes(resplit=False), sizes()
    again = {k for k, n in once.items() if n >= 300}
    assert again and all("." not in k for k in once)
    assert all(k in more for k in once.keys() - again)
    assert {k.split(".")[0] for k in more if "." in k} <= again and max(more.values()) < 300
