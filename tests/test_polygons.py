"""Joins and reports of true polygons on shapes with known answers."""

import pytest

from cadastra.geometry import wkb
from cadastra.operators import polygons
from cadastra.plans import boundary

TRIANGLE = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]


def square(x, y, n=1.0):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]


def frame(spark, rings):
    return spark.createDataFrame([(k, wkb.dump([[r]]) if r else None) for k, r in rings.items()], "id long, geom binary")


def test_predicates_of_triangles(spark):
    left = frame(spark, {1: TRIANGLE, 2: None})
    # 13's box meets the triangle's, the shapes do not
    right = frame(spark, {10: square(1, 1), 11: square(0.25, 0.25), 12: square(-1, 0), 13: square(3, 3), 14: square(3, 0, 4), 15: square(-1, -1, 9), 16: TRIANGLE, 17: square(2, 2), 18: None, 19: square(1.5, 1.5)})
    met = {r["b"]["id"]: r["r"].asDict() for r in polygons.polygon_join(left, right, 2.0).collect()}
    assert set(met) == {10, 11, 12, 14, 15, 16, 17, 19}
    said = {k: {p for p in polygons.PREDICATES.values() if v[p]} - {"intersects"} for k, v in met.items()}
    assert said == {10: {"contains"}, 11: {"contains"}, 12: {"touches"}, 14: {"overlaps"}, 15: {"within"}, 16: {"contains", "equals", "within"}, 17: {"touches"}, 19: {"overlaps"}}
    assert met[14]["area"] == pytest.approx(0.5) and met[19]["area"] == pytest.approx(0.5)
    kept = {(r["a"]["id"], r["b"] and r["b"]["id"]) for r in polygons.left_polygon_join(left, right, 2.0, "id", (3,)).collect()}
    assert kept == {(1, 12), (1, 17), (2, None)}
    assert polygons.polygon_join(left.limit(0), right, 2.0).count() == 0


def test_points_in_a_triangle(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 2.1, 2.1), (4, 3.9, 0.05), (5, 0.0, 0.0)], "pid long, x double, y double")
    got = {r["a"]["pid"] for r in polygons.point_join(points, frame(spark, {1: TRIANGLE}), 1.0).collect()}
    assert got == {1, 2, 4, 5}


@pytest.mark.parametrize(("tile", "links"), [(1.5, 200_000), (3.0, 0), (50.0, 200_000)])
def test_gaps_do_not_depend_on_the_tiles(spark, monkeypatch, tile, links):
    """A ring of squares around a 3 x 3 hole, one around a triangle, an open notch."""
    monkeypatch.setattr(polygons, "TASK_LINKS", links)
    rings = {k: square(x, y) for k, (x, y) in enumerate((x, y) for x in range(5) for y in range(5) if x in (0, 4) or y in (0, 4))}
    rings |= {100: [(10.0, 0.0), (14.0, 0.0), (14.0, 4.0)], 101: [(10.0, 0.0), (14.0, 4.0), (10.0, 4.0), (10.0, 3.0), (11.0, 3.0), (10.0, 2.0)], 102: [(9.0, 1.0), (10.0, 2.0), (10.0, 3.0), (9.0, 4.0)]}
    found = sorted(round(r["area"], 6) for r in polygons.gap_polygons(frame(spark, rings), tile).collect())
    assert found == [0.5, 9.0]
    assert polygons.gap_polygons(frame(spark, {1: TRIANGLE}), tile).count() == 0
    assert polygons.gap_polygons(frame(spark, {1: None}), tile).count() == 0


def test_gaps_of_areas_far_apart(spark):
    """Free ground between them is not enumerated; a large hole in a thin ring is one gap."""
    rings = {k: square(x, y) for k, (x, y) in enumerate((x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1))}
    rings |= {20: square(9e6, -4e6), 30: [(100.0, 100.0), (400.0, 100.0), (400.0, 101.0), (100.0, 101.0)], 31: [(100.0, 399.0), (400.0, 399.0), (400.0, 400.0), (100.0, 400.0)], 32: [(100.0, 101.0), (101.0, 101.0), (101.0, 399.0), (100.0, 399.0)], 33: [(399.0, 101.0), (400.0, 101.0), (400.0, 399.0), (399.0, 399.0)]}
    assert sorted(round(r["area"], 6) for r in polygons.gap_polygons(frame(spark, rings), 1.5).collect()) == [1.0, 298.0**2]
    open_ = {k: r for k, r in rings.items() if k != 33}
    assert [round(r["area"], 6) for r in polygons.gap_polygons(frame(spark, open_), 1.5).collect()] == [1.0]


def test_empty_squares_fill_the_rest(spark):
    tiles = [(1, 1), (2, 1), (5, 6), (1, 6)]
    found = polygons.empty_squares(spark.createDataFrame(tiles, "x long, y long"), 3).collect()
    cover = [(i, j) for r in found for i in range(r["x"] << r["l"], (r["x"] + 1) << r["l"]) for j in range(r["y"] << r["l"], (r["y"] + 1) << r["l"])]
    assert sorted(cover + tiles) == [(i, j) for i in range(8) for j in range(8)]


def test_reports(spark):
    rows = [(k, f"g{k}", "r", "p", "c", f"b{k}", wkb.dump([[r]])) for k, r in {1: TRIANGLE, 2: square(1.5, 1.5), 3: square(1.4, 1.4, 0.4)}.items()]
    areas = spark.createDataFrame(rows, "id long, geocode string, region string, province string, city_mun string, barangay string, geom binary")
    points = spark.createDataFrame([(1, 1.6, 1.6), (2, 1.9, 1.9)], "pid long, x double, y double")
    got = {(r["id1"], r["id2"]): r for r in boundary.polygon_overlap_report(areas, points, 1.0).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)}
    assert got[1, 2]["mbi_area"] == 0.5 and got[1, 2]["count_involved_areas"] == 3 and got[1, 2]["num_bldg_pts"] == 2
    assert got[1, 2]["height"] * got[1, 2]["width"] == pytest.approx(1.0) and got[1, 2]["mbi_level"] == "4_Inter-Barangay"
    ring = [(k, f"g{k}", "r", "p", "c", "b", wkb.dump([[square(x, y)]])) for k, (x, y) in enumerate((x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1))]
    hole = boundary.gap_report(spark.createDataFrame(ring, areas.schema), points, 2.0).collect()
    assert [(r["mbi_area"], r["count_involved_areas"], r["num_bldg_pts"], r["mbi_level"]) for r in hole] == [(1.0, 8, 2, "5_Within-Barangay")]


def test_joins_of_triangles(spark):
    left = frame(spark, {1: TRIANGLE, 2: square(20, 20), 3: None})
    right = frame(spark, {10: square(3, 3), 11: square(1.5, 1.5), 12: square(1.5, 1.5), 13: square(2, 2), 14: None}).withColumnRenamed("id", "other")
    assert [tuple(r) for r in polygons.best_overlap(left, right, 2.0, "id", "other").collect()] == [(1, 11, 0.5)]
    assert {r["id"] for r in polygons.semi_join(left, right, 2.0, "id").collect()} == {1}
    assert {r["id"] for r in polygons.semi_join(left, right.where("other = 10"), 2.0, "id").collect()} == set()
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.5, 2.5), (3, 2.0, 2.0), (3, 2.0, 2.0)], "pid long, x double, y double")
    assert {tuple(r) for r in polygons.count_points(left, points, 2.0).select("id", "num_bldg_pts").collect()} == {(1, 3), (2, 0), (3, 0)}
    own = frame(spark, {k: r for k, r in enumerate([TRIANGLE, square(2, 2), square(3, 3), square(2, 2)])}).selectExpr("id", "geom", "if(id = 3, 'b', 'a') AS parent")
    assert {(r[0], r[1]) for r in polygons.adjacency(own, 2.0, "id", "parent").collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_classes_by_issues_and_flags(spark):
    from cadastra.plans import enumeration

    rows = [(1, 50.0, None, None, square(0, 0)), (2, 50.0, None, "for merging", square(1, 0)), (3, 300.0, None, "for_merging", square(9, 9)), (4, None, " For Delineation", None, square(20, 20)), (5, None, None, None, None), (6, 10.0, None, None, square(30, 30))]
    eas = spark.createDataFrame([(i, n, d, m, wkb.dump([[r]]) if r else None) for i, n, d, m, r in rows], "ea_id long, hhcount double, eadel_indi string, merge_indi string, geom binary")
    issues = frame(spark, {1: square(-1, 0), 2: None})
    got = {r["ea_id"]: (r["class"], r["ratio"]) for r in enumeration.classified(eas, issues, 2.0).collect()}
    assert got == {1: ("delineate", 6.0), 2: ("merge", 6.0), 3: ("delineate", 1.0), 4: ("delineate", 1.0), 5: ("merge", 1.0), 6: ("merge", 30.0)}
    flagged = {r["ea_id"]: r["class"] for r in enumeration.classified(eas, issues.limit(0), 2.0, merge="merge_indi").collect()}
    assert flagged == {1: "none", 2: "merge", 3: "delineate", 4: "delineate", 5: "none", 6: "none"}
