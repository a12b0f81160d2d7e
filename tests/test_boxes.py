"""Joins of boxes of very different sizes against brute force."""

import random

from cadastra.geometry import wkb
from cadastra.operators import polygons, spatial

BOXES = "k long, g string, x0 double, y0 double, x1 double, y1 double"


def boxes(n, seed):
    """Sides from zero to the whole extent, corners on a grid so that many just touch."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        side = r.choice((0, 0.25, 1, 1, 2, 7, 40, 300))
        x, y = r.randrange(-80, 80) / 2, r.randrange(-80, 80) / 2
        out.append((i, r.choice("ab"), x, y, x + side, y + side * r.choice((0, 0.5, 1))))
    return out


def met(a, b, closed=True, within=0.0, on=False):
    def hit(p, q):
        lo = [max(p[2] - within, q[2]), max(p[3] - within, q[3])]
        hi = [min(p[4] + within, q[4]), min(p[5] + within, q[5])]
        return all(u <= v for u, v in zip(lo, hi)) if closed else all(u < v for u, v in zip(lo, hi))

    return sorted((p[0], q[0]) for p in a for q in b if hit(p, q) and (not on or p[1] == q[1]))


def pairs(df):
    return sorted(map(tuple, df.select("a.k", "b.k").collect()))


def test_scaled_join_is_complete_and_finds_no_pair_twice(spark):
    a, b = boxes(120, 1), boxes(90, 2)
    left, right = spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES)
    for size in (0.3, 4.0, 1000.0):
        assert pairs(spatial.scaled_box_join(left, right, size)) == met(a, b)
    assert pairs(spatial.scaled_box_join(left, right, 1.0, closed=False)) == met(a, b, closed=False)
    assert pairs(spatial.scaled_box_join(left, right, 1.0, on=["g"], within=0.75)) == met(a, b, within=0.75, on=True)
    assert pairs(spatial.scaled_box_join(left, right, 1.0)) == pairs(spatial.box_join(left, right, 1.0))


def test_scaled_join_of_points_nulls_and_nothing(spark):
    points = spark.createDataFrame([(1, "a", 0.5, 0.5), (1, "a", 0.5, 0.5), (2, None, None, 1.0)], "k long, _own string, x double, y double")
    b = [(7, "a", 0.0, 0.0, 500.0, 500.0), (8, "a", 0.5, 0.5, 0.5, 0.5), (9, None, None, None, None, None)]
    right = spark.createDataFrame(b, BOXES)
    assert pairs(spatial.scaled_box_join(points.drop("_own"), right, 1.0)) == [(1, 7), (1, 7), (1, 8), (1, 8)]
    assert pairs(spatial.scaled_box_join(right.limit(0), right, 1.0)) == [] == pairs(spatial.scaled_box_join(right, right.limit(0), 1.0))


def test_one_region_sized_box_takes_a_few_cells(spark):
    wide = spark.createDataFrame([(1, "a", 0.0, 0.0, 1e6, 1e6)], BOXES).withColumn("_own", spatial.box_level(1.0))
    small = spark.createDataFrame(boxes(50, 3), BOXES).withColumn("_own", spatial.box_level(1.0))
    grids = small.agg({"_own": "collect_set"}).scalar()
    assert spatial.levelled_cells(wide, 1.0, grids).count() <= 9
    large = wide.agg({"_own": "collect_set"}).scalar()
    assert spatial.levelled_cells(small, 1.0, large).count() <= 50 * 2 * 9


def test_polygons_of_all_sizes_meet(spark):
    def square(x, y, s):
        return wkb.dump([[[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]])

    rows = [(i, square(i, 0, 1)) for i in range(6)] + [(100, square(-50, -50, 200)), (101, None)]
    layer = spark.createDataFrame(rows, "k long, geom binary")
    plain, scaled = (sorted(map(tuple, polygons.polygon_join(layer, layer, 1.0, scaled=s).select("a.k", "b.k").collect())) for s in (False, True))
    assert plain == scaled and (100, 3) in scaled and (3, 4) in scaled and (3, 5) not in scaled
