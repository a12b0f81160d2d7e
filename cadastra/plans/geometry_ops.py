"""Whole-layer geometry operators on WKB columns: dissolve, gaps, checks, repair and
recovery.  Work is grouped by a key (an area code or a connected neighbourhood), one
arrangement per group; groups are small by nature (the polygons of one area)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.geometry import arrangement as arr
from cadastra.geometry import wkb
from cadastra.operators.polygons import by_group, dealt


def area_of(c: Column | str) -> Column:
    return wkb.geometry_udf(arr.area, "double")(c)


def valid_of(c: Column | str) -> Column:
    return wkb.geometry_udf(arr.is_valid, "boolean")(c)


def make_valid_of(c: Column | str) -> Column:
    return wkb.geometry_udf(arr.make_valid)(c)


def intersection_of(a: Column | str, b: Column | str) -> Column:
    return wkb.geometry_udf(arr.intersection)(a, b)


def difference_of(a: Column | str, b: Column | str) -> Column:
    return wkb.geometry_udf(lambda x, y: arr.difference(x, y))(a, b)


def union_of(a: Column | str, b: Column | str) -> Column:
    return wkb.geometry_udf(lambda x, y: arr.union([x, y]))(a, b)


def buffer_of(c: Column | str, distance: float, quadrant: int = 8) -> Column:
    """What lies within ``distance`` of an area, or for a negative one of it only that
    deep inside; ``quadrant`` steps make a right angle of round corners."""
    return wkb.geometry_udf(lambda g: arr.buffer(g, distance, quadrant))(c)


def largest_part_of(c: Column | str) -> Column:
    """The largest polygon of a multi-part geometry; ties: the first."""
    return wkb.geometry_udf(lambda g: [max(g, key=lambda p: arr.area([p]))] if g else g)(c)


def single_parts(df: DataFrame, geom: str = "geom") -> DataFrame:
    """A row per polygon of each geometry, numbered in ``part`` from 0, with the row's
    attributes; rows without a polygon are left out."""
    @F.pandas_udf("array<binary>")
    def split(shapes: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else [wkb.dump([p]) for p in wkb.parse(g)] for g in shapes])

    return df.select(*[c for c in df.columns if c != geom], F.posexplode(split(geom)).alias("part", geom))


def without_slivers(df: DataFrame, key: str, geom: str = "geom", share: float = 1e-4) -> DataFrame:
    """``(key, geom)``: the parts of all rows of a key, without those smaller than
    ``share`` of its largest, united to one row.  Null keys are left out."""
    parts = single_parts(dealt(df.where(F.col(key).isNotNull()).select(key, geom)), geom).withColumn("_size", area_of(geom))
    least = share * F.max("_size").over(Window.partitionBy(key))
    return dissolve(parts.withColumn("_least", least).where("_size >= _least"), key, geom)


def dissolve(df: DataFrame, key: str, geom: str = "geom", parts: int = 8) -> DataFrame:
    """Union per key in two levels: ``parts`` partial unions of a key, then theirs."""
    salted = df.where(F.col(geom).isNotNull()).select(key, F.col(geom).alias("geom"), F.pmod(F.xxhash64(geom), F.lit(parts)).alias("s"))

    def merge(k: tuple, own: list[tuple]) -> list[tuple]:
        return [(k[0], own[0].geom if len(k) > 1 and len(own) == 1 else wkb.dump(arr.union([wkb.parse(r.geom) for r in own])))]

    schema = f"{key} {df.schema[key].dataType.simpleString()}, geom binary"
    return by_group(by_group(salted, [key, "s"], merge, schema), [key], merge, schema)


def gap_finder(df: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """``(key, part, area, geom)``: holes enclosed by the union of a key's polygons."""
    whole = dissolve(df, key, geom)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, g in zip(pdf[key], pdf["geom"]):
                union = wkb.parse(g)
                for i, gap in enumerate(arr.difference([[p[0]] for p in union], union)):
                    rows.append((k, i, arr.area([gap]), wkb.dump([gap])))
            yield pd.DataFrame(rows, columns=[key, "part", "area", "geom"])

    return whole.mapInPandas(run, f"{key} {kind}, part int, area double, geom binary")


def check_layer(df: DataFrame, fid: str = "fid", geom: str = "geom", layer_type: str = "Polygon") -> DataFrame:
    """``(fid, issue)``: null or empty, self-intersection, wrong type and exact
    duplicates (one record on the earlier of each pair's first).  Null rows get no
    further checks."""
    rows = df.select(F.col(fid).alias("fid"), F.col(geom).alias("geom"))
    empty = F.col("geom").isNull() | (F.octet_length("geom") <= 9)
    kinds = {"01": "Point", "02": "LineString", "03": "Polygon", "04": "Point", "05": "LineString", "06": "Polygon"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.substring(F.hex(F.substring("geom", 2, 1)), 1, 2))
    sound = rows.where(~empty)
    wrong = sound.where(F.coalesce(kind != layer_type, F.lit(True))).select("fid", F.lit("wrong_type").alias("issue"))
    # not repeatable, so that the test is not taken before the rows are dealt
    valid = wkb.geometry_udf(arr.is_valid, "boolean").asNondeterministic()
    bad = dealt(sound.where(kind == layer_type)).where(~valid("geom")).select("fid", F.lit("self_intersection").alias("issue"))
    same = sound.groupBy(F.sha2("geom", 256).alias("h")).agg(F.min("fid").alias("fid"), F.count("*").alias("n")).where("n > 1").select("fid", F.lit("duplicate").alias("issue"))
    return rows.where(empty).select("fid", F.lit("null").alias("issue")).union(wrong).union(bad).union(same)


def finalize(g: arr.Geometry) -> arr.Geometry:
    """Valid polygons without degenerate rings."""
    out = arr.make_valid(g) if g else []
    return [p for p in out if abs(arr.ring_area(p[0])) > 0]


def unspike(g: arr.Geometry) -> arr.Geometry:
    """Coarser and coarser clean-up (share of the bounding box) until valid."""
    if not g:
        return g
    x0, y0, x1, y1 = arr.bounds(g)
    diagonal = math.hypot(x1 - x0, y1 - y0)
    for step in (1e-12, 1e-10, 1e-8, 1e-7, 1e-6):
        tol = diagonal * step
        rings = [[_dedup(r, tol) for r in p] for p in g]
        rings = [[[(round(x / tol) * tol, round(y / tol) * tol) for x, y in r] for r in p if len(r) > 2] for p in rings]
        tried = [[arr.simplify(r, tol) for r in p] for p in rings if p]
        if tried and arr.is_valid(tried):
            return tried
    return finalize(g)


def _dedup(ring: arr.Ring, tol: float) -> arr.Ring:
    out = [p for i, p in enumerate(ring) if i == 0 or math.dist(p, ring[i - 1]) > tol]
    return out[:-1] if len(out) > 1 and math.dist(out[0], out[-1]) <= tol else out


def repair(df: DataFrame, key: str, fid: str = "fid", geom: str = "geom", selected: Column | None = None) -> DataFrame:
    """``(key, fid, geom, repaired)``: selected rows (default: invalid ones) become the
    faces of the group's borders inside their own cleaned shape, else that shape;
    other rows pass through untouched."""
    pick = selected if selected is not None else F.col(geom).isNotNull() & ~F.coalesce(valid_of(geom), F.lit(True))
    rows = df.select(F.col(key).alias("k"), F.col(fid).alias("fid"), F.col(geom).alias("geom"), pick.alias("pick"))
    kinds = [df.schema[key].dataType.simpleString(), df.schema[fid].dataType.simpleString()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shapes = [wkb.parse(g) for g in pdf["geom"]]
        chosen = [g for g, p in zip(shapes, pdf["pick"]) if p and g]
        faces = [f for f in arr.polygonize(chosen)] if chosen else []
        out = []
        for k, i, raw, g, p in zip(pdf["k"], pdf["fid"], pdf["geom"], shapes, pdf["pick"]):
            if not p or not g:
                out.append((k, i, raw, False))
                continue
            own = finalize(g)
            inside = [f for f in faces if own and arr.contains(own, np.array([_inner(f)]))[0]]
            done = finalize(arr.intersection(arr.union(inside), own)) if inside else own
            out.append((k, i, wkb.dump(done if arr.is_valid(done) else unspike(own) or g), True))
        return pd.DataFrame(out, columns=["k", "fid", "geom", "repaired"])

    return dealt(rows, "k").groupBy("k").applyInPandas(run, f"k {kinds[0]}, fid {kinds[1]}, geom binary, repaired boolean").withColumnRenamed("k", key)


def _inner(face: arr.Geometry) -> arr.Point:
    """A point inside a face: beside the middle of its longest edge."""
    ring = face[0][0]
    (ax, ay), (bx, by) = max(zip(ring, ring[1:] + ring[:1]), key=lambda e: math.dist(*e))
    size = math.dist((ax, ay), (bx, by))
    step = min(1e-6 * size, abs(arr.ring_area(ring)) / size * 0.01)
    return (ax + bx) / 2 - (by - ay) / size * step, (ay + by) / 2 + (bx - ax) / size * step


def recover_null(df: DataFrame, key: str, fid: str = "fid", geom: str = "geom", covered: float = 0.01) -> DataFrame:
    """``(key, fid, geom, recovered)``: a group's only row without geometry gets the
    uncovered face of the others' borders, the largest if there are several."""
    rows = df.select(F.col(key).alias("k"), F.col(fid).alias("fid"), F.col(geom).alias("geom"))
    kinds = [df.schema[key].dataType.simpleString(), df.schema[fid].dataType.simpleString()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shapes = [wkb.parse(g) for g in pdf["geom"]]
        missing = [i for i, g in enumerate(shapes) if not g]
        out = [(k, i, g, False) for k, i, g in zip(pdf["k"], pdf["fid"], pdf["geom"])]
        if len(missing) == 1 and len(shapes) > 1:
            have = [g for g in shapes if g]
            free = []
            for face in arr.polygonize(have):
                size = arr.area(face)
                if size > 0 and sum(arr.area(arr.intersection(face, g)) for g in have) / size < covered:
                    free.append((size, face))
            if free:
                at = missing[0]
                out[at] = (*out[at][:2], wkb.dump(max(free, key=lambda f: f[0])[1]), True)
        return pd.DataFrame(out, columns=["k", "fid", "geom", "recovered"])

    return dealt(rows, "k").groupBy("k").applyInPandas(run, f"k {kinds[0]}, fid {kinds[1]}, geom binary, recovered boolean").withColumnRenamed("k", key)


def fill_gaps(polygons: list[arr.Geometry], target: int, extent: arr.Geometry) -> tuple[arr.Geometry, arr.Geometry]:
    """``(result, filled)``: enclosed gaps inside the extent that touch the target are
    added to it; parts at the extent's border are open and stay."""
    taken = arr.union([g for g in polygons if g])
    rest = arr.difference(extent, taken) if taken else extent
    border = arr.segments(extent)
    filled: list[arr.Geometry] = []
    for part in rest:
        gap = [part]
        if _touches_border(gap, border) or arr.shared_boundary(gap, polygons[target]) <= 0:
            continue
        filled.append(arr.difference(gap, polygons[target], *[g for i, g in enumerate(polygons) if i != target and g]))
    gained = arr.union(filled) if filled else []
    result = arr.union([polygons[target], gained]) if gained else polygons[target]
    return result, gained


def _touches_border(g: arr.Geometry, border: np.ndarray) -> bool:
    pts = np.array([p for poly in g for r in poly for p in r])
    s, d = border[:, :2], border[:, 2:] - border[:, :2]
    size = np.maximum((d * d).sum(axis=1), 1e-300)
    for p in pts:
        t = np.clip(((p - s) * d).sum(axis=1) / size, 0, 1)
        if (np.hypot(*(s + d * t[:, None] - p).T) <= 1e-9 * (1 + np.abs(p).max())).any():
            return True
    return False


def gap_fill(df: DataFrame, key: str, fid: str, geom: str, target: Column, extent: Column) -> DataFrame:
    """Per group the rows ``(key, role, fid, area, geom)`` with roles ``original``,
    ``result`` and, where anything was filled, ``gap_fill``; of several targets of a group
    that of the least ``fid`` is filled."""
    rows = df.select(F.col(key).alias("k"), F.col(fid).alias("fid"), F.col(geom).alias("geom"), target.alias("target"), extent.alias("extent"))
    kinds = [df.schema[key].dataType.simpleString(), df.schema[fid].dataType.simpleString()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fid")
        shapes = [wkb.parse(g) for g in pdf["geom"]]
        at = next((i for i, t in enumerate(pdf["target"]) if t and shapes[i]), None)
        out = []
        if at is not None:
            result, gained = fill_gaps(shapes, at, wkb.parse(pdf["extent"].iloc[at]))
            roles = [("original", shapes[at]), ("result", result)] + ([("gap_fill", gained)] if gained else [])
            out = [(pdf["k"].iloc[0], role, pdf["fid"].iloc[at], arr.area(g), wkb.dump(g)) for role, g in roles]
        return pd.DataFrame(out, columns=["k", "role", "fid", "area", "geom"])

    return dealt(rows, "k").groupBy("k").applyInPandas(run, f"k {kinds[0]}, role string, fid {kinds[1]}, area double, geom binary").withColumnRenamed("k", key)
