"""Enumeration-area engine: split over-populated areas, merge small ones, number the new.

Areas of one parent are one group and are worked on in the order of their ids, so the
result does not depend on partitions.  An area is a dict with geometry, households,
buildings ``(x, y, households, value)`` and its code."""

from __future__ import annotations

import functools
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.geometry import arrangement as arr
from cadastra.geometry import wkb
from cadastra.functions import codes, rules
from cadastra.operators import polygons, topology
from cadastra.operators.polygons import by_group, dealt
from cadastra.operators.spatial import cut_lineage

MIN_HOUSEHOLDS, MAX_HOUSEHOLDS = 100, 300
MERGE_PASSES = 5
SPLIT_ROUNDS = 5
KMEANS_ROUNDS = 30
#: Places whose nearest neighbour is further than so many medians are isolated.
OUTLIER_FACTOR, OUTLIER_PLACES = 3.0, 6
#: Room and share of the extent around shapes that cells of points reach into.
AROUND = 0.02, 0.25


def classified(eas: DataFrame, issues: DataFrame, cell: float, key: str = "ea_id", merge: str | None = None) -> DataFrame:
    """``eas`` with ``class`` (``delineate``, ``merge``, ``none``) and ``ratio``, the limit
    by the households.  Areas that meet a shape of ``issues(geom)``, gaps or overlaps, are
    to be delineated whatever their count; ``merge`` names a column that then decides
    alone on merging.  Null counts are zero; null shapes meet nothing."""
    hit = polygons.semi_join(eas.select(key, "geom"), issues.select("geom"), cell, key).select(key, F.lit(True).alias("_issue"))
    flag = F.col(merge) if merge else None
    found = eas.join(hit, key, "left").withColumn("class", rules.ea_class(F.col("hhcount"), F.col("eadel_indi"), flag, F.col("_issue").isNotNull()))
    return found.withColumn("ratio", F.when(F.coalesce("hhcount", F.lit(0)) > 0, MAX_HOUSEHOLDS / F.col("hhcount")).otherwise(1.0)).drop("_issue")


def greedy_groups(points: list[tuple[float, float, float]], limit: float, barriers: np.ndarray | None = None) -> list[list[int]]:
    """Grow groups from the first free point by the free point nearest to any member;
    a group ends where the way to that point crosses a barrier or its value would
    bring the group to ``limit``."""
    free = list(range(len(points)))
    xy = np.array([p[:2] for p in points], dtype=float).reshape(-1, 2)
    groups = []
    while free:
        group = [free.pop(0)]
        total = points[group[0]][2]
        gap = np.hypot(*(xy - xy[group[0]]).T)
        source = np.full(len(points), group[0])
        while free:
            near = min(free, key=lambda i: (gap[i], i))
            if barriers is not None and _crosses(xy[source[near]], xy[near], barriers):
                break
            if total + points[near][2] >= limit:
                break
            group.append(near)
            free.remove(near)
            total += points[near][2]
            d = np.hypot(*(xy - xy[near]).T)
            source = np.where(d < gap, near, source)
            gap = np.minimum(gap, d)
        groups.append(group)
    return groups


def _crosses(p: np.ndarray, q: np.ndarray, barriers: np.ndarray) -> bool:
    a, b = barriers[:, :2], barriers[:, 2:]

    def side(o, u, v):
        return (u[..., 0] - o[..., 0]) * (v[..., 1] - o[..., 1]) - (u[..., 1] - o[..., 1]) * (v[..., 0] - o[..., 0])

    return bool(((side(p[None], q[None], a) * side(p[None], q[None], b) <= 0) & (side(a, b, p[None]) * side(a, b, q[None]) <= 0)).any())


def weighted_kmeans(points: np.ndarray, weights: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Labels of weighted Lloyd rounds; the first centre is the point nearest to the
    weighted mean, others are drawn by distance and weight."""
    rng = random.Random(seed)
    n = len(points)
    k = min(k, n)
    mean = (points * weights[:, None]).sum(axis=0) / max(weights.sum(), 1e-300)
    centres = [points[int(((points - mean) ** 2).sum(axis=1).argmin())]]
    while len(centres) < k:
        d = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0) * weights
        total = float(d.sum())
        pick = rng.random() * total
        at = int(np.searchsorted(np.cumsum(d), pick)) if total > 0 else rng.randrange(n)
        centres.append(points[min(at, n - 1)])
    centres = np.array(centres)
    labels = np.full(n, -1)
    for _ in range(KMEANS_ROUNDS):
        now = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (now == labels).all():
            break
        labels = now
        for c in range(k):
            own = labels == c
            centres[c] = (points[own] * weights[own, None]).sum(axis=0) / weights[own].sum() if own.any() and weights[own].sum() > 0 else points[rng.randrange(n)]
    return labels


def isolated(points: np.ndarray) -> np.ndarray:
    """Which points lie at places too far from any other to count for the clusters; none
    if less than two places would be left."""
    places, at = np.unique(points, axis=0, return_inverse=True)
    if len(places) < OUTLIER_PLACES:
        return np.zeros(len(points), dtype=bool)
    near = np.array([np.partition(np.hypot(*(places - p).T), 1)[1] for p in places])
    far = near > OUTLIER_FACTOR * np.sort(near)[len(near) // 2]
    return far[at.ravel()] if (~far).sum() >= 2 else np.zeros(len(points), dtype=bool)


def clusters(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Labels of weighted clusters of the points that are not isolated; isolated ones go
    to the nearest centre."""
    alone = isolated(points)
    core, own = points[~alone], weights[~alone]
    found = weighted_kmeans(core, own, k)
    labels = np.empty(len(points), dtype=int)
    labels[~alone] = found
    if alone.any():
        names = np.unique(found)
        centres = np.array([np.average(core[found == c], axis=0, weights=own[found == c] if own[found == c].sum() > 0 else None) for c in names])
        labels[alone] = names[((points[alone][:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)]
    return labels


def _part(parent: dict, geom: arr.Geometry, how: str) -> dict:
    inside = arr.contains(geom, np.array([b[:2] for b in parent["buildings"]]).reshape(-1, 2)) if parent["buildings"] else []
    own = [b for b, hit in zip(parent["buildings"], inside) if hit and id(b) not in parent.setdefault("_taken", set())]
    parent["_taken"].update(map(id, own))
    return {**{k: v for k, v in parent.items() if k != "_taken"}, "geom": geom, "buildings": own, "hh": sum(b[2] for b in own), "split_by": how, "from_split": True}


def cells_to_parts(ea: dict, groups: list[list[int]], how: str) -> list[dict]:
    """Voronoi cells of each group joined and cut to the area."""
    points = [(b[0], b[1]) for b in ea["buildings"]]
    x0, y0, x1, y1 = arr.bounds(ea["geom"])
    pad = max(0.01, max(x1 - x0, y1 - y0) * 0.2)
    unique = sorted(set(points))
    cell = dict(zip(unique, arr.voronoi(unique, (x0 - pad, y0 - pad, x1 + pad, y1 + pad))))
    ea["_taken"] = set()
    parts, used = [], set()
    for group in groups:
        own = [cell[points[i]] for i in group if points[i] not in used]
        used |= {points[i] for i in group}
        whole = arr.intersection(ea["geom"], arr.union([[[r]] for r in own if len(r) > 2])) if own else []
        parts += [_part(ea, [polygon], how) for polygon in whole]
    return _covering(ea, parts)


def _covering(ea: dict, parts: list[dict]) -> list[dict]:
    """Parts with the ground and the buildings of the area that none of them has."""
    missing = arr.area(ea["geom"]) - sum(arr.area(p["geom"]) for p in parts)
    if parts and missing > 1e-9 * arr.area(ea["geom"]):
        for p, geom in zip(parts, topology.allocated([p["geom"] for p in parts], ea["geom"])):
            if geom is not p["geom"]:
                more = _part(ea, geom, p["split_by"])["buildings"]  # those no part has taken
                p.update(geom=geom, buildings=p["buildings"] + more, hh=p["hh"] + sum(b[2] for b in more))
    return parts


def strips(ea: dict, n: int) -> list[dict]:
    """Equal slices across the longer side of the bounding box."""
    x0, y0, x1, y1 = arr.bounds(ea["geom"])
    ea["_taken"] = set()
    out = []
    for i in range(n):
        if x1 - x0 >= y1 - y0:
            a, b = x0 + (x1 - x0) * i / n, x0 + (x1 - x0) * (i + 1) / n
            box = [(a, y0), (b, y0), (b, y1), (a, y1)]
        else:
            a, b = y0 + (y1 - y0) * i / n, y0 + (y1 - y0) * (i + 1) / n
            box = [(x0, a), (x1, a), (x1, b), (x0, b)]
        cut = arr.intersection(ea["geom"], [[box]])
        if cut:
            out.append(_part(ea, cut, "strips"))
    return _covering(ea, out)


def merge_into(parts: list[dict], at: int, to: int) -> None:
    """Join part ``at`` to part ``to``."""
    a, b = parts[at], parts[to]
    b["geom"] = arr.union([b["geom"], a["geom"]])
    b["buildings"] = b["buildings"] + a["buildings"]
    b["hh"] += a["hh"]
    del parts[at]


def _best_sibling(parts: list[dict], at: int, high: float | None) -> int | None:
    """Longest common border, else the nearest centre (within ``high`` if possible)."""
    others = [j for j in range(len(parts)) if j != at]
    if len(others) < 2:  # no choice
        return others[0] if others else None
    lengths = {j: arr.shared_boundary(parts[at]["geom"], parts[j]["geom"]) for j in others}
    touching = [j for j in others if lengths[j] >= 0]
    if touching:
        return max(touching, key=lambda j: (lengths[j], -j))
    c = arr.centroid(parts[at]["geom"])
    near = sorted(others, key=lambda j: (math.dist(c, arr.centroid(parts[j]["geom"])), j))
    within = [j for j in near if high is None or parts[at]["hh"] + parts[j]["hh"] <= high]
    return (within or near or [None])[0]


def enforce_minimum(parts: list[dict], low: float = MIN_HOUSEHOLDS, high: float = MAX_HOUSEHOLDS, keep_two: bool = False) -> list[dict]:
    """Smallest parts of at most ``low`` households join a sibling until none is left."""
    while len(parts) > 1 and not (keep_two and len(parts) == 2):
        small = [i for i, p in enumerate(parts) if p["hh"] <= low]
        if not small:
            break
        at = min(small, key=lambda i: (parts[i]["hh"], i))
        to = _best_sibling(parts, at, high)
        if to is None:
            break
        merge_into(parts, at, to)
    return parts


def enforce_value(parts: list[dict], limit: float) -> list[dict]:
    """While a part's summed building value reaches ``limit``, it joins a sibling."""
    while len(parts) > 1:
        value = [sum(b[3] for b in p["buildings"]) for p in parts]
        at = max(range(len(parts)), key=lambda i: (value[i], -i))
        if value[at] < limit:
            break
        to = _best_sibling(parts, at, None)
        if to is None:
            break
        merge_into(parts, at, to)
    return parts


def value_checked(ea: dict, parts: list[dict], low: float = MIN_HOUSEHOLDS, high: float = MAX_HOUSEHOLDS) -> list[dict]:
    """Parts of a split after the check that the value of each stays below the area's
    ``limit`` (none: no check), where it has no such key below ``high`` by its households."""
    limit = ea["limit"] if "limit" in ea else high / ea["hh"] if ea["hh"] else 1.0
    if len(parts) < 2 or limit is None or max(sum(b[3] for b in p["buildings"]) for p in parts) < limit:
        return parts
    return enforce_value(enforce_minimum(parts, low, high, ea.get("flagged", False)), limit)


def split(ea: dict, low: float = MIN_HOUSEHOLDS, high: float = MAX_HOUSEHOLDS, barriers: np.ndarray | None = None) -> list[dict]:
    """Point groups first, then weighted clusters, then strips; the area itself if no
    way gives two parts."""
    points = [(b[0], b[1], b[3]) for b in ea["buildings"]]
    ratio = high / ea["hh"] if ea["hh"] else 1.0
    if len({p[:2] for p in points}) >= 2:
        groups = greedy_groups(points, ratio, barriers)
        if len(groups) >= 2:
            parts = enforce_minimum(_kept(ea, cells_to_parts(ea, groups, "point_based")), low, high, ea.get("flagged", False))
            if len(parts) >= 2:
                return parts
        k = max(2, round(ea["hh"] / high))
        xy = np.array([p[:2] for p in points])
        labels = clusters(xy, np.array([b[2] for b in ea["buildings"]], dtype=float), k)
        groups = [list(np.flatnonzero(labels == c)) for c in sorted(set(labels))]
        parts = enforce_minimum(_kept(ea, cells_to_parts(ea, groups, "kmeans")), low, high, ea.get("flagged", False))
        if len(parts) >= 2:
            return parts
    return split_strips(ea, low, high)


def split_strips(ea: dict, low: float = MIN_HOUSEHOLDS, high: float = MAX_HOUSEHOLDS) -> list[dict]:
    """The first number of strips that gives two parts, all within ``high`` if one does;
    parts above it are cut to strips again until they give no two parts."""
    if len({b[:2] for b in ea["buildings"]}) < 2:
        return [ea]  # parts without buildings join a sibling, so one place stays one part
    base, best = max(2, math.ceil(ea["hh"] / high)), None
    for n in range(base, base + 5):
        parts = enforce_minimum(_kept(ea, strips(ea, n)), low, high, ea.get("flagged", False))
        if len(parts) >= 2:
            if all(p["hh"] <= high for p in parts):
                return parts
            best = best or parts
    if best is None:
        return [ea]
    return [q for p in best for q in (split_strips(p, low, high) if p["hh"] > high else [p])]


def _kept(ea: dict, parts: list[dict]) -> list[dict]:
    """Parts without buildings join a sibling, so no ground of the area is lost."""
    while len(parts) > 1:
        at = next((i for i, p in enumerate(parts) if not p["buildings"]), None)
        if at is None:
            break
        merge_into(parts, at, _best_sibling(parts, at, None))
    return parts


def merge_small(areas: list[dict], low: float = MIN_HOUSEHOLDS, high: float = MAX_HOUSEHOLDS) -> list[dict]:
    """Up to ``MERGE_PASSES`` passes: areas without households join the touching
    neighbour with the fewest, small areas one that brings them nearest to ``high - 1``
    without passing ``high``, first of those that were not split."""
    for _ in range(MERGE_PASSES):
        changed = False
        box = {id(a): arr.bounds(a["geom"]) for a in areas if a["geom"]}  # of shapes that are held by this pass

        def touching(ea: dict, others: list[dict]) -> list[dict]:
            own = box.get(id(ea))
            met = [n for n in others if own and (b := box.get(id(n))) and not arr.boxes_apart(own, b)]
            return [n for n in met if arr.shared_boundary(ea["geom"], n["geom"]) >= 0]

        for ea in sorted(areas, key=lambda e: e["id"]):
            if not any(a is ea for a in areas) or ea.get("candidate") or (ea.get("from_split") and ea["hh"] >= low):
                continue
            empty, small = ea["hh"] == 0, ea["hh"] <= low
            if not small:
                continue
            others = [n for n in areas if n is not ea and not n.get("candidate")]
            if empty:
                choice = min(touching(ea, others), key=lambda n: (n["hh"], n["id"]), default=None)
            else:
                fit = touching(ea, [n for n in others if n["hh"] > low and ea["hh"] + n["hh"] <= high])
                pool = [n for n in fit if not n.get("from_split")] or fit
                choice = min(pool, key=lambda n: (abs(ea["hh"] + n["hh"] - (high - 1)), n["id"]), default=None)
            if choice is None:
                continue
            big, other = (ea, choice) if ea["hh"] >= choice["hh"] else (choice, ea)
            joined = {**big, "geom": arr.union([ea["geom"], choice["geom"]]), "buildings": ea["buildings"] + choice["buildings"], "hh": ea["hh"] + choice["hh"], "from_merge": True}
            box[id(joined)] = arr.bounds(joined["geom"])
            areas = [a for a in areas if a is not ea and a is not choice] + [joined]
            changed = True
        if not changed:
            break
    return areas


def number(areas: list[dict], base: int) -> list[dict]:
    """The largest part of a split keeps its code (unless that starts with 000), other
    new parts take running numbers after ``base``."""
    order = sorted(areas, key=lambda e: (*arr.centroid(e["geom"]), e["id"])) if any(a.get("from_split") for a in areas) else sorted(areas, key=lambda e: (e["id"], arr.centroid(e["geom"])[0]))
    largest: dict[int, int] = {}
    for i, a in enumerate(order):
        if a.get("from_split") and (a["id"] not in largest or a["hh"] > order[largest[a["id"]]]["hh"]):
            largest[a["id"]] = i
    seq = base
    for i, a in enumerate(order):
        code = a["ean"]
        if a.get("from_split") and (largest.get(a["id"]) != i or code.startswith("000")):
            seq += 1
            code = f"{seq:03d}000" if code.startswith("000") else f"{code[:3]}{seq:03d}"
        a["new_ea"] = code
    return order


RESULT = "parent string, ea_id long, ean string, new_ea string, hh double, bldg_count int, split_by string, sink string, geom binary"


def delineate(eas: DataFrame, buildings: DataFrame, low: float = MIN_HOUSEHOLDS, high: float = MAX_HOUSEHOLDS, barriers: DataFrame | None = None) -> DataFrame:
    """The engine per parent.  ``eas``: ea_id, ean, parent, hhcount, flagged, geom (WKB);
    ``buildings``: ea_id, parent, x, y, hh, value (share of the area's total);
    ``barriers``: parent, x0, y0, x1, y1, segments of roads and rivers that groups of
    points do not cross.

    A failing group fails the job; nothing is dropped."""
    def run(key: tuple, left: list[tuple]) -> list[tuple]:
        shapes = [wkb.parse(r.geom) for r in left]
        ox, oy = arr.origin(shapes, *AROUND)
        done = []
        for r, shape in zip(left, shapes):
            b = [(x - ox, y - oy, hh, value) for x, y, hh, value in r.buildings or []]
            total = sum(x[2] for x in b)
            ea = {"id": int(r.ea_id), "ean": r.ean, "geom": shape and arr.shifted(shape, -ox, -oy), "buildings": b, "hh": float(total or r.hhcount or 0), "flagged": bool(r.flagged), "split_by": "none"}
            if ea["flagged"] or ea["hh"] >= high:
                walls = np.array(r.barriers, dtype=float).reshape(-1, 4) - (ox, oy, ox, oy) if r.barriers else None
                parts = value_checked(ea, split(ea, low, high, walls), low, high)
                if len(parts) > 1:
                    done += parts
                    continue
                ea["candidate"] = True
            done.append(ea)
        merged = number(merge_small(done, low, high), len(left))
        return [(
            key[0], a["id"], a["ean"], a["new_ea"], float(a["hh"]), len(a["buildings"]), a["split_by"],
            "delineated" if a.get("from_split") else "merged" if a.get("from_merge") else "retained", wkb.dump(a["geom"] and arr.shifted(a["geom"], ox, oy))) for a in merged]

    point = F.array(*[F.col(c).cast("double") for c in ("x", "y", "hh", "value")])
    inside = buildings.groupBy(F.col("parent").alias("_parent"), F.col("ea_id").alias("_ea")).agg(F.sort_array(F.collect_list(point)).alias("buildings"))
    eas = eas.select(*[c for c in ("ea_id", "ean", "parent", "hhcount", "flagged", "geom")])
    eas = eas.join(inside, F.col("parent").eqNullSafe(F.col("_parent")) & (F.col("ea_id") == F.col("_ea")), "left").drop("_parent", "_ea")
    if barriers is None:
        eas = eas.withColumn("barriers", F.lit(None).cast("array<array<double>>"))
    else:
        segment = F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])
        eas = eas.join(barriers.groupBy("parent").agg(F.collect_list(segment).alias("barriers")), "parent", "left")
    return by_group(eas, ["parent"], run, RESULT, ["ea_id"])


def split_lines(parts: list[dict]) -> list[arr.Ring]:
    """Borders between the parts of one split area, joined to lines."""
    out = []
    for i, a in enumerate(parts):
        for b in parts[:i]:
            out += arr.shared_lines(a["geom"], b["geom"])
    return arr.merge_lines(out)


LINES = "parent string, ea_id long, line int, length double, points array<array<double>>"


def split_borders(done: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """The lines along which areas were split, from the rows of ``delineate``: a row per
    joined line, numbered within its area.  A task sees the parts of one area.  With a
    snapping ``tolerance`` gaps up to four times as wide are bridged and loose ends under
    twice its length go."""
    def run(key: tuple, own: list[tuple]) -> list[tuple]:
        shapes = [wkb.parse(r.geom) for r in own]
        ox, oy = arr.origin(shapes, *AROUND)
        shapes = sorted((arr.shifted(g, -ox, -oy) for g in shapes), key=arr.centroid)
        lines = sorted(split_lines([{"geom": g} for g in shapes]))
        return [(*key, i, sum(math.dist(p, q) for p, q in zip(line, line[1:])), [[x + ox, y + oy] for x, y in line]) for i, line in enumerate(lines)]

    lines = by_group(done.where("sink = 'delineated'").select("parent", "ea_id", "geom"), ["parent", "ea_id"], run, LINES)
    if tolerance <= 0:
        return lines
    fine = topology.refine_lines(lines, ["parent", "ea_id"], 4 * tolerance, 2 * tolerance)
    return fine.withColumn("length", topology.line_length(F.col("points"))).select("parent", "ea_id", "line", "length", "points")


def imputed(eas: DataFrame, buildings: DataFrame) -> DataFrame:
    """``eas`` whose missing or zero ``hhcount`` is the households of the buildings inside
    (``buildings``: ea_id, hh; a building without a usable number counts as one); areas
    without buildings get zero."""
    inside = buildings.groupBy("ea_id").agg(F.sum(rules.building_population(F.col("hh"))).alias("_n"))
    known = F.nullif(codes.try_number(F.col("hhcount")), F.lit(0.0))
    return eas.join(inside, "ea_id", "left").withColumn("hhcount", F.coalesce(known, "_n", F.lit(0.0))).drop("_n")


PARTS = "parent string, ea_id long, ean string, part string, flagged boolean, special boolean, hh double, limit double, split_by string, from_split boolean, open boolean, buildings array<array<double>>, geom binary"


def split_rounds(eas: DataFrame, buildings: DataFrame, candidates: DataFrame | None = None, low: float = MIN_HOUSEHOLDS, high: float = MAX_HOUSEHOLDS, rounds: int = SPLIT_ROUNDS, resplit: bool = True) -> DataFrame:
    """Parts of areas that are flagged or have ``high`` households, split in rounds.

    A row is an area or a part with its buildings; ``part`` is its way down from the area
    (``2.1``: the first part of the second part), ``open`` that it is over the limit
    still.  Each round deals the open rows over all tasks and splits every one by itself,
    so no task sees a whole parent; rows that are done are not written again.  Rows that
    give no two parts are closed as they are.  ``resplit=False`` leaves parts of a split
    as the first round made them.  ``candidates``: ean, hhcount of the areas whose parts'
    building values are held below ``high / hhcount``; without it every area's are.  Of
    several rows with one number the largest count holds.  Null shapes are kept unsplit,
    null counts are zero, columns besides those named are left out."""
    names = PARTS.replace(",", "").split()[::2]
    point = F.array(*[F.col(c).cast("double") for c in ("x", "y", "hh", "value")])
    own = buildings.groupBy("ea_id").agg(F.sort_array(F.collect_list(point)).alias("buildings"), F.sum(F.col("hh").cast("double")).alias("_hh"))
    hh = F.coalesce(F.nullif("_hh", F.lit(0.0)), F.col("hhcount").cast("double"), F.lit(0.0))
    special = F.coalesce(F.col("special"), F.lit(False)) if "special" in eas.columns else F.lit(False)
    state = eas.join(own, "ea_id", "left").withColumn("hh", hh)
    if candidates is None:
        state = state.withColumn("limit", F.when(F.col("hh") > 0, high / F.col("hh")).otherwise(1.0))
    else:
        index = candidates.groupBy("ean").agg(F.max(F.col("hhcount").cast("double")).alias("_c"))
        state = state.join(index, "ean", "left").withColumn("limit", F.when(F.col("_c") > 0, high / F.col("_c")))
    flagged = F.coalesce(F.col("flagged"), F.lit(False))
    state = state.select(
        "parent", "ea_id", "ean", F.lit("").alias("part"), flagged.alias("flagged"), special.alias("special"), "hh", "limit", F.lit("none").alias("split_by"), F.lit(False).alias("from_split"),
        ((flagged | (F.col("hh") >= high)) & F.col("geom").isNotNull()).alias("open"), F.coalesce("buildings", F.array().cast("array<array<double>>")).alias("buildings"), "geom")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                shape = wkb.parse(r.geom)
                ox, oy = arr.origin([shape], *AROUND)
                ea = {**r._asdict(), "geom": arr.shifted(shape, -ox, -oy), "buildings": [(x - ox, y - oy, hh, value) for x, y, hh, value in r.buildings], "limit": None if r.limit is None or math.isnan(r.limit) else r.limit}
                parts = value_checked(ea, split(ea, low, high), low, high)
                if len(parts) < 2:
                    rows.append({**r._asdict(), "open": False})
                    continue
                order = sorted(parts, key=lambda p: (arr.centroid(p["geom"]), p["hh"]))
                for i, p in enumerate(order, 1):
                    rows.append({**p, "part": f"{r.part}.{i}".lstrip("."), "flagged": False, "from_split": True, "open": resplit and p["hh"] >= high, "geom": wkb.dump(arr.shifted(p["geom"], ox, oy)), "buildings": [[x + ox, y + oy, hh, value] for x, y, hh, value in p["buildings"]]})
            yield pd.DataFrame(rows, columns=names)

    state = cut_lineage(state)
    done, open_ = [state.where("NOT open")], state.where("open")
    for _ in range(rounds):
        state = cut_lineage(dealt(open_).mapInPandas(run, PARTS))
        done.append(state.where("NOT open"))
        open_ = state.where("open")
        if open_.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
    return functools.reduce(DataFrame.unionByName, [*done, open_])


def variant(eas: DataFrame, buildings: DataFrame, candidates: DataFrame | None = None, low: float = MIN_HOUSEHOLDS, high: float = MAX_HOUSEHOLDS, rounds: int = SPLIT_ROUNDS, resplit: bool = True) -> DataFrame:
    """The engine's variant: counts imputed from buildings, ``split_rounds``, then small
    areas merged and new ones numbered per parent.

    Special areas (boolean column ``special``, if there is one) go to the delineated
    sink; they neither merge nor are merged into unless they are small themselves.  The
    columns are those of ``delineate``; rows with null shapes come back as they are."""
    parts = split_rounds(imputed(eas, buildings), buildings, candidates, low, high, rounds, resplit)
    total = eas.groupBy("parent").agg(F.count("*").alias("base"))

    def run(key: tuple, own: list[tuple]) -> list[tuple]:
        areas, bare = [], []
        shapes = [wkb.parse(r.geom) for r in own]
        ox, oy = arr.origin(shapes, *AROUND)
        for r, shape in zip(own, shapes):
            a = {"id": int(r.ea_id), "ean": r.ean or "", "buildings": [tuple(b) for b in r.buildings], "hh": float(r.hh), "split_by": r.split_by, "from_split": bool(r.from_split), "special": bool(r.special)}
            if shape is None:
                bare.append((key[0], a["id"], r.ean, r.ean, a["hh"], len(a["buildings"]), "none", "retained", None))
                continue
            over = not a["from_split"] and (r.flagged or a["hh"] >= high)
            areas.append({**a, "geom": arr.shifted(shape, -ox, -oy), "candidate": over or (a["special"] and a["hh"] > low)})
        rows = [(
            key[0], a["id"], a["ean"], a["new_ea"], float(a["hh"]), len(a["buildings"]), a["split_by"],
            "delineated" if a["from_split"] or a["special"] else "merged" if a.get("from_merge") else "retained", wkb.dump(arr.shifted(a["geom"], ox, oy))) for a in number(merge_small(areas, low, high), int(own[0].base))]
        return rows + bare

    whole = parts.join(total, F.equal_null(parts["parent"], total["parent"])).drop(total["parent"])
    return by_group(whole, ["parent"], run, RESULT, ["ea_id", "part"])
