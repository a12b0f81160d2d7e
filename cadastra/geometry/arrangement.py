"""Planar overlay in NumPy: one arrangement serves every polygon operation.

All rings are snapped to a fine grid and cut at their common points; the pieces form a
planar graph whose cycles bound its faces.  A face is labelled with the inputs that
cover it (even-odd rule), an operation is a predicate over labels, and the outline of
the faces chosen is the result.  A geometry is a list of polygons, a polygon a list of
rings (outer first), a ring a list of points without the closing one."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

Point = tuple[float, float]
Ring = list[Point]
Polygon = list[Ring]
Geometry = list[Polygon]

SNAP = 1e-9


#: Shapes of up to so many sides are taken by plain loops, where arrays cost more.
FEW_SIDES = 96


def ring_area(ring: Ring) -> float:
    if len(ring) < 3:
        return 0.0
    if len(ring) > FEW_SIDES:
        a = np.asarray(ring, dtype=float)
        x, y = a[1:, 0] - a[0, 0], a[1:, 1] - a[0, 1]  # from the first point, whose terms are zero
        return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)
    ox, oy = ring[0]
    total = px = py = 0.0
    for x, y in ring:
        x, y = x - ox, y - oy
        total += px * y - x * py
        px, py = x, y
    return float(total / 2)


def area(g: Geometry) -> float:
    return sum(abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:]) for p in g)


def shifted(g: Geometry, dx: float, dy: float) -> Geometry:
    return [[[(x + dx, y + dy) for x, y in r] for r in p] for p in g]


def centroid(g: Geometry) -> Point:
    sx = sy = s = 0.0
    for polygon in g:
        for k, ring in enumerate(polygon):
            a = np.asarray(ring, dtype=float)
            o = a[0]
            a = a - o
            b = np.roll(a, -1, axis=0)
            cross = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
            w = cross.sum() / 2
            if w == 0:
                continue
            c = ((a + b) * cross[:, None]).sum(axis=0) / (6 * w) + o
            w = abs(w) * (1 if k == 0 else -1)
            sx, sy, s = sx + c[0] * w, sy + c[1] * w, s + w
    if s == 0:
        pts = np.array([p for polygon in g for r in polygon for p in r] or [(0.0, 0.0)])
        return tuple(pts.mean(axis=0))
    return sx / s, sy / s


def bounds(g: Geometry) -> tuple[float, float, float, float]:
    xs, ys = zip(*[p for polygon in g for r in polygon for p in r])
    return min(xs), min(ys), max(xs), max(ys)


def origin(shapes: list[Geometry], room: float = 0.0, share: float = 0.0) -> Point:
    """Where shapes should be worked on from.  Less it, all their coordinates, and those
    ``room`` and a ``share`` of the extent around, are of one magnitude: whatever is made
    of them is snapped to one grid, which does not grow with how far off they lie."""
    boxes = [bounds(g) for g in shapes if any(r for p in g or [] for r in p)]
    if not boxes:
        return 0.0, 0.0
    low = min(b[0] for b in boxes), min(b[1] for b in boxes)
    size = max(max(b[2] for b in boxes) - low[0], max(b[3] for b in boxes) - low[1])
    room += share * size
    whole = 2.0 ** math.ceil(math.log2(1.5 * (size + 2 * room) or 1.0))  # at most two thirds are used
    step = whole / 8
    return tuple(math.floor((v - room) / step) * step - whole for v in low)


def sides(g: Geometry) -> list[tuple[float, float, float, float]]:
    """From every point of a ring to the next."""
    return [(*p, *q) for polygon in g for r in polygon if len(r) > 1 for p, q in zip(r, [*r[1:], r[0]])]


def segments(g: Geometry) -> np.ndarray:
    return np.array(sides(g), dtype=float).reshape(-1, 4)


def contains(g: Geometry, points: np.ndarray, boundary: bool = True, tol: float = 1e-12) -> np.ndarray:
    """Even-odd test of many points; ``boundary`` says whether edges are inside."""
    points = np.atleast_2d(np.asarray(points, dtype=float))
    few = sides(g)
    if len(points) * len(few) <= FEW_SIDES:
        return np.array([_holds(few, x, y, boundary, tol) for x, y in points.tolist()], dtype=bool)
    s = np.array(few, dtype=float)
    inside = np.zeros(len(points), dtype=bool)
    on = np.zeros(len(points), dtype=bool)
    x0, y0, x1, y1 = s.T
    for at in range(0, len(points), 4096):
        px, py = points[at : at + 4096, :1], points[at : at + 4096, 1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ((y0 > py) != (y1 > py)) & (px < x0 + (x1 - x0) * (py - y0) / (y1 - y0))
        inside[at : at + 4096] = hit.sum(axis=1) % 2 == 1
        cross = (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)
        size = np.abs(x1 - x0) + np.abs(y1 - y0) + tol
        near = (np.abs(cross) <= tol * size * np.maximum(1, np.abs(px) + np.abs(py))) & (px >= np.minimum(x0, x1) - tol) & (px <= np.maximum(x0, x1) + tol) & (py >= np.minimum(y0, y1) - tol) & (py <= np.maximum(y0, y1) + tol)
        on[at : at + 4096] = near.any(axis=1)
    return inside | on if boundary else inside & ~on


def _holds(sides: list[tuple], px: float, py: float, boundary: bool, tol: float) -> bool:
    """``contains`` of one point."""
    inside = on = False
    far = max(1, abs(px) + abs(py))
    for x0, y0, x1, y1 in sides:
        if (y0 > py) != (y1 > py) and px < x0 + (x1 - x0) * (py - y0) / (y1 - y0):
            inside = not inside
        if not on and (x0 if x0 < x1 else x1) - tol <= px <= (x1 if x0 < x1 else x0) + tol and (y0 if y0 < y1 else y1) - tol <= py <= (y1 if y0 < y1 else y0) + tol:
            on = abs((x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)) <= tol * (abs(x1 - x0) + abs(y1 - y0) + tol) * far
    return inside or on if boundary else inside and not on


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in order, and for each row its place among them."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(rows), dtype=int)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def _meeting(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``i < j`` of boxes that meet, found in blocks."""
    found = [np.empty((0, 2), dtype=int)]
    n = len(lo)
    step = max(1, 1_000_000 // max(n, 1))
    for at in range(0, n, step):
        rows, rest = slice(at, at + step), slice(at + 1, n)
        hit = (lo[None, rest, 0] <= hi[rows, None, 0]) & (hi[None, rest, 0] >= lo[rows, None, 0]) & (lo[None, rest, 1] <= hi[rows, None, 1]) & (hi[None, rest, 1] >= lo[rows, None, 1])
        pairs = np.argwhere(hit)
        pairs[:, 0] += at
        pairs[:, 1] += at + 1
        found.append(pairs[pairs[:, 0] < pairs[:, 1]])
    pairs = np.vstack(found)
    return pairs[:, 0], pairs[:, 1]


class Arrangement:
    """Faces of the common subdivision of several geometries (and lines)."""

    def __init__(self, inputs: list[Geometry], lines: list[Ring] = ()):
        self.inputs = inputs
        self.sides = [sides(g) for g in inputs]
        every = [s for own in self.sides for s in own] + [(*p, *q) for line in lines for p, q in zip(line, line[1:])]
        span = float(max(max(map(max, every)), -min(map(min, every)))) if every else 1.0
        self.grid = 2.0 ** math.floor(math.log2(max(span, 1e-300) * SNAP)) if span else SNAP
        self.nodes, self.edges = self._noded_few(every) if len(every) <= FEW_SIDES else self._noded(np.array(every, dtype=float))
        self._link()

    def _snap(self, points: np.ndarray) -> np.ndarray:
        return np.rint(points / self.grid) * self.grid

    def _noded(self, s: np.ndarray) -> tuple[list[Point], list[tuple[int, int]]]:
        s = self._snap(s)
        for _ in range(4):  # cuts are snapped, which may need cutting anew
            s, _ = _distinct(np.where(self._swap(s), s[:, [2, 3, 0, 1]], s))
            s = s[(s[:, :2] != s[:, 2:]).any(axis=1)]
            cut = self._cut(s)
            if len(cut) == len(s):
                break
            s = cut
        return self._indexed(map(tuple, s.tolist()))

    def _noded_few(self, every: list[tuple]) -> tuple[list[Point], list[tuple[int, int]]]:
        grid = self.grid
        s = [tuple([round(v / grid) * grid for v in side]) for side in every]
        for _ in range(4):
            s = sorted({x if x[:2] <= x[2:] else (*x[2:], *x[:2]) for x in s if x[:2] != x[2:]})
            cut = self._cut_few(s)
            if cut is s:
                break
            s = cut
        return self._indexed(s)

    @staticmethod
    def _indexed(s) -> tuple[list[Point], list[tuple[int, int]]]:
        """Nodes in order and the pairs of them that the sides join."""
        ends = [((x0, y0), (x1, y1)) for x0, y0, x1, y1 in s]
        nodes = sorted({p for e in ends for p in e})
        index = {p: i for i, p in enumerate(nodes)}
        joined = ((index[p], index[q]) for p, q in ends if p != q)
        return nodes, sorted({(i, j) if i < j else (j, i) for i, j in joined})

    def _cut_few(self, s: list[tuple]) -> list[tuple]:
        """``_cut`` of sides in order; the same list if nothing is cut."""
        grid, tol = self.grid, self.grid * 2
        at: dict[int, list[Point]] = defaultdict(list)
        size = [math.hypot(x1 - x0, y1 - y0) for x0, y0, x1, y1 in s]
        low = [min(x[1], x[3]) - tol for x in s]
        high = [max(x[1], x[3]) + tol for x in s]
        for i, (ax, ay, bx, by) in enumerate(s):
            dx, dy, n, reach, bottom, top = bx - ax, by - ay, size[i], bx + tol, low[i], high[i]
            slack = tol * n
            for j in range(i + 1, len(s)):
                px, py, qx, qy = s[j]
                if px - tol > reach:
                    break
                if low[j] > top or high[j] < bottom:
                    continue
                ex, ey, m = qx - px, qy - py, size[j]
                # how far the ends of one lie from the other, times its length
                p, q = dx * (py - ay) - dy * (px - ax), dx * (qy - ay) - dy * (qx - ax)
                if (p > slack and q > slack) or (p < -slack and q < -slack):
                    if ey == dy == 0 or ex == dx == 0:
                        continue
                else:
                    for off, x, y in ((p, px, py), (q, qx, qy)):
                        if -slack <= off <= slack:
                            along = ((x - ax) * dx + (y - ay) * dy) / n
                            if along > tol and n - along > tol:
                                at[i].append((x, y))
                a, b = ex * (ay - py) - ey * (ax - px), ex * (by - py) - ey * (bx - px)
                room = tol * m
                for off, x, y in ((a, ax, ay), (b, bx, by)):
                    if -room <= off <= room:
                        along = ((x - px) * ex + (y - py) * ey) / m
                        if along > tol and m - along > tol:
                            at[j].append((x, y))
                if (p < 0 < q or q < 0 < p) and (a < 0 < b or b < 0 < a):
                    cross = dx * ey - dy * ex
                    if abs(cross) > 1e-14 * n * m:
                        t, u = ((px - ax) * ey - (py - ay) * ex) / cross, ((px - ax) * dy - (py - ay) * dx) / cross
                        if tol < t * n < n - tol and tol < u * m < m - tol:
                            x = round((ax + t * dx) / grid) * grid, round((ay + t * dy) / grid) * grid
                            at[i].append(x)
                            at[j].append(x)
        if not at:
            return s
        out = [x for i, x in enumerate(s) if i not in at]
        for i, points in at.items():
            x0, y0, x1, y1 = s[i]
            way = sorted([(x0, y0), (x1, y1), *points], key=lambda p: (p[0] - x0) ** 2 + (p[1] - y0) ** 2)
            out += [(*p, *q) for p, q in zip(way, way[1:]) if p != q]
        return out

    @staticmethod
    def _swap(s: np.ndarray) -> np.ndarray:
        return ((s[:, 0] > s[:, 2]) | ((s[:, 0] == s[:, 2]) & (s[:, 1] > s[:, 3])))[:, None]

    def _cut(self, s: np.ndarray) -> np.ndarray:
        """Segments split where another one crosses, touches or overlaps them."""
        tol = self.grid * 2
        lo, hi = np.minimum(s[:, :2], s[:, 2:]) - tol, np.maximum(s[:, :2], s[:, 2:]) + tol
        d = s[:, 2:] - s[:, :2]
        size = np.hypot(d[:, 0], d[:, 1])
        i, j = _meeting(lo, hi)
        who, where = [], []

        def ends_on(k: np.ndarray, ends: np.ndarray) -> None:
            off = ends - s[k, :2]
            along = (off * d[k]).sum(axis=1) / size[k]
            gap = np.abs(d[k, 0] * off[:, 1] - d[k, 1] * off[:, 0]) / size[k]
            hit = (gap <= tol) & (along > tol) & (size[k] - along > tol)
            who.append(k[hit])
            where.append(ends[hit])

        for k, other in ((i, j), (j, i)):
            ends_on(k, s[other, :2])
            ends_on(k, s[other, 2:])
        cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        off = s[j, :2] - s[i, :2]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (off[:, 0] * d[j, 1] - off[:, 1] * d[j, 0]) / cross
            u = (off[:, 0] * d[i, 1] - off[:, 1] * d[i, 0]) / cross
        a, b = tol / size[i], tol / size[j]
        meet = np.flatnonzero((np.abs(cross) > 1e-14 * size[i] * size[j]) & (t > a) & (t < 1 - a) & (u > b) & (u < 1 - b))
        p = self._snap(s[i[meet], :2] + t[meet, None] * d[i[meet]])
        k, p = np.concatenate([*who, i[meet], j[meet]]), np.vstack([*where, p, p])
        if not len(k):
            return s
        whole = np.ones(len(s), dtype=bool)
        whole[k] = False
        cut = np.flatnonzero(~whole)
        k, p = np.concatenate([k, cut, cut]), np.vstack([p, s[cut, :2], s[cut, 2:]])
        order = np.lexsort((((p - s[k, :2]) ** 2).sum(axis=1), k))
        k, p = k[order], p[order]
        new = (k[1:] == k[:-1]) & (p[1:] != p[:-1]).any(axis=1)
        return np.vstack([s[whole], np.hstack([p[:-1], p[1:]])[new]])

    def _link(self) -> None:
        """Half-edges 2k and 2k+1 of edge k; the next one keeps the face on the left."""
        nodes = self.nodes
        self.start = [i for e in self.edges for i in e]
        self.end = [i for a, b in self.edges for i in (b, a)]
        around: dict[int, list[int]] = defaultdict(list)
        angle = []
        for h, (i, j) in enumerate(zip(self.start, self.end)):
            (ax, ay), (bx, by) = nodes[i], nodes[j]
            angle.append(math.atan2(by - ay, bx - ax))
            around[i].append(h)
        self.around = around
        self.next = [0] * len(self.start)
        for hs in around.values():
            hs.sort(key=angle.__getitem__)
            for k, h in enumerate(hs):
                self.next[h ^ 1] = hs[k - 1]
        self.cycle = [-1] * len(self.start)
        self.cycles: list[list[int]] = []
        for h in range(len(self.start)):
            if self.cycle[h] < 0:
                walk, at = [], h
                while self.cycle[at] < 0:
                    self.cycle[at] = len(self.cycles)
                    walk.append(at)
                    at = self.next[at]
                self.cycles.append(walk)
        self.areas = [ring_area([nodes[self.start[h]] for h in walk]) for walk in self.cycles]
        self.labels = self._labels()

    def length(self, h: int) -> float:
        """Of a half-edge."""
        return math.dist(self.nodes[self.start[h]], self.nodes[self.end[h]])

    def _labels(self) -> np.ndarray:
        """Per cycle and input whether the input covers the face on the cycle's left."""
        points = []
        for k, walk in enumerate(self.cycles):
            size = [self.length(h) for h in walk]
            longest = max(size)
            h = walk[size.index(longest)]
            (ax, ay), (bx, by) = self.nodes[self.start[h]], self.nodes[self.end[h]]
            step = max(self.grid * 8, min(1e-6 * longest, abs(self.areas[k]) / max(sum(size), 1e-300) * 0.05 or 1e-6 * longest))
            points.append(((ax + bx) / 2 - (by - ay) / longest * step, (ay + by) / 2 + (bx - ax) / longest * step))
        labels = np.zeros((len(points), len(self.inputs)), dtype=bool)
        for i, (g, own) in enumerate(zip(self.inputs, self.sides)):
            if own:
                x0, y0, x1, y1 = bounds(g)
                near = [k for k, (x, y) in enumerate(points) if x0 <= x <= x1 and y0 <= y <= y1]
                if len(near) * len(own) <= 16 * FEW_SIDES:
                    labels[near, i] = [_holds(own, *points[k], False, 0.0) for k in near]
                else:
                    labels[near, i] = contains(g, np.array([points[k] for k in near]), boundary=False, tol=0.0)
        return labels

    def select(self, chosen: np.ndarray) -> Geometry:
        """Outline of the faces whose cycles are chosen."""
        inner = [bool(chosen[c]) for c in range(len(self.cycles))]
        edge = [h for h, c in enumerate(self.cycle) if inner[c] and not inner[self.cycle[h ^ 1]]]
        mark = set(edge)
        rings, seen = [], set()
        for h in edge:
            if h in seen:
                continue
            ring, at = [], h
            while at not in seen:
                seen.add(at)
                ring.append(self.nodes[self.start[at]])
                turn = self.around[self.end[at]]
                k = turn.index(at ^ 1)
                at = next(turn[(k - i) % len(turn)] for i in range(1, len(turn) + 1) if turn[(k - i) % len(turn)] in mark)
            rings.append(_straight(ring))
        return assemble([r for r in rings if len(r) > 2])

    def faces(self) -> list[tuple[Geometry, np.ndarray]]:
        """Every bounded face with its label."""
        out = []
        holes = [k for k, a in enumerate(self.areas) if a <= 0]
        for k, a in enumerate(self.areas):
            if a > 0:
                outer = [self.nodes[self.start[h]] for h in self.cycles[k]]
                inner = []
                for c in holes:
                    p = self.nodes[self.start[self.cycles[c][0]]]
                    if abs(self.areas[c]) < a and contains([[outer]], p, boundary=False)[0]:
                        inner.append([self.nodes[self.start[h]] for h in self.cycles[c]])
                out.append(([[_straight(outer), *[_straight(r) for r in inner if abs(ring_area(r)) > 0]]], self.labels[k]))
        return out


def _straight(ring: Ring) -> Ring:
    """Without repeated points and without those on a straight line."""
    out = list(ring)
    changed = True
    while changed and len(out) > 3:
        changed = False
        for i in range(len(out)):
            (ax, ay), (bx, by), (cx, cy) = out[i - 1], out[i], out[(i + 1) % len(out)]
            cross = (bx - ax) * (cy - by) - (by - ay) * (cx - bx)
            if abs(cross) <= 1e-14 * (math.hypot(bx - ax, by - ay) * math.hypot(cx - bx, cy - by)) or (ax, ay) == (bx, by):
                del out[i]
                changed = True
                break
    return out


def assemble(rings: list[Ring]) -> Geometry:
    """Polygons of outlines: counter-clockwise rings are outer, others holes of the
    smallest outer ring around them."""
    outer = sorted(([r] for r in rings if ring_area(r) > 0), key=lambda p: ring_area(p[0]))
    for hole in (r for r in rings if ring_area(r) < 0):
        mid = np.array([[(hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2]])
        for p in outer:
            if ring_area(p[0]) > -ring_area(hole) and contains([[p[0]]], mid)[0]:
                p.append(hole)
                break
    return sorted(outer, key=lambda p: -ring_area(p[0]))


def _combine(inputs: list[Geometry], keep) -> Geometry:
    a = Arrangement(inputs)
    return a.select(keep(a.labels)) if len(a.cycles) else []


def union(gs: list[Geometry]) -> Geometry:
    return _combine([g for g in gs if g], lambda x: x.any(axis=1)) if any(gs) else []


def intersection(a: Geometry, b: Geometry) -> Geometry:
    return [] if apart(a, b) else _combine([a, b], lambda x: x[:, 0] & x[:, 1])


def difference(a: Geometry, *others: Geometry) -> Geometry:
    others = [o for o in others if o and not apart(a, o)]
    if not a or not others:
        return make_valid(a) if a else []
    return _combine([a, *others], lambda x: x[:, 0] & ~x[:, 1:].any(axis=1))


def make_valid(g: Geometry) -> Geometry:
    """Repair by the even-odd rule, ring by ring structure kept."""
    return _combine([g], lambda x: x[:, 0]) if g else []


def polygonize(gs: list[Geometry], lines: list[Ring] = ()) -> list[Geometry]:
    return [face for face, _ in Arrangement(gs, lines).faces()]


def gaps(gs: list[Geometry]) -> list[Geometry]:
    """Holes enclosed by the union of all; open notches are none."""
    whole = union(gs)
    filled = union([[[p[0]]] for p in whole])
    rest = difference(filled, whole)
    return [[p] for p in rest]


def is_valid(g: Geometry) -> bool:
    """No ring crosses or touches itself along a line and areas agree with the repair, but
    for what snapping to the grid can shift along the rings."""
    if not g or any(len(set(r)) < 3 for p in g for r in p):
        return False
    a = Arrangement([g])
    fixed = a.select(a.labels[:, 0]) if len(a.cycles) else []
    s = segments(g)
    slack = 1e-9 * max(1.0, area(fixed)) + 2 * a.grid * float(np.hypot(s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]).sum())
    return abs(area(fixed) - area(g)) <= slack and len(fixed) == len(g) and sum(map(len, fixed)) == sum(map(len, g))


def apart(a: Geometry, b: Geometry) -> bool:
    """Whether the bounding boxes do not even touch."""
    if not a or not b:
        return True
    return boxes_apart(bounds(a), bounds(b))


def boxes_apart(p: tuple[float, float, float, float], q: tuple[float, float, float, float]) -> bool:
    tol = 1e-9 * max(map(abs, (*p, *q, 1.0)))
    return p[0] > q[2] + tol or q[0] > p[2] + tol or p[1] > q[3] + tol or q[1] > p[3] + tol


def shared_boundary(a: Geometry, b: Geometry) -> float:
    """Length of the border that two geometries have in common (overlaps count with
    their outline); negative where they do not meet."""
    if apart(a, b):
        return -1.0
    arr = Arrangement([a, b])
    if not len(arr.cycles):
        return -1.0
    both = set(_cover(a, arr)) & set(_cover(b, arr))
    length = sum(arr.length(2 * k) for k in both)
    if length > 0:
        return length
    common = arr.labels.all(axis=1)
    if common.any():
        return float(sum(arr.length(h) for h in range(len(arr.start)) if common[arr.cycle[h]] and not common[arr.cycle[h ^ 1]]))
    pa, pb = ({tuple(p) for poly in arr._snap_geometry(g) for r in poly for p in r} for g in (a, b))
    return 0.0 if pa & pb else -1.0


def _cover(g: Geometry, arr: Arrangement) -> list[int]:
    """Edges of the arrangement on the border of ``g``."""
    k = next(i for i, x in enumerate(arr.inputs) if x is g)
    own, cycle = arr.labels[:, k].tolist(), arr.cycle
    return [e for e in range(len(arr.edges)) if own[cycle[2 * e]] != own[cycle[2 * e + 1]]]


def _snap_geometry(self, g: Geometry) -> Geometry:
    return [[[tuple([float(round(v / self.grid) * self.grid) for v in p]) for p in r] for r in poly] for poly in g]


Arrangement._snap_geometry = _snap_geometry


def convex_hull(points: list[Point]) -> Ring:
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    low, up = half(pts), half(reversed(pts))
    return low[:-1] + up[:-1]


def min_rectangle(points: list[Point]) -> tuple[float, float]:
    """``(longer, shorter)`` side of the smallest rectangle of any orientation."""
    hull = np.array(convex_hull(points), dtype=float)
    if len(hull) < 3:
        return (float(np.hypot(*(hull[-1] - hull[0]))) if len(hull) else 0.0), 0.0
    best = None
    for p, q in zip(hull, np.roll(hull, -1, axis=0)):
        u = (q - p) / np.hypot(*(q - p))
        x, y = hull @ u, hull @ np.array([-u[1], u[0]])
        w, h = float(np.ptp(x)), float(np.ptp(y))
        if best is None or w * h < best[0] - 1e-12:
            best = (w * h, max(w, h), min(w, h))
    return best[1], best[2]


def clip_halfplane(ring: Ring, a: float, b: float, c: float) -> Ring:
    """Part of a convex ring where ``a x + b y <= c``."""
    out = []
    for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1]):
        s, t = a * px + b * py - c, a * qx + b * qy - c
        if s <= 0:
            out.append((px, py))
        if (s < 0 < t) or (t < 0 < s):
            k = s / (s - t)
            out.append((px + (qx - px) * k, py + (qy - py) * k))
    return out


def voronoi(points: list[Point], extent: tuple[float, float, float, float]) -> list[Ring]:
    """Cell of every point within the extent, by half-planes of the bisectors; nearer
    points first, until none can reach the cell any more."""
    pts = np.array(points, dtype=float)
    x0, y0, x1, y1 = extent
    out = []
    for i, p in enumerate(pts):
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        d = ((pts - p) ** 2).sum(axis=1)
        for j in np.argsort(d, kind="stable"):
            if j == i or d[j] == 0:
                continue
            reach = max((x - p[0]) ** 2 + (y - p[1]) ** 2 for x, y in ring) if ring else 0
            if d[j] > 4 * reach:
                break
            q = pts[j]
            ring = clip_halfplane(ring, *(2 * (q - p)), float(q @ q - p @ p))
        out.append(ring)
    return out


def kept_between(a: np.ndarray, first: int, last: int, tolerance: float) -> list[int]:
    """Places of the points that Douglas-Peucker keeps of a line, both ends included."""
    keep, todo = {first, last}, [(first, last)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d, off = a[j] - a[i], a[i + 1 : j] - a[i]
        along = np.clip(off @ d / max(float(d @ d), 1e-300), 0, 1)
        far = np.hypot(*(off - along[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return sorted(keep)


def simplified_places(line: list[Point], tolerance: float) -> list[int]:
    """``kept_between`` of a whole line; a closed one is held at its ends and at the point
    that lies furthest from them."""
    a = np.asarray(line, dtype=float)
    if len(a) < 3:
        return list(range(len(a)))
    if line[0] != line[-1]:
        return kept_between(a, 0, len(a) - 1, tolerance)
    far = int(((a - a[0]) ** 2).sum(axis=1).argmax())
    return sorted({*kept_between(a, 0, far, tolerance), *kept_between(a, far, len(a) - 1, tolerance)})


def simplify(ring: Ring, tolerance: float) -> Ring:
    """Douglas-Peucker on a closed ring, anchored at its two most distant ends."""
    return ring if len(ring) < 4 else [ring[i] for i in simplified_places([*ring, ring[0]], tolerance)[:-1]]


#: So many pieces of a buffer are united at a time.
BUFFER_PIECES = 32


def _beside(ring: Ring, d: float, quadrant: int) -> list[Geometry]:
    """What lies within ``d`` on the right of a directed ring: a rectangle per side and,
    where the ring turns left, a fan of at least ``quadrant`` steps a right angle."""
    a = np.array([p for k, p in enumerate(ring) if p != ring[k - 1]], dtype=float)
    if len(a) < 3:
        return []
    v = np.roll(a, -1, axis=0) - a
    n = np.stack([v[:, 1], -v[:, 0]], axis=1) / np.hypot(v[:, 0], v[:, 1])[:, None] * d
    out: list[Geometry] = []
    for k, (p, q) in enumerate(zip(a, np.roll(a, -1, axis=0))):
        out.append([[[tuple(map(float, x)) for x in (p, p + n[k], q + n[k], q)]]])
        m, e = n[k - 1], n[k]
        turn = math.atan2(m[0] * e[1] - m[1] * e[0], float(m @ e))
        if turn > 1e-12:
            start, steps = math.atan2(m[1], m[0]), math.ceil(turn / (math.pi / 2 / quadrant) - 1e-9)
            arc = [(float(p[0] + d * math.cos(start + turn * i / steps)), float(p[1] + d * math.sin(start + turn * i / steps))) for i in range(1, steps)]
            out.append([[[tuple(map(float, p)), tuple(map(float, p + m)), *arc, tuple(map(float, p + e))]]])
    return out


def buffer(g: Geometry, d: float, quadrant: int = 8) -> Geometry:
    """All points within ``d`` of an area; for a negative ``d`` those of the area that lie
    at least as far from its border.  Round corners, ``quadrant`` steps a right angle.
    Taken from an ``origin`` of its own."""
    if not any(r for p in g or [] for r in p):
        return []
    x, y = origin([g], 2 * abs(d))
    return shifted(_buffer(shifted(g, -x, -y), d, quadrant), x, y)


def _buffer(g: Geometry, d: float, quadrant: int) -> Geometry:
    g = make_valid(g)
    if not g or not d:
        return g
    rings = [r if d > 0 else r[::-1] for p in g for r in p]  # outer ones run left, holes right
    pieces = [x for r in rings for x in _beside(r, abs(d), quadrant)]
    joined = [union(pieces[k : k + BUFFER_PIECES]) for k in range(0, len(pieces), BUFFER_PIECES)] if len(pieces) > BUFFER_PIECES else pieces
    return union([g, *joined]) if d > 0 else difference(g, *joined)


def snap_to(ring: Ring, targets: np.ndarray, tolerance: float) -> Ring:
    """Vertices moved to the nearest point of the target segments within tolerance."""
    if not len(targets):
        return ring
    p, d = targets[:, :2], targets[:, 2:] - targets[:, :2]
    size = np.maximum((d * d).sum(axis=1), 1e-300)
    out = []
    for x, y in ring:
        t = np.clip(((np.array([x, y]) - p) * d).sum(axis=1) / size, 0, 1)
        near = p + d * t[:, None]
        gap = np.hypot(near[:, 0] - x, near[:, 1] - y)
        k = int(gap.argmin())
        out.append((float(near[k, 0]), float(near[k, 1])) if gap[k] <= tolerance else (x, y))
    return out


def clip_line(line: Ring, g: Geometry) -> list[Ring]:
    """Pieces of a line inside a geometry."""
    cut = Arrangement([g], [line])
    out = []
    own = {tuple(p) for p in map(tuple, cut._snap(np.asarray(line, dtype=float)))}
    for a, b in cut.edges:
        mid = (np.array(cut.nodes[a]) + np.array(cut.nodes[b])) / 2
        if _on_line(mid, line, cut.grid * 8) and contains(g, mid)[0]:
            out.append([cut.nodes[a], cut.nodes[b]])
    return merge_lines(out) if own else out


def _on_line(p: np.ndarray, line: Ring, tol: float) -> bool:
    a = np.asarray(line, dtype=float)
    s, d = a[:-1], a[1:] - a[:-1]
    t = np.clip(((p - s) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
    return bool((np.hypot(*(s + d * t[:, None] - p).T) <= tol).any())


def merge_lines(lines: list[Ring]) -> list[Ring]:
    """Pieces joined at their ends where exactly two meet, in time linear in the pieces."""
    at: dict[Point, list[int]] = defaultdict(list)
    for i, line in enumerate(lines):
        at[line[0]].append(i)
        at[line[-1]].append(i)
    used: set[int] = set()

    def grown(line: Ring) -> Ring:
        """``line`` with what follows its end."""
        while len(who := at[line[-1]]) == 2 and who[0] != who[1]:
            after = next((i for i in who if i not in used), None)
            if after is None:
                break
            used.add(after)
            more = lines[after] if lines[after][0] == line[-1] else lines[after][::-1]
            line += more[1:]
        return line

    out = []
    for i, line in enumerate(lines):
        if i not in used:
            used.add(i)
            forth = grown(list(line))
            out.append(grown(forth[::-1])[::-1])
    return out


def shared_lines(a: Geometry, b: Geometry) -> list[Ring]:
    """The common border of two geometries as merged lines."""
    arr = Arrangement([a, b])
    both = sorted(set(_cover(a, arr)) & set(_cover(b, arr))) if len(arr.cycles) else []
    return merge_lines([[arr.nodes[i] for i in arr.edges[k]] for k in both])
