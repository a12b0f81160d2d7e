"""Embedding near-dedup by lattice hashing.

Vectors of unit length are projected to eight random dimensions per lattice, scaled and
decoded to the nearest point of E8; the points of a table's lattices, with the label,
are the cell.  Each vector is stored in its own cell of every table and probes the
cells of the neighbouring lattice points nearest to its projection as well.  Vectors
that meet in a cell are verified by their cosine in double precision.

Exactly equal vectors of a label are one class and cost one row.  In cells of few
vectors the meetings become different pairs, which are verified once.  A cell of more
than ``HOT_CELL`` is cut into blocks; each pair of blocks is verified by one matrix
product that returns link counts and a few edges instead of pairs, so no task holds a
hot cell and no pairs of one are written.  A pair that meets in hot cells is counted
in the one with the smallest code and nowhere else."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

COSINE = 0.98
#: Tables, lattices per table (eight projections each), scale of the projections and
#: neighbouring points probed in each lattice: recall 0.999 and more of brute force
#: on near copies, measured in tests/llm/test_other_operators.py.
TABLES, LATTICES, SCALE, PROBES = 5, 2, 0.7, 3
SEED = 11
#: Cells with more vectors than this are verified block by block.
HOT_CELL = 64
BLOCK = 1024


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row, doubled so that it is whole: the better of D8
    and D8 shifted by a half."""
    even, half = _d8(x), _d8(x - 0.5) + 0.5
    near = ((x - even) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(near[:, None], 2 * even, 2 * half).astype(np.int64)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest whole point with an even sum: round, and where the sum is odd round the
    coordinate that is furthest from whole the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (2, -2):
                for b in (2, -2):
                    v = np.zeros(8, dtype=np.int64)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([1 if bits >> i & 1 else -1 for i in range(8)], dtype=np.int64)
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


@lru_cache(maxsize=8)
def projections(width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(TABLES, LATTICES, width, 8)), rng.uniform(0, 2, size=(TABLES, LATTICES, 8))


#: Odd multipliers of the cell code; any will do.
_MIX = np.random.default_rng(5).integers(1 << 62, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOTS = roots()


def codes_of(points: np.ndarray) -> np.ndarray:
    """64-bit code of lattice points (rows of eight whole numbers)."""
    h = (points.astype(np.int64).view(np.uint64) * _MIX[:8]).sum(axis=-1, dtype=np.uint64)
    h ^= h >> np.uint64(31)
    h *= _MIX[8]
    return h ^ h >> np.uint64(29)


def cells(unit: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the cells that each vector is stored in (n x tables) and that it
    probes besides (n x tables*lattices*probes)."""
    matrix, shift = projections(unit.shape[1])
    own, probed = [], []
    base = labels.astype(np.int64).view(np.uint64) * _MIX[9]
    for t in range(TABLES):
        parts, around = [], []
        for k in range(LATTICES):
            x = unit @ matrix[t, k] * SCALE + shift[t, k]
            point = e8(x)
            gain = (2 * x - point) @ _ROOTS.T  # the roots are equally long: the best aligned is nearest
            best = np.argpartition(-gain, PROBES - 1, axis=1)[:, :PROBES]
            parts.append(codes_of(point) * _MIX[10 + k])
            around.append(codes_of(point[:, None, :] + _ROOTS[best]) * _MIX[10 + k])
        whole = sum(parts[1:], parts[0]) + base + np.full(1, t, dtype=np.uint64) * _MIX[15]
        own.append(whole)
        probed += [(whole - parts[k])[:, None] + around[k] for k in range(LATTICES)]
    return np.stack(own, axis=1).view(np.int64), np.concatenate(probed, axis=1).view(np.int64)


def unit_rows(vectors: list) -> np.ndarray:
    """Rows of unit length in double precision, scaled first against overflow."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells_of(batches):
    kind = pa.list_(pa.int64())
    for b in batches:
        vectors = b.column(1).to_pylist()
        labels = b.column(2).to_numpy()
        own, probed = [None] * len(vectors), [None] * len(vectors)
        widths = np.array([len(v) for v in vectors])
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            o, p = cells(unit_rows([vectors[i] for i in at]), labels[at] + w)
            for i, x, y in zip(at, o, p):
                own[i], probed[i] = x, y
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, kind), pa.array(probed, kind)], names=["node", "own", "probed"])


def _verified(batches):
    """Of candidate pairs those that link."""
    for b in batches:
        a, x, ma, c, y, mc = (b.column(i) for i in range(6))
        ok = np.zeros(b.num_rows, dtype=bool)
        xs, ys = x.to_pylist(), y.to_pylist()
        widths = np.array([len(v) for v in xs])
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            at = at[[len(ys[i]) == w for i in at]]
            if len(at):
                ok[at] = (unit_rows([xs[i] for i in at]) * unit_rows([ys[i] for i in at])).sum(axis=1) >= COSINE
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([v.filter(keep) for v in (a, c, ma, mc)], names=["a", "b", "ma", "mb"])


def _block(table: pa.Table) -> pa.Table:
    """Links between the entries (side 0) and the stored vectors (side 1) of a pair of
    blocks of a hot cell: ``(node, other, n)``, n links counted for node, or an edge."""
    key = table.column("key")[0].as_py()
    side = table.column("side").to_numpy()
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    stored = table.column("stored").to_numpy(zero_copy_only=False)
    vectors = table.column("v").to_pylist()
    kind = np.unique([f"{len(v)} {l}" for v, l in zip(vectors, table.column("label").to_pylist())], return_inverse=True)[1]
    own, probed = table.column("hot_own").to_pylist(), table.column("hot_probed").to_pylist()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    rows: list[tuple[int, int | None, int]] = []
    if len(left) and len(right):
        u = np.zeros((len(vectors), max(map(len, vectors))))
        for w in {len(v) for v in vectors}:
            at = [i for i, v in enumerate(vectors) if len(v) == w]
            u[at, :w] = unit_rows([vectors[i] for i in at])
        link = (u[left] @ u[right].T >= COSINE) & (kind[left][:, None] == kind[right][None, :])
        link &= np.where(stored[left][:, None], node[left][:, None] < node[right][None, :], True)
        a, c = np.nonzero(link)
        if len(a):
            # only in the smallest hot cell in which the two meet
            first = np.full(len(a), key, dtype=np.int64)
            for mine, other, one, two in ((own, own, left[a], right[c]), (probed, own, left[a], right[c]), (probed, own, right[c], left[a])):
                first = np.minimum(first, _first_common(mine, other, one, two))
            keep = first == key
            a, c = left[a[keep]], right[c[keep]]
            n = np.zeros(len(node), dtype=np.int64)
            np.add.at(n, a, copies[c])
            np.add.at(n, c, copies[a])
            rows += [(int(node[i]), None, int(n[i])) for i in np.flatnonzero(n)]
            root = list(range(len(node)))

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in zip(a.tolist(), c.tolist()):
                i, j = find(i), find(j)
                if i != j:
                    root[i] = j
                    rows.append((int(node[i]), int(node[j]), 0))
    cols = list(zip(*rows)) if rows else ([], [], [])
    return pa.table({"node": pa.array(cols[0], pa.int64()), "other": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64())})


def _first_common(mine: list, other: list, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Smallest code common to ``mine[one[k]]`` and ``other[two[k]]`` for every k."""
    top = np.iinfo(np.int64).max
    width, deep = max(1, max(map(len, mine))), max(1, max(map(len, other)))
    x = np.full((len(mine), width), top)
    y = np.full((len(other), deep), top - 1)
    for i, v in enumerate(mine):
        x[i, : len(v)] = v
    for i, v in enumerate(other):
        y[i, : len(v)] = v
    out = np.full(len(one), top)
    for i in range(width):
        for j in range(deep):
            out = np.minimum(out, np.where(x[one, i] == y[two, j], x[one, i], top))
    return out


def neardup_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, n_links, component, kept)`` per row of ``vectors``.

    Rows link if their labels are equal and not null and their cosine is ``COSINE``
    or more.  n_links counts the other rows linked directly, component is the
    smallest id reachable, kept says whether that is the row's own.

    Nulls: rows whose vector is null, empty, zero or holds null or non-finite
    components, and rows with a null id or label, link with nothing; a null id has a
    null component and is not kept.  Repeated rows link with each other like any
    copies.  Vectors of different lengths do not link.  Ties do not arise.  Empty
    tables give no rows; other columns are ignored, whatever their names."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    classes = rows.where("sound").groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    classes = shared.materialise(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    coded = shared.materialise(shared.map_batches(classes.select("node", "v", F.xxhash64("label").alias("h")), _cells_of, "node long, own array<long>, probed array<long>"), "cells")
    own = coded.select("node", F.explode("own").alias("key"))
    size = shared.checkpoint(own.groupBy("key").count())
    hot = size.where(F.col("count") > HOT_CELL).select("key", F.col("count").alias("n"))

    # meetings in cells of few vectors: different pairs, verified once
    entries = own.union(coded.select("node", F.explode("probed").alias("key")))
    cold_own = own.join(size.where(F.col("count") <= HOT_CELL).select("key"), "key")
    pairs = entries.join(cold_own.withColumnRenamed("node", "b"), "key").where("node <> b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()

    # which of a vector's cells are hot
    hot_entries = shared.checkpoint(
        own.withColumn("stored", F.lit(True)).union(coded.select("node", F.explode("probed").alias("key"), F.lit(False).alias("stored"))).join(hot, "key"))
    none = F.array().cast("array<long>")
    hot_cells = hot_entries.groupBy("node").agg(F.collect_list(F.when(F.col("stored"), F.col("key"))).alias("hot_own"), F.collect_list(F.when(~F.col("stored"), F.col("key"))).alias("hot_probed"))  # its own few cells
    full = classes.select("node", "v", "copies", "label").join(hot_cells, "node", "left").select("node", "v", "copies", F.col("label").cast("string").alias("label"), F.coalesce("hot_own", none).alias("hot_own"), F.coalesce("hot_probed", none).alias("hot_probed"))
    full = shared.materialise(full, "vectors-hot")

    x, y = full.alias("x"), full.alias("y")
    joined = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
    met = F.arrays_overlap("x.hot_own", "y.hot_own") | F.arrays_overlap("x.hot_own", "y.hot_probed") | F.arrays_overlap("x.hot_probed", "y.hot_own")
    tested = joined.where(~met & (F.col("x.label") == F.col("y.label"))).select("a", F.col("x.v"), F.col("x.copies"), "b", F.col("y.v"), F.col("y.copies")).toDF("a", "x", "ma", "b", "y", "mb")
    links = shared.materialise(shared.map_batches(tested, _verified, "a long, b long, ma long, mb long"), "links")

    # hot cells: pairs of blocks
    total = hot_entries.groupBy("key").agg(F.count("*").alias("every"))
    placed = hot_entries.join(total, "key").withColumn("blocks", F.ceil(F.col("every") / BLOCK).cast("int")).withColumn("own_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    h = F.xxhash64("node")
    left = placed.select("key", "node", "stored", F.lit(0).alias("side"), F.pmod(h, "blocks").cast("int").alias("i"), F.explode(F.expr("sequence(0, own_blocks - 1)")).alias("j"))
    right = placed.where("stored").select("key", "node", "stored", F.lit(1).alias("side"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), F.pmod(h, "own_blocks").cast("int").alias("j"))
    blocks = left.union(right).join(full, "node")
    counted = shared.materialise(blocks.groupBy("key", "i", "j").applyInArrow(_block, "node long, other long, n long"), "block-links")

    counts = links.select(F.col("a").alias("node"), F.col("mb").alias("n")).union(links.select(F.col("b").alias("node"), F.col("ma").alias("n"))).union(counted.where("n > 0").select("node", "n"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    edges = links.select("a", "b").union(counted.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    connected = shared.connected_components(edges)
    lowest = shared.checkpoint(connected.join(classes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("rows")))
    found = shared.join_unique(connected, lowest.drop("rows"), ["root"], lowest, ["node"]).select("node", "component")
    result = classes.join(counts, "node", "left").join(found, "node", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "low").alias("component"))
    copies = classes.select("label", "v", F.col("copies").alias("rows"))
    linked = shared.join_unique(rows.where("sound").drop("sound"), result, ["label", "v"], copies, ["id"]).select("id", "n_links", "component", (F.col("id") == F.col("component")).alias("kept"))
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.col("id").isNotNull().alias("kept"))
    return linked.union(alone)


#: DuckDB SQL of the query: every pair of one label compared.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.seen),
component AS (SELECT vec_id, min(seen) AS c FROM reach GROUP BY vec_id), links AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM component LEFT JOIN links ON a = vec_id
"""
