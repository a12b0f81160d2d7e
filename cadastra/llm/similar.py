"""Join of texts by the Jaccard similarity of their sets of word shingles.

The smallest ``SKETCH`` hashes of a set are its sketch.  Of two sets that are near copies
each of the smallest hashes of the union is in both with the probability of their
similarity, so their sketches have far more than half in common.  A text therefore may
leave out the half of its sketch that is most frequent among all texts, in an order that
is the same for all: of what two texts share the least frequent key stays on both sides.
Passages that many documents share go first, and a text whose other half is its own meets
nobody.  Texts of up to ``SKETCH`` shingles are found without loss; of longer pairs with
exactly 0.8 two in a million may be missed, of more similar ones less.

Candidates of the first round are the links of SimHash fingerprints (multi-index hashing
over the same shingles) and, for every text, the earlier one that it shares most keys
with.  Then texts of one key that are not connected yet are tested against the key's two
outer texts, and of the pairs left only those whose ends are not connected matter: in keys
of few texts they become different pairs, in others the texts outside the largest
component are tested against all by pairs of blocks that return spanning edges.  Every link is verified on whole sets."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SEED = 42
#: Jaccard similarity from which texts are near copies.
NUM, DEN = 4, 5
#: Smallest hashes kept of a set, and how many of them may be left out.
SKETCH = 48
SPARE = 24
#: Keys of more texts than this are tested by blocks of ``BLOCK``.
FEW = 64
BLOCK = 256
#: Tables of no more rows than this are broadcast.
SMALL = 100_000
_COLUMNS = 1 << 14


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words are one shingle."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    found = {b" ".join(words)} if len(words) <= size else set(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), dtype="<u8", count=len(found)))


def alike(common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets with so many common members and so many together are near copies."""
    return (NUM + DEN) * common >= NUM * sizes


def spare(n: Column) -> Column:
    """Keys that a text of ``n`` shingles may leave out: near copies share more.  Those of
    so few shingles that its near copies' sketches are whole sets too share 0.8 of them."""
    return F.when(n * DEN <= SKETCH * NUM, F.ceil(n * NUM / DEN).cast("int") - 1).otherwise(SPARE)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def coded(texts: DataFrame, size: int, fingerprint) -> DataFrame:
    """``(id, h, s, t, n, fp, keys)`` per row of ``texts(id, h, text)``: digest of the set
    in two halves, its size, its fingerprint and its sketch."""

    def run(batches):
        for b in batches:
            digests, sizes, fps, keys = [], [], [], []
            for t in b.column(2).to_pylist():
                own = shingle_set(_words(t), size)
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64))
                sizes.append(len(own))
                fps.append(fingerprint(own))
                keys.append(own[:SKETCH].view(np.int64))
            digests = np.array(digests, dtype=np.int64).reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.empty(0, dtype=np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sizes, pa.int32()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), lists],
                names=["id", "h", "s", "t", "n", "fp", "keys"])

    return shared.map_batches(texts.select("id", "h", "text"), run, "id long, h long, s long, t long, n int, fp long, keys array<long>")


def sized(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it is small; it is counted, so it should be stored."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _sets(texts: DataFrame, prints: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``(node, members)`` of ``nodes(node)``, made again from the texts."""
    want = shared.checkpoint(prints.join(nodes.distinct(), "node", "left_semi").select("node", F.col("best.id").alias("i"), F.col("best.h").alias("g")))
    found = texts.join(sized(want), (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("i"))).select("node", "text")

    def run(batches):
        for b in batches:
            own = [shingle_set(_words(t), size) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "members"])

    return shared.materialise(shared.map_batches(found, run, "node long, members binary").dropDuplicates(["node"]), "shingle-sets")


def _verified(batches):
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            common = len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True))
            keep.append(bool(alike(common, (len(x) + len(y)) // 8)))
        yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, prints: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Of ``pairs(a, b)`` those that are near copies: sizes and sketches are compared
    first, by the low bits of their keys; the sets are fetched for what is left."""
    at = prints.select("node", "n", F.transform("keys", lambda k: (k.bitwiseAND(0xFFFF) - 0x8000).cast("short")).alias("m"))
    both = pairs.join(at.toDF("a", "na", "ma"), "a").join(at.toDF("b", "nb", "mb"), "b")
    near = (F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM) & (F.size(F.array_intersect("ma", "mb")) > F.least(spare(F.col("na")), spare(F.col("nb"))) - 2)
    left = shared.materialise(both.where(near).select("a", "b"), "likely-pairs")
    sets = _sets(texts, prints, left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))), size)
    full = left.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return shared.materialise(shared.map_batches(full, _verified, "a long, b long"), "near-pairs")


def _block(table: pa.Table) -> pa.Table:
    """Spanning edges of the links between two blocks, or within one."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    node, root, at = (table.column(c).to_pylist() for c in ("node", "root", "at"))
    sets = [np.frombuffer(m, dtype=np.uint64) for m in table.column("members").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    left = np.flatnonzero(np.array(at) == i)
    right = np.flatnonzero(np.array(at) == j)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # members of one set only are common to none
    row, shown = np.repeat(np.arange(len(sets)), sizes), count[column] > 1
    row, column = row[shown], number[column[shown]]
    common = np.zeros((len(left), len(right)))
    for lo in range(0, int((count > 1).sum()), _COLUMNS):
        part = (column >= lo) & (column < lo + _COLUMNS)
        dense = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        dense[row[part], column[part] - lo] = 1
        common += dense[left] @ dense[right].T
    link = alike(common, sizes[left][:, None] + sizes[right][None, :])
    forest, rows = shared.Forest(), []
    for a, b in zip(*np.nonzero(link)):
        a, b = left[a], right[b]
        if root[a] != root[b] and forest.join(root[a], root[b]):
            rows.append((node[a], node[b]))
    cols = list(zip(*rows)) if rows else ([], [])
    return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})


def meeting_keys(prints: DataFrame) -> DataFrame:
    """``(node, k)``: of every sketch the keys that other sketches have too, less the
    most frequent ones that near copies can do without."""
    keyed = prints.select("node", "n", F.explode("keys").alias("k"))
    met = shared.materialise(keyed.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "met")
    found = keyed.join(sized(met), "k").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "k"))).alias("met"))  # a sketch at most
    rarest = F.slice("met", 1, F.greatest(F.size("met") - spare(F.col("n")), F.lit(0)))
    return shared.materialise(found.select("node", F.explode(rarest).alias("m")).select("node", "m.k"), "met-nodes")


def fingerprint_pairs(prints: DataFrame, near_pairs) -> DataFrame:
    """``(a, b)`` of nodes that SimHash links: the first ones of linked fingerprints, and
    each other node with the first of its own fingerprint."""
    first = shared.checkpoint(prints.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("c")))
    same = prints.select("node", "fp").join(first.where("c > 1"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = near_pairs(first.select("fp"))
    across = links.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.union(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def components(prints: DataFrame, texts: DataFrame, size: int, near_pairs) -> DataFrame:
    """``(node, root)`` of the different sets ``prints(node, best, n, fp, keys)`` that are
    near copies of others, directly or by a chain."""
    members = meeting_keys(prints)
    keys = members.groupBy("k").agg(F.count("*").alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("c > 1")
    # of keys with the same texts one is enough
    keys = shared.checkpoint(keys.groupBy("x", "y", "c", "lo", "hi").agg(F.min("k").alias("k"), F.count("*").alias("times")))
    members = shared.materialise(members.join(sized(keys.select("k", "c", "lo", "hi", "times")), "k"), "met-nodes")

    lower = members.where("node <> lo").groupBy("node", "lo").agg(F.sum("times").alias("times"))
    closest = lower.groupBy("node").agg(F.max(F.struct("times", (-F.col("lo")).alias("o"))).alias("m")).select((-F.col("m.o")).alias("a"), F.col("node").alias("b"))
    first = shared.materialise(closest.union(fingerprint_pairs(prints, near_pairs)).distinct(), "pairs")
    found = shared.connected_components(verified(first, prints, texts, size))

    outer = _open(members, found).select("node", "root", F.explode(F.array("lo", "hi")).alias("o")).where("node <> o")
    ends = found.select(F.col("node").alias("o"), F.col("root").alias("other"))
    outer = outer.join(ends, "o", "left").where("root <> coalesce(other, o)").select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct()
    outer = shared.materialise(outer.join(first, ["a", "b"], "left_anti"), "pairs")
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(outer, prints, texts, size))
    found = shared.connected_components(edges)

    rest = shared.materialise(_open(members, found), "met-rest")
    few = rest.where(F.col("c") <= FEW)
    x, y = few.select("k", F.col("node").alias("a"), F.col("root").alias("ra")), few.select("k", F.col("node").alias("b"), F.col("root").alias("rb"))
    pairs = x.join(y, "k").where("a < b AND ra <> rb").select("a", "b").distinct().join(first.union(outer), ["a", "b"], "left_anti")
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(shared.materialise(pairs, "pairs"), prints, texts, size))

    # texts that are connected already need no test among themselves: those of a key's
    # largest component meet the others only
    hot = rest.where(F.col("c") > FEW)
    main = hot.groupBy("k", "root").agg(F.count("*").alias("held")).groupBy("k").agg(F.max(F.struct("held", (-F.col("root")).alias("r"))).alias("m"))
    hot = hot.join(sized(shared.checkpoint(main.select("k", "m.held", (-F.col("m.r")).alias("main")))), "k")
    hot = hot.withColumn("few", F.ceil((F.col("c") - F.col("held")) / BLOCK).cast("int")).withColumn("many", F.ceil(F.col("held") / BLOCK).cast("int"))
    inner, h = F.col("root") == F.col("main"), F.xxhash64("node")
    hot = hot.withColumn("at", F.when(inner, F.col("few") + F.pmod(h, "many")).otherwise(F.pmod(h, "few")).cast("int"))
    hot = hot.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(inner, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    dealt = hot.select("k", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "at", "node", "root")
    blocks = dealt.join(_sets(texts, prints, hot.select("node"), size), "node").groupBy("k", "i", "j").applyInArrow(_block, "a long, b long")
    return shared.connected_components(edges.union(shared.materialise(blocks, "block-pairs")))


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with their roots, of the keys whose texts are not all connected."""
    told = members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = shared.checkpoint(told.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("k"))
    return told.join(sized(mixed), "k")
