"""SimHash near-dedup by multi-index hashing.

Fingerprints are computed in one pass over the texts (Arrow batches, NumPy bit
counts).  The search then works on *distinct* fingerprints only, so exact copies
cost nothing.  Every fingerprint is cut into segments; by the pigeonhole rule of
multi-index hashing two fingerprints within ``radius`` bits agree, in at least one
segment, up to that segment's own small radius.  Each fingerprint enumerates the
Hamming ball of its segment values, fetches the table rows with those values by an
equi-join and verifies the complete distance.

Buckets that hold very many different fingerprints would make that join quadratic.
Pairs with both ends in such hot buckets are found exactly in another way instead:
two 64-bit values differ in at most two bits if and only if some value is within
one bit of both, so grouping the 65 values of each hot fingerprint's one-bit ball
links precisely the pairs wanted, and no group can hold more than 65 fingerprints."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, similar

SEED = 42
#: A segment bucket with more distinct fingerprints than this is searched by ball keys.
HOT_BUCKET = 48
BITS = 64
_ROWS = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z only, words split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined shingles, repeats included; fewer words give the whole sequence."""
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprint(text: str | None, size: int) -> int:
    """64-bit SimHash as an unsigned integer; zero without words."""
    found = shingles_of(words_of(text), size)
    n = len(found)
    if not n:
        return 0
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), dtype="<u8", count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero without any."""
    n = len(hashes)
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, _ROWS):
        part = hashes[i : i + _ROWS].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id, fp)`` per row, fp as a signed 64-bit value."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], names=["id", "fp"])

    return shared.map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, fp long")


def segments(radius: int, parts: int) -> list[tuple[int, int, int]]:
    """``(shift, width, radius)`` per segment: of ``radius = a*parts + r`` the first
    r+1 segments search balls of radius a, the others of a-1 (none if negative)."""
    a, r = divmod(radius, parts)
    cut = [BITS * i // parts for i in range(parts + 1)]
    return [(lo, hi - lo, a if i <= r else a - 1) for i, (lo, hi) in enumerate(zip(cut, cut[1:])) if (a if i <= r else a - 1) >= 0]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _ball(value: Column, width: int, radius: int) -> Column:
    """Values reached by setting up to ``radius`` zero bits, with themselves; of two
    values that differ in one bit only one sets it, so each pair is met once."""
    masks = [0]
    if radius >= 1:
        masks += [1 << i for i in range(width)]
    if radius >= 2:
        masks += [1 << i | 1 << j for i in range(width) for j in range(i)]
    if radius > 2:
        raise ValueError("balls of radius over 2 are not enumerated")
    every = F.array(*[F.lit(m).cast("long") for m in masks])
    if radius <= 1:
        every = F.filter(every, lambda m: value.bitwiseAND(m) == 0)
    return F.transform(every, lambda m: value.bitwiseXOR(m))


def near_pairs(nodes: DataFrame, radius: int = 2, parts: int = 2) -> DataFrame:
    """Edges ``(a, b)`` over distinct fingerprints ``nodes(fp)``: every pair within
    ``radius`` bits, but for pairs inside one hot bucket only edges enough to
    connect them (radius 2 at most there)."""
    if radius > 2:
        raise ValueError("hot buckets are searched exactly up to radius 2")
    if radius == 0:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    edges, hot_nodes = [], []
    for shift, width, r in segments(radius, parts):
        seg = _segment(F.col("fp"), shift, width)
        keyed = nodes.select("fp", seg.alias("s"))
        hot = keyed.groupBy("s").count().where(F.col("count") > HOT_BUCKET).select("s", F.lit(True).alias("h"))
        marked = shared.checkpoint(keyed.join(hot, "s", "left").select("fp", "s", F.coalesce("h", F.lit(False)).alias("h")))
        hot_nodes.append(marked.where("h").select("fp"))
        table = marked.select(F.col("s").alias("k"), F.col("fp").alias("t"), F.col("h").alias("th"))
        probe = marked.select("fp", "s", "h", F.explode(_ball(F.col("s"), width, r)).alias("k"))
        near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("t"))) <= radius) & (F.col("fp") != F.col("t"))
        if r != 1:
            near = near & (F.col("fp") < F.col("t"))
        else:
            near = near & ((F.col("k") != F.col("s")) | (F.col("fp") < F.col("t")))
        for p, t in ((probe.where("NOT h"), table), (probe.where("h"), table.where("NOT th"))):
            edges.append(p.join(t, "k").where(near).select(F.col("fp").alias("a"), F.col("t").alias("b")))
    hot = hot_nodes[0]
    for other in hot_nodes[1:]:
        hot = hot.union(other)
    edges.append(ball_edges(hot.distinct(), radius))
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def ball_edges(nodes: DataFrame, radius: int) -> DataFrame:
    """Star edges among the fingerprints that share a value within one bit (radius 2)
    or between a fingerprint and one a bit away (radius 1)."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in (1 << i for i in range(BITS))])
    keyed = nodes.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("k"))
    groups = keyed.groupBy("k").agg(F.collect_set("fp").alias("g")).where(F.size("g") > 1)
    pairs = groups.select(F.array_min("g").alias("a"), F.explode("g").alias("b")).where("a <> b")
    return pairs if radius == 2 else pairs.where("false").union(
        groups.select("k", F.explode("g").alias("b")).where("k <> b").join(nodes.select(F.col("fp").alias("k")), "k").select(F.col("k").alias("a"), "b"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, parts: int = 2) -> DataFrame:
    """``(id, fp, component)`` per row of ``docs``.

    component is the smallest id reachable over links of at most ``radius`` bits
    between fingerprints, the row's own id included.

    Nulls: a null or blank text has fingerprint zero and links like any other; a row
    with a null id keeps its fingerprint and gets the smallest id that is not null of
    its component, or null if there is none.  Repeated rows and ids stay repeated.
    Ties do not arise, a minimum decides.  Empty tables give empty results.  Other
    columns are ignored, whatever their names."""
    fps = shared.materialise(fingerprints(docs, id_col, text_col, size), "simhash")
    nodes = shared.checkpoint(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("rows")))
    connected = shared.connected_components(near_pairs(nodes.select("fp"), radius, parts))
    comp = connected.join(nodes.withColumnRenamed("fp", "node"), "node")
    lowest = shared.checkpoint(comp.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("rows")))
    linked = shared.join_unique(connected, lowest.drop("rows"), ["root"], lowest, ["node"]).select(F.col("node").alias("fp"), "component")
    own = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "low").alias("component"))
    return shared.join_unique(fps, own, ["fp"], nodes, ["id"]).select("id", "fp", "component")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """The columns of ``docs`` for one row of each group of near copies: the row with
    the smallest id (null ids last; of repeated rows one).

    Rows group if the Jaccard similarity of their sets of ``size``-word shingles is 0.8
    or more, directly or by a chain.  Fingerprints of the sets within two bits are the
    first candidates; at 0.8 some 15 % of the bits of a fingerprint differ, so the search
    goes on over sketches of the sets (see ``similar``), and every link is verified on
    whole sets.  Null texts and texts without words form one group.  An empty table
    stays empty; extra columns stay, whatever their names."""
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(key.alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    with shared.scratch(docs.sparkSession, "near-copies"):
        coded = shared.materialise(similar.coded(texts, size, majority), "shingled")
        rank = F.struct(F.col("id").isNull().alias("none"), "id", "h")
        prints = coded.groupBy("s", "t").agg(F.min(rank).alias("best"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")])
        # numbered in order of rank, so the smallest number of a group is its best row
        prints = shared.materialise(prints.orderBy("best").withColumn("node", F.monotonically_increasing_id()), "shingled-sets")
        linked = similar.components(prints, texts, size, near_pairs)
        beaten = linked.where("node <> root").select("node")
        keepers = shared.checkpoint(prints.select("node", "best").join(beaten, "node", "left_anti").select(F.col("best.id").alias("i"), F.col("best.h").alias("g")))
        rows = coded.groupBy("id", "h").agg(F.count("*").alias("n")).join(keepers, (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("i")), "left")
        fate = shared.checkpoint(rows.select("id", "h", F.col("g").isNotNull().alias("keep"), "n").where("NOT keep OR n > 1"))
    return _without(docs, fate, id_col, text_col)


#: So many removed rows at most are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, fate: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` less the rows in ``fate(id, h, keep, n)`` that go, and one of each kept
    row that is repeated."""
    gone, repeated = fate.where("NOT keep").select("id", "h"), fate.where("keep").select("id", "h")
    h = "_h"
    while h in docs.columns:
        h += "_"
    told = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    some = fate.agg(F.sum(F.when(F.col("keep"), 0).otherwise(1)), F.sum(F.when(F.col("keep"), 1).otherwise(0))).first()

    def sized(df: DataFrame, n: int | None) -> DataFrame:
        return F.broadcast(df) if (n or 0) <= BROADCAST_ROWS else df

    def same(df: DataFrame) -> Column:
        return (told[h] == df["h"]) & told[id_col].cast("long").eqNullSafe(df["id"])

    either = gone.union(repeated)
    out = told.join(sized(either, (some[0] or 0) + (some[1] or 0)), same(either), "left_anti")
    if some[1]:
        twice = told.join(sized(repeated, some[1]), same(repeated), "left_semi")
        out = out.union(twice.dropDuplicates([id_col, h]))
    return out.drop(h)
