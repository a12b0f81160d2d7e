"""Best-fit packing of tokenised documents into sequences of fixed length.

Hierarchical residual packing.  Round 0 tokenises a partition, cuts long documents
into pieces and packs the pieces best-fit decreasing; bins that are nearly full leave
at once.  Underfull bins travel on as single items (a bin's number and its fill, no
tokens): each round deals them to fewer groups, a tree of merges; each merge packs bins
best-fit again and lets nearly full ones go, until one group is left or groups are full.
Every round is written to the shared folder, so a lost executor costs one round's
tasks at most and no order of rows can change a placement already made."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, tokens

#: A bin with at most this share of its room left is not merged further.
NEARLY_FULL = 0.002
#: Groups merged into one in each round.
FAN_IN = 16
#: Bins of a group on average, so that a task can hold it; more keep more groups.
BINS_PER_TASK = 200_000


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` per item, best fit in order of falling size (ties: given
    order).  Open bins stand in lists by room left; one integer's bits tell which
    rooms exist, so the tightest bin is found by a shift."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms, bins = 0, 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room, bins = bins, capacity, bins + 1
        placed[i] = (b, capacity - room)
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return placed


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)``; only longer documents are cut, the first piece takes the rest."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    cuts = ([0] if head else []) + list(range(head, n, capacity))
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], n])]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its tokens and ``end_id``.  Nulls: a null text is an empty one (its
    piece is ``end_id`` alone); a row with a null id is packed like any other.
    Repeated rows are packed each by itself.  Ties are packed in the order read; the
    number of sequences depends only on sizes and partitions.  Very long texts are
    encoded whole and cut.  An empty table gives no rows.  Other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    source = tokens.broadcast_tokenizer(spark, tokenizer_path)
    slack = int(capacity * NEARLY_FULL)
    end = np.array([end_id], dtype="<u4").tobytes()

    def first_round(batches):
        ids, piece, start, length, crc = [], [], [], [], []
        for b in batches:  # not gathered: packing leaves a worker less memory
            keys = b.column(0).to_pylist()
            for key, coded in zip(keys, tokens.encoder(source.value).encode(b.column(1))):
                coded += end
                for k, (at, n) in enumerate(pieces_of(len(coded) // 4, capacity)):
                    ids.append(key), piece.append(k), start.append(at), length.append(n)
                    crc.append(zlib.crc32(coded[4 * at : 4 * (at + n)]))
        if not ids:
            return
        placed = np.array(best_fit(length, capacity), dtype=np.int64)
        home = TaskContext.get().partitionId()
        fill = np.bincount(placed[:, 0], weights=length).astype(np.int64)[placed[:, 0]]
        table = pa.table({
            "id": pa.array(ids, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()), "bin": placed[:, 0] + (home << 32), "offset": placed[:, 1], "fill": fill})
        yield from table.to_batches(max_chunksize=10_000)

    items = shared.map_batches(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), first_round,
        "id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long")
    items = shared.materialise(items, "pack0")
    moved = merge_bins(items.where(F.col("fill") < capacity - slack).groupBy("bin").agg(F.first("fill").alias("fill")), capacity, slack)
    if moved is not None:
        items = items.join(moved, "bin", "left")
    else:
        items = items.withColumn("parent", F.lit(None).cast("long")).withColumn("shift", F.lit(0).cast("long"))
    return items.select(
        "id", "piece", "start", "length", "ids_crc32",
        F.coalesce("parent", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def merge_bins(bins: DataFrame, capacity: int, slack: int) -> DataFrame | None:
    """``(bin, parent, shift)`` of the underfull bins that were merged with others."""
    members = "array<struct<bin:long,shift:long>>"
    level = shared.checkpoint(bins.select("bin", "fill", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).cast(members).alias("members")))
    left, top = level.agg(F.count("*"), F.max(F.shiftright("bin", 32))).first()
    groups, done = (top or 0) + 1, []
    while left:
        now = max(-(-groups // FAN_IN), -(-left // BINS_PER_TASK))
        merged = dealt(level, now)
        merged = shared.checkpoint(shared.map_batches(_tuples(merged), _pack_level(capacity), f"bin long, fill long, members {members}"))
        if now == 1 or now >= groups:
            done.append(merged)
            break
        done.append(merged.where(F.col("fill") >= capacity - slack))
        level = merged.where(F.col("fill") < capacity - slack)
        left, groups = level.count(), now
    if not done:
        return None
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select(F.col("bin").alias("parent"), F.explode("members").alias("m")).select("m.bin", "parent", "m.shift").where("bin <> parent OR shift <> 0")


def dealt(bins: DataFrame, groups: int) -> DataFrame:
    """``bins`` in so many partitions of about equal size."""
    return bins.repartitionById(groups, F.pmod(F.xxhash64("bin"), F.lit(groups)).cast("int"))


def _tuples(df: DataFrame) -> DataFrame:
    return df.select("bin", "fill", F.col("members.bin").alias("m"), F.col("members.shift").alias("s"))


def _pack_level(capacity: int):
    def run(batches):
        bins, fills, members = [], [], []
        for b in batches:
            bins += b.column(0).to_pylist()
            fills += b.column(1).to_pylist()
            members += [list(zip(m, s)) for m, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        order = sorted(range(len(bins)), key=bins.__getitem__)  # the same whatever order the shuffle gave
        placed = best_fit([fills[i] for i in order], capacity)
        name: dict[int, int] = {}
        fill: dict[int, int] = defaultdict(int)
        inside: dict[int, list] = defaultdict(list)
        for i, (b, off) in zip(order, placed):
            name.setdefault(b, bins[i])
            fill[b] += fills[i]
            inside[b] += [{"bin": m, "shift": s + off} for m, s in members[i]]
        kind = pa.list_(pa.struct([("bin", pa.int64()), ("shift", pa.int64())]))
        for at in range(0, len(name), 5000):
            part = list(name)[at : at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([name[b] for b in part], pa.int64()), pa.array([fill[b] for b in part], pa.int64()), pa.array([inside[b] for b in part], kind)], names=["bin", "fill", "members"])

    return run
