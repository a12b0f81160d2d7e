"""Token-id output in canonical length-limited Huffman code.

1. Every text is tokenised once; ids go to the shared folder.
2. Global counts of ids give code lengths of at most ``LIMIT`` bits (package-merge),
   which alone define the canonical code.
3. Documents in ascending id order are cut into independent blocks.  A block is a
   self-contained byte string::

       magic 'CHB1' | u8 limit | u32 documents | u64 first id's place in the whole
       output | u64 ids | u32 symbols in the code | u8 length per symbol, deflated
       (u32 size first) | u32 checkpoints | u64 bit offset per checkpoint |
       per document: i64 doc_id, u8 is-null, u32 ids | u64 payload bytes | payload

   Checkpoints give the bit offset of every ``STRIDE``-th id, so a block is decoded
   in that many lanes at once and any document can be reached without the ids before
   it.  Blocks are rows of a Parquet dataset, written by Spark's committer: a lost
   or repeated task leaves no partial file.
4. Decoding looks ``LIMIT`` bits up in a table that gives symbol and length."""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

LIMIT = 16
STRIDE = 512
#: Ids of a block; only a single longer document makes a larger one.
BLOCK_IDS = 1 << 20
#: Documents of a partition, and so many partitions at most.
PART_DOCS, PARTS = 8192, 50_000
MAGIC = b"CHB1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; zero for
    symbols that do not occur.  Plain Huffman lengths are taken where they fit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = [int(c) for c in counts[order]]
    n = len(leaf)
    taken: list[list[bool]] = []  # by level: which of its cheapest entries are leaves
    row = leaf
    for _ in range(limit - 1):
        pairs = [row[i] + row[i + 1] for i in range(0, len(row) - 1, 2)]
        merged = list(heapq.merge(((c, 0) for c in leaf), ((c, 1) for c in pairs)))
        taken.append([k == 0 for _, k in merged])
        row = [c for c, _ in merged]
    lengths, need = np.zeros(n, dtype=np.int64), 2 * (n - 1)
    for flags in reversed(taken):
        leaves = sum(flags[:need])
        lengths[:leaves] += 1
        need = 2 * (need - leaves)
    lengths[:need] += 1
    out[order] = lengths
    return out


class Code:
    """Canonical code: symbols in order of (length, id) take consecutive codes."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.limit = max(1, int(lengths.max(initial=1)))
        self.codes = np.zeros(len(lengths), dtype=np.uint32)
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        size = np.int64(1) << (self.limit - lengths[used].astype(np.int64))
        start = np.cumsum(size) - size
        self.codes[used] = (start >> (self.limit - lengths[used].astype(np.int64))).astype(np.uint32)
        self.symbol = np.zeros(1 << self.limit, dtype=np.uint32)
        self.length = np.ones(1 << self.limit, dtype=np.uint8)
        total = int(size.sum())
        self.symbol[:total] = np.repeat(used, size)
        self.length[:total] = np.repeat(lengths[used], size)

    def encode(self, ids: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
        """Bits, most significant first, and the bit offset of every ``stride``-th id."""
        if not len(ids):
            return b"", np.empty(0, dtype=np.uint64)
        n = self.lengths[ids].astype(np.int64)
        if n.min() == 0:
            raise ValueError("an id without a code")
        end = np.cumsum(n)
        start = end - n
        word, room = start >> 5, 64 - (start & 31) - n  # each code lies within two 32-bit words
        bits = self.codes[ids].astype(np.uint64) << room.astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.add.reduceat(bits, first)
        words = np.zeros(int(end[-1] + 31 >> 5) + 2, dtype=np.uint64)
        at = word[first]
        words[at] += sums >> np.uint64(32)
        words[at + 1] += sums & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes()[: int(end[-1] + 7 >> 3)], start[::stride].astype(np.uint64)

    def decode(self, data: bytes, n: int, offsets: np.ndarray, stride: int = STRIDE) -> np.ndarray:
        """All ``n`` ids, one lane per checkpoint."""
        if not n:
            return np.empty(0, dtype=np.uint32)
        lanes = len(offsets)
        raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from every byte on
        out = np.empty((stride, lanes), dtype=np.uint32)
        pos, drop, mask = offsets.astype(np.int64), np.uint32(32 - self.limit), np.uint32((1 << self.limit) - 1)
        last = n - (lanes - 1) * stride
        for k in range(min(stride, n)):
            if k == last and lanes > 1:  # the last lane has ended
                pos = pos[:-1]
            look = window[pos >> 3] >> (drop - (pos & 7).astype(np.uint32)) & mask
            out[k, : len(pos)] = self.symbol[look]
            pos = pos + self.length[look]
        return out.T.reshape(-1)[:n] if stride <= n else out[:n, 0]


def pack_block(code: Code, keys: list[int | None], counts: list[int], ids: np.ndarray, first: int) -> bytes:
    payload, checkpoints = code.encode(ids)
    table = zlib.compress(code.lengths.tobytes())
    directory = b"".join(struct.pack("<qBI", k or 0, k is None, n) for k, n in zip(keys, counts))
    return b"".join((
        MAGIC, struct.pack("<BIQQII", code.limit, len(keys), first, len(ids), len(code.lengths), len(table)), table,
        struct.pack("<I", len(checkpoints)), checkpoints.astype("<u8").tobytes(), directory, struct.pack("<Q", len(payload)), payload))


_CODES: dict[bytes, Code] = {}


def unpack_block(data: bytes) -> tuple[list[int | None], list[int], np.ndarray, int]:
    """``keys, counts, ids, first place`` of a block."""
    if data[:4] != MAGIC:
        raise ValueError("not a block of coded ids")
    _, docs, first, n, symbols, size = struct.unpack_from("<BIQQII", data, 4)
    at = 4 + struct.calcsize("<BIQQII")
    table = data[at : at + size]
    if table not in _CODES:
        _CODES.clear()
        _CODES[table] = Code(np.frombuffer(zlib.decompress(table), dtype=np.uint8, count=symbols))
    at += size
    (marks,) = struct.unpack_from("<I", data, at)
    offsets = np.frombuffer(data, dtype="<u8", count=marks, offset=at + 4)
    at += 4 + 8 * marks
    entries = list(struct.iter_unpack("<qBI", data[at : at + 13 * docs]))
    at += 13 * docs
    (size,) = struct.unpack_from("<Q", data, at)
    ids = _CODES[table].decode(data[at + 8 : at + 8 + size], n, offsets)
    return [None if null else k for k, null, _ in entries], [c for *_, c in entries], ids, first


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", cuts: np.ndarray | None = None) -> DataFrame:
    """``(id, n, ids, p)`` with little-endian ids of two bytes where the vocabulary
    allows; p is the number of the document's range between ``cuts``."""
    source = tokens.broadcast_tokenizer(docs.sparkSession, tokenizer_path)
    ranges = docs.sparkSession.sparkContext.broadcast(np.empty(0, dtype=np.int64) if cuts is None else cuts)  # PARTS numbers at most
    end = np.array([end_id], dtype="<u4").tobytes()
    wide = vocabulary(tokenizer_path, end_id) > 1 << 16

    def run(batches):
        for b in tokens.gathered(batches, 1):
            coded = [np.frombuffer(x + end, dtype="<u4") for x in tokens.encoder(source.value).encode(b.column(1))]
            packed = [c.tobytes() if wide else c.astype("<u2").tobytes() for c in coded]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(c) for c in coded], pa.int64()), pa.array(packed, pa.binary()), pa.array(range_of(b.column(0), packed, ranges.value), pa.int32())], names=["id", "n", "ids", "p"])

    return shared.map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, n long, ids binary, p int")


_NULL = -(1 << 63)


def id_cuts(ids: DataFrame, parts: int) -> np.ndarray:
    """Upper ends of ranges with about equally many ``ids(id)``, null as the least; an id
    of more rows than a range takes is the end of several."""
    if parts < 2:
        return np.empty(0, dtype=np.int64)
    cuts = ids.agg(F.percentile_approx(F.coalesce("id", F.lit(_NULL)), [i / parts for i in range(1, parts)], min(100 * parts, 1_000_000))).first()[0]
    return np.array(cuts or [], dtype=np.int64)


def range_of(ids: pa.Array, packed: list[bytes], cuts: np.ndarray) -> np.ndarray:
    """Range per row; rows of an id that ends several are dealt to all of these."""
    keys = ids.fill_null(_NULL).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
    for i in np.flatnonzero(high - low > 1):
        low[i] += zlib.crc32(packed[i]) % (high[i] - low[i])
    return low


def vocabulary(tokenizer_path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)


def _kind(size: int) -> str:
    return "<u4" if size > 1 << 16 else "<u2"


def count_ids(coded: DataFrame, size: int) -> np.ndarray:
    """Global counts, summed per partition before the shuffle; as long as the vocabulary."""

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, dtype=_kind(size)), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["token", "n"])

    rows = shared.map_batches(coded.select("ids"), _joined(run), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # bounded by the vocabulary
    counts = np.zeros(size, dtype=np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    return counts


def _joined(run):
    """Concatenate a batch's ids first: one count per batch instead of one per document."""

    def joined(batches):
        return run(pa.RecordBatch.from_arrays([pa.array([b"".join(b.column(0).to_pylist())], pa.binary())], names=["ids"]) for b in batches)

    return joined


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", docs_per_part: int = PART_DOCS) -> None:
    """Write all ids of ``docs`` in ascending id order as coded blocks to ``path``.

    Nulls: a null text is an empty one; null ids come first.  Repeated ids stand
    side by side.  A very long text is a block of its own.  An empty table gives an
    empty dataset.  Other columns are ignored, whatever their names."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    parts = min(max(1, -(-ids.count() // docs_per_part)), PARTS)
    cuts = id_cuts(ids, parts)
    with shared.scratch(docs.sparkSession, "token-ids"):
        _write_coded(shared.materialise(tokenise(docs, tokenizer_path, end_id, id_col, text_col, cuts), "ids"), vocabulary(tokenizer_path, end_id), len(cuts) + 1, path)


def _write_coded(coded: DataFrame, size: int, parts: int, path: str) -> None:
    lengths = code_lengths(count_ids(coded, size))
    totals = dict(coded.groupBy("p").agg(F.sum("n")).collect())  # a row per range
    first = np.cumsum([0, *[totals.get(p, 0) for p in range(parts)]]).tolist()
    placed = coded.repartitionById(parts, F.col("p")).sortWithinPartitions("p", F.col("id").asc_nulls_first(), "n", F.xxhash64("ids")).select("id", "n", "ids", "p")

    def run(batches):
        code, keys, counts, held, have, place, at = Code(lengths), [], [], [], 0, 0, None
        for b in batches:
            for key, n, x, p in zip(*(c.to_pylist() for c in b.columns)):
                if p != at or have >= BLOCK_IDS:
                    if keys:
                        yield from _block(code, keys, counts, held, place, size)
                    place = place + have if p == at else first[p]
                    keys, counts, held, have, at = [], [], [], 0, p
                keys.append(key), counts.append(n), held.append(x)
                have += n
        if keys:
            yield from _block(code, keys, counts, held, place, size)

    shared.map_batches(placed, run, "first long, block binary").write.option("compression", "none").parquet(path)


def _block(code: Code, keys, counts, held, place: int, size: int):
    ids = np.frombuffer(b"".join(held), dtype=_kind(size))
    yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([pack_block(code, keys, counts, ids, place)], pa.binary())], names=["first", "block"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids)`` per document, decoded from the files; ids as
    little-endian unsigned 32-bit."""
    return shared.map_batches(spark.read.schema("first long, block binary").parquet(path), _decoding(lambda x: x.tobytes(), pa.binary()), "id long, start long, n_tokens long, ids binary")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` per document, decoded from the files."""
    return shared.map_batches(spark.read.schema("first long, block binary").parquet(path), _decoding(lambda x: zlib.crc32(x), pa.int64(), "ids_crc32"), "id long, start long, n_tokens long, ids_crc32 long")


def _decoding(last, kind, name: str = "ids"):
    def run(batches):
        for b in batches:
            for data in b.column(1):
                keys, counts, ids, first = unpack_block(data.as_py())
                ends = np.cumsum(counts)
                starts = ends - counts
                ids = np.ascontiguousarray(ids, dtype="<u4")
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(counts, pa.int64()), pa.array([last(ids[i:j]) for i, j in zip(starts, ends)], kind)], names=["id", "start", "n_tokens", name])

    return run
