"""Benchmark decontamination: which documents contain which test items.

Size-partitioned MinHash containment search.  A test item is far shorter than many
documents, so the resemblance of both is tiny and only *containment* of the item's
word shingles tells.  Items are partitioned by size (powers of two of their number
of different shingles).  Each partition has its own sketch length: the
``floor((1 - threshold) * upper size) + 1`` smallest MinHash values of an item.  At
most ``floor((1 - threshold) * n)`` of an item's n shingles may be missing at the
threshold, so at least one value of its sketch occurs in any document that contains
it: the search loses nothing.  Documents stream past the sketches, one pass, no
shuffle; candidates are verified by exact containment of the words themselves.

The benchmark is fixed beside the corpus, but its size is checked all the same: it
is cut into blocks of at most ``BLOCK_BYTES`` of text, and the documents are searched
for one block after the other."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_BYTES = 32 << 20
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 18
#: Words kept in a worker's memo before it starts anew.
MEMO_WORDS = 300_000


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; case and punctuation do not count."""
    return _WORD.findall(text.lower()) if text else []


def shingle_hashes(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """64-bit hash of every shingle in text order, from memoised word hashes."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    memo = shared.only_memo("decontaminate", dict)
    try:
        codes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        codes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        h ^= codes[i : i + n]
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def grams(words: list[str], size: int) -> set[tuple[str, ...]]:
    """Different runs of ``size`` words."""
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else set()


class Sketches:
    """A block of items as sorted arrays: shingle hashes of each, sketch values and their
    owners, and the texts for the exact check; measured at nine times the text while it is built.  Items of
    fewer words than a shingle are indexed apart, by their own length."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = SHINGLE, threshold: float = THRESHOLD, inside: bool = True):
        self.threshold, self.size = threshold, size
        lengths: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for key, text in items:
            if words := words_of(text):
                lengths[min(size, len(words))].append((key, " ".join(words)))
        self.parts = [_Part(n, found, threshold, inside or n == size) for n, found in sorted(lengths.items())]

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item, shingles, shingles found)`` of the items that the text contains."""
        words = words_of(text)
        return [hit for part in self.parts for hit in part.search(words)] if words else []


class _Part:
    """Items of one shingle length; if not ``inside``, only as whole texts."""

    def __init__(self, size: int, items: list[tuple[int, str]], threshold: float, inside: bool):
        self.size, self.threshold, self.inside = size, threshold, inside
        self.keys, self.texts = [i[0] for i in items], [i[1] for i in items]
        need = [np.unique(shingle_hashes(text.split(" "), size)) for text in self.texts]
        cut = []
        for h in need:
            upper = 1 << (len(h) - 1).bit_length()
            cut.append(h[: math.floor((1 - threshold) * upper + 1e-9) + 1])
        self.need = np.concatenate(need)
        self.start = np.cumsum([0, *map(len, need)])
        sketch, owner = np.concatenate(cut), np.repeat(np.arange(len(items), dtype=np.int32), list(map(len, cut)))
        order = np.argsort(sketch, kind="stable")
        self.owner = owner[order]
        self.values, self.first = np.unique(sketch[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.values >> np.uint64(64 - _FILTER_BITS)] = True

    def search(self, words: list[str]) -> list[tuple[int, int, int]]:
        if len(words) < self.size or not self.inside and len(words) > self.size:
            return []
        every = shingle_hashes(words, self.size)
        h = every[self.filter[every >> np.uint64(64 - _FILTER_BITS)]]
        at = np.searchsorted(self.values, h)
        at[at == len(self.values)] = 0
        hit = np.unique(at[self.values[at] == h])
        if not len(hit):
            return []
        every = np.unique(every)
        own, out = None, []
        for i in np.unique(np.concatenate([self.owner[self.first[k] : self.first[k + 1]] for k in hit])):
            need = self.need[self.start[i] : self.start[i + 1]]
            near = np.minimum(np.searchsorted(every, need), len(every) - 1)
            if np.count_nonzero(every[near] == need) < self.threshold * len(need) - 1e-9:
                continue
            own = grams(words, self.size) if own is None else own
            exact = grams(self.texts[i].split(" "), self.size)
            have = len(exact & own)
            if have >= self.threshold * len(exact) - 1e-9:
                out.append((self.keys[i], len(exact), have))
        return out


def contained_items(docs: DataFrame, bench: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, item_id, shingles, found, containment)`` per document row and item
    whose different shingles it contains to at least ``threshold``.

    Nulls: texts that are null or without words contain nothing and are contained
    in nothing; null ids are carried.  An item of fewer words than a shingle is found
    wherever its words follow each other in a document.  Very long texts are hashed whole.
    Repeated documents give repeated rows; repeated benchmark rows count once.  Ties
    do not matter.  Empty tables give no rows.  Other columns are ignored."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = bench.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    out = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(Sketches([tuple(r) for r in part.collect()], size, threshold))  # at most one block of text
        found = shared.map_batches(texts, _searching(index), "id long, item_id long, shingles int, found int")
        out = found if out is None else out.union(found)
    return out.withColumn("containment", F.col("found") / F.col("shingles"))


def _searching(index):
    def run(batches):
        sketches = index.value
        for b in batches:
            rows = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in sketches.search(t)]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["id", "item_id", "shingles", "found"])

    return run


#: DuckDB SQL of the query: exact containment of every item in every document.
ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, w, least(len(w), 5) AS l FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0),
ds AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i+l-1], ' '))) AS s
    FROM dw, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l),
sh AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i+l-1], ' '))) AS s FROM iw),
sizes AS (SELECT item_id, count(*) AS n FROM sh GROUP BY item_id)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS shingles, CAST(count(DISTINCT ds.s) AS INTEGER) AS found, count(DISTINCT ds.s) / CAST(n AS DOUBLE) AS containment
FROM ds JOIN sh USING (s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n HAVING count(DISTINCT ds.s) >= 0.8 * n - 1e-9
"""


def without_items(docs: DataFrame, bench: DataFrame, text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, item_text_col: str = "text", short_anywhere: bool = True) -> DataFrame:
    """The rows of ``docs`` that contain no item.

    Nulls: null texts, of documents or items, contain nothing and are contained in
    nothing; null ids are carried.  Very long texts are hashed whole; repeated rows stay or
    go together; ties do not matter; an empty benchmark keeps every row, an empty table
    gives none; extra columns stay, whatever their names.  An item of fewer words than a
    shingle, a name or a number, drops the documents in which its words follow each other;
    without ``short_anywhere`` only those that consist of it."""
    spark = docs.sparkSession
    items = bench.select(F.col(item_text_col).cast("string").alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(Sketches([(i, r["text"]) for i, r in enumerate(part.collect())], size, threshold, inside=short_anywhere))  # at most one block of text
        found = shared.annotate(docs, [text_col], _hits(index), "hits int")
        docs = shared.restore(found.where("hits = 0"), docs)
    return docs


def _hits(index):
    return lambda columns: [pa.array([len(index.value.search(t)) for t in columns[0].to_pylist()], pa.int32())]
