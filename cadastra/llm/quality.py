"""Text quality by a factorisation machine.

Features of a whole text: its hashed words and word shapes (weighted by the square
root of their share), structure statistics and metadata (the recorded length against
the real one).  The score is the sigmoid of

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

so all pairwise interactions cost time linear in the features.  The model is fitted
on the driver by mini-batches of AdaGrad on at most ``TRAIN_ROWS`` labelled rows, the
ones with the smallest hash of their id; scoring covers every row in one pass."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bound of the labelled sample that the model is fitted on.
TRAIN_ROWS = 12_000
WORD_BUCKETS = 1 << 13
SHAPE_BUCKETS = 1 << 10
RANK = 6
#: Passes over the sample; a small one is passed over more often, for as many steps.
EPOCHS, STEPS = 6, 600
BATCH = 128
THRESHOLD = 0.7
#: A labelled row whose crc32(id) mod FOLDS is HELD_OUT is not learnt from.
FOLDS, HELD_OUT = 4, 2
STATISTICS = 21
SIZE = WORD_BUCKETS + SHAPE_BUCKETS + STATISTICS

#: Words kept in a worker's memo before it starts anew.
MEMO_WORDS = 250_000
_CLASSES = np.zeros(256, dtype=np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 plain punctuation, 6 symbols, 7 beyond ASCII
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58], _CLASSES[128:] = 1, 2, 3, 7
_CLASSES[[9, 10, 11, 12, 13, 32]] = 4
_CLASSES[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASSES[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6


def _word(word: str) -> tuple[int, int, int]:
    """Bucket of the word, bucket of its shape, whether it ends like a word of prose."""
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", re.sub(r"\d", "0", word)))
    return (
        xxhash.xxh32_intdigest(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS,
        WORD_BUCKETS + xxhash.xxh32_intdigest(shape.encode("utf-8", "surrogatepass"), 1) % SHAPE_BUCKETS,
        int(word[-1].isalpha()),
    )


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the features that are not zero."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    memo = shared.only_memo("quality", dict)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    for w in counts:
        if w not in memo:
            memo[w] = _word(w)
    total = len(words)
    stat = np.zeros(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    stat[0] = 1.0
    stat[1] = math.log1p(len(text)) / 10
    stat[2] = math.log1p(total) / 10
    stat[3] = n_chars is None or n_chars < 0
    stat[4] = 0.0 if stat[3] else min(1.0, abs(n_chars - len(text)) / (len(text) + 1))
    if not total:
        stat[5] = 1.0
        used = np.flatnonzero(stat)
        return (WORD_BUCKETS + SHAPE_BUCKETS + used).astype(np.int32), stat[used].astype(np.float32)
    rows = np.array([memo[w] for w in counts], dtype=np.int64)
    n = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    kinds = np.bincount(_CLASSES[raw], minlength=8) / len(raw)
    stat[6:14] = kinds
    stat[14] = len(counts) / total
    stat[15] = n.max() / total
    stat[16] = float(rows[:, 2] @ n) / total
    stat[17] = min(4.0, len(text) / total / 6) / 2
    lines = [x for x in text.split("\n") if x.strip()]
    stat[18] = 1 - len(set(lines)) / max(1, len(lines))
    stat[19] = min(1.0, len(lines) / total * 5)
    stat[20] = sum(map(eq, words, islice(words, 1, None))) / total
    bag = np.zeros(WORD_BUCKETS + SHAPE_BUCKETS)
    np.add.at(bag, rows[:, 0], n)
    np.add.at(bag, rows[:, 1], n)
    used = np.flatnonzero(bag)
    weight = np.sqrt(bag[used] / total)
    weight[used < WORD_BUCKETS] *= 0.5
    flags = np.flatnonzero(stat)
    return np.concatenate([used, WORD_BUCKETS + SHAPE_BUCKETS + flags]).astype(np.int32), np.concatenate([weight, stat[flags]]).astype(np.float32)


class Machine:
    """w0, w and V; without labelled rows all are zero and every score is a half."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        part = self.v[index] * value[:, None]
        pair = 0.5 * float((part.sum(axis=0) ** 2).sum() - (part * part).sum())
        z = self.w0 + float(self.w[index] @ value) + pair
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK))
    if not rows:
        return Machine(0.0, w, np.zeros((SIZE, RANK)))
    labels = np.array([y for *_, y in rows], dtype=np.float64)
    share = min(max(labels.mean(), 0.5 / (len(rows) + 1)), 1 - 0.5 / (len(rows) + 1))
    w0 = math.log(share / (1 - share))
    gw, gv, g0, rate, decay = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3), 1e-3, 0.1, 1e-5
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)) if len(rows) < STEPS * BATCH // EPOCHS else 0)):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = order[at : at + BATCH]
            index = np.concatenate([rows[i][0] for i in pick])
            value = np.concatenate([rows[i][1] for i in pick]).astype(np.float64)
            size = np.array([len(rows[i][0]) for i in pick])
            start = np.cumsum(size) - size
            part = v[index] * value[:, None]
            sums = np.add.reduceat(part, start)
            z = w0 + np.add.reduceat(w[index] * value, start) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((part * part).sum(axis=1), start))
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]
            each = np.repeat(err, size) * value / len(pick)
            used, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, weights=each) + decay * w[used]
            slope = np.repeat(sums, size, axis=0) - part
            dv = np.stack([np.bincount(back, weights=each * slope[:, f]) for f in range(RANK)], axis=1) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            g0 += (err.mean()) ** 2
            w0 -= rate * err.mean() / math.sqrt(g0)
    return Machine(w0, w, v)


def fold_of(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS, F.lit(-1))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", label_col: str = "quality") -> Machine:
    """Fit on labelled rows outside the held-out fold.  Rows labelled more than once
    take the mean label, halves count as 1; null labels and ids are left out."""
    told = labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    told = told.where(fold_of(F.col("k")) != HELD_OUT).groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    sample = told.orderBy(F.xxhash64("k"), "k").limit(TRAIN_ROWS)
    chars = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text"), chars.alias("n")).join(F.broadcast(sample), "k")  # TRAIN_ROWS keys at most

    def run(batches):
        for b in batches:
            made = [features(t, n) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary())], names=["k", "y", "i", "x"])

    found = shared.map_batches(rows.select(F.col("k").cast("long").alias("k"), "text", "n", "y"), run, "k long, y int, i binary, x binary")
    kept = found.orderBy(F.xxhash64("k"), "k", "i", "x").limit(TRAIN_ROWS).collect()  # bounded
    return fit([(np.frombuffer(r["i"], dtype=np.int32), np.frombuffer(r["x"], dtype=np.float32), r["y"]) for r in kept])


def with_score(docs: DataFrame, machine: Machine, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``row`` and ``score`` of every row (see ``shared.annotate``)."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # SIZE x (RANK + 1) numbers
    names = [text_col, chars_col] if chars_col in docs.columns else [text_col]

    def fn(columns):
        texts = columns[0].to_pylist()
        chars = columns[1].to_pylist() if len(columns) > 1 else [None] * len(texts)
        return [pa.array([model.value.score(*features(t, n)) for t, n in zip(texts, chars)], pa.float64())]

    return shared.annotate(docs, names, fn, "score double")


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``(id, held_out, score, predicted)`` per row.

    Nulls: a null text is an empty one, which has a score like any other; a null id
    is not held out; a null length is a feature of its own.  Without labelled rows
    every score is 0.5.  Very long texts are scored whole.  Repeated rows get equal
    scores; an empty table gives no rows; other columns are ignored, whatever their names."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")).alias("n_chars"))
    machine = train(docs, labels, id_col, text_col, chars_col)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for b in batches:
            found = [model.value.score(*features(t, n)) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    out = shared.map_batches(slim, run, "id long, score double")
    return out.select("id", (fold_of(F.col("id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
