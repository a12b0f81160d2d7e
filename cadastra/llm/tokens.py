"""Whole-text tokenisation with a word memo.

A public tokenizer's file is read once on the driver and its text (a few MB, fixed
by the vocabulary) is broadcast, so executors need no file.  Invented or natural
prose repeats its words; both supported pre-tokenizers treat a space-delimited chunk
the same wherever it stands, so every distinct chunk goes through the library once
and later occurrences are looked up, once for some megabytes of text.  Texts with chunks for which that is not
certain (runs of white space, other white space than space and line feed) are
encoded whole by the library itself."""

from __future__ import annotations

import codecs
import json
import os
import re
import string
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from . import shared

#: Chunks kept in a worker's memo, half of them in each of two generations.
MEMO_CHUNKS = 700_000
PUNCTUATION = string.punctuation
#: Bytes of text that are looked up together, and texts whose ids are put together at once.
TEXT_BYTES, TEXTS = 8 << 20, 100


#: Byte-level BPE writes bytes that are no printable Latin-1 characters as those from U+0100 on.
ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}

#: The alphabet by byte, line feeds apart.
LINES = "".join(chr(ALPHABET.get(b, b)) if b != 10 else "\n" for b in range(256))
#: Letters that normalisation may change in other ways than by case.
FAR = re.compile("[\u0180-\U0010ffff]")


class ChunkEncoder:
    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.model = self.tokenizer.model
        if forget := getattr(self.model, "_resize_cache", None):
            forget(0)  # the memo stands before the library's own, which only costs then
        self.mode = mode_of(json.loads(source))
        self.memo: dict[str, bytes | bool] = {}  # False: must be seen in its place
        self.older: dict[str, bytes | bool] = {}
        self.tails: dict[str, bytes] = {}

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text (null: empty).

        Arrow cuts the texts and numbers the distinct chunks of the batch, Python sees
        each of these once, and NumPy puts their ids in the places of the chunks."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        if self.mode == "whole":
            return self._library(texts.to_pylist())
        if self.mode == "word":
            told = pc.replace_substring(texts, "\n", " ")
        else:
            nul = pa.scalar("\0", pa.large_string())
            told = pc.if_else(pc.match_substring(texts, "\0"), nul, pc.binary_join_element_wise(nul, pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string())))
        parts = pc.split_pattern(told, " ")
        chunks = parts.flatten().dictionary_encode()
        known = self._known(_listed(chunks.dictionary))
        apart = np.array([k is False for k in known], dtype=bool)
        known = [k or b"" for k in known]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), dtype="<u4")
        which, of_text = chunks.indices.to_numpy(), parts.offsets.to_numpy()
        out: list[bytes] = []
        for a in range(0, len(texts), TEXTS):
            cuts = of_text[a : a + TEXTS + 1]
            here = which[cuts[0] : cuts[-1]]
            n = sizes[here]
            ends = np.cumsum(n)
            ids = flat[np.arange(n.sum()) + np.repeat(starts[here] - (ends - n), n)].tobytes()
            marks = (4 * np.append(0, ends)[cuts - cuts[0]]).tolist()
            out += [ids[i:j] for i, j in zip(marks, marks[1:])]
        if apart.any():
            rest = np.flatnonzero(np.diff(np.append(0, np.cumsum(apart[which]))[of_text])).tolist()
            for i, ids in zip(rest, self._library(texts.take(pa.array(rest)).to_pylist())):
                out[i] = ids
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _known(self, chunks: list[str]) -> list[bytes | bool]:
        """Ids per chunk.  The memo has two generations: when the younger is full it takes
        the place of the older, and what is met again there moves on, so frequent chunks stay."""
        if 2 * len(self.memo) > MEMO_CHUNKS:
            self.older, self.memo = self.memo, {}
        known = list(map(self.memo.get, chunks))
        new = [i for i, k in enumerate(known) if k is None]
        self._learn([chunks[i] for i in new])
        for i in new:
            known[i] = self.memo[chunks[i]]
        return known

    def _learn(self, wanted: list[str]) -> None:
        memo, older = self.memo, self.older
        words, names, told, parts = [], [], [], []
        for c in wanted:
            if (ids := older.get(c)) is not None:
                memo[c] = ids
            elif c.isalpha():
                words.append(c)
            else:
                core = c.rstrip(PUNCTUATION)
                if len(core) != len(c) and core.isalpha():
                    # letters, then ASCII punctuation: both patterns part them, and neither part sees the other
                    parts.append((c, core, c[len(core) :]))
                    continue
                said = self._standing(c)
                if not said:
                    memo[c] = False if said is None else b""
                else:
                    names.append(c)
                    told.append(said)
        memo.update(zip(names, self._library(told)))
        memo.update(zip(words, self._model(words)))
        words = []
        for core in {core for _, core, _ in parts if core not in memo}:
            if (ids := older.get(core)) is not None:
                memo[core] = ids
            else:
                words.append(core)
        memo.update(zip(words, self._model(words)))
        if len(self.tails) > MEMO_CHUNKS:
            self.tails.clear()
        tails = list({tail for *_, tail in parts} - self.tails.keys())
        self.tails.update(zip(tails, self._library(tails)))
        for c, core, tail in parts:
            memo[c] = memo[core] + self.tails[tail]

    def _model(self, words: list[str]) -> list[bytes]:
        """Words of letters straight from the library's BPE model.  Normalisation and
        pre-tokenisation of such words are known: (lower case and) their bytes as the
        byte-level alphabet writes them, with the space before it in ``byte`` mode.  All
        are written in one go, a line each."""
        if not words:
            return []
        lines = " " + "\n ".join(words) if self.mode == "byte" else "\n".join(words).lower()
        far = [i for i, x in enumerate(lines.split("\n")) if FAR.search(x)] if FAR.search(lines) else []
        tokenize = self.model.tokenize
        out = [array("I", [t.id for t in tokenize(x)]).tobytes() for x in codecs.charmap_decode(lines.encode(), "strict", LINES)[0].split("\n")]
        for i, ids in zip(far, self._library([self._standing(words[i]) for i in far])):
            out[i] = ids
        return out

    def _standing(self, chunk: str) -> str | None:
        """The string that the library gets for a chunk; None if it depends on its neighbours."""
        if self.mode == "word":
            return chunk
        first = chunk[:1]
        body = chunk[1:] if first in ("\n", "\0") else chunk
        if not body and first == "\0":
            return None
        if not body or "\0" in body or any(c.isspace() for c in body):
            return None
        return {"\n": chunk, "\0": body}.get(first, " " + chunk)


def _listed(chunks: pa.Array) -> list[str]:
    """Chunks without spaces as a list, by one string."""
    if not len(chunks):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), pa.scalar(" ", chunks.type))[0].as_py().split(" ")


def mode_of(spec: dict) -> str:
    """``byte``: byte-level BPE whose pattern ties one leading space to a word;
    ``word``: white space only separates; ``whole``: anything else."""
    normal, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    steps = [s.get("type") for s in (normal or {}).get("normalizers", [])]
    splits = pre.get("pretokenizers") or [{}]
    first = splits[0]
    if (
        steps == ["NFC", "Replace", "Lowercase"]
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert")
        and first.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    ):
        return "word"
    return "whole"


def gathered(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``TEXT_BYTES`` of a text column, so that a frequent chunk
    is looked up once in more texts; a larger batch stays as it is."""
    held, size = [], 0
    for b in batches:
        n = b.column(column).nbytes
        if held and size + n > TEXT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.concat_batches(held)


def encoder(source: str) -> ChunkEncoder:
    """One encoder per worker process and tokenizer."""
    return shared.only_memo(("tokens", hash(source)), lambda: ChunkEncoder(source))


def broadcast_tokenizer(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:  # the tokenizer's file is the driver's own, not an input table
        return spark.sparkContext.broadcast(f.read())
