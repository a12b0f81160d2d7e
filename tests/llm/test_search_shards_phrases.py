"""Lexical search, sharding and phrase mining against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cadastra.llm import lexical, phrases, sharding

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, id string, n string, rank string, shard string"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "x", "y", "z", "s") for i, t, lang in rows], DOCS).repartition(5)


def ranked(docs, items, k):
    words = [(i, TERM.findall(t.translate(ASCII)) if t else []) for i, t, _ in docs]
    n, total = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(TERM.findall(t.translate(ASCII)) if t else [])
    out = []
    for item, terms in asked.items():
        found = []
        for i, w in words:
            tf = Counter(w)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 20 * (50 + 50 * len(w) * n // total))) for t in terms if tf[t])
            if score > 0:
                found.append((-score, i is not None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def test_search_equals_summing_all(spark):
    rng = random.Random(5)
    common, rare = ["the", "of", "Ärger", "e9", "İx"], [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(rng.randrange(1, 60))), "en") for i in range(400)]
    docs += [(i, "the of THE-of e9's", "en") for i in range(900, 960)] + [(960, "the " * 20_000 + "w1", "en"), (961, None, "en"), (962, "", None), (963, " \x7f-—", "en"), (None, "w1 w2 the", "en"), (7, docs[7][1], "en"), (7, docs[7][1], "en")]
    items = [(i, " ".join(rng.sample(common, 3) + rng.sample(rare, 4))) for i in range(25)] + [(50, "the of"), (51, None), (52, "unheard"), (53, "the"), (53, "w1 w2"), (None, "w3 the"), (1, "the the of"), (54, "The OF Ärger e9 İx")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    for k in (1, 10, 50):
        got = sorted((tuple(r) for r in lexical.search(table(spark, docs), bench, k=k).collect()), key=repr)
        assert got == ranked(docs, items, k)
    assert lexical.search(table(spark, docs), bench.limit(0)).count() == 0
    assert lexical.search(table(spark, []), bench).count() == 0


def test_search_without_broadcasts(spark, monkeypatch):
    docs = [(i, f"the w{i % 9} w{i % 7} of" + " the" * (i % 5), "en") for i in range(200)]
    items = [(1, "the w1 w2"), (2, "w3 of"), (3, "the")]
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    got = lexical.search(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked(docs, items, 5)


def test_shards(spark):
    docs = [(i, "é" * (i % 70), "en") for i in range(3000)] + [(5, "again", "en")] * 400 + [(None, None, None)] * 300 + [(9000, "x" * 300_000, "en")]
    weights = [1.0, 2.0, 1.0, 4.0]
    got = sharding.place(table(spark, docs), weights, [*weights, 2.0]).collect()
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    assert all(r["law"] == "key" for r in got)
    shard = {}
    slots = defaultdict(list)
    for r in got:
        assert shard.setdefault(r["id"], r["shard"]) == r["shard"]
        assert r["grown_shard"] in (r["shard"], 4)
        slots[r["shard"]].append((r["slot"], r["id"] is not None, r["id"] or 0))
    for rows in slots.values():
        rows.sort()
        assert [s for s, _, _ in rows] == list(range(len(rows))) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)
    share = Counter(shard.values())
    assert all(abs(share[j] / len(shard) - w / 8) < 0.03 for j, w in enumerate(weights))
    moved = len({r["id"] for r in got if r["grown_shard"] == 4})
    assert abs(moved / len(shard) - 0.2) < 0.03
    again = sharding.place(table(spark, docs[:50]).coalesce(1), weights).collect()  # neither other rows nor their order matter
    assert all(r["shard"] == shard[r["id"]] and r["grown_shard"] is None for r in again)
    assert sharding.place(table(spark, []), weights).count() == 0


def test_slots_of_overlapping_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).select(F.lit("one").alias("g"), (F.col("id") % 3).alias("k"), F.col("id").alias("row"))
    got = [(r["k"], r["row"], r["slot"]) for r in sharding.numbered(sharding.shared.materialise(rows, "rows"), "g", ["k", "row"]).collect()]
    assert [s for _, _, s in sorted(got)] == list(range(5000))


def mined(docs, least, first):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f[lang or "und"].update(zip(*(words[i:] for i in range(k))))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        rows = []
        for p, a in found.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        rows.sort()
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(rows[:first], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(2)
    words = ["a", "b", "C", "été", "d e", "f\x1cg", "𝒳", "-", "(x)"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", " ; "]) for _ in range(rng.randrange(90))), rng.choice(["en", "en", "de", None])) for i in range(150)]
    return docs + [(1, "new york city " * 3000, "en"), (2, "a a a a a a " * 40, "de"), (3, None, "en"), (4, "", "fr"), (5, "...,", "es"), (6, "only once here", "it")] + [(7, "the quick brown fox", "en")] * 60


def test_phrases_equal_counting_all(spark, monkeypatch):
    docs = corpus()
    for least, first in ((30, 2000), (5, 20)):
        got = sorted(tuple(r) for r in phrases.collocations(table(spark, docs), least, first).collect())
        assert got == mined(docs, least, first)
    assert phrases.collocations(table(spark, [])).count() == 0
    monkeypatch.setattr(phrases, "BLOCK_CELLS", 20)  # several blocks
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, docs), 30, 2000).collect())
    assert got == mined(docs, 30, 2000)


def test_parts_of_phrase_mining_with_small_bounds(monkeypatch):
    import pyarrow as pa

    for name, value in (("CHUNK", 64), ("TASK_CELLS", 500), ("_WORDS", 12), ("MEMO_WORDS", 3)):
        monkeypatch.setattr(phrases, name, value)
    docs = corpus()
    want = Counter()
    for _, text, _ in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                want.update(" ".join(g).encode() for g in zip(*(words[i:] for i in range(k))))
    some = sorted(p for p in want if b" " in p)
    automata = phrases.Automata(some)
    assert len(automata.parts) > 1
    sums = Counter()
    for words, own in phrases.chunks([(t or "").encode() for _, t, _ in docs]):
        automata.scan(words, own)
        for n, places, h in phrases.runs(words, own, "en"):
            for i, x in zip(places.tolist(), h.tolist()):
                assert phrases._BREAK not in words[i : i + n]
                sums[b" ".join(words[i : i + n]), x] += 1
    found = dict(zip(automata.names, automata.counts.tolist()))
    assert found.pop(b"") == sum(n for p, n in want.items() if b" " not in p)
    assert found == {p: want[p] for p in found} and set(some) <= set(found)
    assert {p: n for (p, _), n in sums.items()} == {p: want[p] for p in some} and len(sums) == len({x for _, x in sums})
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(docs)), pa.array([(t or "").encode() for _, t, _ in docs])], names=["lang", "text"])
    added = sorted((r for b in phrases._sketching(40, 30)([batch]) for r in b.to_pylist()), key=lambda r: r["segment"])
    added = pa.RecordBatch.from_pylist(added, schema=pa.schema([("segment", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())]))
    full = [c for b in phrases._summing(30)([added]) for c in b.column(0).to_pylist()]
    assert len(full) == len(set(full)) == sum(want[p] >= 30 for p in some)
