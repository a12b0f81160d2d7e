"""Near copies of the pipeline against brute force over the sets of word shingles."""

import random

import numpy as np
import pytest

from cadastra.llm import simhash, similar

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def survivors(texts):
    """Least number of every component of the links of 0.8 or more."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [i for i in range(len(sets)) if find(i) == i]


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    return sorted(r[0] for r in simhash.near_copies(df).select("doc_id").collect())


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def changed(rng, base, n):
    out = list(base)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.randrange(10**6)}"
    return out


def test_all_pairs_of_0_8_to_0_9_are_found(spark):
    rng = random.Random(1)
    texts = []
    for i in range(120):
        base = words(rng, 200)
        texts += [" ".join(base), " ".join(changed(rng, base, 1 + i % 5))]
    bands = [jaccard(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)]
    assert sum(0.8 <= b < 0.85 for b in bands) >= 20 and sum(b < 0.8 for b in bands) >= 20
    assert kept(spark, texts) == survivors(texts)


def test_below_0_8_nothing_is_linked(spark):
    rng = random.Random(2)
    line = words(rng, 12)
    # one line repeated: nearly the same shingles by count, few in common as sets
    texts = [" ".join(line * 40 + words(rng, 8)) for _ in range(10)]
    for _ in range(40):
        base = words(rng, 120)
        texts += [" ".join(base), " ".join(base[:-14] + words(rng, 14))]
    assert max(jaccard(texts[i], texts[i + 1]) for i in range(10, len(texts), 2)) < 0.8
    assert kept(spark, texts) == list(range(len(texts)))


@pytest.mark.parametrize("few, block", [(64, 256), (3, 7)])
def test_families_that_share_a_passage(spark, monkeypatch, few, block):
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(3)
    passage = words(rng, 100)
    texts = []
    for _ in range(8):  # the passage is most of each text; families differ in the rest
        tail = words(rng, 25)
        texts += [" ".join(passage + changed(rng, tail, rng.randrange(3))) for _ in range(12)]
    drift = words(rng, 150)
    for _ in range(40):  # a chain: only neighbours are near
        texts.append(" ".join(drift))
        drift = changed(rng, drift, 2)
    rng.shuffle(texts)
    want = survivors(texts)
    assert 1 < len(want) < len(texts) // 2
    assert kept(spark, texts) == want


def test_sketches_of_alike_sets_keep_a_common_key():
    """The rarest half of either sketch, in any common order, has a key of both."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        union = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        both = rng.permutation(len(union))[: -(-4 * len(union) // 5)]
        side = rng.random(len(union)) < 0.5
        shared_ = np.isin(np.arange(len(union)), both)
        a, b = union[shared_ | side], union[shared_ | ~side]
        order = rng.permutation(len(union))
        left = []
        for x in (a, b):
            keys = sorted(x[: similar.SKETCH], key=lambda k: order[np.searchsorted(union, k)])
            spare = -(-similar.NUM * len(x) // similar.DEN) - 1 if len(x) <= 38 else similar.SPARE
            left.append(set(keys[: len(keys) - spare]))
        assert left[0] & left[1]
