"""MinHash near-duplicates against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from decoyscope.llm import minhash, near_sets

SCHEMA = "doc_id long, text string, lang string, size long, whole string, body string, key long, h long, n long, least string"
CLASH = ("en", 1, "w", "b", 2, 3, 4, "l")


def set_of(text):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))} if ws else set()


def expected(rows):
    sets = [set_of(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i) if sets[i] else -1 - i
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    ids = [least.get(find(i) if sets[i] else -1 - i) for i in range(len(rows))]
    return Counter((r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, ids))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [" ".join(fresh(rng.randrange(1, 90))) for _ in range(60)]
    for n in (12, 60, 400):
        base = fresh(n)
        texts += [edited(rng, base, rng.randrange(0, n // 8 + 1)) for _ in range(40)]
    texts += texts[5:12] + [t.upper().replace(" ", "\n\t ") for t in texts[:4]] + [None, "", " \n\t", "a", "A", "a b c", "😀 ñ Σ ß x", "😀 ñ Σ ß y", "w " * 30_000, "long " + "w " * 30_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, None), (None, "alone it is here"), (4, texts[4]), (4, texts[4]), (9, "other text of id nine")]
    rows += [(1000 + i, texts[70]) for i in range(120)]
    return [(*r, *CLASH) for r in rows]


def test_every_row(spark):
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert Counter(tuple(r) for r in got) == expected(rows)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("filled", [8, 30])
def test_one_template(spark, filled):
    """A part of a thousand texts of one template, of which few (filled = 30) or most are alike: as many groups as by all pairs."""
    rng = random.Random(filled)
    base = [f"w{i}" for i in range(160)]
    rows = [(i, edited(rng, base, rng.randrange(0, filled)), *CLASH) for i in range(1000)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert Counter(tuple(r) for r in got) == expected(rows)


def test_sketches_tell_similarity():
    rng = np.random.default_rng(2)
    far = []
    for k in range(300):
        both, own = rng.integers(0, 2**64, 800, dtype=np.uint64), rng.integers(0, 2**64, 200, dtype=np.uint64)
        drawn = near_sets.samples([np.r_[both, own[:100]], np.r_[both, own[100:]]])  # 800 of 1000
        assert abs((drawn[0] == drawn[1]).mean() - 0.8) < 0.15
        a, b = near_sets.odd_sketches(drawn)
        far.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()))
    assert max(far) <= near_sets.allowed(0.8)
    assert abs(np.mean(near_sets.similarity(np.array(far))) - 0.8) < 0.01
    assert np.std(near_sets.similarity(np.array(far))) < 0.04
