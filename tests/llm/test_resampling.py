"""Importance resampling against a plain loop."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from decoyscope.llm import resampling

SCHEMA = "doc_id long, text string, lang string, n_words long, n_features long, eligible string, score string, at long, rank long, range long"
CLASH = (1, 2, "e", "s", 3, 4, 5)


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features_of(text):
    ws = words_of(text)
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def buckets_of(text, n=10_000):
    return [zlib.crc32(f.encode()) % n for f in features_of(text)]


def expected(rows, items):
    s = Counter(b for r in rows for b in buckets_of(r[1]))
    t = Counter(b for text in items for b in buckets_of(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for doc_id, text, *_ in rows:
        of = buckets_of(text)
        weight = sum(map(gain, of)) // len(of) if of else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(of), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text)) >= 20])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def corpus():
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "ñandú", "Σ", "x1", "don't", "a-b", "😀", "zeta_9", "THE", "über"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", "\n", "!? "]) for _ in range(rng.randrange(1, 80))) for _ in range(150)]
    texts += [None, "", " \n.,;", "one", "{|}~`@[", "\x00a\x7fb", "w" * 70_000, "big " * 60_000]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, texts[2], None), (None, None, None)]
    rows += [rows[7], rows[7]] + [(1000 + i, texts[5], "hot") for i in range(90)]
    return [(*r, *CLASH) for r in rows], [t for t in texts[:20:3]] + [None, ""]


def items(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "item_id long, text string, n long")


def test_every_row(spark):
    rows, target = corpus()
    got = resampling.resampled(spark.createDataFrame(rows, SCHEMA).repartition(6), items(spark, target)).collect()
    assert Counter(tuple(r) for r in got) == expected(rows, target)


def test_empty_tables(spark):
    rows, _ = corpus()
    docs, none = spark.createDataFrame(rows[:40], SCHEMA), items(spark, [])
    assert Counter(tuple(r) for r in resampling.resampled(docs, none).collect()) == expected(rows[:40], [])
    assert resampling.resampled(docs.limit(0), items(spark, ["a b"])).collect() == []


@pytest.mark.parametrize("block", [7, 64, 4_000_000])
def test_features_of_pieces(monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    texts = [t for _, t, *_ in corpus()[0] if t is None or len(t) < 5000]
    n, owner, bucket = resampling.featured(texts, 997)
    assert n.tolist() == [len(words_of(t)) for t in texts]
    got = [Counter(bucket[owner == i].tolist()) for i in range(len(texts))]
    assert got == [Counter(buckets_of(t, 997)) for t in texts]


def test_crc_matrices():
    rng = np.random.default_rng(3)
    stream = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts, lengths = rng.integers(0, 4000, 3000), rng.integers(1, 900, 3000)
    want = [zlib.crc32(stream[a : a + n].tobytes()) for a, n in zip(starts.tolist(), lengths.tolist())]
    assert resampling.crc32s(stream, starts, lengths).tolist() == want
