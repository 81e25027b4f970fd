"""Ordered folds of hot keys in segments against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from decoyscope.operators import dedup

START = datetime(2024, 1, 1)


def plain_first(rows, ttl):
    kept, last = [], {}
    for key, at, tie in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        before = last.get(key)
        if before is None or at is None or at - before >= ttl:
            kept.append(tie)
            last[key] = at
    return sorted(kept)


@pytest.mark.parametrize("segment,ttl", [(7, 5), (40, 90), (40, 4000), (10**6, 50)])
def test_first_seen(spark, segment, ttl):
    rng = random.Random(segment + ttl)
    rows = [(rng.choice(["hot", "hot", "hot", None, f"k{rng.randrange(40)}"]), rng.choice([None, *[rng.randrange(3000)] * 30]), i) for i in range(900)]
    df = spark.createDataFrame([(k, None if t is None else START + timedelta(seconds=t), i, "c") for k, t, i in rows], "k string, ts timestamp, tie long, part string")
    got = dedup.first_seen(df, "k", "ts", ttl, "tie", segment)
    assert got.columns == df.columns and sorted(r.tie for r in got.collect()) == plain_first(rows, ttl)


@pytest.mark.parametrize("segment,share", [(9, 0.02), (9, 0.5), (60, 0.0), (10**6, 0.1)])
def test_retries(spark, segment, share):
    rng = random.Random(segment)
    rows = [(rng.choice(["hot", "hot", None, f"k{rng.randrange(30)}"]), i, rng.random() < share) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, i long, good boolean")
    want, run = {}, {}
    for k, i, good in rows:
        run[k] = 0 if good else run.get(k, 0) + 1
        want[i] = (run[k], run[k] >= 3)
    got = {r.i: (r.attempt, r.dead) for r in dedup.retries(df, "k", ["i"], F.col("good"), segment=segment).collect()}
    assert got == want


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, ts timestamp, tie long")
    assert dedup.first_seen(none, "k", "ts", 5, "tie").collect() == []
    assert dedup.retries(none, "k", ["ts"], F.lit(True)).collect() == []


def test_time_maps():
    rng = random.Random(1)
    for n, span in [(1, 5), (30, 3), (200, 40), (50, 10_000)]:
        times = np.sort(np.array([rng.randrange(1000) for _ in range(n)], dtype=np.int64))
        found = dedup.time_map(times, span)
        assert [u for u, _ in found] == sorted({u for u, _ in found})
        for state in range(int(times[0]) - span - 3, int(times[0]) + 1):
            last = state
            for t in times.tolist():
                last = t if t - last >= span else last
            assert next((o for u, o in found if state <= u), state) == last
