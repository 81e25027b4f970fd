"""Keyed collections against a dictionary, version by version."""

import random

import pytest

from decoyscope.sources import collections as C

SCHEMA = "id long, a string, b long, ts long"


def apply(model, batch, merge):
    newest = {}
    for r in batch:
        if r[0] not in newest or r[3] > newest[r[0]][3]:
            newest[r[0]] = r
    out = dict(model)
    for k, r in newest.items():
        old = model.get(k) if merge else None
        out[k] = tuple(o if v is None and old else v for v, o in zip(r, old or r))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_every_version_equals_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    at, model, models = f"file://{tmp_path}/kept", {}, []
    for v in range(6):
        n = 300 if v == 0 else rng.randrange(1, 40)
        batch = [(rng.randrange(400), rng.choice([None, f"a{v}"]), rng.choice([None, v]), 1000 * v + i) for i in range(n)]
        df, merge = spark.createDataFrame(batch, SCHEMA), v % 3 != 2
        assert C.upsert(spark, at, df, "id", "ts", v, merge) == v
        if v == 4:  # a batch that comes again changes nothing
            C.upsert(spark, at, df, "id", "ts", v, merge)
        model = apply(model, batch, merge)
        models.append(sorted(model.values()))
        assert rows(C.collection(spark, at, v)) == models[v]
    assert rows(C.collection(spark, at, 4)) == models[4] and rows(C.collection(spark, at, 3)) == models[3]
    # small batches are segments of their own; the large first one stayed as it was
    segments = C._manifest(spark, at, 5)["segments"]
    assert segments[0][0] == "0-0" and len(segments) > 1 and sum(s[1] for s in segments[1:]) < 200
    kept = {p.name for p in (tmp_path / "kept" / "rows").iterdir()}
    assert kept == {s[0] for v in (3, 4, 5) for s in C._manifest(spark, at, v)["segments"]}


def test_lookups_read_only_segments_with_the_key(spark, tmp_path):
    at = f"file://{tmp_path}/kept"
    for v, ids in enumerate([range(400), range(1000, 1100), range(2000, 2010)]):
        C.upsert(spark, at, spark.createDataFrame([(i, f"a{v}", i, 1) for i in ids], SCHEMA), "id", "ts", v)
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    names = lambda *ids: [s[0] for s in C.segments_of(spark, at, 2, keys(*ids))]
    assert names(2003) == ["2-2"] and names(7, 1050) == ["0-0", "1-1"] and names(5000) == []
    assert rows(C.lookup(spark, at, 2, keys(7, 2003, 5000, 7))) == [(7, "a0", 7, 1), (2003, "a2", 2003, 1)]
    for v in (0, 1, 2):
        segment = C._manifest(spark, at, v)["segments"][-1]
        every = spark.read.parquet(f"{at}/rows/{segment[0]}").select("id")
        assert all(segment[0] in names(r.id) for r in every.limit(5).collect())


@pytest.mark.parametrize("merge", [True, False])
def test_empty_batches_and_null_keys(spark, tmp_path, merge):
    at = f"file://{tmp_path}/kept"
    C.upsert(spark, at, spark.createDataFrame([], SCHEMA), "id", "ts", 0, merge)
    assert rows(C.collection(spark, at, 0)) == []
    C.upsert(spark, at, spark.createDataFrame([(None, "x", 1, 1), (3, "y", None, 2)], SCHEMA), "id", "ts", 1, merge)
    C.upsert(spark, at, spark.createDataFrame([(None, None, 2, 3)], SCHEMA), "id", "ts", 2, merge)
    got = {r.id: (r.a, r.b) for r in C.collection(spark, at, 2).collect()}
    assert got == {None: ("x", 2) if merge else (None, 2), 3: ("y", None)}
