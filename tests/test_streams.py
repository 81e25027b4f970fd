"""Keyed state over several batches."""

import json

import pytest
from pyspark.sql import functions as F

from decoyscope.sources import collections as C
from decoyscope.sources import records as S
from decoyscope.streaming import state

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batches(spark, tmp_path, schema, groups):
    """A stream that takes one group of rows a batch."""
    for i, rows in enumerate(groups):
        p = tmp_path / "in" / f"{i}.json"
        p.parent.mkdir(exist_ok=True)
        p.write_text("".join(json.dumps(r) + "\n" for r in rows))
        import os

        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def run(spark, tmp_path, df):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect()


def test_first_seen_over_batches(spark, tmp_path):
    at = lambda s: s * 1_000_000
    groups = [[{"k": "a", "event_id": 1, "at": at(0)}, {"k": "a", "event_id": 2, "at": at(5)}, {"k": "b", "event_id": 3, "at": at(1)}], [{"k": "a", "event_id": 4, "at": at(9)}, {"k": "a", "event_id": 5, "at": at(10)}, {"k": "b", "event_id": 6, "at": at(2)}]]
    df = batches(spark, tmp_path, "k string, event_id long, at long", groups)
    assert sorted(r.event_id for r in run(spark, tmp_path, state.first_seen(df, "k", 10))) == [1, 3, 5]


def test_inactive_rechecks(spark, tmp_path):
    d = 86_400
    day = lambda n, ok=False, slow=False: {"domain": "u" if slow else "x", "at": n * d, "unregistered": slow, "resolved": ok}
    groups = [[day(0)], [day(6)], [day(7)], [day(14)], [day(45)], [day(0, slow=True)], [day(29, True, True)], [day(30, True, True)]]
    df = batches(spark, tmp_path, "domain string, at long, unregistered boolean, resolved boolean", groups)
    got = {(r.domain, r.at // d, r.checks, r.outcome) for r in run(spark, tmp_path, state.inactive_recheck(df))}
    # x: first check on day 7, the second 7 days later, the third 30 after that; u: found on day 30
    assert got == {("x", 45, 3, "dropped"), ("u", 30, 1, "newly_active")}


def test_upsert_merges_and_replaces(spark):
    old = spark.createDataFrame([(1, "a", 10, 1), (2, "b", 20, 1)], "id int, x string, y int, ts int")
    new = spark.createDataFrame([(2, None, 21, 2), (2, "z", 9, 1), (3, "c", 30, 2)], "id int, x string, y int, ts int")
    rows = lambda df: sorted((r.id, r.x, r.y) for r in df.collect())
    assert rows(S.upserted(old, new, "id", "ts")) == [(1, "a", 10), (2, "b", 21), (3, "c", 30)]
    got = S.upserted(old, new, "id", "ts", merge=False).collect()
    assert sorted((r.id, r.x or "", r.y) for r in got) == [(1, "a", 10), (2, "", 21), (3, "c", 30)]


def test_files(spark, tmp_path):
    (tmp_path / "seeds.csv").write_text("cse_id,seed_registrable\n c1 , A.com \nc2,\n")
    assert [tuple(r) for r in S.read_seeds(spark, str(tmp_path / "seeds.csv")).collect()] == [("c1", "a.com")]
    (tmp_path / "l.txt").write_text("# no\n\n in \nco.in\n")
    assert [r.term for r in S.read_list(spark, str(tmp_path / "l.txt")).collect()] == ["in", "co.in"]
    (tmp_path / "bulk.csv").write_text("a.com,1\n,2\nb.com\n")
    assert sorted(r.input for r in S.read_bulk_csv(spark, str(tmp_path / "bulk.csv")).collect()) == ["a.com", "b.com"]
    d = tmp_path / "j" / "deep"
    d.mkdir(parents=True)
    (d / "x.jsonl").write_text('{"a": 1}\n\n{bad\n')
    good, bad = S.read_jsonl(spark, str(tmp_path / "j"), "a int")
    assert [r.a for r in good.collect()] == [1] and [r.value for r in bad.collect()] == ["{bad"]
    S.dump_all(spark.range(5), str(tmp_path / "dump"), 3)
    assert spark.read.json(str(tmp_path / "dump")).count() == 3
    assert spark.range(1).select(F.lit("k").alias("key"), F.lit(1).alias("v")).transform(lambda df: S.encode(df, "key")).first().value == '{"key":"k","v":1}'


@pytest.mark.parametrize("topics", [["raw.hosts", "domains.candidates"]])
def test_topics_need_the_connector(spark, topics):
    """Without the connector's jar the source is unknown; with it, it would be asked for both topics."""
    with pytest.raises(Exception, match="(?i)kafka"):
        S.read_topic(spark, "nowhere:9092", topics, "a int")


class Value:
    """A value state held in memory."""

    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, name, schema, ttlDurationMs=None):
        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


def test_inactive_rechecks_by_the_clock():
    """A timer checks at the due time by the last observation; rows of a batch are ordered over all its chunks."""
    import pandas as pd

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getExpiryTimeInMs(self):
            return self.ms

    d = 86_400
    p, h = state.InactiveRecheck(True), Handle()
    p.init(h)
    chunk = lambda *rows: pd.DataFrame([{"at": n * d, "unregistered": False, "resolved": ok} for n, ok in rows])
    feed = lambda *chunks: pd.concat(list(p.handleInputRows(("x",), iter(chunks), None))).outcome.tolist()
    fire = lambda n: pd.concat(list(p.handleExpiredTimer(("x",), None, At(n * d * 1000)))).outcome.tolist()
    assert feed(chunk((3, True)), chunk((1, False), (0, False))) == [] and h.timers == [7 * d * 1000]
    assert fire(7) == ["newly_active"] and fire(8) == []
    assert feed(chunk((10, False))) == [] and fire(16) == [] and fire(17) == [] and fire(24) == [] and fire(54) == ["dropped"] and fire(400) == []


def test_a_batch_writes_an_inactive_entry_once():
    """However many rows a key has in a batch, its state is read and written once."""
    import pandas as pd

    class Counted(Value):
        writes = reads = 0

        def get(self):
            self.reads += 1
            return super().get()

        def update(self, v):
            self.writes += 1
            super().update(v)

    p = state.InactiveRecheck(False)
    p.init(Handle())
    p.entry = Counted()
    for day in (0, 1):
        list(p.handleInputRows(("x",), iter([pd.DataFrame({"at": range(day * 100, day * 100 + 50), "unregistered": False, "resolved": [i % 2 == 0 for i in range(50)]})]), None))
    assert p.entry.writes <= 2 and p.entry.reads <= 2


def test_fusing_many_keys_takes_little_time_each():
    import time

    import pandas as pd

    p = state.Fusion(["a", "b", "c"], None)
    p.init(Handle())
    rows = pd.DataFrame({"kind": ["c", "a", None, "a", "b"], "at": [1, 5, 9, 5, 2], "event_id": [1, 2, 3, 4, 5], "value": [1.0, 2.0, 3.0, 4.0, 5.0]})
    began = time.process_time()
    for k in range(3000):
        p.parts = Value()
        out = pd.concat(list(p.handleInputRows((k,), iter([rows]), None)))
        assert out.values.tolist() == [[k, 4.0, 5.0, 1.0]]
    assert time.process_time() - began < 5


def test_active_rechecks():
    import pandas as pd

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getExpiryTimeInMs(self):
            return self.ms

    p, h = state.Recheck(), Handle()
    p.init(h)
    feed = lambda at, due=None: pd.concat(list(p.handleInputRows(("d",), iter([pd.DataFrame({"at": [at], "due": [due]})]), None))).recheck.tolist()
    assert feed(0, 10) == [] and h.timers == [10_000]
    assert pd.concat(list(p.handleExpiredTimer(("d",), None, At(10_000)))).recheck.tolist() == [1]
    assert feed(11, 20) == [] and feed(19) == [] and feed(20) == [2]
    assert feed(21, 30) == [] and feed(40) == [3] and feed(50) == []


def live(spark, tmp_path, df, mode, feeds, done, seconds=90):
    """Runs a stream by the clock: `feeds` are (seconds to wait, rows) written one after the other; ends when done(rows) holds."""
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    seen = []
    run = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="500 milliseconds").foreachBatch(lambda x, n: seen.extend(r.asDict() for r in x.collect())).start()
    try:
        for i, (wait, rows) in enumerate(feeds):
            if wait:
                time.sleep(wait)
            before = len(seen)
            (tmp_path / "in" / f".{i}").write_text("".join(json.dumps(r) + "\n" for r in rows))
            (tmp_path / "in" / f".{i}").rename(tmp_path / "in" / f"{i}.json")
            until = time.time() + seconds
            while mode == "update" and len(seen) == before and time.time() < until:
                time.sleep(0.2)
        until = time.time() + seconds
        while not done(seen) and time.time() < until:
            time.sleep(0.2)
    finally:
        run.stop()
    return seen


def test_active_rechecks_in_a_stream(spark, tmp_path):
    """Timers fire by the clock; a key's own later rows trigger what is due, too."""
    import time

    (tmp_path / "in").mkdir()
    now = int(time.time())
    df = spark.readStream.schema("domain string, at long, due long").json(str(tmp_path / "in"))
    row = lambda d, at, due=None: {"domain": d, "at": at, "due": due}
    feeds = [(0, [row("a", now, now + 1), row("b", now + 5000, None), row("b", now, now + 4000), row("c", now)]), (1, [row("b", now + 6000, now + 9000)]), (1, [row("b", now + 9000)])]
    seen = live(spark, tmp_path, state.recheck(df), "append", feeds, lambda rows: len(rows) >= 3)
    assert {(r["domain"], r["due"], r["recheck"], r["reason"]) for r in seen} == {("a", now + 1, 1, "Re-check #1"), ("b", now + 4000, 1, "Re-check #1"), ("b", now + 9000, 2, "Re-check #2")}


def test_idle_parts_are_evicted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    df = spark.readStream.schema("k string, kind string, at long, event_id long, value double").json(str(tmp_path / "in"))
    row = lambda k, kind, at, v: {"k": k, "kind": kind, "at": at, "event_id": at, "value": v}
    feeds = [(0, [row("a", "domain", 1, 1.0)]), (8, [row("a", "http", 2, 2.0)]), (0, [row("a", "domain", 3, 3.0)])]
    seen = live(spark, tmp_path, state.fuse(df, "k", ["domain", "http"], idle_seconds=5), "update", feeds, lambda rows: len(rows) >= 3)
    none = lambda v: None if v is None or v != v else v
    # the domain part of the first batch is gone when the second comes, its http part is there in the third
    assert [(none(r["domain"]), none(r["http"])) for r in seen] == [(1.0, None), (None, 2.0), (3.0, 2.0)]


def test_micro_batches_upsert(spark, tmp_path):
    groups = [[{"id": 1, "x": "a", "ts": 1}, {"id": 2, "x": "b", "ts": 1}], [{"id": 2, "x": "c", "ts": 2}], [{"id": 3, "x": "d", "ts": 3}, {"id": 3, "x": "e", "ts": 4}], [{"id": 1, "x": None, "ts": 5}], [{"id": 4, "x": "f", "ts": 6}]]
    df = batches(spark, tmp_path, "id long, x string, ts long", groups)
    at = f"file://{tmp_path}/kept"
    state.upsert_stream(df, at, "id", "ts", str(tmp_path / "log"), drain=True).awaitTermination(120)
    rows = lambda v: sorted((r.id, r.x, r.ts) for r in C.collection(spark, at, v).collect())
    assert rows(4) == [(1, "a", 5), (2, "c", 2), (3, "e", 4), (4, "f", 6)] and rows(3) == rows(4)[:3]
    again = C.upsert(spark, at, spark.createDataFrame([(4, "f", 6)], "id long, x string, ts long"), "id", "ts", 4)
    assert rows(again) == [(1, "a", 5), (2, "c", 2), (3, "e", 4), (4, "f", 6)]
    assert sorted(p.name for p in (tmp_path / "kept" / "manifest").iterdir()) == ["v=2", "v=3", "v=4"]


@pytest.mark.parametrize("how,want", [({"size": "10 minutes", "slide": "5 minutes"}, {(-5, "x", 1), (0, "x", 2), (5, "x", 1)}), ({"gap": "4 minutes"}, {(1, "x", 1), (6, "x", 1)})])
def test_sliding_and_session_windows(spark, tmp_path, how, want):
    at = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z"
    row = lambda m: {"ts": at(m), "verdict": "x"}
    df = batches(spark, tmp_path, "ts timestamp, verdict string", [[row(1), row(6)], [row(200)], [row(400)]])
    got = run(spark, tmp_path, state.windowed_verdicts(df, "ts", "verdict", delay="1 minute", **how))
    zero = 1_704_067_200
    early = {((int(r.start.timestamp()) - zero) // 60, r.verdict, r.n) for r in got if r.start.timestamp() < zero + 3600}
    assert early == want


def test_pages_of_a_dump_share_files(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "dump")
    S.dump_all(spark.range(0, 1003, 1, 4), at, page_size=10, page="page")
    assert len(list((tmp_path / "dump").glob("part-*"))) == 4  # not one for each of 102 pages
    assert spark.read.json(at).select("id").distinct().count() == 1003
    sizes = [r["count"] for r in spark.read.json(at).groupBy("page").count().collect()]
    assert max(sizes) == 10 and sum(sizes) == 1003 and len(sizes) <= 104
    monkeypatch.setattr(S, "PAGES", 2)
    S.dump_all(spark.range(0, 1003, 1, 4), at, page_size=10, page="page")
    held = spark.read.json(at).select("page", F.col("_metadata.file_path").alias("file")).distinct().groupBy("page").count()
    assert held.where("count > 1").isEmpty()
    with pytest.raises(ValueError):
        S.dump_all(spark.range(3), at, page="ID")
