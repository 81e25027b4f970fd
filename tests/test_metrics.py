"""Measures of batches: sums over several batches, after a failure and a restart."""

import time

import pytest
from pyspark.sql import functions as F

from decoyscope.streaming import metrics
from tests.test_streams import batches

GROUPS = [[{"host": f"h{i % 7}", "value": i} for i in range(n, n + 10)] for n in (0, 10, 20)]


def test_counts_survive_a_failure_between_two_sinks(spark, tmp_path):
    df = batches(spark, tmp_path, "host string, value long", GROUPS)
    sent, broken = [], [True]

    def topic(rows, n):
        if n == 1 and broken:
            broken.clear()
            raise OSError("the topic is away")
        sent.extend((n, r.value) for r in rows.collect())

    start = lambda: metrics.metered(df, metrics.both_sinks(topic, f"file://{tmp_path}/lines"), metrics.counters(F.col("value") % 2 == 0, "host"), f"file://{tmp_path}/metrics", str(tmp_path / "log"), drain=True)
    with pytest.raises(Exception, match="topic is away"):
        start().awaitTermination(120)
    start().awaitTermination(120)
    assert sorted(sent) == [(i // 10, i) for i in range(30)]
    assert sorted(r.value for r in spark.read.json(f"file://{tmp_path}/lines").collect()) == list(range(30))
    assert [tuple(r) for r in metrics.summed(spark, f"file://{tmp_path}/metrics").collect()] == [(30, 15, 7)]


def test_a_job_is_measured_as_it_writes(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("value"), (F.col("id") % 9).cast("string").alias("host"))
    watched, seen = metrics.passing(df, metrics.counters(F.col("value") > 89, "host"))
    watched.write.parquet(f"file://{tmp_path}/rows")
    metrics.record(spark, f"file://{tmp_path}/metrics", 0, dict(seen.get))
    assert tuple(metrics.summed(spark, f"file://{tmp_path}/metrics").first()) == (100, 10, 9)


def test_many_hosts_are_counted_exactly(spark, tmp_path):
    n = 20_000
    df = batches(spark, tmp_path, "host long, value long", [[{"host": i % n, "value": i} for i in range(a, a + n)] for a in (0, n // 2)] + [[{"host": None, "value": 1}]])
    at = f"file://{tmp_path}"
    metrics.metered(df, metrics.both_sinks(lambda rows, n: None, f"{at}/lines"), metrics.counters(F.col("value") < 5), f"{at}/metrics", str(tmp_path / "log"), drain=True, hosts=("host", f"{at}/hosts")).awaitTermination(120)
    assert tuple(metrics.summed(spark, f"{at}/metrics", f"{at}/hosts").first()) == (2 * n + 1, 6, n)


def test_heartbeats_of_a_running_stream(spark, tmp_path):
    df = batches(spark, tmp_path, "host string, value long", GROUPS).observe("seen", F.count(F.lit(1)).alias("n"))
    beat = metrics.Heartbeat()
    spark.streams.addListener(beat)
    try:
        run = df.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="200 milliseconds").start()
        until = time.time() + 60
        while time.time() < until and beat.alive.get(run.id, {}).get("rows", 0) < 30:
            time.sleep(0.2)
        held = beat.alive[run.id]
        assert held["rows"] == 30 and held["batch"] >= 2
        run.stop()
        while time.time() < until and run.id in beat.alive:
            time.sleep(0.2)
        assert run.id not in beat.alive
    finally:
        spark.streams.removeListener(beat)
