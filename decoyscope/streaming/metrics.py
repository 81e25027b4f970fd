"""Run metrics of jobs and streams, taken while the rows pass.

Counts are observed in the pass that writes the rows, so they cost no job of
their own. Metrics of a batch are a row in a folder named by the batch: a
batch that is repeated after a failure replaces its row, and sums over the
folder are those of a run without failures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counters(emitted: Column, host: str | None = None) -> dict[str, Column]:
    """What a run counts: messages, emitted ones and, if named, hosts (a sketch of the distinct ones, which merges over batches)."""
    counts = {"messages": F.count(F.lit(1)), "emitted": F.count_if(emitted)}
    return counts | ({"hosts": F.hex(F.hll_sketch_agg(host, F.lit(12)))} if host else {})


def passing(df: DataFrame, measures: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """`df` with its measures observed; `Observation.get` has them once the rows were written."""
    seen = Observation()
    return df.observe(seen, *[c.alias(k) for k, c in measures.items()]), seen


def record(spark: SparkSession, path: str, batch: int, values: dict) -> None:
    """Puts the row of a batch in place of what it may have left before."""
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    spark.createDataFrame([tuple(values.values())], schema).coalesce(1).write.mode("overwrite").json(f"{path}/batch={batch}")


def metered(rows: DataFrame, sink: Callable[[DataFrame, int], None], measures: dict[str, Column], path: str, checkpoint: str, drain: bool = False, hosts: tuple[str, str] | None = None):
    """Starts a stream that gives each batch to `sink`, which must bear repetition, and then records its measures below `path`.

    `hosts` (column, folder) keeps the distinct hosts of each batch too, for an exact count of them.
    """

    def batch(df: DataFrame, n: int) -> None:
        watched, seen = passing(df, measures)
        sink(watched, n)
        if hosts:
            df.select(F.col(hosts[0]).alias("host")).distinct().write.mode("overwrite").parquet(f"{hosts[1]}/batch={n}")
        record(df.sparkSession, path, n, dict(seen.get))

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def both_sinks(topic: Callable[[DataFrame, int], None], path: str) -> Callable[[DataFrame, int], None]:
    """A sink of two: JSON lines in a folder of the batch below `path`, then `topic`.

    The batch is worked out once for both. Its folder is replaced when it is
    repeated, so a failure between the sinks and a restart leave each line
    once; `topic` is called again for the whole batch, under the same number.
    """

    def write(df: DataFrame, n: int) -> None:
        kept = df.persist()
        try:
            kept.write.mode("overwrite").json(f"{path}/batch={n}")
            topic(kept, n)
        finally:
            kept.unpersist()

    return write


def summed(spark: SparkSession, path: str, hosts: str | None = None) -> DataFrame:
    """One row of messages, emitted and distinct hosts over all batches below `path`.

    Hosts are counted exactly from the folder that `metered` kept them in, or
    else estimated by sketches (exact below some thousands).
    """
    rows = spark.read.schema("messages long, emitted long, hosts string").json(path)
    sums = [F.sum("messages").alias("messages"), F.sum("emitted").alias("emitted")]
    if not hosts:
        return rows.agg(*sums, F.hll_sketch_estimate(F.hll_union_agg(F.unhex("hosts"))).alias("unique_hosts"))
    return rows.agg(*sums).crossJoin(F.broadcast(spark.read.parquet(hosts).agg(F.count_distinct("host").alias("unique_hosts"))))  # one row each


class Heartbeat(StreamingQueryListener):
    """Keeps the last progress of each running stream: batch, rows, rows a second and observed measures; `alive` has them."""

    def __init__(self):
        self.alive: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.alive[str(event.id)] = {"batch": None, "rows": 0, "rate": 0.0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        held = self.alive.setdefault(str(p.id), {"rows": 0})
        held |= {"batch": p.batchId, "rows": held["rows"] + p.numInputRows, "rate": p.processedRowsPerSecond, "measures": {k: r.asDict() for k, r in (p.observedMetrics or {}).items()}}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.alive.pop(str(event.id), None)
