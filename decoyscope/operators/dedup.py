"""First-seen and ranked records, retries and rechecks over histories.

Folds over a key's rows in order run in one task for most keys. Keys of more
rows than `segment` are cut into time segments: every segment is summarised
as a map from the state that comes in to the one that goes out, the maps are
composed in order, and then all segments are replayed at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decoyscope.durable import written

#: Rows of a key that one task folds.
SEGMENT = 1_000_000
#: The state before any row was kept.
NEVER = -(2**62)


def split_hot(rows: DataFrame, key: str, segment: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with up to `segment` rows, rows of the others or None); there are few of the others, as each has so many rows."""
    hot = written(rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > segment).select(F.col(key).alias("_hot")))
    if hot.isEmpty():
        return rows, None
    met = F.col(key).eqNullSafe(F.col("_hot"))
    return rows.join(F.broadcast(hot), met, "left_anti"), rows.join(F.broadcast(hot), met, "left_semi")


def in_segments(rows: DataFrame, key: str, order: list[str], segment: int) -> DataFrame:
    """The rows sorted by key and order over ranges of about `segment` rows, written, with `_part`, the number of the range.

    A range's rows of one key are a segment; ranges ascend, so a key's
    segments do too. Rows that agree in key and order stay in one range.
    """
    by = [F.asc_nulls_first(c) for c in (key, *order)]
    rows = written(rows)  # ranges are found by a sample; the rows aren't worked out again for it
    ranged = rows.repartitionByRange(max(1, -(-rows.count() // segment)), *by).sortWithinPartitions(*by)
    return written(ranged.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))


def time_map(times: np.ndarray, span: int) -> list[tuple[int, int]]:
    """A segment's map of the time kept before it to the one kept last in it: (upper bound of the first, the second), bounds ascending.

    A row is the first one kept for all earlier times that lie more than
    `span` before the row ahead of it. What is kept after it doesn't depend on
    the state any more. Earlier times beyond the last bound stay.
    """
    n = len(times)
    following = np.searchsorted(times, times + span)
    ends = times.copy()
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            ends[i] = ends[following[i]]
    entries = int(np.searchsorted(times, times[0] + span)) + 1  # the state isn't later than the segment's first row
    bounds, ends = (times - span)[:entries], ends[:entries]
    last = np.r_[np.flatnonzero(ends[1:] != ends[:-1]), len(ends) - 1]
    return list(zip(bounds[last].tolist(), ends[last].tolist()))


def _first_segments(ranged: DataFrame, key: str, span: int) -> DataFrame:
    """(key, part, upto, out): the time map of every segment."""
    kind = dict(ranged.dtypes)[key]

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def maps(name, part, times):
            found = time_map(np.concatenate(times), span) if sum(map(len, times)) else []
            return pd.DataFrame({"key": pd.Series([name] * (len(found) + 1), dtype=object), "part": part, "upto": [u for u, _ in found] + [2**62], "out": [o for _, o in found] + [NEVER]})

        name, part, times = None, None, []
        for pdf in batches:
            for (k, p), some in pdf.groupby(["key", "_part"], sort=False, dropna=False):
                k = None if pd.isna(k) else k
                if part is not None and (p, k) != (part, name):
                    yield maps(name, part, times)
                    times = []
                name, part = k, p
                times.append(some["at"].dropna().to_numpy(np.int64))
        if part is not None:
            yield maps(name, part, times)

    slim = ranged.select(F.col(key).alias("key"), "_part", F.col("_at").alias("at"))
    return slim.mapInPandas(summarise, f"key {kind}, part long, upto long, out long")


def _composed(maps: DataFrame) -> dict[int, int]:
    """Range -> the state that comes in to its first key, for ranges in which a key goes on: one number for each range.

    A key's maps are read in order past one value; NEVER as the last entry's
    result lets the state through.
    """

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, part, state, out, done = object(), None, NEVER, NEVER, False
        for pdf in batches:
            found = []
            for k, p, upto, to in zip(pdf["key"], pdf["part"], pdf["upto"], pdf["out"]):
                k = None if pd.isna(k) else k
                if k != name:
                    name, part, out = k, None, NEVER
                if p != part:
                    state, part, done = out, p, False
                    found.append((p, state))
                if not done and state <= upto:
                    out, done = (state if to == NEVER else to), True
            yield pd.DataFrame(found, columns=["part", "state"], dtype=np.int64)

    ordered = maps.repartition("key").sortWithinPartitions(F.asc_nulls_first("key"), "part", "upto")
    return {r["part"]: r["state"] for r in ordered.mapInPandas(compose, "part long, state long").where(F.col("state") != NEVER).collect()}


def first_seen(rows: DataFrame, key: str, ts: str, ttl_seconds: int, tie: str, segment: int = SEGMENT) -> DataFrame:
    """Rows of which no kept row of the same key lies in the `ttl_seconds` before.

    The time counts from the kept row and isn't renewed by rows that are
    dropped: a recurrence that no window frame expresses. Keys are dealt over
    tasks and sorted there (with spill), and Arrow batches run past a fold
    that holds one key's last kept time, never a list. Rows without a time
    are all kept. Keys of more than `segment` rows are folded in segments.
    """
    span = ttl_seconds * 1_000_000
    few, many = split_hot(rows.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))), key, segment)
    out = _first_fold(few.repartition(key).sortWithinPartitions(key, "_at", tie), key, span, {})
    if many is None:
        return out.drop("_at")
    ranged = in_segments(many, key, ["_at", tie], segment)
    states = _composed(_first_segments(ranged, key, span))
    return out.unionByName(_first_fold(ranged, key, span, states).drop("_part")).drop("_at")


def _first_fold(ordered: DataFrame, key: str, span: int, states: dict[int, int]) -> DataFrame:
    """The rows kept of ordered ones; `states` has, by `_part`, the time kept before a range's first row."""

    def fold(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        last_key, last, begun = object(), None, False
        for batch in batches:
            keep = []
            names = batch.column(key).to_pylist()
            if names and not begun:
                begun = True
                if states and (before := states.get(batch.column("_part")[0].as_py())) is not None:
                    last_key, last = names[0], before
            for k, t in zip(names, batch.column("_at").to_pylist()):
                new = k != last_key or last is None or t is None or t - last >= span
                keep.append(new)
                if new:
                    last_key, last = k, t
            yield pc.filter(batch, pa.array(keep, pa.bool_())) if not all(keep) else batch

    return ordered.mapInArrow(fold, ordered.schema)


def rank_first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def newest(rows: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """The `n` newest rows of all, as a sort with a limit, not a window."""
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def _failures(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds _e, the successes before a row, and _k, its number since the last one."""
    w = Window.partitionBy(*by).orderBy(*order)
    epoch = F.coalesce(F.sum(F.col("_ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = Window.partitionBy(*by, "_e").orderBy(*order)
    return rows.withColumn("_e", epoch).withColumn("_k", F.row_number().over(inner).cast("long"))


def retries(rows: DataFrame, key: str, order: list[str], ok: Column, most: int = 3, segment: int = SEGMENT) -> DataFrame:
    """Adds attempt (failures in a row, this one included; 0 for a success) and dead (attempt >= `most`).

    Keys of more than `segment` rows: a segment passes on the failures that
    came in and its own, or only those after its last success.
    """
    few, many = split_hot(rows.withColumn("_ok", ok), key, segment)
    out = _failures(few, [key], order)
    if many is not None:
        each = _failures(in_segments(many, key, order, segment), [key, "_part"], order)
        ends = each.groupBy(key, "_part").agg(F.max(F.struct("_e", "_k", "_ok")).alias("x"), F.max((F.col("_ok")).cast("int")).alias("any"))
        # the last row has the most successes before it; if it is one itself, no failure is passed on
        ends = ends.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), "any", F.when(F.col("x._ok"), 0).otherwise(F.col("x._k")).alias("own"))
        line = Window.partitionBy("_key").orderBy("_p")
        ends = ends.withColumn("g", F.sum("any").over(line))
        ends = ends.withColumn("sum", F.sum("own").over(Window.partitionBy("_key", "g").orderBy("_p")))
        states = ends.select("_key", "_p", F.coalesce(F.lag("sum").over(line), F.lit(0)).alias("_in"))
        met = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p"))
        # as many rows as there are segments
        each = each.join(F.broadcast(states), met).withColumn("_k", F.col("_k") + F.when(F.col("_e") == 0, F.col("_in")).otherwise(0))
        out = out.unionByName(each.drop("_part", "_key", "_p", "_in"))
    return out.withColumn("attempt", F.when(F.col("_ok"), 0).otherwise(F.col("_k")).cast("int")).withColumn("dead", ~F.col("_ok") & (F.col("_k") >= most)).drop("_e", "_k", "_ok")


def rechecks(rows: DataFrame, key: str, order: list, most: int = 3) -> DataFrame:
    """Adds recheck (1 for the first after adoption) and stops after `most`; no more rows of a key than these leave a task, however many it has."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = rows.withColumn("_n", n).where(F.col("_n") <= most + 1).where(F.col("_n") > 1)
    return first.withColumn("recheck", F.col("_n") - 1).withColumn("reason", F.concat(F.lit("Re-check #"), F.col("recheck").cast("string"))).drop("_n")
