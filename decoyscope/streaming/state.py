"""Keyed state over streams: dedup, recheck, fusion, retries, progress.

A key's rows of one micro-batch are ordered in one task; a source's
maxFilesPerTrigger or maxBytesPerTrigger bounds how many these can be.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The worker that starts a processor on the driver doesn't see files sent with a job, so these classes travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY = 86_400
#: Delays of the inactive and the unregistered schedule, in days.
INACTIVE_DAYS, UNREGISTERED_DAYS, MOST = (7, 30, 90), (30, 90, 180), 3


class FirstSeen(StatefulProcessor):
    """Lets a row pass if none passed for its key in the span before, by the rows' own times."""

    def __init__(self, span_seconds: int):
        self.span = span_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["at", "event_id"], ignore_index=True)
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for at in pdf["at"]:
            new = last is None or at - last >= self.span
            keep.append(new)
            last = at if new else last
        if last is not None:
            self.last.update((int(last),))
        yield pdf[keep]

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, key: str, span_seconds: int) -> DataFrame:
    """rows: key, event_id long, at (microseconds) long. TTL dedup of a stream."""
    schema = rows.select(key, "event_id", "at").schema
    return rows.select(key, "event_id", "at").groupBy(key).transformWithStateInPandas(FirstSeen(span_seconds), schema, "Append", "None")


def first_seen_native(rows: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Without Python, where keeping one row per key and watermark span is enough."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


class Recheck(StatefulProcessor):
    """Active monitoring: a verdict sets a due time; when it comes, a re-check is emitted, three at most.

    Works on event rows (`due` set) and clock rows (`due` null): a key's own
    later rows and timers both trigger what is due.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "due bigint, count int")

    def _due(self, key, now: int) -> list[tuple]:
        out = []
        if self.entry.exists():
            due, count = self.entry.get()
            if due is not None and due <= now:
                count += 1
                out.append((key[0], due, count, f"Re-check #{count}"))
                if count >= MOST:
                    self.entry.clear()
                else:
                    self.entry.update((None, count))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["at", "due"], ignore_index=True)
        for at, due in zip(pdf["at"], pdf["due"]):
            out += self._due(key, int(at))
            if pd.notna(due):
                count = self.entry.get()[1] if self.entry.exists() else 0
                if count < MOST:
                    self.entry.update((int(due), count))
                    self.handle.registerTimer(int(due) * 1000)
        yield pd.DataFrame(out, columns=["domain", "due", "recheck", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self._due(key, expiredTimerInfo.getExpiryTimeInMs() // 1000), columns=["domain", "due", "recheck", "reason"])

    def close(self) -> None:
        pass


def recheck(rows: DataFrame) -> DataFrame:
    """rows: domain string, at long, due long (epoch seconds, null for none) -> domain, due, recheck, reason."""
    return rows.select("domain", "at", "due").groupBy("domain").transformWithStateInPandas(Recheck(), "domain string, due long, recheck int, reason string", "Append", "ProcessingTime")


class InactiveRecheck(StatefulProcessor):
    """Inactive monitoring: at a due time a resolved domain is handed back, another waits on, three checks at most.

    The delay after the n-th check is the n-th of the schedule, so the first
    delay serves twice. `resolved` is joined from the latest observations. A
    key's rows of a batch are put in order of time, whatever chunks they come
    in; rows older than the newest one seen don't set the clock back. With
    timers a check is made when it is due, by the last observation; else when
    the key's next row arrives.
    """

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "due bigint, count int, slow boolean, resolved boolean")

    def _delay(self, slow: bool, n: int) -> int:
        return (UNREGISTERED_DAYS if slow else INACTIVE_DAYS)[n] * DAY

    def _check(self, entry: tuple, at: int) -> tuple[tuple | None, tuple | None]:
        """What is left of an entry at `at`, and (checks, outcome) of a check that is due by then."""
        due, count, slow, resolved = entry
        if due is None or at < due:
            return entry, None
        if resolved:
            return None, (count + 1, "newly_active")
        if count + 1 >= MOST:
            return (None, MOST, slow, resolved), (count + 1, "dropped")
        return (at + self._delay(slow, count), count + 1, slow, resolved), None

    def _keep(self, before: tuple | None, entry: tuple | None) -> None:
        """State is written once a batch, if it changed; a due time that stays has its timer already."""
        if entry == before:
            return
        if entry is None:
            self.entry.clear()
            return
        self.entry.update(entry)
        if self.timed and entry[0] is not None and (before is None or before[0] != entry[0]):
            self.handle.registerTimer(entry[0] * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = sorted((int(at), bool(resolved), bool(slow)) for pdf in rows for at, slow, resolved in zip(pdf["at"].tolist(), pdf["unregistered"].tolist(), pdf["resolved"].tolist()))
        before = entry = tuple(self.entry.get()) if self.entry.exists() else None
        out = []
        for at, resolved, slow in seen:
            if entry is None:
                entry = (at + self._delay(slow, 0), 0, slow, resolved)
                continue
            entry, told = self._check((*entry[:3], resolved), at)
            if told:
                out.append((key[0], at, *told))
        self._keep(before, entry)
        yield pd.DataFrame(out, columns=["domain", "at", "checks", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told, at = None, expiredTimerInfo.getExpiryTimeInMs() // 1000
        if self.entry.exists():
            before = tuple(self.entry.get())
            entry, told = self._check(before, at)
            self._keep(before, entry)
        yield pd.DataFrame([(key[0], at, *told)] if told else [], columns=["domain", "at", "checks", "outcome"])

    def close(self) -> None:
        pass


def inactive_recheck(rows: DataFrame, timed: bool = False) -> DataFrame:
    """rows: domain, at (epoch seconds), unregistered, resolved -> domain, at, checks, outcome.

    `timed` checks by the clock, for which Spark runs batches without end;
    otherwise an availableNow run ends.
    """
    keyed = rows.select("domain", "at", "unregistered", "resolved").groupBy("domain")
    return keyed.transformWithStateInPandas(InactiveRecheck(timed), "domain string, at long, checks int, outcome string", "Append", "ProcessingTime" if timed else "None")


class Fusion(StatefulProcessor):
    """Keeps the newest part of each kind of a key and emits the key's parts whenever one arrives; idle keys expire.

    One value holds all parts of a key, so that a batch reads and writes a
    key's state once.
    """

    def __init__(self, kinds: list[str], idle_seconds: int | None):
        self.kinds, self.idle = kinds, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = ", ".join(f"{k}_at bigint, {k}_id bigint, {k} double" for k in self.kinds)
        self.parts = handle.getValueState("parts", schema, ttlDurationMs=self.idle * 1000 if self.idle else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.parts.get()) if self.parts.exists() else [None] * (3 * len(self.kinds))
        place = {kind: 3 * i for i, kind in enumerate(self.kinds)}
        for pdf in rows:
            for kind, at, id_, value in zip(pdf["kind"].tolist(), pdf["at"].tolist(), pdf["event_id"].tolist(), pdf["value"].tolist()):
                i = place.get(kind)
                if i is not None and (held[i] is None or tuple(held[i : i + 2]) <= (at, id_)):
                    held[i : i + 3] = [int(at), int(id_), float(value)]
        self.parts.update(tuple(held))
        yield pd.DataFrame({"k": [key[0]], **{k: [float("nan") if held[3 * i + 2] is None else held[3 * i + 2]] for i, k in enumerate(self.kinds)}})

    def close(self) -> None:
        pass


def fuse(rows: DataFrame, key: str, kinds: list[str], idle_seconds: int | None = 300) -> DataFrame:
    """rows: key, kind, at, event_id, value -> key as k and a column of each kind's newest value, per batch.

    Without idle_seconds nothing expires, and an availableNow run ends; expiry
    goes by the clock, for which Spark runs batches without end.
    """
    schema = f"k {dict(rows.dtypes)[key]}, " + ", ".join(f"{k} double" for k in kinds)
    return rows.select(key, "kind", "at", "event_id", "value").groupBy(key).transformWithStateInPandas(Fusion(kinds, idle_seconds), schema, "Update", "ProcessingTime" if idle_seconds else "None")


class Retry(StatefulProcessor):
    """Counts failures in a row; a success clears them."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failed = handle.getValueState("failed", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["at", "event_id"], ignore_index=True)
        n = self.failed.get()[0] if self.failed.exists() else 0
        attempts = []
        for ok in pdf["ok"]:
            n = 0 if ok else n + 1
            attempts.append(n)
        self.failed.update((n,))
        yield pd.DataFrame({"k": key[0], "event_id": pdf["event_id"], "attempt": attempts, "dead": [a >= self.most for a in attempts]})

    def close(self) -> None:
        pass


def retries(rows: DataFrame, key: str, most: int = 3) -> DataFrame:
    """rows: key, at, event_id, ok -> k, event_id, attempt, dead."""
    schema = f"k {dict(rows.dtypes)[key]}, event_id long, attempt int, dead boolean"
    return rows.select(key, "at", "event_id", "ok").groupBy(key).transformWithStateInPandas(Retry(most), schema, "Append", "None")


def progress(rows: DataFrame, seed: str, url: str, delay: str, ts: str) -> DataFrame:
    """Crawled and failed urls of each seed, each url and status once within the watermark's span; update mode."""
    once = rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([seed, url, "status"])
    return once.groupBy(seed).agg(F.count_if(F.col("status") == "ok").alias("crawled"), F.count_if(F.col("status") == "failed").alias("failed"))


def windowed_verdicts(rows: DataFrame, ts: str, kind: str, size: str = "1 hour", slide: str | None = None, gap: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts per event-time window and kind: tumbling, sliding, or sessions with `gap`."""
    w = F.session_window(ts, gap) if gap else F.window(ts, size, slide)
    return rows.withWatermark(ts, delay).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def upsert_stream(rows: DataFrame, path: str, key: str, ts: str, checkpoint: str, merge: bool = True, drain: bool = False):
    """Micro-batch upsert: batch n writes version n of the collection at `path`, again the same if it is repeated; `drain` ends with the source."""
    from decoyscope.sources.collections import upsert

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: upsert(df.sparkSession, path, df, key, ts, n, merge))
    return (writer.trigger(availableNow=True) if drain else writer).start()
