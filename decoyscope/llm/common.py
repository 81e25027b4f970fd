"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts name it: space and U+0009 to U+000D.
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent, and only
    under a local master, where every task runs on this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows that Python gets at a time where each brings a whole text.
TEXTS = 1000


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Writes the rows to the shared folder, so later reads don't depend on executors.

    What the optimizer knows of the rows by their history isn't kept either:
    in loops that knowledge doubles with every round. `batch` bounds the rows
    that a Python worker holds at a time.
    """
    spark = df.sparkSession
    shared_dir(spark)
    settings = {"spark.sql.constraintPropagation.enabled": "false"}
    if batch:
        settings["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch)
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return df.checkpoint()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def give_back() -> None:
    """Hands memory that a Python worker has freed back to the system: workers live on for later stages, whose share it would take."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def driver_gives_back(spark: SparkSession) -> None:
    """The driver drops what nothing refers to, shuffles and checkpoints with it, and hands freed memory back to the system.

    Else both its heap and what its JVM's threads have freed outside of it stay as large as at their peak.
    """
    gc.collect()
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    with contextlib.suppress(Exception):  # a JVM without this command
        name, kinds = jvm.java.lang.Class.forName, array(jvm.java.lang.Class, 4)
        kinds[0], kinds[1], kinds[2], kinds[3] = (name(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        call = array(jvm.java.lang.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # found by the interface, as the server's own class is not open to calls
        name("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    give_back()


#: What Python workers keep from task to task: how it is dropped, by who keeps it; and whose tasks a worker ran last.
_KEPT: dict[str, Callable[[], None]] = {}
_AT_WORK = [""]


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Names what `owner` keeps in a Python worker; it goes when the worker begins another one's tasks."""
    _KEPT[owner] = drop


def begins(owner: str) -> None:
    """To be called where a task of `owner` begins: what others have kept in this worker is dropped and handed back."""
    if _AT_WORK[0] != owner:
        for other, drop in _KEPT.items():
            if other != owner:
                drop()
        _AT_WORK[0] = owner
        give_back()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store whose rows nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key that holds more than 1 / HOT of all rows is hot; there are fewer than HOT of these.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """`rows` with the columns of their group, by an inner join that no hot key can load onto one task.

    `groups` has one row per key and its number of rows, `size`, out of
    `total`. Hot groups, fewer than HOT by their definition, are broadcast
    and meet their rows where these are; the others are shuffled.
    """
    hot = groups.where(F.col(size) * HOT > total)
    if hot.isEmpty():
        return rows.join(groups, keys)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(size) * HOT <= total), keys)
    return near.unionByName(far)


#: Rows of ids or hashes up to which `small` broadcasts a table.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A written table of a few narrow columns, to be broadcast if its rows are few enough, so that texts stay where they are."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Hashes up to which `among` sends a table's to all workers, 8 bytes each.
HASHES = 2_000_000


def among(hashes: DataFrame) -> Callable[[str], Column] | None:
    """Whether a long is in the only column of a written table: rows are told apart where they are, and the driver gets 8 bytes of each hash where `small` takes some 200. None beyond HASHES rows."""
    if hashes.count() > HASHES:
        return None
    sent = hashes.sparkSession.sparkContext.broadcast(np.unique(hashes.toArrow().column(0).to_numpy()))
    give_back()

    @F.pandas_udf("boolean")
    def work(asked: pd.Series) -> pd.Series:
        x, known = asked.to_numpy(np.int64), sent.value
        at = np.searchsorted(known, x)
        return pd.Series(known[np.minimum(at, len(known) - 1)] == x if len(known) else np.zeros(len(x), dtype=bool))

    return lambda name: work(F.col(name))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def in_batches(batches: Iterator, rows: int) -> Iterator:
    """Cuts pandas batches so that none holds more than `rows` rows."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]
