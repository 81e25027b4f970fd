"""Pages by a cursor: the next rows after the last one seen, newest first.

Rows lie in files of ascending ranges of (time, id), and the statistics of
each file are kept beside them. A page reads the files between its cursor and
the bound behind which enough rows are known to lie, and takes its rows by a
top-k of these; it sorts no table and skips no rows. Inserts are runs of files
of their own; rows newer than a cursor never shift its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert(path: str, rows: DataFrame, ts: str, id_: str, run: int, files: int | None = None) -> None:
    """Writes a run of rows and its statistics: file, rows, least and greatest (time, id). A run that is repeated is replaced; rows without time or id are left out."""
    kept = rows.where(F.col(ts).isNotNull() & F.col(id_).isNotNull())
    ranged = kept.repartitionByRange(files, ts, id_) if files else kept.repartitionByRange(ts, id_)
    ranged.sortWithinPartitions(ts, id_).write.mode("overwrite").parquet(f"{path}/rows/run={run}")
    spark = rows.sparkSession
    back = spark.read.schema(rows.schema).parquet(f"{path}/rows/run={run}")
    at = F.struct(F.col(ts).alias("t"), F.col(id_).alias("i"))
    stats = back.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/run={run}")


def _before(ts: str, id_: str, cursor: tuple | None) -> Column:
    """Rows older than the cursor; the first half of the test is one that files answer by their least and greatest values."""
    if cursor is None:
        return F.lit(True)
    t, i = F.lit(cursor[0]), F.lit(cursor[1])
    return (F.col(ts) <= t) & ((F.col(ts) < t) | (F.col(id_) < i))


def files_of(spark: SparkSession, path: str, limit: int, cursor: tuple | None) -> list[str]:
    """The files that a page must read: one row of statistics each is looked at, newest first."""
    stats = spark.read.parquet(f"{path}/stats").orderBy(F.desc("high")).collect()
    older = [s for s in stats if cursor is None or tuple(s["low"]) < tuple(cursor)]
    # whole files behind the cursor, from the newest on, until they hold a page: no row beyond their least one can be on it
    held, bound = 0, None
    for s in older:
        if cursor is None or tuple(s["high"]) < tuple(cursor):
            held, bound = held + s["n"], min(x for x in (bound, tuple(s["low"])) if x is not None)
            if held >= limit:
                break
    return [s["file"] for s in older if held < limit or tuple(s["high"]) >= bound]


def page(spark: SparkSession, path: str, ts: str, id_: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """The next `limit` rows, newest first, after the cursor (time, id) of the last row seen; from the newest on without one. Ids of one time are unique."""
    some = files_of(spark, path, limit, cursor)
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*some) if some else spark.read.parquet(f"{path}/rows").limit(0)
    return rows.drop("run").where(_before(ts, id_, cursor)).orderBy(F.desc(ts), F.desc(id_)).limit(limit)
