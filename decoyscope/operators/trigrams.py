"""Substring search by an index of short character runs.

Every run of two and of three characters of a row's lower-cased text is a
posting. A needle's rows have all of its runs, so the postings of its rarest
runs are intersected and only these rows are read and verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a needle, the rarest, whose postings are intersected; candidates up to which their ids are broadcast.
RAREST, BROADCAST_ROWS = 4, 500_000


def runs(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters of a text in lower case; none of shorter texts and of null."""
    low = F.lower(text)
    at = F.sequence(F.lit(1), F.length(low) - size + 1)
    every = F.when(F.length(low) >= size, F.array_distinct(F.transform(at, lambda i: F.substr(low, i, F.lit(size)))))
    return F.coalesce(every, F.array().cast("array<string>"))


def build(path: str, rows: DataFrame, id_: str, text: str) -> None:
    """Writes the rows, their postings (run, id) sorted by run, and how many rows have each run; ids are unique."""
    rows.repartitionByRange(id_).sortWithinPartitions(id_).write.mode("overwrite").parquet(f"{path}/rows")
    kept = rows.sparkSession.read.parquet(f"{path}/rows")
    each = kept.select(F.col(id_).alias("id"), F.explode(F.concat(runs(F.col(text), 2), runs(F.col(text), 3))).alias("run"))
    each.repartitionByRange("run").sortWithinPartitions("run", "id").write.mode("overwrite").parquet(f"{path}/postings")
    counts = kept.sparkSession.read.parquet(f"{path}/postings").groupBy("run").agg(F.count("*").alias("n"))
    counts.repartitionByRange("run").sortWithinPartitions("run").write.mode("overwrite").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame | None:
    """(id) of the rows that have the rarest runs of a needle; None if it is too short to have one.

    The runs of a needle are few; files whose least and greatest run don't
    enclose them aren't read.
    """
    if len(needle) < 2:
        return None
    wanted = [r["run"] for r in spark.range(1).select(F.explode(runs(F.lit(needle), 3 if len(needle) > 2 else 2)).alias("run")).collect()]
    known = {r["run"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("run").isin(wanted)).collect()}
    postings = spark.read.parquet(f"{path}/postings")
    if len(known) < len(wanted):
        return postings.select("id").limit(0)
    some = sorted(known, key=known.get)[:RAREST]
    return postings.where(F.col("run").isin(some)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(some)).select("id")


def find(spark: SparkSession, path: str, id_: str, text: str, needle: str) -> DataFrame:
    """The rows whose text contains the needle, whatever the case; an empty needle finds all, and one of a single character is looked for in all."""
    from decoyscope.operators.search import like

    rows, some = spark.read.parquet(f"{path}/rows"), candidates(spark, path, needle)
    if some is not None:
        ids = some.withColumnRenamed("id", "_id")
        rows = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, F.col(id_) == F.col("_id"), "left_semi")
    return rows.where(like(F.col(text), needle))
