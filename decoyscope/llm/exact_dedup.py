"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.llm.common import WHITE, cut, join_groups, read

KEY = ["digest", "check", "n_bytes"]
#: Runs that the partitions' own runs are merged into at first, a power of two, and ranges of digests that each is dealt out in.
RUNS, RANGES = 32, 1024


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row_id and the identity of the normalised text.

    Two texts count as equal when SHA-256, a 64-bit hash of another family
    and the byte length all agree. No two texts of one SHA-256 are known, so
    this says as much as comparing the bytes, and only 44 bytes of a text travel.
    """
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), WHITE, " ")
    return docs.select("doc_id", text.alias("norm")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_id"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64("norm").alias("check"),
        F.octet_length("norm").alias("n_bytes"),
    )


def _merge(level: DataFrame) -> DataFrame:
    """Equal digests of a run as one row: the smallest head and all copies."""
    return level.groupBy("range", "run", *KEY).agg(F.min("head").alias("head"), F.sum("copies").alias("copies"))


def merge_runs(rows: DataFrame, runs: int = RUNS) -> DataFrame:
    """One row per distinct text with its first row (`head`) and its number of copies.

    `rows` has a `part`, the partition it comes from. Each partition sorts its
    digests and merges equal ones, and every `runs`-th partition's run is
    merged into one (a multiway merge). Then come log2(runs) binomial rounds:
    the run of each odd number goes to its neighbour, by ranges of digests, so
    that a range of a pair of runs meets in one task, is sorted there and
    merged by a sort-based aggregate that needs no further exchange and leaves
    it sorted. At every level the digests that meet are verified against the
    second hash and the length, and the smallest row stays. A hot digest
    enters a round at most once per run.
    """
    ranges = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 6), 16, 10).cast("int"), F.lit(RANGES))
    level = _merge(rows.select(ranges.alias("range"), F.pmod("part", F.lit(runs)).alias("run"), *KEY, "head", F.lit(1).cast("long").alias("copies")))
    while runs > 1:
        runs //= 2
        paired = level.withColumn("run", F.shiftright("run", 1)).repartition("range", "run")
        level = _merge(paired.sortWithinPartitions("range", "run", *KEY))
    return level.drop("range", "run")


def exact_dedup(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """Every row of `docs` with the row that stands for its text.

    Nulls count as empty texts. Of equal texts the row with the smallest
    doc_id stays (null ids come last); of rows that also share the id, exactly
    one stays. Texts of any length count whole. Other columns are ignored; an
    empty table gives no rows. `runs` is a power of two.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    narrow = cut(digests(docs))
    head = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    merged = cut(merge_runs(narrow.select(F.shiftright("row_id", 33).cast("int").alias("part"), *KEY, head.alias("head")), runs))
    return join_groups(narrow, merged, KEY, "copies", narrow.count()).select(
        "doc_id",
        F.col("head.doc_id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row_id") == F.col("head.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
