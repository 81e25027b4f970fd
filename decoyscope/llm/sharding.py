"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decoyscope.llm.common import cut, join_groups, read
from decoyscope.llm.differencing import differencing

#: Items that one differencing takes, and the bundles it leaves of them.
ITEMS, BUNDLES = 4096, 256


def _part(items: DataFrame, ways: int) -> DataFrame:
    """Adds `way` to each item: one differencing for each value of `bucket`."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True])
        return pdf.assign(way=differencing(pdf["size"].to_numpy(np.int64), ways))

    return items.groupBy("bucket").applyInPandas(split, "bucket int, item long, size long, way long")


def _balance(groups: DataFrame, shards: int, total: int, n: int) -> DataFrame:
    """(item, shard) for groups (item, size).

    While more than `ITEMS` items are left, small items are dealt into
    buckets by hash, and a differencing in each bucket glues them into
    `BUNDLES` bundles of near-equal size, which are the items of the next
    level; items larger than a bundle pass through. So no task holds more
    than a bounded number of items, and the last level still has items small
    enough to fill the gaps that a large group leaves.
    """
    levels = []
    items = groups
    while n > ITEMS + shards * BUNDLES:
        buckets = -(-n // ITEMS)
        large = max(1, total // (shards * BUNDLES))
        small = items.where(F.col("size") <= large).withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int"))
        glued = cut(_part(small.select("bucket", "item", "size"), BUNDLES).select(
            "item", F.xxhash64(F.lit(len(levels)), "bucket", "way").alias("bundle"), "size"))
        levels.append(glued.select("item", "bundle"))
        items = cut(items.where(F.col("size") > large).select("item", "size").unionByName(
            glued.groupBy("bundle").agg(F.sum("size").alias("size")).withColumnRenamed("bundle", "item")))
        n, before = items.count(), n
        if n >= before:  # a level leaves a sixteenth and a bounded number of large items
            raise RuntimeError(f"differencing left {n} of {before} items")
    placed = cut(_part(items.select(F.lit(0).alias("bucket"), "item", "size"), shards).select("item", F.col("way").cast("int").alias("shard")))
    for bundles in reversed(levels):
        placed = placed.unionByName(bundles.join(placed.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard"))
    return placed


def shard(docs: DataFrame, shards: int = 24, divide: bool = False) -> DataFrame:
    """Puts every row into one of `shards` shards of near-equal bytes.

    A row's size is its text's UTF-8 bytes plus 8. Rows with equal texts form
    a group that goes to one shard as a whole. So a group larger than a fair
    share (total / shards) leaves its shard as much larger than the others,
    which are balanced among themselves. With `divide`, such groups, of which
    there are fewer than `shards`, are cut into the fewest pieces that aren't
    larger. A null text counts as empty. Repeated rows each get a slot; null
    ids are kept. Other columns are ignored; an empty table gives no rows.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.md5(text.cast("binary"))).alias("item"),
    ))
    sized = lambda: cut(rows.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    groups = sized()
    total, n, n_rows = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    fair = max(1, total // shards)
    # fewer than `shards` rows, as each holds more than a fair share
    pieces = {r["item"]: -(-r["size"] // fair) for r in groups.where(F.col("size") > fair).collect()} if divide else {}
    if pieces:
        piece = F.lit(None).cast("long")
        for item, k in pieces.items():
            piece = F.when(F.col("item") == item, F.pmod(F.xxhash64("row_id"), F.lit(k))).otherwise(piece)
        rows = rows.withColumn("item", F.when(F.col("item").isin(list(pieces)), F.xxhash64("item", piece)).otherwise(F.col("item")))
        groups = sized()
        n = groups.count()
    placed = cut(groups.select("item", "n").join(_balance(groups.select("item", "size"), shards, total, n), "item"))
    placed = join_groups(rows, placed, ["item"], "n", n_rows)

    # Slots: rows are counted in blocks, the blocks' counts are summed up, and only a block is numbered in one task.
    blocks = max(16, -(-n_rows // (shards * 20_000)))
    placed = cut(placed.select("doc_id", "row_id", "size", "text_crc32", "shard").withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int")))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "row_id")
    return placed.withColumn("at", F.row_number().over(within) - 1).join(starts, ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("at")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
