"""Nearest 64-bit hashes by Hamming distance, by multi-index hashing.

A hash is cut into BLOCKS blocks. Two hashes within BLOCKS * (r + 1) - 1 bits
of each other differ in at most r bits in one of their blocks at least. So
hashes meet where a block is equal (r = 0), then those still unmatched where a
block has one other bit (r = 1). What is nearer than that is an exact minimum;
only hashes without any neighbour so near are compared with all of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.durable import written

BITS, BLOCKS = 64, 9
SIZES = [BITS // BLOCKS + (i < BITS % BLOCKS) for i in range(BLOCKS)]


def blocks(value: Column, flips: int = 0) -> Column:
    """An array of (number, bits) of a hash's blocks, each also with every one of its bits turned if `flips` is 1."""
    out, below = [], BITS
    for i, size in enumerate(SIZES):
        below -= size
        bits = F.shiftrightunsigned(value, below).bitwiseAND((1 << size) - 1).cast("int")
        turned = [bits, *[bits.bitwiseXOR(1 << j) for j in range(size)]] if flips else [bits]
        out += [F.struct(F.lit(i).alias("i"), b.alias("bits")) for b in turned]
    return F.array(*out)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def candidates(asked: DataFrame, known: DataFrame, group: str, value: str, flips: int) -> DataFrame:
    """(group, value, other): pairs of one group that agree in a block up to `flips` bits; a pair that agrees in several comes as often."""
    index = known.select(group, F.col(value).alias("other"), F.explode(blocks(F.col(value))).alias("block"))
    probe = asked.select(group, value, F.explode(blocks(F.col(value), flips)).alias("block"))
    return probe.join(index, [group, "block"]).select(group, value, "other")


def nearest(rows: DataFrame, known: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, distance) of the distinct hashes of `rows` whose group has some in `known`: the least distance to these.

    Null groups and hashes have no distance. Distinct hashes are compared, so
    copies cost nothing more.
    """
    some = known.select(group, value).dropna().distinct()
    left = written(rows.select(group, value).dropna().distinct().join(some.select(group).distinct(), group, "left_semi"))
    found = None
    for flips in (0, 1):
        near = candidates(left, some, group, value, flips).groupBy(group, value).agg(F.min(distance(F.col(value), F.col("other"))).alias("distance"))
        near = written(near.where(F.col("distance") <= BLOCKS * (flips + 1) - 1))
        found = near if found is None else found.unionByName(near)
        left = written(left.join(near, [group, value], "left_anti"))
    rest = left.join(some.withColumnRenamed(value, "other"), group).groupBy(group, value).agg(F.min(distance(F.col(value), F.col("other"))).alias("distance"))
    return found.unionByName(rest)


def logo_match(pages: DataFrame, logos: DataFrame, most: int = 8) -> DataFrame:
    """(page_id, distance, detected): least Hamming distance of a page's phash to its brand's logos, as `match.logo_match` gives it."""
    near = nearest(pages, logos, "cse_id", "phash")
    return pages.select("page_id", "cse_id", "phash").join(near, ["cse_id", "phash"]).groupBy("page_id").agg(F.min("distance").alias("distance")).withColumn("detected", F.col("distance") <= most)
