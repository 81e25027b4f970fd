"""Joins with observation snapshots: DNS, registration, networks, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ipv4(s: Column) -> Column:
    """A dotted address as a number; null if it isn't one."""
    parts = F.transform(F.split(s, r"\."), lambda p: F.try_to_number(p, F.lit("999")).cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    return F.when(s.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & F.forall(parts, lambda p: p < 256), number)


def primary_ip(a: Column, aaaa: Column) -> Column:
    """The first address, A records first."""
    none = F.array().cast("array<string>")
    return F.get(F.concat(F.coalesce(a, none), F.coalesce(aaaa, none)), F.lit(0))


def range_join(rows: DataFrame, ranges: DataFrame, value: str, width: int, low: str = "net_start", high: str = "net_end") -> DataFrame:
    """Left join on low <= value <= high (longs) as an equi-join on buckets of `width` with the bounds as a residual.

    A range is copied into each bucket it touches, so choose a width near the
    usual range; disjoint ranges give each row one partner at most.
    """
    cut = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    left = rows.withColumn("_bucket", F.floor(F.col(value) / width))
    test = (left["_bucket"] == cut["_bucket"]) & (left[value] >= cut[low]) & (left[value] <= cut[high])
    return left.join(cut, test, "left").drop("_bucket")


def attach(rows: DataFrame, key: str, **snapshots: DataFrame) -> DataFrame:
    """Left-joins each snapshot on `key` as a struct column of its name."""
    for name, snap in snapshots.items():
        rest = [c for c in snap.columns if c != key]
        rows = rows.join(snap.select(key, F.struct(*rest).alias(name)), key, "left")
    return rows


def with_variant_stats(rows: DataFrame, stats: DataFrame, key: str = "domain") -> DataFrame:
    """Adds registered, unregistered and total to originals; values that a row has already win."""
    joined = rows.join(stats.select(key, F.col("registered").alias("_r"), F.col("unregistered").alias("_u")), key, "left")
    own = lambda name, other: F.when(F.col("is_original_seed"), F.coalesce(F.col(name), F.col(other)))
    out = joined.withColumn("registered", own("registered", "_r")).withColumn("unregistered", own("unregistered", "_u"))
    return out.withColumn("total", F.col("registered") + F.col("unregistered")).drop("_r", "_u")
