"""Addresses matched with networks: nested, overlapping, of either family.

An address is its bits as text, its family before them, so a network is a
prefix of its addresses and an equi-join on prefixes finds all networks that
hold an address. A range that is no network is at most 2 * 128 networks put
side by side, however wide it is; it isn't copied into what it covers.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.operators.enrich import ipv4


def _bits(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> str:
    if address.version == 6 and address.ipv4_mapped:
        address = address.ipv4_mapped
    return f"{address.version}:{int(address):0{address.max_prefixlen}b}"


def address_bits(address: Column) -> Column:
    """`4:` or `6:` and the bits of an address; null if it is none. Only addresses with a colon reach Python."""

    @F.pandas_udf("string")
    def parse(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return _bits(ipaddress.ip_address(text))
            except ValueError:
                return None

        return texts.map(one, na_action="ignore")

    text = F.trim(address)
    colon = F.contains(text, F.lit(":"))
    return F.when(colon, parse(F.when(colon, text))).otherwise(F.concat(F.lit("4:"), F.lpad(F.bin(ipv4(text)), 32, "0")))


def _blocks(network: str | None) -> tuple[list[str], str | None]:
    """The prefixes that make up a network (a/n) or a range (a-b), and its number of addresses in binary of fixed length; none if it can't be read."""
    try:
        if "-" in network:
            first, last = (ipaddress.ip_address(x.strip()) for x in network.split("-"))
            blocks = list(ipaddress.summarize_address_range(first, last))
        else:
            blocks = [ipaddress.ip_network(network.strip(), strict=False)]
    except (ValueError, TypeError):
        return [], None
    size = sum(b.num_addresses for b in blocks)
    return [f"{b.version}:{int(b.network_address):0{b.max_prefixlen}b}"[: 2 + b.prefixlen] for b in blocks], f"{size:0129b}"


def prefixes(networks: DataFrame, network: str = "network") -> DataFrame:
    """`networks` with a row for each `_prefix` of its bits that it is made of, and `_size`; those that can't be read are left out."""

    @F.pandas_udf("prefixes array<string>, size string")
    def cover(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_blocks(t) for t in texts], columns=["prefixes", "size"])

    return networks.withColumn("_n", cover(F.col(network))).select("*", F.explode("_n.prefixes").alias("_prefix"), F.col("_n.size").alias("_size")).drop("_n")


def with_network(rows: DataFrame, networks: DataFrame, address: str, network: str = "network", name: str = "net") -> DataFrame:
    """Adds the struct `name`: the row of the smallest of `networks` that holds `address`, null if none does.

    Networks of one size: the one of the lesser text. Each distinct address
    is cut to the lengths that occur among the networks of its family (at
    most 33 and 129), and the cuts meet the networks' prefixes.
    """
    held = prefixes(networks, network)
    lengths = {r["family"]: r["ns"] for r in held.groupBy(F.left("_prefix", F.lit(2)).alias("family")).agg(F.sort_array(F.collect_set(F.length("_prefix"))).alias("ns")).collect()}
    none = F.array().cast("array<int>")
    cuts = F.when(F.startswith("_bits", F.lit("4:")), F.lit(lengths["4:"]) if "4:" in lengths else none).otherwise(F.lit(lengths["6:"]) if "6:" in lengths else none)
    asked = rows.select(F.col(address).alias("_address")).where(F.col("_address").isNotNull()).distinct().withColumn("_bits", address_bits(F.col("_address"))).where("_bits is not null")
    tried = asked.select("_address", F.explode(F.transform(cuts, lambda n: F.left(F.col("_bits"), n))).alias("_prefix"))
    found = tried.join(held.select("_prefix", "_size", F.col(network).alias("_text"), F.struct(*networks.columns).alias(name)), "_prefix")
    best = found.groupBy("_address").agg(F.min_by(name, F.struct("_size", "_text")).alias(name))
    return rows.join(best, rows[address] == best["_address"], "left").drop("_address")
