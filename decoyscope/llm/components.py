"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decoyscope.llm.common import cut, join_groups

#: Links that are contracted in one task (16 bytes each); rows of links in a partition of a written round, about.
BLOCK, TOGETHER = 1_000_000, 200_000


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index linked to each index, however many steps away."""
    root = np.arange(n)
    for a, b in links:
        while len(a):
            a, b = root[a], root[b]
            part = a != b
            a, b = a[part], b[part]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    links = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype=np.int64), *batches])
    nodes, at = np.unique(links[["u", "v"]].to_numpy(np.int64).T, return_inverse=True)
    u, v = at.reshape(2, -1)
    yield pd.DataFrame({"node": nodes, "root": nodes[forest(len(nodes), [(u, v)])]})


def components(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) for every node of `edges` (u long, v long); the root is the smallest node.

    Up to `block` links, counted, are contracted in one task. More are
    contracted in rounds of all tasks: only a minimum per node is gathered,
    never a list of neighbours, and the rows of a node with very many links
    stay where they are, so such a node costs a task no more than another.
    Each round is written to the shared folder, in as many parts as its rows
    need; rounds end when no link changes. Repeated links and links of a node
    to itself count for nothing; an empty table gives no rows.
    """
    links = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state, n = None, links.count()
    if n <= block:
        return cut(links.coalesce(1).mapInPandas(_contract, "node long, root long"))
    while True:
        written = lambda df, n=n: cut(df.coalesce(max(8, n // TOGETHER)))
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
        large = written(join_groups(both.where("v > u"), least, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_groups(large, least, ["u"], "n", n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        links = written(small.select("e.u", "e.v").where("u <> v").distinct())
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state, n = now, now[0]
