"""A Merkle manifest of a table, kept as an append log in postorder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decoyscope.llm.common import crc_mod, cut, read

#: Nodes that become one; levels that a builder closes by itself; nodes that a builder gets at most; nodes in a group of builders, about.
ARITY, LEVELS = 3, 5
ALIGNED, TOGETHER = ARITY**LEVELS, 1000
#: Bytes of a digest.
WIDE = 32


def joined(digests: list[bytes]) -> bytes:
    """The digest of digests written after each other as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def position(level: int, index: int, leaves: int) -> int:
    """Where the log has a node, in closed form.

    A node is written right after the last leaf below it and the levels
    between; before a leaf stand all leaves to its left and, for every level,
    the nodes that these fill.
    """
    last = min((index + 1) * ARITY**level, leaves) - 1
    at, filled = last + level, last // ARITY
    while filled:
        at, filled = at + filled, filled // ARITY
    return at


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    up = 0
    while leaves > 1:
        leaves, up = -(-leaves // ARITY), up + 1
    return up


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """All nodes in the order in which they are completed, `levels` levels above the leaves; the last one is the root."""
    log, runs = [], [[] for _ in range(levels + 1)]
    for i, node in enumerate(leaves):
        for level, run in enumerate(runs):
            log.append(node)
            run.append(node)
            if level == levels or (len(run) < ARITY and i + 1 < len(leaves)):
                break
            node = joined(run)
            run.clear()
    return log


def _levels(chunk: int, leaves: int) -> int:
    """Levels of a builder's nodes: a tree's only one ends at the root, others at their common level."""
    return LEVELS if chunk else height(leaves)


def path(log: list[bytes], index: int, leaves: int, levels: int) -> bytes:
    """A leaf's way to the builder's last node: for each level its place in the run and the number of others as one byte, and their digests."""
    out, n = [], leaves
    for level in range(levels):
        first = index - index % ARITY
        others = [log[position(level, i, leaves)] for i in range(first, min(first + ARITY, n)) if i != index]
        out += [bytes([(index - first) << 4 | len(others)]), *others]
        index, n = index // ARITY, -(-n // ARITY)
    return b"".join(out)


def steps(way: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, other digests of the run) for each level of a path."""
    at = 0
    while at < len(way):
        place, n = way[at] >> 4, way[at] & 15
        yield place, [way[at + 1 + i * WIDE : at + 1 + (i + 1) * WIDE] for i in range(n)]
        at += 1 + n * WIDE


def fold(leaf: bytes, way: bytes) -> bytes:
    """The root that a leaf and its path make."""
    for place, others in steps(way):
        leaf = joined([*others[:place], leaf, *others[place:]])
    return leaf


def proof_digest(way: bytes) -> str:
    """The hex digest of a path's other digests, level by level, left to right."""
    return joined([d for _, others in steps(way) for d in others]).hex()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The leaf of a row of documents that has this text."""
    return F.unhex(F.sha2(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)), 256))


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `pos`, their rank from 0 in their `tree`, null values first.

    Rows are sorted into ranges, whatever trees these hold, so a large tree
    has many tasks. Of a range only its first tree can have begun before, so
    one number for each range is all that is sent back to place its rows.
    """
    order = ("tree", *order)
    rows = cut(rows)  # ranges are found by a sample, for which nothing is worked out again
    by = [F.asc_nulls_first(c) for c in order]
    ranged = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    spans = ranged.groupBy(F.shiftright("at", 33).alias("range"), "tree").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = {r["range"]: r["before"] for r in spans.withColumn("before", before).where("before > 0").select("range", "before").collect()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, begin = None, 0
        for pdf in batches:
            at, trees = pdf["at"].to_numpy(np.int64), pdf["tree"].to_numpy(object)
            if not len(at):
                continue
            new = np.r_[trees[0] != tree, trees[1:] != trees[:-1]]
            begins = np.flatnonzero(new)
            value = at[begins].copy()
            if len(begins) and begins[0] == 0 and at[0] & (2**33 - 1) == 0:
                value[0] -= carried.get(int(at[0]) >> 33, 0)
            value = np.r_[begin, value]
            yield pdf.assign(pos=at - value[np.cumsum(new)])
            tree, begin = trees[-1], value[-1]

    return cut(ranged.mapInPandas(place, ranged.schema.simpleString()[7:-1] + ",pos:bigint").drop("at"))


def _group(chunk: Column, n: int) -> Column:
    """Builders are worked off in groups, so that many small trees make few calls."""
    return F.pmod(F.xxhash64("tree", chunk), F.lit(max(12, -(-n // TOGETHER)))).cast("int")


def _built(nodes: DataFrame, n: int) -> DataFrame:
    """(tree, chunk, digest, log) of every builder over nodes (tree, pos, digest): its last node, and all in completion order."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["tree", "pos"])
        for (tree, chunk), part in pdf.groupby(["tree", "chunk"], sort=False):
            log = append_log(list(part["digest"]), _levels(chunk, len(part)))
            out.append((tree, chunk, log[-1], b"".join(log)))
        return pd.DataFrame(out, columns=["tree", "chunk", "digest", "log"])

    chunk = F.floor(F.col("pos") / ALIGNED)
    dealt = nodes.select("tree", "pos", "digest", chunk.alias("chunk"), _group(chunk, n).alias("group"))
    return cut(dealt.groupBy("group").applyInPandas(build, "tree string, chunk long, digest binary, log binary"))


def _ways(children: DataFrame, builders: DataFrame, n: int, schema: str, finish) -> DataFrame:
    """`finish(child rows, paths, builder row)` for the children (tree, pos, ...) of each builder (tree, chunk, log, way): each path leads to the root."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def extract(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        above = {(t, c): i for i, (t, c) in enumerate(zip(theirs["tree"], theirs["chunk"]))}
        out = []
        for (tree, chunk), part in mine.groupby(["tree", "chunk"], sort=False):
            builder = theirs.iloc[above[tree, chunk]]
            packed = bytes(builder["log"])
            log = [packed[i : i + WIDE] for i in range(0, len(packed), WIDE)]
            m = len(part)
            ways = [path(log, i, m, _levels(chunk, m)) + bytes(builder["way"]) for i in (part["pos"] - chunk * ALIGNED).tolist()]
            out.append(finish(part, ways, builder))
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    chunk = F.floor(F.col("pos") / ALIGNED)
    left = children.withColumn("chunk", chunk).withColumn("group", _group(chunk, n)).groupBy("group")
    right = builders.withColumn("group", _group(F.col("chunk"), n)).groupBy("group")
    return left.cogroup(right).applyInPandas(extract, schema)


def _tiers(nodes: DataFrame, n: int) -> list[tuple[DataFrame, DataFrame, int]]:
    """(nodes, their builders, number of nodes), tier by tier, until each tree has one builder."""
    tiers = []
    while True:
        built = _built(nodes, n)
        tiers.append((nodes, built, n))
        if built.where("chunk > 0").isEmpty():
            return tiers
        nodes, n = built.select("tree", F.col("chunk").alias("pos"), "digest"), built.count()


def _down(tiers: list[tuple[DataFrame, DataFrame, int]], top: DataFrame) -> DataFrame:
    """The builders of the lowest tier with `way` and `subroot`, given those (tree, way, subroot) of the trees' roots."""
    builders = tiers[-1][1].join(top, "tree")
    schema = "tree string, chunk long, way binary, subroot binary"

    def finish(part: pd.DataFrame, ways: list[bytes], builder: pd.Series) -> pd.DataFrame:
        return part[["tree"]].assign(chunk=part["pos"], way=ways, subroot=[builder["subroot"]] * len(part))

    for (_, below, _), (nodes, _, n) in zip(tiers[-2::-1], tiers[:0:-1]):
        builders = below.join(_ways(nodes, builders, n, schema, finish), ["tree", "chunk"])
    return builders


class Manifest:
    """The trees of a table's sources, and the tree of their roots, built and written to the shared folder.

    A row of documents (doc_id, source, lang, n_chars, text) is a leaf; a
    source's leaves ascend by doc_id, null ids first and rows of one id by
    their digests; repeated rows are leaves of their own. Sources ascend
    bytewise, the null source first and apart from the empty one. An empty
    table has no root. Other columns are ignored.
    """

    def __init__(self, docs: DataFrame, altered: Column | None = None):
        self.spark = docs.sparkSession
        source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree")
        changed = (F.lit(None) if altered is None else F.nullif(leaf_of(altered), leaf_of(F.col("text")))).cast("binary").alias("altered")
        leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source, leaf_of(F.col("text")).alias("digest"), changed)
        self.leaves = _placed(leaves, "doc_id", "digest")
        self.n = self.leaves.count()
        self.tiers = _tiers(self.leaves, self.n) if self.n else []
        if self.n:
            roots = self.tiers[-1][1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
            self.sources = _placed(roots, "source")
            self.top = _tiers(self.sources, self.sources.count())
            self.root = bytes(self.top[-1][1].first()["digest"])

    def log(self) -> DataFrame:
        """(tree, position, digest) of every node of the sources' trees, gapless in each; a tree is `=` and its source, or empty for null.

        A builder's nodes stand where the closed form says; it needs the
        node's level and index and the number of leaves of its tree.
        """
        sizes = self.leaves.groupBy("tree").agg(F.count("*").alias("leaves"))
        out = None
        for tier, (nodes, built, _) in enumerate(self.tiers):

            def rows(batches: Iterator[pd.DataFrame], tier: int = tier) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    for r in pdf.itertuples():
                        mine = -(-r.leaves // ALIGNED**tier)
                        m = min(ALIGNED, mine - r.chunk * ALIGNED)
                        if tier and mine == 1:
                            continue  # the tree ended in a lower tier
                        digests = [r.log[i : i + WIDE] for i in range(0, len(r.log), WIDE)]
                        at, n = [], m
                        for level in range(_levels(r.chunk, m) + 1):
                            first = r.chunk * ALIGNED // ARITY**level
                            at += [(position(level, i, m), position(tier * LEVELS + level, first + i, r.leaves)) for i in range(n) if level or not tier]
                            n = -(-n // ARITY)
                        yield pd.DataFrame({"tree": r.tree, "position": [p for _, p in at], "digest": [digests[i] for i, _ in at]})

            part = built.join(sizes, "tree").mapInPandas(rows, "tree string, position long, digest binary")
            out = part if out is None else out.unionByName(part)
        return out

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf: its path is taken from the log and folded."""
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        if not self.n:
            return self.spark.createDataFrame([], schema)
        root = self.root
        start = self.top[-1][1].select("tree", F.lit(b"").alias("way"), F.lit(root).alias("subroot"))

        def named(part: pd.DataFrame, ways: list[bytes], builder: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({"tree": part["source"], "way": ways, "subroot": part["digest"]})

        nodes, _, n = self.top[0]
        subroots = cut(_ways(nodes, _down(self.top, start), n, "tree string, way binary, subroot binary", named))

        def finish(part: pd.DataFrame, ways: list[bytes], builder: pd.Series) -> pd.DataFrame:
            made = [fold(leaf if other is None else other, way) for leaf, other, way in zip(part["digest"], part["altered"], ways)]
            return pd.DataFrame({
                "doc_id": part["doc_id"].astype("Int64"), "leaf": [d.hex() for d in part["digest"]], "subroot": bytes(builder["subroot"]).hex(), "root": root.hex(),
                "proof_sha256": [proof_digest(w) for w in ways], "folded_root": [d.hex() for d in made], "verified": [d == root for d in made],
            })

        return _ways(self.leaves, _down(self.tiers, subroots), self.n, schema, finish)


def verified(docs: DataFrame) -> DataFrame:
    """Every row's leaf, its source's root and the root of all, and whether its proof holds after some rows were tampered with.

    Where crc32 of the id is even (a null id counts as empty text, which is),
    line feeds are taken from the text; rows whose text has none keep their
    leaf and so their proof. Nulls, empty and very long texts are leaves like
    others. An empty table gives no rows.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    altered = F.when(crc_mod("doc_id", 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return Manifest(docs, altered).proofs()


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(read(spark, sf_dir, "documents"))


#: crc32 of a doc_id's digits, bit by bit; a source's levels as lists of digests.
ORACLE = r"""
WITH RECURSIVE field AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
      lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295::BIGINT) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
      ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS tampered
  FROM field),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
level AS (
  SELECT source, 0 AS depth, list(leaf ORDER BY pos) AS l FROM placed GROUP BY source
  UNION ALL
  SELECT source, depth + 1, list_transform(range(0, len(l), 3), lambda i: sha256(array_to_string(l[i + 1:i + 3], ''))) FROM level WHERE len(l) > 1),
subroots AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM level WHERE len(l) = 1),
upper AS (
  SELECT 0 AS depth, list(subroot ORDER BY pos) AS l FROM subroots
  UNION ALL
  SELECT depth + 1, list_transform(range(0, len(l), 3), lambda i: sha256(array_to_string(l[i + 1:i + 3], ''))) FROM upper WHERE len(l) > 1),
chain AS (
  SELECT source, depth, l FROM level WHERE len(l) > 1
  UNION ALL
  SELECT s.source, h.top + u.depth, u.l FROM upper u, subroots s, (SELECT source AS src, max(depth) AS top FROM level GROUP BY source) h
  WHERE len(u.l) > 1 AND s.source IS NOT DISTINCT FROM h.src),
walk AS (
  SELECT p.doc_id, p.source, p.leaf, p.pos AS own, 0 AS depth, p.pos AS at, p.tampered AS node, '' AS proof FROM placed p
  UNION ALL
  SELECT w.doc_id, w.source, w.leaf, w.own, w.depth + 1, CASE WHEN h.top = w.depth + 1 THEN s.pos ELSE w.at // 3 END,
    sha256(array_to_string(c.l[w.at - w.at % 3 + 1:w.at] || [w.node] || c.l[w.at + 2:w.at - w.at % 3 + 3], '')),
    w.proof || array_to_string(c.l[w.at - w.at % 3 + 1:w.at] || c.l[w.at + 2:w.at - w.at % 3 + 3], '')
  FROM walk w JOIN chain c ON c.source IS NOT DISTINCT FROM w.source AND c.depth = w.depth
  JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source
  JOIN (SELECT source, max(depth) AS top FROM level GROUP BY source) h ON h.source IS NOT DISTINCT FROM w.source),
ends AS (SELECT *, row_number() OVER (PARTITION BY source, own ORDER BY depth DESC) AS back FROM walk)
SELECT e.doc_id, e.leaf, s.subroot, u.l[1] AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = u.l[1] AS verified
FROM ends e JOIN subroots s ON s.source IS NOT DISTINCT FROM e.source, upper u WHERE len(u.l) = 1 AND e.back = 1
"""
