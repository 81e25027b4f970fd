"""SimHash fingerprints linked by a binary trie self-join."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.llm import near_sets
from decoyscope.llm.common import TEXTS, cut, driver_gives_back, join_groups, read
from decoyscope.llm.components import components, forest
from decoyscope.llm.near_sets import shingle_hashes

BITS = 64
#: Fingerprints in one bucket of the trie, about, and node pairs walked at a time.
BUCKET, WALKED = 100_000, 200_000
#: Near copies: words of a shingle, least similarity, fingerprints of a text's words, and bits in which one of them may differ.
WORDS, SIMILAR, FAMILIES, WIDE = 5, 0.8, 2, 6


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half the hashes."""
    set_bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int((2 * set_bits > len(hashes)).astype(np.uint64) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of one text over its word shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprint_of(text: Column) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def work(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return work(text)


def trie_links(keys: np.ndarray, lead: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct 64-bit keys that share `lead` leading bits and differ in at most `budget` others.

    A trie node is a range of the sorted keys. The walk begins with each node
    at depth `lead` paired with itself, splits both sides of a pair by their
    next bit, adds one to the pair's differing bits where the sides part, and
    drops pairs that exceed the budget or hold no two keys. It goes depth
    first over blocks of pairs, so memory stays bounded.
    """
    n = len(keys)
    if n < 2:
        return
    top = keys >> np.uint64(BITS - lead) if lead else np.zeros(n, dtype=np.uint64)
    edges = np.flatnonzero(np.r_[True, top[1:] != top[:-1], True])
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(lead, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8))]
    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        if len(al) > WALKED:
            half = len(al) // 2
            stack += [(depth, *(x[half:] for x in (al, ah, bl, bh, diff))), (depth, *(x[:half] for x in (al, ah, bl, bh, diff)))]
            continue
        if not len(al):
            continue
        if depth == BITS:
            yield al, bl
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        ones = np.r_[0, np.cumsum((keys & bit) != 0)]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = al == bl
        parts = []
        for left, right, cost, keep in (
            ((al, am), (bl, bm), 0, None),
            ((am, ah), (bm, bh), 0, None),
            ((al, am), (bm, bh), 1, None),
            ((am, ah), (bl, bm), 1, ~same),
        ):
            d = diff + np.int8(cost)
            na, nb = left[1] - left[0], right[1] - right[0]
            ok = (d <= budget) & (na > 0) & (nb > 0)
            if cost == 0:
                ok &= ~same | (na > 1)
            if keep is not None:
                ok &= keep
            parts.append(tuple(x[ok] for x in (*left, *right, d)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))


def _turned(keys: np.ndarray, sizes: list[int], order: list[int]) -> np.ndarray:
    """The keys with their blocks of bits, `sizes` from the top, put in another order."""
    down = BITS - np.cumsum(sizes)
    out = np.zeros(len(keys), dtype=np.uint64)
    for i in order:
        out = (out << np.uint64(sizes[i] % BITS)) | (keys >> np.uint64(down[i])) & np.uint64(2 ** sizes[i] - 1)
    return out


def link(distinct: DataFrame, budget: int = 2, exact: int = 1) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints (fp) within `budget` bits of each other.

    The bits are cut into budget + exact blocks; two fingerprints within the
    budget agree on `exact` of them at least. So the trie is dealt out once
    for each choice of `exact` blocks, turned so that these lead: keys with
    equal leading blocks meet in one bucket, where the walk has no error to
    spend in them and the whole budget behind. More exact blocks make more
    tries with smaller buckets, and the same links. A bucket returns a
    spanning forest of its links rather than the links.
    """
    blocks = budget + exact
    sizes = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    tries = [(*c, *(i for i in range(blocks) if i not in c)) for c in itertools.combinations(range(blocks), exact)]
    leads = [sum(sizes[i] for i in order[:exact]) for order in tries]
    n = distinct.count()
    buckets = max(12, -(-n * len(tries) // BUCKET))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for k, order in enumerate(tries):
                key = _turned(fp, sizes, order)
                lead = (key >> np.uint64(BITS - leads[k])) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xD1342543DE82EF95 % 2**64)
                yield pd.DataFrame({"k": np.int32(k), "key": key.view(np.int64), "bucket": ((lead >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        made = [np.zeros((0, 2), dtype=np.int64)]
        for k, part in pdf.groupby("k"):
            keys = np.sort(part["key"].to_numpy(np.int64).view(np.uint64))
            root = forest(len(keys), trie_links(keys, leads[k], budget))
            far = np.flatnonzero(root != np.arange(len(keys)))
            order = tries[k]
            fp = _turned(keys, [sizes[i] for i in order], [order.index(i) for i in range(blocks)])
            made.append(np.stack([fp[far].view(np.int64), fp[root[far]].view(np.int64)], axis=1))
        return pd.DataFrame(np.concatenate(made), columns=["u", "v"])

    return distinct.select("fp").mapInPandas(deal, "k int, key long, bucket int").groupBy("bucket").applyInPandas(walk, "u long, v long")


def groups(docs: DataFrame, key: str, budget: int = 2) -> DataFrame:
    """(key, doc_id, fp, root, component_id) for every row; rows with the same root form a group."""
    rows = cut(docs.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of(F.col("text")).alias("fp")))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(link(distinct, budget))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(placed.join(ids, "root").select("fp", "n", "root", "component_id"))
    return join_groups(rows, named, ["fp"], "n", rows.count()).drop("n")


def _word_fingerprints(text: Column) -> Column:
    """FAMILIES fingerprints of the set of a text's words."""

    @F.pandas_udf("array<long>")
    def work(texts: pd.Series) -> pd.Series:
        import xxhash

        out = np.zeros((len(texts), FAMILIES), dtype=np.uint64)
        for i, t in enumerate(texts):
            ws = set((t or "").encode("utf-8", "surrogatepass").lower().split())
            for f in range(FAMILIES):
                out[i, f] = majority(np.array([xxhash.xxh64_intdigest(w, 42 + f) for w in ws], dtype="<u8"))
        return pd.Series(list(out.view(np.int64)))

    return work(text)


def similar_groups(docs: DataFrame, words: int = WORDS, least: float = SIMILAR, budget: int = WIDE) -> DataFrame:
    """(doc_id, body, root) for every row, body being a digest of its text; rows with the same root form a group of near copies.

    Candidates come from the trie: FAMILIES fingerprints of the texts' sets of
    words, linked at `budget` bits or fewer in one of them, make parts of
    texts that may be alike. In a part, texts that share a MinHash band are
    compared as `near_sets.links` does: by odd sketches, then by the exact
    Jaccard similarity of their sets of `words`-word shingles. Links have a
    similarity of `least` or more, and groups are what they connect; a part of any size loses no link to
    its size. Texts with the same set of shingles are one; those without
    words are one group. Ids may be null or repeat.
    """
    driver_gives_back(docs.sparkSession)  # it may have fitted a model before
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), near_sets.identity(F.col("text")).alias("body"), near_sets.sketched(F.col("text"), words).alias("x"), _word_fingerprints(F.col("text")).alias("fps"))
    rows = cut(rows.select("doc_id", "body", "x.*", "fps"), TEXTS)
    one = ["whole", "check", "size"]
    classes = rows.groupBy(*one).agg(F.min("body").alias("body"), F.first("bands").alias("bands"), F.first("odd").alias("odd"), F.first("fps").alias("fps"), F.count("*").alias("n"))
    classes = cut(cut(classes).withColumn("key", F.monotonically_increasing_id()))
    near = None
    for f in range(FAMILIES):
        named = classes.where("size > 0").select(F.col("fps")[f].alias("fp"), "key")
        firsts = cut(named.groupBy("fp").agg(F.min("key").alias("v"), F.count("*").alias("n")))
        same = join_groups(named, firsts.where("n > 1"), ["fp"], "n", named.count()).select(F.col("key").alias("u"), "v")
        u, v = (firsts.select(F.col("fp").alias(k), F.col("v").alias(to)) for k, to in (("u", "a"), ("v", "b")))
        others = link(firsts, budget, 2).join(u, "u").join(v, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = cut(same.unionByName(others))
        near = both if near is None else near.unionByName(both)
        driver_gives_back(docs.sparkSession)
    parts = components(near).select(F.col("node").alias("key"), F.col("root").alias("part"))
    placed = cut(classes.join(parts, "key").select("key", "part", "size", "bands", "odd", "body"))
    members = near_sets.shared_buckets(placed.select("key", "part", F.explode("bands").alias("band")).select(F.xxhash64("part", "band").alias("h"), "key"))
    sets = near_sets.sets_of(docs, placed.join(members.select("key").distinct(), "key").select("body", "key"), lambda t: near_sets.shingle_hashes(t, words, True))
    roots = components(near_sets.links(members, placed.select("key", "size", "odd"), sets, least)).withColumnRenamed("node", "key")
    named = cut(classes.select(*one, "n", "key").join(roots, "key", "left").select(*one, "n", F.coalesce("root", "key").alias("root")))
    return join_groups(rows.select("doc_id", "body", *one), named, one, "n", rows.count()).select("doc_id", "body", "root")


def near_duplicates(docs: DataFrame, budget: int = 2) -> DataFrame:
    """Fingerprint and component of every row.

    Rows with equal fingerprints meet once; texts without words have
    fingerprint zero and are linked like any other; null counts as empty. A
    component's id is its smallest doc_id (null only if all its ids are).
    Repeated rows are kept. Other columns are ignored.

    Returns doc_id, fingerprint, component_id.
    """
    return groups(docs, "doc_id", budget).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
