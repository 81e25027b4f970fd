"""Links between sets of one bucket that are alike, without comparing all pairs of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decoyscope.llm.common import TEXTS, among, begins, cut, driver_gives_back, give_back, join_groups
from decoyscope.llm.components import components

#: MinHash samples of a set, bits of its odd sketch, and shingle hashes worked on together.
SAMPLES, BITS, BLOCK = 256, 1024, 65_536
#: Samples in a band: two sets of similarity 0.8 share none of the 42 bands in three of a million cases; hashes of texts that are sketched together, about.
ROWS, TOGETHER = 6, 250_000
#: Rounds of comparisons with one member of a bucket's largest group.
ROUNDS = 3
#: Rows that meet one copy of a set, and narrow rows of a written part, about.
SALTED, PART = 256, 20_000


def _odd(rng: np.random.Generator, n: int) -> np.ndarray:
    return rng.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


#: Multipliers of the samples, and of what places them in the sketch.
_RNG = np.random.default_rng(13)
MULTIPLIERS, PLACES, MIX = _odd(_RNG, SAMPLES), _odd(_RNG, SAMPLES), _odd(_RNG, 8)


def shingle_hashes(text: str | None, words: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, A-Z in lower case; of all its words if they are fewer; none without words."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws], dtype=np.int64) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[min(words, max(1, len(ws))) - 1 :].tolist())], dtype="<u8")
    return np.unique(hashes) if distinct else hashes


def samples(sets: list[np.ndarray], k: int = SAMPLES) -> np.ndarray:
    """The k MinHash samples of each of some nonempty sets of 64-bit hashes."""
    out = np.full((len(sets), k), np.uint64(2**64 - 1))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for at in range(0, len(flat), BLOCK):
        some, of = flat[at : at + BLOCK], owner[at : at + BLOCK]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        rows = of[starts]
        for j in range(k):
            out[rows, j] = np.minimum(out[rows, j], np.minimum.reduceat(some * MULTIPLIERS[j], starts))
    return out


def odd_sketches(drawn: np.ndarray) -> np.ndarray:
    """Each row's samples folded into parities: a sample flips one bit, told by its value and number."""
    n, k = drawn.shape
    out = np.zeros((n, BITS // 64), dtype=np.int64)
    for at in range(0, n, 256):
        some = drawn[at : at + 256]
        bit = ((some ^ some >> np.uint64(29)) * PLACES[:k] >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
        flips = np.bincount((bit + BITS * np.arange(len(some))[:, None]).ravel(), minlength=len(some) * BITS).reshape(-1, BITS)
        out[at : at + 256] = np.packbits((flips & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
    return out


def bands(drawn: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash for each run of `rows` samples."""
    n = drawn.shape[1] // rows
    out = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64) * MIX[0], (len(drawn), n)).copy()
    for j in range(rows):
        out = (out ^ out >> np.uint64(31)) * MIX[1] + (drawn[:, j : n * rows : rows] ^ out >> np.uint64(17)) * MIX[2]
    return out.view(np.int64)


def allowed(least: float, k: int = SAMPLES) -> int:
    """Differing bits that two sketches of similarity `least` exceed about once in ten million pairs.

    Their samples differ in a binomial number d; 2 d flips fall on the bits,
    and two on one bit cancel. Mean and variance are those of both steps; the
    bound lies five and a half deviations above.
    """
    d, spread = k * (1 - least), k * least * (1 - least)
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * d))
    slope, lost = 2 * (1 - 2 / BITS) ** (2 * d), (2 * d) ** 2 / 2 / BITS
    return int(mean + 5.5 * (slope**2 * spread + 4 * lost) ** 0.5)


def similarity(differing: np.ndarray | int, k: int = SAMPLES) -> np.ndarray:
    """The similarity that so many differing bits of two sketches speak for."""
    share = np.minimum(np.asarray(differing) / BITS, 0.4999)
    return 1 + BITS / (4 * k) * np.log(1 - 2 * share)


def sketched(text: Column, words: int) -> Column:
    """(size, whole, check, bands, odd) of a text's set of shingles: its size, two hashes of it, and its sketch; no bands if it is empty."""

    @F.pandas_udf("size long, whole long, check long, bands array<long>, odd array<long>")
    def work(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        begins("near_sets")
        size, whole, check = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
        banded, odd = [None] * len(texts), [None] * len(texts)

        def finish(block: list[tuple[int, np.ndarray]]) -> None:
            if block:
                drawn = samples([s for _, s in block])
                for (i, _), b, o in zip(block, bands(drawn, ROWS), odd_sketches(drawn)):
                    banded[i], odd[i] = b, o

        block, held = [], 0
        for i, t in enumerate(texts):
            hs = shingle_hashes(t, words, True)
            raw = hs.tobytes()
            size[i] = len(hs)
            whole[i], check[i] = np.array([xxhash.xxh64_intdigest(raw, 7), xxhash.xxh3_64_intdigest(raw)], dtype=np.uint64).view(np.int64)
            if len(hs):
                block.append((i, hs))
                held += len(hs)
            if held > TOGETHER:
                finish(block)
                block, held = [], 0
        finish(block)
        give_back()
        return pd.DataFrame({"size": size, "whole": whole, "check": check, "bands": banded, "odd": odd})

    return work(text)


def _apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _written(df: DataFrame, n: int) -> DataFrame:
    """Written in as many parts as n rows need, however many partitions made them."""
    return cut(df.coalesce(max(12, n // PART)))


def _confirmed(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sketches and then whose full sets (key, set) are alike to `least`; a set that many pairs share comes once for SALTED of them."""
    n = pairs.count()
    sizes = _written(pairs.groupBy("v").agg(F.count("*").alias("n")), n)
    salts = F.ceil(F.col("n") / SALTED).cast("int")
    dealt = join_groups(pairs, sizes, ["v"], "n", n).select("u", "v", F.pmod(F.xxhash64("u"), salts).cast("int").alias("salt"))
    copies = lambda of, name: sizes.join(of, F.col("v") == F.col("key")).select("v", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col(name).alias("b"))
    seen = dealt.join(sketches.select(F.col("key").alias("u"), F.col("odd").alias("a")), "u").join(copies(sketches, "odd"), ["v", "salt"])
    dealt = _written(seen.where(_apart("a", "b") <= allowed(least)).select("u", "v", "salt"), n)
    both = dealt.join(sets.select(F.col("key").alias("u"), F.col("set").alias("a")), "u").join(copies(sets, "set"), ["v", "salt"])
    shared = F.size(F.array_intersect("a", "b"))
    return _written(both.where(F.round(100 * shared - 100 * least * (F.size("a") + F.size("b") - shared), 6) >= 0).select("u", "v"), n)


def _unsettled(members: DataFrame, n: int, roots: DataFrame | None, found: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """(members with their root, buckets) of the buckets (h, key) that hold more than one root: n rows, the largest root, and the one of its members that has most links, or by turns another."""
    rows = members.withColumn("root", F.col("key")) if roots is None else members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = rows.withColumn("linked", F.lit(0).cast("long"))
    if found is not None and turn % 2:
        links = found.groupBy(F.col("v").alias("key")).agg(F.count("*").alias("linked"))
        rows = rows.drop("linked").join(links, "key", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    rows = _written(rows, n)
    one = F.min(F.struct(-F.col("linked"), F.xxhash64(F.lit(turn), "key"), "key"))["key"].alias("pivot")
    parts = rows.groupBy("h", "root").agg(F.count("*").alias("n"), one)
    buckets = parts.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max(F.struct("n", "root", "pivot")).alias("most"))
    return rows.drop("linked"), _written(buckets.where("roots > 1").select("h", "n", F.col("most.root").alias("main"), F.col("most.pivot").alias("pivot"), F.col("most.n").alias("its")), n)


def _rest(members: DataFrame, total: int, sets: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of different roots that may be alike, at least one of them outside the largest root of a bucket that they may share.

    Two sets of similarity `least` or more share `least` / (1 + `least`) of
    their sizes' sum. In any common order they share one of the first hashes
    of either, with so many left from there on in both. Here the rarest come
    first. What sets of one bucket have in common comes last, so sets that
    differ in more than they may are not compared, however many share a bucket.
    """
    rows, buckets = _unsettled(members, total, roots, None, ROUNDS)
    rows = join_groups(rows, buckets, ["h"], "n", total)
    apart = _written(rows.groupBy("key").agg(F.max("root").alias("root"), F.max((F.col("root") != F.col("main")).cast("int")).alias("outside")), total)
    each = cut(sets.join(apart, "key").select("key", "root", "outside", F.size("set").alias("size"), F.explode("set").alias("x")))
    held = cut(each.groupBy("x").agg(F.count("*").alias("held")).where("held > 1"))
    each = join_groups(each, held, ["x"], "held", each.count())
    mine = Window.partitionBy("key")
    # hashes that no other set has come first of all
    place = F.col("size") - F.col("common") + F.row_number().over(mine.orderBy("held", "x"))
    each = each.withColumn("common", F.count("*").over(mine)).withColumn("at", place).where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)
    each = cut(each.select("key", "root", "outside", "size", "common", "x", "at"))
    needed = least / (1 + least) * (F.col("size") + F.col("its")) - 1e-9
    left = F.least(1 + F.least(F.col("size") - F.col("at"), F.col("its") - F.col("there")), "common", "known")
    fits = (F.col("root") != F.col("other")) & (F.least("size", "its") >= least * F.greatest("size", "its") - 1e-9) & (left >= needed)
    there = each.select("x", F.col("key").alias("v"), F.col("root").alias("other"), F.col("size").alias("its"), F.col("common").alias("known"), F.col("at").alias("there"))
    met = each.where("outside = 1").join(there, "x").where(fits)
    return met.select(F.greatest("key", "v").alias("u"), F.least("key", "v").alias("v")).distinct()


def links(members: DataFrame, sketches: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (u, v) that connect what all pairs of members (h, key) of a bucket with a Jaccard similarity of `least` or more connect.

    `sketches` has (key, size, odd) and `sets` (key, set), the distinct
    hashes, of every member. In each of ROUNDS rounds a bucket's members
    outside its largest group are compared with one member of that group; in
    the end those that are still apart meet all others with which they share
    a rare hash. Every link is confirmed on the full sets.
    """
    found, roots, n = None, None, members.count()
    for turn in range(ROUNDS):
        rows, buckets = _unsettled(members, n, roots, found, turn)
        pairs = join_groups(rows, buckets, ["h"], "n", n).where("root <> main")
        pairs = _written(pairs.groupBy(F.col("key").alias("u"), F.col("pivot").alias("v")).agg(F.max("main").alias("main")), n)
        new = _confirmed(pairs.select("u", "v"), sets, sketches, least)
        found = new if found is None else found.unionByName(new)
        # enough for the next round: who was linked is counted to the root it met
        moved = new.join(pairs, ["u", "v"]).groupBy(F.col("u").alias("key")).agg(F.max("main").alias("root"))
        roots = _written(moved if roots is None else moved.unionByName(roots.join(moved, "key", "left_anti")), n)
        driver_gives_back(members.sparkSession)  # a round has many plans
    found = _written(found, n)
    roots = components(found).withColumnRenamed("node", "key")
    return found.unionByName(_confirmed(cut(_rest(members, n, sets, roots, least)), sets, sketches, least))


def shared_buckets(each: DataFrame) -> DataFrame:
    """The rows (h, key) whose bucket holds more than one key."""
    each = cut(each)
    several = cut(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    return cut(join_groups(each, several, ["h"], "n", each.count()).select("h", "key"))


def sets_of(docs: DataFrame, bodies: DataFrame, hashes) -> DataFrame:
    """(key, set) of the texts named by bodies (body, key), body being `identity` of the text; copies of a text are read once, and other texts stay where they are."""
    make = F.pandas_udf(lambda texts: pd.Series([hashes(t).view(np.int64) for t in texts]), "array<long>")
    bodies = cut(bodies)
    texts = docs.select(identity(F.col("text")).alias("body"), "text")
    named = among(bodies.select(F.xxhash64("body")))
    if named:
        texts = texts.withColumn("h", F.xxhash64("body")).where(named("h"))
    texts = texts.groupBy("body").agg(F.first("text").alias("text")).join(bodies, "body")
    return cut(texts.select("key", make("text").alias("set")), TEXTS)


def identity(text: Column) -> Column:
    """What makes texts the same: those of one digest are read once."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))
