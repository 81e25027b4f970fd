"""Benchmark items held by documents: size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decoyscope.llm.common import cut, free_name, read, small

WORDS = 5


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: str, k: int) -> Column:
    """Distinct 64-bit hashes of the k-word shingles of an array column; none if it has fewer words."""
    ws = F.col(words)
    whole = F.transform(ws, lambda w, i: F.xxhash64(F.lit(k), w, *[F.get(ws, i + j) for j in range(1, k)]))
    return F.array_distinct(F.slice(whole, F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(0))))


def _once(x: Column) -> Column:
    """Works `x` out once a row: later expressions can't be merged with it across a generator."""
    return F.explode(F.array(x))


def identity(text: Column) -> Column:
    """What makes texts the same for the search: rows of one text are searched once."""
    return F.md5(F.coalesce(text, F.lit("")))


def signatures(items: DataFrame, threshold: float) -> DataFrame:
    """(item, size, h, signature, need): every shingle of every item (item, words), with its MinHash signature marked.

    Items are partitioned by their number n of shingles (`part`, the power of
    two below it). An item contained to `threshold` misses at most
    m = n - ceil(threshold * n) shingles. Its signature are its m + 1 + e
    least hashes, e being as large as m or as n allows: a document that holds
    the item has `need` = e + 1 of them at least, so the search misses none,
    and one that shares a phrase or two mostly has fewer. Hashes that many
    items hold (by powers of two) come after the others, as they tell little.
    """
    parts = [items.where(F.size("words") >= WORDS).select("item", F.explode(shingles("words", WORDS)).alias("h"))]
    for k in range(1, WORDS):  # shorter items are one shingle of all their words
        parts.append(items.where(F.size("words") == k).select("item", F.explode(shingles("words", k)).alias("h")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.join(rows.groupBy("h").agg(F.floor(F.log2(F.count("*"))).alias("held")), "h")
    item = Window.partitionBy("item")
    rows = rows.withColumn("size", F.count("*").over(item)).withColumn("at", F.row_number().over(item.orderBy("held", "h")))
    missed = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9)
    more = F.least(missed, F.col("size") - missed - 1)
    return rows.select("item", "size", F.floor(F.log2("size")).cast("int").alias("part"), "h", (F.col("at") <= missed + 1 + more).alias("signature"), (more + 1).alias("need"))


def held_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(body, item, size, held) for each distinct text (by `identity`) and item (item, words) that it holds to `threshold` or more.

    A document is probed by its own minima: of its shingles only those go on
    whose hash is at most the ceiling of some partition of items that are
    small enough to be held by it; a ceiling is the greatest hash in the
    partition's signatures. Documents with `need` of an item's signature are
    candidates, and of these alone all shingles are compared.
    """
    rows = cut(signatures(items, threshold))
    # one row for each power of two
    tops = {r["part"]: r["top"] for r in rows.where("signature").groupBy("part").agg(F.max("h").alias("top")).collect()}
    short = sorted(r[0] for r in items.select(F.size("words").alias("k")).where(F.col("k").between(1, WORDS - 1)).distinct().collect())
    words = docs.select(identity(F.col("text")).alias("body"), "text").select("body", _once(word_list(F.col("text"))).alias("words"))
    every = F.concat(*[shingles("words", k) for k in (WORDS, *short)])
    hashed = words.select("body", _once(every).alias("hs"))
    ceiling = F.lit(None).cast("long")
    for part in sorted(tops):
        top = max(t for p, t in tops.items() if p <= part)
        ceiling = F.when(F.size("hs") >= threshold * 2**part - 1e-9, F.lit(top).cast("long")).otherwise(ceiling)
    minima = hashed.select("body", F.size("hs").alias("n"), "hs", _once(ceiling).alias("ceiling"))
    probes = minima.select("body", "n", F.explode(F.filter("hs", lambda h: h <= F.col("ceiling"))).alias("h"))
    signed = cut(rows.where("signature").select("item", "size", "h", "need"))
    met = probes.join(small(signed), "h").where(F.col("n") >= threshold * F.col("size") - 1e-9)
    # copies of a text are counted together: their hits are too many rather than too few
    candidates = cut(met.groupBy("body", "item", "need").agg(F.count("*").alias("hits")).where("hits >= need").select("body", "item"))
    some = small(cut(candidates.select("body").distinct()))
    have = words.join(some, "body", "left_semi").dropDuplicates(["body"]).select("body", F.explode(every).alias("h"))
    both = have.join(candidates.join(rows.select("item", "size", "h"), "item"), ["body", "h"])
    counted = both.groupBy("body", "item", "size").agg(F.count("*").alias("held"))
    return cut(counted.where(F.col("held") >= threshold * F.col("size") - 1e-9))


def _named(items: DataFrame) -> DataFrame:
    """`items` with their words, and an `item` that stands for these; those without words go."""
    split = items.select("*", _once(word_list(F.col("text"))).alias("words")).drop("text")
    return split.where(F.size("words") > 0).withColumn("item", F.md5(F.concat_ws(" ", "words")))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Documents and the benchmark items they hold to `threshold` or more.

    Containment is the share of an item's distinct five-word shingles that a
    document also has; words are lower-cased runs of letters and digits, over
    whole texts of any length. An item with fewer words is one shingle of all
    its words; items and documents without words, nulls among them, never
    match. Every row is searched by itself; of rows that share a document's id
    and of items that share an item's id, the one that holds most is returned.
    Null ids of either kind are kept as one id. An empty benchmark or table
    gives no rows. Other columns are ignored.

    Returns doc_id, item_id, item_shingles, held_shingles, containment.
    """
    named = cut(_named(benchmark.select("item_id", "text")))
    found = held_items(docs, named.select("item", "words").dropDuplicates(["item"]), threshold)
    ids = cut(found.join(named.select("item", "item_id"), "item").select("body", "item_id", "size", "held"))
    rows = docs.select("doc_id", identity(F.col("text")).alias("body")).join(small(ids), "body")
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("held") / F.col("size")).alias("share"), "size", "held")).alias("x"))
    return best.select(
        "doc_id", "item_id", F.col("x.size").alias("item_shingles"), F.col("x.held").alias("held_shingles"), F.round("x.share", 6).alias("containment")
    )


def without_held(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs` whose text holds no benchmark item to `threshold`, each with all its columns, whatever its id."""
    items = cut(_named(benchmark.select("text")).select("item", "words").dropDuplicates(["item"]))
    body = free_name(docs, "body")
    gone = cut(held_items(docs, items, threshold).select(F.col("body").alias(body)).distinct())
    return docs.withColumn(body, identity(F.col("text"))).join(small(gone), body, "left_anti").select(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
sizes AS (SELECT DISTINCT least(len(ws), 5) AS k FROM w WHERE kind = 'b' AND len(ws) > 0),
b AS (
  SELECT DISTINCT id AS item_id, least(len(ws), 5) AS k, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS s
  FROM w, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) t(i) WHERE kind = 'b' AND len(ws) > 0),
d AS (
  SELECT DISTINCT id AS doc_id, k, array_to_string(ws[i:i + k - 1], ' ') AS s
  FROM w, sizes, unnest(range(1, len(ws) - k + 2)) t(i) WHERE kind = 'd'),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, any_value(n.item_shingles) AS item_shingles, count(*) AS held_shingles,
       round(count(*) / any_value(n.item_shingles), 6) AS containment
FROM d JOIN b USING (k, s) JOIN n USING (item_id)
GROUP BY d.doc_id, b.item_id HAVING count(*) / any_value(n.item_shingles) >= 0.8 - 1e-9
"""
