"""Cross-site boilerplate lines by HyperLogLog spread."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.llm.common import cut, free_name, read

#: log2 of a sketch's registers; its relative standard error is 1.04 / sqrt(2**LG_K).
LG_K = 10
#: Lines whose estimate lies within this share of the threshold get an exact count (three standard errors).
NEAR = 3 * 1.04 / (2**LG_K) ** 0.5
#: Sites from which a line counts as boilerplate.
SITES = 10
#: Boilerplate lines up to which their hashes travel as one literal (some 20 bytes each); more of them meet the lines by a join.
LITERAL_LINES = 20_000
#: Lines, near the threshold or far-spread, up to which their hashes (8 bytes each) are broadcast.
BROADCAST_ROWS = 100_000


def _line(x: Column) -> Column:
    return F.trim(x)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(site, ls) of each distinct text: a hash of its least source, and (h, size) of each of its distinct lines.

    However often a text is copied, and on however many sites, it is one text
    on one site. Copies are combined in each task before they meet. h is a
    hash of the trimmed line; blank lines have none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ls = F.filter(F.array_distinct(F.transform(F.split(text, "\n"), _line)), lambda x: x != "")
    hashed = F.transform(ls, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("size")))
    rows = docs.select(F.xxhash64(text).alias("body"), F.octet_length(text).alias("n"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), hashed.alias("ls"))
    return rows.groupBy("body", "n").agg(F.min("source").alias("source"), F.first("ls").alias("ls")).select(F.xxhash64("source").alias("site"), "ls")


def _far(each: DataFrame, sites: int) -> DataFrame:
    """(h, sites) of the lines (h, site) on `sites` sites or more.

    A sketch of each line's sites is built in every task and merged by line.
    An estimate outside the band around the threshold decides by itself; one
    inside it is replaced by an exact distinct count.
    """
    sketched = each.groupBy("h").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("s")).where(F.col("n") >= sites)
    guess = cut(sketched.select("h", F.hll_sketch_estimate("s").alias("sites")).where(F.col("sites") >= sites * (1 - NEAR)))
    near = F.col("sites") <= sites * (1 + NEAR)
    band = guess.where(near).select("h")
    # a line on few sites may have very many rows: they stay where they are, or come once per site
    some = each.join(F.broadcast(band), "h", "left_semi") if band.count() <= BROADCAST_ROWS else each.distinct().join(band, "h", "left_semi")
    exact = some.groupBy("h").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= sites)
    return cut(guess.where(~near).unionByName(exact))


def spread(docs: DataFrame, sites: int = SITES, own: float = 0.0) -> DataFrame:
    """(h, sites) of the boilerplate lines of `docs`: those that distinct texts hold on `sites` sites or more.

    With `own` above 0, a text counts for a second, deciding spread only if
    at least that share of its characters is in lines that aren't far-spread
    by the first. Near copies of a document on many sites share most of their
    lines, so they count for none of these and keep them, however many they
    are; texts that only carry a header and a footer do count.
    """
    texts = distinct_texts(docs)
    if own <= 0:
        return _far(texts.select("site", F.explode("ls.h").alias("h")), sites)
    texts = cut(texts.withColumn("text", F.monotonically_increasing_id()))
    each = texts.select("text", "site", F.explode("ls").alias("x")).select("text", "site", "x.*")
    far = _far(each.select("h", "site"), sites).select("h")
    far = F.broadcast(far) if far.count() <= BROADCAST_ROWS else far  # so that very common lines stay where they are
    shared = each.join(far, "h", "left_semi").groupBy("text").agg(F.sum("size").alias("shared"))
    whole = F.aggregate("ls", F.lit(0).cast("long"), lambda n, x: n + x["size"])
    voters = texts.join(shared, "text").where(whole - F.col("shared") >= own * whole)
    return _far(voters.select("site", F.explode("ls.h").alias("h")).join(far, "h", "left_semi"), sites)


def removed(docs: DataFrame, sites: int = SITES, own: float = 0.0, count: str = "n_removed") -> DataFrame:
    """`docs` with boilerplate lines taken out of `text`, and the lines removed.

    Every row and column stays; `text` loses all lines that `spread` names,
    and the rest is joined by newlines as before. Texts without such lines,
    nulls and empty texts among them, stay as they are. A null source is a
    site of its own. Ids play no part: they may be null or repeat. Adds how
    many lines went as the column named by `count`.
    """
    found = spread(docs, sites, own).select("h")
    n = found.count()
    ls = F.split("text", "\n")
    if n <= LITERAL_LINES:
        # 2 * n short lists, by the hash's remainder: a line is looked up in one of them, where the text is
        slots = max(1, 2 * n)
        lists: list[list[int]] = [[] for _ in range(slots)]
        for (h,) in found.collect():
            lists[h % slots].append(h)
        table = F.from_json(F.lit(json.dumps(lists)), "array<array<bigint>>")
        kept = F.filter(ls, lambda x: ~F.array_contains(F.get(table, F.pmod(F.xxhash64(_line(x)), F.lit(slots)).cast("int")), F.xxhash64(_line(x))))
        return _without(docs, ls, kept, count)
    row, gone, h = (free_name(docs, x) for x in ("row", "gone", "h"))
    docs = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    each = docs.select(row, F.explode(F.array_distinct(F.transform(ls, lambda x: F.xxhash64(_line(x))))).alias(h))
    hits = each.join(found.withColumnRenamed("h", h), h, "left_semi").groupBy(row).agg(F.collect_set(h).alias(gone))
    kept = F.filter(ls, lambda x: ~F.coalesce(F.array_contains(gone, F.xxhash64(_line(x))), F.lit(False)))
    return _without(docs.join(hits, row, "left"), ls, kept, count).drop(row, gone)


def _without(docs: DataFrame, ls: Column, kept: Column, count: str) -> DataFrame:
    """The texts of fewer lines joined anew, and how many went."""
    left = free_name(docs, "left")
    made = docs.withColumn(left, kept)
    number = F.coalesce(F.when(F.col("text").isNotNull(), F.size(ls) - F.size(left)), F.lit(0))
    text = F.when(number > 0, F.array_join(left, "\n")).otherwise(F.col("text")).alias("text")
    others = [c for c in docs.columns if c.lower() != count.lower()]
    return made.select(*[text if c == "text" else F.col(f"`{c}`") for c in others], number.alias(count))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without boilerplate lines, and how many were removed, for every document."""
    return removed(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


ORACLE = r"""
WITH t AS (SELECT coalesce(text, '') AS text, min(coalesce(source, '')) AS source FROM documents GROUP BY 1),
l AS (SELECT source, trim(unnest(string_split(text, chr(10))), ' ') AS t FROM t),
g AS (SELECT list(t) AS ts FROM (SELECT t FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10)),
k AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls,
         list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(ts, trim(x, ' ')), false)) AS kept
  FROM documents, g)
SELECT doc_id, CASE WHEN len(kept) < len(ls) THEN coalesce(array_to_string(kept, chr(10)), '') ELSE text END AS text,
       CAST(coalesce(len(ls) - len(kept), 0) AS INTEGER) AS n_removed
FROM k
"""
