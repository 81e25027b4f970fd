"""MinHash near-duplicates: bands find candidates, odd sketches judge them, full sets confirm them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.llm import near_sets
from decoyscope.llm.common import TEXTS, cut, join_groups, read
from decoyscope.llm.components import components
from decoyscope.llm.near_sets import shingle_hashes

#: Words of a shingle, least similarity.
WORDS, SIMILAR = 4, 0.8


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = SIMILAR) -> DataFrame:
    """Every document with the component of near-duplicates that it is in.

    A text's set are its distinct shingles of `words` words, lower-cased in
    A-Z; a shorter text is one shingle. Texts of one set meet once. Sets
    that share a band are candidates; links have a Jaccard similarity of
    `least` or more on the full sets. Texts without words, nulls among them,
    have empty sets and are linked with nothing. A component's id is its
    smallest doc_id, null only if all its ids are. Repeated rows are kept; a
    row is kept if its id is the component's, null ids only if all are null.
    Other columns are ignored; an empty table gives no rows.

    Returns doc_id, n_shingles, component_id, kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), near_sets.identity(F.col("text")).alias("body"), near_sets.sketched(F.col("text"), words).alias("x"))
    rows = cut(rows.select("doc_id", "body", "x.*"), TEXTS)
    one = ["whole", "check", "size"]
    classes = rows.where("size > 0").groupBy(*one).agg(F.min("doc_id").alias("least"), F.min("body").alias("body"), F.first("bands").alias("bands"), F.first("odd").alias("odd"), F.count("*").alias("n"))
    classes = cut(cut(classes).withColumn("key", F.monotonically_increasing_id()))
    members = near_sets.shared_buckets(classes.select(F.explode("bands").alias("h"), "key"))
    some = cut(members.select("key").distinct())
    sketches = cut(classes.join(some, "key").select("key", "size", "odd", "body"))
    sets = near_sets.sets_of(docs, sketches.select("body", "key"), lambda t: shingle_hashes(t, words, True))
    roots = components(near_sets.links(members, sketches.drop("body"), sets, least)).withColumnRenamed("node", "key")
    placed = cut(classes.select(*one, "key", "least", "n").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(placed.join(ids, "root").select(*one, "n", "component_id"))
    slim = rows.select("doc_id", *one)
    full = join_groups(slim.where("size > 0"), named, one, "n", rows.count()).unionByName(slim.where("size = 0").withColumns({"n": F.lit(1).cast("long"), "component_id": F.col("doc_id")}))
    return full.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
