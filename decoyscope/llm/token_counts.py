"""Token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.llm.common import WHITE, begins, cut, in_batches, join_groups, read, remove, shared_dir
from decoyscope.llm.tokens import word_ids

#: Digests to be encoded (32 bytes each) up to which they are broadcast, so that only their texts travel.
BROADCAST_ROWS = 100_000
CACHE = "tokenizer string, digest binary, n_tokens long"


@lru_cache(maxsize=16)
def tokenizer_digest(name: str) -> str:
    """SHA-256 of the tokenizer's file and of how it is called."""
    import public_tokenizers
    import tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read() + f"|{tokenizers.__version__}|plain".encode()).hexdigest()


def _stored(spark: SparkSession, cache: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(CACHE).parquet(cache) if fs.exists(path) else spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Counts the tokens of every whole text.

    `cache` is a Parquet folder of (tokenizer, digest, n_tokens) in a shared
    store; it is made when absent, and rows are only ever appended. Contents
    are normalised by joining their words with single spaces, which leaves
    the count as it is for tokenizers that drop white space. Texts whose
    digest isn't stored are encoded once each, however many rows hold them,
    and appended before the counts are read back; a task that is run again
    writes the same rows. Two writers may append the same digest; readers
    take one of the equal counts. None: a cache of this call alone.

    A null counts as the empty text, which has no tokens. Repeated rows and
    null ids are kept; an empty table gives no rows. Other columns are ignored.
    A tokenizer that keeps white space or joins across it is refused.

    Returns doc_id, n_bytes, n_tokens, over_limit.
    """
    spark = docs.sparkSession
    own, cache = cache is None, cache or f"{shared_dir(spark)}/token_counts_{uuid.uuid4().hex}"
    version = tokenizer_digest(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.trim(F.regexp_replace(text, WHITE, " "))
    digest = F.unhex(F.sha2("norm", 256)).alias("digest")
    rows = cut(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), norm.alias("norm")).select("doc_id", "n_bytes", digest))
    groups = cut(rows.groupBy("digest").agg(F.count("*").alias("n")))
    known = _stored(spark, cache).where(F.col("tokenizer") == version)
    missing = cut(groups.select("digest").join(known.select("digest"), "digest", "left_anti"))
    n = missing.count()
    if n:
        if n <= BROADCAST_ROWS:
            missing = F.broadcast(missing)
        texts = docs.select(norm.alias("norm")).select(digest, "norm").join(missing, "digest", "left_semi").dropDuplicates(["digest"])

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            begins("tokens")
            for pdf in in_batches(batches, 512):
                counts = [len(ids) // 4 for ids in word_ids(tokenizer).texts(pdf["norm"].tolist())]
                yield pd.DataFrame({"tokenizer": version, "digest": pdf["digest"], "n_tokens": counts})

        texts.mapInPandas(encode, CACHE).write.mode("append").parquet(cache)
    counts = _stored(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted = cut(groups.join(counts, "digest"))
    if own:
        remove(spark, cache)
    return join_groups(rows, counted, ["digest"], "n", rows.count()).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
