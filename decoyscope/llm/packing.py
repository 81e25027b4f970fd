"""Packs token ids into fixed windows by Karmarkar-Karp differencing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.llm.common import TEXTS, begins, cut, give_back, in_batches, read
from decoyscope.llm.differencing import differencing
from decoyscope.llm.tokens import word_ids

#: A document's last, partial window is cut into pieces of at most this many tokens.
PIECE = 512
#: Windows that one differencing fills, and pieces that it takes, about.
WINDOWS, PIECES = 512, 32_768


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """Encodes whole texts and cuts their ids: full windows first, then pieces of the rest."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begins("tokens")
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in in_batches(batches, 512):
            out = []
            for row, doc, ids in zip(pdf["row_id"], pdf["doc_id"], word_ids(tokenizer).texts(pdf["text"].tolist())):
                ids += end
                n = len(ids) // 4
                at = 0
                while at < n:
                    size = capacity if n - at >= capacity else min(PIECE, n - at)
                    out.append((row, doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
                    at += size
            made = pd.DataFrame(out, columns=["row_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            give_back()
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(encode, "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each piece: differencing over as few windows as hold them.

    The window count begins at the least possible and rises by one whenever
    some window exceeds the capacity.
    """
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = differencing(lengths, windows)
        if np.bincount(window, weights=lengths, minlength=windows).max(initial=0) <= capacity:
            return window
        windows += 1


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    A document is its text's ids and `end_id`. Its full windows are
    sequences of their own, numbered where they are; what is left is cut into
    pieces of at most `PIECE` tokens, dealt evenly into buckets of about
    `WINDOWS` windows and at most about `PIECES` pieces, and differenced there. A null or empty text is one piece that holds the end
    id. Repeated rows are packed each; null ids are kept. Other columns are
    ignored; an empty table gives no rows. A sequence id is its bucket times
    2**32 plus its number there, and negative for a full window.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    cutted = cut(pieces(docs, capacity, tokenizer, end_id), TEXTS)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rests = cutted.where(F.col("length") < capacity)
    total, n = rests.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-total // (capacity * WINDOWS)), -(-n // PIECES))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_id", "start"], ascending=[False, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        window = fill(lengths, capacity)
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.r_[True, window[order][1:] != window[order][:-1]]
        base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        offset = np.empty(len(pdf), dtype=np.int64)
        offset[order] = ends - lengths[order] - base
        out = pdf[columns]
        return out.assign(doc_id=out["doc_id"].astype("Int64"), sequence_id=(np.int64(pdf["bucket"].iloc[0]) << 32) + window, offset=offset)

    dealt = rests.withColumn("bucket", F.pmod(F.xxhash64("row_id", "start"), F.lit(buckets)).cast("int"))
    placed = dealt.groupBy("bucket").applyInPandas(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    # full windows stay where they are
    full = cutted.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
