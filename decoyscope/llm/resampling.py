"""Importance resampling of documents towards a target's word runs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.llm.common import cut, read

#: Buckets of features; share of the eligible documents that is drawn, in hundredths; words that make a document eligible; text before the id that is hashed.
BUCKETS, SHARE, LEAST_WORDS, SALT = 10_000, 25, 20, "7:"
#: Bytes of text worked on together, about; rows of a matrix.
BLOCK, ROWS = 4_000_000, 65_536


def _fold() -> bytes:
    """Byte -> byte: A-Z to lower case; what is no digit, letter or part of a longer character to a space."""
    word = lambda b: chr(b).isalnum() or b >= 0x80
    return bytes(ord(chr(b).lower()) if b < 0x80 and word(b) else b if word(b) else 0x20 for b in range(256))


def _crc_steps() -> np.ndarray:
    """What a byte does to a CRC-32 (reflected polynomial EDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


FOLD, STEPS = _fold(), _crc_steps()


def crc32s(stream: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of slices of a byte stream, each at least one byte long.

    Slices of equal length form the rows of a matrix of bytes; a step updates
    the sums of all its rows by one column. The results are then scattered
    back to the slices' order.
    """
    out = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=0, append=0))
    for lo, hi in zip(edges[:-1], edges[1:]):
        length = int(lengths[order[lo]])
        rows = max(1, min(ROWS, 16 * ROWS // length))
        for at in range(lo, hi, rows):
            some = order[at : min(at + rows, hi)]
            matrix = np.empty((len(some), length), dtype=np.uint8, order="F")
            for j in range(length):
                matrix[:, j] = stream[starts[some] + j]
            crc = np.full(len(some), 0xFFFFFFFF, dtype=np.uint32)
            for j in range(length):
                crc = STEPS[(crc ^ matrix[:, j]) & 0xFF] ^ crc >> 8
            out[some] = ~crc
    return out


def _first(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n codes stands first."""
    at = np.empty(n, dtype=np.int64)
    at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return at


def _pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A folded text in pieces cut at spaces, and whether a piece begins with the last word of the one before."""
    at, last = 0, b""
    while at < len(text):
        end = text.find(b" ", at + BLOCK)
        end = len(text) if end < 0 else end
        piece = text[at:end]
        yield last + b" " + piece if last else piece, bool(last)
        if end < len(text):
            last = piece.rsplit(maxsplit=1)[-1] if piece.strip() else last
        at = end


def featured(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature), features being all words and pairs of neighbours, repeats included.

    The words of all texts are put in one stream with a space between them,
    so a distinct word or pair is a slice of it where it stands first; only
    distinct features are hashed.
    """
    n = np.zeros(len(texts), dtype=np.int64)
    flat, owner, again = [], [], []
    for i, text in enumerate(texts):
        for piece, repeated in _pieces((text or "").encode("utf-8", "surrogatepass").translate(FOLD)):
            ws = piece.split()
            flat += ws
            owner.append((i, len(ws)))
            again.append((repeated and len(ws) > 0, len(ws)))
            n[i] += len(ws) - (repeated and len(ws) > 0)
    if not flat:
        return n, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    of = np.repeat([i for i, _ in owner], [m for _, m in owner])
    index = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(index.__getitem__, flat), dtype=np.int64, count=len(flat))
    lengths = np.fromiter(map(len, index), dtype=np.int64, count=len(index))[ids]
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    stream = np.frombuffer(b" ".join(flat), dtype=np.uint8)
    first = _first(ids, len(index))
    singles = crc32s(stream, starts[first], lengths[first])[ids] % buckets
    # a piece's first word may be the last one of the piece before: it counts only as a part of a pair
    begins = np.cumsum([0, *[m for _, m in again][:-1]])
    twice = np.array([b for b, (r, _) in zip(begins, again) if r], dtype=np.int64)
    own = np.ones(len(flat), dtype=bool)
    own[twice] = False
    pair = np.ones(len(flat), dtype=bool)  # whether a word has one after it in its piece
    pair[-1:] = False
    pair[begins[1:][begins[1:] > 0] - 1] = False
    left = np.flatnonzero(pair)
    codes, known = pd.factorize(ids[left] * len(index) + ids[left + 1])
    first = left[_first(codes, len(known))]
    pairs = crc32s(stream, starts[first], ends[first + 1] - starts[first])[codes] % buckets
    return n, np.concatenate([of[own], of[left]]), np.concatenate([singles[own], pairs]).astype(np.int64)


def _blocks(texts: pd.Series) -> Iterator[slice]:
    """Runs of texts of bounded length; a longer text is one alone."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        its = len(text or "")
        if i > begin and size + its > BLOCK:
            yield slice(begin, i)
            begin, size = i, 0
        size += its
    if begin < len(texts):
        yield slice(begin, len(texts))


def feature_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket: one row per bucket and task is sent on, one per bucket to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(buckets, dtype=np.int64)
        for pdf in batches:
            for run in _blocks(pdf["text"]):
                n += np.bincount(featured(list(pdf["text"][run]), buckets)[2], minlength=buckets)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": n[some]})

    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed share of a bucket in the target over that in the corpus."""
    every, all_target = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratio = lambda s, t: (t + 1.0) * every / ((s + 1.0) * all_target)
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def _luck(doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{SALT}{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    buckets = len(gain)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run in _blocks(pdf["text"]):
                some = pdf[run]
                n, owner, bucket = featured(list(some["text"]), buckets)
                features = np.bincount(owner, minlength=len(n))
                total = np.zeros(len(n), dtype=np.int64)
                np.add.at(total, owner, gain[bucket])
                weight = total // np.maximum(features, 1)
                ids = [None if pd.isna(i) else int(i) for i in some["doc_id"]]
                yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_words": n, "n_features": features, "weight": weight, "score": weight + np.array([_luck(i) for i in ids], dtype=np.int64)})

    # ids may be null: as text they keep every digit on the way to Python
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(score, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """Every document with its weight and score, and its rank if it is drawn.

    Words are runs of ASCII letters and digits and of characters beyond
    ASCII; features are words and pairs of neighbours. The highest scores are
    drawn, ties by the smaller doc_id, null ids last; rows that repeat have
    ranks of their own. Null and empty texts have no features, weight 0 and
    no rank. An empty target gives weights against an even spread. An empty
    table gives no rows. Other columns are ignored.

    Returns doc_id, n_features, weight, score, rank.
    """
    gain = gains(feature_counts(docs, buckets), feature_counts(target, buckets))
    rows = cut(weighted(docs, gain).withColumn("eligible", F.col("n_words") >= least_words).drop("n_words"))
    # sorted into ranges; a row's rank is its place in its range and the rows of the ranges before
    by = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ranged = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("range", F.shiftright("at", 33))
    sizes = {r["range"]: (r["n"], r["fit"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.count_if("eligible").alias("fit")).collect()}
    drawn, offset, before = share * sum(fit for _, fit in sizes.values()) // 100, [], 0
    for k in sorted(sizes):
        offset.append((k, before))
        before += sizes[k][0]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(offset, "range long, before long"))  # one row for each range
    place = F.col("before") + F.col("at").bitwiseAND(2**33 - 1) + 1
    return ranged.join(offsets, "range").select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: CRC-32 by half bytes; bytes of a feature from its hex digits.
ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, row_number() OVER (),
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
half AS (SELECT list_transform(range(16), lambda n: list_reduce(list_prepend(n, range(4)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS h),
f AS (
  SELECT kind, r, unnest(ws) AS f FROM w
  UNION ALL
  SELECT kind, r, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
g AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
c AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2),
      lambda i: (position(x[2 * i + 1] IN '0123456789ABCDEF') - 1) * 16 + position(x[2 * i + 2] IN '0123456789ABCDEF') - 1)),
    lambda a, b: xor(xor(xor(a, b) // 16, h[xor(a, b) % 16 + 1]) // 16, h[xor(xor(a, b) // 16, h[xor(a, b) % 16 + 1]) % 16 + 1]))) % 10000 AS bucket
  FROM g, half),
n AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM f JOIN c USING (f) GROUP BY bucket),
total AS (SELECT sum(s)::DOUBLE + 10000 AS s, sum(t)::DOUBLE + 10000 AS t FROM n),
gain AS (SELECT bucket, floor(1000 * ln((n.t + 1) * total.s / ((n.s + 1) * total.t)))::BIGINT AS gain FROM n, total),
weight AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN c USING (f) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY r),
scored AS (
  SELECT id AS doc_id, len(ws) >= 20 AS fit, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || sha256('7:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weight USING (r) WHERE kind = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS fits FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * fits // 100 THEN place END AS rank FROM ranked
"""
