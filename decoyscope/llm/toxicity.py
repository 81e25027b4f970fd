"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.llm.common import begins, crc_mod, keeps, read

#: Weights are hashed into 2**BITS places.
BITS = 20
#: Labelled rows of each class that the fit reads at most, in the order of a hash of their ids, and distinct features of each.
SAMPLE, FEATURES = 3000, 4096
#: How much more a toxic row may count than another, where they are few.
CAP = 3.0
#: Score from which a document is predicted toxic.
THRESHOLD = 0.7
#: Bytes of a word's stems, and numbers of words with a stem from which it is a further feature.
STEMS, OFTEN = (4, 6, 8), (2, 4, 8)
#: Words whose hashes a worker keeps.
KEPT = 150_000
_MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


class _Words:
    """Hashes of words and of their stems, kept in each worker: 0 for a stem that a word is too short for."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.numbers = array("Q")

    def add(self, word: str) -> None:
        bare = word.lower().strip(_MARKS).encode("utf-8", "surrogatepass")
        self.at[word] = len(self.at)
        self.numbers.append(zlib.crc32(bare) + 1)
        for k in STEMS:  # letters of two bytes are cut between two of them at most: a stem is a stem
            self.numbers.append(zlib.crc32(bare[:k]) + 1 if len(bare) >= k else 0)

    def hashes(self, text: str | None) -> np.ndarray:
        """One row for each white-space separated word, lower-cased, without punctuation around it."""
        words = (text or "").split()
        if len(self.at) > KEPT:
            self.__init__()
        try:
            at = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            for w in words:
                if w not in self.at:
                    self.add(w)
            at = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
        return np.frombuffer(self.numbers, dtype=np.uint64).reshape(-1, 1 + len(STEMS))[at]


_words = _Words()
keeps("toxicity", _words.__init__)


def features(text: str | None, dense: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed places of a text's words, stems, word pairs and pairs with one word between; of stems also how often they occur.

    With the weights of all places, `dense`, those are left out that have none and whose stem has none.
    """
    rows = _words.hashes(text)
    shift = np.uint64(64 - BITS)
    h = rows[:, 0]
    with np.errstate(over="ignore"):
        one = h * np.uint64(0x9E3779B97F4A7C15)
        parts = [one >> shift]
        if len(h) > 1:
            parts.append((one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9)) >> shift)
        if len(h) > 2:
            parts.append((one[:-2] * np.uint64(0xD6E8FEB86659FD93) + h[2:] * np.uint64(0xA0761D6478BD642F)) >> shift)
        stems = np.concatenate([(rows[:, k][rows[:, k] > 0] + np.uint64(k << 40)) * np.uint64(0xD1342543DE82EF95) for k in range(1, rows.shape[1])])
        often = lambda x, i: (x + np.uint64(i)) * np.uint64(0xA24BAED4963EE407) >> shift if i else x >> shift
        if dense is not None:
            some = dense != 0
            parts = [p[some[p]] for p in (q.astype(np.int64) for q in parts)]
            stems = stems[np.logical_or.reduce([some[often(stems, i).astype(np.int64)] for i in range(len(OFTEN) + 1)])]
        stems, n = np.unique(stems, return_counts=True)
        parts += [often(stems[n >= least], i).astype(np.int64) for i, least in enumerate((1, *OFTEN))]
    return np.unique(np.concatenate([p.astype(np.int64) for p in parts]))


def fit(rows: list[np.ndarray], toxic: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 15.0, l2: float = 0.1, epochs: int = 6, seed: int = 7):
    """FTRL-proximal: per-coordinate learning rates, L1 for sparsity.

    `rows` has the distinct features of each text. Returns (bias, places,
    weights) of the non-zero weights. Classes are weighted towards counting alike.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    share = max(1e-6, float(np.mean(toxic))) if len(toxic) else 1.0
    cost = np.where(toxic == 1, min(CAP, (1 - share) / share), 1.0)
    rng = np.random.default_rng(seed)

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            w = weight(z[at], n[at])
            b = -zb / ((beta + nb**0.5) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(b + w.sum(), -35, 35)))
            g = (p - toxic[i]) * cost[i]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    w = weight(z, n)
    places = np.flatnonzero(w)
    return -zb / ((beta + nb**0.5) / alpha + l2), places, w[places]


def score(text: str | None, bias: float, dense: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(bias + dense[features(text, dense)].sum(), -35, 35))))


def _packed(texts: pd.Series) -> pd.Series:
    """A text's features as 32-bit integers; of more than FEATURES, those that come first by a hash."""
    begins("toxicity")
    out = []
    for t in texts:
        at = features(t)
        if len(at) > FEATURES:
            at = at[np.argpartition(at * 2654435761 % 4294967291, FEATURES)[:FEATURES]]
        out.append(np.sort(at).astype("<i4").tobytes())
    return pd.Series(out, dtype=object)


def train(docs: DataFrame, labels: DataFrame):
    """Fits on labelled rows whose crc32(doc_id) mod 3 is not 1.

    At most `SAMPLE` ids of each class are taken, chosen by a hash of the id,
    and one row of each; conflicting labels of an id count as toxic. Tasks turn
    the whole texts into features, and the driver gets at most FEATURES of
    each: 4 bytes * FEATURES * 2 * SAMPLE, 98 MB, whatever the texts'
    lengths. None if a class is missing.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for kind in (0, 1):
        some = marks.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 * SAMPLE ids; of rows that share one, the one whose features come first
    made = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", F.pandas_udf(_packed, "binary")("text").alias("x"))
    got = made.groupBy("doc_id", "toxic").agg(F.min("x").alias("x")).select("toxic", "x").toPandas()
    if got["toxic"].nunique() < 2:
        return None
    got = got.drop_duplicates().sort_values(["toxic", "x"], ignore_index=True)
    return fit([np.frombuffer(x, dtype="<i4") for x in got["x"]], got["toxic"].to_numpy(np.float64))


def scorer(docs: DataFrame, labels: DataFrame):
    """A function from a text column to its score, fitted by `train`; the non-zero weights are broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    # texts become Python strings one by one: a batch of them isn't held twice
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begins("toxicity")
        dense = np.zeros(1 << BITS, dtype=np.float32)
        bias = None
        if sent.value is not None:
            bias, places, weights = sent.value
            dense[places] = weights
        for texts in batches:
            yield pa.array([0.0 if bias is None else score(t.as_py(), bias, dense) for t in texts], pa.float64())

    return scored


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every whole text.

    The weights are learnt from `labels` (doc_id, toxic); scores use the text
    alone, whole texts of any length. A null text counts as empty and gets the
    bias. Without labels of both classes every score is 0. Repeated rows and
    null ids are kept; an id that repeats teaches with one of its rows. An empty
    table gives no rows. Other columns are ignored.

    Returns doc_id, held_out, score, predicted.
    """
    out = docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), scorer(docs, labels)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
