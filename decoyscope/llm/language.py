"""Language identification by a bidirectional GRU over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decoyscope.llm.common import crc_mod, in_batches, read

#: Documents of each language that the fit reads at most, spans of each and their characters, and languages.
SAMPLE, SPANS, SPAN_CHARS, LANGUAGES = 300, 6, 160, 1000
HIDDEN, EMBED = 10, 12
#: Bytes of a text that one recurrent pass labels, bytes on either side that it reads without labelling them, and least and most bytes of a pass in the fit.
WINDOW, MARGIN, SHORT, TRAINED = 480, 16, 4, 48
#: Windows that are read together.
TOGETHER = 1024


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class ByteGRU:
    """Two GRUs, one for each direction, and a softmax over languages at every byte."""

    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        g = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": g(257, EMBED) * 4, "Wo": g(2 * HIDDEN, len(labels)), "bo": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": g(EMBED, 3 * HIDDEN), f"U{d}": g(HIDDEN, 2 * HIDDEN), f"V{d}": g(HIDDEN, HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None):
        """Hidden states (T, B, H); x holds bytes (T, B), 256 outside a sequence."""
        p, H = self.p, HIDDEN
        table = p["E"] @ p[f"W{d}"] + p[f"b{d}"]
        T, B = x.shape
        h = np.zeros((B, H), np.float32)
        out = np.zeros((T, B, H), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a = table[x[t]]
            zr = _sigmoid(a[:, : 2 * H] + h @ p[f"U{d}"])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(a[:, 2 * H :] + (r * h) @ p[f"V{d}"])
            new = z * h + (1 - z) * c
            m = mask[t][:, None]
            if tape is not None:
                tape.append((t, h, z, r, c, m))
            h = np.where(m, new, h)
            out[t] = h
        return out

    def _states(self, x: np.ndarray, full: np.ndarray, d: str) -> np.ndarray:
        """As `_run`, for labelling alone: no masks where all windows go on, and few copies."""
        p, H = self.p, HIDDEN
        T, B = x.shape
        table = p["E"] @ p[f"W{d}"] + p[f"b{d}"]
        table[:, : 2 * H] *= 0.5  # sigmoid(v) = (1 + tanh(v / 2)) / 2
        tz, tr, tc = (np.ascontiguousarray(table[:, k * H : (k + 1) * H], dtype=np.float32) for k in range(3))
        uz, ur = (np.ascontiguousarray(p[f"U{d}"][:, k * H : (k + 1) * H] * np.float32(0.5)) for k in range(2))
        z, r, c, a = (np.empty((B, H), np.float32) for _ in range(4))
        h, out = np.zeros((B, H), np.float32), np.empty((T, B, H), np.float32)

        def gate(g: np.ndarray, state: np.ndarray, weights: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
            np.matmul(state, weights, out=g)
            np.take(rows, at, axis=0, out=a, mode="clip")
            np.add(g, a, out=g)
            np.tanh(g, out=g)

        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            for g, u, rows in ((r, ur, tr), (z, uz, tz)):
                gate(g, h, u, rows, x[t])
                g += 1
                g *= np.float32(0.5)
            r *= h
            gate(c, r, p[f"V{d}"], tc, x[t])
            new = out[t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            if not full[t]:
                new[x[t] == 256] = h[x[t] == 256]
            h = new
        return out

    def log_probs(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-probability of each language at every position (T, B, L)."""
        full = mask.all(axis=1)
        logits = self._states(x, full, "f") @ self.p["Wo"][:HIDDEN]
        logits += self._states(x, full, "b") @ self.p["Wo"][HIDDEN:]
        logits += self.p["bo"]
        np.clip(logits, -60, 60, out=logits)  # so that no exponential overflows
        logits -= np.log(np.exp(logits) @ np.ones(len(self.labels), np.float32))[:, :, None]
        return logits

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Mean cross-entropy over positions and its gradients, by backpropagation through time."""
        p, H = self.p, HIDDEN
        tapes = {d: [] for d in "fb"}
        hs = {d: self._run(x, mask, d, tapes[d]) for d in "fb"}
        h = np.concatenate([hs["f"], hs["b"]], axis=2)
        logits = h @ p["Wo"] + p["bo"]
        logits -= logits.max(axis=2, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(axis=2, keepdims=True)
        n = max(1, mask.sum())
        take = q[:, np.arange(len(y)), y]
        loss = float(-(np.log(take + 1e-9) * mask).sum() / n)
        q[:, np.arange(len(y)), y] -= 1
        q *= mask[:, :, None] / n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["Wo"] = np.einsum("tbh,tbl->hl", h, q)
        g["bo"] = q.sum(axis=(0, 1))
        dh_all = q @ p["Wo"].T
        for k, d in enumerate("fb"):
            carry = np.zeros((x.shape[1], H), np.float32)
            da = np.zeros((*x.shape, 3 * H), np.float32)
            for t, before, z, r, c, m in reversed(tapes[d]):
                dh = dh_all[t, :, k * H : (k + 1) * H] + carry
                inside = dh * m
                dc = inside * (1 - z) * (1 - c * c)
                dz = inside * (before - c) * z * (1 - z)
                back = dc @ p[f"V{d}"].T
                dr = back * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                carry = dh * ~m + inside * z + back * r + dzr @ p[f"U{d}"].T
                g[f"U{d}"] += before.T @ dzr
                g[f"V{d}"] += (r * before).T @ dc
                da[t] = np.concatenate([dzr, dc], axis=1)
            flat = da.reshape(-1, 3 * H)
            per_byte = np.zeros((257, 3 * H), np.float32)
            np.add.at(per_byte, x.reshape(-1), flat)
            g[f"b{d}"] = flat.sum(axis=0)
            g[f"W{d}"] = p["E"].T @ per_byte
            g["E"] += per_byte @ p[f"W{d}"].T
        return loss, g

    def fit(self, spans: list[list[bytes]], steps: int = 700, batch: int = 128, rate: float = 0.01, seed: int = 5):
        """Adam on random windows of the spans of each language; every language counts alike."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            y = rng.integers(0, len(spans), batch)
            some = [spans[k][rng.integers(0, len(spans[k]))] for k in y]
            size = rng.integers(SHORT, TRAINED + 1, batch)  # short texts are whole windows, too
            at = [int(rng.integers(0, max(1, len(b) - n + 1))) for b, n in zip(some, size)]
            x, mask = padded([b[k : k + n] for b, k, n in zip(some, at, size)])
            _, g = self.gradients(x, mask, y)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                step = rate * (1 - i / (steps + 1)) * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)
                self.p[k] = (self.p[k] - step).astype(np.float32)
        return self

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Best label and its pooled probability for each text.

        A text's bytes are cut into windows of WINDOW, each read with MARGIN
        more on either side, so that both passes come warm to the first byte
        they label. Every byte is labelled once, and a text's log-probabilities
        are the sums of its bytes'.
        """
        whole = [bytes_of(t) for t in texts]
        sizes = np.array([len(b) for b in whole], dtype=np.int64)
        flat = np.frombuffer(b"".join(whole), dtype=np.uint8)
        ends = np.cumsum(sizes)
        per = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(whole)), per)
        start = (ends - sizes)[owner] + WINDOW * (np.arange(len(owner)) - (np.cumsum(per) - per)[owner])
        stop = np.minimum(start + WINDOW, ends[owner])
        lo, hi = np.maximum(start - MARGIN, (ends - sizes)[owner]), np.minimum(stop + MARGIN, ends[owner])
        pooled = np.zeros((len(whole), len(self.labels)))
        order = np.argsort(hi - lo, kind="stable")
        for k in range(0, len(order), TOGETHER):
            w = order[k : k + TOGETHER]
            at = lo[w] + np.arange((hi - lo)[w].max())[:, None]
            mask = at < hi[w]
            x = np.where(mask, flat[np.minimum(at, len(flat) - 1)].astype(np.intp), 256)
            labelled = (at >= start[w]) & (at < stop[w])
            np.add.at(pooled, owner[w], np.einsum("tbl,tb->bl", self.log_probs(x, mask), labelled.astype(np.float32)))
        q = np.exp(pooled - pooled.max(axis=1, keepdims=True))
        return q.argmax(axis=1), q.max(axis=1) / q.sum(axis=1)


def padded(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    T = max(1, *map(len, some))
    flat = np.frombuffer(b"".join(b.ljust(T, b"\0") for b in some), dtype=np.uint8).reshape(len(some), T).T
    mask = np.arange(T)[:, None] < np.array([len(b) for b in some])
    return np.where(mask, flat.astype(np.intp), 256), mask


def bytes_of(text: str | None) -> bytes:
    """The lower-cased text with runs of white space as one space, in UTF-8."""
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def sample(docs: DataFrame) -> pd.DataFrame:
    """(lang, spans): labelled texts for the fit, SAMPLE documents of each language at most.

    Only rows with a language whose crc32(doc_id) mod 4 is not 2 and whose text
    has a letter, in the order of a hash of id and text. The driver gets SPANS
    spans of SPAN_CHARS characters from hashed places of each whole text,
    and one row per language, of which there may be LANGUAGES.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_mod("doc_id", 4) != 2)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = usable.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # a language is thinned to about twice the bound where the rows are, and cut to it after that
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * SAMPLE + 50) / r["count"])) for r in sizes], "lang string, rate double")
    thinned = usable.join(F.broadcast(rates), "lang").where(F.pmod("h", F.lit(1_000_003)) < F.col("rate") * 1_000_003)
    place = lambda i: F.pmod(F.xxhash64(i, "h"), F.greatest(F.length("text") - SPAN_CHARS, F.lit(0)) + 1).cast("int") + 1
    spans = F.transform(F.sequence(F.lit(1), F.lit(SPANS)), lambda i: F.substring("text", place(i), F.lit(SPAN_CHARS)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "text"))
    got = thinned.select("lang", spans.alias("spans"), first.alias("at")).where(F.col("at") <= SAMPLE).select("lang", "spans", "at")
    return got.toPandas().sort_values(["lang", "at"], ignore_index=True)


def train(docs: DataFrame) -> ByteGRU | None:
    got = sample(docs)
    spans: dict[str, list[bytes]] = {}
    for lang, some in zip(got["lang"], got["spans"]):
        spans.setdefault(lang, []).extend(b for b in map(bytes_of, some) if b)
    labels = sorted(k for k, v in spans.items() if v)
    return ByteGRU(labels).fit([spans[k] for k in labels]) if labels else None


def languages(docs: DataFrame) -> DataFrame:
    """Predicts the language of every whole text.

    Both recurrent passes run over all bytes of a text, in overlapping
    windows; every byte gets label log-probabilities, and a document's are
    their sum. Texts that are null or have no letter are `und` with score 0;
    without any labelled text all are. Repeated rows and null ids are kept; an
    empty table gives no rows. Other columns are ignored.

    Returns doc_id, held_out, lang_pred, score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.pandas_udf("lang string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for texts in batches:
            made = [pd.DataFrame({"lang": pd.Series(dtype=object), "score": pd.Series(dtype=float)})]
            for part in in_batches([texts.to_frame("text")], 512):
                if model is None:
                    made.append(pd.DataFrame({"lang": ["und"] * len(part), "score": 0.0}))
                    continue
                best, sure = model.texts(part["text"].tolist())
                made.append(pd.DataFrame({"lang": [model.labels[i] for i in best], "score": sure}))
            yield pd.concat(made[1:] or made, ignore_index=True)

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), letters.alias("letters"), label("text").alias("x"))
    return out.select(
        "doc_id",
        "held_out",
        F.when(F.col("letters"), F.col("x.lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("x.score")).otherwise(0.0).alias("score"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))
