"""Main text of web pages by a bidirectional LSTM that labels leaf blocks."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.llm.common import in_batches, read
from decoyscope.llm.html_blocks import leaf_blocks

#: Pages that the fit reads at most, blocks in a row of each, characters of a block and of its path, and re-dressed copies made of each page.
SAMPLE, BLOCKS, BLOCK_CHARS, PATH_TOKENS, DRESSED = 200, 400, 1000, 100, 4
PATHS, WORDS, EMBED_P, EMBED_W, HIDDEN = 1024, 4096, 16, 8, 16
KEPT = 500_000
#: Share of re-dressed pages whose markup says nothing.
NEUTRAL = 0.35

#: Words of tags, classes, ids and roles that mark what is not the article (fixed values, ours).
ASIDE = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip toc",
    "header": "header masthead banner branding logo tagline",
    "footer": "footer copyright colophon legal bottom imprint",
    "sidebar": "aside sidebar related recommended widget rail secondary complementary trending popular tags archive categories",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog warning paywall message disclaimer",
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion adsense teaser banner dfp outbrain taboola",
    "form": "form newsletter subscribe subscription signup login search searchbox contact register fieldset button label input",
    "comment": "comments comment discussion replies reply disqus respond thread commentlist reactions",
    "share": "share sharing social follow buttons author-box byline-share",
}
_ASIDE_TAGS = frozenset("nav header footer aside form fieldset button label menu dialog legend option".split())
_ASIDE_WORDS = frozenset("." + w for ws in ASIDE.values() for w in ws.replace("-", " ").split())
_MAIN = frozenset(["article", "main", ".article", ".content", ".post", ".entry", ".main", ".story", ".body", ".text"])

_kept: dict[str, int] = {}


def teacher(path: tuple[str, ...]) -> int | None:
    """What the markup itself says of a block: 1 article, 0 something else, None if it is silent."""
    inside = [i for i, t in enumerate(path) if t in _MAIN]
    if any(t in _ASIDE_WORDS or (t in _ASIDE_TAGS and not (t == "header" and "article" in path[:i])) for i, t in enumerate(path)):
        return 0
    return 1 if inside else None


def dressed(blocks: list[tuple[tuple[str, ...], str, float]], marks: list[int], others: list[str], rng: np.random.Generator):
    """The page's blocks under other markup, with further kinds of surroundings: (blocks, marks)."""
    main = [b for b, m in zip(blocks, marks) if m == 1]
    rest = [b[1] for b, m in zip(blocks, marks) if m == 0] + [others[i] for i in rng.integers(0, len(others), 6)]
    pick = lambda xs: xs[rng.integers(0, len(xs))]
    shells = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".main", "div", ".post"), ("div", ".article", ".body"), ("section", ".entry", ".content"), ("div", ".wrapper", "div", ".story"), ("div", ".page", "article", ".post"), ("div", ".main", ".col"), ("div", ".column")]
    tails = [("ul", "li"), ("ol", "li"), ("blockquote",), ("blockquote", "p"), ("div",), ("h2",), ("h3",), ("figure", "figcaption"), ("table", "tr", "td"), ("pre",), ("dl", "dd")]
    base = ("html", "body", *pick([(), ("div", ".wrapper"), ("div", ".container"), ("div", ".page", "div", ".site")]))
    shell = pick(shells)
    neutral = rng.random() < NEUTRAL
    if neutral:  # markup that says nothing: one and the same shell for all, classes without meaning
        base, shell = ("html", "body"), pick([("div",), ("div", ".x"), ("section", ".c"), ("div", ".x", "div")])
        plain = pick([("p",), ("div",), ("div", ".x")])

    def side(kind: str):
        if neutral:
            link = float(kind in ("menu", "share"))
            path = (*shell, *pick([("div",), ("p",), ("div", ".x"), ("ul", "li"), ("p", ".x")]))
            return [(path, pick(rest), link) for _ in range(rng.integers(1, 5))]
        word = pick(ASIDE[kind].split())
        own = {"menu": [("nav",), ("nav", "ul", "li"), ("ul", ".menu", "li")], "header": [("header",)], "footer": [("footer",)], "sidebar": [("aside",)], "notice": [("dialog",)], "advert": [("div", ".ad")], "form": [("form",), ("form", "label"), ("form", "button")], "comment": [("section", ".comments", "div")], "share": [("ul", ".share", "li")]}[kind]
        path = pick(own) if rng.random() < 0.4 else (pick(["div", "section", "ul", "aside", "div"]), "." + word.split("-")[0])
        path += pick([(), ("p",), ("div",), ("li",), ("h3",)])
        link = float(kind in ("menu", "share") or rng.random() < 0.3)
        return [(path, pick(rest), link if rng.random() < 0.8 else 0.0) for _ in range(rng.integers(1, 7))]

    kinds = list(ASIDE)
    before, inside, after = [], [], []
    for kind in ("menu", "header", *(k for k in kinds if rng.random() < 0.35)):
        before += [((*base, *p), t, a) for p, t, a in side(kind)]
    for kind in (k for k in kinds if rng.random() < 0.2):
        inside.append([((*base, *shell, *p), t, a) for p, t, a in side(kind)])
    for kind in ("footer", *(k for k in kinds if rng.random() < 0.35)):
        after += [((*base, *p), t, a) for p, t, a in side(kind)]
    body = []
    for path, text, link in main:
        tail = pick(tails) if rng.random() < 0.2 else (path[-1] if path and path[-1][0] != "." else "p",)
        tail = plain if neutral and tail == ("p",) else tail
        words = text.split()
        if tail[-1] in ("li", "td", "figcaption", "h2", "h3") and len(words) > 4:  # such blocks are short
            text = " ".join(words[: rng.integers(2, 16)])
        body.append([((*base, *shell, *tail), text, link if rng.random() < 0.9 else 0.5)])
    for group in inside:
        body.insert(int(rng.integers(0, len(body) + 1)), group)
    marked = [(b, 0) for b in before]
    mains = {id(b) for g in body if g not in inside for b in g}
    for g in body:
        marked += [(b, int(id(b) in mains)) for b in g]
    marked += [(b, 0) for b in after]
    return [b for b, _ in marked], [m for _, m in marked]


def shortened(blocks: list[tuple[tuple[str, ...], str, float]], rng: np.random.Generator) -> list[tuple[tuple[str, ...], str, float]]:
    """The blocks with a third of them cut to a word or two: a block's length says little of its kind."""
    return [(p, " ".join(t.split()[: rng.integers(1, 3)]), a) if rng.random() < 0.33 else (p, t, a) for p, t, a in blocks]


def _words(text: str) -> np.ndarray:
    global _kept
    words = text.split()
    try:
        return np.fromiter(map(_kept.__getitem__, words), dtype=np.int64, count=len(words))
    except KeyError:
        if len(_kept) > KEPT:
            _kept = {}
        for w in words:
            if w not in _kept:
                _kept[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
        return np.fromiter(map(_kept.__getitem__, words), dtype=np.int64, count=len(words))


_places: dict[tuple[str, ...], np.ndarray] = {}


def _path(path: tuple[str, ...]) -> np.ndarray:
    found = _places.get(path)
    if found is None:
        if len(_places) > KEPT // 10:
            _places.clear()
        # an element counts once, so that depth alone doesn't outweigh its words; the innermost tag counts as such too
        last = next((t for t in reversed(path) if t[0] != "."), "")
        found = _places[path] = np.array(sorted({zlib.crc32(t.encode()) % PATHS for t in (*path, "^" + last)}), dtype=np.int64)
    return found


def encoded(pages: list[list[tuple[tuple[str, ...], str, float]]]):
    """Flat indices of the path elements and words of all blocks, and numbers of each block."""
    paths, words, numbers = [], [], []
    for blocks in pages:
        for i, (path, text, link) in enumerate(blocks):
            paths.append(_path(path))
            w = _words(text)
            words.append(w)
            marks = sum(map(text.count, ".,;:!?"))
            numbers.append((np.log1p(len(w)) / 4, link, marks / (1 + len(w)), i / len(blocks), float(text[-1] in ".!?"), 1.0))
    return paths, words, np.array(numbers, dtype=np.float32).reshape(-1, 6)


def _pool(table: np.ndarray, lists: list[np.ndarray], mean: bool) -> np.ndarray:
    sizes = np.array([len(x) for x in lists])
    flat = table[np.concatenate(lists)] if sizes.sum() else np.zeros((0, table.shape[1]), np.float32)
    out = np.zeros((len(lists), table.shape[1]), np.float32)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(flat, (np.cumsum(sizes) - sizes)[full], axis=0)
    return out / np.maximum(1, sizes)[:, None] if mean else out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """LSTMs over a page's blocks from both ends and a logistic output for each block."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        D = EMBED_P + EMBED_W + 6
        self.p = {"P": rng.normal(size=(PATHS, EMBED_P)).astype(np.float32) * 0.3, "W": rng.normal(size=(WORDS, EMBED_W)).astype(np.float32) * 0.1, "o": g(2 * HIDDEN + D, 1)[:, 0], "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"X{d}": g(D, 4 * HIDDEN), f"H{d}": g(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}

    def _inputs(self, pages):
        paths, words, numbers = encoded(pages)
        x = np.concatenate([_pool(self.p["P"], paths, False), _pool(self.p["W"], words, True), numbers], axis=1)
        sizes = np.array([len(b) for b in pages])
        T = max(1, sizes.max(initial=1))
        mask = np.arange(T)[:, None] < sizes
        grid = np.zeros((T, len(pages), x.shape[1]), np.float32)
        t, b = np.nonzero(mask.T)[::-1]
        grid[t, b] = x
        return grid, mask, (t, b), paths, words

    def _run(self, x, mask, d, tape=None):
        p, H = self.p, HIDDEN
        T, B, _ = x.shape
        a = x @ p[f"X{d}"] + p[f"b{d}"]
        h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
        out = np.zeros((T, B, H), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            s = a[t] + h @ p[f"H{d}"]
            ifo = _sigmoid(s[:, : 3 * H])
            i, f, o = ifo[:, :H], ifo[:, H : 2 * H], ifo[:, 2 * H :]
            u = np.tanh(s[:, 3 * H :])
            c2 = f * c + i * u
            th = np.tanh(c2)
            m = mask[t][:, None]
            if tape is not None:
                tape.append((t, h, c, i, f, o, u, th, m))
            h, c = np.where(m, o * th, h), np.where(m, c2, c)
            out[t] = h
        return out

    def label(self, pages) -> list[np.ndarray]:
        """Whether each block of each page belongs to the article."""
        if not pages:
            return []
        x, mask, (t, b), _, _ = self._inputs(pages)
        z = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b"), x], axis=2) @ self.p["o"] + self.p["c"]
        flat = (z > 0)[t, b]
        return np.split(flat, np.cumsum([len(p) for p in pages])[:-1])

    def gradients(self, pages, y):
        """Mean logistic loss over blocks and its gradients."""
        p, H = self.p, HIDDEN
        x, mask, (t_at, b_at), paths, words = self._inputs(pages)
        tapes = {d: [] for d in "fb"}
        hs = [self._run(x, mask, d, tapes[d]) for d in "fb"]
        full = np.concatenate([*hs, x], axis=2)
        q = _sigmoid(full @ p["o"] + p["c"])
        target = np.zeros_like(q)
        target[t_at, b_at] = y
        n = len(y)
        loss = -np.mean(np.log(np.where(y, q[t_at, b_at], 1 - q[t_at, b_at]) + 1e-9))
        dz = (q - target) * mask / n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["c"] = np.einsum("tbd,tb->d", full, dz), np.array([dz.sum()], np.float32)
        dfull = dz[:, :, None] * p["o"]
        dx = dfull[:, :, 2 * H :].copy()
        for k, d in enumerate("fb"):
            dh = np.zeros((x.shape[1], H), np.float32)
            dc = np.zeros_like(dh)
            ds_all = np.zeros((*mask.shape, 4 * H), np.float32)
            for t, h, c, i, f, o, u, th, m in reversed(tapes[d]):
                whole = dh + dfull[t, :, k * H : (k + 1) * H]
                dh_in = whole * m
                dc_in = dc * m + dh_in * o * (1 - th * th)
                ds = np.concatenate([dc_in * u * i * (1 - i), dc_in * c * f * (1 - f), dh_in * th * o * (1 - o), dc_in * i * (1 - u * u)], axis=1)
                g[f"H{d}"] += h.T @ ds
                dh = whole * ~m + ds @ p[f"H{d}"].T
                dc = dc * ~m + dc_in * f
                ds_all[t] = ds
            flat = ds_all.reshape(-1, 4 * H)
            g[f"X{d}"] = x.reshape(-1, x.shape[2]).T @ flat
            g[f"b{d}"] = flat.sum(axis=0)
            dx += ds_all @ p[f"X{d}"].T
        each = dx[t_at, b_at]
        np.add.at(g["P"], np.concatenate(paths), np.repeat(each[:, :EMBED_P], [len(a) for a in paths], axis=0))
        sizes = np.array([len(w) for w in words])
        np.add.at(g["W"], np.concatenate(words), np.repeat(each[:, EMBED_P : EMBED_P + EMBED_W] / np.maximum(1, sizes)[:, None], sizes, axis=0))
        return loss, g

    def fit(self, pages, marks, steps: int = 500, batch: int = 20, rate: float = 0.02, seed: int = 13):
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(pages), batch)
            _, g = self.gradients([pages[i] for i in pick], np.concatenate([marks[i] for i in pick]))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                move = rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
                self.p[k] = (self.p[k] - move).astype(np.float32)
            self.p["W"] *= 0.98  # a word counts for little unless it keeps doing so: most are in either kind of block
        return self


#: Pages of ours for the fit where a table has none that can teach.
SPARE = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A title</h1><p>Some words of an article, and more.</p></article><footer>Imprint</footer></body></html>"


def taught_blocks(page: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """What the fit reads of a page: BLOCKS blocks in a row from a hashed place, with bounded texts and paths."""
    blocks = leaf_blocks(page)
    at = zlib.crc32((page or "").encode("utf-8", "surrogatepass")) % max(1, len(blocks) - BLOCKS + 1)
    return [(path[-PATH_TOKENS:], text[:BLOCK_CHARS], link) for path, text, link in blocks[at : at + BLOCKS]]


def train(pages: DataFrame) -> BlockLabeller:
    """Fits the labeller on at most SAMPLE pages, by what their own markup says.

    No page comes labelled, so blocks whose tag path names an article or a
    surrounding (`teacher`) teach. Tasks cut the pages up; the driver gets at
    most BLOCKS blocks of each, of bounded size. Each page is also re-dressed: the same
    blocks under other markup, among menus, notices, forms, comments and the
    like, so that the labeller doesn't hang on one site's template.
    """
    some = pages.where(F.col("html").isNotNull()).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)

    def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in in_batches(batches, 64):
            yield pd.DataFrame({"page_id": pdf["page_id"], "x": [json.dumps(taught_blocks(h)) for h in pdf["html"]]})

    # one row for each of SAMPLE ids
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").join(F.broadcast(some), "page_id").mapInPandas(blocks_of, "page_id long, x string")
    got = made.groupBy("page_id").agg(F.min("x").alias("x")).toPandas()["x"].tolist()
    rng = np.random.default_rng(17)
    taught = []
    for page in [*sorted(set(got)), json.dumps(taught_blocks(SPARE))]:
        blocks = [(tuple(path), text, link) for path, text, link in json.loads(page)]
        marks = [teacher(path) for path, _, _ in blocks]
        if blocks and 1 in marks and 0 in marks and None not in marks:
            taught.append((blocks, marks))
    others = [b[1] for blocks, marks in taught for b, m in zip(blocks, marks) if len(b[1]) < 400]
    lots = [*taught, *((shortened(b, rng), m) for b, m in taught)]
    for b, m in taught:
        for _ in range(DRESSED):
            other, marks = dressed(b, m, others, rng)
            lots.append((shortened(other, rng) if rng.random() < 0.3 else other, marks))
    return BlockLabeller().fit([b for b, _ in lots], [np.array(m, dtype=bool) for _, m in lots])


#: Pages that are labelled together, and blocks, counting each page as long as the longest; a longer page runs alone.
GROUP_PAGES, GROUP_BLOCKS = 128, 100_000


def grouped(sizes: list[int]) -> Iterator[list[int]]:
    """Indices of the pages that have blocks, shortest first, in groups within GROUP_PAGES and GROUP_BLOCKS."""
    some = []
    for i in sorted((i for i, n in enumerate(sizes) if n), key=lambda i: sizes[i]):
        if some and (len(some) == GROUP_PAGES or (len(some) + 1) * sizes[i] > GROUP_BLOCKS):
            yield some
            some = []
        some.append(i)
    if some:
        yield some


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page, from its whole html.

    Blocks that the labeller counts to the article, in page order, joined by
    one newline; white space inside a block is one space and character
    references are decoded. A null or empty html, or one without article
    blocks, gives the empty string. Repeated rows and null ids are kept;
    other columns are ignored.

    Returns page_id, url, text, n_chars.
    """
    sent = pages.sparkSession.sparkContext.broadcast(train(pages))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for pdf in in_batches(batches, 512):
            blocks = [leaf_blocks(h) for h in pdf["html"]]
            texts = [""] * len(blocks)
            for some in grouped([len(b) for b in blocks]):
                for i, keep in zip(some, model.label([blocks[i] for i in some])):
                    texts[i] = "\n".join(b[1] for b, k in zip(blocks[i], keep) if k)
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64").to_numpy(), "url": pdf["url"].to_numpy(), "text": texts})

    made = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(work, "page_id long, url string, text string")
    return made.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
