"""The Merkle manifest against a plain tree."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from decoyscope.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, digest string, chunk long, at long"
CLASH = ("t", 1, "d", 2, 3)


def digest(*hexes):
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def plain_levels(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def siblings(levels, index):
    found = []
    for level in levels[:-1]:
        first = index - index % 3
        found += [(len(level), index % 3, [d for i, d in enumerate(level[first : first + 3], first) if i != index])]
        index //= 3
    return found


def expected(rows):
    trees = defaultdict(list)
    for r in rows:
        text = None if r[1] is None else r[1].replace("\n", "")
        even = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0
        trees[r[3]].append((r[0], plain_leaf(r, r[1]), plain_leaf(r, text if even else r[1])))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[s] = plain_levels([x[1] for x in trees[s]])
    top = plain_levels([built[s][-1][0] for s in names])
    want = Counter()
    for k, s in enumerate(names):
        for i, (doc_id, leaf, tampered) in enumerate(trees[s]):
            way = siblings(built[s], i) + siblings(top, k)
            node = tampered
            for _, place, others in way:
                node = digest(*others[:place], node, *others[place:])
            proof = digest(*[d for _, _, others in way for d in others])
            want[doc_id, leaf, built[s][-1][0], top[-1][0], proof, node, node == top[-1][0]] += 1
    return want, {s: built[s] for s in names}


def corpus(n=0):
    rows = [(i, f"text {i}" + "\n" * (i % 3), "en" if i % 4 else None, f"s{i % 5}", i) for i in range(40)]
    rows += [(i + 1000, f"hot {i % 7}\nx", "fr", "hot", 5) for i in range(n)]
    rows += [rows[3], rows[3], (None, None, None, None, None), (None, "no\nid", "de", None, 1), (7, "", "", "", 0), (8, "ñ😀\n", "é", "ß", 3), (9, "long\n" * 30_000, None, "one", None)]
    return [(*r, *CLASH) for r in rows]


@pytest.mark.parametrize("n", [0, 800])
def test_every_row(spark, n):
    rows = corpus(n)
    got = manifest.verified(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want, built = expected(rows)
    assert Counter(tuple(r) for r in got) == want
    assert {r.verified for r in got} == {True, False}
    if n:  # one log for each source: gapless, and in the order in which a plain builder completes nodes
        log = defaultdict(dict)
        for r in manifest.Manifest(spark.createDataFrame(rows, SCHEMA)).log().collect():
            assert r.position not in log[r.tree]
            log[r.tree][r.position] = bytes(r.digest).hex()
        for source, levels in built.items():
            nodes = log["" if source is None else "=" + source]
            assert sorted(nodes) == list(range(sum(map(len, levels))))
            done = manifest.append_log([bytes.fromhex(d) for d in levels[0]], len(levels) - 1)
            assert [nodes[i] for i in range(len(nodes))] == [d.hex() for d in done]


def test_empty_table(spark):
    assert manifest.verified(spark.createDataFrame([], SCHEMA)).collect() == []


def test_closed_form():
    for n in [*range(1, 60), 81, 82, 242, 243, 244, 731]:
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        levels = plain_levels([d.hex() for d in leaves])
        log = manifest.append_log(leaves, manifest.height(n))
        assert len(log) == sum(map(len, levels)) and manifest.height(n) == len(levels) - 1
        for depth, level in enumerate(levels):
            assert [log[manifest.position(depth, i, n)].hex() for i in range(len(level))] == level
        for i in {0, n // 2, n - 1}:
            way = manifest.path(log, i, n, manifest.height(n))
            assert manifest.fold(leaves[i], way).hex() == levels[-1][0]
            if n > 1:
                assert manifest.fold(leaves[i - 1], way).hex() != levels[-1][0]
