"""The examples of RFC 3986, section 5.4, and links of pages."""

from pyspark.sql import functions as F

from decoyscope.functions import html, reference
from decoyscope.operators import hamming, match

BASE = "http://a/b/c/d;p?q"
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
    "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
    "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
    "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x",
    "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_examples_of_the_rfc(spark):
    df = spark.createDataFrame(list(EXAMPLES.items()), "ref string, want string").select("ref", "want", reference.resolve(F.lit(BASE), F.col("ref")).alias("got"))
    assert [(r.ref, r.got) for r in df.collect() if r.got != r.want] == []
    more = [("http://h", "x", "http://h/x"), ("http://h", "?q", "http://h?q"), ("http://h/a/", "..", "http://h/"), ("mailto:a@b", "http://x/../y", "http://x/y"), ("http://h//a/b", "../c", "http://h//c"), ("http://h/a", None, None), (None, "x", None)]
    df = spark.createDataFrame(more, "base string, ref string, want string").select("base", "want", reference.resolve(F.col("base"), F.col("ref")).alias("got"))
    assert [(r.base, r.got) for r in df.collect() if r.got != r.want] == []


def test_links_are_counted_by_what_they_name(spark):
    page = "<base href='https://cdn.org/x/'><a href='y'>1</a><a href='//a.org/z'>2</a><a href='https://a.org'>3</a><a href='mailto:me@a.org'>4</a><a href='#s'>5</a><form action='../send'><input type=password></form><form><input></form><link rel='icon' href='i.png'>"
    plain = "<a href='y/../z'>1</a><a href='?q'>2</a><a href='https://b.org/'>3</a><form action='//b.org/s'></form>"
    rows = spark.createDataFrame([(1, page, "https://a.org/p/q"), (2, plain, "https://a.org/p/q"), (3, None, None)], "i int, html string, url string")
    got = {r.i: r for r in rows.select("i", html.resolved_links(F.col("html"), F.col("url")).alias("l"), html.resolved_actions(F.col("html"), F.col("url")).alias("a"), html.resolved_favicon(F.col("html"), F.col("url")).alias("f")).collect()}
    assert got[1].l.urls == ["https://cdn.org/x/y", "https://a.org/z", "https://a.org", "mailto:me@a.org", "https://cdn.org/x/#s"] and (got[1].l.internal, got[1].l.external) == (2, 2)
    assert got[1].a == ["https://cdn.org/send", "https://a.org/p/q"] and got[1].f == "https://cdn.org/x/i.png"
    assert got[2].l.urls == ["https://a.org/p/z", "https://a.org/p/q?q", "https://b.org/"] and (got[2].l.internal, got[2].l.external) == (2, 1)
    assert got[2].a == ["https://b.org/s"] and got[2].f == "https://a.org/favicon.ico"


def test_nearest_hashes(spark):
    import random

    rng = random.Random(5)
    signed = lambda v: v - 2**64 if v >> 63 else v
    logos = [(g, rng.getrandbits(64)) for g in (1, 2, 3) for _ in range(60)] + [(None, 5), (1, None)]
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    pages = [(i, g, flip(v, rng.randrange(0, 30))) for i, (g, v) in enumerate(x for x in logos if None not in x)] + [(900, 9, 1), (901, None, 1), (902, 1, None), (903, 2, 2**64 - 1), (904, 2, 2**64 - 1)]
    number = lambda v: None if v is None else signed(v)
    p = spark.createDataFrame([(i, g, number(v)) for i, g, v in pages], "page_id long, cse_id long, phash long")
    known = spark.createDataFrame([(g, number(v)) for g, v in logos], "cse_id long, phash long")
    got = {r.page_id: (r.distance, r.detected) for r in hamming.logo_match(p, known).collect()}
    want = {}
    for i, g, v in pages:
        near = [bin(v ^ w).count("1") for h, w in logos if h == g and g is not None and v is not None and w is not None]
        if near:
            want[i] = (min(near), min(near) <= 8)
    assert got == want and len({d for d, _ in want.values()}) > 15
    plain = {r.page_id: r.distance for r in match.logo_match(p.dropna(), known.dropna()).collect()}
    assert plain == {i: d for i, (d, _) in got.items()}
    met = hamming.candidates(p.dropna(), known.dropna(), "cse_id", "phash", 0).distinct().count()
    assert met < 0.15 * p.dropna().join(known.dropna(), "cse_id").count()
