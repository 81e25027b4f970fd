"""Golden cases of scoring and of single functions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from decoyscope.functions import host as H
from decoyscope.functions import html as X
from decoyscope.functions import text as T
from decoyscope.functions import url as U
from decoyscope.operators import dedup, enrich, fuse, match, route, rules, search, variants

def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def scored(spark, **record):
    df = spark.range(1).select(*[(F.array(*[F.lit(i) for i in v]) if isinstance(v, list) else F.create_map(*[F.lit(i) for kv in v.items() for i in kv]) if isinstance(v, dict) else F.lit(v)).alias(k) for k, v in record.items()])
    return rules.score(df, F.to_timestamp(F.lit("2024-02-01"))).first()


def test_government_impersonation(spark):
    r = scored(spark, fqdn="dc.crsorgi.gov.in.web.index.dc-verify.info", registrable="dc-verify.info", mx=["dc.crsorgi.gov.in.web.index.dc-verify.info"], ttls={"A": 30}, whois_error="no output", country="DE")
    assert (r.score, r.verdict) == (99, "phishing")
    assert r.categories["impersonation"] == 40 and "TLD impersonation: gov.in in subdomain" in r.reasons


def test_typosquat(spark):
    r = scored(spark, fqdn="www.ciaude.ai", registrable="ciaude.ai", seed_registrable="claude.ai", obfuscated_scripts=1, original_host="www.ciaude.ai", url="https://login.other.org/", mx=["mx.a"])
    assert (r.score, r.verdict) == (52, "suspicious")
    assert r.monitor_until == 1706745600 + 90 * 86400


def test_legitimate(spark):
    r = scored(spark, fqdn="www.google.com", registrable="google.com", mx=["mx"])
    assert (r.score, r.verdict, r.reasons) == (0, "benign", [])


def test_parked_and_established(spark):
    signs = dict(fqdn="a.example.com", ns=["ns1.sedoparking.com"], html_size=900, title="Domain for sale", page_text="buy this domain", is_newly_registered=True)
    r = scored(spark, **signs)
    assert (r.verdict, r.score) == ("parked", 40 + 30 + 10 + 8 + 12 + 5) and r.monitor_reason == "parked"
    assert scored(spark, domain_age_days=400, **signs).verdict != "parked"


@pytest.mark.parametrize("c,want", [
    (lambda: H.subdomain_depth(F.lit("a.b.c.d.example.com")), 4),
    (lambda: H.strip_www(H.url_host(F.lit("https://www.example.com/path"))), "example.com"),
    (lambda: H.strip_www(H.url_host(F.lit("https://sub.example.com"))), "sub.example.com"),
    (lambda: H.strip_www(F.lit("www.com")), "www.com"),
    (lambda: H.canonical_host(F.lit(" *.Bücher.Example. ")), "xn--bcher-kva.example"),
    (lambda: H.within_one_edit(F.lit("hdfcbanl"), F.lit("hdfcbank")), True),
    (lambda: U.normalize_url(F.lit("a.com?x=1#y")), "http://a.com/?x=1#y"),
    (lambda: U.normalize_url(F.lit("https://")), None),
    (lambda: X.is_private_ip(F.lit("172.20.1.1")), True),
    (lambda: X.is_private_ip(F.lit("172.32.1.1")), False),
    (lambda: enrich.ipv4(F.lit("1.2.3.4")), 16909060),
    (lambda: enrich.ipv4(F.lit("1.2.3.400")), None),
    (lambda: T.entropy(F.lit("")), 0.0),
    (lambda: T.entropy(F.lit("aab")), 0.9183),
    (lambda: F.array_join(T.csv_list(F.lit("a0, b ,,c")), "|"), "a0|b|c"),
])
def test_columns(spark, c, want):
    assert value(spark, c()) == want


def test_redirects(spark):
    urls = lambda *us: F.array(*[F.lit(u) for u in us])
    r = value(spark, H.redirect_summary(urls("https://phishing.com/", "https://legitimate.com/")))
    assert (r.crosses, r.original, r.final, r.hops) == (True, "phishing.com", "legitimate.com", 1)
    r = value(spark, H.redirect_summary(urls("https://example.com/", "https://www.example.com/")))
    assert (r.crosses, r.hops, r.final) == (False, 0, "example.com")


def test_entropy_and_edits_against_loops(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé1") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.entropy(F.col("w")).alias("e")).collect()
    for r in got:
        n = len(r.w)
        assert r.e == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(r.w).values()), abs=6e-5)

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        cut = lambda s: {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        return a in cut(b) or b in cut(a)

    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(400)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", H.within_one_edit(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r.x == one_edit(r.a, r.b) for r in got)


def test_tokens(spark):
    labels = ["sbi", "my-sbi", "sbi123", "123sbi", "subscriber", "hdfcbanl", "sb", "", "a-1st-b", "login"]
    got = match.token_match(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([("sbi",), ("hdfcbank",), ("login",), ("1st",), ("ab",)], "token string")).collect()
    assert {r.label: r.rule for r in got} == {"sbi": "token:exact", "my-sbi": "token:word", "sbi123": "token:word", "123sbi": "token:word", "hdfcbanl": "token:ld1", "a-1st-b": "token:word"}


def test_registrable(spark):
    hosts = spark.createDataFrame([("a.b.co.in",), ("x.in",), ("co.in",), ("deep.a.b.c.uk",), (None,)], "host string")
    got = H.with_registrable(hosts, spark.createDataFrame([("in",), ("co.in",)], "suffix string")).collect()
    assert {r.host: r.registrable for r in got} == {"a.b.co.in": "b.co.in", "x.in": "x.in", "co.in": "co.in", "deep.a.b.c.uk": "deep.a.b.c.uk", None: None}


def test_record_types(spark):
    rows = [(d, f, v, i) for d in (True, False) for f in (True, False) for v in (True, False) for i in (True, False)]
    got = spark.createDataFrame(rows, "d boolean, f boolean, v boolean, i boolean").select(fuse.record_type(F.col("d"), F.col("f"), F.col("v"), F.col("i")).alias("r")).collect()
    assert {(r.r.record_type, r.r.enrichment_level) for r in got} == {("fully_enriched", 3), ("verdict_only", 2), ("with_features", 2), ("domain_only", 1), ("features_only", 1), ("inactive", 0), ("partial", 0)}


def test_routes(spark):
    values = ['{"ok": tr', "{}", '{"ok": false, "fqdn": "a.b"}', '{"ok": true, "url": "https://a.b/c"}', None, "[1]"]
    got = route.route(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")).orderBy("i").collect()
    assert [(r.route, r.failure_type) for r in got] == [("dead", "json_parse_error"), ("dead", "missing_url"), ("inactive", "connection_failed"), ("crawl", None), ("dead", "json_parse_error"), ("dead", "json_parse_error")]


def test_first_seen_of_one_key(spark):
    rows = [("k", i, t) for i, t in enumerate([0, 5, 10, 12, 20, 21, 40])] + [(None, 9, 3), (None, 10, 4)]
    df = spark.createDataFrame(rows, "key string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.id for r in dedup.first_seen(df, "key", "ts", 10, "id").collect()) == [0, 2, 4, 6, 9]


def test_variant_families(spark):
    got = variants.generate(spark.createDataFrame([("shop", "com")], "label string, tld string"), {"A": (["bitsquatting", "homoglyph", "vowel-swap", "insertion", "subdomain", "replacement"], ["net"], [])}).collect()
    names = {(r.fuzzer, r.fqdn) for r in got}
    assert {("vowel-swap", "shap.com"), ("homoglyph", "sh0p.com"), ("subdomain", "s.hop.com"), ("bitsquatting", "rhop.com")} <= names
    assert all(r.fqdn != "shop.com" for r in got)


def test_vector_search_without_collections(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0])], "id int, embedding array<double>")
    got = search.cosine_top_k(df.where("id <> 5"), F.array(F.lit(1.0), F.lit(0.0)), 2).collect()
    assert [(r.id, r.similarity) for r in got] == [(1, 1.0), (3, 0.7071)]


@pytest.mark.parametrize("body,want", [("sedo\xf1ie", 1), ("a\u017fedo", 1), ("\xe9sedo.", 1), ("sedo_", 0), ("sedos", 0), ("thi\u017f domain is for sale", 1), ("Ma\u212ae an OFFER", 1), ("Make an offe\u0131r", 0)])
def test_parking_rules_take_ascii_words_and_fold_case_as_the_sql_does(spark, body, want):
    import duckdb

    from decoyscope.functions.terms import PARKING_RULE_BRANDS, PARKING_RULE_HINTS

    c = duckdb.connect()
    assert sum(c.execute("SELECT regexp_matches(?, '(?i)' || ?)", [body, p]).fetchall()[0][0] for p in PARKING_RULE_BRANDS + PARKING_RULE_HINTS) == want
    assert value(spark, X.parking_rules(F.lit(None).cast("string"), F.lit(body), F.lit("")))["score"] == want


def test_whole_days_count_parts_of_a_second(spark):
    days = lambda a, b: value(spark, T.days_between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")))
    assert days("2024-03-01", "2024-01-11 00:00:00.000001") == 49
    assert days("2024-03-01", "2024-01-11") == 50
    assert days("2024-03-01", "2024-03-01 00:00:00.5") == -1


def test_rules_stand_once_in_the_plans_of_scores_and_categories(spark):
    from decoyscope.plans import scoring

    for query in (scoring.scored_records, scoring.category_points, scoring.category_columns):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan and len(plan) < 200_000, (query.__name__, len(plan))


def test_categories_and_reasons_of_rules_that_hold_several_times(spark):
    r = scored(spark, ns=["a.Njalla.no", None, "ecatel.x", "plain"], country="US", a=["1"], ptr=["p"])
    assert r.categories == {"dns": 24} and r.score == 24 and r.reasons == ["Suspicious nameserver (njalla)", "Suspicious nameserver (ecatel)"]
    r = scored(spark, asn_org="My OVH offshore", url="https://h/verify/login.php?id=1&token=2", cert_risk_score=50)
    assert r.categories == {"ssl": 10, "behavior": 12 + 8 + 8, "infrastructure": 7 + 25} and r.score == 70
    assert r.reasons == ["Suspicious path pattern: /verify/", "Suspicious file: login.php", "Suspicious URL parameters", "High-risk hosting: ovh", "Bulletproof hosting detected"]


def test_top_words_shuffle_no_words_and_join_rows_of_one_key(spark):
    from decoyscope.operators import rollup

    texts = [(1, "the cat saw cat cats; dog, dog cat-dog x_cat"), (2, None), (3, "cat" + " cat" * 30_000 + " and bee bee ant"), (4, "zoo yak zoo yak")]
    got = lambda rows: sorted((r.k or 0, *r[1:]) for r in rollup.top_words(spark.createDataFrame(rows, "k long, t string"), "k", "t", ["the", "and"], 3).collect())
    alone = [(1, "cat", 3, 1), (1, "dog", 3, 2), (1, "saw", 1, 3), (3, "ant", 1, 3), (3, "bee", 2, 2), (3, "cat", 30_001, 1), (4, "yak", 2, 2), (4, "zoo", 2, 1)]
    assert got(texts) == alone
    both = got(texts + [(4, "yak yak"), (5, "one"), (None, "odd even"), (None, "even")])
    assert [r for r in both if r[0] == 0] == [(0, "even", 2, 1), (0, "odd", 1, 2)]
    assert [r for r in both if r[0] in (1, 3)] == alone[:6] and [r for r in both if r[0] == 4] == [(4, "yak", 4, 1), (4, "zoo", 2, 2)]
    plan = rollup.top_words(spark.createDataFrame(texts, "k long, t string"), "k", "t", [])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
