"""Queries that score records: rules, certificates, registrations, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.functions import risk
from decoyscope.functions.host import redirect_penalty, redirect_summary
from decoyscope.functions.terms import COUNTRY_POINTS
from decoyscope.operators import fuse, rules
from decoyscope.plans.registry import query, table

AS_OF = "2024-02-01 00:00:00"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with signals from customer rows: k is the customer's number."""
    k = F.col("c_custkey")
    m = lambda n: k % n
    strings = lambda *xs: F.array(*[F.lit(x) for x in xs])
    none = F.array().cast("array<string>")
    countries = F.array(*[F.lit(c) for c in ("NG", "RU", "IN", "US", "DE", "ZZ")])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number is few bytes and its record much work, so the files' own splits are too few
    return table(spark, sf_dir, "customer").select("c_custkey").repartition(tasks, "c_custkey").select(
        k.alias("k"),
        F.when(m(4) == 0, "www.shop.example.com").when(m(4) == 1, "a.gov.in.b.c.scam.xyz").when(m(4) == 2, "pay.in.deal.top").otherwise("xn--a.example.net").alias("fqdn"),
        F.concat(F.lit("reg"), m(3).cast("string"), F.lit(".com")).alias("registrable"),
        F.when(m(3) > 0, "reg1.com").alias("seed_registrable"), (m(11) == 0).alias("is_original_seed"),
        F.concat(F.lit("https://h.example.com"), F.when(m(5) == 0, "/verify/login.php?id=1&token=2&key=3").when(m(5) == 1, "/a.pdf.exe").when(m(5) == 2, "/ab12c").when(m(5) == 3, "/signin/account/ssl/").otherwise("/")).alias("url"),
        F.when(m(6) == 0, "start.other.org").otherwise("h.example.com").alias("original_host"),
        (m(140)).cast("int").alias("url_length"), (m(50) / 10).alias("url_entropy"), (m(2) == 0).alias("has_repeated_digits"), (m(13) == 0).alias("is_idn"), (m(17) == 0).alias("mixed_script"),
        (m(10) == 0).alias("is_very_new"), (m(10) < 3).alias("is_newly_registered"), (m(90)).cast("long").alias("days_until_expiry"), (m(500)).cast("long").alias("domain_age_days"),
        F.when(m(4) == 0, "NameCheap Inc").otherwise("Good Registrar").alias("registrar"), F.when(m(9) == 0, "No output received").alias("whois_error"),
        (m(3)).cast("int").alias("password_fields"), (m(2)).cast("int").alias("email_fields"), (m(4)).cast("int").alias("form_count"), (m(7) == 0).cast("int").alias("suspicious_form_count"),
        (m(8) == 0).cast("int").alias("forms_to_ip"), (m(12) == 0).cast("int").alias("forms_to_suspicious_tld"), (m(14) == 0).cast("int").alias("forms_to_private_ip"),
        (m(10)).cast("int").alias("keyword_count"), (m(6) == 0).cast("int").alias("obfuscated_scripts"),
        (m(15) == 0).alias("is_self_signed"), (m(16) == 0).alias("has_domain_mismatch"), (m(18) == 0).alias("cert_is_very_new"), (m(18) < 4).alias("is_newly_issued"), (m(60)).cast("int").alias("cert_risk_score"),
        (m(40)).cast("long").alias("cert_age_days"), (m(200)).cast("long").alias("cert_validity_days"), F.when(m(2) == 0, "Let's Encrypt R3").otherwise("DigiCert").alias("cert_issuer"),
        F.when(m(3) == 0, none).when(m(3) == 1, strings("1.1.1.1")).otherwise(strings(*"abcdef")).alias("a"),
        F.when(m(5) == 0, F.array(F.lit("www.shop.example.com."))).when(m(5) == 1, none).otherwise(strings("mx.a.org")).alias("mx"),
        F.when(m(7) == 0, strings("ns1.njalla.no", "x.afraid.org")).when(m(7) == 1, strings("a.sedoparking.com")).otherwise(none).alias("ns"),
        F.when(m(2) == 0, strings("p")).otherwise(none).alias("ptr"),
        F.create_map(F.lit("A"), m(120).cast("int")).alias("ttls"), F.element_at(countries, (m(6) + 1).cast("int")).alias("country"),
        F.when(m(8) == 0, "OVH Offshore Ltd").when(m(8) == 1, "City Broadband").otherwise("Plain Net").alias("asn_org"),
        F.when(m(9) == 1, "Domain for sale").otherwise("Shop").alias("title"), F.when(m(9) == 1, "buy this domain now, make an offer").otherwise("welcome").alias("page_text"),
        (m(9)).cast("int").alias("external_links"), (m(3) * 3000).cast("int").alias("html_size"), F.when(m(19) == 0, "bodis/1").otherwise("nginx").alias("server"),
    )


_c = lambda test, n: f"CASE WHEN {test} THEN {n} ELSE 0 END"
_COUNTRY = "['NG','RU','IN','US','DE','ZZ'][k % 6 + 1]"
_RISK = "CASE " + " ".join(f"WHEN {_COUNTRY} = '{c}' THEN {COUNTRY_POINTS[c]}" for c in ("NG", "RU", "IN", "US", "DE")) + " ELSE 0 END"
#: Group -> SQL of its points, written from the records' rule of making.
SQL_POINTS = {
    "registration": f"CASE WHEN k % 10 = 0 THEN 25 WHEN k % 10 < 3 THEN 12 ELSE 0 END + {_c('k % 90 < 30', 5)}",
    "url": f"{_c('k % 4 = 3', 15)} + {_c('k % 13 = 0', 10)} + {_c('k % 17 = 0', 10)} + CASE WHEN k % 140 >= 130 THEN 10 WHEN k % 140 >= 80 THEN 5 ELSE 0 END + CASE WHEN k % 50 > 45 THEN 15 WHEN k % 50 > 40 THEN 10 ELSE 0 END"
    f" + CASE k % 4 WHEN 1 THEN 12 ELSE 0 END + {_c('k % 2 = 0', 6)} + {_c('k % 4 IN (1, 2)', 6)}",
    "impersonation": "CASE k % 4 WHEN 1 THEN 40 WHEN 2 THEN 30 ELSE 0 END",
    "content": f"{_c('k % 3 > 0 AND k % 2 > 0', 22)} + {_c('k % 7 = 0', 18)} + {_c('k % 8 = 0', 10)} + {_c('k % 12 = 0', 10)} + {_c('k % 14 = 0', 10)} + CASE WHEN k % 10 >= 8 THEN 18 WHEN k % 10 >= 3 THEN 12 WHEN k % 10 >= 1 THEN 8 ELSE 0 END + {_c('k % 6 = 0', 15)}",
    "certificate": f"{_c('k % 15 = 0', 40)} + {_c('k % 16 = 0', 25)} + CASE WHEN k % 18 = 0 THEN 12 WHEN k % 18 < 4 THEN 8 ELSE 0 END + least(20, (k % 60) * 2 // 10)",
    "network": f"{_c('k % 6 = 0', 12)} + {_c('k % 5 = 0 AND k % 4 = 0', 10)} + {_c('k % 120 < 60', 8)} + {_c('k % 9 = 0', 5)} + {_c('k % 7 = 0', 12)} + {_c(f'k % 4 = 1 AND {_COUNTRY} NOT IN (chr(73) || chr(78))', 15)} + {_c('k % 3 = 2 AND k % 11 <> 0', 25)}",
    "temporal": f"CASE WHEN abs(k % 500 - k % 40) <= 1 THEN 35 WHEN abs(k % 500 - k % 40) <= 7 THEN 20 WHEN abs(k % 500 - k % 40) <= 30 THEN 10 ELSE 0 END + {_c('k % 500 > 0 AND k % 500 < 7 AND k % 2 = 0', 15)} + {_c('k % 200 > 0 AND k % 200 < 90', 8)}",
    "behaviour": "CASE k % 5 WHEN 0 THEN 12 + 8 + 15 WHEN 1 THEN 20 WHEN 2 THEN 10 WHEN 3 THEN 15 + 12 ELSE 0 END",
    "infrastructure": f"{_c('k % 8 = 0', 7)} + {_RISK} + {_c('k % 7 = 0', 8)} + {_c('k % 8 = 0', 25)} + {_c('k % 8 = 1', 15)} + {_c('k % 4 = 0', 5)} + {_c('k % 3 > 0 AND k % 2 = 1', 8)} + {_c('k % 3 = 2', 10)}",
}
SQL_PARKING = (
    f"{_c('k % 7 = 1', 40)} + {_c('k % 9 = 1', 30)} + {_c('k % 5 = 1', 10)} + {_c('k % 5 = 1 AND k % 3 = 1', 10)} + {_c('k % 4 = 0', 8)} + {_c('k % 3 = 1', 12)}"
    f" + {_c('k % 9 > 5 AND k % 4 = 0', 15)} + {_c('k % 10 < 3', 5)} + {_c('k % 90 < 60', 8)} + {_c('k % 19 = 0', 30)}"
)
_POS = {"temporal", "behaviour", "infrastructure"}
SQL_SCORED = f"""
p AS (SELECT c_custkey AS k FROM customer),
g AS (SELECT k, {", ".join(f"{v} AS {n}" for n, v in SQL_POINTS.items())}, {SQL_PARKING} AS sure FROM p),
t AS (SELECT *, {" + ".join(f"greatest({n}, 0)" if n in _POS else n for n in SQL_POINTS)} AS total FROM g),
v AS (SELECT *, CASE WHEN sure >= 50 AND k % 500 <= 365 THEN 'parked' WHEN total >= 70 THEN 'phishing' WHEN total >= 40 THEN 'suspicious' ELSE 'benign' END AS verdict FROM t),
s AS (
  SELECT k, verdict, CAST(CASE verdict WHEN 'parked' THEN sure ELSE total END AS INTEGER) AS score,
    round(CASE verdict WHEN 'parked' THEN least(0.95, 0.5 + CAST(sure AS DOUBLE) / 200) WHEN 'phishing' THEN least(0.99, 0.9 + CAST(total - 70 AS DOUBLE) / 100) WHEN 'suspicious' THEN 0.65 + CAST(total - 40 AS DOUBLE) / 200 ELSE 0.5 END, 3) AS confidence,
    CASE WHEN verdict = 'suspicious' OR (verdict = 'parked' AND k % 10 < 3) THEN CAST(1706745600 + 90 * 86400 AS BIGINT) END AS monitor_until FROM v)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score(records(spark, sf_dir), F.to_timestamp(F.lit(AS_OF)))


@query(f"WITH {SQL_SCORED} SELECT k, verdict, score, confidence, monitor_until FROM s")
def scored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, score and confidence of every record under all rules."""
    return _scored(spark, sf_dir).select("k", "verdict", "score", "confidence", "monitor_until")


_SQL_CATEGORIES = f"""
c AS (
  SELECT k, 'whois' AS category, {SQL_POINTS['registration']} AS points FROM v WHERE verdict <> 'parked'
  UNION ALL SELECT k, 'impersonation', impersonation FROM v WHERE verdict <> 'parked'
  UNION ALL SELECT k, 'ssl', certificate FROM v WHERE verdict <> 'parked'
  UNION ALL SELECT k, 'temporal', temporal FROM v WHERE verdict <> 'parked'
  UNION ALL SELECT k, 'behavior', behaviour FROM v WHERE verdict <> 'parked'
  UNION ALL SELECT k, 'parked', sure FROM v WHERE verdict = 'parked')"""
_CATEGORIES = ["whois", "impersonation", "ssl", "temporal", "behavior", "parked"]


@query(f"WITH {SQL_SCORED}, {_SQL_CATEGORIES} SELECT category, count(*) AS records, CAST(sum(points) AS BIGINT) AS points FROM c WHERE points > 0 GROUP BY category")
def category_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by rule category, for categories that one group fills."""
    rows = rules.category_sums(_scored(spark, sf_dir), "k").where(F.col("category").isin(_CATEGORIES))
    return rows.groupBy("category").agg(F.count("*").alias("records"), F.sum("points").alias("points"))


@query(f"""
WITH {SQL_SCORED}, {_SQL_CATEGORIES}
SELECT k, {", ".join(f"CAST(sum(points) FILTER (category = '{x}') AS BIGINT) AS cat_{x}" for x in ("whois", "impersonation", "ssl", "temporal", "behavior", "parked"))}
FROM c WHERE points > 0 GROUP BY k""")
def category_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of each record with a column per category."""
    wide = rules.category_columns(_scored(spark, sf_dir), "k", _CATEGORIES)
    return wide.where(F.coalesce(*[f"cat_{x}" for x in _CATEGORIES]).isNotNull())


@query(f"""
WITH {SQL_SCORED},
m AS (SELECT *, k % 3 AS hops, k % 3 * 10 + CASE WHEN k % 3 > 0 THEN 15 ELSE 0 END AS penalty FROM s)
SELECT k, CASE WHEN monitor_until IS NOT NULL THEN 'rules:monitor' ELSE 'rules:' || verdict END AS stage,
  CASE WHEN hops > 0 THEN CAST(penalty AS INTEGER) END AS penalty, CASE WHEN hops > 0 THEN CAST(greatest(score - penalty, 0) // 2 AS BIGINT) END AS original_score,
  CASE WHEN hops > 0 THEN CAST(greatest(score - penalty, 0) - greatest(score - penalty, 0) // 2 AS BIGINT) END AS final_score,
  CASE hops WHEN 1 THEN 'a.org' WHEN 2 THEN 'b.org' END AS final_domain FROM (SELECT k, verdict, score, monitor_until, hops, CASE hops WHEN 1 THEN 10 WHEN 2 THEN 35 ELSE 0 END AS penalty FROM m) q""")
def merged_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged records with the split of the score over a redirect."""
    k = F.col("k") % 3
    lit = F.lit
    chain = F.when(k == 0, F.array(lit("https://a.org/"), lit("https://www.a.org/"))).when(k == 1, F.array(lit("https://s.org/"), lit("https://a.org/x"))).otherwise(F.array(lit("https://a.org/"), lit("https://bit.ly/1"), lit("https://b.org/")))
    df = _scored(spark, sf_dir).withColumn("chain", chain).withColumn("sum", redirect_summary(F.col("chain")))
    df = rules.merged(df, F.col("chain"), F.col("sum"), redirect_penalty(F.col("chain"), F.col("sum.hops")))
    x = "cross_domain."
    return df.select("k", "stage", x + "penalty", x + "original_score", x + "final_score", F.col(x + "final_site.domain").alias("final_domain"))


@query("""
WITH s AS (
  SELECT s_suppkey AS k, TIMESTAMP '2024-02-01' - to_days(CAST(s_suppkey % 45 AS INTEGER)) AS nb, TIMESTAMP '2024-02-01' + to_days(CAST(s_suppkey % 80 AS INTEGER)) AS na FROM supplier),
f AS (
  SELECT k, k % 45 AS age, k % 5 = 0 AS own, k % 3 = 0 AS other, k % 4 = 0 AS trusted, k % 45 + k % 80 AS validity, k % 7 = 0 AS err FROM s)
SELECT k, own AS is_self_signed, other AS has_domain_mismatch, age AS cert_age_days, validity AS cert_validity_days,
  CAST(CASE WHEN err THEN 20 ELSE CASE WHEN own THEN 30 ELSE 0 END + CASE WHEN other THEN 25 ELSE 0 END + CASE WHEN age < 7 THEN 15 WHEN age < 30 THEN 10 ELSE 0 END + CASE WHEN NOT trusted AND NOT own THEN 10 ELSE 0 END END AS INTEGER) AS cert_risk_score,
  age AS domain_age_days, k % 80 AS days_until_expiry, age < 30 AS is_newly_registered, k % 80 < 30 AS expires_soon FROM f""")
def certificate_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificate and registration risk of records made of suppliers."""
    k = F.col("s_suppkey")
    at = F.to_timestamp(F.lit(AS_OF))
    day = lambda n: F.timestamp_seconds(F.unix_timestamp(at) + n * 86400)
    before, after = day(-(k % 45)), day(k % 80)
    issuer = F.when(k % 4 == 0, "Amazon RSA").otherwise("Own CA")
    subject = F.when(k % 5 == 0, issuer).otherwise("h.example.com")
    sans = F.when(k % 3 == 0, F.array(F.lit("x.example.com"))).otherwise(F.array(F.lit("site.example.com")))
    df = table(spark, sf_dir, "supplier").select(
        k.alias("k"), risk.tls_risk(F.lit("site.example.com"), issuer, subject, sans, before, after, k % 7 == 0, at).alias("t"), risk.whois_age(before, after, at).alias("w"))
    return df.select("k", "t.is_self_signed", "t.has_domain_mismatch", "t.cert_age_days", "t.cert_validity_days", "t.cert_risk_score", "w.domain_age_days", "w.days_until_expiry", "w.is_newly_registered", "w.expires_soon")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, ts, value FROM events WHERE event_type IN ('click', 'view', 'purchase')),
l AS (SELECT user_id, event_type, arg_max(value, struct_pack(t := ts, i := event_id)) AS v FROM e GROUP BY ALL)
SELECT user_id, max(v) FILTER (event_type = 'click') AS domain, max(v) FILTER (event_type = 'view') AS http, max(v) FILTER (event_type = 'purchase') AS features FROM l GROUP BY user_id""")
def fused_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest part of each kind of every key."""
    parts = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "click", "domain").when(F.col("event_type") == "view", "http").when(F.col("event_type") == "purchase", "features").alias("part"), "ts", "event_id", "value")
    out = fuse.fuse(parts, "user_id", "part", ["domain", "http", "features"], ["value"], tie="event_id")
    return out.select("user_id", *[F.col(f"{k}.value").alias(k) for k in ("domain", "http", "features")])


@query("""
WITH f AS (SELECT user_id, max(event_type = 'click') AS d, max(event_type = 'view' AND value > 20) AS fe, max(event_type = 'purchase' AND value > 40) AS v, max(event_type = 'error') AS i FROM events GROUP BY user_id, date_trunc('day', ts))
SELECT CASE WHEN v AND fe AND d THEN 'fully_enriched' WHEN v AND d THEN 'verdict_only' WHEN fe AND d THEN 'with_features' WHEN d THEN 'domain_only' WHEN fe THEN 'features_only' WHEN i THEN 'inactive' ELSE 'partial' END AS record_type,
  CAST(CASE WHEN v AND fe AND d THEN 3 WHEN v AND d THEN 2 WHEN fe AND d THEN 2 WHEN d THEN 1 WHEN fe THEN 1 ELSE 0 END AS INTEGER) AS enrichment_level,
  CASE WHEN i AND v THEN 'inactive' WHEN i THEN 'failed' WHEN v THEN 'verdict' WHEN fe THEN 'features' ELSE 'domain' END AS message_type, count(*) AS n
FROM f GROUP BY ALL""")
def record_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the records of a key and day are enriched."""
    t, v = F.col("event_type"), F.col("value")
    df = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts")).agg(
        F.max(t == "click").alias("d"), F.max((t == "view") & (v > 20)).alias("fe"), F.max((t == "purchase") & (v > 40)).alias("v"), F.max(t == "error").alias("i"))
    kind = fuse.record_type(F.col("d"), F.col("fe"), F.col("v"), F.col("i"))
    df = df.select(kind.alias("r"), fuse.message_type(F.col("i") & F.col("v"), F.col("i"), F.col("v"), F.col("fe")).alias("message_type"))
    return df.groupBy("r.record_type", "r.enrichment_level", "message_type").agg(F.count("*").alias("n"))


@query("""
WITH n AS (
  SELECT s_suppkey AS id, s_name, ['ns' || (s_suppkey % 3), 'b'] AS ns, s_acctbal FROM supplier)
SELECT id, s_name, 2 AS ns_count, array_to_string(ns, ',') AS ns, s_acctbal AS money_balance, '{"A":' || (id % 9) || '}' AS ttls, id % 9 AS ttl_a, array_to_string(ns, ';') AS back FROM n""")
def flat_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records flattened to scalars, and read back."""
    k = F.col("s_suppkey")
    df = table(spark, sf_dir, "supplier").select(
        k.alias("id"), "s_name", F.array(F.concat(F.lit("ns"), (k % 3).cast("string")), F.lit("b")).alias("ns"), F.struct(F.col("s_acctbal").alias("balance")).alias("money"), F.create_map(F.lit("A"), (k % 9)).alias("ttls"))
    flat = fuse.flatten(df)
    back = fuse.rehydrate(flat.select("id", "ttls", "ns"), {"ttls": "map<string,bigint>"}, ["ns"]).select("id", F.col("ttls")["A"].alias("ttl_a"), F.array_join("ns", ";").alias("back"))
    return flat.join(back, "id")


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN FALSE ELSE p_partkey % 3 = 0 END AS html_exists, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'p' || p_partkey || '.html' END AS html_name FROM part""")
def artifact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records have their stored page."""
    k = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("/out/html/p"), k, F.lit(".html"))
    parts = table(spark, sf_dir, "part")
    rows = parts.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, "None").otherwise(path).alias("html"))
    return fuse.artifact_links(rows, parts.where("p_partkey % 3 = 0").select(path.alias("path")), "html").drop("html")


@query("""
SELECT c_custkey, '[who]' || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment
  || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '[where]' || chr(10) || 'nation: ' || c_nationkey ELSE '' END AS document FROM customer""")
def record_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts of records; sections without values are left out."""
    df = table(spark, sf_dir, "customer").withColumn("nation", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")))
    return df.select("c_custkey", fuse.document(df, {"who": ["c_name", "c_mktsegment"], "where": ["nation"]}).alias("document"))


@query(f"""
WITH {SQL_SCORED}
SELECT CASE k % 4 WHEN 0 THEN 'www.shop.example.com' WHEN 1 THEN 'a.gov.in.b.c.scam.xyz' WHEN 2 THEN 'pay.in.deal.top' ELSE 'xn--a.example.net' END AS fqdn,
  CASE WHEN k % 3 > 0 THEN 'reg1.com' END AS seed_registrable, 'omission' AS fuzzer, CASE k % 3 WHEN 1 THEN '1.1.1.1' WHEN 2 THEN 'a' END AS ip,
  CASE k % 7 WHEN 0 THEN 'ns1.njalla.no' WHEN 1 THEN 'a.sedoparking.com' END AS name_server, CASE k % 5 WHEN 0 THEN 'www.shop.example.com.' WHEN 1 THEN NULL ELSE 'mx.a.org' END AS mail_server,
  score, verdict, '2024-01-01' AS created, CASE k % 4 WHEN 0 THEN 'NameCheap Inc' ELSE 'Good Registrar' END AS registrar FROM s""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat report rows of scored records."""
    return fuse.report(_scored(spark, sf_dir).withColumns({"fuzzer": F.lit("omission"), "created": F.lit("2024-01-01")}))
