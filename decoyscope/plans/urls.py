"""Queries on page urls and hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.functions import host as H
from decoyscope.functions import text as T
from decoyscope.functions import url as U
from decoyscope.operators import route as R
from decoyscope.operators import rules
from decoyscope.plans.registry import query, table

HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def sql_entropy(s: str) -> str:
    return f"(SELECT round(coalesce(-sum(c / n * log2(c / n)), 0), 4) FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS n FROM (SELECT unnest(string_split({s}, '')) AS ch) q WHERE ch <> '' GROUP BY ch) z)"


@query(f"""
WITH p AS (SELECT page_id, url, {HOST} AS host FROM pages),
ch AS (SELECT page_id, unnest(string_split(url, '')) AS c FROM p),
cc AS (SELECT page_id, c, count(*) AS k FROM ch WHERE c <> '' GROUP BY ALL),
e AS (SELECT page_id, round(-sum(k / n * log2(k / n)), 4) AS ent FROM (SELECT page_id, k, sum(k) OVER (PARTITION BY page_id) AS n FROM cc) q GROUP BY page_id),
s AS (
  SELECT p.page_id, len(string_split(host, '.')) - 2 AS depth, e.ent, length(url) AS len, url, host, string_split(host, '.')[-1] AS tld
  FROM p JOIN e USING (page_id)),
r AS (
  SELECT page_id,
    CASE WHEN depth >= 8 THEN 20 WHEN depth >= 6 THEN 15 WHEN depth >= 5 THEN 12 WHEN depth >= 3 THEN 8 ELSE 0 END
    + CASE WHEN ent > 4.5 THEN 15 WHEN ent > 4.0 THEN 10 ELSE 0 END
    + CASE WHEN len >= 130 THEN 10 WHEN len >= 80 THEN 5 ELSE 0 END
    + CASE WHEN regexp_matches(url, '00|11|22|33|44|55|66|77|88|99') THEN 6 ELSE 0 END
    + CASE WHEN host LIKE '%xn--%' THEN 15 ELSE 0 END
    + CASE WHEN tld IN ('tk','ml','ga','cf','gq','xyz','top','club','info','online','site','website','space','tech','zip','click','download') THEN 6 ELSE 0 END AS score
  FROM s)
SELECT verdict, count(*) AS n, round(avg(score), 6) AS mean_score FROM (
  SELECT score, CASE WHEN score >= 70 THEN 'phishing' WHEN score >= 40 THEN 'suspicious' ELSE 'benign' END AS verdict FROM r) v
GROUP BY verdict""")
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls by verdict of the url rules."""
    df = table(spark, sf_dir, "pages").select("url").withColumn("fqdn", H.url_host(F.col("url")))
    df = df.withColumns({"url_length": F.length("url"), "url_entropy": T.entropy(F.col("url")), "has_repeated_digits": F.col("url").rlike(r"(\d)\1")})
    hits = rules.complete(df).select(rules.points(rules.url_shape(F.col)).alias("score"))
    verdict = F.when(F.col("score") >= 70, "phishing").when(F.col("score") >= 40, "suspicious").otherwise("benign")
    return hits.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def _sql_count(s: str, chars: str) -> str:
    return f"length({s}) - length(translate({s}, '{chars}', ''))"


@query(f"""
WITH p AS (
  SELECT page_id, url, {HOST} AS host,
    CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
q AS (SELECT *, string_split(host, '.') AS ls FROM p),
i AS (SELECT *, array_to_string(ls[1:greatest(len(ls) - 2, 0)], '') AS glued, greatest(len(ls) - 2, 0) AS n, len(ls) > 2 AS deep FROM q)
SELECT page_id, length(url) AS url_length, {_sql_count('url', '.')} AS num_dots,
  regexp_matches(url, '00|11|22|33|44|55|66|77|88|99') AS has_repeated_digits, {_sql_count('url', '@&%$!#?=_')} AS num_special_chars,
  {_sql_count('url', '-')} AS num_hyphens, {_sql_count('url', '/')} AS num_slashes, {_sql_count('url', '_')} AS num_underscores,
  {_sql_count('url', '?')} AS num_question_marks, {_sql_count('url', '=')} AS num_equal_signs, {_sql_count('url', '$')} AS num_dollar_signs,
  {_sql_count('url', '!')} AS num_exclamation_marks, {_sql_count('url', '#')} AS num_hashtags, {_sql_count('url', '%')} AS num_percent_signs,
  length(host) AS domain_length, {_sql_count('host', '-')} AS domain_hyphens, {_sql_count('host', '@&%$!#?=._-/')} > 0 AS domain_has_special_chars,
  {_sql_count('host', '@&%$!#?=._-/')} AS domain_num_special_chars, {sql_entropy('url')} AS url_entropy, {sql_entropy('host')} AS domain_entropy,
  greatest({_sql_count('host', '.')} - 1, 0) AS num_subdomains, CASE WHEN deep THEN length(glued) / greatest(n, 1) ELSE 0.0 END AS avg_subdomain_length,
  CASE WHEN deep THEN {sql_entropy('glued')} ELSE 0.0 END AS subdomain_entropy,
  CASE WHEN deep THEN {_sql_count('glued', '@&%$!#?=._-/')} ELSE 0 END AS subdomain_num_special_chars, deep AND contains(glued, '-') AS subdomain_has_hyphen,
  deep AND regexp_matches(glued, '00|11|22|33|44|55|66|77|88|99') AS subdomain_has_repeated_digits, length(path) AS path_length,
  regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) <> '' AS path_has_query, regexp_extract(url, '#(.*)$', 1) <> '' AS path_has_fragment,
  contains(url, '#') AS url_has_anchor
FROM i""")
def url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All structural features of every page url."""
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(k) for k, c in U.url_features(F.col("url")).items()])


@query(f"""
WITH h AS (SELECT page_id, trim(lower(host), '.') AS host FROM (SELECT page_id, {HOST} AS host FROM pages) q),
suffix AS (SELECT DISTINCT string_split(host, '.')[-1] AS s FROM h UNION SELECT 'example.org'),
l AS (SELECT *, string_split(host, '.') AS ls FROM h),
t AS (SELECT page_id, n FROM l, unnest(range(1, len(ls) + 1)) u(n) JOIN suffix ON array_to_string(ls[len(ls) - n + 1:], '.') = suffix.s),
b AS (SELECT page_id, max(n) AS n FROM t GROUP BY page_id)
SELECT l.page_id, host, ls[1] AS left_label, ls[-1] AS tld, greatest(len(ls) - 2, 0) AS depth,
  array_to_string(ls[len(ls) - least(n + 1, len(ls)) + 1:], '.') AS registrable,
  CASE WHEN regexp_matches(host, '^www\\.[^.]*\\..*') THEN host[5:] ELSE host END AS bare,
  regexp_matches(ls[1], '^[a-f0-9]{{16,}}$') OR ls[1] IN ('cpanel','cpcalendars','cpcontacts','webdisk','webmail','autodiscover','autoconfig','whm','mail','ns1','ns2','imap','pop','smtp') AS noisy,
  regexp_matches(host, '^([a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\\.)+[a-zA-Z]{{2,}}$') AS valid
FROM l JOIN b USING (page_id)""")
def host_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and the registrable domain of page hosts, with suffixes taken from the hosts and one of two labels."""
    from decoyscope.operators.match import is_noise

    hosts = table(spark, sf_dir, "pages").select("page_id", H.canonical_host(H.url_host(F.col("url")), idna=False).alias("host"))
    suffixes = hosts.select(F.element_at(H.labels(F.col("host")), -1).alias("suffix")).unionByName(hosts.select(F.lit("example.org").alias("suffix"))).distinct()
    h = F.col("host")
    return H.with_registrable(hosts, suffixes).select(
        "page_id", "host", H.left_label(h).alias("left_label"), H.tld(h).alias("tld"), H.subdomain_depth(h).alias("depth"), "registrable",
        H.strip_www(h).alias("bare"), is_noise(h).alias("noisy"), U.is_valid_domain(h).alias("valid"))


#: Rules of every kind, and what hosts end with; @ stands for the first label of a page's host.
RULES = ["com", "in", "co.in", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "kawasaki.jp", "// a comment", " ", "UK", "co.uk"]
PRIVATE_RULES = ["blogspot.com", "*.compute.cloud.com", "!own.compute.cloud.com"]
ENDS = [
    "@.com", "b.@.co.in", "a.b.@.ck", "@.ck", "a.www.ck", "www.ck", "a.@.kawasaki.jp", "a.b.city.kawasaki.jp", "@.city.kawasaki.jp", "kawasaki.jp", "x.@.blogspot.com",
    "a.@.eu.compute.cloud.com", "@.own.compute.cloud.com", "a.@.unknown", "@", "co.uk", "a.@.co.uk", "@.in",
]
ENDED = "CASE page_id % " + str(len(ENDS)) + "".join(f" WHEN {i} THEN replace('{e}', '@', label)" for i, e in enumerate(ENDS)) + " END"


@query(f"""
WITH p AS (SELECT page_id, string_split({HOST}, '.')[1] AS label FROM pages),
h AS (SELECT page_id, {ENDED} AS host FROM p),
rule AS (
  SELECT trim(lower(r)) AS r, priv FROM (SELECT unnest({RULES}) AS r, false AS priv UNION ALL SELECT unnest({PRIVATE_RULES}), true) q
  WHERE trim(r) <> '' AND NOT starts_with(r, '//')),
regex AS (
  SELECT priv, starts_with(r, '!') AS exception, len(string_split(r, '.')) - CASE WHEN starts_with(r, '!') THEN 1 ELSE 0 END AS n,
    '^(.*\\.)?' || replace(replace(replace(r, '!', ''), '.', '\\.'), '*', '[^.]+') || '$' AS x FROM rule),
hit AS (SELECT h.page_id, g.priv, g.exception, g.n FROM h JOIN regex g ON regexp_matches(h.host, g.x)),
best AS (SELECT page_id, arg_max(n, (exception::INT, n)) AS n FROM hit GROUP BY page_id),
open AS (SELECT page_id, arg_max(n, (exception::INT, n)) AS n FROM hit WHERE NOT priv GROUP BY page_id),
l AS (SELECT page_id, host, string_split(host, '.') AS ls FROM h)
SELECT l.page_id, l.host, array_to_string(ls[greatest(len(ls) - coalesce(best.n, len(ls)), 1):], '.') AS registrable,
  array_to_string(ls[greatest(len(ls) - coalesce(open.n, 1), 1):], '.') AS without_private
FROM l LEFT JOIN best USING (page_id) LEFT JOIN open USING (page_id)""")
def suffix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrable domains under rules with wildcards, exceptions and private suffixes, and under none."""
    label = H.left_label(H.url_host(F.col("url")))
    hosts = table(spark, sf_dir, "pages").select("page_id", label.alias("label")).select("page_id", F.expr(ENDED).alias("host"))
    rules = spark.createDataFrame([(r, False) for r in RULES] + [(r, True) for r in PRIVATE_RULES], "suffix string, private boolean")
    every = H.with_registrable(hosts, rules)
    public = H.with_registrable(every.withColumnRenamed("registrable", "every"), rules, private=False, unknown=2)
    return public.select("page_id", "host", F.col("every").alias("registrable"), F.col("registrable").alias("without_private"))


@query(f"""
WITH p AS (SELECT page_id, url, {HOST} AS host FROM pages),
q AS (SELECT *, CASE WHEN regexp_matches(host, '^www\\.[^.]*\\..*') THEN host[5:] ELSE host END AS bare FROM p)
SELECT page_id, regexp_replace(host, '[^a-zA-Z0-9.-]', '_', 'g') || '_' || left(sha256(url), 8) AS file_name,
  bare || ':' || left(sha1(bare), 16) AS id, md5(url) AS url_md5 FROM q""")
def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifact names, stable ids and hashes of page urls."""
    none, u = F.lit(None).cast("string"), F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.safe_filename(none, none, u, none).alias("file_name"), U.stable_id(none, u, none, none, F.to_json(F.struct("page_id"))).alias("id"), F.md5("url").alias("url_md5"))


def _bulk(df: DataFrame) -> DataFrame:
    """Submissions of several kinds from page urls."""
    k, u = F.col("page_id") % 5, F.col("url")
    bare = F.regexp_replace(u, "^https?://", "")
    return df.select(F.col("page_id").alias("idx"), F.when(k == 0, u).when(k == 1, F.concat(F.lit("  "), F.upper(H.url_host(u)), F.lit(" "))).when(k == 2, bare).when(k == 3, F.lit("")).otherwise(F.concat(F.lit("-"), H.url_host(u))).alias("input"))


SQL_BULK = f"""
SELECT page_id AS idx, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '  ' || upper({HOST}) || ' ' WHEN 2 THEN regexp_replace(url, '^https?://', '') WHEN 3 THEN '' ELSE '-' || {HOST} END AS input FROM pages"""


@query(f"""
WITH b AS ({SQL_BULK}),
d AS (SELECT idx, input, CASE WHEN regexp_matches(lower(trim(input)), '^https?://') THEN {HOST.replace('url', 'trim(input)')} ELSE lower(trim(input)) END AS domain FROM b)
SELECT idx, input, domain, CASE WHEN regexp_matches(domain, '^([a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\\.)+[a-zA-Z]{{2,}}$') THEN 'queued' ELSE 'Invalid domain format' END AS status FROM d""")
def bulk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bulk submissions are queued."""
    return R.bulk_report(_bulk(table(spark, sf_dir, "pages")), most=1 << 40)


@query(f"""
WITH b AS ({SQL_BULK}),
t AS (SELECT idx, trim(input) AS s FROM b),
f AS (SELECT idx, s, CASE WHEN regexp_matches(lower(s), '^https?://') THEN s ELSE 'http://' || s END AS f FROM t),
h AS (SELECT idx, s, f, regexp_extract(f, '^(https?://[^/?#\\s]+)', 1) AS head FROM f)
SELECT idx, CASE WHEN s <> '' AND head <> '' THEN head || CASE WHEN starts_with(f[length(head) + 1:], '/') THEN '' ELSE '/' END || f[length(head) + 1:] END AS normal FROM h""")
def url_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form of each submission, null where there is none."""
    return _bulk(table(spark, sf_dir, "pages")).select("idx", U.normalize_url(F.col("input")).alias("normal"))


def _probes(df: DataFrame) -> DataFrame:
    """Probe records as JSON, some of them malformed, from page urls."""
    k = F.col("page_id") % 7
    host = H.url_host(F.col("url"))
    lit = lambda s: F.lit(s)
    value = (
        F.when(k == 0, F.concat(lit('{"ok": false, "canonical_fqdn": "'), host, lit('"}')))
        .when(k == 1, F.concat(lit('{"ok": tru, "url": "'), F.col("url"), lit('"')))
        .when(k == 2, F.concat(lit('{"ok": true, "canonical_fqdn": "'), host, lit('", "url": "  "}')))
        .when(k == 3, lit('{"ok": true, "url": "http://"}'))
        .when(k == 4, F.concat(lit('{"ok": true, "final": {"url": "'), F.col("url"), lit('", "title": "t"}, "cse_id": "c1"}')))
        .when(k == 5, F.concat(lit('{"ok": false, "error": "timeout", "registrable": "r.org", "host": "'), host, lit('"}')))
        .otherwise(F.concat(lit('{"ok": true, "url": "'), F.col("url"), lit('"}')))
    )
    return df.select("page_id", value.alias("value"))


@query("""
SELECT CASE WHEN page_id % 7 IN (0, 5) THEN 'inactive' WHEN page_id % 7 IN (1, 2, 3) THEN 'dead' ELSE 'crawl' END AS route,
  CASE page_id % 7 WHEN 0 THEN 'connection_failed' WHEN 1 THEN 'json_parse_error' WHEN 2 THEN 'missing_url' WHEN 3 THEN 'invalid_url' WHEN 5 THEN 'timeout' ELSE 'none' END AS failure_type,
  count(*) AS n
FROM pages GROUP BY ALL""")
def route_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router counts by route and failure type."""
    routed = R.route(_probes(table(spark, sf_dir, "pages")))
    return routed.groupBy("route", F.coalesce("failure_type", F.lit("none")).alias("failure_type")).agg(F.count("*").alias("n"))


@query(f"""
SELECT CASE page_id % 7 WHEN 5 THEN 'r.org' ELSE {HOST} END AS registrable, CASE page_id % 7 WHEN 5 THEN 'r.org' ELSE {HOST} END AS canonical_fqdn,
  NULL AS cse_id, NULL AS seed_registrable, 'inactive' AS status, CASE page_id % 7 WHEN 5 THEN 'timeout' ELSE 'connection_failed' END AS failure_type
FROM pages WHERE page_id % 7 IN (0, 5)""")
def inactive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of inactive hosts."""
    return R.inactive(R.route(_probes(table(spark, sf_dir, "pages")))).drop("reasons")


@query("""
WITH u AS (SELECT page_id, url AS k FROM pages WHERE page_id % 7 IN (4, 6))
SELECT k AS key, CASE page_id % 7 WHEN 4 THEN '{"schema_version":"v1","url":"' || k || '","cse_id":"c1","title":"t"}' ELSE '{"schema_version":"v1","url":"' || k || '"}' END AS value FROM u""")
def crawl_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned crawl requests; absent fields are left out."""
    return R.crawl_requests(R.route(_probes(table(spark, sf_dir, "pages"))))


#: Records of every shape, @ standing for a page's url and # for its id; one page has the one of its id's remainder.
SHAPES = [
    '{"url":"@?short","final_url":" @#landing "}',
    '{"url":"  ","final":{"url":"@","title":"inner"},"title":"outer","status":200}',
    '{"final":{"url":"@?probe","status_code":301,"id":"f#"},"result":{"final_url":"@?result"}}',
    '{"result":{"final_url":null,"url":"@","cse_id":"r#"},"cse_id":" "}',
    '{"http":{"location":"@","url":7},"id":"top#","data":{"id":"in#"}}',
    '{"http_result":{"final_url":"@?r","url":"@"},"http":{"status":404,"brand":"b"},"status":null}',
    '{"artifact":{"url":"@"},"artifacts":{"url":"@?later","cse":"a#"},"brand":{"n":1,"name":"x"}}',
    '{"artifacts":{"location":"@"},"data":{"registrable":"d.org"},"result":{"registrable":"r.org"}}',
    '{"data":{"location":"@","fqdn":"f.data","seed_registrable":"s.org"},"canonical_id":5,"http":[{"url":"@?list"}]}',
    '{"final_url":5,"url":["@"],"http":"@"}',
    '{"url":"http://","data":{"url":"@"}}',
    '{"url":"@","ok":"false","status_code":"200","canonical_fqdn":"c.org"}',
    '{"url":"@","ok":false,"fqdn":"only.org","cse_id":"c#"}',
    '{"url":"@","ok":false,"error":"dns","result":{"registrable":"r.org"}}',
    '["@"]',
    '"@"',
    '{"url":"@"',
    '{"other":{"url":"@"},"ts":1}',
]
SHAPED = "CASE page_id % " + str(len(SHAPES)) + "".join(f" WHEN {i} THEN replace(replace('{s}', '#', CAST(page_id AS VARCHAR(20))), '@', url)" for i, s in enumerate(SHAPES)) + " END"


def _sql_text(at: str) -> str:
    return f"CASE WHEN json_type(value, '$.{at}') = 'VARCHAR' THEN nullif(trim(json_extract_string(value, '$.{at}')), '') END"


SQL_URL = ", ".join(map(_sql_text, ["final_url", "url", "final.url", *(f"{k}.{n}" for k in ["result", "http", "http_result", "artifact", "artifacts", "data"] for n in ["final_url", "url", "location"])]))
SQL_SEED = ", ".join(_sql_text(at + n) for at in ["", "result.", "http.", "http_result.", "artifact.", "artifacts.", "data.", "final."] for n in ["cse_id", "id", "cse", "canonical_id"])
SQL_SHAPED = f"""
WITH s AS (SELECT page_id, {SHAPED} AS raw FROM pages),
j AS (SELECT page_id, raw, CASE WHEN json_valid(raw) THEN CASE WHEN json_type(raw) = 'OBJECT' THEN raw::JSON END END AS value FROM s),
u AS (SELECT *, coalesce(json_type(value, '$.ok') = 'BOOLEAN' AND json_extract_string(value, '$.ok') = 'false', false) AS failed, coalesce({SQL_URL}) AS found FROM j),
f AS (SELECT *, CASE WHEN regexp_matches(lower(found), '^https?://') THEN found ELSE 'http://' || found END AS full_url FROM u),
h AS (SELECT *, regexp_extract(full_url, '^(https?://[^/?#\\s]+)', 1) AS head FROM f),
r AS (SELECT *, CASE WHEN head <> '' THEN head || CASE WHEN starts_with(full_url[length(head) + 1:], '/') THEN '' ELSE '/' END || full_url[length(head) + 1:] END AS url FROM h)
"""


def _shaped(df: DataFrame) -> DataFrame:
    return df.select("page_id", F.expr(SHAPED).alias("value"))


def _sql_passed(name: str) -> str:
    at = [f"nullif(json_extract(value, '$.{k}{name}')::VARCHAR, 'null')" for k in ["", "result.", "http.", "http_result.", "artifact.", "artifacts.", "data.", "final."]]
    return f"coalesce({', '.join(at)}) AS {name}"


@query(SQL_SHAPED + f"""
SELECT page_id, CASE WHEN failed THEN 'inactive' WHEN url IS NULL THEN 'dead' ELSE 'crawl' END AS route,
  CASE WHEN value IS NULL THEN 'json_parse_error' WHEN failed THEN coalesce(json_extract_string(value, '$.error'), 'connection_failed')
    WHEN found IS NULL THEN 'missing_url' WHEN url IS NULL THEN 'invalid_url' END AS failure_type,
  url, coalesce({SQL_SEED}) AS cse_id, {", ".join(map(_sql_passed, ["status", "status_code", "title", "registrable", "brand", "seed_registrable", "canonical_fqdn", "fqdn"]))}
FROM r""")
def record_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, url, seed and passed fields of records of every shape."""
    routed = R.route(_shaped(table(spark, sf_dir, "pages")))
    r = F.col("rec")
    return routed.select("page_id", "route", "failure_type", "url", R.found_seed(r).alias("cse_id"), *[F.to_json(R.passed_field(r, k)).alias(k) for k in R.PASSED])


@query(SQL_SHAPED + """
SELECT failure_type, keys AS shape, count(*) AS n, min(left(raw, 20)) AS least FROM (
  SELECT raw, CASE WHEN value IS NULL THEN 'json_parse_error' WHEN found IS NULL THEN 'missing_url' ELSE 'invalid_url' END AS failure_type,
    CASE WHEN value IS NULL THEN '-' ELSE array_to_string(json_keys(value), ',') END AS keys
  FROM r WHERE NOT failed AND url IS NULL) q GROUP BY failure_type, keys""")
def dead_letter_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters by failure and by the record's keys."""
    dead = R.dead_letters(R.route(_shaped(table(spark, sf_dir, "pages"))))
    shape = F.coalesce(F.array_join("record_keys", ","), F.lit("-"))
    return dead.groupBy("failure_type", shape.alias("shape")).agg(F.count("*").alias("n"), F.min(F.left("raw_value", F.lit(20))).alias("least"))


@query(SQL_SHAPED + """
SELECT coalesce(json_extract_string(value, '$.registrable'), json_extract_string(value, '$.canonical_fqdn'), json_extract_string(value, '$.fqdn')) AS registrable,
  coalesce(json_extract_string(value, '$.cse_id'), 'none') AS cse_id, 'http_probe_failed' AS reason
FROM r WHERE failed AND coalesce(json_extract_string(value, '$.registrable'), json_extract_string(value, '$.canonical_fqdn'), json_extract_string(value, '$.fqdn')) IS NOT NULL""")
def inactive_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inactive records of any shape; those that name no host are left out."""
    found = R.inactive(R.route(_shaped(table(spark, sf_dir, "pages"))))
    return found.select("registrable", F.coalesce("cse_id", F.lit("none")).alias("cse_id"), F.element_at("reasons", 1).alias("reason"))



@query(f"""
WITH p AS (SELECT page_id, url, {HOST} AS full_host FROM pages),
w AS (SELECT page_id, url, CASE WHEN regexp_matches(full_host, '^www\\.[^.]*\\..*') THEN full_host[5:] ELSE full_host END AS h FROM p),
c AS (
  SELECT page_id, h, CASE page_id % 4 WHEN 0 THEN [url] WHEN 1 THEN [url, 'https://bit.ly/a', 'https://www.' || h || '/x'] WHEN 2 THEN ['https://www.' || h || '/', url] ELSE [url, 'http://t.co/1', 'http://a.netlify.app/', 'https://final.example.com/'] END AS chain
  FROM w)
SELECT page_id, len(chain) - 1 AS redirect_count, CASE page_id % 4 WHEN 0 THEN NULL ELSE h END AS original,
  CASE page_id % 4 WHEN 0 THEN NULL WHEN 3 THEN 'final.example.com' ELSE h END AS final,
  CASE page_id % 4 WHEN 1 THEN 1 WHEN 3 THEN CASE WHEN h = 'final.example.com' THEN 2 ELSE 3 END ELSE 0 END AS hops,
  CASE page_id % 4 WHEN 1 THEN 25 WHEN 3 THEN CASE WHEN h = 'final.example.com' THEN 45 ELSE 55 END ELSE 0 END AS penalty,
  page_id % 4 IN (1, 3) AS crosses
FROM c""")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and penalty of redirect chains made of page urls."""
    u, k = F.col("url"), F.col("page_id") % 4
    www = F.concat(F.lit("https://www."), H.strip_www(H.url_host(u)))
    chain = (
        F.when(k == 0, F.array(u)).when(k == 1, F.array(u, F.lit("https://bit.ly/a"), F.concat(www, F.lit("/x"))))
        .when(k == 2, F.array(F.concat(www, F.lit("/")), u)).otherwise(F.array(u, F.lit("http://t.co/1"), F.lit("http://a.netlify.app/"), F.lit("https://final.example.com/")))
    )
    df = table(spark, sf_dir, "pages").select("page_id", chain.alias("chain")).withColumn("s", H.redirect_summary(F.col("chain")))
    return df.select("page_id", "s.redirect_count", "s.original", "s.final", "s.hops", H.redirect_penalty(F.col("chain"), F.col("s.hops")).alias("penalty"), "s.crosses")


@query(f"""
WITH h AS (SELECT page_id, {HOST} AS host, page_id % 4 AS k FROM pages),
c AS (SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 4 ELSE k END AS k FROM h)
SELECT coalesce(CASE k WHEN 1 THEN 'vercel' WHEN 2 THEN 'bitly' WHEN 3 THEN 'ngrok' WHEN 4 THEN 'rebrandly' END, 'none') AS service,
  coalesce(CASE k WHEN 1 THEN 'high' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' WHEN 4 THEN 'high' END, 'none') AS risk, count(*) AS n FROM c GROUP BY ALL""")
def hosting_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts by hosting service."""
    h, k = H.url_host(F.col("url")), F.col("page_id") % 4
    host = F.when(F.col("page_id") % 5 == 4, F.concat(F.lit("link."), h)).when(k == 0, h).when(k == 1, F.concat(h, F.lit(".vercel.app"))).when(k == 2, F.concat(F.lit("x."), h, F.lit(".bit.ly"))).otherwise("a.ngrok.io")
    df = table(spark, sf_dir, "pages").select(host.alias("host")).withColumn("c", H.hosting_class(F.col("host")))
    return df.groupBy(F.coalesce("c.service", F.lit("none")).alias("service"), F.coalesce("c.risk", F.lit("none")).alias("risk")).agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(regexp_replace(lower(text), '[^\\p{L}\\n ]', '', 'g'), ' ')) AS w FROM documents),
h AS (SELECT w || '.example.com' AS host FROM w WHERE length(w) BETWEEN 3 AND 20 AND NOT contains(w, chr(10)))
SELECT host, n > 0 AS is_idn, n > 0 AS mixed_script, n AS confusable_count
FROM (SELECT host, len(regexp_extract_all(host, '[^\\x00-\\x7F]')) AS n FROM h) q""")
def idn_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script features of hosts made of the documents' words."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\n ]", ""), " ")).alias("w")).distinct()
    hosts = words.where(F.length("w").between(3, 20) & ~F.contains("w", F.lit("\n"))).select(F.concat("w", F.lit(".example.com")).alias("host"))
    return hosts.select("host", H.idn_features(F.col("host")).alias("f")).select("host", "f.*")


@query(f"""
WITH h AS (SELECT page_id, {HOST} AS host FROM pages),
n AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN [] ELSE ['ns' || (page_id % 3) || '.' || host, 'a.' || host] END AS ns FROM h),
j AS (SELECT *, array_to_string(ns, '') AS s FROM n)
SELECT page_id, len(ns) AS count, {sql_entropy('s')} AS entropy, CASE WHEN len(ns) > 0 THEN 2.0 ELSE 0.0 END AS mean_length, CASE WHEN len(ns) > 0 THEN 0.5 ELSE 0.0 END AS digit_share FROM j""")
def nameserver_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of name server lists made of page hosts."""
    h, k = H.url_host(F.col("url")), F.col("page_id") % 3
    ns = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("ns"), k.cast("string"), F.lit("."), h), F.concat(F.lit("a."), h)))
    return table(spark, sf_dir, "pages").select("page_id", H.nameserver_features(ns).alias("f")).select("page_id", "f.*")
