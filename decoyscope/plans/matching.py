"""Queries that match hosts with seeds and generate lookalikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.operators import enrich, match, networks, route, variants
from decoyscope.plans.registry import query, table

_TOKENS = "SELECT DISTINCT lower(regexp_extract(p_name, '([a-z]+)$', 1)) AS token FROM part"
_LABELS = """
SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN w WHEN 1 THEN 'my-' || w WHEN 2 THEN w || (p_partkey % 100) WHEN 3 THEN left(w, length(w) - 1) WHEN 4 THEN w || 'x' ELSE 'sub' || w END AS label
FROM (SELECT p_partkey, lower(regexp_extract(p_name, '([a-z]+)$', 1)) AS w FROM part) q"""


@query(f"""
WITH t AS (SELECT token FROM ({_TOKENS}) q WHERE length(token) >= 3), l AS ({_LABELS}),
h AS (
  SELECT label, token, CASE WHEN label = token THEN 1 WHEN length(token) >= 5 AND levenshtein(label, token) <= 1 THEN 2
    WHEN regexp_matches(label, '(^|[^a-z])' || token || '([^a-z]|$)') THEN 3 END AS rule FROM l, t WHERE label <> '')
SELECT label, min(token) AS token, ['token:exact', 'token:ld1', 'token:word'][arg_min(rule, token)] AS rule FROM h WHERE rule IS NOT NULL GROUP BY label""")
def token_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand tokens found in host labels: exact, within one edit, as a word."""
    w = F.lower(F.regexp_extract("p_name", "([a-z]+)$", 1))
    k = F.col("p_partkey") % 6
    parts = table(spark, sf_dir, "part")
    label = (
        F.when(k == 0, w).when(k == 1, F.concat(F.lit("my-"), w)).when(k == 2, F.concat(w, (F.col("p_partkey") % 100).cast("string")))
        .when(k == 3, F.left(w, F.length(w) - 1)).when(k == 4, F.concat(w, F.lit("x"))).otherwise(F.concat(F.lit("sub"), w))
    )
    return match.token_match(parts.select(label.alias("label")), parts.select(w.alias("token")))


@query("""
WITH h AS (SELECT c_custkey, lower(c_mktsegment) || '-' || c_nationkey || '.com' AS registrable FROM customer),
s AS (SELECT 'c' || n_nationkey AS cse_id, 'building-' || n_nationkey || '.com' AS seed_registrable FROM nation)
SELECT c_custkey, registrable, cse_id, CASE WHEN seed_registrable IS NULL THEN '' ELSE 'seed:registrable:eq' END AS reasons FROM h LEFT JOIN s ON registrable = seed_registrable""")
def seed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts whose registrable domain is a protected seed."""
    hosts = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.lit("-"), F.col("c_nationkey").cast("string"), F.lit(".com")).alias("registrable"))
    n = F.col("n_nationkey").cast("string")
    seeds = table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), n).alias("cse_id"), F.concat(F.lit("building-"), n, F.lit(".com")).alias("seed_registrable"))
    return match.seed_match(hosts, seeds).select("c_custkey", "registrable", "cse_id", F.array_join("reasons", ",").alias("reasons"))


@query("""
WITH h AS (SELECT p_partkey, 'h' || (p_partkey % 300) || CASE WHEN p_partkey % 4 = 0 THEN '.bad.org' ELSE '.ok.org' END AS fqdn FROM part),
s AS (SELECT DISTINCT 'h' || (s_suppkey % 50) || '.ok.org' AS fqdn FROM supplier)
SELECT fqdn, p_partkey FROM h WHERE fqdn NOT LIKE '%bad.org' AND fqdn NOT IN (SELECT fqdn FROM s)""")
def unseen_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts outside the denied suffixes and the hosts seen before."""
    k = F.col("p_partkey")
    hosts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("h"), (k % 300).cast("string"), F.when(k % 4 == 0, ".bad.org").otherwise(".ok.org")).alias("fqdn"))
    seen = table(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), (F.col("s_suppkey") % 50).cast("string"), F.lit(".ok.org")).alias("fqdn"))
    return match.unseen(match.deny_suffixes(hosts, ["bad.org"]), seen)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed domains from the words of part names."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("label")).where(F.col("label").rlike("^[a-z]{3,}$")).distinct()
    return words.select("label", F.lit("com").alias("tld"))


_SEEDS = "SELECT DISTINCT label FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS label FROM part) q WHERE regexp_full_match(label, '[a-z]{3,}')"
_TLDS, _WORDS = ["com", "net", "org", "xyz"], ["secure", "login"]
_PASSES = {"PASS_A": (["omission", "repetition", "transposition", "hyphenation", "addition", "tld-swap"], _TLDS, []), "PASS_C": (["dictionary"], [], _WORDS)}
_VARIANTS = f"""
v AS (
  SELECT label || '.com' AS seed, fuzzer, fqdn, pass FROM (
    SELECT label, 'omission' AS fuzzer, left(label, i - 1) || label[i + 1:] || '.com' AS fqdn, 'PASS_A' AS pass FROM s, unnest(range(1, length(label) + 1)) t(i)
    UNION SELECT label, 'repetition', left(label, i) || label[i:] || '.com', 'PASS_A' FROM s, unnest(range(1, length(label) + 1)) t(i)
    UNION SELECT label, 'transposition', left(label, i - 2) || label[i] || label[i - 1] || label[i + 1:] || '.com', 'PASS_A' FROM s, unnest(range(2, length(label) + 1)) t(i)
    UNION SELECT label, 'hyphenation', left(label, i - 1) || '-' || label[i:] || '.com', 'PASS_A' FROM s, unnest(range(2, length(label) + 1)) t(i)
    UNION SELECT label, 'addition', label || x || '.com', 'PASS_A' FROM s, unnest(string_split('abcdefghijklmnopqrstuvwxyz0123456789', '')) t(x)
    UNION SELECT label, 'tld-swap', label || '.' || x, 'PASS_A' FROM s, unnest({_TLDS}) t(x)
    UNION SELECT label, 'dictionary', unnest([label || '-' || x, label || x, x || '-' || label, x || label]) || '.com', 'PASS_C' FROM s, unnest({_WORDS}) t(x)) q
  WHERE fqdn <> label || '.com' AND fqdn <> '.com')"""


@query(f"""
WITH s AS ({_SEEDS}), {_VARIANTS},
o AS (SELECT fqdn, ('0x' || left(md5(fqdn), 1))::INTEGER < 4 AS registered, seed FROM v)
SELECT seed, count(DISTINCT fqdn) FILTER (registered) AS registered, count(DISTINCT fqdn) FILTER (NOT registered) AS unregistered, count(*) AS rows FROM o GROUP BY seed""")
def variant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered and unregistered lookalikes of each seed; a quarter of the hosts is taken for observed."""
    made = variants.generate(_seeds(spark, sf_dir), _PASSES)
    observed = made.where(F.conv(F.left(F.md5("fqdn"), F.lit(1)), 16, 10).cast("int") < 4).select("fqdn")
    return variants.seed_stats(match.registered_split(made, observed))


@query(f"""
WITH s AS ({_SEEDS}), {_VARIANTS}
SELECT seed, fqdn, arg_min(fuzzer, pass || fuzzer) AS fuzzer, min(pass) AS pass, array_to_string(list_sort(list_distinct(list(pass))), ',') AS reasons, FALSE AS is_original_seed FROM v GROUP BY seed, fqdn
UNION ALL SELECT label || '.com', label || '.com', NULL, NULL, '', TRUE FROM s""")
def lookalike_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lookalike once, from its first pass, and the seeds themselves."""
    seeds = _seeds(spark, sf_dir)
    made = variants.first_pass(variants.generate(seeds, _PASSES))
    every = variants.with_seeds(made, seeds)
    return every.join(made, ["seed", "fqdn"], "left").select("seed", "fqdn", "fuzzer", "pass", F.coalesce(F.array_join("reasons", ","), F.lit("")).alias("reasons"), "is_original_seed")


def _values(pairs: dict[str, str]) -> str:
    """(ch, y): a row for each character and each that may take its place."""
    rows = ", ".join(f"('{c}', '{y}')" for c, ys in pairs.items() for y in ys)
    return f"(VALUES {rows}) x(ch, y)"


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]::VARCHAR[]"


def _family_sql(name: str, tlds: list[str], words: list[str]) -> str:
    """SELECT label, fqdn of one family over s (label), every seed being label.com."""
    at = lambda first: f"s, unnest(range({first}, length(label) + 1)) t(i)"
    changed = lambda table, keep="": f"SELECT label, left(label, i - 1) || y{keep} || label[i + 1:] || '.com' AS fqdn FROM {at(1)} JOIN {table} ON ch = label[i]"
    letters = f"unnest(string_split('{variants.LETTERS}', '')) z(c)"
    squat = f"(SELECT c AS ch, chr(xor(ascii(c), CAST(1 << b AS INTEGER))) AS y FROM {letters}, unnest(range(0, 7)) w(b) WHERE contains('{variants.LETTERS}-', chr(xor(ascii(c), CAST(1 << b AS INTEGER))))) x"
    return {
        "addition": f"SELECT label, label || c || '.com' AS fqdn FROM s, {letters}",
        "bitsquatting": changed(squat),
        "homoglyph": changed(_values(variants.HOMOGLYPHS)),
        "hyphenation": f"SELECT label, left(label, i - 1) || '-' || label[i:] || '.com' AS fqdn FROM {at(2)}",
        "insertion": changed(_values(variants.NEIGHBOURS), " || label[i]"),
        "omission": f"SELECT label, left(label, i - 1) || label[i + 1:] || '.com' AS fqdn FROM {at(1)}",
        "repetition": f"SELECT label, left(label, i) || label[i:] || '.com' AS fqdn FROM {at(1)}",
        "replacement": changed(_values(variants.NEIGHBOURS)),
        "subdomain": f"SELECT label, left(label, i - 1) || '.' || label[i:] || '.com' AS fqdn FROM {at(2)}",
        "transposition": f"SELECT label, left(label, i - 2) || label[i] || label[i - 1] || label[i + 1:] || '.com' AS fqdn FROM {at(2)}",
        "vowel-swap": changed(_values({v: variants.VOWELS for v in variants.VOWELS})),
        "dictionary": f"SELECT label, unnest([label || '-' || w, label || w, w || '-' || label, w || label]) || '.com' AS fqdn FROM s, unnest({_sql_list(words)}) t(w)",
        "tld-swap": f"SELECT label, label || '.' || x AS fqdn FROM s, unnest({_sql_list(tlds)}) t(x)",
    }[name]


def _passes_sql(passes: dict) -> str:
    """v: seed, fqdn, fuzzer, pass of all passes."""
    parts = [f"SELECT *, '{name}' AS fuzzer, '{label}' AS pass FROM ({_family_sql(name, tlds, words)}) q" for label, (names, tlds, words) in passes.items() for name in names]
    return f"""s AS ({_SEEDS}), v AS (SELECT DISTINCT label || '.com' AS seed, fqdn, fuzzer, pass FROM ({" UNION ALL ".join(parts)}) q
  WHERE fqdn <> label || '.com' AND NOT regexp_matches(fqdn, '(^|\\.)-|-(\\.|$)|\\.\\.|^\\.'))"""


_ALL = {"PASS_A": (variants.PASSES["PASS_A"][0], _TLDS, _WORDS)}


@query(f"WITH {_passes_sql(_ALL)} SELECT * FROM v")
def all_variant_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family over every seed."""
    return variants.generate(_seeds(spark, sf_dir), _ALL)


@query(f"""
WITH {_passes_sql(variants.PASSES)}
SELECT seed, fqdn, arg_min(fuzzer, pass || fuzzer) AS fuzzer, min(pass) AS pass, array_to_string(list_sort(list_distinct(list(pass))), ',') AS reasons FROM v GROUP BY seed, fqdn""")
def three_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three passes with their own families, endings and words, each lookalike once."""
    made = variants.first_pass(variants.generate(_seeds(spark, sf_dir)))
    return made.withColumn("reasons", F.array_join("reasons", ","))


#: Addresses of both families made of customers, some of them none; nested and overlapping networks and ranges made of nations. Both engines read these.
ADDRESSES = """
SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN '10.' || c_nationkey || '.' || (c_custkey % 256) || '.' || (c_custkey * 7 % 256)
  WHEN c_custkey % 5 < 4 THEN '2001:db8:' || lower(hex(c_nationkey)) || ':' || lower(hex(c_custkey % 65536)) || '::' || lower(hex(c_custkey * 13 % 65536)) ELSE 'host' || c_custkey END AS address
FROM customer"""
NETWORKS = """
SELECT '10.0.0.0/8' AS network UNION SELECT '2001:db8::/32' UNION SELECT '2001:db8::/129' UNION SELECT 'none'
UNION SELECT '10.' || n_nationkey || '.0.0/16' FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT '10.' || n_nationkey || '.' || (n_nationkey * 8) || '.0/21' FROM nation
UNION SELECT '10.' || n_nationkey || '.64.0/18' FROM nation WHERE n_nationkey % 3 = 0
UNION SELECT '10.' || n_nationkey || '.5.200-10.' || (n_nationkey + 1) || '.1.7' FROM nation WHERE n_nationkey % 5 = 0
UNION SELECT '2001:db8:' || lower(hex(n_nationkey)) || '::/48' FROM nation WHERE n_nationkey % 2 = 0
UNION SELECT '2001:db8:' || lower(hex(n_nationkey)) || ':0:8000::/66' FROM nation UNION SELECT '2001:db8:' || lower(hex(n_nationkey)) || ':80::/57' FROM nation"""


@query(f"""
WITH a AS ({ADDRESSES.replace("lower(hex(", "lower(printf('%x', ")}),
b AS (
  SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN '4:' || lpad(bin(10 * 16777216 + c_nationkey * 65536 + c_custkey % 256 * 256 + c_custkey * 7 % 256), 32, '0')
    WHEN c_custkey % 5 < 4 THEN '6:' || lpad(bin(8193), 16, '0') || lpad(bin(3512), 16, '0') || lpad(bin(c_nationkey), 16, '0') || lpad(bin(c_custkey % 65536), 16, '0') || repeat('0', 48) || lpad(bin(c_custkey * 13 % 65536), 16, '0') END AS bits
  FROM customer),
v4 AS (
  SELECT '10.0.0.0/8' AS network, 10 * 16777216 AS low, 11 * 16777216 - 1 AS high
  UNION SELECT '10.' || n_nationkey || '.0.0/16', (2560 + n_nationkey) * 65536, (2561 + n_nationkey) * 65536 - 1 FROM nation WHERE n_nationkey % 2 = 0
  UNION SELECT '10.' || n_nationkey || '.' || (n_nationkey * 8) || '.0/21', (2560 + n_nationkey) * 65536 + n_nationkey * 2048, (2560 + n_nationkey) * 65536 + n_nationkey * 2048 + 2047 FROM nation
  UNION SELECT '10.' || n_nationkey || '.64.0/18', (2560 + n_nationkey) * 65536 + 16384, (2560 + n_nationkey) * 65536 + 32767 FROM nation WHERE n_nationkey % 3 = 0
  UNION SELECT '10.' || n_nationkey || '.5.200-10.' || (n_nationkey + 1) || '.1.7', (2560 + n_nationkey) * 65536 + 1480, (2561 + n_nationkey) * 65536 + 263 FROM nation WHERE n_nationkey % 5 = 0),
v6 AS (
  SELECT '2001:db8::/32' AS network, lpad(bin(8193), 16, '0') || lpad(bin(3512), 16, '0') AS head
  UNION SELECT '2001:db8:' || printf('%x', n_nationkey) || '::/48', lpad(bin(8193), 16, '0') || lpad(bin(3512), 16, '0') || lpad(bin(n_nationkey), 16, '0') FROM nation WHERE n_nationkey % 2 = 0
  UNION SELECT '2001:db8:' || printf('%x', n_nationkey) || ':0:8000::/66', lpad(bin(8193), 16, '0') || lpad(bin(3512), 16, '0') || lpad(bin(n_nationkey), 16, '0') || repeat('0', 16) || '10' FROM nation
  UNION SELECT '2001:db8:' || printf('%x', n_nationkey) || ':80::/57', lpad(bin(8193), 16, '0') || lpad(bin(3512), 16, '0') || lpad(bin(n_nationkey), 16, '0') || '000000001' FROM nation),
n AS (
  SELECT network, '4:' || lpad(bin(low), 32, '0') AS low, '4:' || lpad(bin(high), 32, '0') AS high, (high - low + 1)::DOUBLE AS size FROM v4
  UNION ALL SELECT network, '6:' || rpad(head, 128, '0'), '6:' || rpad(head, 128, '1'), pow(2, 128 - length(head)) FROM v6),
best AS (SELECT c_custkey, arg_min(network, (size, network)) AS network FROM b JOIN n ON bits BETWEEN low AND high GROUP BY c_custkey)
SELECT a.c_custkey, address, network FROM a LEFT JOIN best USING (c_custkey)""")
def network_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest network or range of either family that holds each address."""
    for name in ("customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"_{name}")
    read = lambda text: spark.sql(text.replace("FROM customer", "FROM _customer").replace("FROM nation", "FROM _nation"))
    return networks.with_network(read(ADDRESSES), read(NETWORKS), "address").select("c_custkey", "address", F.col("net.network").alias("network"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS ip FROM orders),
r AS (SELECT n_nationkey * 20000 AS net_start, n_nationkey * 20000 + 14999 AS net_end, n_name AS country FROM nation)
SELECT o_orderkey, country FROM o LEFT JOIN r ON ip BETWEEN net_start AND net_end""")
def address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join of values with disjoint ranges."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("ip"))
    start = F.col("n_nationkey").cast("long") * 20000
    ranges = table(spark, sf_dir, "nation").select(start.alias("net_start"), (start + 14999).alias("net_end"), F.col("n_name").alias("country"))
    return enrich.range_join(rows, ranges, "ip", 20000).select("o_orderkey", "country")


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey % 256 AS BIGINT) + 256 * 2 + 65536 * 3 + 16777216 * 10 END AS number, n_name AS nation, r_name AS region,
  CASE c_custkey % 4 WHEN 0 THEN '10.3.2.' || (c_custkey % 256) WHEN 1 THEN '::1' WHEN 2 THEN '300.1.1.1' END AS ip
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def enriched_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with their snapshots and their first address as a number."""
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    a = F.when(k % 4 == 0, F.array(F.concat(F.lit("10.3.2."), (k % 256).cast("string")))).when(k % 4 == 2, F.array(F.lit("300.1.1.1"))).otherwise(none)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"), enrich.primary_ip(a, F.when(k % 4 == 1, F.array(F.lit("::1")))).alias("ip"))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    snap = nation.select(F.col("n_nationkey").alias("key"), "n_name", "r_name")
    return enrich.attach(rows, "key", geo=snap).select("c_custkey", enrich.ipv4(F.col("ip")).alias("number"), F.col("geo.n_name").alias("nation"), F.col("geo.r_name").alias("region"), "ip")


@query("""
WITH o AS (SELECT c_custkey, 'd' || c_nationkey AS domain, c_custkey % 3 = 0 AS own, CASE WHEN c_custkey % 6 = 0 THEN CAST(7 AS BIGINT) END AS registered FROM customer),
s AS (SELECT 'd' || s_nationkey AS domain, count(*) FILTER (s_acctbal > 0) AS r, count(*) FILTER (s_acctbal <= 0) AS u FROM supplier GROUP BY 1)
SELECT c_custkey, CASE WHEN own THEN coalesce(registered, r) END AS registered, CASE WHEN own THEN u END AS unregistered, CASE WHEN own THEN coalesce(registered, r) + u END AS total FROM o LEFT JOIN s USING (domain)""")
def original_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant numbers of original domains; what a row has already wins."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("domain"), (F.col("c_custkey") % 3 == 0).alias("is_original_seed"),
        F.when(F.col("c_custkey") % 6 == 0, F.lit(7)).cast("long").alias("registered"), F.lit(None).cast("long").alias("unregistered"))
    stats = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("d"), F.col("s_nationkey").cast("string")).alias("domain")).agg(F.count_if(F.col("s_acctbal") > 0).alias("registered"), F.count_if(F.col("s_acctbal") <= 0).alias("unregistered"))
    return enrich.with_variant_stats(rows, stats).select("c_custkey", "registered", "unregistered", "total")


@query("""
WITH c AS (SELECT o_orderkey, o_orderstatus, ['w' || o_custkey % 40 || '.example.com', CASE WHEN o_orderkey % 3 = 0 THEN 'mail.example.com' ELSE 'brand' || o_orderkey % 9 || '.net' END] AS ds FROM orders),
h AS (SELECT unnest(ds) AS fqdn FROM c WHERE o_orderstatus <> 'P')
SELECT fqdn, count(*) AS n, CASE WHEN fqdn LIKE 'brand%' THEN 'seed:brand' ELSE 'ct:test_all' END AS reason FROM h WHERE fqdn <> 'mail.example.com' GROUP BY fqdn""")
def certificate_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of certificate messages, without noise, with the reasons of the `all` mode."""
    k = F.col("o_orderkey")
    domains = F.array(
        F.concat(F.lit("w"), (F.col("o_custkey") % 40).cast("string"), F.lit(".example.com")),
        F.when(k % 3 == 0, "mail.example.com").otherwise(F.concat(F.lit("brand"), (k % 9).cast("string"), F.lit(".net"))))
    messages = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "P", "heartbeat").otherwise("certificate_update").alias("message_type"),
        F.struct(F.struct(domains.alias("all_domains")).alias("leaf_cert")).alias("data"))
    hosts = route.not_from(route.certificate_hosts(messages)).where(~match.is_noise(F.col("fqdn")))
    reasons = F.when(F.startswith("fqdn", F.lit("brand")), F.array(F.lit("seed:brand"))).otherwise(F.array().cast("array<string>"))
    return route.match_mode(hosts.withColumn("reasons", reasons), "all").groupBy("fqdn", F.element_at("reasons", 1).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, CAST(0 AS INTEGER) AS position, 'http://h' || l_partkey || '.com/' AS url, 301 AS status FROM lineitem UNION ALL SELECT l_orderkey, 1, 'https://h' || l_partkey || '.com/', 200 FROM lineitem")
def redirect_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each hop of each chain."""
    host = F.concat(F.lit("://h"), F.col("l_partkey").cast("string"), F.lit(".com/"))
    chain = F.array(F.struct(F.concat(F.lit("http"), host).alias("url"), F.lit(301).alias("status")), F.struct(F.concat(F.lit("https"), host).alias("url"), F.lit(200).alias("status")))
    return route.redirect_hops(table(spark, sf_dir, "lineitem").select("l_orderkey", chain.alias("redirect_chain")), "l_orderkey")


@query("""
SELECT o_orderkey AS domain, o_orderkey % 4 + 1 AS recheck_count, 'Re-check #' || (o_orderkey % 4 + 1) AS reason, o_orderkey % 4 + 1 >= 3 AS last
FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderkey % 4 + 1 <= 3""")
def due_rechecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched domains that are due."""
    queue = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("domain"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("due"), (F.col("o_orderkey") % 4).alias("recheck_count"))
    return route.due_rechecks(queue, F.to_timestamp(F.lit("1998-01-01")))


@query("""
SELECT 'raw.hosts' AS topic, count(*) AS n, count(DISTINCT s_nationkey) AS keys FROM supplier UNION ALL SELECT 'domains.candidates', count(*), count(DISTINCT c_nationkey) FROM customer""")
def topic_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two topics in one stream of records with missing columns filled."""
    a = table(spark, sf_dir, "supplier").select(F.lit("raw.hosts").alias("topic"), F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"))
    b = table(spark, sf_dir, "customer").select(F.lit("domains.candidates").alias("topic"), F.col("c_nationkey").alias("key"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("topic").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE 'ct' END AS src, CASE WHEN c_custkey % 3 = 0 THEN CAST(1704067200 AS BIGINT) ELSE CAST(c_custkey AS BIGINT) END AS observed_at,
  'h' || c_custkey || '.com' AS canonical_fqdn, CAST(c_custkey % 7 = 0 AS INTEGER) AS reasons, coalesce(c_custkey % 4 = 0, FALSE) AS is_original_seed, 8 AS width FROM customer""")
def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in their fixed columns with defaults, without heavy ones."""
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        F.when(k % 5 > 0, "ct").alias("src"), F.when(k % 3 > 0, k.cast("long")).alias("observed_at"), F.concat(F.lit("h"), k.cast("string"), F.lit(".com")).alias("canonical_fqdn"),
        F.lit("x.com").alias("registrable"), k.cast("string").alias("cse_id"), F.lit(None).cast("string").alias("seed_registrable"),
        F.when(k % 7 == 0, F.array(F.lit("seed"))).alias("reasons"), F.when(k % 4 == 0, True).alias("is_original_seed"), F.lit("<html>").alias("html"), F.lit("x").alias("screenshot"))
    light = route.drop_heavy(raw)
    made = route.candidate(light, F.lit(1704067200).cast("long"))
    width = len(made.columns) + len({"html", "screenshot"} & set(light.columns))
    return made.select(F.col("cse_id").cast("long").alias("c_custkey"), "src", "observed_at", "canonical_fqdn", F.size("reasons").alias("reasons"), "is_original_seed", F.lit(width).alias("width"))


@query("""
WITH h AS (SELECT s_suppkey, 'h' || s_suppkey AS fqdn, CASE s_suppkey % 3 WHEN 0 THEN 'dnstwist' WHEN 1 THEN 'ct' END AS src, CAST(s_suppkey % 4 = 0 AS INTEGER) AS n FROM supplier)
SELECT s_suppkey, fqdn, src FROM h WHERE (src IS NULL OR src <> 'dnstwist') AND n > 0""")
def seed_mode_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with a reason, as the `seed` mode keeps them, without a source's own rows."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(F.lit("h"), k.cast("string")).alias("fqdn"), F.when(k % 3 == 0, "dnstwist").when(k % 3 == 1, "ct").alias("src"),
        F.when(k % 4 == 0, F.array(F.lit("seed:registrable:eq"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    return route.match_mode(route.not_from(rows)).select("s_suppkey", "fqdn", "src")
