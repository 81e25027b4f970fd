"""Queries over event histories: dedup, ranks, retries, rechecks, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.durable import scratch
from decoyscope.functions import text as T
from decoyscope.operators import dedup, fuse, pages, search, trigrams
from decoyscope.plans.registry import query, table
from decoyscope.sources import collections as C
from decoyscope.sources import records as S


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (
  SELECT user_id, event_id, ts, n FROM e WHERE n = 1
  UNION ALL
  SELECT * FROM (
    SELECT e.user_id, e.event_id, e.ts, e.n FROM k JOIN e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 3 DAY AND e.n > k.n
    QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.n) = 1) q)
SELECT user_id, event_id FROM k""")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which none of the same key was kept in the three days before."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return dedup.first_seen(e, "user_id", "ts", 3 * 86400, "event_id").select("user_id", "event_id")


@query("SELECT user_id, arg_max(event_id, struct_pack(t := ts, i := event_id)) AS event_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS event_type FROM events GROUP BY user_id")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return fuse.latest(e, "user_id", tie="event_id").select("user_id", "event_id", "event_type")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN event_type = 'click' THEN value END AS a, CASE WHEN event_type = 'view' THEN value END AS b FROM events)
SELECT user_id, arg_max(a, ts) FILTER (a IS NOT NULL) AS a, arg_max(b, ts) FILTER (b IS NOT NULL) AS b FROM e GROUP BY user_id""")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest known value of each column of each key."""
    t = F.col("event_type")
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.when(t == "click", F.col("value")).alias("a"), F.when(t == "view", F.col("value")).alias("b"))
    return fuse.merge(e, "user_id").select("user_id", "a", "b")


@query("""
WITH e AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok FROM events),
g AS (SELECT *, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ep ORDER BY ts, event_id) AS k FROM g)
SELECT event_id, CAST(CASE WHEN ok THEN 0 ELSE k END AS INTEGER) AS attempt, NOT ok AND k >= 3 AS dead FROM r""")
def retry_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row of each key; the third is dead."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return dedup.retries(e, "user_id", ["ts", "event_id"], F.col("ok")).select("event_id", "attempt", "dead")


ONE_KEY = "CASE WHEN user_id % 3 = 0 THEN user_id END"


@query(f"""
WITH RECURSIVE e AS (SELECT coalesce({ONE_KEY}, -1) AS k, event_id, ts, row_number() OVER (PARTITION BY {ONE_KEY} ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT k, event_id, ts, n FROM e WHERE n = 1
  UNION ALL
  SELECT * FROM (
    SELECT e.k, e.event_id, e.ts, e.n FROM r JOIN e ON e.k = r.k AND e.ts >= r.ts + INTERVAL 7 HOUR AND e.n > r.n
    QUALIFY row_number() OVER (PARTITION BY e.k ORDER BY e.n) = 1) q)
SELECT k, event_id FROM r""")
def first_seen_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept events where one key, the null key, has two thirds of all rows: it is folded in segments of a hundredth of its rows or more."""
    e = table(spark, sf_dir, "events").select(F.expr(ONE_KEY).alias("k"), "event_id", "ts")
    segment = max(100, e.count() // 150)
    return dedup.first_seen(e, "k", "ts", 7 * 3600, "event_id", segment).select(F.coalesce("k", F.lit(-1)).alias("k"), "event_id")


@query(f"""
WITH e AS (SELECT {ONE_KEY} AS k, event_id, ts, event_id % 50 = 0 AS ok FROM events),
g AS (SELECT *, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY k, ep ORDER BY ts, event_id) AS n FROM g)
SELECT event_id, CAST(CASE WHEN ok THEN 0 ELSE n END AS INTEGER) AS attempt, NOT ok AND n >= 3 AS dead FROM r""")
def retries_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row where one key has two thirds of all rows and long runs of failures cross its segments."""
    ok = F.col("event_id") % 50 == 0
    e = table(spark, sf_dir, "events").select(F.expr(ONE_KEY).alias("k"), "event_id", "ts", ok.alias("ok"))
    return dedup.retries(e, "k", ["ts", "event_id"], F.col("ok"), segment=max(20, e.count() // 1000)).select("event_id", "attempt", "dead")


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events WHERE event_type = 'error')
SELECT user_id, event_id, CAST(n AS INTEGER) AS recheck, 'Re-check #' || n AS reason FROM e WHERE n BETWEEN 1 AND 3""")
def recheck_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three re-checks after adoption."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", "ts")
    return dedup.rechecks(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "recheck", "reason")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) q WHERE n = 1 GROUP BY ALL")
def first_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each kind and key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return dedup.rank_first(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def newest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thousand newest events (the cap is the feature)."""
    return dedup.newest(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), 1000, "ts", "event_id").drop("ts")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 0 AND 5000 ORDER BY c_custkey LIMIT 100 OFFSET 20")
def filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of customers by equality and range."""
    where = search.equal_all({"c_mktsegment": "BUILDING", "c_nationkey": None}) & F.col("c_acctbal").between(0, 5000)
    return search.page(table(spark, sf_dir, "customer").where(where), 100, 20, ["c_custkey"]).select("c_custkey", "c_name")


@query("""
WITH o AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT (n - 1) // 200 AS page, o_orderkey FROM o WHERE n <= 1000""")
def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages of the newest orders, each read from the cursor of the one before (the pages are the feature)."""
    at = scratch(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    for run in (0, 1):
        pages.insert(at, orders.where(F.col("o_orderkey") % 2 == run), "o_orderdate", "o_orderkey", run, 16)
    found, cursor = [], None
    for k in range(5):
        one = pages.page(spark, at, "o_orderdate", "o_orderkey", 200, cursor)
        last = one.orderBy("o_orderdate", "o_orderkey").first()
        cursor = (last["o_orderdate"], last["o_orderkey"]) if last else cursor
        found.append(one.select(F.lit(k).cast("long").alias("page"), "o_orderkey"))
    return reduce(DataFrame.unionByName, found)


@query("""
SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'pairs' END AS pairs, CASE WHEN (c_nationkey > 20 OR c_mktsegment = 'MACHINERY') AND c_acctbal >= 100.5 AND c_mktsegment <> 'FURNITURE' THEN 'tree' END AS tree
FROM customer WHERE (c_nationkey = 3 AND c_acctbal <= 9000) OR ((c_nationkey > 20 OR c_mktsegment = 'MACHINERY') AND c_acctbal >= 100.5 AND c_mktsegment <> 'FURNITURE')""")
def predicate_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that predicates built from text and from nested conditions find."""
    pairs = search.where_pairs(["c_nationkey=3"], {"c_acctbal": (None, 9000)})
    tree = search.where_tree({"$or": [{"c_nationkey": {"$gt": 20}}, {"c_mktsegment": "MACHINERY"}], "c_acctbal": {"$gte": 100.5}, "c_mktsegment": {"$ne": "FURNITURE"}})
    df = table(spark, sf_dir, "customer").where(pairs | tree)
    return df.select("c_custkey", F.when(F.col("c_nationkey") == 3, "pairs").alias("pairs"), F.when(tree, "tree").alias("tree"))


@query("""
SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal < 5000 OR c_custkey = 7 OR c_acctbal <= -900 AND c_nationkey > 5""")
def predicate_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each of the comparison operators helps to find."""
    few = {"c_nationkey": {"$in": [1, 2, 3]}, "c_mktsegment": {"$nin": ["BUILDING", "MACHINERY"]}, "c_acctbal": {"$lt": 5000}}
    tree = {"$or": [few, {"c_custkey": {"$eq": 7}}, {"$and": [{"c_acctbal": {"$lte": -900}}, {"c_nationkey": {"$gt": 5}}]}]}
    return table(spark, sf_dir, "customer").where(search.where_tree(tree)).select("c_custkey")


@query("""
WITH h AS (SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00012'))
SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY c_custkey DESC LIMIT 100""")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that contain a string, the newest hundred, and how many in all."""
    return search.search(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "00012", [F.desc("c_custkey")])


NEEDLES = ["ring", "ED R", "an", "goldenrod", "qx", "e s"]


@query("""
SELECT needle, count(*) AS n, sum(p_partkey) AS keys FROM part, (SELECT unnest(['ring', 'ED R', 'an', 'goldenrod', 'qx', 'e s']) AS needle) q
WHERE contains(lower(p_name), lower(needle)) GROUP BY needle""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold each of some needles, found by an index of character runs."""
    at = scratch(spark)
    trigrams.build(at, table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name")
    found = [trigrams.find(spark, at, "p_partkey", "p_name", n).select(F.lit(n).alias("needle"), "p_partkey") for n in NEEDLES]
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("needle").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query("""
WITH n AS (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 400)
SELECT q.o_orderkey FROM (SELECT n.o_orderkey, o.o_orderdate FROM n JOIN orders o USING (o_orderkey) WHERE n.o_orderstatus = 'F' ORDER BY o.o_orderdate DESC, n.o_orderkey DESC LIMIT 200) q""")
def completed_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 finished of the newest 400 orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return search.filtered_top(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderstatus") == "F", 200).select("o_orderkey")


@query("""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id, label % 2 AS part, 1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS distance FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY distance, vec_id) AS n FROM d)
SELECT vec_id, CAST(part AS INTEGER) AS part, round(1 - distance, 4) AS similarity FROM r WHERE n <= 10""")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each collection to one vector."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id = 0").first()
    q = F.array(*[F.lit(float(x)) for x in asked["embedding"]]) if asked else F.lit(None).cast("array<double>")
    rows = e.select("vec_id", (F.col("label") % 2).cast("int").alias("part"), "embedding")
    return search.cosine_top_k(rows, q, 10, id_="vec_id", by="part").select("vec_id", "part", "similarity")


@query("""
WITH c AS (SELECT c_custkey, 'd' || c_nationkey || '.com:' || c_custkey AS id, 'https://www.d' || (c_nationkey + 1) || '.com/' AS url, 'd' || (c_nationkey + 2) || '.com' AS registrable, 'd' || (c_nationkey + 3) || '.com' AS seed_registrable, c_custkey % 2 = 0 AS is_original FROM customer),
r AS (SELECT *, CASE WHEN starts_with(id, 'd7.com:') THEN 1 WHEN url = 'https://www.d7.com/' THEN 2 WHEN registrable = 'd7.com' THEN 3 WHEN seed_registrable = 'd7.com' THEN 4 END AS rule FROM c)
SELECT id, CAST(rule AS INTEGER) AS rule FROM r WHERE rule IS NOT NULL ORDER BY is_original DESC, rule, id LIMIT 1""")
def domain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of a domain over originals and variants."""
    n = F.col("c_nationkey")
    name = lambda k: F.concat(F.lit("d"), (n + k).cast("string"), F.lit(".com"))
    rows = table(spark, sf_dir, "customer").select(
        F.concat(name(0), F.lit(":"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("https://www."), name(1), F.lit("/")).alias("url"),
        name(2).alias("registrable"), name(3).alias("seed_registrable"), (F.col("c_custkey") % 2 == 0).alias("is_original"))
    return search.domain_lookup(rows, "d7.com").select("id", "rule")


@query("""
SELECT strategy, count(*) AS n FROM (
  SELECT 'by_id' AS strategy FROM customer WHERE c_custkey < 50 UNION ALL SELECT 'by_brand' FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'by_risk' FROM customer WHERE c_acctbal < 0) q GROUP BY strategy""")
def lookup_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each way of looking finds."""
    df = table(spark, sf_dir, "customer")
    found = search.strategies(df, {"by_id": F.col("c_custkey") < 50, "by_brand": F.col("c_mktsegment") == "BUILDING", "by_risk": F.col("c_acctbal") < 0})
    return found.groupBy("strategy").agg(F.count("*").alias("n"))


@query("""
WITH k AS (SELECT n_nationkey * 97 AS c_custkey FROM nation)
SELECT k.c_custkey, c_name, c.c_custkey IS NOT NULL AS found FROM k LEFT JOIN customer c ON c.c_custkey = k.c_custkey""")
def seed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked keys with their rows; a miss is a row too."""
    keys = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") * 97).alias("c_custkey"))
    return search.status_of(keys, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("""
WITH a AS (SELECT s_suppkey % 40 AS domain, 'active' AS queue, s_suppkey AS due FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey % 60, 'inactive', s_suppkey FROM supplier WHERE s_suppkey % 2 = 1)
SELECT domain, min(queue) AS queue, min(due) FILTER (queue = q) AS due FROM (SELECT *, min(queue) OVER (PARTITION BY domain) AS q FROM a) x GROUP BY domain""")
def monitoring_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per watched domain, active before inactive."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return search.monitoring_lookup(s.where(k % 2 == 0).select((k % 40).alias("domain"), k.alias("due")), s.where(k % 2 == 1).select((k % 60).alias("domain"), k.alias("due")))


@query("""
SELECT event_id, strftime(to_timestamp(event_id * 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch(TIMESTAMP '2024-03-01' - ts) / 86400) AS BIGINT) AS days,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 24 * 3600 + 1704067200 AS BIGINT) END AS shot, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(len(json_keys(props)) AS INTEGER) AS keys FROM events""")
def time_and_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times between their encodings, and values of JSON columns."""
    i = F.col("event_id")
    exif = F.when(i % 3 == 0, F.concat(F.lit("2024:01:01 "), F.lpad((i % 24).cast("string"), 2, "0"), F.lit(":00:00"))).otherwise("no date")
    return table(spark, sf_dir, "events").select(
        "event_id", T.epoch_to_iso(i * 1000).alias("iso"), T.days_between(F.lit("2024-03-01").cast("timestamp"), F.col("ts").cast("timestamp")).alias("days"),
        F.unix_timestamp(T.exif_time(exif)).alias("shot"), F.from_json("props", "k bigint")["k"].alias("k"), F.size(F.json_object_keys("props")).alias("keys"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines with bad lines among them, read again, bad lines dropped."""
    at = scratch(spark)
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    S.write_jsonl(e, at, "20240101T000000Z")
    e.where("event_id % 100 = 0").select(F.lit("{broken").alias("value")).write.mode("append").text(f"{at}/bad")
    good, _ = S.read_jsonl(spark, at, "event_id bigint, event_type string, value double", "*.{json,txt}")
    return good.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""
WITH l AS (SELECT user_id, event_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, event_id, value FROM l WHERE n = 1""")
def upserted_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the events put one after the other into a keyed collection."""
    at = scratch(spark)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    C.upsert(spark, at, e.where(F.col("at.ts") < middle), "user_id", "at", 0)
    last = C.upsert(spark, at, e.where(F.col("at.ts") >= middle), "user_id", "at", 1, merge=False)
    return C.collection(spark, at, last).select("user_id", "event_id", "value")


@query("""
WITH c AS (SELECT c_custkey AS k, c_name, c_nationkey FROM customer)
SELECT 'seeds' AS source, count(*) AS n, min(lower(c_name) || '.com') AS least FROM c WHERE k % 5 > 0
UNION ALL SELECT 'list', count(*), min('t' || k) FROM c WHERE k % 7 > 1
UNION ALL SELECT 'bulk', count(*), min(c_name) FROM c WHERE k % 4 > 0""")
def read_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, a list of terms and a bulk file written from customers with blanks and comments among them, and read again."""
    at, k = scratch(spark), F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    seeds = c.select(F.concat(F.lit(" c"), k.cast("string")).alias("cse_id"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" "), F.upper("c_name"), F.lit(".COM "))).alias("seed_registrable"))
    seeds.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{at}/seeds")
    c.select(F.when(k % 7 == 0, "# comment").when(k % 7 == 1, "  ").otherwise(F.concat(F.lit(" t"), k.cast("string"))).alias("value")).write.text(f"{at}/list")
    c.select(F.when(k % 4 == 0, " ").otherwise(F.col("c_name")).alias("a"), "c_nationkey").write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{at}/bulk")
    found = [("seeds", S.read_seeds(spark, f"{at}/seeds"), "seed_registrable"), ("list", S.read_list(spark, f"{at}/list"), "term"), ("bulk", S.read_bulk_csv(spark, f"{at}/bulk"), "input")]
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.min(value).alias("least")) for name, df, value in found])


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def dumped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection dumped as pages of JSON lines, a hundred rows each at most, and read again."""
    at = scratch(spark)
    S.dump_all(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), at, page_size=100, page="page")
    lines = spark.read.schema("c_custkey long, c_mktsegment string, c_acctbal double, page long").json(at)
    sizes = lines.groupBy("page", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"))
    whole = sizes.groupBy("page").agg(F.sum("n").alias("rows")).where("rows <= 100").select("page")
    return sizes.join(whole, "page").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


#: Batches of events by id; those of the third replace whole rows, the others keep what they have no value for.
BATCHES = 6


@query(f"""
WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type <> 'view' THEN value END AS value, event_id * {BATCHES} // (SELECT max(event_id) + 1 FROM events) AS b FROM events),
n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, b ORDER BY event_id DESC) = 1),
f AS (SELECT user_id, coalesce(max(b) FILTER (b = 2), 0) AS floor FROM n GROUP BY user_id)
SELECT user_id, arg_max(event_id, b) AS event_id, arg_max(event_type, b) AS kind, arg_max(value, b) FILTER (value IS NOT NULL AND b >= floor OR b = 2) AS value,
  min(event_id) FILTER (b = 0 AND floor = 0) AS oldest
FROM n JOIN f USING (user_id) GROUP BY user_id""")
def merged_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection after six upserts, one of which replaces; the first one's column `oldest` is never given again."""
    at = scratch(spark)
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("event_id") + 1).first()[0]
    value = F.when(F.col("event_type") != "view", F.col("value"))
    rows = e.select("user_id", "event_id", F.col("event_type").alias("kind"), value.alias("value"), F.floor(F.col("event_id") * BATCHES / top).alias("b"))
    for b in range(BATCHES):
        oldest = F.col("event_id") if b == 0 else F.lit(None).cast("long")
        C.upsert(spark, at, rows.where(F.col("b") == b).drop("b").withColumn("oldest", oldest), "user_id", "event_id", b, merge=b != 2)
    return C.collection(spark, at, BATCHES - 1)


@query("""
WITH e AS (SELECT user_id, event_id, CAST(strftime(ts, '%d') AS INTEGER) AS day FROM events),
n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, event_id DESC) = 1)
SELECT user_id, event_id, day FROM n WHERE user_id % 7 = 3""")
def collection_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of some keys of a collection of several segments, read by the segments' key filters."""
    at = scratch(spark)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.dayofmonth("ts").alias("day")).withColumn("at", F.struct("day", "event_id"))
    for v, (low, high) in enumerate([(0, 25), (26, 29), (30, 31)]):
        C.upsert(spark, at, e.where(F.col("day").between(low, high)), "user_id", "at", v)
    keys = e.where("user_id % 7 = 3").select("user_id").distinct()
    return C.lookup(spark, at, 2, keys).drop("at")


@query("SELECT 'originals' AS collection, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'variants', count(*) FROM customer WHERE c_custkey % 3 <> 0")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of originals and variants, null marks counting as variants."""
    k = F.col("c_custkey") % 3
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, True).when(k == 1, False).alias("is_original_seed"))
    own, other = S.split_collections(rows)
    both = own.select(F.lit("originals").alias("collection")).unionByName(other.select(F.lit("variants").alias("collection")))
    return both.groupBy("collection").agg(F.count("*").alias("n"))


@query("SELECT 'c' || c_custkey AS id, c_name AS document, c_mktsegment AS segment, c_acctbal > 0 AS solvent FROM customer")
def whole_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored collection read as a whole: id, document and the rest as metadata."""
    at = scratch(spark)
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("document"), "c_mktsegment", (F.col("c_acctbal") > 0).alias("solvent"))
    rows.write.parquet(at)
    return S.fetch_all(spark, at).select("id", "document", F.col("metadata.c_mktsegment").alias("segment"), "metadata.solvent")
