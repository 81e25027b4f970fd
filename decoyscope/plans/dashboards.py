"""Queries behind dashboards: counters, progress, series, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.operators import rollup
from decoyscope.plans.registry import query, table

#: Order = seed, line = url, return flag = status.
_STATUS = "CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'R' THEN 'failed' ELSE 'open' END"


@query("""
WITH t AS (SELECT count(*) AS messages, count(*) FILTER (value > 20) AS emitted, count(DISTINCT user_id) AS unique_hosts FROM events),
r AS (SELECT reason, count(*) AS n FROM (SELECT unnest([event_type, 'hour' || (hour(ts) % 6)]) AS reason FROM events) q GROUP BY reason ORDER BY n DESC, reason LIMIT 5)
SELECT t.*, (SELECT string_agg(reason || '=' || n, ',' ORDER BY n DESC, reason) FROM r) AS top_reasons FROM t""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run and its five most frequent reasons."""
    e = table(spark, sf_dir, "events").withColumn("reasons", F.array("event_type", F.concat(F.lit("hour"), (F.hour("ts") % 6).cast("string"))))
    return rollup.run_metrics(e, "user_id", "reasons", F.col("value") > 20)


@query(f"""
WITH e AS (SELECT DISTINCT l_orderkey AS seed, l_linenumber AS url, {_STATUS} AS status FROM lineitem WHERE l_returnflag IN ('A', 'R')),
c AS (SELECT seed, count(*) FILTER (status = 'ok') AS crawled, count(*) FILTER (status = 'failed') AS failed FROM e GROUP BY seed),
t AS (SELECT o_orderkey AS seed, o_orderkey % 5 + 1 AS total FROM orders WHERE o_orderkey % 4 > 0),
j AS (SELECT coalesce(t.seed, c.seed) AS seed, coalesce(total, 1) AS total, coalesce(crawled, 0) AS crawled, coalesce(failed, 0) AS failed FROM t FULL JOIN c ON t.seed = c.seed)
SELECT seed, total, crawled, failed, greatest(total - crawled - failed, 0) AS pending, round(100.0 * crawled / total, 2) AS percentage, CASE WHEN crawled + failed >= total THEN 'completed' ELSE 'processing' END AS state FROM j""")
def seed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each seed's urls are crawled."""
    f = F.col("l_returnflag")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seed"), F.col("l_linenumber").alias("url"), F.when(f == "A", "ok").when(f == "R", "failed").otherwise("open").alias("status"))
    totals = table(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("seed"), (F.col("o_orderkey") % 5 + 1).alias("total"))
    return rollup.progress(e, totals).select("seed", "total", "crawled", "failed", "pending", "percentage", "state")


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS crawled, count(*) FILTER (l_returnflag <> 'A') AS failed FROM lineitem GROUP BY l_suppkey")
def probe_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.probe_counters(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "A")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_orderkey % 9 AS failed FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10)
SELECT count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS o_custkey, CAST(sum(failed) AS BIGINT) AS failed FROM r""")
def recent_seed_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the ten newest seeds."""
    o = table(spark, sf_dir, "orders").withColumn("failed", F.col("o_orderkey") % 9)
    return rollup.recent_sums(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], 10, ["o_custkey", "failed"])


@query("SELECT o_orderstatus AS queue, count(*) AS n FROM orders GROUP BY 1")
def queue_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.counts_by(table(spark, sf_dir, "orders"), F.col("o_orderstatus").alias("queue"))


@query("SELECT o_orderkey, o_orderdate, CAST(floor(epoch(TIMESTAMP '2002-01-01' - o_orderdate)) AS BIGINT) AS elapsed FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def oldest_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed that has been worked on longest."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(1)
    return o.select("o_orderkey", "o_orderdate", (F.unix_timestamp(F.lit("2002-01-01").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("elapsed"))


_VERDICT = "CASE event_type WHEN 'error' THEN 'phishing' WHEN 'purchase' THEN 'suspicious' WHEN 'signup' THEN 'parked' ELSE 'clean' END"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    v = F.when(t == "error", "phishing").when(t == "purchase", "suspicious").when(t == "signup", "parked").otherwise("clean")
    return table(spark, sf_dir, "events").withColumn("verdict", v)


@query(f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (v = 'phishing') AS phishing, count(*) FILTER (v = 'suspicious') AS suspicious, count(*) FILTER (v = 'clean') AS clean
FROM (SELECT ts, {_VERDICT} AS v FROM events) q GROUP BY 1""")
def verdict_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts per day."""
    return rollup.verdict_series(_verdicts(spark, sf_dir), "ts", "verdict", ["phishing", "suspicious", "clean"]).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT user_id, min(ts) FILTER (v = 'parked') AS first_parked, arg_max(v, struct_pack(t := ts, i := event_id)) AS last_verdict FROM (SELECT *, {_VERDICT} AS v FROM events) q GROUP BY user_id")
def parked_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each domain was parked first, and its last verdict."""
    return rollup.parked_insights(_verdicts(spark, sf_dir), "user_id", "ts", "verdict", "event_id")


@query("""
SELECT n_name AS country, CASE WHEN GROUPING(c_mktsegment) = 1 THEN NULL ELSE c_mktsegment END AS city, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), (n_name, c_mktsegment))""")
def geo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per country and per place in it."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("city"))
    return rollup.geo_counts(rows, "country", "city").drop("whole")


@query("SELECT c_mktsegment AS sector, count(*) FILTER (s < 40) AS low, count(*) FILTER (s >= 40 AND s < 70) AS medium, count(*) FILTER (s >= 70) AS high FROM (SELECT c_mktsegment, c_acctbal / 100 AS s FROM customer) q GROUP BY 1")
def risk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors by risk band."""
    return rollup.risk_matrix(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("sector"), (F.col("c_acctbal") / 100).alias("score")), "sector", "score")


@query("""
SELECT c_mktsegment AS category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM customer), 2) AS share, string_agg(DISTINCT 'c' || (c_nationkey % 4), ',' ORDER BY 'c' || (c_nationkey % 4)) AS members
FROM customer GROUP BY 1""")
def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each category, and who contributes."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), F.concat(F.lit("c"), (F.col("c_nationkey") % 4).cast("string")).alias("cse"))
    shares = rollup.category_shares(rows, "category", "cse")  # four members a category
    return shares.groupBy("category", "n", "share").agg(F.array_join(F.array_sort(F.collect_list("cse")), ",").alias("members"))


@query("""
SELECT c_mktsegment AS category, t.n, round(100.0 * t.n / (SELECT count(*) FROM customer), 2) AS share, c_custkey // 3 AS member, count(*) AS member_n
FROM customer JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) t USING (c_mktsegment) WHERE c_custkey % 5 > 0 GROUP BY ALL""")
def category_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of each category with its rows, however many there are."""
    member = F.when(F.col("c_custkey") % 5 > 0, F.floor(F.col("c_custkey") / 3).cast("long"))
    return rollup.category_shares(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), member.alias("member")), "category", "member")


@query(f"SELECT count(*) AS scans, count(*) FILTER (v = 'phishing') AS phishing, count(DISTINCT user_id) AS brands, round(avg(value / 100), 3) AS mean_confidence FROM (SELECT *, {_VERDICT} AS v FROM events) q")
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans, hits, brands and mean confidence."""
    return rollup.dashboard(_verdicts(spark, sf_dir).withColumns({"cse_id": F.col("user_id"), "confidence": F.col("value") / 100}))


@query(f"SELECT count(*) AS lookalikes, count(*) FILTER (event_id % 3 > 0) AS with_mx, count(*) FILTER (v <> 'parked') AS active, count(*) FILTER (v = 'parked') AS parked FROM (SELECT *, {_VERDICT} AS v FROM events) q")
def lookalike_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lookalikes take mail, are active, are parked."""
    return rollup.lookalike_summary(_verdicts(spark, sf_dir).withColumn("mx", F.when(F.col("event_id") % 3 > 0, F.array(F.lit("mx")))))


@query("""
WITH n AS (SELECT max(ts) AS t FROM events)
SELECT k AS range, count(*) FILTER (ts > t - to_minutes(m) AND ts <= t) AS n FROM events, n, (VALUES ('5m', 5), ('30m', 30), ('1h', 60), ('24h', 1440)) r(k, m) GROUP BY k""")
def recent_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in each relative range that ends with the newest."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    newest = e.agg(F.max("ts").alias("newest"))  # one row
    return rollup.range_counts(e.crossJoin(F.broadcast(newest)), "ts", F.col("newest"))
