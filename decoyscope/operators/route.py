"""Candidates, crawl requests and the routing of probe records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.functions.text import first_non_empty
from decoyscope.functions.url import extract_domain, is_valid_domain, normalize_url
from decoyscope.functions.variant import first_text, first_value, flag_at, record, settled

#: Schema of probe records as JSON.
PROBE = "ok boolean, url string, final_url string, final struct<url:string,title:string>, result struct<final_url:string>, href string, input_url string, canonical_fqdn string, fqdn string, host string, domain string, registrable string, cse_id string, error string, ts long"
HEAVY = ["html", "raw_html", "pdf", "screenshot", "screenshots", "page_html", "image_bytes"]


def pick_fqdn(r: Column) -> Column:
    return first_non_empty(r["canonical_fqdn"], r["fqdn"], r["host"], r["domain"])


def pick_url(r: Column) -> Column:
    return first_non_empty(r["url"], r["final_url"], r["final"]["url"], r["result"]["final_url"], r["input_url"], r["href"])


def drop_heavy(df: DataFrame) -> DataFrame:
    return df.drop(*HEAVY)


def parse(values: DataFrame, schema: str = PROBE) -> DataFrame:
    """Adds `rec` from the JSON in `value`; null where it can't be read."""
    whole = F.json_object_keys("value").isNotNull()
    return values.withColumn("rec", F.when(whole, F.from_json("value", schema)))


#: Objects in which a record may hold its url, an object of the probe itself, names of a seed's id, and fields that are passed on.
CONTAINERS = ["result", "http", "http_result", "artifact", "artifacts", "data"]
PROBED = "final"
SEED_IDS = ["cse_id", "id", "cse", "canonical_id"]
PASSED = ["status", "status_code", "title", "registrable", "brand", "seed_registrable", "canonical_fqdn", "fqdn"]


def found_url(v: Column) -> Column:
    """A record's url: final_url before url, then the probe's own, then those of the containers, in order; only strings count."""
    return first_text(v, ("final_url",), ("url",), (PROBED, "url"), *[(k, name) for k in CONTAINERS for name in ("final_url", "url", "location")])


def found_seed(v: Column) -> Column:
    """The id of the seed that a record belongs to, from the top level or the containers, in order."""
    return first_text(v, *[(*at, name) for at in [(), *((k,) for k in (*CONTAINERS, PROBED))] for name in SEED_IDS])


def passed_field(v: Column, name: str) -> Column:
    """A field of any type: the top level wins, then the first container that has it."""
    return first_value(v, (name,), *[(k, name) for k in (*CONTAINERS, PROBED)])


def route(values: DataFrame) -> DataFrame:
    """Adds rec (a variant), route (crawl, inactive, dead), failure_type, url and raw_value to JSON records in `value`.

    Unreadable values are dead letters, rows with ok = false are inactive,
    rows without a url or with an invalid one are dead letters again.
    """
    r = F.col("rec")
    failed = flag_at(r, "ok").eqNullSafe(F.lit(False))
    df = settled(settled(values, rec=record(F.col("value"))), _url=found_url(r)).withColumn("url", normalize_url(F.col("_url")))
    kind = (
        F.when(r.isNull(), "json_parse_error")
        .when(failed, F.coalesce(first_text(r, ("error",)), F.lit("connection_failed")))
        .when(F.col("_url").isNull(), "missing_url")
        .when(F.col("url").isNull(), "invalid_url")
    )
    where = F.when(failed, "inactive").when(F.col("url").isNull(), "dead").otherwise("crawl")
    return df.withColumns({"route": where, "failure_type": kind, "raw_value": F.when(where == "dead", F.left("value", F.lit(500)))}).drop("_url")


def inactive(routed: DataFrame) -> DataFrame:
    """Records of inactive hosts that name one; only their top level counts."""
    r = F.col("rec")
    name = first_text(r, ("registrable",), ("canonical_fqdn",), ("fqdn",))
    return routed.where("route = 'inactive'").select(
        name.alias("registrable"), F.coalesce(first_text(r, ("canonical_fqdn",)), name).alias("canonical_fqdn"), first_text(r, ("cse_id",)).alias("cse_id"),
        first_text(r, ("seed_registrable",)).alias("seed_registrable"), F.lit("inactive").alias("status"), "failure_type",
        F.array(F.lit("http_probe_failed")).alias("reasons")).where("registrable is not null")


def crawl_requests(routed: DataFrame, now: Column | None = None) -> DataFrame:
    """Versioned request as JSON, without absent fields, keyed by url; `now` is its time in milliseconds."""
    r = F.col("rec")
    passed = ["registrable", "title", "status", "status_code", "brand", "canonical_fqdn", "seed_registrable"]
    time = [] if now is None else [F.unix_millis(now).alias("ts")]
    body = F.struct(F.lit("v1").alias("schema_version"), F.col("url").alias("url"), *time, found_seed(r).alias("cse_id"), *[passed_field(r, k).alias(k) for k in passed])
    return routed.where("route = 'crawl'").select(F.col("url").alias("key"), F.to_json(body).alias("value"))


def dead_letters(routed: DataFrame) -> DataFrame:
    """(failure_type, raw_value, record_keys) of what can't be crawled; a record's keys tell its shape."""
    return routed.where("route = 'dead'").select("failure_type", "raw_value", F.json_object_keys("value").alias("record_keys"))


def candidate(df: DataFrame, now: Column) -> DataFrame:
    """Fixed candidate columns with defaults."""
    none = F.array().cast("array<string>")
    return df.select(
        F.coalesce("src", F.lit("unknown")).alias("src"), F.coalesce("observed_at", now).alias("observed_at"), "canonical_fqdn", "registrable",
        "cse_id", "seed_registrable", F.coalesce("reasons", none).alias("reasons"), F.coalesce("is_original_seed", F.lit(False)).alias("is_original_seed"))


def bulk_report(inputs: DataFrame, most: int = 10_000) -> DataFrame:
    """(idx, input, domain, status) of a bulk submission; all rows are refused beyond `most`."""
    n = inputs.count()
    d = extract_domain(F.col("input"))
    verdict = F.lit("Too many domains") if n > most else F.when(is_valid_domain(d), "queued").otherwise("Invalid domain format")
    return inputs.select("idx", "input", d.alias("domain"), verdict.alias("status"))


def certificate_hosts(messages: DataFrame) -> DataFrame:
    """A row for each domain of each certificate update; other messages are left out.

    messages: message_type, data.leaf_cert.all_domains.
    """
    return messages.where(F.col("message_type") == "certificate_update").select(F.explode("data.leaf_cert.all_domains").alias("fqdn"), F.lit("ct").alias("src"))


def redirect_hops(rows: DataFrame, key: str, chain: str = "redirect_chain") -> DataFrame:
    """(key, position, url, status) for each hop of an array of struct(url, status)."""
    return rows.select(key, F.posexplode(chain).alias("position", "hop")).select(key, "position", "hop.url", "hop.status")


def match_mode(rows: DataFrame, mode: str = "seed") -> DataFrame:
    """`seed` drops rows without a reason; `all` keeps them with the reason ct:test_all."""
    if mode == "seed":
        return rows.where(F.size("reasons") > 0)
    return rows.withColumn("reasons", F.when(F.size("reasons") == 0, F.array(F.lit("ct:test_all"))).otherwise(F.col("reasons")))


def not_from(rows: DataFrame, src: str = "dnstwist") -> DataFrame:
    """Without rows of a source, null sources kept; guards against a loop of one's own output."""
    return rows.where(~F.col("src").eqNullSafe(F.lit(src)))


def due_rechecks(queue: DataFrame, as_of: Column, most: int = 3) -> DataFrame:
    """Entries that are due, with their next count and whether that is the last one (queue: domain, due, recheck_count)."""
    n = F.col("recheck_count") + 1
    return queue.where((F.col("due") <= F.unix_timestamp(as_of)) & (n <= most)).select("domain", n.alias("recheck_count"), F.concat(F.lit("Re-check #"), n.cast("string")).alias("reason"), (n >= most).alias("last"))
